"""Registered queries of the text operators and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from tripwire.llm import decontaminate, secret_scan
from tripwire.llm.decontaminate import op8_decontaminate
from tripwire.llm.hmm_lm import op4_hmm_lm
from tripwire.llm.html_wrappers import op3_html_wrappers
from tripwire.llm.license_scan import op5_license_scan
from tripwire.llm.mixing import op6_mixing
from tripwire.llm.pii import op9_pii_surrogates
from tripwire.llm.prefix_trie import op13_prefix_trie
from tripwire.llm.quality_classifier import op2_quality_classifier
from tripwire.llm.quality_rules import op1_quality_rules
from tripwire.llm.secret_scan import op7_secret_scan
from tripwire.llm.simhash import op10_simhash
from tripwire.llm.spelling import op11_spelling
from tripwire.llm.token_files import op12_token_files

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_wrappers": op3_html_wrappers,
    "op4_hmm_lm": op4_hmm_lm,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_token_files": op12_token_files,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_secret_scan": secret_scan.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
}
