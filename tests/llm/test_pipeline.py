import re

import pandas as pd
import pytest
import zstandard

import corpus_pipeline as P
from tripwire.llm import quality_rules as Q

from .conftest import SF
from .test_decontaminate import brute as brute_hits
from .test_mixing import check as check_mix
from .test_quality_rules import brute as brute_quality
from .test_secret_scan import cut
from .test_simhash import brute_components, brute_print


def brute_kept(text):
    """Base rules and bands in the plain: one verdict per text."""
    *_, failed = brute_quality(text)
    if failed:
        return False
    b, pack, bands = text.encode(), zstandard.ZstdCompressor(level=3), Q.Bands()
    ratio = lambda x: len(x) / len(pack.compress(x))
    low, high = [(lo, hi) for size, lo, hi in bands.whole if len(b) >= size][-1:][0] if len(b) >= 64 else (0, 1e9)
    chunks = [b[i:i + 4096] for i in range(0, len(b), 4096)] if len(b) > 4096 else []
    chunks = [x for x in chunks if len(x) >= 2048]
    odd = [x for x in chunks if not bands.chunk_low <= ratio(x) <= bands.chunk_high]
    return low <= ratio(b) <= high and len(odd) <= bands.odd_share * len(chunks)


@pytest.fixture(scope="module")
def expected():
    """Documents that reach the mix, by brute force over whole tables: {doc_id: (text, source)}."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    docs = docs[[brute_kept(t) for t in docs.text]]
    comp = brute_components([brute_print(t) for t in docs.text])
    docs = docs[[c == i for i, c in enumerate(comp)]]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for t in bench.text:
        w = words.findall(t.lower())
        assert len(w) >= 13
        grams |= {tuple(w[i:i + 13]) for i in range(len(w) - 12)}
    keep = []
    for t in docs.text:
        w = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hit = {p for i in range(len(w) - 12) if tuple(w[i:i + 13]) in grams for p in range(i, i + 13)}
        keep.append(not (hit and 20 * len(hit) >= len(w)))
    docs = docs[keep]
    return {r.doc_id: (cut(r.text), r.source) for r in docs.itertuples()}


def test_run_equals_brute_force(spark, expected):
    rows = P.run(spark, SF).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    assert all(r.text == expected[r.doc_id][0] and r.n_chars == len(r.text) and r.taken > 0 for r in rows)
    got = {r.doc_id: r.asDict() for r in rows}
    sizes = {s: r.source_size for r in rows for s in [r.source]}
    target = {s: r.target for r in rows for s in [r.source]}
    full = [got.get(i, {"doc_id": i, "size": len(t.split()), "source_size": sizes[s], "target": target[s], "taken": 0})
            for i, (t, s) in expected.items()]
    check_mix(full, [(i, t, s) for i, (t, s) in expected.items()])


def test_stages_keep_the_columns(spark, make_docs):
    prose = ("The ferry left the harbour before dawn, carrying two crates of oranges, a retired judge and "
             "her nephew, who had never seen open water and asked the mate about every light on the shore.")
    docs = make_docs([None, "", "short", prose])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [r.doc_id for r in docs.collect()] == [3]


def test_empty_documents(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources"]
    assert brute_hits(["a"], [(1, "a")]) == [(1, [0], ["1"])]
