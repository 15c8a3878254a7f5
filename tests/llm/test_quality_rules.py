import random
import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from tripwire.llm import quality_rules as Q
from tripwire.llm.queries import QUERIES

from .conftest import SF


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    c = Counter(wins)
    inside = {j for i, w in enumerate(wins) if c[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            n < 20 or 100 * len(inside) > 30 * n)


def test_base_equals_brute_force_on_whole_table(spark, texts_sf):
    got = {r.doc_id: tuple(r)[1:7] for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    assert got == {r.doc_id: brute(r.text) for r in texts_sf.itertuples()}


def test_repeat_words_random():
    rnd = random.Random(5)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 60))]
        assert Q.repeat_words(words) == brute(" ".join(w.decode() for w in words))[4]


def test_bands_and_edges(make_docs):
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rnd.randint(0x21, 0x2FFF)) for _ in range(30)) for _ in range(80))
    # one phrase with a changing number: no 8-word window repeats, yet it compresses far too well
    repeated = " ".join(f"buy cheap pills now {i}" for i in range(2000))
    pad = " " * 40_000
    rows = [None, "", " \n\t ", "few words", prose, prose, noise, repeated, prose + pad + prose[::-1], "x" * 200_000]
    out = Q.quality_rules(make_docs(rows).withColumn("quality_verdict", F.lit(1))).orderBy("doc_id").collect()
    got = [r.quality.reason for r in out]
    assert got == ["few_words"] * 4 + [None, None, "incompressible", "repetitive", out[8].quality.reason, "few_words"]
    assert got[8] in ("repetitive", "odd_chunks")
    assert [r.quality.kept for r in out] == [g is None for g in got]
    assert out[7].quality.base_failed is False
    kept = Q.kept_documents(make_docs(rows).withColumn("quality_verdict", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality_verdict"]
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5]


def test_ratio_is_zstd(make_docs):
    text = "abc def " * 40
    r = Q.quality_rules(make_docs([text])).first().quality
    assert r.zstd_ratio == len(text) / len(zstandard.ZstdCompressor(level=3).compress(text.encode()))


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    rows = QUERIES["op1_quality_rules"](spark, SF).filter("not base_failed").join(labels, "doc_id")
    assert rows.filter("not kept").count() == 0


def test_empty_table(make_docs):
    assert Q.kept_documents(make_docs([])).count() == 0
