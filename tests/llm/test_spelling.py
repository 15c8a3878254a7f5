import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.llm import spelling as S
from tripwire.llm.queries import QUERIES

from .conftest import SF


def brute_counts(docs):
    n = Counter()
    for i, text in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near_words(counts):
    """Every word against every word of its length and of one more, place by place (no signature of any kind)."""
    near = {w: [] for w in counts}
    size = {}
    for w in sorted(counts):
        size.setdefault(len(w), []).append(w)
    codes = {m: np.array([[ord(c) for c in w] for w in v], np.int32) for m, v in size.items()}
    for m, v in size.items():
        for at, w in enumerate(v):
            own = codes[m][at]
            same = np.nonzero((codes[m][at + 1:] != own).sum(axis=1) == 1)[0] + at + 1
            found = [v[i] for i in same]
            if m + 1 in size:  # equal before some place, and one further after it
                long = codes[m + 1]
                before = np.cumprod(long[:, :m] == own, axis=1).sum(axis=1)
                after = np.cumprod((long[:, 1:] == own)[:, ::-1], axis=1).sum(axis=1)
                found += [size[m + 1][i] for i in np.nonzero(before + after >= m)[0]]
            for o in found:
                near[w].append(o)
                near[o].append(w)
    return near


def brute(counts):
    near, form = near_words(counts), {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_whole_table_equals_brute_force(spark, texts_sf):
    counts = brute_counts(zip(texts_sf.doc_id, texts_sf.text))
    got = QUERIES["op11_spelling"](spark, SF)
    assert rows_of(got) == brute(counts)
    assert sum(r[1] is not None for r in rows_of(got)) > 20


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_hot_chunks_lose_no_pair(spark, bucket):
    """Many words that share a half; small buckets send them through the deletion keys."""
    rnd = random.Random(bucket)
    words = {"internat" + "".join(rnd.choices("abé", k=rnd.randint(0, 5))) for _ in range(150)}
    words |= {"".join(rnd.choices("ab", k=rnd.randint(1, 3))) + "sharedend" for _ in range(60)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaa", "abaaaaa"} | {"a" * n for n in range(7, 16)}
    counts = {w: rnd.choice([2, 3, 30, 400]) for w in sorted(words)}
    assert rows_of(S.variants(frame(spark, counts), bucket=bucket)) == brute(counts)


def test_forms_ties_chains_and_roots(spark):
    counts = {"spelling": 5000, "spellinq": 400, "spelljnq": 30, "spzlljnq": 2,  # a chain
              "speling": 500, "swelling": 5000, "xspelling": 501, "éspelling": 2, "alonewords": 3}
    got = {r[0]: r for r in rows_of(S.variants(frame(spark, counts)))}
    assert set(got.values()) == brute(counts)
    assert got["spzlljnq"][2] == "spelling" and got["xspelling"][1] is None and got["alonewords"][2] == "alonewords"


def test_edges(spark, make_docs):
    long = "abcdefg" * 3000
    texts = [None, "", "short words only", f"{long} {long}x", f"{long}, {long}x", "Café-Society ÉCLAIRS éclairs Éclairs", "ÉCLAIRS  café" * 3,
             "x" * 7 + "÷×" + "y" * 7, "xxxxxxx÷×yyyyyyy"]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3
    docs = make_docs(rows)
    for name in ("word", "n", "i", "t", "key", "m", "k", "own"):
        docs = docs.withColumn(name, F.lit("own"))
    got = rows_of(S.variants(S.word_counts(docs)))
    assert got == brute(brute_counts([("" if i is None else i, t) for i, t in rows]))
    assert max(len(r[0]) for r in got) > 20_000


def test_empty_table(spark, make_docs):
    assert S.variants(S.word_counts(make_docs([]))).count() == 0
