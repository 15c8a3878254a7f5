import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwire.llm import hmm_lm as H
from tripwire.llm.queries import QUERIES

from .conftest import SF


def toy(states=3, symbols=4, seed=0):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    emit = r.random((symbols, states))
    return H.Hmm(norm(r.random(states)), norm(r.random(states)), norm(r.random((states, states))), emit / emit.sum(0))


def paths(m, start, seq):
    for p in itertools.product(range(len(start)), repeat=len(seq)):
        w = start[p[0]] * m.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            w *= m.move[p[t - 1], p[t]] * m.emit[seq[t], p[t]]
        yield p, w


def test_forward_is_the_sum_over_all_paths():
    m = toy()
    seqs = [[0], [1, 2, 3], [3, 3], [0, 1, 2, 3, 0, 1], [2]]
    got = m.log10_of([np.array(s) for s in seqs])
    assert got == pytest.approx([math.log10(sum(w for _, w in paths(m, m.start, s))) for s in seqs])


def test_long_text_does_not_underflow():
    m = toy()
    got = m.log10_of([np.tile([0, 1, 2, 3], 5000), np.array([1])])
    assert np.isfinite(got).all() and got[0] < -1000


def test_expected_counts_are_the_sum_over_all_paths():
    m = toy(2, 3, 4)
    runs, firsts = [[0, 1, 2, 1], [2, 2], [1], [0, 0, 1]], [True, False, True, False]
    packed = np.full((4, 4), -1)
    for i, r in enumerate(runs):
        packed[i, :len(r)] = r
    sums = {"start": np.zeros(2), "again": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((3, 2))}
    m.expected(packed, np.array(firsts), sums)
    want = {k: np.zeros_like(v) for k, v in sums.items()}
    for r, f in zip(runs, firsts):
        ps = list(paths(m, m.start if f else m.again, r))
        total = sum(w for _, w in ps)
        for p, w in ps:
            want["start" if f else "again"][p[0]] += w / total
            for t, k in enumerate(p):
                want["emit"][r[t], k] += w / total
                if t:
                    want["move"][p[t - 1], k] += w / total
    for k in sums:
        assert sums[k] == pytest.approx(want[k], rel=1e-4, abs=1e-5)


def test_rounds_never_lower_the_likelihood(spark):
    r = np.random.default_rng(3)
    texts = [np.concatenate([r.integers(0, 3, 15), r.integers(3, 6, 15)]).astype("<i2") for _ in range(40)]
    df = spark.createDataFrame([(t.tobytes(),) for t in texts], "symbols binary")
    like = [H.baum_welch(df, np.full(6, 1 / 6), states=2, rounds=n, run=64).log10_of(texts).sum() for n in (1, 3, 8)]
    assert like[0] < like[1] < like[2]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" "]


def base_of(rows, held):
    train = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        ws = words_of(t)
        out.setdefault(i, []).append((len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_whole_table(spark, texts_sf):
    rows = QUERIES["op4_hmm_lm"](spark, SF).collect()
    want = base_of(list(zip(texts_sf.doc_id, texts_sf.text)), fold)
    assert len(rows) == len(texts_sf)
    for r in rows:
        n, k, total, base = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, fold(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_join_equals_broadcast(spark, make_docs):
    """The same model whether a word's count comes from the broadcast or from the join."""
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.3, 40) if x < 5000)) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, "w1 w2"), (None, None), (100, ""), (2**62 + 1, "new words here w1 new"), (102, "W1 É é")]
    docs = make_docs(rows).withColumn("row_key", F.lit("clash")).withColumn("e", F.lit(0))
    held = F.pmod(H.crc_of_id(F.col("doc_id")), F.lit(10)) == 0
    kw = {"states": 3, "top": 8, "classes": 4, "rounds": 2}
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6))
    few = sorted(H.score(docs, held, known=12, **kw).collect(), key=key)
    many = sorted(H.score(docs, held, known=100_000, **kw).collect(), key=key)
    assert len(few) == len(many) == len(rows)
    want = base_of(rows, fold)
    for a, b in zip(few, many):
        assert key(a) == key(b) and a.score == pytest.approx(b.score, rel=1e-6)
        assert any((a.n_tokens, a.n_known) == w[:2] and a.base_score == pytest.approx(w[3]) for w in want[a.doc_id])


def test_word_probabilities_sum_to_one(spark, make_docs):
    docs = make_docs(["a a b c d e f g h", "a b c x y z", "q r s t"])
    counts = H.word_counts(docs)
    v = H.vocabulary(counts, top=4, classes=3)
    v.prepare()
    share = np.zeros(3)
    for w, n in zip(v.words[4:], v.counts[4:]):
        share[H.class_of(w, 3)] += (n + H.ADD) / v.class_norm[H.class_of(w, 3)]
    unseen = H.ADD / v.class_norm
    assert share + unseen == pytest.approx(np.ones(3))


def test_empty_tables(spark, make_docs):
    held = F.lit(True)
    assert H.score(make_docs([]), held).count() == 0
    got = H.score(make_docs([None, "a b"]), held, rounds=1).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(np.isfinite(r.score) for r in got)
