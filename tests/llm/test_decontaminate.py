import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tripwire.llm import decontaminate as D
from tripwire.llm.common import lower_terms
from tripwire.llm.queries import ORACLES, QUERIES

from .conftest import SF


def brute(docs, items, window=13):
    """{row: (n_words, hit positions, item ids)} by comparing every position with every pattern."""
    wins = []
    for i, t in items:
        w = lower_terms(t)
        m = min(window, len(w))
        wins += [(i, w[k:k + m]) for k in range(len(w) - m + 1)] if m else []
    out = []
    for t in docs:
        w = lower_terms(t)
        hit, ids = set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= {str(i)} if i is not None else set()
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def rows_of(df):
    got = {}
    for r in df.collect():
        hit = sorted({p for s in r.hits.spans for p in range(s.a, s.z)})
        got[r.doc_id] = (r.hits.n_words, hit, list(r.hits["items"]))
    return got


def case(seed=3):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "dé", "E1"]

    def say(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    items = [(i, say(rnd.choice([0, 1, 2, 3, 5, 13, 14, 30]))) for i in range(14)] + [(3, None), (None, say(13)), (7, say(20))]
    items = [(i, t) for i, t in items if t is None or len(t.split()) not in (1, 2)] + [(90, "zz!"), (91, "x. y")]
    docs = []
    for _ in range(60):
        t = say(rnd.randint(0, 40))
        if rnd.random() < 0.6:
            t += " - " + (rnd.choice(items)[1] or "").upper() + "! " + say(rnd.randint(0, 9))
        docs.append(t + rnd.choice(["", " zz", " x y", " xy"]))
    return docs + [None, "", "?!"], items


@pytest.mark.parametrize("block_words", [400_000, 10])
def test_equals_brute_force(spark, make_docs, block_words):
    docs, items = case()
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    frame = make_docs(docs).withColumn("t", F.lit("clash")).withColumn("text_key", F.lit(1)).withColumn("same_text", F.lit(1))
    found = D.benchmark_hits(frame, bench, block_words=block_words)
    assert found.columns == frame.columns + ["hits"]
    got = rows_of(found)
    assert got == dict(enumerate(brute(docs, items)))


def test_table_search_random():
    rnd = random.Random(1)
    for _ in range(200):
        m = rnd.randint(1, 6)
        pats = [tuple(rnd.choice("ab") for _ in range(m)) for _ in range(rnd.randint(1, 5))]
        t = D.WuManber(m)
        for i, p in enumerate(pats):
            t.add(p, i)
        text = tuple(rnd.choice("abc") for _ in range(40))
        want = [(k, {i for i, p in enumerate(pats) if p == text[k:k + m]}) for k in range(40 - m + 1)]
        assert [(k, set(o)) for k, o in t.search(text)] == [(k, o) for k, o in want if o]


def test_rule_and_stage(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(13))
    fill = " ".join(f"f{i}" for i in range(400))
    rows = [item, item + " " + fill, fill, None, "", "q1 q2", item.upper() + " " + " ".join(["x"] * 247),
            item + " " + " ".join(["x"] * 248)]
    docs = make_docs(rows).withColumn("benchmark_hits", F.lit(0))
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7]


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.clean_documents(make_docs(["a b", None]), none).count() == 2
    assert D.clean_documents(make_docs([]), none).count() == 0


def test_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = con.execute(ORACLES["op8_decontaminate"])
    cols = [d[0] for d in res.description]
    df = QUERIES["op8_decontaminate"](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = df.select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())
    assert sum(r.contaminated for r in got) > 0
