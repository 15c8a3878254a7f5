import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tripwire.llm import mixing as M
from tripwire.llm.queries import QUERIES

from .conftest import SF


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source sizes in source order. Share, cap, and reshare the excess until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed, total = {}, sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(fixed.values())
        share = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        above = [i for i in free if share[i] > most * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: float(most * sizes[i]) for i in above}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 5, 0, 7], [0, 0, 50], [0], [3, 900, 2, 40, 40, 900, 1]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = [(n or "null", n, s) for n, s in zip(names, sizes)]
    got = M.targets(spark.createDataFrame(rows[::-1], "key string, source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.key: r.target for r in got} == pytest.approx({r[0]: t for r, t in zip(rows, want)})


def sums_of(counts):
    return {sum(s * k for s, k in zip(counts, ks)) for ks in itertools.product(*[range(n + 1) for n in counts.values()])}


def test_knapsack_is_exact():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(0, 4))}
        goal = rnd.randint(0, 60)
        take = M.knapsack(goal, counts)
        assert abs(sum(s * n for s, n in take.items()) - goal) == min(abs(x - goal) for x in sums_of(counts))
        assert all(n <= counts[s] for s, n in take.items())


def test_small_source_comes_as_near_as_possible():
    rnd = random.Random(6)
    for _ in range(200):
        counts = {rnd.choice([1, 2, 3, 7, 20, 90, 400]): rnd.randint(1, 4) for _ in range(rnd.randint(1, 4))}
        total = sum(s * n for s, n in counts.items())
        budget = rnd.randint(0, 3 * total)
        copies, take = M.fit(counts, budget)
        rest = budget - copies * total
        assert abs(sum(s * n for s, n in take.items()) - rest) == min(abs(x - rest) for x in sums_of(counts))


@pytest.mark.parametrize("dp_words", [0, 5, 1 << 16])
def test_fit_is_near(dp_words):
    rnd = random.Random(3)
    for _ in range(100):
        counts = {rnd.randint(0, 40): rnd.randint(1, 200) for _ in range(rnd.randint(1, 12))}
        total = sum(s * n for s, n in counts.items())
        budget = rnd.randint(0, 3 * total)
        copies, take = M.fit(counts, budget, 3, dp_words)
        used = copies * total + sum(s * n for s, n in take.items())
        assert abs(budget - used) <= max(counts)
        assert copies + (1 if any(take.values()) else 0) <= 3
        assert all(0 <= n <= counts[s] for s, n in take.items())


def check(rows, docs):
    """rows of the mix against sizes, targets and budgets counted here."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    by = {}
    for i, _, s in docs:
        by.setdefault(s, []).append(i)
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = [sum(size[i] for i in by[s]) for s in order]
    want = dict(zip(order, brute_targets(sizes)))
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for s, total in zip(order, sizes):
        taken = 0
        for i in by[s]:
            r = got[i]
            assert (r["size"], r["source_size"]) == (size[i], total) and r["target"] == pytest.approx(want[s])
            assert r["taken"] % max(1, size[i]) == 0 and r["taken"] <= 3 * size[i]
            taken += r["taken"]
        assert abs(taken - want[s]) <= max(1, min((size[i] for i in by[s] if size[i]), default=1))


def test_whole_table(spark, texts_sf):
    rows = [r.asDict() for r in QUERIES["op6_mixing"](spark, SF).collect()]
    check(rows, list(zip(texts_sf.doc_id, texts_sf.text, texts_sf.source)))
    again = [r.asDict() for r in QUERIES["op6_mixing"](spark.newSession(), SF).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_edges(make_docs):
    rnd = random.Random(4)
    docs = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 3, 3, 8, 50])), rnd.choice(["a", "a", "a", "b", "é", None])) for i in range(400)]
    docs += [(1000, None, "b"), (1001, "x " * 300, "a"), (1002, "one", "tiny")]
    frame = make_docs(docs).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash")).withColumn("key_", F.lit(1))
    out = M.mixed(frame)
    assert out.columns == frame.columns + ["size_", "source_size", "target_", "taken"]
    check([{"doc_id": r.doc_id, "size": r.size_, "source_size": r.source_size, "target": r.target_, "taken": r.taken}
           for r in out.collect()], docs)


def test_repeated_and_null_ids(make_docs):
    docs = [(7, "a b c", "s")] * 5 + [(None, "a b c", "s")] * 4 + [(8, "a b", "t")] * 3
    rows = M.mixed(make_docs(docs)).collect()
    assert len(rows) == 12
    for s in "st":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3


def test_hot_length_is_cut_by_hash(make_docs):
    docs = [(i, "a b c d", "s") for i in range(3000)] + [(5000 + i, "q " * 900, "t") for i in range(3)]
    rows = M.mixed(make_docs(docs), buckets=8).collect()
    own = [r for r in rows if r.source == "s"]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert M.mixed(make_docs(docs), buckets=1).filter("source = 's'").agg(F.sum("taken")).first()[0] == sum(r.taken for r in own)


def test_columns_named_like_internal_ones(make_docs):
    docs = make_docs([(i, "a b c" if i % 3 else "d e", "s" if i % 2 else "t") for i in range(60)])
    names = ["mix_key", "mix_size", "mix_hash", "mix_cut", "mix_need", "mix_row", "mix_order", "mix_extra", "mix_copies", "mix_target",
             "mix_source_size", "mix_bucket", "key", "n", "w", "limit", "level", "fixed", "c0", "upto", "inside", "cut", "size", "taken"]
    plain = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in M.mixed(docs).collect()}
    for c in names:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = M.mixed(docs)
    assert out.columns == [*docs.columns, "size_", "source_size", "target", "taken_"]
    for r in out.collect():
        assert (r.size_, r.source_size, r.target, r.taken_) == plain[r.doc_id] and all(r[c] == f"own {c}" for c in names)


@pytest.mark.parametrize("dp_words", [0, 3, 40, 1 << 16])
def test_one_rule_at_every_size(dp_words):
    """Whatever part of the budget the programme sees, taking shares back never ends further from the target."""
    rnd = random.Random(dp_words)
    for _ in range(200):
        counts = {rnd.randint(1, 60): rnd.randint(1, 30) for _ in range(rnd.randint(1, 6))}
        total = sum(s * n for s, n in counts.items())
        budget = rnd.randint(0, total - 1)
        _, take = M.fit(counts, budget, 3, dp_words)
        used = sum(s * n for s, n in take.items())
        if dp_words >= total:
            reach = 1
            for s, n in counts.items():
                for _ in range(n):
                    reach |= reach << s
            assert abs(used - budget) == min(abs(i - budget) for i in range(total + 1) if reach >> i & 1)


def test_empty_tables(make_docs):
    assert M.mixed(make_docs([])).count() == 0
    assert [r.taken for r in M.mixed(make_docs([None, ""])).collect()] == [0, 0]
