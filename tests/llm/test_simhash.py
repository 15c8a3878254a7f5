import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tripwire.llm import simhash as S
from tripwire.llm.queries import QUERIES

from .conftest import SF


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=2):
    n = len(prints)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_whole_table_equals_brute_force(spark, texts_sf):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, SF).collect()}
    ids = texts_sf.sort_values("doc_id").doc_id.tolist()
    prints = [brute_print(t) for t in texts_sf.sort_values("doc_id").text]
    comp = brute_components(prints)
    assert rows == {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, comp)}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(30)]
    a = np.array(fps, np.uint64)
    q, m = S.within_radius(a, S.planes_of(a), len(a), radius)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), m.tolist())) == want


def prints_frame(spark, prints):
    return spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints], "fp long")


@pytest.mark.parametrize("bucket", [2, 8, 2048])
def test_hot_buckets_lose_no_link(spark, bucket):
    """A tight cloud of fingerprints overflows small buckets and goes through the finer cuts."""
    rnd = random.Random(7)
    seeds = [rnd.getrandbits(64) for _ in range(3)]
    prints = sorted({s ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for s in seeds for _ in range(60)}
                    | {rnd.getrandbits(64) for _ in range(30)})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    comp = brute_components(prints)
    want = {}
    for p, c in zip(signed, comp):
        want.setdefault(c, set()).add(p)
    roots = {r.v: r.root for r in S.components(S.star_edges(prints_frame(spark, prints), 2, bucket)).collect()}
    got = {}
    for p in signed:
        got.setdefault(roots.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_radius_beyond_the_cuts_is_refused(spark):
    with pytest.raises(ValueError):
        S.star_edges(prints_frame(spark, [1]), radius=3)


def test_long_chain_of_links(spark):
    chain = [0]
    for i in range(0, 60, 2):
        chain.append(chain[-1] | 3 << i)
    roots = S.components(S.star_edges(prints_frame(spark, chain))).select("root").distinct().collect()
    assert [r.root for r in roots] == [0]


def test_edges(make_docs):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(5, None), (4, ""), (3, " \n"), (9, words), (7, words), (7, words), (None, words.upper()),
            (None, "only here"), (None, "only here"), (11, "two words"), (12, "x " * 60_000)]
    docs = make_docs(rows).withColumn("component_", F.lit("c")).withColumn("fp", F.lit(1))
    got = S.near_duplicates(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint_, r.component_))
    assert by[5] == by[4] == by[3] == {(0, 3)}
    assert {c for _, c in by[9] | by[7]} == {7}
    assert {c for _, c in by[None]} == {7, None}
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted(
        [(3, " \n"), (7, words), (-1, "only here"), (11, "two words"), (12, "x " * 60_000)])


def test_one_row_of_every_group_also_where_groups_share_an_id(spark, make_docs):
    a, b = ("alpha beta gamma " * 9).strip(), " ".join(f"other{i}" for i in range(40))
    docs = make_docs([(1, a), (1, b), (2, a), (3, b)])
    assert sorted((r.doc_id, r.text) for r in S.one_per_group(docs).collect()) == [(1, a), (1, b)]
    docs = make_docs([(5, a), (2, b), (2, a), (5, b), (None, "alone"), (5, "alone too")])
    assert sorted((r.doc_id or 0, r.text) for r in S.one_per_group(docs).collect()) == sorted(
        [(2, a), (2, b), (0, "alone"), (5, "alone too")])


def test_copies_of_one_row_and_reruns(spark, make_docs):
    """Rows of one id and text that differ elsewhere: one stays, the same one in every run and partitioning."""
    docs = make_docs([(1, "the same text here")] * 50 + [(i, f"own words of {i} alone {i * 7}") for i in range(2, 40)])
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    once = spark.createDataFrame(docs.collect(), docs.schema)
    kept = [sorted(map(tuple, S.one_per_group(once.repartition(n)).collect())) for n in (1, 5)]
    assert kept[0] == kept[1] and len({r[0] for r in kept[0]}) == len(kept[0])


NAMES = ["row", "id", "hash", "keep_id", "keep_hash", "n", "fp", "fingerprint_", "text_hash_", "text_", "group_", "component_",
         "key_of_row", "row_of_id", "root", "v", "c0", "c1"]


def test_columns_named_like_internal_ones(make_docs):
    docs = make_docs([(1, "one two three four"), (2, "one two three four"), (3, "five six seven")])
    for c in NAMES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [1, 3]
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in NAMES)


def test_empty_table(make_docs):
    assert S.near_duplicates(make_docs([]).select("doc_id", "text")).count() == 0
    assert S.one_per_group(make_docs([])).count() == 0
