import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwire.llm import prefix_trie as T
from tripwire.llm.queries import QUERIES

from .conftest import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        return t[:3] + (hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()[:16],)

    conv = {c: [t[2:] for t in sorted(v, key=order)] for c, v in conv.items()}
    return {c: conv.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + conv[c][zlib.crc32(str(c).encode()) % 9:] for c in conv}


def brute(convs):
    """Every node as a tuple of turns, straight from the definition."""
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in members.items():
        end = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    d = pd.read_parquet(f"{SF}/conversations.parquet")
    want = brute(brute_rebuilt(d[["conv_id", "turn", "role", "text"]].itertuples(index=False)))
    assert rows_of(QUERIES["op13_prefix_trie"](spark, SF)) == want


SCHEMA = "conv_id long, turn long, role string, text string"


def test_edges(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "é", "", None])) for c in range(60) for t in range(rnd.randint(1, 12))]
    rows += [(7, None, "user", "no turn"), (7, None, "user", "nor this"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 1, "user", "x"),
             (8001, 0, "user", "base is absent"), (8002, 0, "user", "x" * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "j", "b", "p1", "node", "nb", "td", "_seg", "h"):
        frame = frame.withColumn(name, F.lit("own"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(T.op13_prefix_trie(spark, str(tmp_path))) == brute(brute_rebuilt(rows))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert T.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def frames(spark, convs):
    turns = [(c, p + 1, hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].encode())) for c, v in convs.items() for p, t in enumerate(v)]
    return (spark.createDataFrame(turns, "conv_id long, pos long, td binary, nb long"),
            spark.createDataFrame([(c,) for c in convs], "conv_id long"))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_any_block_length_gives_the_same_trie(spark, block):
    """Copies, prefixes of others, siblings that part inside a block and at its border, a long and a turnless one."""
    rnd = random.Random(block)
    base = [("u", f"t{i}") for i in range(40)]
    convs = {c: base[:rnd.randint(0, 14)] + [("a", str(rnd.randint(0, 2))) for _ in range(rnd.randint(0, 4))] for c in range(80)}
    convs |= {100 + c: base[:9] for c in range(40)} | {300: base * 3, 301: base * 3 + [("u", "more")], 302: []}
    assert rows_of(T.prefix_trie(*frames(spark, convs), block=block)) == brute(convs)


def test_ids_of_a_hot_end_run_through_one_hash(spark, monkeypatch):
    """More members than a piece holds, over several ranges."""
    monkeypatch.setattr(T, "PIECE", 7)
    convs = {c: [("u", "same")] for c in range(500, 3, -3)}
    assert rows_of(T.prefix_trie(*frames(spark, convs))) == brute(convs)


def test_inner_boundaries_are_digested_only_where_siblings_part(spark):
    shared = [("u", f"t{i}") for i in range(8)]
    convs = {1: shared, 2: shared[:5] + [("u", "x")] + shared[6:], 3: shared[:5] + [("u", "y")]}
    blocks = T.block_rows(frames(spark, convs)[0], 4)
    fine = T.refined(blocks, 4).select("j", "node.depth", "node.q").collect()
    assert {bool(r.q) for r in fine if r.j == 0} == {False}
    assert all(bool(r.q) == (r.depth < 8) for r in fine if r.j == 1)
