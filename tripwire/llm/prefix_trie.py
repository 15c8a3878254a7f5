"""Conversation prefix trie by fixed-length block hashing.

Conversations that begin with the same turns share a path of a trie; a node is a distinct sequence of first turns.

Blocks. A conversation's turns are cut into blocks of BLOCK turns (the last one may be shorter). A turn's digest is the
first 16 bytes of a SHA-256 over role and text; a block's digest is taken over its turns' digests; the path before a
block is the exclusive or of 128-bit hashes of (block number, block digest) of the blocks before it, which is a running
aggregate and can be cut into ranges, so a conversation with a third of all turns is not one task's work. Members are
counted per distinct (path, block), never per turn.

Refinement. Where all conversations that share a path continue with one and the same block, its inner turn boundaries
hold exactly the members of the block, so they are named by the path alone. Only where several blocks follow one path
are their inner boundaries digested turn by turn, once per distinct block, and merged where they are equal.

Subtrees. Every node belongs to its smallest member, and the nodes of one owner are the lower end of its path. So a sum
over a subtree is a sum over its members of what each of them owns in total (again one aggregate over blocks, refined
to turns), less what the node's own owner owns above it (a running sum). Nothing walks the trie and no pairs arise:
all work is linear in the number of blocks and nodes.

Input is turns (conv_id, turn, role, text), in any order. Null roles and texts are empty; null turns come first; turns
of one number are ordered by role and text digest; rows without a conv_id belong to no conversation and are left out.
Extra columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwire.llm.common import crc_of_id, join_unique, table, written
from tripwire.operators.segments import cut, inside, numbered, running_sum, with_carry

BLOCK = 4
#: Turns that a conversation can take over from the first of its five.
HEAD = 8
#: Members whose ids are joined to one piece of text at a time.
PIECE = 4096


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, td, nb): place from 1, 16-byte digest of role and text, UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16).alias("td"),
        F.octet_length(text).cast("long").alias("nb"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("td")]
    return numbered(turns, ["conv_id"], order, "pos").select("conv_id", "pos", "td", "nb")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations, all conversation ids): the first h turns of the first conversation of each
    five, then the own turns after the first h; h is the crc32 of the decimal id, modulo 9."""
    convs = turns.groupBy("conv_id").agg(F.least(F.count(F.lit(1)), F.lit(HEAD)).alias("own"))
    heads = (turns.filter((F.col("pos") <= HEAD) & (F.col("conv_id") % 5 == 0)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "td", "nb"))).alias("head")))  # at most HEAD turns
    h = (crc_of_id(F.col("conv_id")) % 9).cast("int")
    plan = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    plan = plan.join(heads, "base", "left").select(
        "conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<pos:bigint,td:binary,nb:bigint>>")).alias("head"))
    plan = written(plan, "trie-plan")
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.td", "t.nb")
    shift = plan.select(F.col("conv_id").alias("c"), "h", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.join(shift, turns["conv_id"] == shift["c"]).filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "td", "nb")
    return taken.unionByName(own), plan.select("conv_id")


def _lane(k: int, *cols) -> Column:
    return F.xxhash64(F.lit(k), *[F.col(c) if isinstance(c, str) else c for c in cols])


def block_rows(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, j, p1, p2, b, size, turns): every block with the path before it."""
    j = F.floor((F.col("pos") - 1) / block).cast("long")
    blocks = (turns.groupBy("conv_id", j.alias("j"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "td", "nb"))).alias("turns"))  # at most `block` turns
              .withColumn("size", F.size("turns"))
              .withColumn("b", _digest(F.col("turns"), F.col("size"))))
    rows = cut(blocks, ["conv_id"], ["j"]).withColumn("x1", _lane(1, "j", "b")).withColumn("x2", _lane(2, "j", "b"))
    before = inside(["conv_id"], "j").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("l1", F.bit_xor("x1").over(before)).withColumn("l2", F.bit_xor("x2").over(before))
    rows = with_carry(rows, ["conv_id"], {"s1": F.bit_xor("x1"), "s2": F.bit_xor("x2")},
                      {"e1": F.bit_xor("s1"), "e2": F.bit_xor("s2")})
    zero = F.lit(0).cast("long")
    path = [F.coalesce(f"l{k}", zero).bitwiseXOR(F.coalesce(f"e{k}", zero)).alias(f"p{k}") for k in (1, 2)]
    return written(rows.select("conv_id", "j", *path, "b", "size", "turns"), "trie-blocks")


def _digest(turns: Column, n: "Column | int") -> Column:
    """16-byte digest of the first n turns' digests."""
    joined = F.aggregate(F.slice(turns, 1, n), F.lit("").cast("binary"), lambda a, t: F.concat(a, t["td"]))
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def refined(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct blocks exploded to their turn boundaries: (j, p1, p2, b, n, first, node, parent, nb, end).

    `node` and `parent` are (depth, p1, p2, q); q is empty where the path alone names the node. `end`: the last
    boundary of the block.
    """
    path, name = ["j", "p1", "p2"], ["j", "p1", "p2", "b"]
    groups = blocks.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"),
                                       F.first("size").alias("size"), F.first("turns").alias("turns"))  # equal in a group
    groups = written(groups, "trie-groups")
    # the one block of a path that does not branch; both sides of the join are unique, so no path is a hot key
    alone = (groups.groupBy(*path).agg(F.count(F.lit(1)).alias("k"), F.min("b").alias("b")).filter("k = 1")
             .select(*name, F.lit(True).alias("alone")))
    marked = groups.join(alone, name, "left")
    empty = F.lit("").cast("binary")

    def node(i: Column) -> Column:
        """Boundary after i turns of the block: 0 is the path itself, a whole block is the path after it."""
        full = (i == block)
        here = [F.when(full, F.col(f"p{k}").bitwiseXOR(_lane(k, "j", "b"))).otherwise(F.col(f"p{k}")) for k in (1, 2)]
        inner = F.when(full | (i == 0) | F.col("alone"), empty).otherwise(_digest(F.col("turns"), i))
        return F.struct((F.col("j") * block + i).alias("depth"), here[0].alias("p1"), here[1].alias("p2"), inner.alias("q"))

    rows = marked.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size"))))
    return rows.select(*name, "n", "first", node(F.col("i")).alias("node"), node(F.col("i") - 1).alias("parent"),
                       F.element_at("turns", F.col("i"))["nb"].alias("nb"), (F.col("i") == F.col("size")).alias("end"))


def _as_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.hex(k), F.lit("")) for k in keys])


def ends(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Per key the SHA-256 of its members' ids, ascending and comma-joined: (ends_key: the key as text, ends_sha256).

    Ids are joined to pieces inside ranges of (keys, id); the pieces of a key then run through one hash in order, a
    piece at a time, so neither a hot key's ids nor their text is ever held whole.
    """

    def pieces(batches):
        held, first, ids = None, None, []
        for batch in batches:
            for k, m in zip(batch.column("k").to_pylist(), batch.column("m").to_pylist()):
                if k != held or len(ids) == PIECE:
                    if ids:
                        yield one(held, first, ids)
                    held, first, ids = k, m, []
                ids.append(str(m))
        if ids:
            yield one(held, first, ids)

    def one(k, first, ids):
        return k, first, ",".join(ids)

    def batched(found, names, size=1024):
        rows = []
        for r in found:
            rows.append(r)
            if len(rows) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    def hashed(batches):
        held, state = None, None
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("piece").to_pylist()):
                if k != held:
                    if held is not None:
                        yield held, state.hexdigest()
                    held, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if held is not None:
            yield held, state.hexdigest()

    cut_up = (rows.select(_as_text(keys).alias("k"), F.col(member).alias("m")).repartitionByRange("k", "m").sortWithinPartitions("k", "m")
              .mapInArrow(lambda b: batched(pieces(b), ["k", "first", "piece"], 64), "k string, first long, piece string"))
    sums = (cut_up.repartition("k").sortWithinPartitions("k", "first")
            .mapInArrow(lambda b: batched(hashed(b), ["k", "ends_sha256"]), "k string, ends_sha256 string"))
    return sums.withColumnRenamed("k", "ends_key")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of `turns` (conv_id, pos, td, nb); `conversations` (conv_id) also names turnless ones.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    blocks = block_rows(turns, block)
    fine = written(refined(blocks, block), "trie-fine")
    nodes = written(fine.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"),
                                             F.first("nb").alias("nb"), F.first("parent").alias("parent")), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("nb"))
    nodes = written(running_sum(nodes, ["conv_id"], [F.col("node.depth")], F.col("own"), "above"), "trie-owned")

    # what every owner owns in total, summed over the members of each block and then of each boundary
    owned = nodes.groupBy("conv_id").agg(F.sum("own").alias("t"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    name = ["j", "p1", "p2", "b"]
    weights = (blocks.select("conv_id", *name).join(owned, "conv_id").groupBy(*name)
               .agg(F.sum("t").alias("t"), F.sum("leaves").alias("leaves")))
    sums = fine.select(*name, "node").join(weights, name).groupBy("node").agg(F.sum("t").alias("t"), F.sum("leaves").alias("leaves"))

    # members whose last turn ends a block: all of them end at the same boundary; turnless ones end at the root
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct(*name), "j").alias("e")).select("conv_id", "e.*")
    turnless = conversations.join(last, "conv_id", "left_anti").select(
        "conv_id", F.lit(-1).cast("long").alias("j"), *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2")], F.lit("").cast("binary").alias("b"))
    at = ends(last.unionByName(turnless), name, "conv_id")
    ending = fine.filter("end").select("node", _as_text(name).alias("ends_key")).join(at, "ends_key").select("node", "ends_sha256")
    none = hashlib.sha256(b"").hexdigest()

    # the owner of a node's parent; a parent is met by as many rows as it has children
    all_nodes = nodes.agg(F.count(F.lit(1))).first()[0]
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit("").cast("binary").alias("q"))
    first = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    owners = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("met")).unionByName(
        first.select(root.alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.lit(all_nodes + 1).cast("long").alias("met")))
    full = join_unique(nodes.join(sums, "node").join(ending, "node", "left"), owners, ["parent"], "met", all_nodes)
    out = full.select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("t") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

    # the root: one row
    whole = nodes.agg(F.sum("own").alias("t"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"),
                      F.sum((F.col("node.depth") == 1).cast("long")).alias("n_children"))
    at_root = at.filter(F.col("ends_key").startswith("FFFFFFFFFFFFFFFF|")).agg(F.max("ends_sha256").alias("ends_sha256"))
    top = first.filter(F.col("n_convs") > 0).crossJoin(whole).crossJoin(at_root).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("t", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    return out.unionByName(top)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(written(turn_digests(table(spark, sf_dir, "conversations")), "trie-turns"))
    return prefix_trie(turns, conversations)
