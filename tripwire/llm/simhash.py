"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance, exactly.

Candidates. A fingerprint is cut into four 16-bit parts; two fingerprints at distance 2 or less agree
on at least two of them, so they meet under one of the six pairs of parts (a 32-bit key). Equal
fingerprints are merged first, with the smallest id kept. Keys with more than `bucket` distinct
fingerprints are cut again the same way: the 32 bits that the key leaves open are cut into four
parts of 8 bits, then the 16 open ones into four parts of 4 bits. After the third cut only 8 bits are
open, so a bucket holds at most 256 fingerprints whatever the data; nothing is capped, and no bucket
grows with the table.

Comparison. A bucket is stored as bit planes (bit b of 64 members in one machine word). Distances of
many members to many queries are counted at once with carry-save bitwise counters (ones, twos, and a
sticky "over" plane), and a block of 64 members is abandoned as soon as all of it is over the radius.

Links leave a bucket as a star onto the smallest member of each local component, at most one edge per
member, never as all pairs. Components grow by label propagation with pointer jumping; each round is
written to the shared checkpoint folder.

Null and empty texts have fingerprint zero and are linked like any other; ids may repeat or be null
(null is never the smallest id of a component that has another one). `near_duplicates` leaves extra
columns out, `one_per_group` returns them as they are, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tripwire.llm.common import lower_words, materialized, table

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET = 2048


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit b is set when over half of the shingles' 64-bit hashes have it set; no words: zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size).tolist()
    hashes = [h64(joined[a:z], SEED) for a, z in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    # at least half a million bits at a time: a very long text never needs 64 bytes a shingle at once
    count = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).astype(">u8")
    for i in range(0, len(values), 8192):
        part = values[i:i + 8192]
        count += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(values)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """docs plus the fingerprint as a signed 64-bit column; one Arrow pass, no shuffle."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(lower_words(t), shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


# ---------------------------------------------------------------- bit-sliced comparison in a bucket


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words; bit m of word w of plane b is bit b of member 64 w + m."""
    n = len(prints)
    bits = np.zeros((64, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = (prints[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS, stride: int = 8):
    """(query index, member index) arrays of all pairs at `radius` (0 to 3) or fewer differing bits."""
    query, word = (x.ravel() for x in np.indices((len(queries), planes.shape[1])))
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    valid = np.full(planes.shape[1], np.uint64(2**64 - 1))
    if n % 64:
        valid[-1] = np.uint64(2 ** (n % 64) - 1)
    over |= ~valid[word]
    for first in range(0, 64, stride):
        for b in range(first, first + stride):
            flip = np.uint64(0) - ((queries[query] >> np.uint64(b)) & np.uint64(1))
            x = planes[b][word] ^ flip
            carry = ones & x
            ones ^= x
            over |= twos & carry  # four or more
            twos ^= carry
        beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else np.uint64(0))
        live = beyond != np.uint64(2**64 - 1)  # the other blocks are abandoned
        query, word, ones, twos, over, beyond = (v[live] for v in (query, word, ones, twos, over, beyond))
        if not len(query):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(hits)
    return query[row], word[row] * 64 + bit


def local_stars(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component in this bucket) for members that have a link."""
    prints = np.unique(prints)
    n = len(prints)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes = planes_of(prints)
    per_round = max(1, 262_144 // planes.shape[1])
    for at in range(0, n, per_round):
        q, m = within_radius(prints[at:at + per_round], planes, n, radius)
        q = q + at
        for i, j in zip(q[q < m].tolist(), m[q < m].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    top = np.array([root(i) for i in range(n)], np.int64)
    linked = top != np.arange(n)
    return prints[linked], prints[top[linked]]


# ---------------------------------------------------------------- candidates and components in Spark


def _cut(open_bits: list[int]) -> list[list[int]]:
    """The six pairs of four equal parts of the open bit positions: the bits that a pair fixes."""
    size = len(open_bits) // 4
    parts = [open_bits[i * size:(i + 1) * size] for i in range(4)]
    return [a + b for a, b in combinations(parts, 2)]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _keyed(prints: DataFrame, fixed: "list[tuple[str, list[int]]]") -> DataFrame:
    """One row per fingerprint and mask: (fp, cut: name of the mask, key: the fixed bits)."""
    cuts = F.array(*[F.struct(F.lit(name).alias("cut"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"))
                     for name, bits in fixed])
    return prints.select("fp", F.explode(cuts).alias("c")).select("fp", "c.cut", "c.key")


def _stars(keyed: DataFrame, radius: int) -> DataFrame:
    """Star edges (a: member, b: smallest) of every bucket; buckets are bounded by the caller."""
    rows = (keyed.groupBy("cut", "key").agg(F.collect_list("fp").alias("fps"))
            .filter(F.size("fps") > 1).select("fps"))

    def compare(batches):
        for pdf in batches:
            found = [local_stars(np.asarray(f, np.int64).view(np.uint64), radius) for f in pdf["fps"]]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pd.DataFrame({"a": a, "b": b})

    return rows.mapInPandas(compare, "a long, b long")


def star_edges(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links among distinct fingerprints (column fp), as star edges of bounded buckets.

    Three levels of cuts; each level compares the buckets that are small enough and hands the
    fingerprints of larger ones to the next. The last level is bounded by 2**8 by construction.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two of four parts agree for certain only at a distance of 2 or less")
    level = [("", list(range(64)), [])]  # (name, open bits, fixed bits) of every mask in use
    todo, edges = prints.select("fp"), None
    keyed = None
    for depth in range(3):
        nxt = [(f"{name}{i}", [b for b in free if b not in pick], fixed + pick)
               for name, free, fixed in level for i, pick in enumerate(_cut(free))]
        if depth == 0:
            keyed = _keyed(todo, [(name, fixed) for name, _, fixed in nxt])
        else:  # a hot bucket's members get the six finer masks of that bucket's own mask
            finer = F.create_map(*[x for name, _, _ in level for x in (
                F.lit(name), F.array(*[F.struct(F.lit(n2).alias("cut"), F.lit(_mask(f2)).cast("long").alias("mask"))
                                       for n2, _, f2 in nxt if n2[:-1] == name]))])
            keyed = (todo.select("fp", F.explode(F.element_at(finer, F.col("cut"))).alias("c"))
                     .select("fp", F.col("c.cut").alias("cut"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("key")))
        level = nxt
        sizes = keyed.groupBy("cut", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = materialized(sizes)
        if depth == 2:
            fit = keyed.join(sizes.select("cut", "key"), ["cut", "key"], "left_semi")
        else:
            fit = keyed.join(sizes.filter(F.col("n") <= bucket).select("cut", "key"), ["cut", "key"], "left_semi")
        found = _stars(fit, radius)
        edges = found if edges is None else edges.unionByName(found)
        hot = sizes.filter(F.col("n") > bucket).select("cut", "key")
        if depth == 2 or not hot.take(1):
            break
        todo = keyed.join(hot, ["cut", "key"], "left_semi").select("fp", "cut")
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest vertex of its component.

    Every round takes the smallest label among a vertex and its neighbours, hooks the old label's
    vertex onto it too, and jumps one pointer; it ends when a round changes nothing.
    """
    both = materialized(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = materialized(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                         .select("v", F.least("v", "m").alias("root")))
    while True:
        near = both.join(label, both.b == label.v).select(F.col("a").alias("v"), "root")
        best = label.select("v", "root").union(near).groupBy("v").agg(F.min("root").alias("best"))
        own = label.join(best, "v")
        hooked = (own.select(F.col("root").alias("v"), F.col("best").alias("root"))
                  .union(own.select("v", F.col("best").alias("root")))
                  .groupBy("v").agg(F.min("root").alias("root")))
        up = hooked.select(F.col("v").alias("root"), F.col("root").alias("top"))
        new = materialized(hooked.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root")))
        moved = new.join(label.withColumnRenamed("root", "was"), "v").filter(F.col("root") != F.col("was"))
        label, done = new, not moved.take(1)
        if done:
            return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint_: signed 64 bits, text_hash_, group_, component_: smallest id of the group), a row per row of docs.

    Only ids and fingerprints are shuffled. The fingerprints of all rows are computed once and written
    to the shared folder; copies of one fingerprint are merged before any candidate is made.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text_"))
    marked = materialized(with_fingerprint(own, "text_", "fingerprint_", shingle)
                          .withColumn("text_hash_", F.xxhash64("text_")).drop("text_"))
    groups = materialized(marked.groupBy(F.col("fingerprint_").alias("fp"))
                          .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    edges = materialized(star_edges(groups, radius, bucket))
    roots = components(edges)
    linked = groups.join(roots, groups.fp == roots.v).groupBy("root").agg(F.min("first").alias("comp"))
    linked = roots.join(linked, "root").select(F.col("v").alias("fp"), "root", "comp")
    names = groups.join(linked, "fp", "left").select(
        F.col("fp").alias("fingerprint_"), F.coalesce("root", "fp").alias("group_"),
        F.coalesce("comp", "first").alias("component_"), "n")
    # A fingerprint that over a thousandth of all rows share is a hot join key. There are fewer than a
    # thousand of them whatever the table, so their names are broadcast; all others meet by shuffle.
    hot = F.col("n") * 1000 > F.lit(groups.agg(F.sum("n")).first()[0] or 0)
    often = F.broadcast(groups.filter(hot).select(F.col("fp").alias("fingerprint_")))
    return (marked.join(F.broadcast(names.filter(hot).drop("n")), "fingerprint_")
            .unionByName(marked.join(often, "fingerprint_", "left_anti").join(names.filter(~hot).drop("n"), "fingerprint_")))


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every linked group, columns unchanged: the one with the smallest (id, text hash), null ids last.

    Ids may be shared by rows of different groups: a group's row is named by its id and text hash together, and rows that
    agree in both have one text and so one group. Of those the row with the smallest hash over all columns stays, so
    reruns agree. The search shuffles ids and fingerprints only; the texts come from a second read of `docs`, which one
    shuffle by id and hash serves for both the join and the choice among copies. Copies of one id and text that are over
    a thousandth of all rows are found by broadcast (fewer than a thousand of them) and reduced before they are shuffled.
    """
    groups = near_duplicates(docs, shingle=shingle, radius=radius)
    copies = groups.groupBy("group_", "doc_id", "text_hash_").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash_", "n")).alias("row")
    keep = materialized(copies.groupBy("group_").agg(first).select(
        F.col("row.doc_id").alias("keep_id"), F.col("row.text_hash_").alias("keep_hash"), F.col("row.n").alias("n")))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), whole.alias("row"))
    hot = F.col("n") * 1000 > groups.count()

    def chosen(names: DataFrame) -> DataFrame:
        same = rows["id"].eqNullSafe(F.col("keep_id")) & (rows["hash"] == F.col("keep_hash"))
        return rows.join(names, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))

    both = chosen(keep.filter(~hot)).unionByName(chosen(F.broadcast(keep.filter(hot))))
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_"), 16, "0")).alias("fingerprint"),
                        F.col("component_").alias("component_id"))
