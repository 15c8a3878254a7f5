"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (an item with fewer words, but not
none, is one pattern). Patterns of one length share a search table, as in Wu and Manber's method with
words as symbols: the block of the last three words of the current window is looked up in a shift
table that says how far the window can move without passing an occurrence; only where the shift is
zero the block's suffix bucket is opened, patterns whose first word fits are selected, and a direct
comparison of all words confirms. Most blocks of clean text are unknown and move the window eleven
words at once.

The benchmark reaches the tasks in blocks of at most about `block_words` words, whose number follows
from its measured size, so a broadcast never grows with the data; with several blocks the documents
are searched once per block and the found stretches are united per document row.

Null and empty texts have no words: such documents are clean, such items have no pattern. Repeated
benchmark rows count once; an item without id marks words but is not listed. Repeated documents stay
repeated, extra columns pass through `clean_documents`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tripwire.llm.common import free_name, lower_terms, table

WINDOW = 13
BLOCK = 3
BLOCK_WORDS = 400_000
FOUND = "n_words long, spans array<struct<a:long,z:long>>, items array<string>"


class WuManber:
    """Search table for word patterns of one length."""

    def __init__(self, length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set]] = {}

    def add(self, pattern: tuple, owner) -> None:
        for end in range(self.block, self.length + 1):
            key = pattern[end - self.block:end]
            self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
        self.buckets.setdefault(pattern[-self.block:], {}).setdefault(pattern, set()).add(owner)

    def search(self, words: tuple):
        """(start, owners) of every occurrence, left to right."""
        length, block, default, shift = self.length, self.block, self.default, self.shift
        end, n = length, len(words)
        while end <= n:
            key = words[end - block:end]
            move = shift.get(key, default)
            if move:
                end += move
                continue
            first = words[end - length]
            for pattern, owners in self.buckets[key].items():
                if pattern[0] == first and pattern == words[end - length:end]:
                    yield end - length, owners
            end += 1


class Patterns:
    """The patterns of some benchmark items; the tables are built once in each Python worker."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.items, self.window, self.tables = items, window, None

    def search(self, words: tuple) -> tuple[list, list]:
        """Merged [start, end) stretches of hit words, and the ids of the items found."""
        if self.tables is None:
            tables: dict[int, WuManber] = {}
            for item, text in self.items:
                own = tuple(lower_terms(text))
                size = min(self.window, len(own))
                for i in range(len(own) - size + 1 if own else 0):
                    tables.setdefault(size, WuManber(size)).add(own[i:i + size], item)
            self.tables = tables
        found = sorted((at, at + size, owners) for size, t in self.tables.items() for at, owners in t.search(words))
        return merged((a, z) for a, z, _ in found), sorted({str(i) for _, _, o in found for i in o if i is not None})


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, block_words: int):
    """Item lists of bounded size, one after the other; every row falls into exactly one."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / (6 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark.filter(part == k).select("item_id", "text").distinct().collect()
        yield [(r.item_id, r.text) for r in rows]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits",
                   window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs plus a struct column `out`: n_words, spans of hit words, items (ids as sorted strings)."""
    spark = docs.sparkSession

    def searched(rows: DataFrame, items: list[tuple]) -> DataFrame:
        patterns = spark.sparkContext.broadcast(Patterns(items, window))

        @F.pandas_udf(FOUND)
        def search(texts: pd.Series) -> pd.DataFrame:
            found = []
            for t in texts:
                words = tuple(lower_terms(t))
                spans, owners = patterns.value.search(words)
                found.append((len(words), [{"a": a, "z": z} for a, z in spans], owners))
            return pd.DataFrame(found, columns=["n_words", "spans", "items"])

        return rows.withColumn(out, search(F.col(text)))

    blocks = list(_blocks(benchmark, block_words))
    if len(blocks) == 1:
        return searched(docs, blocks[0])

    key, same = free_name(docs, "text_key"), free_name(docs, "same_text")
    keys = docs.select(text).distinct()  # equal texts have equal hits, so they are searched once
    parts = [searched(keys, b).select(F.xxhash64(text).alias(key), F.col(text).alias(same), f"{out}.*") for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    @F.pandas_udf("array<struct<a:long,z:long>>")
    def unite(spans: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "z": z} for a, z in merged((x["a"], x["z"]) for x in s)] for s in spans])

    whole = every.groupBy(key, same).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.select(key, same, F.struct("n_words", unite("spans").alias("spans"), "items").alias(out))
    joined = docs.join(whole, (F.xxhash64(docs[text]) == whole[key]) & docs[text].eqNullSafe(whole[same]), "left")
    return joined.drop(key, same)


def n_hit(hits) -> "F.Column":
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda s, x: s + x.z - x.a)


def contaminated(hits: str = "hits"):
    """The contract's rule: some word is hit, and at least 5% of all words are."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    name = free_name(docs, "benchmark_hits")
    return benchmark_hits(docs, benchmark, out=name).filter(~contaminated(name)).drop(name)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", n_hit("hits").alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: The same result in DuckDB: item windows joined to document windows of the same length as strings.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
