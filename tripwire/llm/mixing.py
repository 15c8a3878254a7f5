"""Mixing sources to target weights: subset-sum budget fitting over exact word counts.

Every source gets a budget of words: all words of the corpus are shared by weight, a target stops at
three times its source's size, and the excess is shared again by weight until none is above (water
filling). A budget of at least one source size takes every document of the source whole one, two or
three times; the remaining budget is fitted with single documents:

1. documents are counted by exact length (source, size); the rest of the work sees counts only;
2. every length gives the same share of its documents, rounded down, then the longest lengths give
   more until about `dp_words` words are open;
3. bounded-knapsack dynamic programming over lengths and their remaining counts finds the reachable
   sum nearest to the open budget (one bit per reachable sum, counts split into powers of two);
4. within a length the documents with the smallest seeded hash are taken. The hash range is cut into
   buckets whose counts are known, so only the bucket that holds the cut is ordered; a length that
   holds a third of all documents is never one sorted group.

Only counts are shuffled; a group of step 3 is one source's distinct lengths. Reruns agree: the order
comes from xxhash64(doc_id, seed). Null and empty texts have size 0 and are never taken (there is
nothing to take); rows without source form one source, last in code point order. Repeated rows count
as separate documents and are ordered among themselves by row. Extra columns pass through `mixed`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwire.llm.common import free_name, materialized, table

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240
BUCKETS = 256
DP_WORDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text, F.lit(WORD))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target) from one row per source (key, source, source_size).

    Weights repeat in code point order of the source, null last. Filling rises by size / weight: the
    first source whose limit is above the level reached there fixes the common level. The unpartitioned
    windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("w", w).withColumn("limit", most * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("key"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("level", level)
    open_ = F.when(F.col("limit") > F.col("level") * F.col("w"), F.struct(F.col("limit") / F.col("w"), "key", "level"))
    t = t.withColumn("fixed", F.min(open_).over(every)["level"])
    return t.select("key", "source_size", F.least("limit", F.coalesce(F.col("fixed") * F.col("w"), F.col("limit"))).alias("target"))


def _reach(open_words: int, limit: int, counts: dict[int, int]) -> tuple[int, list]:
    """Bit set of the sums up to `limit`, and its growth; it ends once `open_words` is reached."""
    mask = (1 << limit + 1) - 1
    reach, steps = 1, []
    for size in sorted(counts):
        left, piece = min(counts[size], limit // size), 1
        while left > 0 and not reach >> open_words & 1:
            piece = min(piece, left)
            steps.append((size, piece, reach))
            reach |= reach << size * piece & mask
            left, piece = left - piece, piece * 2
    return reach, steps


def knapsack(open_words: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that the sum is the reachable one nearest to open_words.

    Of two sums equally near the smaller one is taken. The second pass looks above the budget, as far
    as the gap that the first one left below it.
    """
    reach, steps = _reach(open_words, open_words, counts)
    at = reach.bit_length() - 1
    gap = open_words - at
    if gap > 1:
        above, more = _reach(open_words, open_words + gap - 1, counts)
        over = above >> open_words
        if over:
            at, steps = open_words + (over & -over).bit_length() - 1, more
    take: dict[int, int] = {}
    for size, piece, before in reversed(steps):
        if not before >> at & 1:
            take[size] = take.get(size, 0) + piece
            at -= size * piece
    return take


def _words(take: dict[int, int]) -> int:
    return sum(size * n for size, n in take.items())


def fit(counts: dict[int, int], budget: int, most: int = MOST, dp_words: int = DP_WORDS) -> tuple[int, dict[int, int]]:
    """(whole copies of every document, further documents by length) whose words come to the budget.

    Where equal shares by length and the programme leave a gap, the last `dp_words` words of the shares (all of them, if
    they are fewer) are taken back and fitted by the programme too, and the nearer of both choices stays.
    """
    total = _words(counts)
    if total == 0:
        return 0, {}
    copies, rest = divmod(min(budget, most * total), total)

    def fitted(shared: int) -> dict[int, int]:
        """Equal shares of about `shared` words, the words that are then open by the programme."""
        take = {size: n * shared // total for size, n in counts.items() if size > 0}
        open_words = rest - _words(take)
        for size in sorted(take, reverse=True):
            more = min(counts[size] - take[size], max(0, open_words - dp_words) // size)
            take[size] += more
            open_words -= more * size
        for size, n in knapsack(open_words, {s: counts[s] - n for s, n in take.items() if counts[s] > n}).items():
            take[size] += n
        return take

    take = fitted(rest)
    if _words(take) != rest:
        take = min(take, fitted(max(0, rest - dp_words)), key=lambda t: abs(_words(t) - rest))
    return copies, take


def _plan(classes: DataFrame, wanted: DataFrame, most: int, dp_words: int) -> DataFrame:
    """(key, size, source_size, target, copies, take) for every length of every source."""

    def per_source(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(pdf["size"].tolist(), pdf["n"].tolist()))
        copies, take = fit(counts, int(round(pdf["target"].iloc[0])), most, dp_words)
        sizes = pdf["size"].tolist()
        return pd.DataFrame({
            "key": pdf["key"].tolist(), "size": sizes, "source_size": pdf["source_size"].tolist(),
            "target": pdf["target"].tolist(), "copies": copies, "take": [take.get(s, 0) for s in sizes]})

    return classes.join(wanted, "key").select("key", "size", "n", "source_size", "target").groupBy("key").applyInPandas(
        per_source, "key string, size long, source_size long, target double, copies long, take long")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED, buckets: int = BUCKETS,
          dp_words: int = DP_WORDS, size: Column | None = None) -> DataFrame:
    """docs plus size, source_size, target and taken (names get underscores where docs has them).

    `size` is the document's word count where the caller has it already, else counted from `text`.
    """
    names = [free_name(docs, n) for n in ("size", "source_size", "target", "taken")]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no name of docs can clash
    sized = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("mix_key"), F.col("source"),
        F.coalesce(word_count() if size is None else size, F.lit(0)).cast("long").alias("mix_size"),
        F.xxhash64("doc_id", F.lit(seed)).alias("mix_hash"),
        F.struct(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns]).alias("mix_order"), whole.alias("mix_row"))
    return _taken(sized, docs.columns, names, weights, most, buckets, dp_words)


def _taken(sized: DataFrame, columns: list[str], names: list[str], weights, most, buckets, dp_words) -> DataFrame:
    bucket = F.pmod("mix_hash", F.lit(buckets))
    cells = materialized(sized.groupBy("mix_key", "mix_size", bucket.alias("mix_bucket")).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    classes = cells.groupBy("mix_key", "mix_size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    classes = classes.select(F.col("mix_key").alias("key"), "source", F.col("mix_size").alias("size"), "n")
    sources = classes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = _plan(classes, targets(sources, weights, most), most, dp_words)

    # the bucket of each length in which the cut falls, and how many documents of it are taken
    up_to = F.sum("n").over(Window.partitionBy("mix_key", "mix_size").orderBy("mix_bucket"))
    cut = cells.withColumn("upto", up_to).join(plan, (F.col("mix_key") == plan["key"]) & (F.col("mix_size") == plan["size"]))
    cut = (cut.withColumn("inside", F.when(F.col("upto") > F.col("take"), F.struct("mix_bucket", (F.col("take") - (F.col("upto") - F.col("n"))).alias("need"))))
           .groupBy("key", "size", "source_size", "target", "copies").agg(F.min("inside").alias("cut")))
    plan = materialized(cut.select(F.col("key").alias("mix_key"), F.col("size").alias("mix_size"), "source_size", "target", "copies",
                                   F.coalesce("cut.mix_bucket", F.lit(buckets)).alias("mix_cut"), F.coalesce("cut.need", F.lit(0)).alias("mix_need")))
    plan = plan.select("mix_key", "mix_size", *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "copies")], "mix_cut", "mix_need")

    # the bucket of the cut is a key of the second join, so a length that holds many rows is spread
    rows = sized.join(plan, ["mix_key", "mix_size"])
    rank = F.row_number().over(Window.partitionBy("mix_key", "mix_size").orderBy("mix_hash", "mix_order"))
    split = (bucket == F.col("mix_cut")) & (F.col("mix_need") > 0)
    away = rows.filter(~split).withColumn("mix_extra", (bucket < F.col("mix_cut")).cast("int"))
    near = rows.filter(split).withColumn("mix_extra", (rank <= F.col("mix_need")).cast("int"))
    size, source_size, target, taken = names
    return away.unionByName(near).select(
        *[F.col(f"mix_row.c{i}").alias(c) for i, c in enumerate(columns)], F.col("mix_size").alias(size), F.col("mix_source_size").alias(source_size),
        F.col("mix_target").alias(target), ((F.col("mix_copies") + F.col("mix_extra")) * F.col("mix_size")).alias(taken))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("n_words"))
    return mixed(materialized(docs), size=F.col("n_words")).select("doc_id", "size", "source_size", "target", "taken")
