"""Spelling variants of words: edit-distance-one join by asymmetric q-chunks, and the form that each variant stands for.

Join. A word of m code points contributes two disjoint chunks of q = m // 2: the code points [0, q) and [q, 2q). A word
of m or m + 1 code points contributes its positional q-grams. One edit leaves a chunk whole, and moves it by one place
at most: an edit at place q or later leaves the first chunk where it is; one before place q leaves the second, one place
further if it inserted a code point. So two words at distance one meet under (m, chunk, gram), and as lengths tell the
shift, the longer word makes only the grams that a chunk can meet: its rows are constant in number and linear in size
however long it is. Candidates are verified by the edit distance itself.

Hot chunks. A key with more than `bucket` rows (a prefix that very many words share) is not paired: its members are
joined under the key and, as well, the word with one code point taken out, at the places where the edit must be when
that chunk is whole. After a replacement both words lack the same place; after an insertion the longer one without the
inserted code point is the shorter one. Few words share such a key (the size of the alphabet), and its pairs are the
near pairs. Nothing is capped; both ways find every pair, and candidates per word are bounded whatever the vocabulary.

Words of a table without any have no rows; null texts hold no words; a null id counts as the empty text. Repeated rows
count as often as they stand there. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripwire.llm.common import join_unique, materialized, raw, table, written

LETTERS = re.compile("[A-Za-z\u00C0-\u00FF]+")
SHORTEST = 7
LEAST = 2
TIMES = 10
BUCKET = 64
#: One of so many runs of a document loses a code point, chosen by the crc32 of id and run.
SLIPS = 31


def slipped(run: str, doc: int) -> str:
    """The run, or for one in SLIPS the run without one code point; doc is the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), doc)
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % SLIPS == 0 else run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): distinct words of at least `shortest` code points that stand in the texts `least` times or more.

    Counts are added up per batch before they are shuffled, so a frequent word is a few rows per task.
    """

    def count(batches):
        for batch in batches:
            total: Counter = Counter()
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                runs = Counter(LETTERS.findall(raw(t).lower().decode("utf-8", "surrogatepass")))
                start = zlib.crc32(f"{i}:".encode())
                for run, n in runs.items():
                    if len(run) >= shortest:
                        total[slipped(run, start)] += n
            kept = {w: n for w, n in total.items() if len(w) >= shortest}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _keys(words: DataFrame) -> DataFrame:
    """(key, m, k, own, word, n): a row for each chunk (own: it is also a gram of words of that length) and longer word's gram."""
    size = F.length("word")

    def row(m: Column, k: int, shift: int) -> Column:
        q = F.floor(m / 2).cast("int")
        gram = F.substr(F.col("word"), q * k + shift + 1, q)
        return F.struct(F.xxhash64(m, F.lit(k), gram).alias("key"), m.alias("m"), F.lit(k).alias("k"), (m == size).alias("own"))

    rows = F.array(row(size, 0, 0), row(size, 1, 0), row(size - 1, 0, 0), row(size - 1, 1, 1))
    return words.select("word", "n", F.explode(rows).alias("r")).select("r.*", "word", "n")


def _without(i: Column) -> Column:
    return F.concat(F.substr(F.col("word"), F.lit(1), i), F.substr(F.col("word"), i + 2))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, na, b, nb): every unordered pair of words (word, n) at edit distance exactly one, once."""
    rows = _keys(words)
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows_of_key")).filter("rows_of_key > 1"), "spelling-sizes")
    total = 4 * words.count()
    marked = written(join_unique(rows, sizes, ["key"], "rows_of_key", total), "spelling-marked")

    def met(found: DataFrame) -> DataFrame:
        chunks = found.filter("own").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        grams = found.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
        first = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
        return chunks.join(grams, "key").filter(first & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")

    cold = met(marked.filter(F.col("rows_of_key") <= bucket))
    hot = marked.filter(F.col("rows_of_key") > bucket)
    # places of the edit when the first or the second chunk is whole
    q = F.floor(F.col("m") / 2).cast("int")
    longer = (~F.col("own")).cast("int")
    places = F.when(F.col("k") == 0, F.sequence(q, F.length("word") - 1)).otherwise(F.sequence(F.lit(0), q - 1 + longer))
    cuts = hot.withColumn("i", F.explode(places))
    replaced = cuts.filter("own").withColumn("key", F.xxhash64("key", "i", _without(F.col("i"))))
    inserted = (cuts.filter("not own").withColumn("key", F.xxhash64("key", F.lit(-1), _without(F.col("i")))).drop("i")
                .unionByName(hot.filter("own").withColumn("key", F.xxhash64("key", F.lit(-1), F.col("word")))))
    return cold.unionByName(met(replaced)).unionByName(met(inserted)).distinct()


def variants(words: DataFrame, times: int = TIMES, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word (word, n).

    form: the most frequent near word (ties: the first in code-point order) where it is `times` as frequent, else null;
    root: the end of the chain of forms, the word itself without any. A chain's counts rise by a factor of `times` at
    each step, so it has few steps and pointer jumping few rounds.
    """
    words = written(words, "spelling-words")
    pairs = written(near_pairs(words, bucket), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other")).alias("best"))
    rare = F.col("best.other_n") >= times * F.col("n")
    rows = materialized(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(rare, F.col("best.other")).alias("form"), F.when(rare, F.col("best.other_n")).alias("form_n")))
    roots = materialized(rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        further = roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        further = materialized(further)
        roots = further.select("word", "root")
        if not further.filter("moved").take(1):
            break
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))
