"""Token-id files: Parquet list columns in document order, for selective reads of ids and metadata.

`write_tokens` encodes texts with a public tokenizer, ends every document with one end id and writes

    <path>/tokens   part, doc_id, start, n_tokens, ids (list of int) and, if asked for, meta (a struct)
    <path>/parts    one row per file: part, base, first_id, last_id, n_docs, n_tokens

in ascending document order: range partitions over (id, text hash), each sorted, one file each. `start` counts the
ids before a document in its own file, `base` those before the file, so a document's place in the whole stream is
base + start and the ids are written in a single pass.

Format: `ids` is dictionary encoded (a tokenizer has few distinct ids, so the indexes are bit-packed; parquet-mr
itself changes a chunk to plain pages once its dictionary is full). doc_id, start and n_tokens are rising or small
numbers and take the delta encoding of format version 2. Row groups end at `row_group` bytes and pages at `page_rows`
rows or `page` bytes; the writer adds column and offset indexes, so a filter on doc_id or start reads the pages that
can match and `metadata` never touches the ids. `layout` reports what the files hold.

Null texts are empty: their only id is the end id. Ids may repeat or be null (null first); rows of equal id are
ordered by the hash of their text. Extra columns are left out unless named in `meta`, where names cannot clash.
An empty table gives no rows. Texts are encoded whole, whatever their length.

Encoding: the tokenizers library encodes distinct words, with the space before them; a worker remembers the words it met
most often from task to task. This goes for tokenizers that are a byte-level BPE without normalizer, which always starts a
new piece at a space after a word; with any other tokenizer, and in texts with other white space, the library encodes text
by text. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tripwire.llm.common import table
from tripwire.session import checkpoint_dir

VOCABULARY = "byte_bpe_50k.json"
END = 2
ROW_GROUP = 32 << 20
PAGE = 128 << 10
PAGE_ROWS = 2000
#: Distinct words that the library encodes as one text, and texts that it gets at once.
TOGETHER = 256
LIBRARY = 64
#: Distinct words that a worker remembers; beyond them it keeps those that it met most often, which changes no result.
REMEMBERED = 600_000
#: Texts whose distinct words are looked for at once.
AT_ONCE = 4000

#: Texts that are encoded whole: white space before a space, a space at the end, or white space that is not ASCII or that
#: only some libraries count as such. In all others a space that follows a word starts a new piece of the tokenizer.
_WHOLE = (r"[\t\n\x0b\x0c\r ] | $|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}\x{feff}]")

#: Words that may be joined to one text: neither empty nor with white space at an end.
_JOINED = r"(?s)^[^\t\n\x0b\x0c\r ](?:.*[^\t\n\x0b\x0c\r ])?$"


def _path(vocabulary: str) -> str:
    """The file itself, or that of the public package by this name, looked up on the worker."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Encoder:
    """Ids of whole texts; distinct words are encoded once and remembered."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(_path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(self.tokenizer.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.by_word = (parts["normalizer"] is None and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
                        and not pre.get("add_prefix_space") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")))
        if self.by_word:  # byte-level tokens are spelt with one character a byte
            vocabulary_ids = self.tokenizer.get_vocab(with_added_tokens=False)
            self.bytes_of_id = np.zeros(max(vocabulary_ids.values()) + 1, np.int64)
            for token, i in vocabulary_ids.items():
                self.bytes_of_id[i] = len(token)
        self.words, self.lists, self.met = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), np.zeros(0, np.int32)

    def _encoded(self, texts: list[str]) -> pa.ListArray:
        """The ids of every text; few texts at a time, as the library's results are many times as large as the ids."""
        sizes, parts = [0], [np.zeros(0, np.int32)]
        for i in range(0, len(texts), LIBRARY):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i:i + LIBRARY], add_special_tokens=False)]
            sizes += map(len, found)
            parts.append(np.fromiter(chain.from_iterable(found), np.int32))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts)))

    def _after_space(self, words: pa.Array) -> pa.ListArray:
        """The ids of distinct words with a space before each.

        Some hundred words at a time are one text: each starts a new piece, so an id's bytes tell its word.
        """
        joined = pc.match_substring_regex(words, _JOINED).to_numpy(zero_copy_only=False)
        plain, other = words.filter(pa.array(joined)), words.filter(pa.array(~joined)).to_pylist()
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(plain), TOGETHER), len(plain)], pa.int32()), plain)
        flat = self._encoded([f" {t}" for t in pc.binary_join(groups, " ").to_pylist()]).values.to_numpy()
        sizes = pc.binary_length(plain).to_numpy().astype(np.int64) + 1
        ends = np.searchsorted(np.cumsum(self.bytes_of_id[flat]), np.cumsum(sizes)) + 1
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
        at = np.empty(len(words), np.int32)
        at[joined], at[~joined] = np.arange(len(plain)), np.arange(len(plain), len(words))
        return pa.concat_arrays([lists, self._encoded([f" {w}" for w in other])]).take(pa.array(at))

    def _known(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in self.lists, after encoding those that are new."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new, old = words.filter(pc.is_null(at)), len(self.words)
            at = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
            at[at < 0] = np.arange(old, old + len(new))
            self.words, self.lists, self.met = (pa.concat_arrays([self.words, new]), pa.concat_arrays([self.lists, self._after_space(new)]),
                                                np.concatenate([self.met, np.zeros(len(new), np.int32)]))
        else:
            at = at.to_numpy()
        self.met[at] += 1
        return at

    def _forget(self) -> None:
        """Keep the words that were met in most calls, fewer than half of what may be remembered."""
        often = self.met > np.partition(self.met, -REMEMBERED // 2)[-REMEMBERED // 2]
        self.words, self.lists, self.met = self.words.filter(pa.array(often)), self.lists.filter(pa.array(often)), self.met[often]

    def __call__(self, texts: pa.Array, end: int) -> pa.ListArray:
        """The ids of every text with the end id behind them."""
        texts = pc.fill_null(texts, "")
        last = pa.array([[end]], pa.list_(pa.int32()))
        whole = np.full(len(texts), True) if not self.by_word else pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        if whole.all():
            at = np.full(2 * len(texts), len(texts), np.int32)
            at[::2] = np.arange(len(texts))
            found = pa.concat_arrays([self._encoded(texts.to_pylist()), last]).take(pa.array(at))
            return pa.ListArray.from_arrays(found.offsets.take(pa.array(np.arange(0, len(at) + 1, 2))), found.values)
        if whole.any():  # in the order of the texts again
            at = np.empty(len(texts), np.int64)
            at[whole], at[~whole] = np.arange(whole.sum()), np.arange(whole.sum(), len(texts))
            return pa.concat_arrays([self(texts.filter(pa.array(w)), end) for w in (whole, ~whole)]).take(pa.array(at))
        split = pc.split_pattern(texts, " ")
        words, start = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        first = words.take(pa.array(start[:-1])).dictionary_encode()  # no space before a text's first word
        coded = words.dictionary_encode()
        del split, words
        at = self._known(coded.dictionary)[coded.indices.to_numpy()]
        at[start[:-1]] = len(self.lists) + first.indices.to_numpy()
        lists = pa.concat_arrays([self.lists, self._encoded(first.dictionary.to_pylist()), last])
        at = np.insert(at, start[1:], len(lists) - 1)
        if len(self.words) > REMEMBERED:
            self._forget()
        found = lists.take(pa.array(at))
        return pa.ListArray.from_arrays(found.offsets.take(pa.array(start + np.arange(len(start)))), found.values)


@lru_cache(maxsize=1)
def _kept(path: str, changed: int) -> Encoder:
    return Encoder(path)


def encoder_of(vocabulary: str) -> Encoder:
    """The worker's encoder, which its tasks share: a later task need not load the tokenizer nor encode frequent words anew."""
    path = _path(vocabulary)
    return _kept(path, os.stat(path).st_mtime_ns)


def _encoded(rows: DataFrame, key: str, vocabulary: str, end: int) -> DataFrame:
    """Sorted partitions (key, text, meta) as rows of the file, with the running start of every document."""

    def encode(batches):
        encoder, total, part = encoder_of(vocabulary), 0, TaskContext.get().partitionId()
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            n = batch.num_rows
            lists = encoder(batch.column("text"), end)
            ends = lists.offsets.to_numpy().astype(np.int64)
            columns = {"part": pa.array(np.full(n, part, np.int32)), "doc_id": batch.column(key),
                       "start": pa.array(total + ends[:-1]), "n_tokens": pa.array(np.diff(ends)), "ids": lists}
            if "meta" in batch.schema.names:
                columns["meta"] = batch.column("meta")
            total += int(ends[-1])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            pa.default_memory_pool().release_unused()

    kind = rows.schema[key].dataType.simpleString()
    meta = f", meta {rows.schema['meta'].dataType.simpleString()}" if "meta" in rows.columns else ""
    return rows.mapInArrow(encode, f"part int, doc_id {kind}, start long, n_tokens long, ids array<int>{meta}")


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", meta: "tuple[str, ...]" = (),
                 vocabulary: str = VOCABULARY, end: int = END, row_group: int = ROW_GROUP, page: int = PAGE,
                 page_rows: int = PAGE_ROWS, codec: str = "zstd") -> None:
    """Encode docs and write them as token files under `path` (a folder that executors and readers share).

    Texts are shuffled once, by ranges that sampling makes about equally large; the last sort key is the row's place in
    the input, so copies of one row spread over ranges as well.
    """
    columns = [F.col(f"`{doc_id}`").alias("key"), F.col(f"`{text}`").alias("text")]
    if meta:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in meta]).alias("meta"))
    order = ["key", "hash", "place"]
    rows = docs.select(*columns).withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("hash", "place")
    options = {
        "compression": codec, "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group,
        "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")},
    }
    _encoded(rows, "key", vocabulary, end).write.options(**options).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    files = (metadata_of_files(spark, path).groupBy("part")
             .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_docs"),
                  F.sum("n_tokens").alias("n_tokens")))
    # one row per file: the only rows of this window
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def metadata_of_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tokens").drop("ids")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Rows of token files with `start` counted over all files."""
    base = spark.read.parquet(f"{path}/parts").select(F.col("part").alias("part_"), "base")
    placed = rows.join(base, rows["part"] == F.col("part_"))
    return placed.withColumn("start", F.col("base") + F.col("start")).drop("part", "part_", "base")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens and meta of every document; the ids are not read."""
    return _placed(metadata_of_files(spark, path), spark, path)


def read_tokens(spark: SparkSession, path: str, where: "Column | None" = None) -> DataFrame:
    """Documents with their ids; a filter on doc_id reaches the page indexes of the files."""
    rows = spark.read.parquet(f"{path}/tokens")
    return _placed(rows if where is None else rows.filter(where), spark, path)


def stream_slice(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids at the places first <= place < last of the whole stream: doc_id, start (of the piece), ids.

    The table of files names the files that the slice touches (two numbers come to the driver); other files are
    skipped by their statistics, and only pages of documents inside the slice are used.
    """
    parts = spark.read.parquet(f"{path}/parts")
    hit = parts.filter((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    low, high = hit.agg(F.min("part"), F.max("part")).first()
    rows = spark.read.parquet(f"{path}/tokens").filter(F.lit(False) if low is None else F.col("part").between(low, high))
    rows = _placed(rows, spark, path).filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    take = F.least(F.col("n_tokens"), F.lit(last) - F.col("start")) - skip
    return rows.filter(take > 0).select("doc_id", (F.col("start") + skip).alias("start"),
                       F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, row group and column: file, row_group, n_rows, column, encodings, bytes, and whether it has page indexes.

    Only the footers are kept of each file; the files are read where Spark's tasks run.
    """

    fields = ["file", "row_group", "n_rows", "column", "encodings", "bytes", "column_index", "offset_index"]

    def footers(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                meta = pq.ParquetFile(io.BytesIO(content)).metadata
                found = [(os.path.basename(name), g, meta.row_group(g).num_rows, c.path_in_schema, list(c.encodings),
                          c.total_compressed_size, bool(c.has_column_index), bool(c.has_offset_index))
                         for g in range(meta.num_row_groups) for c in map(meta.row_group(g).column, range(meta.num_columns))]
                yield pd.DataFrame(found, columns=fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/tokens").select("path", "content")
    return files.mapInPandas(footers, "file string, row_group int, n_rows long, column string, encodings array<string>, "
                                      "bytes long, column_index boolean, offset_index boolean")


def crc_of_ids(rows: DataFrame) -> DataFrame:
    """rows (doc_id, start, n_tokens, ids) with ids_crc32 in the place of ids."""

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4")
            sums = np.fromiter((zlib.crc32(values[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return crc_of_ids(read_tokens(spark, path))
