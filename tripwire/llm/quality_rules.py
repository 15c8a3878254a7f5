"""Quality rules: word and line statistics plus zstandard compression bands.

A document is measured whole and in fixed chunks: raw bytes / zstandard-compressed bytes. Text that
repeats itself compresses far better than prose, encoded or random data far worse. Each byte length
has its own band, because short texts cannot compress much and long ones share more context.

Verdict, in order: the base rules (too few words, too many words inside repeated 8-word windows),
then the whole-document band of the text's length, then the share of chunks outside the chunk band.

Null and empty texts have no words, so the base rules reject them; texts shorter than the first band
have no compression verdict. Every row is judged on its own: repeated rows get the same verdict, and
extra columns pass through `quality_rules` untouched.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from tripwire.llm.common import SPACES, free_name, raw

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_odd_chunks long, reason string")


@dataclass(frozen=True)
class Bands:
    """Limits of the compression rules.

    whole: (smallest byte length, lowest ratio, highest ratio), ascending by length; the last entry
    not above a text's length applies. Chunks of `chunk_bytes` (the rest at the end counts as one
    where it has at least half of that) are held against `chunk_low`..`chunk_high`; a document goes
    when more than `odd_share` of its chunks are outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (64, 0.0, 2.2), (256, 1.15, 2.6), (1024, 1.3, 3.4), (4096, 1.4, 4.5), (16384, 1.5, 6.0))
    chunk_bytes: int = 4096
    chunk_low: float = 1.3
    chunk_high: float = 4.0
    odd_share: float = 0.2
    level: int = 3
    min_words: int = 20
    max_repeat_pct: int = 30


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text.

    Rolling 64-bit sums of word hashes find the windows that can repeat at all; those few are then
    compared word by word, so a hash collision never counts.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):  # a different odd factor per position, so order matters
        key += h[i:i + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) % 2**64 | 1)
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    found = Counter(tuple(words[i:i + window]) for i in at.tolist())
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if found[tuple(words[i:i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text, pack: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    """The fields of FIELDS for one text."""
    b = raw(text)
    words = b.split()
    n = len(words)
    chars = len(text) - (len(b) - len(b.translate(None, SPACES))) if b else 0
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeats = repeat_words(words)
    base = n < bands.min_words or 100 * repeats > bands.max_repeat_pct * n

    ratio = len(b) / len(pack.compress(b)) if b else 0.0
    low, high = next(((lo, hi) for size, lo, hi in reversed(bands.whole) if len(b) >= size), (0.0, float("inf")))
    step = bands.chunk_bytes
    chunks = [b[i:i + step] for i in range(0, len(b), step) if len(b) - i >= step // 2] if len(b) > step else []
    odd = sum(not bands.chunk_low <= len(x) / len(pack.compress(x)) <= bands.chunk_high for x in chunks)
    reason = ("few_words" if n < bands.min_words else "repeated_words" if base else
              "incompressible" if ratio < low else "repetitive" if ratio > high else
              "odd_chunks" if odd > bands.odd_share * len(chunks) else None)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, base, reason is None, ratio, len(chunks), odd, reason


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality", bands: Bands = Bands()) -> DataFrame:
    """docs plus a struct column `out` with FIELDS; one Arrow pass over the text column, no shuffle."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        pack = zstandard.ZstdCompressor(level=bands.level)
        return pd.DataFrame([measure(t, pack, bands) for t in texts], columns=names)

    return docs.withColumn(out, measured(F.col(text)))


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    name = free_name(docs, "quality_verdict")
    return quality_rules(docs, out=name, bands=bands).filter(F.col(f"{name}.kept")).drop(name)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from tripwire.llm.common import table

    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "quality.*")
