"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripwire.session import checkpoint_dir, materialized

__all__ = ["SPACES", "crc_of_id", "free_name", "join_unique", "lower_terms", "lower_words", "materialized", "raw", "table", "written"]

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: They are exactly what bytes.split() and bytes.strip() treat as white space.
SPACES = b" \t\n\x0b\x0c\r"

#: Translates every ASCII byte that is neither a digit nor a lower-case letter to a space, for
#: texts whose A-Z are already lower-cased; bytes of other characters (0x80 and up) stay.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text) -> bytes:
    """UTF-8 bytes of a text cell; null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def lower_words(text) -> list[bytes]:
    """Words between white space, A-Z lower-cased (other letters keep their case)."""
    return raw(text).lower().split()


def lower_terms(text) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return raw(text).lower().translate(_ALNUM).split()


def written(df: DataFrame, name: str) -> DataFrame:
    """Like `materialized`, but as a Parquet table in the shared folder: later reads see only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crc_of_id(col: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, want: str) -> str:
    """`want`, or `want` with underscores appended until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of unique keys, without a hot key: column n of `unique` says how many rows have the key.

    Keys of over a thousandth of all `total` rows (fewer than a thousand of them, whatever the table) meet by broadcast,
    all others by shuffle. Column n stays in the result.
    """
    hot = F.col(n) * 1000 > total
    often = F.broadcast(unique.filter(hot))
    return rows.join(often, keys).unionByName(
        rows.join(F.broadcast(unique.filter(hot).select(*keys)), keys, "left_anti").join(unique.filter(~hot), keys))
