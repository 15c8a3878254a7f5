"""Parameter and tag text: lookups, 'k=v' threshold lists, tag lists and their JSON forms.

Threshold text is data: it is parsed into typed values, never executed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

_KV = re.compile(r"@?(\w+)\s*(?:\w+)?\s*=\s*(.*)")


def parse_thresholds(text: str) -> dict[str, str]:
    """'@A int=1,@B int=2' or ';'-separated -> {'A': '1', 'B': '2'} (driver-side, for config text)."""
    out: dict[str, str] = {}
    for part in re.split(r"[,;]", text or ""):
        m = _KV.match(part.strip())
        if m:
            out[m.group(1)] = m.group(2).strip()
    return out


def thresholds_kv(text: Column) -> Column:
    """Column form of `parse_thresholds`: text -> map<name, value text> (last duplicate wins)."""
    items = F.filter(F.split(text, "[,;]"), lambda x: F.trim(x) != "")
    entries = F.transform(items, lambda x: F.struct(
        F.regexp_extract(x, r"@?(\w+)", 1).alias("k"), F.trim(F.regexp_extract(x, r"=\s*(.*)$", 1)).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def param_value(parameters: DataFrame, name: str, default: str | None) -> DataFrame:
    """One-row frame with the parameter's value, or the default when the name is absent."""
    hit = parameters.filter(F.col("name") == name).agg(F.max("value").alias("_v"))
    return hit.select(F.coalesce(F.col("_v"), F.lit(default)).alias("value"))


def tag_pairs(text: Column) -> Column:
    """'Tag1:v1,v2;Tag2:v3' -> array<struct<tag_name, tag_value>> (explode it for rows)."""
    groups = F.filter(F.split(text, ";"), lambda g: F.trim(g) != "")

    def expand(g: Column) -> Column:
        name = F.trim(F.substring_index(g, ":", 1))
        vals = F.split(F.regexp_extract(g, r"^[^:]*:(.*)$", 1), ",")
        return F.transform(vals, lambda v: F.struct(name.alias("tag_name"), F.trim(v).alias("tag_value")))

    return F.flatten(F.transform(groups, expand))


TAGS_JSON_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("tags", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]))]))

THRESHOLDS_JSON_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("thresholds", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))]))


def _mode(strict: bool) -> dict:
    return {"mode": "FAILFAST" if strict else "PERMISSIVE"}


def tags_from_json(doc: Column, strict: bool = False) -> Column:
    """'[{"tags": {"name": n, "values": [..]}}]' -> array<struct<tag_name, tag_value>>.

    An entry without values still yields one pair with a NULL value (outer semantics). Malformed
    text gives NULL, or an error where `strict` is set."""
    arr = F.from_json(doc, TAGS_JSON_SCHEMA, _mode(strict))
    per = F.transform(arr, lambda e: F.transform(
        F.coalesce(e["tags"]["values"], F.array(F.lit(None).cast("string"))),
        lambda v: F.struct(e["tags"]["name"].alias("tag_name"), v.alias("tag_value"))))
    return F.flatten(per)


def thresholds_from_json(doc: Column, strict: bool = False) -> Column:
    """'[{"thresholds": {"name": n, "value": v}}]' -> array<struct<threshold, limit>>; `strict` as above."""
    arr = F.from_json(doc, THRESHOLDS_JSON_SCHEMA, _mode(strict))
    return F.transform(arr, lambda e: F.struct(e["thresholds"]["name"].alias("threshold"),
                                               e["thresholds"]["value"].alias("limit")))
