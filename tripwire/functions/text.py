"""Column-level helpers: number formatting, XML escaping, small text rules.

All are built-in Spark expressions (they stay inside whole-stage codegen); no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fmt_n(c: Column, digits: int) -> Column:
    """Culture-style 'N<digits>' number text: thousands separators, half away from zero.

    `round` on a decimal rounds half-up (away from zero); the rounded value is then printed
    with exactly `digits` decimals, so no second rounding happens in `format_number`.
    """
    d = c.cast(f"decimal(38,{max(digits, 6)})")
    return F.format_number(F.round(d, digits), digits)


def xml_escape(c: Column) -> Column:
    """Escape text for an XML/HTML element body (& first)."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def unescape_angles(c: Column) -> Column:
    """Undo the escaping of < and > only (keeps &amp; entities)."""
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def td(c: Column) -> Column:
    """One table cell; a NULL value produces no cell at all."""
    return F.concat(F.lit("<td>"), xml_escape(c.cast("string")), F.lit("</td>"))


def tr(*cells: Column) -> Column:
    """One table row from cell values (NULL cells are left out)."""
    return F.concat(F.lit("<tr>"), F.concat_ws("", *[td(c) for c in cells]), F.lit("</tr>"))


def flag_label(flag: Column) -> Column:
    """0/1 flag as the fixed-width label 'No ' / 'Yes'."""
    return F.when(flag == 1, F.lit("Yes")).when(flag == 0, F.lit("No "))


def counter_path(obj: Column, counter: Column, instance: Column) -> Column:
    """object\\counter\\instance; an empty instance name is left out."""
    return F.concat_ws("\\", obj, counter, F.nullif(instance, F.lit("")))


def wiki_link(wiki: Column, alert_name: Column) -> Column:
    """Wiki URL with the alert name filled in; spaces become dashes for github links."""
    w = F.replace(wiki, F.lit("##alertname##"), alert_name)
    return F.when(F.lower(w).contains("github"), F.replace(w, F.lit(" "), F.lit("-"))).otherwise(w)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two times (datediff(minute, start, end) semantics)."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end))


def int_avg(total: Column, count: Column) -> Column:
    """Integer average that truncates toward zero, like an integer AVG."""
    return F.when(count > 0, (total.cast("decimal(38,0)") / count).cast("bigint"))
