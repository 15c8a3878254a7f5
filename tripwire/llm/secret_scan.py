"""Secret scans with a trigram inverted index, DataFrame functions only.

1. Query. From each rule's regular expression a Boolean trigram query is derived: literal runs that
   every match must contain become AND clauses of their trigrams, alternatives become OR. All of it is
   lower-cased, so one index serves rules in either case.
2. Index. Every document is probed for the trigrams that occur in the queries; a posting is a row
   (trigram, document). Postings are joined to the clauses of the rules and intersected: a document is
   a candidate of a rule when it has all trigrams of one of the rule's clauses.
3. Verification. Candidates meet their texts again in one shuffle by document and only there the
   rule's expression runs. A rule without mandatory trigrams (a bare hexadecimal run) scans all texts.

Matches are leftmost and do not overlap within a rule; a match whose checked group is too short is
dropped but still consumes its text. Positions count code points, ends are exclusive; they are summed
from the pieces between matches.

Null and empty texts have no spans. Documents are told apart by a hash of id and text, so repeated
rows share candidates and each keeps its own row; a hash collision could only add a candidate, which
verification decides. Extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.llm.common import free_name, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `group` of each match must have `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The patterns that the scan must find, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------------- trigram queries from expressions

EXACT = 64  # largest set of literal alternatives that is kept apart; beyond it a part counts as anything


def _trigrams(word: str) -> frozenset:
    return frozenset(word[i:i + 3] for i in range(len(word) - 2))


def _all(a: set, b: set) -> set:
    """AND of two OR-sets of trigram clauses."""
    return {x | y for x in a for y in b}


ANY = {frozenset()}  # the query that every text satisfies: one clause without trigrams


def _literals(words: set) -> set:
    """OR over the words, each the AND of its trigrams; too short a word matches anything."""
    return {_trigrams(w) for w in words}


def _walk(tree) -> tuple[set | None, set]:
    """(exact set of strings or None, trigram clauses) of a parsed expression, in sequence."""
    done, run, literal = ANY, {""}, True
    for op, arg in tree:
        exact, query = _node(str(op), arg)
        if exact is not None and len(run) * len(exact) <= EXACT:
            run = {a + b for a in run for b in exact}
            continue
        literal = False
        done = _all(_all(done, _literals(run)), query if exact is None else _literals(exact))
        run = {""}
    return (run, ANY) if literal else (None, _all(done, _literals(run)))


def _node(op: str, arg) -> tuple[set | None, set]:
    if op == "LITERAL":
        return {chr(arg).lower()}, ANY
    if op == "IN":
        chars = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op == "SUBPATTERN":
        return _walk(arg[-1])
    if op == "BRANCH":
        parts = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            return reduce(set.union, (e for e, _ in parts)), ANY
        return None, reduce(set.union, (q if e is None else _literals(e) for e, q in parts))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        exact, query = _walk(body)
        if exact is not None and low == 0 and high == 1:
            return exact | {""}, ANY
        if exact is not None and low == high == 1:
            return exact, ANY
        if low == 0:
            return None, ANY
        return None, query if exact is None else _literals(exact)
    return None, ANY


def trigram_query(pattern: str) -> list[frozenset]:
    """OR of AND clauses of lower-case trigrams; empty where nothing is mandatory (scan everything)."""
    exact, clauses = _walk(re._parser.parse(pattern))
    clauses = clauses if exact is None else _literals(exact)
    least = {c for c in clauses if not any(d < c for d in clauses)}
    return [] if frozenset() in least else sorted(least, key=sorted)


# ---------------------------------------------------------------- index, candidates, verification


def _clauses(rules) -> list[tuple[str, int, frozenset]]:
    return [(r.kind, i, c) for r in rules for i, c in enumerate(trigram_query(r.pattern))]


def postings(docs: DataFrame, key: Column, text: Column, rules=RULES) -> DataFrame:
    """(doc_key, trigram): the part of the trigram index that the rules' queries read."""
    grams = sorted({t for _, _, c in _clauses(rules) for t in c})
    low = docs.select(key.alias("doc_key"), F.lower(text).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in grams]))
    return low.select("doc_key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_key, kinds): the rules whose query the document's postings satisfy."""
    clauses = _clauses(rules)
    of = {}  # trigram -> clauses that need it; the size of this map is fixed by the rules
    for kind, i, clause in clauses:
        for t in clause:
            of.setdefault(t, []).append((kind, i, len(clause)))
    needs = F.create_map(*[x for t, needed in sorted(of.items()) for x in (
        F.lit(t), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(n).alias("size")) for k, i, n in needed]))])
    probe = index.distinct().select("doc_key", F.explode(F.element_at(needs, F.col("trigram"))).alias("q"))
    return (probe.groupBy("doc_key", "q.kind", "q.clause", "q.size").agg(F.count(F.lit(1)).alias("n"))
            .filter("n = size").groupBy("doc_key").agg(F.collect_set("kind").alias("kinds")))


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<start,end,kind>> of one rule in one text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.arrays_zip(whole.alias("m"), group.alias("g"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("gap"))
    span = "struct<start:long,end:long,kind:string>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["m"])
        one = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(p["g"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, begin, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "spans", rules=RULES) -> DataFrame:
    """docs plus `out`: array<struct<start,end,kind>> by start, then kind in the order of the rules."""
    key, kinds, body = (free_name(docs, n) for n in ("doc_key", "candidate_kinds", "whole_text"))
    key_of = F.xxhash64(doc_id, text)
    cand = candidates(postings(docs, key_of, F.col(text), rules), rules)
    cand = cand.select(F.col("doc_key").alias(key), F.col("kinds").alias(kinds))
    rows = docs.withColumn(key, key_of).join(cand.hint("shuffle_hash"), key, "left").withColumn(body, F.coalesce(text, F.lit("")))
    none = F.array().cast("array<struct<start:long,end:long,kind:string>>")
    parts = []
    for rule in rules:
        found = _matches(F.col(body), rule)
        if trigram_query(rule.pattern):
            found = F.when(F.array_contains(kinds, rule.kind), found).otherwise(none)
        elif rule.group == 0 and rule.least > 0:  # a plain run: most texts have none that is long enough
            found = F.when(F.col(body).rlike(re.sub(r"\+$", f"{{{rule.least}}}", rule.pattern)), found).otherwise(none)
        parts.append(found)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform(F.concat(*parts), lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("rank"), s["end"], s["kind"]))
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return rows.withColumn(out, spans).drop(key, kinds, body)


def redacted(docs: DataFrame, mark: str = "[secret]", rules=RULES) -> DataFrame:
    """Documents with every stretch of secrets replaced by `mark`, n_chars counted anew where a text changed."""
    spans = free_name(docs, "secret_spans")
    found = scan(docs, out=spans, rules=rules)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(acc, s):  # spans come by start; one that overlaps what is replaced already only moves the end
        fresh = F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when((s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0)), acc["done"]).otherwise(fresh).alias("done"))

    text = F.aggregate(spans, begin, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    # the new text gets a name of its own first: within one select, lambdas would see the new "text"
    fresh = free_name(found, "fresh_text")
    found = found.withColumn(fresh, F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    changes = {"text": F.col(fresh)}
    if "n_chars" in docs.columns:
        count = F.length(fresh).cast(docs.schema["n_chars"].dataType)
        changes["n_chars"] = F.when(F.size(spans) > 0, count).otherwise(F.col("n_chars"))
    return found.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """DuckDB: every rule over every text; positions from the pieces between matches."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {i} AS rank, '{r.kind}' AS kind, e - len(m[k]) AS s, e
FROM (SELECT r, m, k, v, list_sum([len(x) for x in m[1:k]]) + list_sum([len(x) for x in gap[1:k]]) AS e
      FROM (SELECT r, m, gap, v, unnest(range(1, len(m) + 1)) AS k
            FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS v,
                         string_split_regex(t, '{p}') AS gap FROM d)))
WHERE len(v[k]) >= {r.least}""")
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    kinds = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {count},
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (kind IN ({kinds})) AS base,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
      FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


ORACLE = _oracle()
