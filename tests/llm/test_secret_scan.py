import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from tripwire.llm import secret_scan as S
from tripwire.llm.queries import ORACLES, QUERIES

from .conftest import SF

HEX = "0123456789abcdef" * 2
CASES = [
    None, "", " ", "nothing here",
    f'token = "{HEX}a" and more', f'TOKEN: {HEX.upper()}', "password=short", "password = 'longenough1'",
    "secret: passwd : abcdefghij", "secret: abc token=abcdefgh12", "api_key:abcdefgh apikey=ABCDEFGH API_KEY = x" + "y" * 9,
    "api-key=abcdefgh", "AKIA" + "A1" * 6, "AKIA" + "Z" * 11, "xAKIAAKIA" + "Q" * 12 + "q", "akia" + "1" * 20,
    HEX, HEX[:-1], "é" * 5 + HEX + "ß😀" + HEX + "g" + HEX * 3, "token=" + "😀" + " token=abcdefgh",
    "ghp_" + "a1" * 18 + " xoxb-1234567890-abc AIza" + "x" * 35 + " sk_live_" + "9" * 20,
    "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----", "eyJabcdefgh1.eyJabcdefgh2.sig_sig_sig",
    "secret=" + HEX + "\n" * 3 + "passwd\":\"" + HEX, "KEY key to ken ap i se cret", "PaSsWoRd='AKIA" + "B" * 16 + "'",
]


def brute(text, rules=S.RULES):
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), rank, m.end(), r.kind))
    return [(k, s, e) for s, _, e, k in sorted(found)]


def test_spans_equal_brute_force(make_docs):
    docs = make_docs(CASES + CASES[:6]).withColumn("doc_key", F.lit("clash")).withColumn("kinds", F.lit(1))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in S.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES + CASES[:6])}


def test_rows_repeat_and_ids_may_be_null(make_docs):
    rows = [(None, CASES[4]), (None, CASES[4]), (1, CASES[4]), (1, CASES[3]), (1, CASES[4])]
    assert sorted(len(r.spans) for r in S.scan(make_docs(rows)).collect()) == [0, 2, 2, 2, 2]


def test_every_match_satisfies_its_trigram_query():
    for r in S.RULES:
        clauses = S.trigram_query(r.pattern)
        for text in CASES:
            for m in re.finditer(r.pattern, text or ""):
                low = m[0].lower()
                assert not clauses or any(all(t in low for t in c) for c in clauses), (r.kind, m[0])


def test_trigram_queries():
    assert S.trigram_query("[0-9a-f]+") == [] and S.trigram_query("a?b?c?") == [] and S.trigram_query("(abc|x)") == []
    assert S.trigram_query("abc(d|e)f") == [frozenset({"abc", "bcd", "cdf"}), frozenset({"abc", "bce", "cef"})]
    assert S.trigram_query("(foo|bar)+x") == [frozenset({"bar"}), frozenset({"foo"})]
    assert S.trigram_query("hello.*WORLD") == [frozenset({"hel", "ell", "llo", "wor", "orl", "rld"})]


def test_candidates_come_from_intersected_postings(make_docs):
    docs = make_docs(["tok ken oke", "tok oke", "token", None])
    rules = (S.Rule("t", "token=x"),)
    index = S.postings(docs, F.col("doc_id"), F.col("text"), (S.Rule("t", "token"),))
    assert sorted((r.doc_key, r.trigram) for r in index.collect()) == [
        (0, "ken"), (0, "oke"), (0, "tok"), (1, "oke"), (1, "tok"), (2, "ken"), (2, "oke"), (2, "tok")]
    assert sorted(r.doc_key for r in S.candidates(index, (S.Rule("t", "token"),)).collect()) == [0, 2]
    assert rules[0].kind == "t"


def cut(text, mark="[secret]"):
    if text is None:
        return None
    out, at = "", 0
    for _, s, e in brute(text):
        if s < at or (s == at and at > 0):
            at = max(at, e)
            continue
        out, at = out + text[at:s] + mark, max(at, e)
    return out + text[at:]


def test_redaction(make_docs):
    docs = make_docs(CASES).withColumn("secret_spans", F.lit(2))
    out = S.redacted(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == cut(CASES[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert not brute(r.text)


def test_empty_table(make_docs):
    assert S.scan(make_docs([])).count() == 0 and S.redacted(make_docs([])).count() == 0


def test_oracle_and_digest(spark, texts_sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    res = con.execute(ORACLES["op7_secret_scan"])
    cols = [d[0] for d in res.description]
    df = QUERIES["op7_secret_scan"](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = df.select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())
    kinds = {r.kind for r in S.BASE_RULES}
    text = dict(zip(texts_sf.doc_id, texts_sf.text))
    for r in got:
        spans = brute(text[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in kinds)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    assert sum(r.n_assign for r in got) > 0


def test_main_path_has_no_python(spark):
    plan = QUERIES["op7_secret_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
