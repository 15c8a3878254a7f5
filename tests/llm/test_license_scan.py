import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tripwire.llm import license_scan as L
from tripwire.llm.queries import QUERIES

from .conftest import SF


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates=L.TEMPLATES, threshold=L.THRESHOLD, span=L.SPAN):
    """All places of all phrases, and every template held against every block."""
    words = terms(text)
    base = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    blocks = []
    for line in (text or "").split("\n"):
        w = terms(line)
        blocks += [w] if len(w) <= 2 * span else [w[i:i + 2 * span] for i in range(0, len(w) - span, span)]
    hits = []
    for b in blocks:
        met = [(set(terms(t)), label) for label, t in templates if terms(t)]
        met = [(t, label) for t, label in met if len(set(b) & t) / len(t) >= threshold - 1e-12]
        hits += [(len(set(b) & t) / len(t), label) for t, label in met if not any(t < u for u, _ in met)]
    own = sorted({x for _, x in base})
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own),
            ",".join(sorted(set(own) | {x for _, x in hits})), 1.0 if base else max((c for c, _ in hits), default=0.0))


def rows_of(df):
    return [(r.doc_id, (r.x.n_words, r.x.n_base, r.x.first_word, r.x.last_word, ",".join(r.x.base_labels), ",".join(r.x.labels),
                        pytest.approx(r.x.score))) for r in df.collect()]


def test_whole_table_equals_brute_force(spark, texts_sf):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_license_scan"](spark, SF).collect()}
    want = {r.doc_id: brute(r.text) for r in texts_sf.itertuples()}
    assert got == want
    labels = {x for v in got.values() for x in v[5].split(",") if x}
    assert labels >= {"mit", "apache", "gpl", "cc-by-nc"}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_join_loses_no_pair(make_docs, threshold):
    rnd = random.Random(int(threshold * 10))
    vocab = [f"v{i}" for i in range(12)] + ["ß", "É"]
    say = lambda n: " ".join(rnd.choices(vocab, weights=range(1, 15), k=n))
    templates = [(f"l{i}", say(rnd.randint(1, 9))) for i in range(8)] + [("none", "?!")]
    docs = ["\n".join(say(rnd.randint(0, 14)) for _ in range(4)) for _ in range(150)] + [say(90)]
    got = L.scan(make_docs(docs), out="x", templates=templates, threshold=threshold, span=10)
    assert dict(rows_of(got)) == {i: brute(t, templates, threshold, 10) for i, t in enumerate(docs)}


def test_every_short_run_lies_in_a_block():
    words = [f"w{i}" for i in range(530)]
    out = L.blocks(" ".join(words), 20)
    for n in (1, 7, 20):
        for i in range(len(words) - n + 1):
            run = [w.encode() for w in words[i:i + n]]
            assert any(run == b[j:j + n] for b in out for j in range(len(b) - n + 1))


def test_notices_are_told_apart(make_docs):
    rows = ["Licensed under CC BY-NC 4.0.", "licensed under cc by 4.0", "Licensed under CC BY-SA 4.0!",
            "Licensed under the GNU Lesser General Public License, version 3", "All rights reserved."]
    got = [r.licences.labels for r in L.scan(make_docs(rows)).orderBy("doc_id").collect()]
    assert got == [["cc-by-nc"], ["cc-by"], ["cc-by-sa"], ["gpl", "lgpl"], []]


def test_edges(make_docs):
    rows = [None, "", "MIT License", "mit-license.APACHE  license", "the general\npublic license general public license",
            "mit licenses", "word " * 50_000 + "Released under the MIT License", "das ist mit license: nein", "mit license"]
    frame = make_docs(rows).withColumn("labels", F.lit("clash")).withColumn("licences", F.lit(0))
    assert dict(rows_of(L.scan(frame, out="x"))) == {i: brute(t) for i, t in enumerate(rows)}
    assert L.scan(make_docs([])).count() == 0
    assert [r.licences.labels for r in L.scan(make_docs(["mit license", "gpl"]), templates=()).orderBy("doc_id").collect()] == [["mit"], []]


NOTICES = [t for label, t in L.TEMPLATES if label in ("mit", "gpl", "bsd", "cc0") and len(t) > 100]


def stretches(text, templates, threshold, reach):
    """Labels of templates held against every stretch of `reach` words; a smaller one needs a place without a larger one."""
    words, out = terms(text), set()
    sets = [(label, set(terms(t))) for label, t in templates if terms(t)]
    met = lambda t, a, b: len(t & set(words[a:b])) / len(t) >= threshold - 1e-12
    for label, t in sets:
        places = [(a, b) for a in range(len(words)) for b in range(a + 1, min(len(words), a + reach) + 1)
                  if met(t, a, b) and not met(t, a + 1, b) and not met(t, a, b - 1)]
        for a, b in places:
            around = range(max(0, b - reach), a + 1)
            if not any(t < u and met(u, i, i + reach) for _, u in sets for i in around):
                out.add(label)
    return out


@pytest.mark.parametrize("width, mark", [(70, ""), (80, ""), (78, " * "), (72, "# "), (20, "// ")])
def test_wrapped_notices(make_docs, width, mark):
    assert len(NOTICES) == 4
    rows = ["some prose before it\n" * 9 + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\nand after it" * 9 for t in NOTICES]
    assert all(not r.x.matches for r in L.scan(make_docs(rows), out="x", span=L.SPAN).collect())  # no line has enough of them
    got = L.scan(make_docs(rows)).orderBy("doc_id").collect()
    assert [r.licences.labels for r in got] == [["mit"], ["gpl"], ["bsd"], ["cc0"]]
    assert all(r.licences.score == 1.0 and r.licences.matches for r in got)


def test_windows_equal_all_stretches():
    rnd = random.Random(7)
    say = lambda k: " ".join(rnd.choices("abcdefghijkl", weights=range(1, 13), k=k))
    for n in range(150):
        threshold = rnd.choice([0.5, 0.8, 0.95, 1.0])
        templates = [(f"l{i}", say(rnd.randint(2, 9))) for i in range(6)]
        templates += [("more", templates[0][1] + " z")]
        known = L.Templates(templates, {w.encode(): i for i, w in enumerate("lkjihgfedcba")}, threshold)
        known.reach = reach = rnd.randint(9, 14)
        text = " ".join(rnd.choice([say(3), "x y", "q r s t u v w", say(6), "z"]) for _ in range(rnd.randint(1, 20)))
        got = {templates[t][0] for _, t, _ in known.across(L.lower_terms(text))}
        assert got == stretches(text, templates, threshold, reach), (n, text)


def test_long_templates_and_parts_of_larger_ones(make_docs):
    long = " ".join(f"t{i}" for i in range(300))
    templates = [("long", long), ("part", "under these terms"), ("whole", "under these terms of x")]
    rows = [long, "a " * 90 + "\n".join(textwrap.wrap(long, 60)), "under these\nterms of x", "under\nthese terms", long[:700]]
    got = L.scan(make_docs(rows), templates=templates).orderBy("doc_id").collect()
    assert [r.licences.labels for r in got] == [["long"], ["long"], ["whole"], ["part"], []]
