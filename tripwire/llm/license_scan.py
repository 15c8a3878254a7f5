"""Licence scans: exact set-similarity join of text blocks with licence notice templates.

A block is a line of a text; a line of more than 2 * SPAN words is cut into windows of that many words,
each starting SPAN words after the last. Notices are also wrapped over lines, so every stretch of
`reach` consecutive words of the whole text is a block too, whatever lines it crosses; `reach` is SPAN or
the words of the longest template, whichever is more. A template's tokens are a set T; block B (as a set
of tokens) meets it when |B and T| >= threshold * |T|. The join finds every such pair:

* order: all template tokens are ranked by their document frequency over all texts, rarest first;
  tokens outside every template can never match and are left out of B;
* prefix filter: o = ceil(threshold * |T|) common tokens leave at most |T| - o tokens of T unmatched,
  so B shares one of the first |T| - o + 1 tokens of T: only these are indexed;
* length filter: B has at least o template tokens;
* positional filter: with the first common token at place i of T and j of B, both in rank order, the
  overlap is at most 1 + min(|T| - i - 1, |B| - j - 1);
* the sets of the remaining pairs are intersected.

Where a block meets two templates and one's tokens are part of the other's ("CC BY" and "CC BY-NC"),
the larger one names the licence and the smaller one is no match of its own. Stretches overlap: there the
smaller one is left out where some stretch holds its place together with a place of the larger one.

The stretches are not tried one by one: windows of 2 * reach words, each starting `reach` words after the
last, hold all of them, and only templates that meet such a window are slid over its words.

Templates are a stated query set (a few notices; their number is a parameter of the operator, not of
the data) that every task holds; texts are read once for the frequencies and once for the join, and
only one row of counts per token is shuffled.

A licence phrase (its words standing consecutively) gives its label by itself. The score of a document
is 1 where it has a phrase, else the largest containment that met the threshold, else 0.

Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike, extra
columns pass through `scan`.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tripwire.llm.common import lower_terms, table

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices as public licences are declared, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission"),
)

THRESHOLD = 0.95
SPAN = 48


def blocks(text, span: int = SPAN) -> list[list[bytes]]:
    """Token lists of a text's lines; every run of up to `span` words of a line is inside one."""
    out = []
    for line in text.split("\n") if isinstance(text, str) else []:
        words = lower_terms(line)
        if len(words) <= 2 * span:
            if words:
                out.append(words)
        else:
            out += [words[i:i + 2 * span] for i in range(0, len(words) - span, span)]
    return out


class Templates:
    """Rank-ordered templates and the inverted index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        sets = [(label, set(lower_terms(t))) for label, t in templates]
        ranked = sorted(set().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w)) if sets else []
        self.rank = {w: i for i, w in enumerate(ranked)}
        self.templates, self.index = [], {}
        self.reach = max([SPAN, *(len(lower_terms(t)) for _, t in templates)])
        for label, tokens in sets:
            if not tokens:
                continue
            order = sorted(map(self.rank.__getitem__, tokens))
            need = max(1, math.ceil(threshold * len(order) - 1e-9))
            me = len(self.templates)
            self.templates.append((label, order, frozenset(order), need))
            for place, token in enumerate(order[:len(order) - need + 1]):
                self.index.setdefault(token, []).append((me, place))
        self.prefix_words = frozenset(w for w, i in self.rank.items() if i in self.index)

    def matches(self, words: list[bytes]) -> dict[int, float]:
        """{template: containment} of all templates that the block meets, but for parts of larger ones."""
        found = self.met(words)
        return {t: c for t, c in found.items() if not any(self.templates[t][2] < self.templates[u][2] for u in found)}

    def met(self, words: list[bytes]) -> dict[int, float]:
        """{template: containment} of all templates that the block meets."""
        if self.prefix_words.isdisjoint(words):
            return {}
        block = sorted({self.rank[w] for w in words if w in self.rank})
        tried, found = set(), {}
        for j, token in enumerate(block):
            for t, i in self.index.get(token, ()):
                if t in tried:
                    continue  # its first common token was seen; the pair is settled
                tried.add(t)
                _, order, tokens, need = self.templates[t]
                if len(block) < need or 1 + min(len(order) - i - 1, len(block) - j - 1) < need:
                    continue
                common = sum(x in tokens for x in block[j:])
                if common >= need:
                    found[t] = common / len(order)
        return found

    def slid(self, t: int, words: list[bytes]) -> tuple[float, list[tuple[int, int]]]:
        """(largest containment in a stretch, smallest places (first, last word) that meet the template)."""
        _, order, tokens, need = self.templates[t]
        at = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) in tokens]
        best, places = 0, []
        wide, narrow, first, start = Counter(), Counter(), 0, 0
        for i, r in at:
            wide[r] += 1
            while at[first][0] <= i - self.reach:  # the longest stretch that ends here
                old = at[first][1]
                wide[old] -= 1
                if not wide[old]:
                    del wide[old]
                first += 1
            best = max(best, len(wide))
            narrow[r] += 1
            while len(narrow) - (narrow[at[start][1]] == 1) >= need:  # the shortest that has enough
                old = at[start][1]
                narrow[old] -= 1
                if not narrow[old]:
                    del narrow[old]
                start += 1
            if len(narrow) >= need and i - at[start][0] < self.reach and not (places and places[-1][0] == at[start][0]):
                places.append((at[start][0], i))
        if best < need:
            return 0.0, []
        return best / len(order), places

    def across(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(window, template, containment) of all templates that a stretch of the whole text meets."""
        seen = []
        for k, at in enumerate(range(0, max(1, len(words) - self.reach), self.reach)):
            window = words[at:at + 2 * self.reach]
            for t in sorted(self.met(window)):
                containment, places = self.slid(t, window)
                if places:
                    seen.append((k, t, containment, [(at + a, at + b) for a, b in places]))
        places_of: dict[int, set] = {}
        for _, t, _, places in seen:
            places_of.setdefault(t, set()).update(places)
        larger = {t: [u for u in places_of if self.templates[t][2] < self.templates[u][2]] for t in places_of}
        # of places with the same first word the shortest; first and last words then both rise
        spans = {}
        for u in {u for us in larger.values() for u in us}:
            kept: list = []
            for a, b in sorted(places_of[u], reverse=True):
                if not kept or b < kept[-1][1]:
                    kept.append((a, b))
                elif kept[-1][0] == a:
                    kept[-1] = (a, b)
            spans[u] = kept[::-1]

        def part(t, a, b) -> bool:
            for u in larger[t]:
                i = bisect_left(spans[u], (b - self.reach + 1, -1))
                if i < len(spans[u]) and spans[u][i][1] <= a + self.reach - 1:
                    return True
            return False

        return [(k, t, c) for k, t, c, places in seen if not all(part(t, a, b) for a, b in places)]


def frequencies(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Document frequency of the given tokens over all texts: one partial count per task and token."""

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf[text]:
                seen.update(words.intersection(lower_terms(t)))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    rows = docs.select(text).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
         "labels array<string>, score double, matches array<struct<block:long,template:int,containment:double>>")


def scan(docs: DataFrame, text: str = "text", out: str = "licences", templates=TEMPLATES, phrases=PHRASES,
         threshold: float = THRESHOLD, span: int | None = None) -> DataFrame:
    """docs plus a struct column `out` with FOUND: phrases, labels and every block-template match.

    Blocks are numbered lines first, then windows of the whole text. With a `span` of the caller, only
    lines (cut by that span) are blocks, for texts whose lines are records of their own.
    """
    tokens = {w for _, t in templates for w in lower_terms(t)}
    known = Templates(templates, frequencies(docs, tokens, text) if tokens else {}, threshold)
    wanted: dict[bytes, list] = {}
    for phrase, label in phrases.items():
        words = lower_terms(phrase)
        wanted.setdefault(words[-1], []).append((words, label))
    last_words = frozenset(wanted)

    def places(words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        if not last_words.isdisjoint(words):
            for end, w in enumerate(words):
                for phrase, label in wanted.get(w, ()):
                    at = end - len(phrase) + 1
                    if at >= 0 and words[at:end + 1] == phrase:
                        found.append((at, label))
        return sorted(found)

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = lower_terms(t)
            base = places(words)
            hits = []
            if not known.prefix_words.isdisjoint(words):
                lines = blocks(t, span or SPAN)
                hits = [(b, m, c) for b, block in enumerate(lines) for m, c in sorted(known.matches(block).items())]
                if span is None:
                    hits += [(len(lines) + k, m, c) for k, m, c in known.across(words)]
            own = sorted({label for _, label in base})
            every = sorted(set(own) | {known.templates[m][0] for _, m, _ in hits})
            rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, own, every,
                         1.0 if base else max((c for _, _, c in hits), default=0.0),
                         [{"block": b, "template": m, "containment": c} for b, m, c in hits]))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FOUND.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(out, search(F.col(text)))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "licences.n_words", "licences.n_base", "licences.first_word", "licences.last_word",
                        F.array_join("licences.base_labels", ",").alias("base_labels"),
                        F.array_join("licences.labels", ",").alias("labels"), "licences.score")
