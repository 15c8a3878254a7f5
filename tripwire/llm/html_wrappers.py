"""Main text of web pages by wrappers inferred per host: union-free regular expressions over tokens.

Token stream. A page is cut into start tags, end tags and text; formatting tags (bold, links, spans)
belong to their text, scripts, styles and comments vanish, and missing end tags are supplied, so that
every start tag has its end. A tag's token is its name with its classes and id (digits normalised).

Wrapper. A wrapper is a union-free regular expression over tokens: tags, constant texts, text slots,
repeated groups (+) and optional parts (?). One page is the first wrapper of its host; all further
pages are aligned with it, one after the other:

* inside an element, neighbouring groups of tokens that repeat are folded into one repeated group;
* equal tokens are matched in order; a text that differs becomes a slot;
* a part that only one side has becomes optional; a part that only one side repeats becomes repeated;
* an element in which parts keep changing their order becomes a repeated group of optional parts,
  which bounds a wrapper by the number of distinct tags of the site.

All pages of all hosts take part: every task folds its pages into one partial wrapper per host, the
partial wrappers of a host are aligned with each other in a tree that joins about 64 at a time, so
a host with a third of all pages is never one group of pages nor of partial wrappers.

Extraction. Each slot of a host's wrapper is judged once, from its path and its share of the host's
text: slots in menus, headers, footers, sidebars, notices, adverts, forms and comments are left out;
where the wrapper has an article (else a main part, else a content container), only slots inside it
are kept; without any of these, pure links and texts that half of the pages share are left out too. A page's blocks are
then looked up by their path; a block whose path the wrapper does not have is judged by the same rules.

Constants inside the region. The texts that fill a kept slot are counted over all pages of the host: one that stands in the
same slot in at least `SHARE` of the host's different articles is part of the template (a subscribe line, a notice) and left
out. Articles are different if their longest blocks differ, so copies of an article count once and don't make its text a
template; hosts with fewer than `ARTICLES` different articles have no such constants.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one space in page order; a page of a kind that lacks the host's region is judged by its own. Null and empty pages have the empty text; pages without a url form one host.
Repeated pages are extracted alike; extra columns pass through `main_text`. The judged slots reach the
tasks as a broadcast where they are small (measured, at most `broadcast_bytes`), else by a join.
"""

from __future__ import annotations

import html as html_text
import json
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tripwire.llm.common import free_name, raw, table, written

# HTML's element groups.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title"
CLOSES = {  # a start tag ends these open elements, up to the given container
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))

# Parts of a page that are not its article, by tag, by role, and by word in class or id.
OTHER_TAGS = frozenset("nav header footer aside form head button select menu dialog object".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar aside rail footer header masthead topbar toolbar cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond responses "
    "widget widgets pagination pager search form copyright skip".split())
LAYOUT_WORDS = frozenset("has with without no".split())  # "with-sidebar" names a layout, not a sidebar
CONTENT_WORDS = frozenset("article content main post entry story prose".split())
EVEN_ARTICLES = frozenset("related comment comments ad promo sponsored".split())  # an <article> of these is not the article

TOKEN = re.compile(  # an <svg .../> ends at its own tag; <svg-icon> and <title-bar> are elements like others
    r"<!--(?:.*?-->|.*)|<svg(?=[\s/])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    rf"|<({RAW})(?=[\s/>]|\Z)(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

TEXT, LINK = "T", "L"  # keys of text nodes: plain text, text that is all inside links
JUDGED_WORDS = OTHER_WORDS | LAYOUT_WORDS | CONTENT_WORDS
MANY, KEYS = 24, 64  # longest sequence inside an element, most distinct tokens before they are shortened to what is judged
ARTICLES, SHARE = 20, 0.9  # different articles a host needs to have constants inside them, and the share that has one
FAN_IN = 64  # partial wrappers merged at a time
DEEP = 100  # elements nested deeper belong to the one at this depth


# ---------------------------------------------------------------- tokens and trees

# A node is a list [type, key, ...]:
#   ["e", key, children]      a start tag, what stands inside, its end tag
#   ["t", key, text, chars]   a text: constant (text) or a slot (None); characters seen there so far
#   ["+", [nodes]]            one or more times the sequence
#   ["?", node]               once or not at all


def tag_key(name: str, attributes: str) -> str:
    """Token of a start tag: name, marks of role and of hidden parts, words of class and id.

    Of the words, the first eight are enough to align pages by; all that `judge` looks at stay.
    """
    if not attributes or attributes.isspace():
        return name
    marks, words = [], []
    for m in ATTRIBUTE.finditer(attributes):
        what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if what == "role":
            marks.append("@" + value.strip().lower())
        elif what == "itemprop" and value.lower() == "articlebody":
            marks.append("@main")
        elif what == "hidden" or (what == "aria-hidden" and value == "true") or (what == "style" and re.search(r"display\s*:\s*none", value)):
            marks.append("@hidden")
        elif what in ("class", "id"):
            words += re.sub(r"\d+", "0", value).split()
    words = sorted(set(words))
    words = words[:8] + [w for w in words[8:] if _words(w) & JUDGED_WORDS]
    return " ".join([name, *sorted(set(marks)), *["." + w for w in words]])


def _words(name: str) -> set:
    return {w.lower() for w in WORD.findall(name)}


def brief(key: str) -> str:
    """A token without all that `judge` does not look at: equal for all names of a kind of part."""
    name, roles, words = _marks(key)
    roles = {"hidden" if r == "hidden" or r in OTHER_ROLES else r for r in roles} & {"hidden", "article", "main"}
    seen = ({"content"} if words & CONTENT_WORDS else set()) | ({"header"} if words & {"header", "masthead"} else set())
    seen |= ({"ad"} if words & EVEN_ARTICLES else {"nav"} if words & OTHER_WORDS else set()) | ({"with"} if words & LAYOUT_WORDS else set())
    return " ".join([name, *sorted("@" + r for r in roles), *sorted("." + w for w in seen)])


def parse(page) -> list:
    """The children of the root of a page's tree."""
    root: list = ["e", "", []]
    stack, text, linked, links = [(root, "")], [], 0, 0
    beyond: list[str] = []  # open elements below DEEP
    at, page = 0, page if isinstance(page, str) else ""

    def flush():
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                all_linked = linked >= sum(len("".join(x.split())) for x in text)
                stack[-1][0][2].append(["t", LINK if all_linked else TEXT, words, len(words)])
            text.clear()
        linked = 0

    def plain(piece: str):
        nonlocal linked
        if piece:
            piece = html_text.unescape(piece)
            text.append(piece)
            if links:
                linked += len("".join(piece.split()))

    for m in TOKEN.finditer(page):
        plain(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue  # comment, declaration or raw element
        name = m[3].lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[2] else 1))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        flush()
        links = 0
        if m[2]:
            if name in beyond:
                while beyond.pop() != name:
                    pass
            elif any(n == name for _, n in stack):
                beyond.clear()
                while stack[-1][1] != name:
                    stack.pop()
                stack.pop()
            continue
        if stack[-1][1] == "p":  # any block starts: an open paragraph ends
            stack.pop()
        ends, within = CLOSES.get(name, ((), ()))
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][1] in within:
                break
            if stack[depth][1] in ends:
                del stack[depth:]
        if len(stack) > DEEP:
            beyond.append(name)
            continue
        node = ["e", tag_key(name, m[4]), []]
        stack[-1][0][2].append(node)
        stack.append((node, name))
    plain(page[at:])
    flush()
    return root[2]


# ---------------------------------------------------------------- folding and aligning


def key_of(node) -> str:
    """What a node is matched by; an optional or repeated single node by what it holds."""
    if node[0] == "?":
        return key_of(node[1])
    if node[0] == "+":
        return key_of(node[1][0]) if len(node[1]) == 1 else "+" + "\0".join(map(key_of, node[1]))
    return node[1]


def _open(node) -> tuple[list, bool, bool]:
    """(sequence inside, repeated, optional) of a node."""
    optional = node[0] == "?"
    node = node[1] if optional else node
    return (node[1], True, optional) if node[0] == "+" else ([node], False, optional)


def _wrap(nodes: list, repeated: bool, optional: bool):
    node = ["+", nodes] if repeated else nodes[0]
    return ["?", node] if optional else node


def unify(a, b, again: bool = False):
    """One node for two of equal key; `again`: they stand side by side, so together they repeat."""
    (x, many_a, maybe_a), (y, many_b, maybe_b) = _open(a), _open(b)
    many, maybe = many_a or many_b or again, (maybe_a and maybe_b) if again else (maybe_a or maybe_b)
    if len(x) == len(y) == 1:
        x, y = x[0], y[0]
        if x[0] == "?" or x[0] == "+" or y[0] == "?" or y[0] == "+":
            return _wrap([unify(x, y)], many, maybe)
        if x[0] == "t":
            return _wrap([["t", x[1], x[2] if x[2] == y[2] else None, x[3] + y[3]]], many, maybe)
        return _wrap([["e", x[1], align(x[2], y[2])]], many, maybe)
    return _wrap(align(x, y), many, maybe)


def fold(nodes: list) -> list:
    """Repeated neighbouring groups of a sequence as one repeated group, inner ones first."""
    nodes = [["e", n[1], fold(n[2])] if n[0] == "e" else n for n in nodes]
    while len(nodes) > 1:
        names: dict[str, str] = {}
        coded = "".join(names.setdefault(key_of(n), chr(0xE000 + len(names) % 0x1900)) for n in nodes)
        out, at = [], 0
        for m in re.finditer(r"(.{1,6}?)\1+", coded, re.S):
            size, group = len(m[1]), nodes[m.start():m.end()]
            first = group[:size]
            if len(names) > 0x1900 and [key_of(n) for n in group] != [key_of(n) for n in first] * (len(group) // size):
                continue  # two tokens share a code
            for i in range(size, len(group), size):
                first = [unify(p, q, again=size == 1) for p, q in zip(first, group[i:i + size])]
            out += nodes[at:m.start()] + [first[0] if size == 1 else ["+", first]]
            at = m.end()
        if not at:
            break
        nodes = out + nodes[at:]
    return _bounded(nodes) if len(nodes) > 4 * MANY else nodes


def _regroup(nodes: list, groups: dict) -> list:
    """Single passes of a repeated group that the other side has, as that group."""
    out, i = [], 0
    while i < len(nodes):
        for keys in groups:
            if [key_of(n) for n in nodes[i:i + len(keys)]] == list(keys):
                out.append(["+", nodes[i:i + len(keys)]])
                i += len(keys)
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def align(a: list, b: list) -> list:
    """The sequence that covers both: matches unified, the rest optional, changing orders repeated."""
    ka, kb = list(map(key_of, a)), list(map(key_of, b))
    if ka != kb:
        groups = {tuple(map(key_of, n[1])) for s in (a, b) for n in (x[1] if x[0] == "?" else x for x in s) if n[0] == "+" and len(n[1]) > 1}
        if groups:
            a, b = _regroup(a, groups), _regroup(b, groups)
            ka, kb = list(map(key_of, a)), list(map(key_of, b))
    if ka == kb:
        return [unify(p, q) for p, q in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    maybe = lambda n: n if n[0] == "?" else ["?", n]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            node, i, j = unify(a[i], b[j]), i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            node, i = maybe(a[i]), i + 1
        else:
            node, j = maybe(b[j]), j + 1
        if out and key_of(out[-1]) == key_of(node):
            node = unify(out.pop(), node, again=True)
        out.append(node)
    return _bounded(out) if len(out) > MANY else out


def _bounded(nodes: list) -> list:
    """A long sequence as one repeated group of optional parts, each kind of part once."""
    parts: dict[str, list] = {}

    def add(node):
        inner, _, _ = _open(node)
        for n in inner:
            if n[0] in "?+":
                add(n)
            else:
                parts[n[1]] = unify(parts[n[1]], n) if n[1] in parts else n

    for n in nodes:
        add(n)
    if len(parts) > KEYS:
        short: dict[str, list] = {}
        for n in parts.values():
            if n[0] == "e":
                n = ["e", brief(n[1]), n[2]]
            short[n[1]] = unify(short[n[1]], n) if n[1] in short else n
        parts = short
    return [["+", [["?", parts[k]] for k in sorted(parts)]]]


def wrapper_of(page) -> list:
    return fold(parse(page))


def expression(nodes: list) -> str:
    """A wrapper in regular-expression notation, slots as #text."""
    out = []
    for n in nodes:
        if n[0] == "t":
            out.append("#text" if n[2] is None else n[2])
        elif n[0] == "e":
            out.append(f"<{n[1]}>{expression(n[2])}</{n[1].split(' ')[0]}>")
        elif n[0] == "+":
            out.append(f"({expression(n[1])})+")
        else:
            out.append(f"({expression([n[1]])})?")
    return "".join(out)


def accepts(wrapper: list, nodes: list) -> bool:
    """Whether the wrapper generates the tree (tokens and slots; constants must be equal)."""

    def ends(pattern: list, seq: list, at: frozenset) -> frozenset:
        for p in pattern:
            if not at:
                break
            at = one(p, seq, at)
        return at

    def one(p, seq, at: frozenset) -> frozenset:
        if p[0] == "?":
            return at | one(p[1], seq, at)
        if p[0] == "+":
            seen, new = frozenset(), at
            while new:
                new = ends(p[1], seq, new) - seen
                seen |= new
            return seen
        return frozenset(i + 1 for i in at if i < len(seq) and fits(p, seq[i]))

    def fits(p, n) -> bool:
        if p[0] != n[0] or p[1] != n[1] and (n[0] == "t" or p[1] != brief(n[1])):
            return False
        if p[0] == "t":
            return p[2] is None or p[2] == n[2]
        return len(n[2]) in ends(p[2], n[2], frozenset([0]))

    return len(nodes) in ends(wrapper, nodes, frozenset([0]))


# ---------------------------------------------------------------- judging slots


def _marks(key: str) -> tuple[str, set, set]:
    name, *rest = key.split(" ")
    words = set().union(*(_words(x) for x in rest if x[0] == "."))
    return name, {x[1:] for x in rest if x[0] == "@"}, words


def judge(path: tuple) -> tuple[bool, str]:
    """(outside the article by its own path, region: article, main, content or none)."""
    region, rank = "", {"": 0, "content": 1, "main": 2, "article": 3}
    other = False
    for key in path:
        name, roles, words = _marks(key)
        if name in ("html", "body", ""):
            continue
        here = ("article" if name == "article" or "article" in roles else
                "main" if name == "main" or "main" in roles else "content" if words & CONTENT_WORDS else "")
        if "hidden" in roles or roles & OTHER_ROLES or name in OTHER_TAGS - {"header"}:
            other = True
        elif name == "header" or words & {"header", "masthead"}:
            other |= not (region in ("article", "main") and any(_marks(k)[0] in HEADINGS for k in path))
        elif words & OTHER_WORDS and not words & LAYOUT_WORDS and not (name in ("article", "main") and not words & EVEN_ARTICLES):
            other = True
        if rank[here] > rank[region]:
            region = here
    return other, region


def slots_of(wrapper: list) -> list[tuple[tuple, str, str | None, int]]:
    """(path, text key, constant or None, characters) of every text of a wrapper."""
    found = []

    def walk(nodes, path):
        for n in nodes:
            if n[0] == "t":
                found.append((path, n[1], n[2], n[3]))
            elif n[0] == "e":
                walk(n[2], (*path, n[1]))
            else:
                walk(n[1] if n[0] == "+" else [n[1]], path)

    walk(wrapper, ())
    return found


def judged(wrapper: list, pages: int) -> dict:
    """{"region": the region to keep, "slots": {path: keep}, "fixed": constants to leave out}."""
    slots = slots_of(wrapper)
    chars: dict[str, int] = {}
    for path, _, _, n in slots:
        other, region = judge(path)
        if not other:
            chars[region] = chars.get(region, 0) + n
    best = next((r for r in ("article", "main", "content") if chars.get(r)), "")
    keep: dict[str, bool] = {}
    for path, key, text, _ in slots:
        name = "/".join(path) + "|" + key
        keep[name] = keep.get(name, False) or kept(path, key, best)
    # a constant that at least half of the pages have (characters / length: how often it was seen)
    fixed = sorted({t for _, _, t, n in slots if t is not None and 2 * n >= pages * len(t)}) if not best and pages > 2 else []
    return {"region": best, "slots": keep, "fixed": fixed, "pages": pages}


def kept(path: tuple, key: str, best: str) -> bool:
    other, region = judge(path)
    return not other and (region == best if best else key == TEXT)


def article(page, table: dict) -> list[tuple[str | None, str]]:
    """(slot, text) of the page's blocks in kept slots.

    A page without the region that its host's wrapper has (another kind of page of the same host) is
    judged by the best region that it has itself; its blocks have no slot.
    """
    slots, best, fixed = table["slots"], table["region"], set(table["fixed"])
    regions = table.setdefault("regions", {})  # by path, filled while pages are read
    blocks, elements = [], set()

    def walk(nodes, path):
        for n in nodes:
            if n[0] == "e":
                below = (*path, n[1])
                elements.add(below)
                walk(n[2], below)
            else:
                blocks.append((path, n[1], n[2]))

    walk(parse(page), ())
    for p in elements:
        if p not in regions:
            regions[p] = judge(p)[1]
    if best and all(regions[p] != best for p in elements):
        own = {judge(path)[1] for path, _, _ in blocks if not judge(path)[0]}
        best = next((r for r in ("article", "main", "content") if r in own), "")
        return [(None, t) for path, key, t in blocks if kept(path, key, best)]
    out = []
    for path, key, text in blocks:
        name = "/".join(path) + "|" + key
        if name not in slots:
            slots[name] = kept(path, key, best)
        if slots[name] and text not in fixed:
            out.append((name, text))
    return out


def code(slot: str, text: str) -> int:
    """What a text in a slot is counted by (a signed 64-bit number)."""
    return xxhash.xxh64_intdigest(raw(slot + "\0" + text)) - (1 << 63)


def extract(page, table: dict) -> str:
    """The article's blocks without the constants of its host, joined by one space."""
    constants = table.get("constants")
    return " ".join(t for slot, t in article(page, table) if not constants or slot is None or code(slot, t) not in constants)


def fillings(page, table: dict) -> list[int]:
    """The code of the article (of its longest block), then the codes of the texts in its slots; none on a small host."""
    if not table["region"] or table["pages"] < ARTICLES:
        return []
    found = [(slot, t) for slot, t in article(page, table) if slot is not None]
    if not found:
        return []
    longest = max((t for _, t in found), key=lambda t: (len(t), t))
    return [code("", longest), *{code(slot, t) for slot, t in found}]


# ---------------------------------------------------------------- Spark


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def partial_wrappers(pages: DataFrame, html: str = "html", most: int = 2000) -> DataFrame:
    """(host, pages, wrapper as JSON): one per host and task; a task keeps at most `most` hosts open."""

    def build(batches):
        held: dict[str, list] = {}
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf[html]):
                new = wrapper_of(page)
                if host in held:
                    held[host] = [held[host][0] + 1, align(held[host][1], new)]
                else:
                    if len(held) >= most:
                        yield _rows(held)
                        held = {}
                    held[host] = [1, new]
        if held:
            yield _rows(held)

    return pages.select("host", html).mapInPandas(build, "host string, pages long, wrapper string")


def _rows(held: dict) -> pd.DataFrame:
    return pd.DataFrame({"host": list(held), "pages": [v[0] for v in held.values()], "wrapper": [json.dumps(v[1]) for v in held.values()]})


def _merged(pdf: pd.DataFrame) -> tuple[int, list]:
    whole = None
    for w in sorted(pdf["wrapper"]):
        new = json.loads(w)
        whole = new if whole is None else align(whole, new)
    return int(pdf["pages"].sum()), whole or []


def wrappers(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, pages, wrapper): all pages of a host aligned; `pages` needs a column host."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, whole = _merged(pdf)
        return pd.DataFrame({"host": [str(pdf["host"].iloc[0])], "pages": [n], "wrapper": [json.dumps(whole)]})

    found = written(partial_wrappers(pages, html), "wrappers")
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    groups = FAN_IN
    while groups * FAN_IN < most:
        groups *= FAN_IN
    while groups >= 1:
        part = F.pmod(F.xxhash64("wrapper"), F.lit(groups))
        found = found.withColumn("part", part).groupBy("host", "part").applyInPandas(merge, "host string, pages long, wrapper string")
        groups //= FAN_IN
    return found


def slot_tables(found: DataFrame) -> DataFrame:
    """(host, slots): the judged slots of each host's wrapper as JSON."""

    @F.pandas_udf("string")
    def judge_all(wrapper: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(judged(json.loads(w), n)) for w, n in zip(wrapper, pages)])

    return found.select("host", judge_all("wrapper", "pages").alias("slots"))


def _by_host(pages: DataFrame, tables: DataFrame, host: str, html: str, out: str, function, kind: str, broadcast_bytes: int) -> DataFrame:
    """pages plus `out`: function(page, judged slots of its host). The function is called once a page: as it counts as
    non-deterministic, no filter on its result is evaluated below it a second time."""
    slots = free_name(pages, "slots_of_host")
    empty = {"region": "", "slots": {}, "fixed": [], "pages": 0}

    def loaded(text: str) -> dict:
        found = json.loads(text)
        return dict(found, constants=frozenset(found.get("constants", ())))

    if (tables.agg(F.sum(F.length("slots") + F.length("host"))).first()[0] or 0) <= broadcast_bytes:
        every = pages.sparkSession.sparkContext.broadcast({r.host: r.slots for r in tables.collect()})

        @F.pandas_udf(kind)
        def by_host(texts: pd.Series, hosts: pd.Series) -> pd.Series:
            read: dict[str, dict] = {}
            found = []
            for t, h in zip(texts, hosts):
                if h not in read:
                    read[h] = loaded(every.value[h]) if h in every.value else dict(empty, slots={})
                found.append(function(t, read[h]))
            return pd.Series(found, dtype=object)

        return pages.withColumn(out, by_host.asNondeterministic()(F.col(html), F.col(host)))

    @F.pandas_udf(kind)
    def by_slots(texts: pd.Series, given: pd.Series) -> pd.Series:
        read: dict[str, dict] = {}
        found = []
        for t, s in zip(texts, given):
            if s not in read:
                if len(read) > 500:
                    read.clear()
                read[s] = loaded(s)
            found.append(function(t, read[s]))
        return pd.Series(found, dtype=object)

    joined = pages.join(tables.select(F.col("host").alias(host), F.col("slots").alias(slots)), host)
    return joined.withColumn(out, by_slots.asNondeterministic()(F.col(html), F.col(slots))).select(*[F.col(f"`{c}`") for c in pages.columns if c != out], out)


def constants(pages: DataFrame, tables: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(host, constants): codes of the texts that at least SHARE of a host's different articles have in one slot.

    `pages` has the columns host and html. A host has at most as many constants as an article has blocks, over SHARE.
    """
    filled = _by_host(pages, tables, "host", "html", "codes", fillings, "array<bigint>", broadcast_bytes)
    seen = filled.select("host", F.get("codes", F.lit(0)).alias("article"), F.explode("codes").alias("text"))
    seen = written(seen.distinct(), "fillings")
    articles = seen.filter(F.col("text") == F.col("article")).groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    texts = seen.filter(F.col("text") != F.col("article")).groupBy("host", "text").agg(F.count(F.lit(1)).alias("n"))
    often = texts.filter(F.col("n") >= ARTICLES * SHARE).join(articles.filter(F.col("articles") >= ARTICLES), "host")
    return often.filter(F.col("n") >= SHARE * F.col("articles")).groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants"))


def with_constants(tables: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slots) with the constants of the host among its judged slots."""

    @F.pandas_udf("string")
    def add(slots: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([s if c is None else json.dumps(dict(json.loads(s), constants=[int(x) for x in c])) for s, c in zip(slots, codes)])

    return tables.join(found, "host", "left").select("host", add("slots", "constants").alias("slots"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "main_text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pages plus `out`: the text of the article."""
    host = free_name(pages, "host_of_page")
    keyed = pages.withColumn(host, host_of(url))
    known = keyed.select(F.col(host).alias("host"), F.col(html).alias("html"))
    tables = written(slot_tables(wrappers(known)), "slots")
    tables = written(with_constants(tables, constants(known, tables, broadcast_bytes)), "slots")
    return _by_host(keyed, tables, host, html, out, extract, "string", broadcast_bytes).drop(host)


def op3_html_wrappers(spark, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
