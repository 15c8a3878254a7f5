"""Personal data: keyed, type-consistent surrogates, DataFrame functions only.

Detection. One expression finds e-mail addresses, IPv4 addresses, IBANs, social security numbers, card
numbers, telephone numbers and persons (a title with all capitalised names after it, initials and
particles as "van der" between them), leftmost and without overlap. Telephone numbers are international
ones (with +, grouped or not) and national ones in groups; bare digits without a + are not taken. Every match is split into parts with a kind and a canonical value: spelling variants
of one entity (capitals, separators of a number) share it, and a person's names are parts of their own,
so "Mrs Maria Lopez" and "Mrs Lopez" share the surrogate of "Lopez". Names that a document introduces
with a title are also replaced where they stand without one, in any spelling that starts with a capital
(McDonald, LOPEZ); in small letters they are often words (brown, may) and stay. Initials become other ones.

Surrogates come from sha256(key, kind, value, attempt): numbers keep their layout, country code or trunk
zeros and check digits (Luhn, ISO 7064), private network addresses their range (others become reserved
ones), e-mail addresses their shape with a domain under .example, names their capitals and their script
(Latin, Cyrillic, Greek, Han; Latin for others), given names the gender that the titles tell. There may be
several titles ("Frau Dr."). A name has one surrogate whatever title or place it has.

Collision checks. The distinct entities of all texts get their surrogates in rounds: a surrogate that
equals an entity of the corpus, one already given, or that of a smaller value of the round is rejected,
and the rejected entities try again with the next attempt (names and addresses then grow longer, and
after some rounds numbers too, so a kind with more entities than its format allows still ends). It
ends when every entity has a surrogate of its own, so distinct entities stay distinct and equal ones
equal, in all documents. Rounds are written to the shared folder.

Only texts with a match are written to the shared folder and shuffled, once, to meet their surrogates; the entity table meets the parts
by a join on (kind, value), whose entity side is unique, so a frequent entity only makes its own rows.

Null texts stay null, empty ones empty. Rows are told apart by id and a hash of the text; repeated rows
get equal results and each stays. Extra columns pass through `replaced`. The same key gives the same
surrogates for the same set of entities; the key is a secret of the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.llm.common import free_name, materialized, table, written

#: Setting that holds the key of `op9_pii_surrogates`; a session without it gets a demonstration key, which protects nothing.
KEY_SETTING = "spark.tripwire.pii.key"

# Titles that introduce a person, by gender.
TITLES_F = "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Señora Señorita Sra Srta Signora госпожа г-жа Κυρία".split()
TITLES_M = "Mr Mister Sir Lord Herr Monsieur Señor Sr Don Signor господин г-н Κύριος".split()
TITLES_U = "Dr Prof Professor Mx".split()

_TITLE = "|".join(sorted(TITLES_F + TITLES_M + TITLES_U, key=lambda t: (-len(t), t)))
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# two letters at least, inner marks (O'Brien, Anna-Lena), d'Arcy, al-Rashid; a genitive 's is not of the name
_CASED = r"(?:[dl]['’]|(?:al|el)-)?\p{Lu}(?:[\p{L}\p{M}]|(?!['’][sS](?!\p{L}))['’-](?=\p{L}))++"
# scripts without capitals: Han names of two to four characters, else a whole word
_NAME = rf"(?:{_CASED}|\p{{IsHan}}{{2,4}}+|(?![ªº\p{{IsHan}}])\p{{Lo}}[\p{{Lo}}\p{{M}}]*+)"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.){0,4}"
PARTICLES = "van von vom zu zum zur der den de del della di da do dos das du des la le el al bin ibn ben ter ten af av y".split()
_BEFORE = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=lambda t: (-len(t), t)))}|{_INITIALS}|\p{{Lu}}) ){{0,6}}"

# a domain has at most 127 labels; an open repetition would nest as deep as a text has dots
EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+){1,126}"
IP = rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9A-Za-z])"
GROUPED = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"
ABROAD = r"(?<![0-9A-Za-z])\+[1-9](?:[ ./()-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"
# with a trunk 0 (030 123456, 01 23 45 67 89), nine digits or more and no date; or as 912 34 56 78
NATIONAL = (r"(?<![0-9A-Za-z.,+-])(?!0[0-9][./-][0-9]{2}[./-][0-9]{4})(?=\(?[0-9](?:[ ./()-]{0,2}[0-9]){8,13}(?![0-9A-Za-z]))"
            r"(?:\(0[0-9]{1,5}\) ?[0-9]{2,10}|0[0-9]{1,5}[ ./-][0-9]{2,10}|[6-9][0-9]{1,2}[ .-][0-9]{2,3}[ .-][0-9]{2}(?=[ .-][0-9]{2}(?![0-9])))"
            r"(?:[ ./-][0-9]{2,8}){0,5}(?![0-9A-Za-z])")
PHONE = "|".join([GROUPED, ABROAD, NATIONAL])
# calling codes of countries: one, two or three digits
COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# the look-ahead rejects most places by one character before the titles are tried
_TITLES = rf"(?:(?:{_TITLE})\.? ){{1,4}}"
TITLED = rf"(?<![\p{{L}}0-9])(?=[{''.join(sorted({t[0] for t in TITLES_F + TITLES_M + TITLES_U}))}]){_TITLES}"
PERSON = rf"{TITLED}{_BEFORE}{_NAME}(?: {_BEFORE}{_NAME})*+"
ENTITY = "|".join([EMAIL, IP, IBAN, SSN, CARD, PHONE, PERSON])

# Common given names by script and gender, and syllables for family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Irene Julia Laura Lena Lucia Maria Nina Nora Olivia Paula Sofia Vera".split(),
    ("latin", "m"): "Adam Anton Bruno David Emil Felix Hugo Jonas Leo Lukas Martin Oscar Paul Simon Tomas Victor".split(),
    ("latin", "u"): "Alex Andrea Ariel Charlie Jamie Jules Kim Lee Luca Morgan Noa Robin Sasha Sky Toni Yael".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Иван Марк Олег Павел".split(),
    ("cyrillic", "u"): "Саша Женя Валя Слава Шура Вика Миша Юля".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιρις Κλειώ Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δήμος Ηλίας Κώστας Μάρκος Νίκος Πέτρος".split(),
    ("greek", "u"): "Αγγέλη Αριάν Δάφνι Κρις Λέων Μάξι Ορφέα Φοίβη".split(),
    ("han", "f"): "秀英 桂兰 美玲 丽华 春梅 雪芳 玉珍 婷婷".split(),
    ("han", "m"): "建国 志强 伟明 国庆 大勇 海涛 文军 立新".split(),
    ("han", "u"): "晓明 文华 春生 思远 永安 子涵 天佑 安然".split(),
}
FAMILY = {
    "latin": "ba be bo da de do fa fe fi ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to".split(),
    "cyrillic": "ба бо ва ве го да де ка ко ла ле ма ме на но ра".split(),
    "greek": "βα βο γα δα δε κα κο λα λε μα με να νο ρα ρο τα".split(),
    "han": "林 陈 周 吴 郑 孙 朱 何 高 罗 梁 宋 唐 许 邓 冯 曹 彭 曾 萧".split(),
}
ALPHABET = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

KINDS = ("email", "ip", "iban", "ssn", "card", "phone", "person")
PART = "array<struct<kind:string,value:string>>"


# ---------------------------------------------------------------- matches and their parts


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .when(word.rlike(r"\p{IsHan}"), "han").otherwise("latin"))


def kind_of(match: Column) -> Column:
    """Which of the expressions made the match; each has a shape that the others lack."""
    return (F.when(match.contains("@"), "email")
            .when(match.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
            .when(match.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), "iban")
            .when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(match.rlike("^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$"), "card")
            .when(match.rlike("^[+(0-9]"), "phone")
            .otherwise("person"))


def _names(match: Column) -> Column:
    """The words after the titles."""
    return F.split(F.regexp_replace(match, rf"^{_TITLES}", ""), " ")


def _gender(match: Column) -> Column:
    titles = F.regexp_extract(match, rf"^{_TITLES}", 0)
    female, male = (titles.rlike(rf"(?:^| )(?:{'|'.join(t)})\.? ") for t in (TITLES_F, TITLES_M))
    return F.when(female & ~male, "f").when(male & ~female, "m").otherwise("u")


def parts_of(match: Column) -> Column:
    """array<struct<kind,value>> of a match: kind in detail, canonical value."""
    kind = kind_of(match)
    # bound once per match, as its words may be many
    people = F.array(F.struct(_names(match).alias("words"), _gender(match).alias("gender")))

    def name_part(p, word, i):
        detail = F.when(i == F.size(p["words"]) - 1, F.concat(F.lit("family_"), _script(word))).otherwise(F.concat_ws("_", F.lit("given"), _script(word), p["gender"]))
        name = F.struct(detail.alias("kind"), F.lower(F.translate(word, "’", "'")).alias("value"))
        own = F.when(word.isin(*PARTICLES), "particle").when(word.rlike(rf"^(?:{_INITIALS}|\p{{Lu}})$"), "initials")
        return F.when(own.isNull(), name).otherwise(F.struct(own.alias("kind"), word.alias("value")))

    named = F.transform(people, lambda p: F.transform(p["words"], lambda word, i: name_part(p, word, i)))[0]
    number = F.regexp_replace(match, "[^0-9]", "")
    # what stays: the country after a +, else the trunk zeros
    plus = F.when(match.startswith("+"), F.regexp_extract(number, COUNTRY, 1)).otherwise(F.regexp_extract(number, "^0*", 0))
    value = (F.when(kind == "email", F.lower(match)).when(kind == "ip", match).when(kind == "iban", F.regexp_replace(match, " ", ""))
             .when(kind == "phone", F.concat_ws("|", plus, F.substring(number, F.length(plus) + 1, F.length(number)))).otherwise(number))
    one = F.array(F.struct(kind.alias("kind"), value.alias("value")))
    return F.when(kind == "person", named).otherwise(one).cast(PART)


# ---------------------------------------------------------------- surrogates of canonical values


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0, around the end again) of a hex digest as a number."""
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _digits(digest: Column) -> Column:
    """64 decimal digits from a hex digest."""
    return F.translate(digest, "abcdef", "573190")


def _shaped(value: Column, digest: Column) -> Column:
    """Every letter becomes a letter of its script, every digit a digit; the rest stays."""

    def one(c, i):
        b = _byte(digest, i)
        letter = lambda script: F.substring(F.lit(ALPHABET[script]), (F.pmod(b, F.lit(len(ALPHABET[script]))) + 1).cast("int"), F.lit(1))
        small = F.when(c.rlike(r"\p{IsCyrillic}"), letter("cyrillic")).when(c.rlike(r"\p{IsGreek}"), letter("greek")).otherwise(letter("latin"))
        return (F.when(c.rlike("[0-9]"), F.pmod(b, F.lit(10)).cast("string"))
                .when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column, first: int) -> Column:
    """Luhn sum of a digit string; `first` is 2 where the last digit counts double, else 1."""

    def add(acc, c):
        d = F.substring(digits, (F.length(digits) - c).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(F.pmod(c, F.lit(2)) == (0 if first == 2 else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(value: Column, digest: Column) -> Column:
    """Same first digit and length; the Luhn check holds exactly where it holds for the original."""
    body = F.concat(F.substring(value, 1, 1), F.substring(_digits(digest), 1, 14))
    check = F.pmod(-_luhn_sum(body, 2), F.lit(10))
    good = F.pmod(_luhn_sum(value, 1), F.lit(10)) == 0
    return F.concat(body, F.when(good, check).otherwise(F.pmod(check + 1 + _byte(digest, F.lit(20)) % 9, F.lit(10))).cast("string"))


def _iban(value: Column, digest: Column) -> Column:
    """Same country and shape with the right check digits."""
    body = _shaped(F.substring(value, F.lit(5), F.length(value)), digest)
    country = F.substring(value, 1, 2)

    def add(r, c):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.pmod(F.when(v < 10, r * 10 + v).otherwise(r * 100 + v), F.lit(97))

    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(F.concat(body, country)) + 2),
                                   lambda i: F.substring(F.concat(body, country, F.lit("00")), i, F.lit(1))), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _ip(value: Column, digest: Column) -> Column:
    """Private, loopback and link-local addresses stay in their range; others go to the reserved one, which nobody has."""
    byte = [_byte(digest, F.lit(i)) for i in range(4)]
    kept = F.when(value.rlike(r"^(?:10|127)\."), F.substring_index(value, ".", 1)).when(
        value.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.substring_index(value, ".", 2)).otherwise(
        (240 + F.pmod(byte[0], F.lit(15))).cast("string"))
    rest = F.transform(F.sequence(F.size(F.split(kept, r"\.")), F.lit(3)), lambda i: _byte(digest, i).cast("string"))
    return F.concat_ws(".", kept, F.array_join(rest, "."))


def _email(value: Column, digest: Column, attempt: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    more = F.when(attempt > 2, F.substring(_digits(digest), F.lit(1), attempt)).otherwise("")
    host = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 10)
    return F.concat(_shaped(local, digest), more, F.lit("@mail-"), host, F.lit(".example"))


def _given(words: list[str], digest: Column, attempt: Column) -> Column:
    """One name, and a further one joined by a hyphen for each attempt that failed."""
    return F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(words, _byte(digest, i))), "-")


def _family(syllables: list[str], digest: Column, attempt: Column) -> Column:
    joined = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _pick(syllables, _byte(digest, i + 8))), "")
    return F.initcap(joined)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate that the attempt gives to a canonical value, in canonical spelling."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    out = (F.when(kind == "email", _email(value, digest, attempt, key)).when(kind == "ip", _ip(value, digest))
           .when(kind == "iban", _iban(value, digest)).when(kind == "card", _card(value, digest))
           .when(kind == "phone", F.concat(F.substring_index(value, "|", 1), F.lit("|"), F.regexp_replace(
               F.substring(_digits(digest), F.lit(1), F.length(F.substring_index(value, "|", -1))), "^0", "7")))
           .when(kind == "ssn", F.substring(_digits(digest), 1, 9)))
    # a format that has no free value left grows by digits, names and addresses grow from the start
    more = F.substring(_digits(F.sha2(digest, 256)), F.lit(1), attempt - GROW + 1)
    out = F.when(kind.isin("ip", "iban", "card", "phone", "ssn") & (attempt >= GROW), F.concat(out, more)).otherwise(out)
    out = F.when(out.isNotNull(), out)
    for (script, gender), words in GIVEN.items():
        out = out.when(kind == f"given_{script}_{gender}", _given(words, digest, attempt))
    for script, syllables in FAMILY.items():
        out = out.when(kind == f"family_{script}", _family(syllables, digest, attempt))
    return out


def _pool(kind: Column) -> Column:
    """Kinds among which surrogates must differ: all names together, every other kind by itself."""
    return F.when(kind.startswith("given_") | kind.startswith("family_"), "name").otherwise(kind)


#: Rounds after which numbers get longer than their format.
GROW = 12


def _canonical(kind: Column, value: Column) -> Column:
    return F.when(_pool(kind) == "name", F.lower(value)).otherwise(value)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value); no surrogate is given twice within a pool.

    A name has one surrogate whatever stood before it and wherever it stood in a person's names: as a family name if it is
    one anywhere, else as a given name of the gender that its titles agree on.
    """
    known = materialized(entities.distinct())
    pool = _pool(F.col("kind"))
    named = known.filter(pool == "name").withColumn("word", F.split("kind", "_"))
    gender = F.collect_set(F.when((F.size("word") == 3) & (F.element_at("word", -1) != "u"), F.element_at("word", -1)))
    people = named.groupBy("value").agg(F.max((F.col("word")[0] == "family").cast("int")).alias("family"),
                                        F.min(F.col("word")[1]).alias("script"), gender.alias("genders"))
    people = people.select(F.when(F.col("family") == 1, F.concat(F.lit("family_"), "script")).otherwise(F.concat_ws(
        "_", F.lit("given"), "script", F.when(F.size("genders") == 1, F.element_at("genders", 1)).otherwise("u"))).alias("kind"), "value")
    pending = materialized(known.filter(pool != "name").unionByName(people))
    own = pending.select(pool.alias("pool"), F.col("value").alias("canonical")).distinct()
    done, attempt = None, 0
    while True:
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key))
        free = tried.withColumns({"pool": pool, "canonical": _canonical(F.col("kind"), F.col("surrogate"))})
        free = free.join(own, ["pool", "canonical"], "left_anti")
        if done is not None:
            free = free.join(done.select("pool", "canonical"), ["pool", "canonical"], "left_anti")
        won = materialized(free.groupBy("pool", "canonical").agg(F.min(F.struct("kind", "value", "surrogate")).alias("w"))
                           .select("pool", "canonical", "w.*"))
        done = won if done is None else done.unionByName(won)
        pending = materialized(pending.join(won.select("kind", "value"), ["kind", "value"], "left_anti"))
        attempt += 1
        if not pending.take(1):
            names = done.select(F.col("pool").alias("of"), "value", "surrogate")
            return known.withColumn("of", pool).join(names, ["of", "value"]).select("kind", "value", "surrogate")


# ---------------------------------------------------------------- rewriting texts


def _spelled(match: Column, given: Column) -> Column:
    """The match with its parts' surrogates in the spelling of the original."""
    kind = kind_of(match)
    flat = F.regexp_replace(given[0], "[|]", "")

    def place(acc, c):  # the next digit or letter of the surrogate goes where the original has one
        fits = c.rlike("[0-9A-Z]")
        return F.struct((acc["at"] + F.when(fits, 1).otherwise(0)).alias("at"),
                        F.concat(acc["out"], F.when(fits, F.substring(flat, acc["at"], F.lit(1))).otherwise(c)).alias("out"))

    laid = F.aggregate(F.split(match, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), place,
                       lambda a: F.concat(a["out"], F.substring(flat, a["at"], F.length(flat))))  # what outgrew the format
    loud = lambda old, new: F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(new)
    title = F.regexp_extract(match, rf"^{_TITLES}", 0)
    person = F.concat(title, F.array_join(F.zip_with(_names(match), given, loud), " "))
    return F.when(kind == "person", person).when(kind == "email", loud(match, given[0])).when(kind == "ip", given[0]).otherwise(laid)


def matches(text: Column) -> Column:
    """All entity matches of a text; the cheap test first, because most texts have none."""
    some = text.rlike("[0-9@]") | text.rlike(rf"{TITLED}{_BEFORE}(?:{_NAME})")
    return F.when(some, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replaced(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id", out: str = "entities") -> DataFrame:
    """docs with surrogates in `text`, and `out`: array<string> of the kinds replaced, in text order."""
    hash_, found, parts, id2, hash2 = (free_name(docs, n) for n in ("text_hash", "found", "parts", "parts_id", "parts_hash"))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn(found, matches(body))
    plain = marked.filter(F.size(found) == 0).withColumn(out, F.array().cast("array<string>")).drop(found)
    # texts with a match are written once: their parts and the rewriting read them from there
    marked = written(marked.filter(F.size(found) > 0).withColumn(hash_, F.xxhash64(text)), "pii")

    each = (marked.select(F.col(doc_id).alias("id"), F.col(hash_).alias("h"), F.posexplode(found).alias("i", "m"))
            .select("id", "h", "i", F.posexplode(parts_of(F.col("m"))).alias("j", "p")).select("id", "h", "i", "j", "p.*"))
    each = materialized(each.distinct())
    # particles stay as they are, initials tell nobody apart: neither is an entity
    between = F.col("kind").isin("particle", "initials")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    initials = _shaped(F.col("value"), F.sha2(F.concat_ws("|", F.lit(key), "kind", "value"), 256))
    initials = F.when(initials == F.col("value"), F.translate("value", capitals, capitals[1:] + "A")).otherwise(initials)
    others = each.filter(between).withColumn("surrogate", F.when(F.col("kind") == "particle", F.col("value")).otherwise(initials))
    each = each.filter(~between)
    names = assigned(each.select("kind", "value"), key)
    per_text = (each.join(names, ["kind", "value"]).unionByName(others).groupBy("id", "h")
                .agg(F.array_sort(F.collect_list(F.struct("i", "j", "surrogate", "kind", "value"))).alias(parts)))
    per_text = per_text.withColumnsRenamed({"id": id2, "h": hash2})
    joined = marked.join(per_text, (F.col(hash_) == F.col(hash2)) & F.col(doc_id).eqNullSafe(F.col(id2))).drop(id2, hash2)

    # names that the text introduces with a title are replaced between the matches too, as whole words
    people = F.array_distinct(F.transform(F.filter(F.col(parts), lambda p: _pool(p["kind"]) == "name"),
                                          lambda p: F.struct(p["value"].alias("old"), p["surrogate"].alias("new"))))
    who, fresh = free_name(joined, "people"), free_name(joined, "fresh_text")
    joined = joined.withColumn(who, people)

    def told_apart(gap):
        # a name has letters, hyphens and apostrophes only, so it is its own expression; Han is written without word ends
        word = lambda old: F.when(old.rlike(r"^\p{IsHan}+$"), old).otherwise(F.concat(
            F.lit(r"(?<![\p{L}\p{M}0-9-])"), F.regexp_replace(old, "'", "['’]"), F.lit(r"(?![\p{L}\p{M}0-9-])")))
        loud = lambda t, p: F.regexp_replace(t, word(F.upper(p["old"])), F.upper(p["new"]))
        start = F.lit(r"(?iu)(?=(?-i:(?:[dl]['’]|(?:al|el)-)?[\p{Lu}\p{Lo}]))")
        return F.aggregate(who, gap, lambda t, p: F.regexp_replace(loud(t, p), F.concat(start, word(p["old"])), p["new"]))

    def spelled(m, i):
        return _spelled(m, F.transform(F.filter(F.col(parts), lambda p: p["i"] == i), lambda p: p["surrogate"]))

    gaps = F.transform(F.split(F.col(text), ENTITY, -1), told_apart)
    made = F.transform(F.col(found), spelled)
    rewritten = joined.withColumn(fresh, F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), made, lambda g, m: F.concat(g, m)), ""), F.element_at(gaps, -1)))
    rewritten = rewritten.withColumn(out, F.transform(found, kind_of))
    columns = [F.col(fresh).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return rewritten.select(*columns, out).unionByName(plain)


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, "demonstration only")
    found = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *[_count(k) for k in KINDS])


def _count(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e == kind)).cast("long").alias(f"n_{kind}")
