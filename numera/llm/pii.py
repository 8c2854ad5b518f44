"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

A text is cut at its entities; each entity gets a surrogate that a keyed hash
of its type and normalised value decides, so that mentions of one entity agree
in all documents. Where a person is named in full, later mentions of a part of
that name in the same text, also in capitals, are mentions of the person too.

Surrogates keep type and format: digits for digits, letters for letters with
their case, grouping and punctuation; card numbers keep their first digit and a
valid check digit, addresses stay addresses, mail goes to a reserved domain,
secrets keep their alphabet, names their gender, script and case, dates of
birth the distances between them. Distinct entities whose surrogates meet, or
whose surrogate is another entity of the corpus, are drawn again with the next
attempt number, the others of the corpus being left as they are.

No pattern looks further than it can match, so a text takes time in proportion
to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.llm.common import checkpoint, row_keys

#: Draws after which an entity that still clashes is an error: its format has hardly a free value.
ATTEMPTS = 64
#: The key that a caller replaces by a secret.
KEY = "numera"

# Titles and frequent given names by gender.
TITLES = {"m": "Mr Herr Monsieur Señor Signor господин", "f": "Mrs Ms Miss Frau Madame Mme Señora Señorita Signora госпожа", "n": "Dr Prof"}
GIVEN = {
    "m": "Adam Ahmed Alejandro Ali Andrew Anthony Antonio Arjun Benjamin Brian Carlos Charles Chen Christian Christopher Daniel David Diego Edward Emmanuel"
    " Eric Fernando Francisco Frank George Giovanni Hans Hassan Hiroshi Ibrahim Ivan Jack Jacob Jacques James Jan Jason Jean Jeffrey John Jonathan José Joseph"
    " Joshua Juan Jürgen Karl Kenji Kenneth Kevin Klaus Lars Luca Luis Marco Mark Matthew Michael Mohammed Nicholas Omar Oliver Pablo Patrick Paul Pedro Peter"
    " Pierre Raj Rahul Ricardo Richard Robert Ronald Ryan Samuel Scott Stefan Stephen Steven Sven Thomas Timothy Wei William Алексей Дмитрий Иван Сергей",
    "f": "Aisha Alexandra Alice Amanda Amy Ana Angela Anna Anne Barbara Camille Carmen Carol Catherine Charlotte Christine Claire Deborah Diana Donna Dorothy Elena"
    " Elizabeth Emily Emma Fatima Francesca Giulia Grace Hannah Heather Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Kathleen Laura Lena Linda Lisa Lucía"
    " Margaret Maria Marie Mary Megan Mei Michelle Monika Nancy Natalia Nicole Nina Olga Olivia Pamela Patricia Priya Rachel Rebecca Rosa Ruth Sabine Samantha"
    " Sandra Sara Sarah Sharon Sofia Sophia Sophie Stephanie Susan Svetlana Teresa Ursula Victoria Yuki Zoe Анна Елена Мария Ольга",
}
# What announces a name of two or three capitalised words, a date of birth, or a secret.
_CUE = r"(?:[Mm]y name is|I am called|[Nn]ame:|[Cc]ontact:|[Ss]igned by|[Rr]egards,|[Ss]incerely,|[Dd]ear|[Ff]rom:|[Tt]o:|[Aa]uthor:|[Ww]ritten by|[Pp]atient:|[Cc]ustomer:|[Ee]mployee:|[Jj]e m'appelle|[Ii]ch heiße|[Mm]e llamo)"
_NO_NAME = r"(?!(?:Sir|Madam|All|Team|Customers?|Friends?|Colleagues?|Reader|Readers|Users?)(?![\p{L}]))"
_BORN = r"(?:[Bb]orn(?: on)?|DOB|[Dd]ate of [Bb]irth|[Bb]irthday|[Gg]eboren(?: am)?|[Gg]eb\.|[Nn]ée?(?: le)?|[Nn]acid[oa](?: el)?)\s{0,3}:?\s{0,3}"
# Kinds of streets, before or behind their names.
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Place|Way|Highway)(?![\p{L}\p{N}])\.?"
_STRASSE = r"(?:straße|strasse|str\.|weg|platz|allee|gasse)"
_RUE = r"(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:(?:de|du|des|la|le)\s){0,2}"
# Sounds that made-up names are built of, by script.
SOUNDS = {"latin": ("bdfghjklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстфч", "аеиоу"), "greek": ("βγδζθκλμνπρστφχ", "αειου")}

_CAPITAL = r"\p{Lu}[\p{L}'’-]{1,40}"
_TITLE = "(?:" + "|".join(t for own in TITLES.values() for t in own.split()) + r")\.?"
_NAME = "(?:" + "|".join(n for own in GIVEN.values() for n in own.split()) + ")"
_START = r"(?<![\p{L}\p{N}])"
#: What announces a secret; the mention takes it in and gives it back unchanged.
_SECRET_LABEL = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|(?:[Aa]pi|API|[Aa]ccess|ACCESS)[_-]?(?:[Kk]ey|KEY))[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Entity types in the order in which they are tried, and their patterns.
PATTERNS = {
    "secret": rf"{_SECRET_LABEL}[A-Za-z0-9_+/=.~-]{{8,}}|{_START}(?:[0-9a-f]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}})(?![\p{{L}}\p{{N}}])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"{_START}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": rf"{_START}\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}(?!\d)"
    rf"|{_START}\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\d)|(?<![\d-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "birthdate": rf"{_START}{_BORN}(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|\d{{4}}-\d{{2}}-\d{{2}})(?!\d)",
    "address": rf"{_START}\d{{1,5}}[A-Za-z]?\s(?:\p{{Lu}}[\p{{L}}'’]{{0,40}}\s){{1,3}}{_STREET}|{_START}\d{{1,4}},?\s{_RUE}{_CAPITAL}|{_START}\p{{Lu}}\p{{L}}{{1,40}}{_STRASSE}\s\d{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])",
    "name": rf"{_START}(?:(?=[\p{{Lu}}г])(?:{_TITLE}\s{_CAPITAL}(?:\s{_CAPITAL})?|{_NAME}\s(?:\p{{Lu}}\.\s)?{_CAPITAL})|{_CUE}\s{{1,2}}{_NO_NAME}{_CAPITAL}(?:\s{_CAPITAL}){{1,2}})",
}
#: The same for a string that is an entity and nothing else: without what they look at around it.
_WHOLE = {kind: re.sub(r"\(\?<?!(?:\[(?:\\.|[^\]])*\]|\\.|[^()\[\]])*\)", "", pattern.replace(_NO_NAME, "")) for kind, pattern in PATTERNS.items()}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Words that labels of secrets contain, in lower case.
_LABEL_WORDS = ("token", "secret", "passw", "key")
_NAME_HINT = rf"{_START}(?:(?=[\p{{Lu}}г])(?:{_TITLE}|{_NAME})|{_CUE})\s"
#: Types whose surrogates are not compared: those of dates are distinct by themselves, initials are parts of names.
_APART = ("birthdate", "initial")


def _hinted(text: Column) -> Column:
    """Cheap tests of which every text with an entity passes one: a digit or @, a label, a title or name."""
    label = reduce(Column.__or__, (F.lower(text).contains(w) for w in _LABEL_WORDS)) & text.rlike("[=:]")
    return text.rlike("[0-9@]") | label | text.rlike(_NAME_HINT)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _kind(value: Column) -> Column:
    """The type of a mention: the first whose pattern it is."""
    kind = F.lit("secret")
    for name, pattern in reversed(_WHOLE.items()):
        kind = F.when(value.rlike(rf"\A(?:{pattern})\z"), name).otherwise(kind)
    return kind


def entities(text: Column) -> Column:
    """The entities of a text in order, as strings, without bare mentions of persons."""
    return F.when(_hinted(text), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _persons(found: Column) -> Column:
    """Map from the words, in lower case, of the names among a text's entities to their kinds."""
    words = F.flatten(F.transform(F.filter(found, lambda v: _kind(v) == "name"), lambda v: _parts(v, F.lit("name"))))
    words = F.filter(words, lambda p: (p["kind"] == "surname") | p["kind"].startswith("given_"))
    words = F.filter(words, lambda p: F.length(p["raw"]) >= 3)
    kinds = F.array_distinct(F.transform(words, lambda p: F.struct(p["norm"].alias("norm"), p["kind"].alias("kind"))))
    # of several kinds of a word the first by name counts
    first = F.filter(kinds, lambda k: ~F.exists(kinds, lambda o: (o["norm"] == k["norm"]) & (o["kind"] < k["kind"])))
    return F.when(F.size(words) > 0, F.map_from_entries(first)).otherwise(F.create_map().cast("map<string,string>"))


def _pattern(persons: Column) -> Column:
    """What a text is cut at: all entities, and the words of its persons' names with a capital or in capitals."""
    forms = F.flatten(F.transform(F.map_keys(persons), lambda w: F.array(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2), F.length(w))), F.upper(w))))
    bare = F.concat(F.lit(f"{_ANY}|{_START}(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(persons) > 0, bare).otherwise(F.lit(_ANY))


def _seed(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    message = F.concat_ws("\0", F.lit(key), kind, norm, attempt.cast("string"))
    return F.sha2(F.concat(F.lit(key), F.sha2(message, 512)), 512)


def _byte(seed: Column, i: Column) -> Column:
    """Byte i (from 0, going round) of a seed of 128 hex digits."""
    return F.conv(F.substr(seed, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _characters(value: Column) -> Column:
    return F.split(value, "")


def _alike(value: Column, seed: Column, fixed: int = 1 << 30, codes: tuple[int, ...] = ()) -> Column:
    """Each digit, capital and small letter replaced by one of its kind; the rest stays.

    Characters are counted from the right, separators left out, so that the
    same number is replaced alike however it is grouped. Those from ``fixed``
    on stay; at the places ``codes`` no 0 or 1 may stand.
    """

    def of(own: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            place = F.size(own) - 1 - i
            b = _byte(seed, place) + place
            digit = F.when(place.isin(*codes), _pick("23456789", b)).otherwise(_pick("0123456789", b)) if codes else _pick("0123456789", b)
            drawn = F.when(c.rlike("[0-9]"), digit).when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", b)).otherwise(c)
            return F.when(place >= fixed, c).otherwise(drawn)

        between = F.split(value, r"[\p{L}\p{N}]", -1)
        return F.array_join(F.flatten(F.zip_with(between, F.transform(own, one), lambda gap, c: F.array(gap, F.coalesce(c, F.lit(""))))), "")

    # the characters without what stands between them
    return _let(F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]"), F.lit(0)), of)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def of(own: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            d = F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(F.pmod(F.size(own) - 1 - i, F.lit(2)) == 1, 2).otherwise(1)
            return F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.transform(own, one), F.lit(0), lambda a, x: a + x)

    return _let(_characters(digits), of)


def _card(value: Column, seed: Column) -> Column:
    def of(drawn: Column) -> Column:
        head = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
        open_sum = _luhn(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0")))
        valid = F.concat(head, F.pmod(-open_sum, F.lit(10)).cast("string"))
        return F.when(F.pmod(_luhn(F.regexp_replace(value, r"\D", "")), F.lit(10)) == 0, valid).otherwise(drawn)

    return _let(F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_alike(value, seed), F.lit(2), F.length(value))), of)


def _ip(seed: Column) -> Column:
    number = F.conv(F.substr(seed, F.lit(1), F.lit(12)), 16, 10).cast("long")
    return F.concat_ws(".", *(((F.floor(number / (254**k)) % 254) + 1).cast("long").cast("string") for k in range(4)))


def _phone(value: Column, seed: Column) -> Column:
    """Digits before the last ten are the country's; area and exchange codes don't begin with 0 or 1."""
    return _alike(value, seed, fixed=10, codes=(9, 6))


def _birthdate(value: Column, key: str) -> Column:
    """The date as many days earlier as the key says, written alike; what is no date, digit by digit."""
    days = 30 + int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big") % 3000

    def of(p: Column) -> Column:
        a, b, c = (p[i] for i in range(3))
        iso = F.length(a) == 4
        first, second = a.cast("int"), b.cast("int")
        # the month comes first with slashes, unless it can't be one
        by_month = F.when(value.contains("/"), first <= 12).otherwise((first <= 12) & (second > 12))
        year = F.when(iso, a).when(F.length(c) == 2, F.concat(F.lit("19"), c)).otherwise(c)
        month, day = F.when(iso, b).when(by_month, a).otherwise(b), F.when(iso, c).when(by_month, b).otherwise(a)
        old = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
        new = F.date_sub(old, days)
        y = F.lpad(F.year(new).cast("string"), 4, "0")
        m, d = (F.lpad(n(new).cast("string"), 2, "0") for n in (F.month, F.dayofmonth))
        separator = F.regexp_extract(value, r"[./-]", 0)
        short = F.when(F.length(c) == 2, F.substr(y, F.lit(3), F.lit(2))).otherwise(y)
        written = F.when(iso, F.concat_ws("-", y, m, d)).when(by_month, F.concat(m, separator, d, separator, short)).otherwise(F.concat(d, separator, m, separator, short))
        return F.coalesce(written, _alike(value, F.sha2(F.concat(F.lit(key), value), 512)))

    return _let(F.split(value, r"[./-]"), of)


def _address(value: Column, seed: Column) -> Column:
    """Numbers and capitalised names are replaced, kinds of streets and small words stay."""

    def one(w: Column, i: Column) -> Column:
        own = F.sha2(F.concat(seed, i.cast("string")), 512)
        stem = F.regexp_extract(w, rf"^(\p{{Lu}}\p{{L}}*?)({_STRASSE})$", 1)
        made = lambda token: _made_up(token, own, F.lit("n"), F.lit(0))
        return (
            F.when(w.rlike(r"^\d"), _alike(w, own))
            .when(w.rlike(rf"^(?:{_STREET})$"), w)
            .when(stem != "", F.concat(made(stem), F.substr(w, F.length(stem) + 1, F.length(w))))
            .when(w.rlike(r"^\p{Lu}\p{L}"), made(w))
            .otherwise(w)
        )

    return F.array_join(F.transform(F.split(value, r"(?<=\s)|(?=\s)"), one), "")


def _email(value: Column, seed: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    label = F.translate(F.substr(_seed(key, F.lit("domain"), domain, F.lit(0)), F.lit(1), F.lit(10)), "0123456789", "ghjkmnpqrs")
    # two more letters than the local part has keep short ones apart
    more = F.concat(_pick("abcdefghijklmnopqrstuvwxyz", _byte(seed, F.lit(62))), _pick("abcdefghijklmnopqrstuvwxyz", _byte(seed, F.lit(63))))
    return F.concat(more, _alike(local, seed), F.lit("@"), label, F.lit(".example."), F.substring_index(domain, ".", -1))


def _secret(value: Column, seed: Column) -> Column:
    hexed = F.substr(F.repeat(seed, 2), F.lit(1), F.length(value))
    return F.when(value.rlike("^[0-9a-f]+$") & (F.length(value) <= 256), hexed).otherwise(_alike(value, seed))


def _made_up(token: Column, seed: Column, gender: Column, attempt: Column) -> Column:
    """A name of the token's script and case whose ending goes with the gender."""

    def of(script: str) -> Column:
        consonants, vowels = SOUNDS[script]
        n = 3 + F.least(attempt, F.lit(3))
        syllables = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(_pick(consonants, _byte(seed, i * 2)), _pick(vowels, _byte(seed, i * 2 + 1))))
        end = {"latin": "ans", "cyrillic": "анс", "greek": "ανς"}[script]
        ending = F.when(gender == "f", end[0]).when(gender == "m", end[1]).otherwise(end[2])
        return F.concat(F.array_join(syllables, ""), F.lit(consonants[3]), ending)

    name = F.when(token.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(token.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    return F.when(token == F.upper(token), F.upper(name)).otherwise(F.initcap(name))


def _parts(value: Column, kind: Column, persons: Column | None = None) -> Column:
    """The mention as parts (kind, norm, raw): a name's title and words are parts of their own, so that
    a surname alone and with a given name stay one person; kind null: stays as it is."""
    nothing = F.lit(None).cast("string")

    def part(kind: Column, norm: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), raw.alias("raw"))

    def labelled(label: str, name: str) -> Column:
        """What announces it, unchanged, and the rest."""
        head = F.regexp_extract(value, rf"\A{label}", 0)
        rest = F.substr(value, F.length(head) + 1, F.length(value))
        return F.array(part(nothing, head, head), part(F.lit(name), rest, rest))

    cue = F.regexp_extract(value, rf"\A{_CUE}\s{{1,2}}", 0)
    words = F.split(F.substr(value, F.length(cue) + 1, F.length(value)), r"(?<=\s)|(?=\s)")
    title = F.regexp_extract(value, rf"^({_TITLE})\s", 1)
    bare = F.regexp_replace(title, r"\.$", "")
    by_title = F.when(bare.isin(TITLES["m"].split()), "m").when(bare.isin(TITLES["f"].split()), "f").otherwise("n")

    def word(w: Column, i: Column) -> Column:
        own = F.when(w.isin(GIVEN["m"].split()), "m").when(w.isin(GIVEN["f"].split()), "f").otherwise(by_title)
        last = i == F.size(words) - 1
        kind_of = F.when(w.rlike(r"^\s*$") | ((i == 0) & (title != "")), nothing).when(w.endswith("."), "initial").when(last, "surname").otherwise(F.concat(F.lit("given_"), own))
        return part(kind_of, F.lower(w), w)

    digits = F.regexp_replace(value, r"\D", "")
    # numbers that no issuer gives out are no cards
    card = F.when(value.rlike("^[2-6]") & (F.pmod(_luhn(digits), F.lit(10)) == 0), "card")
    compact = F.regexp_replace(value, r"[ ()-]", "")
    norm = F.when(kind.isin("email", "address"), F.lower(value)).when(kind.isin("card", "phone", "ssn", "iban"), compact).otherwise(value)
    out = F.when(kind == "name", F.concat(F.when(cue != "", F.array(part(nothing, cue, cue))).otherwise(F.array().cast("array<struct<kind:string,norm:string,raw:string>>")), F.transform(words, word)))
    out = out.when(kind == "secret", labelled(_SECRET_LABEL, "secret")).when(kind == "birthdate", labelled(_BORN, "birthdate")).when(kind == "card", F.array(part(card, norm, value)))
    if persons is not None:
        out = out.when(kind == "person", F.array(part(F.try_element_at(persons, F.lower(value)), F.lower(value), value)))
    return out.otherwise(F.array(part(kind, norm, value)))


def surrogate(key: str, kind: Column, norm: Column, raw: Column, attempt: Column) -> Column:
    """What replaces ``raw``, a mention of the entity ``norm``."""
    gender = F.when(kind.startswith("given_"), F.substr(kind, F.lit(7), F.lit(1))).otherwise("n")

    def of(seed: Column) -> Column:
        out = F.when(kind == "email", _email(raw, seed, key)).when(kind == "ip", _ip(seed)).when(kind == "card", _card(raw, seed))
        out = out.when(kind == "phone", _phone(raw, seed)).when(kind == "secret", _secret(raw, seed)).when(kind == "birthdate", _birthdate(raw, key)).when(kind == "address", _address(raw, seed))
        out = out.when(kind == "iban", F.concat(F.substr(raw, F.lit(1), F.lit(2)), F.substr(_alike(raw, seed), F.lit(3), F.length(raw))))
        out = out.when((kind == "surname") | kind.startswith("given_"), _made_up(raw, seed, gender, attempt))
        return out.otherwise(_alike(raw, seed))

    return F.when(kind.isNull(), raw).otherwise(_let(_seed(key, kind, norm, attempt), of))


def _norm_of_surrogate(kind: Column, value: Column) -> Column:
    """A surrogate as it is compared: as an entity of its type is normalised."""
    return F.when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(value, r"[ ()-]", "")).when(kind.isin("ip", "secret"), value).otherwise(F.lower(value))


def _space(kind: Column) -> Column:
    """What surrogates are distinct in: all words of names are one space."""
    return F.when((kind == "surname") | kind.startswith("given_"), "name").otherwise(kind)


def attempts(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate won't do.

    Entities are all distinct (kind, norm) of ``parts`` (kind, norm, raw). One
    keeps its surrogate if no other entity is equal to it and no entity with a
    lower norm has it too; the others try again until no clash is left. Raises
    if ATTEMPTS draws don't do.
    """
    own = parts.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*_APART)).groupBy("kind", "norm").agg(F.min("raw").alias("raw"))
    own = checkpoint(own.withColumn("attempt", F.lit(0)))
    taken = own.select(_space(F.col("kind")).alias("space"), F.col("norm").alias("drawn"), F.lit(True).alias("is_entity")).distinct()
    for _ in range(ATTEMPTS):
        drawn = own.withColumn("drawn", _norm_of_surrogate(F.col("kind"), surrogate(key, F.col("kind"), F.col("norm"), F.col("raw"), F.col("attempt")))).withColumn("space", _space(F.col("kind")))
        first = drawn.groupBy("space", "drawn").agg(F.min(F.struct("attempt", "norm", "kind")).alias("holder"))
        judged = drawn.join(first, ["space", "drawn"]).join(taken, ["space", "drawn"], "left")
        clash = F.col("is_entity").isNotNull() | (F.col("holder.norm") != F.col("norm")) | (F.col("holder.kind") != F.col("kind"))
        judged = checkpoint(judged.select("kind", "norm", "raw", "attempt", clash.alias("clash")))
        if not judged.where("clash").limit(1).count():
            return own.where("attempt > 0").select("kind", "norm", "attempt")
        own = judged.select("kind", "norm", "raw", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    kinds = [r["kind"] for r in judged.where("clash").select("kind").distinct().collect()]
    raise ValueError(f"no surrogate without a clash in {ATTEMPTS} draws for entities of type {', '.join(sorted(kinds))}")


def _mentions(found: Column, persons: Column) -> Column:
    def parts(v: Column) -> Column:
        return _let(F.when(F.map_contains_key(persons, F.lower(v)), "person").otherwise(_kind(v)), lambda kind: _parts(v, kind, persons))

    return F.transform(found, parts)


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities, kinds.

    kinds lists the types found, in order of their names, joined by spaces. A
    null text stays null, an empty one empty, both without entities. Rows that
    repeat are rewritten alike; an empty table gives an empty result; other
    columns are not looked at. Whole texts are read, twice each.
    """
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    rows = rows.withColumn("found", entities(F.coalesce("text", F.lit("")))).withColumn("persons", _persons(F.col("found")))
    rows = rows.withColumn("found", F.when(F.size("persons") > 0, F.regexp_extract_all("text", _pattern(F.col("persons")), F.lit(0))).otherwise(F.col("found")))
    rows = rows.withColumn("mentions", _mentions(F.col("found"), F.col("persons")))
    # a filter on the mentions, given or inferred, would find them a second time; this one stays behind them
    parts = rows.select("k1", "k2", F.explode_outer(F.flatten("mentions")).alias("p")).select("k1", "k2", "p.kind", "p.norm", "p.raw")
    parts = checkpoint(parts.where("kind is not null"))
    again = checkpoint(attempts(parts.select("kind", "norm", "raw"), key))
    if again.limit(1).count():
        changed = parts.join(again, ["kind", "norm"]).select("k1", "k2", F.concat_ws("\0", "kind", "norm").alias("name"), "attempt").distinct()
        changed = changed.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("name", "attempt"))).alias("tries"))
        rows = rows.join(changed, ["k1", "k2"], "left")
        tries = F.coalesce("tries", F.create_map().cast("map<string,int>"))
        attempt = lambda p: F.coalesce(F.try_element_at(tries, F.concat_ws("\0", p["kind"], p["norm"])), F.lit(0))
    else:
        attempt = lambda p: F.lit(0)
    made = F.transform("mentions", lambda ps: F.array_join(F.transform(ps, lambda p: surrogate(key, p["kind"], p["norm"], p["raw"], attempt(p))), ""))
    # a text without entities is not cut
    between = F.split(F.when(F.size("found") > 0, F.col("text")).otherwise(""), _pattern(F.col("persons")), -1)
    woven = lambda own: F.array_join(F.concat(F.slice(own, 1, 1), F.flatten(F.zip_with(made, F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda m, b: F.array(m, b)))), "")
    joined = _let(between, woven)
    true_kinds = F.filter(F.transform(F.flatten("mentions"), lambda p: F.regexp_replace(p["kind"], "^(given_.|surname|initial)$", "name")), lambda k: k.isNotNull())
    n = F.size(F.filter("mentions", lambda ps: F.exists(ps, lambda p: p["kind"].isNotNull())))
    return rows.select("doc_id", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"), n.alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(true_kinds)), " ").alias("kinds"))
