"""Licence scans: windows of a text compared to licence templates by the Dice coefficient over word bigrams.

A text is read as words, in lower case, with runs of anything but letters and
digits between them, so that lines, comment marks and paragraphs make no
difference. A window of m distinct bigrams reaches the least coefficient t with
a template of n only if m is between t/(2-t) n and (2-t)/t n, and only if it
shares t/(2-t) n of the template's, hence at least one of any set that is larger
than the rest: the template's probes. So each place where a probe stands in a
text lays a window of the template's length over it, such that the probe is
where the template has it; windows that share too little are pruned, the others
are cut to what they share and compared. Of matches that overlap the one that
shares most stays. Each probe has one of a few telling words; a text with none
of these words is left out before it is cut up. All of it is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.llm.common import checkpoint, row_keys
from numera.llm.license_texts import TEMPLATES

#: Words too frequent to tell anything.
_FREQUENT = frozenset("a all an and any are as at be but by for from have if in is it may no not of on or that the this to was will with you".split())
#: Least Dice coefficient of a match.
LEAST = 0.8
_NOT_WORD = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _spare(bigrams: list[str], least: float) -> int:
    """How many of a template's bigrams a match may lack."""
    return int(len(bigrams) - least / (2 - least) * len(bigrams) + 1e-9)


def telling_words(templates: list[list[str]], least: float) -> list[str]:
    """Words such that each template has more bigrams with one of them than a match may lack.

    Chosen greedily, long words first: the one that is in most bigrams of the
    templates that still need it. Frequent words come last.
    """
    words: list[str] = []
    while True:
        need = [b for b in templates if sum(not words_of(g).isdisjoint(words) for g in b) <= _spare(b, least)]
        if not need:
            return sorted(words)
        gain: dict[str, int] = {}
        for b in need:
            for g in b:
                if words_of(g).isdisjoint(words):
                    for w in words_of(g):
                        gain[w] = gain.get(w, 0) + 1
        rare = {w: n for w, n in gain.items() if w not in _FREQUENT and not w.isdigit()} or gain
        words.append(max(rare, key=lambda w: (rare[w] * (len(w) >= 6), rare[w], len(w), w)))


def words_of(bigram: str) -> frozenset[str]:
    return frozenset(bigram.split(" "))


def probes(bigrams: list[str], telling: list[str], least: float) -> list[str]:
    """Bigrams with a telling word of which a passage must have one to reach ``least``."""
    own = sorted((b for b in bigrams if not words_of(b).isdisjoint(telling)), key=lambda b: (-len(b), b))
    return own[: _spare(bigrams, least) + 1]


def _offsets(text: str) -> dict[str, int]:
    """Where in the template each of its bigrams stands first."""
    words, out = template_words(text), {}
    for k, (a, b) in enumerate(zip(words, words[1:])):
        out.setdefault(f"{a} {b}", k)
    return out


def _template_rows(templates: tuple[tuple[str, str], ...], least: float) -> tuple[list[tuple], list[tuple], list[str]]:
    """(template, license, n, length), (bigram, template, offset, probe), and the telling words.

    n counts distinct bigrams, length all of them.
    """
    own = [template_bigrams(text) for _, text in templates]
    telling = telling_words(own, least)
    whole, grams = [], []
    for i, ((spdx, text), bigrams) in enumerate(zip(templates, own)):
        whole.append((i, spdx, len(bigrams), len(template_words(text)) - 1))
        chosen = set(probes(bigrams, telling, least))
        grams += [(bigram, i, offset, bigram in chosen) for bigram, offset in _offsets(text).items()]
    return whole, grams, telling


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row for each match: two row keys, license, dice, first (word number from 0), words, common (bigrams).

    A match goes if one that overlaps it shares more bigrams (then by dice,
    then template, then place): first of the same template, then of any. A null or empty text has no match. Rows that
    repeat have one row a match together. Whole texts are scanned.
    """
    spark = docs.sparkSession
    whole_rows, gram_rows, telling = _template_rows(templates, least)
    # both template tables are fixed values, so the broadcasts are bounded
    whole = F.broadcast(spark.createDataFrame(whole_rows, "template int, license string, n int, length int"))
    grams = F.broadcast(spark.createDataFrame(gram_rows, "bigram string, template int, offset int, probe boolean"))
    share = least / (2 - least)
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(telling) + r")(?![\p{L}\p{N}])"
    # few texts have a telling word; they are read three times
    texts = docs.where(F.lower(F.col(text_col)).rlike(pattern)).select(k1.alias("k1"), k2.alias("k2"), F.split(normalised(F.col(text_col)), " ").alias("w"))
    texts = checkpoint(texts)
    hits = texts.select("k1", "k2", F.posexplode(_bigrams(F.col("w"))).alias("pos", "bigram")).join(grams, "bigram").join(whole.select("template", "n", "length"), "template")
    hits = hits.select("k1", "k2", "template", "n", "length", "pos", "offset", "probe")
    # a window meets the hits of two bins of its template's length
    windows = hits.where("probe").select("k1", "k2", "template", "length", (F.col("pos") - F.col("offset")).alias("start")).distinct()
    bins = F.explode(F.array(F.floor(F.col("start") / F.col("length")), F.floor(F.col("start") / F.col("length")) + 1))
    windows = windows.select("k1", "k2", "template", "start", bins.alias("bin"))
    placed = hits.select("k1", "k2", "template", "n", "length", "pos", "offset", F.floor(F.col("pos") / F.col("length")).alias("bin"))
    inside = windows.join(placed, ["k1", "k2", "template", "bin"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("length")))
    spans = inside.groupBy("k1", "k2", "template", "start").agg(F.max("n").alias("n"), F.size(F.collect_set("offset")).alias("common"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    spans = spans.where(F.col("common") >= share * F.col("n") - 1e-9).select("k1", "k2", "template", "n", "common", "first", "last").distinct()
    m = F.size(F.array_distinct(_bigrams(F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + 2))))
    dice = spans.join(texts, ["k1", "k2"]).select(*spans.columns, m.alias("m")).where(F.col("m").between(share * F.col("n") - 1e-9, F.col("n") / share + 1e-9))
    dice = dice.withColumn("dice", 2 * F.col("common") / (F.col("m") + F.col("n"))).where(F.col("dice") >= least).distinct()
    better = F.struct(F.col("common"), F.col("dice"), (-F.col("template")).alias("t"), (-F.col("first")).alias("f"), (-F.col("last")).alias("l"))
    ranked = dice.withColumn("rank", better)

    def best_of(rows: DataFrame, own: bool) -> DataFrame:
        """Rows that no better one overlaps: of their own template, or of any."""
        other = rows.select("k1", "k2", F.col("template").alias("template2"), F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("rank").alias("rank2"))
        overlap = (rows["k1"] == other["k1"]) & (rows["k2"] == other["k2"]) & (F.col("first2") <= F.col("last") + 1) & (F.col("last2") + 1 >= F.col("first")) & (F.col("rank2") > F.col("rank"))
        return rows.join(other, overlap & (F.col("template") == F.col("template2")) if own else overlap, "left_anti")

    best = best_of(best_of(ranked, True), False).join(whole.select("template", "license"), "template")
    return best.select("k1", "k2", "license", "dice", "first", (F.col("last") - F.col("first") + 2).alias("words"), "common")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches, license, dice, licenses.

    license and dice are those of the best match by dice (then the first by
    name), null without one; licenses lists all, in order, joined by spaces.
    Null and empty texts have none; rows that repeat get the same answer each;
    an empty table gives an empty result; other columns are not looked at.
    """
    found = matches(docs, id_col, text_col, templates, least).groupBy("k1", "k2").agg(
        F.count("*").alias("n_matches"),
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"),
        F.array_join(F.array_sort(F.collect_set("license")), " ").alias("licenses"),
    )
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> str:
    """``scan`` of documents in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def best_of(name: str, rows: str, more: str) -> str:
        return f"""{name} AS (
    SELECT * FROM {rows} a WHERE NOT EXISTS (
        SELECT 1 FROM {rows} b WHERE {more}b.r = a.r AND b.first_pos <= a.last_pos + 1 AND b.last_pos + 1 >= a.first_pos
        AND (b.common, b.dice, -b.template, -b.first_pos, -b.last_pos) > (a.common, a.dice, -a.template, -a.first_pos, -a.last_pos)))"""

    whole, grams, _ = _template_rows(templates, least)
    share = least / (2 - least)
    whole_sql = ", ".join(f"({i}, {quoted(spdx)}, {n}, {length})" for i, spdx, n, length in whole)
    gram_sql = ", ".join(f"({quoted(bigram)}, {i}, {offset}, {probe})" for bigram, i, offset, probe in grams)
    return rf"""
WITH templates(template, license, n, length) AS (VALUES {whole_sql}),
grams(bigram, template, off, probe) AS (VALUES {gram_sql}),
words AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
    FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT r, unnest(range(0, len(w) - 1)) AS pos, w FROM words WHERE len(w) > 1),
hits AS (SELECT p.r, p.pos, g.template, g.off, g.probe, t.n, t.length
         FROM (SELECT r, pos, w[pos + 1] || ' ' || w[pos + 2] AS bigram FROM pairs) p JOIN grams g USING (bigram) JOIN templates t USING (template)),
windows AS (SELECT DISTINCT r, template, pos - off AS start FROM hits WHERE probe),
spans AS (
    SELECT DISTINCT r, template, n, common, first_pos, last_pos FROM (
        SELECT h.r, h.template, x.start, any_value(n) AS n, count(DISTINCT off) AS common, min(pos) AS first_pos, max(pos) AS last_pos
        FROM windows x JOIN hits h ON h.r = x.r AND h.template = x.template AND h.pos >= x.start AND h.pos < x.start + h.length
        GROUP BY h.r, h.template, x.start)
    WHERE common >= {share}::DOUBLE * n - 1e-9),
sized AS (
    SELECT s.*, len(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(first_pos + 1, last_pos + 2)])) AS m
    FROM spans s JOIN words USING (r)),
scored AS (SELECT *, (2 * common)::DOUBLE / (m + n) AS dice FROM sized WHERE m BETWEEN {share}::DOUBLE * n - 1e-9 AND n / {share}::DOUBLE + 1e-9),
good AS (SELECT * FROM scored WHERE dice >= {least}),
{best_of("peak", "good", "b.template = a.template AND ")},
{best_of("best", "peak", "")},
found AS (
    SELECT r, count(*) AS n_matches, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, string_agg(DISTINCT license, ' ' ORDER BY license) AS licenses
    FROM best JOIN templates USING (template) GROUP BY r)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, license, dice, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN (SELECT w.doc_id, f.* FROM found f JOIN words w USING (r)) x ON x.doc_id = d.doc_id
"""
