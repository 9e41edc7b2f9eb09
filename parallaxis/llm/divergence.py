"""How far the sources of a language differ in their words: a plain relational audit.

Terms, which are what stands between the matches of a regexp, are exploded and counted by (lang, source, term), with the documents that have them; groups are crossed with
the terms that their language keeps, so that zeros are there too; a self-join on lang and term sets the sources of a language
side by side; sums and ranks follow. All arithmetic is on whole numbers: a rate is p = 1 + floor(SCALE * (count + 2) / (N + 2V)),
with N the group's occurrences of the V kept terms, and two rates differ by floor((p - q)^2 / (p + q)).

Shuffles carry counts, not words: what a task has seen is summed before. A language is spread over SALTS keys where its groups
meet its terms, ranks are cut within SALTS parts of a group before its parts meet. The work grows with the number of kept terms
times the pairs of sources of their language, as the result of all pairs asks for.

Null texts, languages and sources are ''. Every row is a document, repeated ones too. Texts of any length are taken whole; a
group without terms has rates and pairs, and pairs have the value 0 where a language keeps no terms. Equal values are
ranked by item, bytewise in UTF-8. An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, pick, written

#: What stands between terms. Splitting at it gives the matches of its complement, and takes a tenth of regexp_extract_all's time.
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SALTS = 32


def _groups_of(docs: DataFrame) -> DataFrame:
    part = pick(docs, "text", "lang", "source")
    return part.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it)."""
    words = _groups_of(docs).select("lang", "source", F.split(ascii_lower(F.col("text")), BREAK).alias("words"))
    # the words of a row, then its distinct ones
    twice = words.select("lang", "source", F.explode(F.array(F.struct(F.lit(1).alias("n"), "words"), F.struct(F.lit(0).alias("n"), F.array_distinct("words").alias("words")))).alias("x"))
    rows = twice.select("lang", "source", F.col("x.n").alias("n"), F.explode("x.words").alias("term")).where("term <> ''")  # at the ends of a text there may be empty ones
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs"))


def _rate(count: str, total: str) -> F.Column:
    whole = lambda x: f"CAST({x} AS DECIMAL(19, 0))"  # noqa: E731  counts times SCALE don't fit a long
    return F.expr(f"1 + {whole(SCALE)} * {whole(f'{count} + 2')} div {whole(f'{total} + 2 * v')}")


def _apart(p: str, q: str) -> F.Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def rates(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source, v (kept terms of the language); dense: lang, source, term, n, p, q (the language's rate) for every group and
    kept term)."""
    counts = written(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    kept = written(kept.select("lang", "term", "in_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    totals = counts.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _groups_of(docs).groupBy("lang", "source").agg(F.lit(0).alias("_")).drop("_")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = written(groups, "term-groups")
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    crossed = salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
    dense = crossed.join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").fillna(0, ["n"])
    dense = written(dense.select("lang", "source", "term", "n", _rate("n", "total").alias("p"), _rate("in_lang", "lang_total").alias("q")), "term-rates")
    discard(counts, kept)
    return groups.select("lang", "source", "v"), dense


def pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """lang, source, item (each other source), value. The value is the same both ways, so each pair is summed once."""
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    summed = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(_apart("p", "q")).alias("value"))
    bare = groups.where("v = 0")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    once = summed.unionByName(none)
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def distinctive_terms(dense: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language does), value; the top of each group."""
    rows = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    best = [F.col("value").desc(), F.col("item")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*best))).where(F.col("rank") <= top).drop("rank", "salt")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    groups, dense = rates(docs, least_documents)
    found = pairs(groups, dense).withColumn("part", F.lit("pair")).unionByName(distinctive_terms(dense, top).withColumn("part", F.lit("term")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), c AS (
  SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o SEMI JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY 1, 2, 3
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS m FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
         1 + 1000000000 * (n + 2) // (sum(n) OVER s + 2 * count(*) OVER s)::HUGEINT AS p,
         1 + 1000000000 * (m + 2) // (sum(m) OVER s + 2 * count(*) OVER s)::HUGEINT AS q
  FROM x WINDOW s AS (PARTITION BY lang, source)
), f AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = g.lang AND b.source = h.source AND b.term = a.term
  GROUP BY 1, 2, 4
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 10"""
