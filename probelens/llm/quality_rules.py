"""Quality rules from lines that many documents share, in DataFrame functions alone.

Lines are normalised (trimmed, lower-cased, runs of digits as one 0, runs of white space as one space) and hashed. A
line is boilerplate if more than a share of its host's documents have it, and more than two of them, so that a host's verdicts
do not depend on its size. Such lines are removed, and a document is rejected if
less than a share of its words is left. Only hashes are exchanged, never texts: a line's count combines inside tasks,
and what a document loses is summed over its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line is boilerplate if more documents of a host have it than this, and more than so many percent of them.
MOST_DOCUMENTS = 2
MOST_PERCENT = 1
#: Percent of the words that have to be left.
LEAST_PERCENT = 30

_SPACE_CHARS = " \t\n\x0b\f\r"
_SPACES = r"[ \t\n\x0B\f\r]+"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES))


#: Hashes of three-word windows with their position in the low bits, sorted: equal windows are neighbours.
_TAGGED = "transform(sequence(0, size(__words) - 3), i -> shiftleft(xxhash64(__words[i], __words[i + 1], __words[i + 2]), __bits) | i)"
_REPEATED = """filter(__tagged, (x, i) -> (i > 0 AND shiftright(x, __bits) = shiftright(__tagged[i - 1], __bits))
    OR (i < size(__tagged) - 1 AND shiftright(x, __bits) = shiftright(__tagged[i + 1], __bits)))"""
_STARTS = f"array_sort(transform({_REPEATED}, x -> x & (shiftleft(1L, __bits) - 1)))"
_COVERED = "aggregate(__starts, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"


def _present(line: Column) -> Column:
    """Whether a line has a word."""
    return F.btrim(line, F.lit(_SPACE_CHARS)) != ""


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts have no words. n_repeat_words compares 64-bit hashes less the bits of a position, of which a text
    needs as many as its number of words. Input columns must have other names, and none may begin with two underscores.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", words_of(F.col(text))).withColumn("__lines", F.filter(F.split(whole, "\n"), _present))
    out = out.withColumn("__bits", F.length(F.bin(F.size("__words"))))
    out = out.withColumn("__tagged", F.when(F.size("__words") >= 3, F.sort_array(F.expr(_TAGGED))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__starts", F.expr(_STARTS))
    out = out.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def line_hash(line: Column) -> Column:
    """Hash of a normalised line."""
    spaced = F.regexp_replace(F.btrim(line, F.lit(_SPACE_CHARS)), _SPACES, " ")
    return F.xxhash64(F.lower(F.regexp_replace(spaced, "[0-9]+", "0")))


def boilerplate(docs: DataFrame, text: str, host: str, most_documents: int, percent: int) -> DataFrame:
    """(__host, __hash) of the lines that more documents of a host have than the limit."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _present)
    hosts = docs.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("__documents"))
    each = docs.select(F.col(host).alias("__host"), F.explode(F.array_distinct(F.transform(lines, line_hash))).alias("__hash"))
    often = each.groupBy("__host", "__hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_documents)
    found = often.alias("o").join(hosts.alias("h"), F.expr("o.__host <=> h.__host")).where(F.expr(f"100 * __n > {percent} * __documents"))
    return found.select("o.__host", "__hash")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most_documents: int = MOST_DOCUMENTS,
            percent: int = MOST_PERCENT, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per document: its id, the base counts, base_failed, n_lost (words in boilerplate lines), kept and cleaned
    (the text without its boilerplate lines; other lines, blank ones too, stay as they are, and null stays null).

    A document is kept unless it fails the base rules or boilerplate leaves it less than `least_percent` of its
    words. Null and blank texts fail. A null host is a host of its own. Every row counts as a document, so repeated
    rows count as often as they occur. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(host).alias("__host"), F.col(text).alias("__text")).withColumn("__of", F.xxhash64("__text"))
    bad = boilerplate(rows, "__text", "__host", most_documents, percent)
    lines = F.transform(F.split(F.col("__text"), "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    counted = F.transform(F.filter(lines, lambda x: _present(x["line"])), lambda x: F.struct(x["at"].alias("at"), line_hash(x["line"]).alias("hash"), F.size(words_of(x["line"])).alias("words")))
    placed = rows.select("__id", "__of", "__host", F.explode(counted).alias("__line"))
    placed = placed.select("__id", "__of", "__host", F.col("__line.at").alias("__at"), F.col("__line.hash").alias("__hash"), F.col("__line.words").alias("__lost"))
    hit = placed.alias("p").join(bad.alias("b"), F.expr("p.__hash = b.__hash AND p.__host <=> b.__host"), "left_semi")
    once = hit.groupBy("__id", "__of", "__at").agg(F.max("__lost").alias("__lost"))  # of repeated rows
    lost = once.groupBy("__id", "__of").agg(F.sum("__lost").alias("n_lost"), F.collect_list("__at").alias("__bad"))
    base = base_counts(rows.drop("__host"), "__text")
    out = base.alias("d").join(lost.alias("l"), F.expr("d.__id <=> l.__id AND d.__of = l.__of"), "left")
    n_lost = F.coalesce("n_lost", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - n_lost) >= least_percent * F.col("n_words"))
    left = F.expr("transform(array(split(__text, '\n')), x -> transform(array_except(sequence(0, size(x) - 1), __bad), i -> x[i]))[0]")  # splits once
    cleaned = F.when(F.col("__bad").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("d.__id").alias(doc_id), *names, n_lost.alias("n_lost"), kept.alias("kept"), cleaned.alias("cleaned"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cleaned")


_CLASS = r" \t\n\x0B\f\r"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[{_CLASS}]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
hit AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit WHERE n > 1) GROUP BY doc_id),
raw AS (SELECT row, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT row, doc_id, source, line, len(list_filter(string_split_regex(line, '[{_CLASS}]+'), lambda x: x <> '')) AS n,
         lower(regexp_replace(regexp_replace(regexp_replace(line, '^[{_CLASS}]+|[{_CLASS}]+$', '', 'g'), '[{_CLASS}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
  FROM raw WHERE regexp_matches(line, '[^{_CLASS}]')),
bad AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT row) AS n FROM lines GROUP BY ALL)
  JOIN (SELECT source, count(*) AS documents FROM d GROUP BY source) USING (source)  -- every row counts
  WHERE n > {MOST_DOCUMENTS} AND 100 * n > {MOST_PERCENT} * documents),
lost AS (SELECT doc_id, sum(n) AS n FROM lines SEMI JOIN bad USING (source, norm) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[{_CLASS}]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_lost) >= {LEAST_PERCENT} * n_words AS kept
FROM base
"""
