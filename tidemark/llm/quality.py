"""Quality rules: per-text statistics and cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, words, written

#: A line is boilerplate in its host when over MIN_DOCS distinct documents have it, and over MAX_SHARE of the host's or over MANY_DOCS.
MIN_DOCS = 20
MAX_SHARE = 0.02
MANY_DOCS = 10_000
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.5
MIN_WORDS = 50


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """df with n_repeat_words from `windows` (hashes of three-word windows): words in windows found twice or more.

    Over the sorted positions p of such windows that is the sum of min(3, p - the one before). Texts whose windows all differ are
    settled first. Each step is a column of its own: an array named inside a lambda would be made anew for each element.
    """
    hashes = F.col("windows")
    some = F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), hashes).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("at", F.array_sort(F.transform(some, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    at = F.col("at")
    alike = F.transform(at, lambda x, k: F.when((F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("twice", F.array_sort(F.filter(alike, lambda p: p.isNotNull())))
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda s, p: F.struct(p.alias("last"), (s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )
    return df.withColumn("n_repeat_words", covered).drop("at", "twice")


def normalised_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, source): the base figures, `base_failed`, and `lines`: (hash, words) of each line that has a word.

    A null text has no words. Repeated rows stay. Windows are compared by 64-bit hashes. `content`: the hash of all normalised lines in
    order, which copies of a text share and other texts don't; null without a line.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = own.select(
        "doc_id",
        "source",
        F.xxhash64("source", "text").alias("row_hash"),
        words(F.col("text")).alias("w"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
    )
    w = F.col("w")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(
        F.array().cast("array<bigint>")
    )
    wide = cut.select(
        "doc_id",
        "source",
        "row_hash",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.transform("full", normalised_line).alias("norm"),
    )
    counted = _with_repeat_words(wide).select(
        "doc_id",
        "source",
        "row_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(F.size("norm") > 0, F.xxhash64(F.array_join("norm", "\n"))).alias("content"),
        F.transform("norm", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, many_docs: int = MANY_DOCS) -> DataFrame:
    """(host, line) of lines above the limits, by distinct documents: copies of one text are one document.

    Rows meet per (host, line, content) first, so a line of a third of all rows is counted in parts, then per (host, line).
    """
    host = F.xxhash64("source")  # one host of its own for null
    held = stats.select(host.alias("host"), "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    per_line = held.distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = stats.where("content is not null").select(host.alias("host"), "content").distinct().groupBy("host").agg(F.count("*").alias("of_docs"))
    above = (F.col("n_docs") > max_share * F.col("of_docs")) | (F.col("n_docs") > many_docs)
    return per_line.join(hosts, "host").where(above).select("host", "line")


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, many_docs: int = MANY_DOCS) -> DataFrame:
    """statistics() with `removed_words` (in lines above the limits), `removed_lines` (their hashes), `kept`.

    kept: not base_failed and at least min_left of the words are in lines that stay. A null source is a host of its own.
    """
    stats = written(statistics(docs))
    common = written(frequent_lines(stats, min_docs, max_share, many_docs))
    held = stats.select("doc_id", "row_hash", F.xxhash64("source").alias("host"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    hit = held.join(common, ["host", "line"]).groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("gone"))
    hit = hit.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("row_hash", "hit_hash")
    both = stats.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_hash") == F.col("hit_hash")), "left").drop("hit_id", "hit_hash")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    removed = F.aggregate(F.filter("lines", lambda x: F.array_contains(gone, x["line"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    removed = F.when(F.size(gone) == 0, F.lit(0).cast("long")).otherwise(removed)
    judged = both.withColumns({"removed_lines": gone, "removed_words": removed})
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words"))
    return judged.withColumn("kept", kept).drop("gone")


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines whose normalised hash is in gone."""
    left = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(gone, F.xxhash64(normalised_line(x)))))
    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(left, "\n"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without rejected documents, and without lines above the limits in those that stay; n_chars follows the text.

    Columns of docs stay as they are otherwise. Repeated rows are judged alike.
    """
    judged = verdicts(docs).where("kept").select(F.col("doc_id").alias("_tm_id"), F.col("row_hash").alias("_tm_hash"), F.col("removed_lines").alias("_tm_gone"))
    judged = judged.dropDuplicates(["_tm_id", "_tm_hash"])
    own = docs.withColumns({"_tm_doc": F.col("doc_id").cast("long"), "_tm_own": F.xxhash64("source", F.coalesce(F.col("text").cast("string"), F.lit("")))})
    both = own.join(judged, F.col("_tm_doc").eqNullSafe(F.col("_tm_id")) & (F.col("_tm_own") == F.col("_tm_hash")))
    out = both.withColumn("text", without_lines(F.col("text"), F.col("_tm_gone")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verdicts() of all documents: the base figures, the words in lines above the limits, and whether the document stays."""
    judged = verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


_W = r"[^\x20\x09-\x0D]+"
_S = r"[\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{_W}') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM d),
x AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
y AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM x),
z AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM y WHERE c > 1) GROUP BY r),
s AS (SELECT w.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words,
             list_transform(l, lambda x: lower(trim(regexp_replace(x, '{_S}', ' ', 'g')))) AS norm
      FROM w LEFT JOIN z ON w.r = z.r),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
e AS (SELECT r, source, norm, unnest(norm) AS line FROM f),
c AS (SELECT source, line, count(DISTINCT norm) AS n FROM e GROUP BY source, line),
h AS (SELECT source, count(DISTINCT norm) AS m FROM f WHERE len(norm) > 0 GROUP BY source),
g AS (SELECT c.source, line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {MIN_DOCS} AND (n > {MAX_SHARE} * m OR n > {MANY_DOCS})),
q AS (SELECT r, sum(len(string_split(e.line, ' '))) AS gone FROM e JOIN g ON e.line = g.line AND e.source IS NOT DISTINCT FROM g.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - coalesce(gone, 0) >= {MIN_LEFT} * n_words AS kept, CAST(coalesce(gone, 0) AS BIGINT) AS removed_words
FROM f LEFT JOIN q ON f.r = q.r
"""
