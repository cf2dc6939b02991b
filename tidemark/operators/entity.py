"""Resolving one entity's ids in several sources."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """An id as text: trimmed, '.0' dropped from whole numbers only, leading zeros kept, empty or 'nan' null."""
    t = F.trim(c.cast("string"))
    t = F.when(t.rlike(r"^[0-9]+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


@cache
def _accents() -> tuple[str, str]:
    """Letters below U+2000 whose decomposition is one ASCII letter and marks, and these letters."""
    pairs = [(chr(k), plain) for k in range(0xC0, 0x2000) if len(plain := "".join(x for x in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(x))) == 1 and plain.isascii() and plain.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(c: Column) -> Column:
    """Letters without their marks, by one translation; combining marks that stand alone go too."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}", "")


def name_key(c: Column) -> Column:
    """A name for matching: lower case letters and digits without accents, points and quotes joined, other signs as spaces, generation suffixes dropped."""
    t = F.regexp_replace(F.lower(without_accents(c)), r"['’.`]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]", " "), r"\s+", " "))
    return F.regexp_replace(t, r"(\s+(jr|sr|ii|iii|iv|v))+$", "")


def strict(c: Column, mapping: Mapping[str, str]) -> Column:
    """c by the mapping; a value that it lacks is an error, null stays."""
    out = F.raise_error(F.concat(F.lit("not in the mapping: "), c)).cast("string")
    for k, v in reversed(mapping.items()):
        out = F.when(c == k, v).otherwise(out)
    return F.when(c.isNotNull(), out)


def candidates(df: DataFrame, columns: Mapping[str, str], key: str, method: str, rank: int, season: str) -> DataFrame:
    """One row per id type, id and key that a source names: id_type, source_id, entity, method, rank, first and last season. columns: id type -> column."""
    ids = F.array(*[F.struct(F.lit(t).alias("id_type"), canonical(F.col(c)).alias("source_id")) for t, c in columns.items()])
    long = df.select(F.inline(ids), F.col(key).alias("entity"), F.col(season).alias("_s")).where("source_id is not null and entity is not null")
    per = long.groupBy("id_type", "source_id", "entity").agg(F.min("_s").alias("first_season"), F.max("_s").alias("last_season"))
    return per.withColumns({"method": F.lit(method), "rank": F.lit(rank)})


def bridge(candidates: DataFrame, id_type: str, source_id: str, entity: str, priority: str) -> DataFrame:
    """(id_type, source_id) -> entity. The best priority decides; an id that its best priority gives to two entities stays unresolved, with their number."""
    best = candidates.groupBy(id_type, source_id).agg(F.min(priority).alias("_best"))
    held = candidates.join(best, [id_type, source_id]).where(F.col(priority) == F.col("_best"))
    per = held.groupBy(id_type, source_id).agg(F.min(entity).alias("low"), F.max(entity).alias("high"), F.count_distinct(entity).alias("n_entities"))
    return per.select(id_type, source_id, F.when(F.col("low") == F.col("high"), F.col("low")).alias("entity"), "n_entities")


def conflicts(candidates: DataFrame, rank: str = "rank") -> DataFrame:
    """Ids for which a worse method names another entity than the best one: id_type, source_id, and what each names, in order."""
    of = candidates.groupBy("id_type", "source_id").agg(F.count_distinct("entity").alias("n"), F.array_sort(F.collect_set(F.struct(F.col(rank).alias("r"), F.col("entity").cast("string").alias("e")))).alias("named"))
    text = F.array_join(F.transform("named", lambda x: F.concat_ws(":", x["r"].cast("string"), x["e"])), " ")
    return of.where("n > 1").select("id_type", "source_id", text.alias("named"))


def unique_links(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows alike in all of `on`, where one row on each side has these values; nulls meet nothing. Keys are counted, so rows of a common key never meet each other."""
    one = lambda df, i, name: df.dropna(subset=on).groupBy(*on).agg(F.count("*").alias(f"_{name}"), F.min(i).alias(name)).where(F.col(f"_{name}") == 1).drop(f"_{name}")
    return one(left, left_id, "left_id").join(one(right, right_id, "right_id"), on).select("left_id", "right_id")


def two_pass_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, first: list[str], second: list[str], agree: str) -> DataFrame:
    """(left_id, right_id, pass): by `first`, then, for left rows that it didn't link, by `second`, where `agree` may be unknown but not different."""
    a = unique_links(left, right, first, left_id, right_id).withColumn("pass", F.lit("a"))
    rest = left.join(a.select(F.col("left_id").alias(left_id)), left_id, "left_anti")
    b = unique_links(rest, right, second, left_id, right_id)
    b = b.join(rest.select(F.col(left_id).alias("left_id"), F.col(agree).alias("_x")), "left_id").join(right.select(F.col(right_id).alias("right_id"), F.col(agree).alias("_y")), "right_id")
    b = b.where(F.coalesce(F.col("_x") == F.col("_y"), F.lit(True))).select("left_id", "right_id", F.lit("b").alias("pass"))
    return a.unionByName(b)


def usage_check(usage: DataFrame, careers: DataFrame, slack: int = 0) -> DataFrame:
    """Per used (id_type, source_id, entity) whether its seasons lie in the entity's career: used_first, used_last, valid (null without a career). usage: + season; careers: entity, first_season, last_season."""
    per = usage.groupBy("id_type", "source_id", "entity").agg(F.min("season").alias("used_first"), F.max("season").alias("used_last"))
    inside = (F.col("used_first") >= F.col("first_season") - slack) & (F.col("used_last") <= F.col("last_season") + slack)
    return per.join(careers, "entity", "left").select("id_type", "source_id", "entity", "used_first", "used_last", inside.alias("valid"))


def pick(candidates: DataFrame) -> DataFrame:
    """One id per entity and type: the best method's, then the latest season's, then the smallest; pivoted by the caller."""
    w = Window.partitionBy("entity", "id_type").orderBy("rank", F.col("last_season").desc(), "source_id")
    return candidates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("entity", "id_type", "source_id")


def coverage(rows: DataFrame, by: list[str], linked: str) -> DataFrame:
    """Match rates by group: rows, linked rows, distinct entities, share."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(linked).alias("n_linked"), F.count_distinct(linked).alias("n_entities"), F.round(F.count(linked) / F.count("*"), 6).alias("share"))
