"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
#: A (source, size) group is dealt over so many parts, each of which picks its share of the group's quota.
PARTS = 256
#: The dynamic program's first round exchanges so many documents of each of so many of the shortest lengths.
FIRST_LENGTHS, FIRST_DOCS = 64, 2
#: Its table has so many cells at most (5 bytes each).
MOST_CELLS = 1 << 25


def _exchange(sizes: list[int], room: list[int], cells: int) -> tuple[int, list[int]]:
    """The largest sum below `cells` that up to room[i] documents of sizes[i] make, and how many of each make it: a bounded knapsack.

    A length stands in powers of two of its room. first[r]: the step that reached r; r less that step was reached before it.
    """
    reach, first = np.zeros(cells, bool), np.full(cells, -1, np.int32)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i, n in enumerate(sizes):
        left, part = room[i], 1
        while left and not reach[-1]:
            part = min(part, left)
            if n * part < cells:
                new = np.flatnonzero(reach[: -n * part] & ~reach[n * part :]) + n * part
                first[new] = len(steps)
                reach[new] = True
                steps.append((i, part))
            left -= part
            part *= 2
    at = best = int(np.flatnonzero(reach)[-1])
    used = [0] * len(sizes)
    while at:
        i, part = steps[first[at]]
        used[i] += part
        at -= sizes[i] * part
    return best, used


def fit(lengths: list[int], counts: list[int], budget: int, most_cells: int = MOST_CELLS) -> list[int]:
    """How many documents of each length to take so that their words come as near below `budget` as any choice can.

    The same share of every length first, rounded down, then the longest that still fit: what is left is less than one document. A
    bounded knapsack then exchanges documents: a few of the shortest lengths, then, until the budget is met, more of more lengths. If
    two choices differ in more than 2 W + 1 documents (W: the longest), some of these have words that cancel out, so the program
    has seen all that matters once it exchanges so many of each length. Only if its table would outgrow most_cells, it ends before
    that, with less than one document missing.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [budget * c // total if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0), key=lambda i: lengths[i])
    for i in reversed(order):
        k = min(counts[i] - take[i], left // lengths[i])
        take[i] += k
        left -= k * lengths[i]
    unit, most = math.gcd(*(lengths[i] for i in order)), 2 * lengths[order[-1]] + 1
    n_lengths, n_docs = FIRST_LENGTHS, FIRST_DOCS
    while left >= unit:
        free = order[:n_lengths]
        spare = [min(take[i], n_docs) for i in free]
        room = [k + min(counts[i] - take[i], n_docs) for i, k in zip(free, spare, strict=True)]
        sizes = [lengths[i] // unit for i in free]
        cells = left // unit + sum(n * k for n, k in zip(sizes, spare, strict=True)) + 1
        if cells > most_cells:
            break
        best, used = _exchange(sizes, room, cells)
        for i, k, u in zip(free, spare, used, strict=True):
            take[i] += u - k
        left -= unit * (best - sum(n * k for n, k in zip(sizes, spare, strict=True)))
        if n_lengths >= len(order) and n_docs >= min(most, max(counts)):
            break
        n_lengths, n_docs = n_lengths * 4, n_docs * 2
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size: one row per source) with `target`.

    Sources by code point, null last, take the weights in turn. A target is the source's weight's part of share * all sizes; above
    most * source_size it stops there and the excess is shared again by weight. In order of source_size / weight the stopped
    sources come first, so running sums give the level: a source is stopped if, with all before it stopped, its part is above its most.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("double")
    weighted = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    run = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = weighted.withColumns(
        {"budget": F.sum("source_size").over(every) * F.lit(share), "all_w": F.sum("w").over(every), "done": F.coalesce(F.sum("cap").over(run), F.lit(0.0)), "done_w": F.coalesce(F.sum("w").over(run), F.lit(0.0))}
    )
    level = (F.col("budget") - F.col("done")) / (F.col("all_w") - F.col("done_w"))
    stopped = sums.withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "source", "level"))
    return stopped.withColumn("common", F.min(free).over(every)["level"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, size=None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, key=None) -> DataFrame:
    """(doc_id, row_hash, source, size, source_size, target, copies) per row of docs (doc_id, source, text).

    Each source repeats whole as often as its target holds it; the words left are a subset-sum problem over the counts of documents by
    exact length (fit), solved per source over distinct lengths, never over documents. Which documents of a length are taken goes by a
    seeded hash; a length's group is dealt over parts whose quotas come from running counts, so a group of a third of all rows spreads.
    A null text has size 0 and is never needed: copies are its source's whole repeats. Null is a source of its own. Repeated rows
    count each and may be taken differently; ties of the hash go by doc_id. row_hash is of source and text, or `key`. Without words all targets are 0. Reruns give the same.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (n_words(text) if size is None else size).alias("size"), (F.xxhash64("source", "text") if key is None else key).alias("row_hash")
    )
    rows = written(rows.withColumn("pick", F.xxhash64("doc_id", "row_hash", F.lit(seed))).withColumn("part", F.pmod("pick", F.lit(PARTS)).cast("int")))
    parts = written(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        budget = 0 if frame["whole"].iloc[0] >= most else int(frame["budget"].iloc[0])
        frame["take"] = fit(frame["size"].tolist(), frame["n"].tolist(), budget)
        return frame[["source", "size", "n", "take"]]

    at = lambda df, name: df.withColumnRenamed("source", name)
    per = lengths.join(at(goal.select("source", "whole", "budget"), "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    quota = per.groupBy("source").applyInPandas(solve, "source string, size long, n long, take long")
    quota = quota.where("take > 0").select(F.col("source").alias("q"), F.col("size").alias("q_size"), F.col("n").alias("of"), "take")
    w = Window.partitionBy("source", "size").orderBy("part")
    placed = parts.join(quota, F.col("source").eqNullSafe(F.col("q")) & (F.col("size") == F.col("q_size"))).withColumn("upto", F.sum("n").over(w))
    share_of = lambda c: F.expr(f"take * ({c}) div of")
    placed = placed.select(F.col("source").alias("q"), F.col("size").alias("q_size"), F.col("part").alias("q_part"), (share_of("upto") - share_of("upto - n")).alias("quota"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("pick", "doc_id")))
    same = F.col("source").eqNullSafe(F.col("q")) & (F.col("size") == F.col("q_size")) & (F.col("part") == F.col("q_part"))
    chosen = ranked.join(placed, same, "left").join(at(goal.drop("budget"), "g"), F.col("source").eqNullSafe(F.col("g")), "left")
    copies = F.col("whole") + (F.col("rank") <= F.coalesce("quota", F.lit(0))).cast("int")
    return chosen.select("doc_id", "row_hash", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it; columns stay. Rows alike in all columns share their copies.

    Only rows that have an equal are brought together, by an aggregation that combines before it shuffles; the rest stay where they are read.
    """
    key = F.xxhash64(*docs.columns)
    plan = mix(docs, key=key).groupBy("doc_id", "row_hash").agg(F.sum("copies").cast("int").alias("_tm_copies"), F.count("*").alias("_tm_n"))
    plan = written(plan.where("_tm_copies > 0").select(F.col("doc_id").alias("_tm_id"), F.col("row_hash").alias("_tm_hash"), "_tm_copies", "_tm_n"))
    own = docs.withColumns({"_tm_doc": F.col("doc_id").cast("long"), "_tm_own": key})
    both = own.join(plan, F.col("_tm_doc").eqNullSafe(F.col("_tm_id")) & (F.col("_tm_own") == F.col("_tm_hash")))
    each = both.where("_tm_n = 1").unionAll(both.where("_tm_n > 1").dropDuplicates(["_tm_doc", "_tm_own"]))
    return each.withColumn("_tm_k", F.explode(F.sequence(F.lit(1), F.col("_tm_copies")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents by words; `taken` counts repeats."""
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
