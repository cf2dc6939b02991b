"""Connected components of an edge table, by contraction; no edge or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks two steps, and contracts the edges to those
    parents; nodes fall geometrically, so a few rounds end it. A hub only meets aggregations with map-side combining and
    joins whose other side has one row a key, which adaptive execution splits. Every round is a written table: nothing is
    recomputed when an executor is lost. Self loops and repeated edges count once; rows with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    live = written(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        ends = live.select(F.inline(F.array(F.struct(a.alias("node"), b.alias("near")), F.struct(b.alias("node"), a.alias("near")))))
        hook = written(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")))
        step = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        once = hook.join(step, "up").select("node", F.col("upper").alias("up"))
        parent = written(once.join(step, "up").select("node", F.col("upper").alias("root")))
        if labels is None:
            new = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = written(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
            forget(labels)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ra, rb = F.col("ra"), F.col("rb")
        after = live.join(left, "a").join(right, "b").where(ra != rb)
        following = written(after.select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).distinct())
        forget(live)
        forget(hook)
        live, labels = following, new
    if labels is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return labels
