"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.llm.components import components

THRESHOLD = 0.93
TREES = 6
#: Vectors in a leaf, about.
LEAF = 192
#: A vector within so many standard deviations of a split goes to both sides.
SPILL = 0.15
SEED = 11
#: The trees' splits are fitted on so many vectors at most; every vector is indexed. Below the levels that a sample of this size can fit, splits are its overall medians.
SAMPLE = 16_384
#: Members of a leaf that one task compares with each other or with as many others; larger leaves are compared block by block.
BLOCK = 1024
MAX_DEPTH = 40


def direction(seed: int, tree: int, level: int, dims: int) -> np.ndarray:
    v = np.random.default_rng([seed, tree, level, dims]).standard_normal(dims)
    return v / np.linalg.norm(v)


class Forest:
    """Per tree and level one random direction, per node a threshold (the sample's median there) and a spill margin.

    The margin is no smaller than half the typical difference, in one direction, of two vectors at the threshold. A node whose
    vectors have a mean cosine of about the threshold is dense: any cut would part links, so it is a leaf, however large.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = SEED, threshold: float = THRESHOLD) -> None:
        self.depth, self.trees, self.spill, self.seed = depth, trees, spill, seed
        self.dims = sample.shape[1] if sample.ndim == 2 else 0
        self.fitted = min(depth, max(0, int(math.log2(max(1, len(sample)) / 32))))
        least = math.sqrt(2 * max(0.0, 1 - threshold) / max(1, self.dims)) / 2
        dense = 1 - 2 * (1 - threshold)
        self.nodes: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for t in range(trees):
            at, levels = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                p = sample @ direction(seed, t, level, self.dims) if self.dims else np.zeros(len(sample))
                n = 1 << min(level, self.fitted)
                cut, margin, whole = np.zeros(n), np.zeros(n), np.zeros(n, bool)
                for k in range(n):
                    here = at == k if level < self.fitted else np.ones(len(p), bool)
                    own = p[here]
                    if len(own):
                        cut[k], margin[k] = np.median(own), max(least, spill * own.std())
                        if level < self.fitted and len(own) > 1:  # the mean cosine of its pairs
                            whole[k] = (np.square(sample[here].sum(axis=0)).sum() - len(own)) / (len(own) * (len(own) - 1)) >= dense
                levels.append((cut, margin, whole))
                if level < self.fitted:
                    at = at * 2 + (p > cut[at])
            self.nodes.append(levels)

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) memberships of unit vectors x, row i down to its depth[i]; leaves of all trees have numbers of their own."""
        rows_out, leaf_out = [], []
        for t in range(self.trees):
            rows, path = np.arange(len(x)), np.ones(len(x), np.int64)
            for level in range(int(depth.max(initial=0))):
                going = depth[rows] > level
                rows_out.append(rows[~going])
                leaf_out.append(path[~going] * self.trees + t)
                rows, path = rows[going], path[going]
                p = (x @ direction(self.seed, t, level, x.shape[1]))[rows]
                if x.shape[1] == self.dims and level < self.depth:
                    cut, margin, whole = self.nodes[t][level]
                    k = path - (1 << level) if level < self.fitted else np.zeros(len(path), np.int64)
                    ends = whole[k]
                    rows_out.append(rows[ends])
                    leaf_out.append(path[ends] * self.trees + t)
                    rows, path, p, k = rows[~ends], path[~ends], p[~ends], k[~ends]
                    c, m = cut[k], margin[k]
                else:
                    c, m = np.zeros(len(p)), np.full(len(p), self.spill / math.sqrt(x.shape[1]))
                left, right = p <= c + m, p > c - m
                rows, path = np.concatenate([rows[left], rows[right]]), np.concatenate([path[left] * 2, path[right] * 2 + 1])
            rows_out.append(rows)
            leaf_out.append(path * self.trees + t)
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def _valid(kind: str):
    """kind: numpy's name of the input's number type, in which vectors travel; they become unit vectors in double precision where they are used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for v, label in zip(batch.column("embedding").to_pylist(), batch.column("label"), strict=True):
                key = raw = None
                if v and label.is_valid and None not in v:
                    x = np.array(v, np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        raw = x.astype(kind).tobytes()
                        key = hashlib.md5(x.tobytes()).digest()
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "key", "raw"])

    return run


def units(raws: list, kind: str) -> np.ndarray:
    """Unit vectors, a row each, of vectors of one length."""
    x = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(forest: Forest, leaf: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            sizes = np.array(batch.column("label_n").to_pylist(), np.int64)
            depth = np.ceil(np.log2(np.maximum(1, sizes / leaf))).clip(0, MAX_DEPTH).astype(np.int64)
            lists: list[np.ndarray | None] = [None] * len(raws)
            for size in {len(r) for r in raws}:
                own = np.array([i for i, r in enumerate(raws) if len(r) == size])
                rows, leaves = forest.leaves(units([raws[i] for i in own], kind), depth[own])
                order = np.lexsort((leaves, rows))
                ends, leaves = np.searchsorted(rows[order], np.arange(len(own) + 1)), leaves[order]
                for i, a, b in zip(own, ends, ends[1:], strict=False):
                    lists[i] = leaves[a:b]
            names = ["label", "rep", "n", "raw"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lists, pa.list_(pa.int64()))], names=[*names, "leaves"])

    return run


def compare(frame: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """One block, or two blocks against each other, of one leaf: (rep, cnt, root) for members with links.

    cnt: copies that the member's new links lead to; a link is new in the first leaf that its ends share. root: the smallest rep
    that links within these rows reach. Rows out grow with members, however many pairs link.
    """
    leaf, i, j = (int(frame[c].iloc[0]) for c in ("leaf", "i", "j"))
    out: list[pd.DataFrame] = []
    for _, own in frame.groupby(frame["raw"].str.len(), sort=True):
        own = own.sort_values("rep")
        x = units(own["raw"].tolist(), kind)
        n, rep, block = own["n"].to_numpy(np.int64), own["rep"].to_numpy(np.int64), own["block"].to_numpy(np.int64)
        m = len(own)
        before = [np.array([v for v in row if v < leaf]) for row in own["leaves"]]
        earlier, hits = np.unique(np.concatenate(before) if before else np.array([]), return_counts=True)
        shared = earlier[hits > 1]
        held = np.zeros((m, len(shared)), np.float32)
        for r, row in enumerate(before):
            k = np.searchsorted(shared, row)
            ok = k < len(shared)
            k, row = k[ok], row[ok]
            held[r, k[shared[k] == row]] = 1
        link = np.zeros((m, m), bool)
        cnt = np.zeros(m, np.int64)
        for a in range(0, m, 256):
            near = x[a : a + 256] @ x.T >= threshold
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            if i != j:
                near &= block[a : a + 256, None] != block[None]
            link[a : a + 256] = near
            if near.any():
                new = near & ~(held[a : a + 256] @ held.T > 0) if len(shared) else near
                cnt[a : a + 256] = new @ n
        has = link.any(axis=1)
        if not has.any():
            continue
        root = np.arange(m)  # rows are in order of rep
        while True:
            down = root.copy()
            for a in range(0, m, 256):
                down[a : a + 256] = np.minimum(root[a : a + 256], np.where(link[a : a + 256], root[None], m).min(axis=1))
            down = down[down]
            if (down == root).all():
                break
            root = down
        out.append(pd.DataFrame({"rep": rep[has], "cnt": cnt[has], "root": rep[root[has]]}))
    return pd.concat(out) if out else pd.DataFrame({"rep": [], "cnt": [], "root": []}, dtype="int64")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label; other columns are not read).

    Vectors of equal label and length are compared. Equal ones are one, with a count, from the start: a group of copies costs nothing
    however large. The distinct ones go down every tree; those that share a leaf are compared in double precision, so no link is
    below the threshold; a pair of which no tree has a common leaf is missed (recall over brute force is tested). Leaves over
    `block` members are compared block by block, each vector copied once a block. Links leave a task as counts and one root for
    each member, never as pairs. Null, empty, zero, non-finite vectors, and null labels, link with nothing: 0 links, their own component.
    Repeated rows are vectors of their own; a null vec_id never names a component; no rows give no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    base = written(base.mapInArrow(_valid(kind), "vec_id long, label long, key binary, raw binary"))
    # a row without vec_id needs a stand-in below every id, so that copies of it still meet
    own = F.coalesce("vec_id", F.lit(-(1 << 63)).cast("long") + F.pmod(F.xxhash64("label", "key"), F.lit(1 << 40)))
    reps = written(base.where("key is not null").groupBy("label", "key").agg(F.min(F.coalesce("vec_id", own)).alias("rep"), F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("raw").alias("raw")))
    per_label = written(reps.groupBy("label").agg(F.count("*").alias("label_n")))
    largest = per_label.agg(F.max("label_n")).first()[0] or 0
    some = [units([bytes(r.raw)], kind)[0] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("raw").collect()]
    dims = max({len(s) for s in some}, key=lambda d: (sum(len(s) == d for s in some), d), default=0)
    fitted = np.stack([s for s in some if len(s) == dims]) if dims else np.zeros((0, 0))
    forest = Forest(fitted, min(MAX_DEPTH, math.ceil(math.log2(max(1, largest / leaf)))), trees, spill, threshold=threshold)
    placed = written(
        reps.join(per_label.withColumnRenamed("label", "l"), F.col("label") == F.col("l")).select("label", "rep", "n", "raw", "label_n").mapInArrow(_assign(forest, leaf, kind), "label long, rep long, n long, raw binary, leaves array<long>")
    )
    crowded = placed.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").agg(F.count("*").alias("size"))
    crowded = written(crowded.where(F.col("size") > 1).select("label", "leaf", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    member = placed.select("label", "rep", "n", "raw", "leaves", F.explode("leaves").alias("leaf")).join(crowded, ["label", "leaf"])
    own_block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = member.withColumn("block", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    schema = "rep long, cnt long, root long"
    found = written(dealt.groupBy("label", "leaf", "i", "j").applyInPandas(lambda f: compare(f, threshold, kind), schema))
    counts = found.groupBy("rep").agg(F.sum("cnt").alias("cnt"))
    roots = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    named = reps.select("label", "key", "rep", "first_id", "n").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(best, "root").select("label", "key", (F.col("n") - 1 + F.coalesce("cnt", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def brute(rows: list[tuple], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """vec_id: (n_links, component_id) over all pairs, for tests. rows: (vec_id, embedding, label) with distinct vec_id."""

    def unit(v):
        if not v or None in v:
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None

    ok = [(k, u, label) for k, v, label in rows if label is not None and (u := unit(v)) is not None]
    links: dict[int, set[int]] = {k: set() for k, _, _ in rows}
    for a, (k, u, label) in enumerate(ok):
        for q, w, other in ok[:a]:
            if label == other and len(u) == len(w) and u @ w >= threshold:
                links[k].add(q)
                links[q].add(k)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for q in links[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        out[k] = (len(links[k]), min(seen))
    return out


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings at THRESHOLD."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
