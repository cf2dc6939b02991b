"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, table, written
from tidemark.llm.components import components

BITS = 64
RADIUS = 2
WIDTH = 3
SEED = 42
#: Near-duplicate texts of deduplicate(): words of a shingle, and the least Jaccard coefficient of their distinct shingles.
NEAR_WIDTH, SIMILARITY = 5, 0.8
#: A part ends before a shingle whose hash is a multiple of PART, but has LEAST_PART shingles (the last of a text: one) at least.
PART, LEAST_PART = 16, 8
#: Pairs whose whole texts' fingerprints differ in more bits aren't compared: at a Jaccard coefficient of 0.8 a bit differs with probability 0.152, so more than these of 64 do with one of 2 in a million.
FAR_BITS = 24
#: A bucket's texts are compared with so many of them first, those that meet most others: with the first, then, where no link has joined them yet, with the rest. meeting() settles what is apart then.
LEADS = 24
#: meeting() takes a text as its difference from a lead where that has at most HOME of the text's size; it looks for leads so many times.
HOME, ROUNDS = 0.5, 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of which, for any `radius` bit positions, one avoids them all.

    Position i gets a nonzero vector phi(i) of radius+1 bits; the mask of v holds the positions with odd <phi(i), v>. For
    `radius` positions the equations <phi(i), v> = 0 leave a nonzero v: its mask has none of them, so two fingerprints
    that differ only there agree under it. Vectors are dealt evenly, so each mask keeps about 4/7 of the bits at radius 2.
    """
    n = (1 << (radius + 1)) - 1
    phi = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of a text's word shingles, in order. words as bytes, lower-cased: only A-Z change, only the six ASCII spaces part words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)] if words else [], "<u8")
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)), "<u8", len(words) - width + 1)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """Per bit, how many of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _vote(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def parted(hashes: np.ndarray) -> tuple[int, list[int]]:
    """The fingerprints of a text with shingles and of its parts. Where parts end depends on the shingles alone, so a change in a text changes the parts around it only."""
    starts = [0]
    for k in np.flatnonzero(hashes % PART == 0).tolist():
        if k - starts[-1] >= LEAST_PART:
            starts.append(k)
    starts.append(len(hashes))
    ones, prints, at = np.zeros(BITS, np.int64), [], 0
    while at < len(starts) - 1:
        to = at + 1
        while to < len(starts) - 1 and starts[to + 1] - starts[at] <= 1 << 16:
            to += 1
        block = hashes[starts[at] : starts[to]]
        if to == at + 1:
            sums = _ones(block)[None]
        else:
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.array(starts[at:to]) - starts[at], axis=0, dtype=np.int64)
        sizes = np.diff(starts[at : to + 1])
        prints += np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().tolist()
        ones += sums.sum(axis=0)
        at = to
    return _vote(ones, len(hashes)), prints


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; 0 without words."""
    hashes = shingles((text or "").encode().lower().split(), width)
    return _vote(_ones(hashes), len(hashes)) if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def links(uniq: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints `fp` of uniq at `radius` 2 or fewer differing bits.

    Covering tables name the buckets that two or more fingerprints share; only their members go on. In a bucket, members
    differ outside its mask alone, and two differ in at most two bits if and only if their one-bit neighbourhoods meet.
    So each member is filed under itself and its flips at the bits outside the masks it shares; no key holds over 65 fingerprints,
    however large the bucket, and work grows with members, not with pairs.
    """
    if radius != 2:
        raise ValueError("the one-bit neighbourhoods that settle a bucket are for radius 2")
    masks = covering_masks(radius=radius)
    fp = F.col("fp")
    keyed = uniq.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "masked"))
    crowded = keyed.groupBy("t", "masked").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "masked")
    members = keyed.join(crowded, ["t", "masked"], "left_semi")
    outside = F.array(*[F.lit(_signed(~m & (1 << BITS) - 1)) for m in masks])
    free = members.select("fp", F.get(outside, F.col("t")).alias("free")).groupBy("fp").agg(F.bit_or("free").alias("free"))
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: bit.bitwiseAND(F.col("free")) != 0)
    near = free.select("fp", F.explode(F.concat(F.array(fp), F.transform(bits, lambda bit: fp.bitwiseXOR(bit)))).alias("near"))
    balls = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return pairs.where("a != b").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) per row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id reachable over links of at most two differing fingerprint bits, itself included.
    A null or wordless text has fingerprint zero and is linked like any other; texts under three words hash whole; repeated
    rows stay, each with its group; a null doc_id never names a group, and a group without any doc_id has null; no rows give no rows.
    """
    prints = written(fingerprints(docs))
    uniq = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(uniq))
    linked = uniq.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = linked.groupBy("root").agg(F.min("first_id").alias("best"))
    better = linked.join(best, "root").select("fp", "best")
    named = written(uniq.join(better, "fp", "left").select("fp", F.coalesce("best", "first_id").alias("component_id")))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["doc_id", "text_hash", "node", "fp", "n", "shingles", "prints"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[list] = [[] for _ in names[2:]]
                for text in some.column("text"):
                    own = (text.as_py() or "").encode().lower().split()
                    hashes = shingles(own, width)
                    fp, prints = parted(hashes) if len(hashes) else (0, [])
                    distinct = np.unique((hashes >> np.uint64(32)).astype("<u4")).view("<i4")
                    both = {_signed(p) for p in (fp, *prints)}
                    for to, x in zip(rows, (_signed(xxhash.xxh64_intdigest(b" ".join(own), fp)), _signed(fp), len(distinct), distinct, sorted(both)), strict=True):
                        to.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=names)

    return run


def _keys(sets: DataFrame) -> DataFrame:
    """Keys (frame, shingle, node, root, n, size, home, far, place, score) of sets (frame, node, root, n, size, least, home, far, elements).

    In a frame's order of elements, rarest first, two sets with `least` common elements or more share one of the first size - least + 1
    of each; place is the key's place in that order. An element of one set alone takes a place there and is no key. score: in how many
    sets an element of this one is, on average.
    """
    occurs = sets.select("frame", "node", F.explode("elements").alias("shingle"))
    often = occurs.groupBy("frame", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    rare = occurs.join(often, ["frame", "shingle"]).groupBy("frame", "node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    alone = F.col("size") - F.size("rare")
    score = (F.aggregate("rare", F.lit(0).cast("long"), lambda total, x: total + x["df"]) + alone) / F.col("size")
    told = sets.drop("elements").join(rare, ["frame", "node"]).withColumns({"first": (F.size("rare") - F.col("least") + 1).cast("int"), "alone": alone, "score": score})
    each = told.where("first > 0").select("frame", "node", "root", "n", "size", "home", "far", "alone", "score", F.posexplode(F.slice("rare", 1, F.col("first"))).alias("at", "key"))
    return each.select("frame", "key.shingle", "node", "root", "n", "size", "home", "far", (F.col("alone") + F.col("at") + 1).alias("place"), "score")


def _met(keys: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, lead) of different roots that a key brings together and that can be alike by the places it has in both.

    Pairs without a far text are united by their lead, those without a home text are settled elsewhere. Pairs within the root that most
    texts of a key have aren't made.
    """
    on = ["frame", "shingle"]
    most = keys.groupBy(*on, "root").agg(F.count("*").alias("c")).groupBy(*on).agg(F.max(F.struct("c", "root"))["root"].alias("most"))
    few = keys.join(most, on).where("root != most")
    others = keys.select(*on, *(F.col(c).alias(f"lead_{c}") for c in ("node", "root", "n", "size", "home", "far", "place")))
    both = _least_common(F.col("size") + F.col("lead_size"), F.col("n") + F.col("lead_n"), similarity)
    placed = (F.col("place") + both <= F.col("size") + 1) & (F.col("lead_place") + both <= F.col("lead_size") + 1)
    sized = F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n")
    open_ = (F.col("root") != F.col("lead_root")) & (F.col("far") | F.col("lead_far")) & (F.col("home") | F.col("lead_home"))
    pairs = few.join(others, on).where(open_ & sized & placed)
    return pairs.select(F.least("node", "lead_node").alias("node"), F.greatest("node", "lead_node").alias("lead"))


def _apart(similarity: float) -> float:
    """Two sets with a Jaccard coefficient of `similarity` or more differ in at most this share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


def _least_common(sizes: Column, n: Column, similarity: float) -> Column:
    """What two sets' differences from a third, of these sizes together, have in common at least, if the sets, of n elements together, are alike."""
    return F.ceil((sizes - _apart(similarity) * n) / 2 - 1e-9)


def meeting(texts: DataFrame, similarity: float, crowd: int = LEADS + 1, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (node, lead) of texts (node, root, shingles) with different roots, with all that a Jaccard coefficient of `similarity`
    joins, but for pairs whose texts both are joined with a third by others of the pairs.

    Two such texts share `similarity` of the shingles of either, so they meet by their rarest shingles (_keys()). A passage in many texts
    comes last, so texts that have little else in common don't meet. Keys of up to `crowd` texts are joined as they are. Those of more
    texts come from edits of one text, that share most of it and are mostly not alike; their pairs would grow with the square of the group.
    So of the texts that such keys connect one is the lead, and they go on as their differences from it. The difference of two
    texts is that of their differences. Texts that differ little from the lead are joined with it; of any other pair one text is far from
    the lead, and what they have in common beside the lead must make up for that: half of the difference of either or more. An edit's
    own words are in no other text, so few differences meet. A text whose difference is at most HOME of its size has all that it can be
    alike with in that frame, by the triangle inequality; the others go on to the next round, with their own leads. Those that
    `rounds` leave are joined by their shingles.
    """
    c, n = _apart(similarity), F.size("shingles")
    true = F.lit(True)
    whole = texts.select(F.lit(0).cast("long").alias("frame"), "node", "root", n.alias("n"), n.alias("size"), F.ceil(similarity * n - 1e-9).alias("least"), true.alias("home"), true.alias("far"), F.col("shingles").alias("elements"))
    left = written(_keys(whole))
    found, keys = [], []
    for k in range(rounds + 1):
        crowded = left.groupBy("shingle").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("a")).where((F.col("c") > crowd) & (F.col("lo") < F.col("hi")))
        crowded = written(crowded.select("shingle", "a"))
        if k == rounds or crowded.isEmpty():
            keys.append(left)
            break
        keys.append(left.join(crowded, "shingle", "left_anti"))
        left = written(left.join(crowded, "shingle", "left_semi"))
        same = components(left.join(crowded, "shingle").select("a", F.col("node").alias("b")))
        scored = left.groupBy("node").agg(F.first("score").alias("score")).join(same.withColumnRenamed("root", "same"), "node")
        leads = scored.groupBy("same").agg(F.max(F.struct("score", "node"))["node"].alias("frame"))
        framed = scored.join(leads, "same").select("node", "frame")
        lead = texts.select(F.col("node").alias("frame"), F.col("root").alias("lead_root"), F.col("shingles").alias("lead_shingles"))
        both = framed.join(leads.select("frame").join(lead, "frame"), "frame").join(texts, "node").select("frame", "lead_root", "node", "root", n.alias("n"), F.size("lead_shingles").alias("lead_n"), F.concat(F.array_except("shingles", "lead_shingles"), F.array_except("lead_shingles", "shingles")).alias("elements"))
        both = both.withColumn("size", F.size("elements")).where(F.col("size") <= (HOME / similarity + c * (1 + 1 / similarity)) * F.col("n") + 1e-9)
        common = (F.col("n") + F.col("lead_n") - F.col("size")) / 2
        both = both.withColumns({"far": ~(common >= similarity * (F.col("n") + F.col("lead_n") - common)), "home": F.col("size") <= HOME * F.col("n")})
        with_far = F.ceil((F.col("size") + c * (F.col("lead_n") - F.col("n"))) / 2 - 1e-9)
        with_any = F.ceil(F.col("size") - c * (1 + 1 / similarity) * F.col("n") - 1e-9)
        both = written(both.withColumn("least", F.greatest(F.lit(1), F.when(F.col("far"), F.least(with_far, with_any)).otherwise(with_far))))
        found.append(both.where(~F.col("far") & (F.col("root") != F.col("lead_root"))).select("node", F.col("frame").alias("lead")))
        keys.append(_keys(both.drop("lead_root", "lead_n")))
        left = written(left.join(both.where("home").select("node"), "node", "left_anti"))
    found.append(_met(written(reduce(DataFrame.unionByName, keys)), similarity))
    return reduce(DataFrame.unionByName, found).distinct()


def near_groups(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, leads: int = LEADS) -> DataFrame:
    """(doc_id, text_hash, component_id) per row of docs (doc_id, text; other columns are not read): groups by links of texts whose distinct
    shingles have a Jaccard coefficient of `similarity` or more.

    Covering tables find the texts whose fingerprints differ in `radius` bits or fewer. Texts of that similarity often differ in more
    (about 10 of 64 at 0.8), too many for covering masks, but then many of their parts don't differ at all. So a text is filed under its
    class of the covering tables and under the fingerprints of its parts, and texts that meet are compared by their shingles, exactly.
    In a bucket of up to `leads` + 1 texts these are all pairs; in a larger one, all with those that meet most others first (the original
    of many copies is one). What then is still apart in larger buckets is settled by meeting(), which loses no pair of that similarity.
    Alike texts are one from the start, so copies cost nothing. Nulls, texts without words and repeated rows are as in groups(): texts
    without words are alike; component_id is the group's smallest doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    all_ = written(rows.mapInArrow(_sketches(width), "doc_id long, text_hash long, node long, fp long, n long, shingles array<int>, prints array<long>"))
    nodes = written(all_.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    classes = components(links(nodes.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), F.col("root").alias("bucket"))
    filed = written(all_.select("node", F.explode("prints").alias("bucket")).unionAll(nodes.join(classes, "fp").select("node", "bucket")).distinct())
    shared = filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sized = written(filed.join(shared, "bucket"))
    forget(filed)
    meets = sized.groupBy("node").agg(F.sum("size").alias("meets"))
    member = written(sized.join(meets, "node").select("bucket", "node", "meets"))
    forget(sized)
    told = nodes.select("node", "fp", "n")
    order = Window.partitionBy("bucket").orderBy(F.col("meets").desc(), "node")
    led = written(member.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leads).select("bucket", F.col("node").alias("lead"), "place"))
    lead_told = told.select(F.col("node").alias("lead"), F.col("fp").alias("lead_fp"), F.col("n").alias("lead_n"))

    def texts(ids: DataFrame) -> DataFrame:
        """(node, shingles) of ids (node)."""
        return all_.join(ids, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Links among pairs (node, lead), by their shingles; only texts of pairs travel."""
        pairs = written(pairs)
        ids = written(pairs.select(F.explode(F.array("node", "lead")).alias("node")).distinct())
        own = written(texts(ids))
        both = pairs.join(own.select(F.col("node").alias("lead"), F.col("shingles").alias("lead_shingles")), "lead").join(own, "node")
        common = F.size(F.array_intersect("shingles", "lead_shingles"))
        near = common >= similarity * (F.size("shingles") + F.size("lead_shingles") - common)
        found = written(both.where(near).select(F.col("node").alias("a"), F.col("lead").alias("b")))
        for done in (pairs, ids, own):
            forget(done)
        return found

    def close(met: DataFrame) -> DataFrame:
        """Pairs of met (node, lead) that can be alike by their sizes and whole fingerprints."""
        both = met.distinct().join(told, "node").join(lead_told, "lead")
        sizes = F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n")
        return both.where(sizes & (F.bit_count(F.col("fp").bitwiseXOR(F.col("lead_fp"))) <= FAR_BITS)).select("node", "lead")

    joined = alike(close(member.join(led.where("place = 1"), "bucket").where("node != lead").select("node", "lead")))
    roots = components(joined)
    apart = member.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    split = apart.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    lead_roots = roots.select(F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    others = led.where("place > 1").join(lead_roots, "lead", "left").select("bucket", "lead", F.coalesce("lead_root", "lead").alias("lead_root"))
    met = written(apart.join(split, "bucket").join(others, "bucket").where("root != lead_root").select("node", "lead").distinct())
    if not met.isEmpty():
        joined = written(joined.unionAll(alike(close(met))))
        roots = components(joined)
    apart = member.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    large = apart.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    rest = written(apart.join(large.where((F.col("size") > leads + 1) & (F.col("lo") < F.col("hi"))), "bucket").select("node", "root").distinct())
    if not rest.isEmpty():
        own = written(texts(rest.select("node")))
        joined = written(joined.unionAll(alike(meeting(own.join(rest, "node"), similarity))))
        forget(own)
        roots = components(joined)
    named = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(best, "root").select("node", "component_id")
    return all_.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", "component_id")


def deduplicate(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near_groups(): the one whose doc_id names it.

    All columns of docs stay. Of rows alike in doc_id and text one stays; of a group in which no row has a doc_id, one row for each text.
    """
    chosen = near_groups(docs, width, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = chosen.groupBy(F.col("doc_id").alias("_tm_id"), F.col("text_hash").alias("_tm_hash")).agg(F.count("*").alias("_tm_n"))
    keep = written(keep)
    own = docs.withColumns({"_tm_own": F.xxhash64("text"), "_tm_doc": F.col("doc_id").cast("long")})
    both = own.join(keep, F.col("_tm_doc").eqNullSafe(F.col("_tm_id")) & (F.col("_tm_own") == F.col("_tm_hash")))
    kept = both.where("_tm_n = 1").unionAll(both.where("_tm_n > 1").dropDuplicates(["_tm_doc", "_tm_own"]))
    return kept.select(*docs.columns)


def brute_links(prints: list[int], radius: int = RADIUS) -> set[tuple[int, int]]:
    """All index pairs within the radius, for tests."""
    return {(i, j) for (i, x), (j, y) in combinations(enumerate(prints), 2) if (x ^ y).bit_count() <= radius}


def brute_near(texts: list[str | None], width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> set[tuple[int, int]]:
    """All index pairs of texts of that similarity, for tests."""
    sets = [set(shingles((t or "").encode().lower().split(), width).tolist()) for t in texts]
    return {(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(x & y) >= similarity * len(x | y)}


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups() of all documents, fingerprints as hex digits."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
