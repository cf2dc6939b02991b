"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Fixed patterns of the base kinds. Java's, Python's and RE2's engines find the same leftmost matches of them.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that mean little alone: an identifier, a secret without a name, an endpoint.
IDENT = r"""(?i:(access_?key_?id|client_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})"""
BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"(?i:https?|wss?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@-]+"
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
#: Characters between two parts of one scope, at most.
SCOPE = 200
#: In a text without one of these no pattern matches.
_ANY = r"(?i)passw|secret|token|api_?key|akia|key_?id|client_?id|account_?id|user_?name|login|://|[0-9a-z+/]{24}"


#: Array elements that one aggregation appends one by one; longer arrays are worked in blocks of so many.
BLOCK = 64
#: The shortest span of a weak kind, in characters: of one kind so many spans can't start closer.
SHORTEST = 6


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column) -> Column:
    n = F.ceil(F.size(values) / F.lit(BLOCK)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return each


def _sums(values: Column, start: Column) -> Column:
    """start plus the running sums of a few values."""
    empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, empty, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])


def _running(values: Column) -> Column:
    """Running sums of any number of values: within blocks, from the running sums of the blocks."""

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
        upto = F.concat(F.array(F.lit(0)), _sums(totals, F.lit(0)))
        return _let(upto, lambda u: F.flatten(F.transform(blocks, lambda x, i: _sums(x, F.get(u, i)))))

    return _let(values, lambda v: _let(_blocks(v), of_blocks))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """(s, k, e, m) of all matches, in code points: split and matches alternate, so their running lengths are the places."""
    gaps = F.transform(F.split(text, pattern), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: g + F.char_length(x))
        span = lambda e, x: F.struct((e - F.char_length(x)).alias("s"), F.lit(kind).alias("k"), e.alias("e"), x.alias("m"))
        return F.when(F.size(m) > 0, F.zip_with(_running(steps), m, span)).otherwise(_none())

    return _let(found, placed)


def _value(match: Column, pattern: str) -> Column:
    return F.regexp_extract(match, pattern, 2)


def _none() -> Column:
    return F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")


_SHIFT = 1 << 32


def _reached(parts: Column, others: Column, scope: int, forward: bool) -> Column:
    """Parts (as s * 2^32 + e) that have one of others at most `scope` characters before them, or after them, ends touching or apart.

    A sorted sweep: in one order of all places, what decides for a part is the last of the others before it. Between the two are
    only parts of the same kind, and within the scope of those only so many.
    """
    at = (lambda x: -x["s"], lambda x: -x["e"]) if forward else (lambda x: x["e"], lambda x: x["s"])
    told = F.transform(others, lambda o: F.struct(at[0](o).alias("at"), F.lit(0).cast("long").alias("part")))
    asked = F.transform(parts, lambda x: F.struct(at[1](x).alias("at"), (x["s"] * F.lit(_SHIFT) + x["e"]).alias("part")))
    back = scope // SHORTEST + 2

    def sweep(all_: Column) -> Column:
        def found(y: Column, i: Column) -> Column:
            earlier = F.slice(all_, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))
            return F.when((y["part"] != 0) & F.exists(earlier, lambda z: (z["part"] == 0) & (z["at"] >= y["at"] - scope)), y["part"])

        return F.filter(F.transform(all_, found), lambda v: v.isNotNull())

    return _let(F.array_sort(F.concat(told, asked)), sweep)


def _near(parts: Column, others: Column, scope: int) -> Column:
    """Interval join inside a row: the parts (as s * 2^32 + e) that have one of others within `scope` characters before or after them."""
    both = F.array_union(_reached(parts, others, scope, False), _reached(parts, others, scope, True))
    return F.when((F.size(parts) > 0) & (F.size(others) > 0), both).otherwise(F.array().cast("array<bigint>"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with `_tm_base` and `_tm_all`: arrays of (s, k, e) in code points, end exclusive, k an index of KINDS, ordered by (s, k, e).

    Base kinds stand by themselves. The weak kinds are joined by intervals to the other parts of their text: an identifier or an
    unnamed 40-character secret is reported only when the other (or an access identifier, or an assigned secret) lies within
    `scope` characters, before or after it; an endpoint only when both an identifier and a secret do. Everything happens inside a row: parts of
    one text never leave it, so no key can grow hot, and the result has the rows of docs, repeated ones too. Null and empty texts have no spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.withColumn("_tm_text", F.when(text.rlike(_ANY), text).otherwise(F.lit("")))
    t = F.col("_tm_text")
    has = {
        "assign": r"(?i)passw|secret|token|api_?key",
        "access": "AKIA",
        "hex": HEX,
        "ident": r"(?i)key_?id|client_?id|account_?id|user_?name|login",
        "blob": BLOB,
        "endpoint": "://",
    }
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, BLOB, ENDPOINT), strict=True))
    got = seen.withColumns({f"_tm_{k}": F.when(t.rlike(has[k]), _spans(t, p, i)).otherwise(_none()) for i, (k, p) in enumerate(patterns.items())})
    got = got.withColumn("_tm_assign", F.filter("_tm_assign", lambda x: F.char_length(_value(x["m"], ASSIGN)) >= 6))
    a, c, h, i, b, n = (F.col(f"_tm_{k}") for k in KINDS)
    parts = got.withColumns({"_tm_ids": F.concat(c, i), "_tm_keys": F.concat(a, b)})
    ids, keys = F.col("_tm_ids"), F.col("_tm_keys")
    spans = lambda found, kind: F.transform(found, lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("s"), F.lit(kind).alias("k"), v.bitwiseAND(F.lit(_SHIFT - 1)).cast("int").alias("e")))
    weak = F.concat(
        spans(_near(i, keys, scope), 3), spans(_near(b, ids, scope), 4), spans(F.array_intersect(_near(n, ids, scope), _near(n, keys, scope)), 5)
    )
    bare = lambda found: F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.concat(a, c, h)
    out = parts.withColumns({"_tm_base": F.array_sort(bare(base)), "_tm_all": F.array_sort(F.concat(bare(base), weak))})
    return out.drop("_tm_text", "_tm_ids", "_tm_keys", *[f"_tm_{k}" for k in KINDS])


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with each stretch that spans cover replaced by `mark`; n_chars follows the text; other columns and all rows stay."""
    found = find(docs)
    spans, text = F.col("_tm_all"), F.col("text")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    but_last = lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))

    def one_more(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        joins = (F.size(acc) > 0) & (x["s"] < last["e"])
        return F.when(joins, F.concat(but_last(acc), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    def block_more(acc: Column, block: Column) -> Column:
        """Both are apart and in order: of the block only what ends after acc counts, and only the first of that can join its last."""
        last = F.get(acc, F.size(acc) - 1)

        def append(new: Column) -> Column:
            head = F.get(new, F.lit(0))
            grown = F.struct(last["s"].alias("s"), head["e"].alias("e"))
            joins = (F.size(acc) > 0) & (F.size(new) > 0) & (head["s"] < last["e"])
            return F.when(joins, F.concat(but_last(acc), F.array(grown), F.slice(new, 2, F.greatest(F.size(new) - 1, F.lit(0))))).otherwise(F.concat(acc, new))

        return _let(F.filter(block, lambda x: F.coalesce(x["e"] > last["e"], F.lit(True))), append)

    merged = F.aggregate(F.transform(_blocks(spans), lambda x: F.aggregate(x, empty, one_more)), empty, block_more)
    joined = found.withColumn("_tm_m", F.when(F.size(spans) > 0, merged))
    m = F.col("_tm_m")
    before = F.transform(m, lambda x, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"]) + 1, x["s"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"])))
    rest = F.substring(text, F.element_at(m, -1)["e"] + 1, F.char_length(text))
    out = joined.withColumn("text", F.when(m.isNotNull(), F.array_join(F.concat(before, F.array(rest)), mark)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(m.isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find() over all documents, as counts, a digest of the base spans, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("_tm_base")
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_tm_all")).alias("spans"))
