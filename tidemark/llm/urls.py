"""URL filters by a sorted digest array."""

from __future__ import annotations

import heapq
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import own_dir, table

MAGIC = b"TMURL002"
_HEAD = struct.Struct("<8sQQQQ")
#: Of the digests, as in Spark's xxhash64.
SEED = 42
#: Production rules: (rule, verdict); a rule is host/path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Listed hosts, whole, subdomains too, that no rule speaks of.
LISTED = ("spam-farm.example.org", "cheap-pills.example.com", "casino.example.net", "adult.example.com", "malware.example.org")
#: An index file over this size isn't shipped to every executor.
MAX_BYTES = 4 << 30


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry, SEED)


def build(path: str, entries: Iterable[tuple[str, str, str]], listed: Iterable[tuple[int, str]] = ()) -> None:
    """Writes an index to path from entries (entry, verdict, shown), few, and listed (digest, entry), any number, ascending, blocked and without a name.

    An entry is host/path-prefix. File: magic, entries, path lengths in use, numbers of host labels in use, blob size; keys (ascending 64-bit
    xxhash of the entry), 64-bit offsets into the blob (one more than keys), path lengths, label numbers (64-bit), blob of entry, tab,
    verdict, tab, shown. Of an entry given twice the first counts, a named one before a listed one.
    """
    unique = {}
    for entry, verdict, shown in entries:
        unique.setdefault(entry, (verdict, shown))
    named = sorted((digest(e), not v[1], "\t".join((e, *v)).encode()) for e, v in unique.items())
    more = ((k, True, f"{e}\tblock\t".encode()) for k, e in listed)
    lengths, labels, n, at = set(), set(), 0, 0
    with tempfile.TemporaryFile(dir=os.path.dirname(path)) as keys, tempfile.TemporaryFile(dir=os.path.dirname(path)) as offsets, tempfile.TemporaryFile(dir=os.path.dirname(path)) as blob:
        for key, _, row in heapq.merge(named, more):
            entry = row.split(b"\t", 1)[0].decode()
            host = entry[: entry.index("/")]
            lengths.add(len(entry) - len(host))
            labels.add(host.count(".") + 1)
            keys.write(struct.pack("<Q", key))
            offsets.write(struct.pack("<Q", at))
            blob.write(row)
            n, at = n + 1, at + len(row)
            if 16 * n + at > MAX_BYTES:
                raise ValueError(f"the index is over {MAX_BYTES} bytes; split the list by digest range and filter once per part")
        offsets.write(struct.pack("<Q", at))
        with open(path, "wb") as out:
            out.write(_HEAD.pack(MAGIC, n, len(lengths), len(labels), at))
            for part in (keys, offsets):
                part.seek(0)
                shutil.copyfileobj(part, out)
            out.write(np.array(sorted(lengths), "<u8").tobytes())
            out.write(np.array(sorted(labels), "<u8").tobytes())
            blob.seek(0)
            shutil.copyfileobj(blob, out)


def ascending(hosts: DataFrame) -> Iterator[tuple[int, str]]:
    """(digest, entry) of the distinct non-empty hosts in the first column, in order of the unsigned digest: Spark sorts, the driver holds one partition at a time."""
    host = F.translate(hosts[hosts.columns[0]].cast("string"), _UPPER, _UPPER.lower())
    rows = hosts.select(F.concat(host, F.lit("/")).alias("entry")).where((F.length("entry") > 1) & ~F.col("entry").rlike(r"[\t\n]|/.*/")).distinct()
    rows = rows.withColumn("digest", F.xxhash64("entry")).orderBy(F.col("digest").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), "entry")
    return ((r.digest & (1 << 64) - 1, r.entry) for r in rows.toLocalIterator())


class Index:
    """An index file, memory-mapped: nothing of it is read but the pages that probes touch."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            magic, n, k, m, size = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not an index of this format")
        at = _HEAD.size
        mapped = np.memmap(path, np.uint8, "r")
        self.keys = mapped[at : at + 8 * n].view("<u8")
        self.offsets = mapped[at + 8 * n : at + 16 * n + 8].view("<u8")
        at += 16 * n + 8
        self.lengths = mapped[at : at + 8 * k].view("<u8").tolist()
        self.labels = mapped[at + 8 * k : at + 8 * (k + m)].view("<u8").tolist()
        self.blob = mapped[len(mapped) - size :] if size else np.zeros(0, np.uint8)

    def probe(self, entries: list[str]) -> list[tuple[str, str] | None]:
        """(verdict, shown) of each entry that is stored, by vectorised binary search over the digests; the stored string decides, so colliding digests do no harm."""
        if not entries or not len(self.keys):
            return [None] * len(entries)
        digests = np.fromiter((digest(e) for e in entries), "<u8", len(entries))
        out: list[tuple[str, str] | None] = [None] * len(entries)
        first = np.searchsorted(self.keys, digests, "left")
        last = np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(last > first):
            for k in range(first[i], last[i]):
                entry, verdict, shown = bytes(self.blob[int(self.offsets[k]) : int(self.offsets[k + 1])]).decode().split("\t")
                if entry == entries[i] and out[i] is None:
                    out[i] = (verdict, shown)
        return out


@cache
def _index(name: str) -> Index:
    return Index(SparkFiles.get(name))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [p for c in "?#" if (p := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    return (rest, "") if cut < 0 else (rest[:cut], rest[cut:])


def _judge(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name)
        for batch in batches:
            parts = [split(u) for u in batch.column("url").to_pylist()]
            parts = [(h.translate(_LOWER), p) for h, p in parts]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                if not host:
                    continue
                for k in index.labels:  # suffixes of so many labels as an entry has, so a host of any length costs what the list asks
                    if k > host.count(".") + 1:
                        break
                    base = ".".join(host.rsplit(".", k)[-k:])
                    for n in index.lengths:
                        if n <= len(path):
                            probes.append(base + path[:n])
                            owner.append(i)
                        elif n == 1 and not path:  # an entry for a whole host fits a url without a path
                            probes.append(f"{base}/")
                            owner.append(i)
            rule: list[str | None] = [None] * len(parts)
            verdict, best = ["allow"] * len(parts), [(-1, -1)] * len(parts)
            for entry, i, got in zip(probes, owner, index.probe(probes), strict=True):
                if got is not None:
                    rank = (1 if got[1] else 0, len(entry))
                    if rank > best[i]:
                        best[i], verdict[i], rule[i] = rank, got[0], got[1] or None
            hosts, paths = ([p[k] for p in parts] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in (hosts, paths, rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"]
            )

    return run


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, listed: Iterable[str] | DataFrame = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages (page_id, url; other columns are not read).

    rules: (host/path, verdict); a rule fits its host and all subdomains if the path starts with its path, the longest fitting
    one wins. Else a listed host, or a subdomain of one, is blocked; the rest is allowed. A null url, or one without ://, has an empty host
    and path and is allowed. Repeated rows are judged each; no rows give no rows. listed: hosts, or a table whose first column has them
    (null, empty and malformed ones are ignored).
    The index is written by the driver, from a table in order of digests without holding it, served as a file and memory-mapped by the
    workers; a row probes one entry for each number of labels and path length in use. Only the two columns are read and nothing is shuffled.
    """
    spark = pages.sparkSession
    entries = [(r, v, r) for r, v in rules]
    if isinstance(listed, DataFrame):
        name = f"tidemark-urls-{uuid.uuid4().hex}.idx"
        build(os.path.join(own_dir(), name), entries, ascending(listed))
    else:
        entries += [(f"{h}/", "block", "") for h in listed]
        name = f"tidemark-urls-{xxhash.xxh64_hexdigest(repr(entries))}.idx"
        if not os.path.exists(os.path.join(own_dir(), name)):
            build(os.path.join(own_dir(), name), entries)
    spark.sparkContext.addFile(os.path.join(own_dir(), name))  # the driver serves its own file to the executors
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(_judge(name), "page_id long, host string, path string, rule string, verdict string")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all pages under RULES and LISTED."""
    return judge(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}', '{v}')" for r, v in RULES)
_LISTED_SQL = ", ".join(f"'{h}'" for h in LISTED)

OP8_SQL = rf"""
WITH r(rhost, rpath, rule, verdict) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_extract(rest, '^[^?#]*'), '^[^/]*(/.*)$', 1, 's') AS path FROM u),
f AS (SELECT p.k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.k)
SELECT page_id, host, path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN len(list_filter([{_LISTED_SQL}], lambda h: host = h OR ends_with(host, '.' || h))) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN f ON p.k = f.k
"""
