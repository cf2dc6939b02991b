"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. File format, integers little-endian:

    block*   entries; an entry is varint shared, varint unshared, varint value size, key suffix, value
             (shared: bytes the key has in common with the one before in the block); then crc32 of the entries, 4 bytes
    index    per block: varint key size, last key, varint offset, varint size with crc
    bloom    bit array over all keys
    footer   8 unsigned 64-bit: index offset, index size, bloom offset, bloom size, entries, ids, id width, probes; then MAGIC

A key is 0x00 for a null doc_id, else 0x01 and the doc_id as big-endian 64-bit with its sign bit flipped, so byte order is number order.
A value is the ids, 2 bytes each (4 where an id needs it; the footer's id width).
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_at_end, shared_dir, table, tokenizer_path
from tidemark.llm.encode import chunks, encoder
from tidemark.llm.encode import rows as texts

MAGIC = b"TMSST001"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<8Q8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(keys: list[bytes], n_bits: int, probes: int) -> np.ndarray:
    """probes x keys bit positions, by double hashing."""
    h = np.array([xxhash.xxh3_128_intdigest(k) & ((1 << 64) - 1) for k in keys], np.uint64)
    g = np.array([xxhash.xxh64_intdigest(k) | 1 for k in keys], np.uint64)
    with np.errstate(over="ignore"):
        return (h[None] + np.arange(probes, dtype=np.uint64)[:, None] * g[None]) % np.uint64(n_bits)


class Writer:
    def __init__(self, out, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> None:
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.at = self.entries = self.ids = 0
        self.block, self.last, self.keys, self.index = bytearray(), b"", [], bytearray()

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        value = np.frombuffer(ids, "<u4").astype(f"<u{self.id_bytes}").tobytes()
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        self.block += struct.pack("<I", zlib.crc32(self.block))
        self.out.write(bytes(self.block))
        self.index += _varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(self.block))
        self.at += len(self.block)
        self.block, self.last = bytearray(), b""

    def finish(self) -> None:
        self._flush()
        n_bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(n_bits, bool)
        for i in range(0, len(self.keys), 1 << 16):
            bloom[_bits(self.keys[i : i + (1 << 16)], n_bits, PROBES).ravel().astype(np.int64)] = True
        packed = struct.pack("<Q", n_bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(bytes(self.index))
        self.out.write(packed)
        self.out.write(_FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(packed), self.entries, self.ids, self.id_bytes, PROBES, MAGIC))


class Reader:
    """A shard by its file: scan() gives all entries, get() the entries of one doc_id by Bloom filter and binary search."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        head = self._at(size - _FOOTER.size, _FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.id_bytes, self.probes, magic = _FOOTER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, at = self._at(index_at, index_size), 0
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.last_keys.append(key)
            self.places.append((offset, length))
        packed = self._at(bloom_at, bloom_size)
        self.n_bits = struct.unpack("<Q", packed[:8])[0]
        self.bloom = np.frombuffer(packed[8:], np.uint8)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(*self.places[k])
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block is damaged")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + own], at + own
            yield key, np.frombuffer(data[at : at + size], f"<u{self.id_bytes}").astype("<u4").tobytes()
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        at = _bits([key], self.n_bits, self.probes).ravel().astype(np.int64)
        return bool((self.bloom[at >> 3] >> (at & 7) & 1).all())

    def get(self, doc_id: int | None) -> list[bytes]:
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            for k in range(bisect.bisect_left(self.last_keys, key), len(self.places)):
                found += [ids for other, ids in self.block(k) if other == key]
                if self.last_keys[k] > key:
                    break
        return found


def _writes(folder: str, path: str, cut: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path, cut), TaskContext.get().partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        name, part = f"shard-{shard:06d}.sst", f"{root}/.part-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            to = Writer(out, 2 if code.tokenizer.get_vocab_size() <= 1 << 16 else 4)
            for some in chunks(texts(batches)):
                for (doc_id, _), ids in zip(some, code.encode([t for _, t in some]), strict=True):
                    to.add(key_of(doc_id), ids + end)
            to.finish()
        store.move(part, f"{root}/{name}")  # whole or not at all: a second attempt at the task replaces it
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([to.entries], pa.int64()), "n_ids": pa.array([to.ids], pa.int64())})

    return run


def write_shards(docs: DataFrame, path: str, cut: str = "spaced", end_id: int = 2, folder: str | None = None, shards: int | None = None) -> str:
    """Writes docs (doc_id, text; other columns are not read) as shards into a folder that driver and executors share; returns it.

    Documents are dealt by doc_id range, ordered and encoded in the task that writes their shard. A null text is empty (the end id
    alone); a null doc_id comes first; repeated rows are entries of their own, in order of their text's hash; no documents give no shards.
    Only one row a shard reaches the driver, which writes manifest.json: each shard's file, documents, and ids in the shards before it.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    made = dealt.mapInArrow(_writes(folder, path, cut, end_id), "shard long, n_docs long, n_ids long").collect()
    manifest, before = [], 0
    for r in sorted(made):
        if r.n_docs:
            manifest.append({"file": f"shard-{r.shard:06d}.sst", "n_docs": r.n_docs, "n_ids": r.n_ids, "before": before})
        before += r.n_ids
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return folder


def _reads(folder: str, files: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                name, at = files[k]
                with store.open_input_file(f"{root}/{name}") as file:
                    shard = Reader(file)
                    for b in range(len(shard.places)):
                        out = []
                        for key, ids in shard.block(b):
                            out.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids)))
                            at += len(ids) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the shards' files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    store, root = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/manifest.json") as file:
        manifest = json.loads(file.read())
    files = [(m["file"], m["before"]) for m in manifest]
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(_reads(folder, files), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shards with the byte-level vocabulary, and read back; the shards go when the application ends."""
    folder = shared_dir(spark)
    drop_at_end(spark, folder)
    write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder=folder)
    return read_shards(spark, folder)
