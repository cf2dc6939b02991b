"""Sum-of-squares online packing of documents into fixed windows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shared_dir, table, tokenizer_path
from tidemark.llm.encode import chunks, encoder
from tidemark.llm.encode import rows as texts

WINDOW = 2048
#: Ids of open windows that a task holds in memory, in bytes; what is above that lies in files of the shared folder until its window is done.
HELD_BYTES = 64 << 20
#: Texts encoded together, in characters: fewer than elsewhere, as a chunk's pieces are held beside them.
CHUNK_CHARS = 6_000_000
#: Windows made into rows together.
ROWS_TOGETHER = 1024
END_ID = 1

SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

#: A piece in an open window: (doc_id, doc_tokens, start, length, number under which its ids are held); in a done one: (doc_id, doc_tokens, start, ids).
Open = tuple[int | None, int, int, int, int]
Piece = tuple[int | None, int, int, bytes]


class Held:
    """Ids by number, given once and taken once. Above `most` bytes all that is in memory is written to one file more of `folder`."""

    def __init__(self, folder: str | None = None, most: int = HELD_BYTES) -> None:
        self.folder, self.most, self.size, self.count, self.n_files = folder, most, 0, 0, 0
        self.memory: dict[int, bytes] = {}
        self.disk: dict[int, tuple[int, int, int]] = {}
        self.store = self.root = None
        self.reading: tuple[int, object] | None = None

    def put(self, ids: bytes) -> int:
        self.count += 1
        self.memory[self.count] = ids
        self.size += len(ids)
        if self.size > self.most and self.folder:
            self._write()
        return self.count

    def take(self, number: int) -> bytes:
        if number in self.memory:
            ids = self.memory.pop(number)
            self.size -= len(ids)
            return ids
        file, at, size = self.disk.pop(number)
        if self.reading is None or self.reading[0] != file:
            self.reading = (file, self.store.open_input_file(f"{self.root}/{file}"))
        self.reading[1].seek(at)
        return self.reading[1].read(size)

    def _write(self) -> None:
        if self.store is None:
            self.store, path = pafs.FileSystem.from_uri(self.folder)
            self.root = f"{path}/held-{uuid.uuid4().hex}"
            self.store.create_dir(self.root)
        with self.store.open_output_stream(f"{self.root}/{self.n_files}") as out:
            at = 0
            for number, ids in self.memory.items():
                out.write(ids)
                self.disk[number] = (self.n_files, at, len(ids))
                at += len(ids)
        self.n_files += 1
        self.memory, self.size = {}, 0

    def close(self) -> None:
        if self.store is not None:
            self.reading = None
            self.store.delete_dir(self.root)
            self.store = None


class Packer:
    """Places pieces into windows by sum of squares; add() and finish() give the windows that are done.

    levels[h] counts the open windows filled to h. A piece of size s goes where the sum of squares of levels becomes
    smallest: a new window, or an open one at level h with h + s <= window; a full window leaves the counts. Ties go to the
    fullest. Documents longer than a window fill whole windows first, so until finish() each is cut at multiples of it only.
    """

    def __init__(self, window: int = WINDOW, held: Held | None = None) -> None:
        self.window, self.held = window, held or Held()
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Open]]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> list[list[Piece]]:
        n, w = len(ids) // 4, self.window
        whole = n // w * w
        done: list[list[Piece]] = [[(doc_id, n, at, ids[4 * at : 4 * (at + w)])] for at in range(0, whole, w)]
        if whole < n:
            done += self._place(doc_id, n, whole, ids[4 * whole :])
        return done

    def _done(self, pieces: list[Open]) -> list[Piece]:
        return [(doc_id, n, start, self.held.take(number)) for doc_id, n, start, _, number in pieces]

    def _place(self, doc_id: int | None, n: int, start: int, ids: bytes) -> list[list[Piece]]:
        size, w, levels = len(ids) // 4, self.window, self.levels
        at, best = 0, 2 * levels[size] + 1
        filled = np.flatnonzero(levels[: w - size + 1])
        if len(filled):
            here = levels[filled]
            cost = 2 * (levels[filled + size] - here + 1)
            if filled[-1] + size == w:
                cost[-1] = 1 - 2 * here[-1]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= best:
                at = int(filled[k])
        pieces: list[Open] = []
        if at:
            pieces = self.open[at].pop()
            levels[at] -= 1
        if at + size == w:
            return [[*self._done(pieces), (doc_id, n, start, ids)]]
        pieces.append((doc_id, n, start, size, self.held.put(ids)))
        self.open.setdefault(at + size, []).append(pieces)
        levels[at + size] += 1
        return []

    def _cut(self, piece: Open, size: int) -> tuple[Piece, Open]:
        doc_id, n, start, length, number = piece
        ids = self.held.take(number)
        return (doc_id, n, start, ids[: 4 * size]), (doc_id, n, start + size, length - size, self.held.put(ids[4 * size :]))

    def finish(self) -> Iterator[list[Piece]]:
        """The windows still open: the fullest are filled with the contents of the emptiest, a piece that overlaps is cut, and the
        last one is cut into sequences of a power of two, so nothing is padded."""
        rows = [(h, pieces) for h in sorted(self.open) for pieces in self.open[h]]
        self.open = {}
        self.levels[:] = 0
        low, last = 0, []
        while len(rows) > low:
            filled, pieces = rows.pop()
            target = self._done(pieces)
            while filled < self.window and low < len(rows):
                donor = rows[low][1]
                piece = donor.pop()
                gap = self.window - filled
                if piece[3] > gap:
                    part, rest = self._cut(piece, gap)
                    donor.append(rest)
                    target.append(part)
                    filled = self.window
                else:
                    target += self._done([piece])
                    filled += piece[3]
                    low += not donor
            if filled == self.window:
                yield target
            else:
                last = target[::-1]
        total = sum(len(p[3]) for p in last) // 4
        for power in reversed(range(total.bit_length())):
            if not total >> power & 1:
                continue
            room, row = 4 << power, []
            while room:
                doc_id, n, start, ids = last.pop()
                row.append((doc_id, n, start, ids[:room]))
                if len(ids) > room:
                    last.append((doc_id, n, start + room // 4, ids[room:]))
                room -= min(room, len(ids))
            yield row


def _pack(path: str, cut: str, end_id: int, window: int, with_ids: bool, folder: str, held_bytes: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held = encoder(path, cut), Held(folder, held_bytes)
        packer = Packer(window, held)
        sequence = TaskContext.get().partitionId() << 40
        names = [*SCHEMA.fieldNames(), *["ids"] * with_ids]

        def rows(done: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            for pieces in done:
                offset = 0
                for doc_id, n, start, ids in pieces:
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

        try:
            for some in chunks(texts(batches), CHUNK_CHARS):
                done: list[list[Piece]] = []
                for (doc_id, _), ids in zip(some, code.encode([t for _, t in some]), strict=True):
                    done += packer.add(doc_id, ids + end)
                yield from rows(done)
            rest = packer.finish()
            while done := list(islice(rest, ROWS_TOGETHER)):
                yield from rows(done)
        finally:
            held.close()

    return run


def pack(docs: DataFrame, path: str, cut: str = "words", end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per piece of docs (doc_id, text; other columns are not read) packed into sequences of at most `window` ids.

    Each input partition packs itself while it is tokenized: no shuffle, and a task that runs again gives the same rows. Ids of open
    windows are in memory up to held_bytes, then in files of the shared folder that go with the task. A sequence is full or its length is a power of two, so nothing is padded.
    A null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null; no rows give no rows.
    with_ids adds the pieces' ids (binary, little-endian unsigned 32-bit integers).
    """
    schema = T.StructType([*SCHEMA.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(path, cut, end_id, window, with_ids, shared_dir(docs.sparkSession), held_bytes), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents with the lower-casing vocabulary."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
