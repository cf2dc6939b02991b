"""Whole texts to token ids with the tokenizers library, fast enough for a corpus.

A text is cut where the tokenizer itself always cuts, each distinct piece is encoded once and kept, and a text's ids are its
pieces' joined. That gives the ids of encoding the whole text, since neither vocabulary's pieces cross such a cut:

- lower-casing vocabulary with word ends: white space parts words and is dropped;
- byte-level vocabulary: a space or line feed between two words starts a piece. Texts where it touches other white space are encoded whole.

tests/llm/test_text_operators.py holds both against encoding whole texts.
"""

from __future__ import annotations

import ctypes
import os
import string
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many new pieces, and those of the generation before, are kept in a worker (about 120 MB); pieces in use move on.
KEPT_PIECES = 300_000
_SIGN_RUN = string.punctuation
#: A space or line feed that touches other white space.
_RUNS = r"[\s\p{Z}\x{85}\x1c-\x1f][ \n]|[ \n][\s\p{Z}\x{85}\x1c-\x1f]"
#: Marks for cuts: the first that no text has.
_MARKS = ("\0", "\x01", "\x02", "\x03", "\ue000", "\uf8ff")
#: Texts encoded together: at most so many characters, one text at least.
CHUNK_CHARS = 11_000_000
#: Pieces that the tokenizer learns in one call; what it holds for a call is many times their size.
LEARNT_TOGETHER = 32_768
#: Rows of a batch that are Python objects at one time, before they join a chunk.
ROWS_TOGETHER = 64


def give_back() -> None:
    """Freed memory to the system: workers outlive their tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Encoder:
    """cut: "words" or "spaced" for the two vocabularies above."""

    def __init__(self, path: str, cut: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' names in a text are ordinary text
        self.cut = cut
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        self.lines = self.marked.copy()
        for token, i in vocabulary.items():
            self.marked[i] = token.endswith("</w>") if cut == "words" else token.startswith("\u0120")  # the vocabulary's sign for a space
            self.lines[i] = token.startswith("\u010a")  # and for a line feed
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: pa.StringArray) -> pa.ListArray | None:
        """Each text's pieces; None if every mark for cuts occurs in the texts."""
        if self.cut == "words":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        for mark in _MARKS:
            if not pc.any(pc.match_substring(texts, mark)).as_py():
                cut = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
                return pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _RUNS), texts, cut), mark)
        return None

    def _learn(self, missing: list[str], to: dict[str, bytes]) -> None:
        """Encodes pieces. Those that stay apart in one text go as one: words of letters, with a run of signs after them or without, part
        where a token ends a word; printable pieces after a space or line feed part where a token starts with it."""
        groups: list[tuple[list[str], str, int, np.ndarray]] = []
        rest: list[str] = []
        if self.cut == "words":
            plain: list[str] = []
            signed: list[str] = []
            for p in missing:
                if p.isalpha():
                    plain.append(p)
                elif p.rstrip(_SIGN_RUN).isalpha():
                    signed.append(p)
                else:
                    rest.append(p)
            groups = [(plain, " ", 1, self.marked), (signed, " ", 2, self.marked)]
        else:
            spaced = [p for p in missing if p[:1] == " " and len(p) > 1 and p.isprintable()]
            others = [p for p in missing if p[:1] != " " or len(p) < 2 or not p.isprintable()]
            lines = [p for p in others if p[:1] == "\n" and len(p) > 1 and p[1:].isprintable()]
            rest = [p for p in others if p[:1] != "\n" or len(p) < 2 or not p[1:].isprintable()]
            groups = [(spaced, "", 1, self.marked), (lines, "", 1, self.lines)]
        parts = [(pieces[i : i + LEARNT_TOGETHER], *how) for pieces, *how in groups for i in range(0, len(pieces), LEARNT_TOGETHER)]
        for pieces, between, per, marked in parts:
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(marked[ids])
            cuts = np.concatenate([[0], at[per - 1 :: per] + 1]) if between else np.append(at, len(ids))
            if len(cuts) != len(pieces) + 1 or cuts[-1] != len(ids) or cuts[0]:
                rest += pieces
                continue
            data, where = ids.tobytes(), (4 * cuts).tolist()
            to.update(zip(pieces, [data[a:b] for a, b in zip(where, where[1:], strict=False)], strict=True))
        for i in range(0, len(rest), LEARNT_TOGETHER):
            some = rest[i : i + LEARNT_TOGETHER]
            to.update(zip(some, self._whole(some), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null is empty."""
        texts = [t or "" for t in texts]
        lists = self._pieces(pa.array(texts, pa.large_string()))
        if lists is None:
            return self._whole(texts)
        coded = pc.dictionary_encode(lists.values)
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > KEPT_PIECES:
            self.older, self.known = self.known, {}
        known = self.known
        missing = [p for p in pieces if p not in known]
        if self.older:
            known.update([(p, self.older[p]) for p in missing if p in self.older])
            missing = [p for p in missing if p not in known]
        long = [p for p in missing if len(p) > 64]
        if long:
            missing = [p for p in missing if len(p) <= 64]
        self._learn(missing, known)
        extra: dict[str, bytes] = {}
        self._learn(long, extra)
        ids = [known[p] if p in known else extra[p] for p in pieces] if long else list(map(known.__getitem__, pieces))
        place, firsts = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        del lists, coded, pieces, missing  # what follows is as large as they are
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(sizes[place])])
        kind = np.int32 if max(ends[-1], starts[-1]) < 1 << 31 else np.int64
        at = np.repeat((starts[place] - ends[:-1]).astype(kind), sizes[place])
        at += np.arange(ends[-1], dtype=kind)
        cuts = (4 * ends[firsts]).tolist()
        del place, ends
        data = memoryview(np.frombuffer(b"".join(ids), "<u4")[at]).cast("B")
        del at
        out = [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        del data, ids
        give_back()
        return out


@cache
def encoder(path: str, cut: str) -> Encoder:
    """One for each worker process; its known pieces outlive a task."""
    return Encoder(path, cut)


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) of every row; a batch of long texts is never held twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_TOGETHER):
            some = batch.slice(i, ROWS_TOGETHER)
            yield from zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True)


def chunks(rows: Iterable[tuple], chars: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows (..., text) in lists of a bounded number of characters."""
    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        size += len(row[-1] or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some
