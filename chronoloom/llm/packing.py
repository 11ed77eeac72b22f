"""Packing of tokenised documents into sequences by the online sum-of-squares rule.

Every task packs the documents of its input partition as they stream by. A document's whole 4096-token stretches become sequences of
their own; the rest, shorter than a sequence, goes to the open sequence whose fill level makes the sum of squared counts of open
sequences per level smallest, a new sequence being level 0. The counts stand in an array by level; ties go to the fullest level.

A sequence leaves the task once it is full. At the end the open ones are drained: pieces of the emptiest are cut to fill the fullest, so
that a task leaves one sequence that is not full; that one is padded. If there are more than ``most_open`` before the end, as where all
pieces are longer than half a sequence, the fullest sixteenth of them is filled up so; all others stay open, and the rule goes on.

Only open sequences are held, at most ``most_open`` of them, with two bytes a token. sequence_id is the task's number times 2**32 plus a count: a task that is
run again after a lost executor gives the same rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import SLICE_BYTES, ranges, release_memory, require, ship_by_value, slices, text_buffers, word_table, worker_cache

ship_by_value(__name__)

LENGTH = 4096
END_ID = 2
MOST_OPEN = 4096
TOKENIZER = "word_bpe_49k.json"
#: Pieces that are encoded at a time.
CODED = 4096

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER, _UPPER, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = True
_MARK[39] = False
_MARK[48:58] = False
_MARK &= ~_LETTER


def plain_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Text and breaks that make equal pieces of words which differ in case or in marks around them only.

    The tokenizer lower-cases and parts letters from marks itself, so its ids stay the same: a break lies between an ASCII letter and
    an ASCII mark other than the apostrophe, which can begin a contraction; a letter before a byte of another script, with which it
    could compose, keeps its case; a text that might spell a special token is left as it is.
    """
    if len(data) < 2 or ((data[:-1] == 60) & (data[1:] == 124)).any():
        return data, None
    lower = _UPPER[data]
    lower[:-1] &= data[1:] < 128
    letter, mark = _LETTER[data], _MARK[data]
    breaks = np.zeros(len(data), bool)
    breaks[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return data + (lower * np.uint8(32)), breaks


class WordTokens:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never looks across it.

    Such a tokenizer's ids of a text are those of its runs without ASCII white space, one after another; each distinct piece of a slice
    is encoded once. Ids of pieces seen before are kept, and forgotten when they fill ``most`` entries.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in a row, and the n + 1 offsets of each row's ids."""
        data, breaks = plain_pieces(data)
        starts, ends, hashes, at = word_table(data, offsets, breaks)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        order = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        unique, first = hashes[order[heads]], order[heads]
        inverse = np.empty(len(hashes), np.int64)
        inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        where = np.searchsorted(self.keys, unique)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == unique[known]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self.clear()
                known[:], where[:] = False, 0
            body, new = memoryview(np.ascontiguousarray(data)), np.flatnonzero(~known)
            texts = [str(body[starts[i] : ends[i]], "utf-8", "replace") for i in first[new]]
            # The tokenizer's own result of a piece is far larger than its ids, so few are held at a time.
            coded = [x.ids for k in range(0, len(texts), CODED) for x in self.tokenizer.encode_batch_fast(texts[k : k + CODED], add_special_tokens=False)]
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            place = where[new]
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(n) - n)
            self.n = np.insert(self.n, place, n)
            self.keys = np.insert(self.keys, place, unique[new])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(n.sum()))])
            where = np.searchsorted(self.keys, unique)
        n = self.n[where][inverse]
        return self.ids[ranges(self.at[where][inverse], n)], np.concatenate([[0], np.cumsum(n)])[at]


class Piece:
    __slots__ = ("doc", "ids", "start", "tokens")

    def __init__(self, doc, start: int, ids: np.ndarray, tokens: int):
        self.doc, self.start, self.ids, self.tokens = doc, start, ids, tokens


class SumOfSquares:
    """Open sequences by fill level. put() and drain() give back full sequences as lists of pieces."""

    def __init__(self, length: int = LENGTH, most_open: int = MOST_OPEN):
        self.length, self.most_open = length, most_open
        self.count = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level, 0 for a new sequence, from which a piece of this size makes the sum of squares grow least."""
        top = self.length - size
        count = self.count
        growth = 2 * (count[size : self.length + 1] - count[: top + 1]) + 2
        growth[top] = 1 - 2 * count[top]
        growth[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * count[size] + 1 if size < self.length else 0
        return top - int(np.argmin(growth[::-1]))

    def put(self, piece: Piece) -> list[list[Piece]]:
        size = len(piece.ids)
        if size == self.length:
            return [[piece]]
        level = self.level_for(size)
        if level:
            sequence = self.open[level].pop()
            self.count[level] -= 1
        else:
            sequence = []
            self.n_open += 1
        sequence.append(piece)
        if level + size == self.length:
            self.n_open -= 1
            return [sequence]
        self.open.setdefault(level + size, []).append(sequence)
        self.count[level + size] += 1
        return self.drain(max(1, self.most_open // 16)) if self.n_open > self.most_open else []

    def drain(self, most: int | None = None) -> list[list[Piece]]:
        """Fills the fullest open sequences, at most so many, with pieces of the emptiest, cut where they must be; the others stay open.

        Without a number all are filled, and the one that is left over comes last.
        """
        rest = [s for level in sorted(self.open) for s in self.open[level]]
        out, low, high = [], 0, len(rest) - 1
        while low < high and (most is None or len(out) < most):
            target = rest[high]
            room = self.length - sum(len(p.ids) for p in target)
            while room and low < high:
                piece = rest[low].pop()
                if len(piece.ids) > room:
                    rest[low].append(Piece(piece.doc, piece.start + room, piece.ids[room:], piece.tokens))
                    piece = Piece(piece.doc, piece.start, piece.ids[:room], piece.tokens)
                target.append(piece)
                room -= len(piece.ids)
                if not rest[low]:
                    low += 1
            if room:
                break
            out.append(target)
            high -= 1
        left = rest[low : high + 1]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        if most is None:
            return out + left
        for sequence in left:
            level = sum(len(p.ids) for p in sequence)
            self.open.setdefault(level, []).append(sequence)
            self.count[level] += 1
            self.n_open += 1
        return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, most_open: int = MOST_OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A null or empty text is the one id end_id. Rows are packed one by one, so rows that share an id, or have none, each get their own
    pieces. Texts of any length are cut into stretches; of levels with equal growth the fullest is taken. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    require(docs, ["doc_id", "text"])
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = worker_cache(f"tokens {path}", lambda: WordTokens(path)), SumOfSquares(length, most_open)
        context = TaskContext.get()
        base, made = (context.partitionId() if context else 0) << 32, 0
        held = np.uint16 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        end = np.array([end_id], np.uint32)
        rows: list[tuple] = []

        def emit(sequences: list[list[Piece]]) -> None:
            nonlocal made
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    raw = p.ids.astype("<u4").tobytes()
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(raw), p.tokens, base + made, offset, raw))
                    offset += len(p.ids)
                made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in columns[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for a, z in slices(offsets, SLICE_BYTES // 2):
                tokens, at = coder.encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                for r in range(a, z):
                    own = np.concatenate([tokens[at[r - a] : at[r - a + 1]], end]).astype(held)
                    for s in range(0, len(own), length):
                        emit(packer.put(Piece(ids[r], s, own[s : s + length], len(own))))
                if rows:
                    yield flush()
        emit(packer.drain())
        if rows:
            yield flush()
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
