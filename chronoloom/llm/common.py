"""Helpers that several corpus operators share.

Modules whose functions run in Python workers call ``ship_by_value`` so that executors need not have this package installed.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_by_value(module: str) -> None:
    """Functions of this module are sent to the workers whole instead of by name."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)

#: Rows of a side that may be broadcast: at most this many rows of a few short columns, some tens of MB.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32_000_000
#: Bytes of text that a worker lays out in arrays at a time.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Evaluates a small table once and cuts its lineage by a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only a local session that names no folder gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chronoloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the counted rows, all of them short, are within the limit; beyond it Spark shuffles both sides and splits
    skewed partitions."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def sized_bytes(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same for a table whose rows differ in size: the sizes are summed up."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df.hint("merge")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text, so that rows with one id (or none) but other texts stay separate; fully repeated rows share it."""
    return F.struct(doc_id.alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7)).alias("h"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the text hash of row_key under a name that is free."""
    (h,) = fresh(docs, "row_hash")
    return docs.withColumn(h, row_key(F.col("doc_id"), F.col("text"))["h"]), h


def meet(docs: DataFrame, h: str, found: DataFrame, how: str, rows: int) -> DataFrame:
    """Joins docs, which has its text hash under the name h, with found (doc_id, h and columns that docs has not) by the row key."""
    kid, kh = fresh(docs, "key_id", "key_hash")
    right = sized(found.withColumnsRenamed({"doc_id": kid, "h": kh}), rows)
    out = docs.join(right, docs["doc_id"].eqNullSafe(right[kid]) & (docs[quoted(h)] == right[kh]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(kid, kh)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows with at most so many bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


#: An odd multiplier, so that it has an inverse modulo 2**64: a span's hash is a difference of prefix sums times an inverse power.
MULTIPLIER = 0x9E3779B97F4A7C15
_WORD_SALT = np.random.default_rng(20_240_101).integers(1, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a multiplier and of its inverse modulo 2**64."""
    known = _POWERS.get(multiplier)
    if known is None or len(known[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for m in (multiplier, pow(multiplier, -1, 2**64)):
            base = np.full(size, m, np.uint64)
            base[0] = 1
            made.append(np.cumprod(base, dtype=np.uint64))
        known = (made[0], made[1])
        if size <= 1 << 23:
            _POWERS[multiplier] = known
    return known[0][:n], known[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans at once; equal spans have equal hashes wherever they stand."""
    up, down = powers(multiplier, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:], dtype=np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def worker_cache(key: str, make):
    """What a Python worker keeps from task to task; it is made again wherever it is missing."""
    kept = sys.modules.setdefault("_chronoloom_worker_cache", types.ModuleType("_chronoloom_worker_cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task: its worker goes on to other tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def word_table(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes without ASCII white space, and the n + 1 offsets of each row's words.

    breaks marks bytes at which a run ends and another begins as well.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    if breaks is not None:
        before |= breaks
        after[:-1] |= breaks[1:]
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        base, top = starts[at], ends[to - 1]
        hashes[at:to] = span_hashes(_WORD_SALT[data[base:top]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    steps = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    heads = np.cumsum(n)[:-1]
    steps[0] = s[0]
    steps[heads] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(steps)
