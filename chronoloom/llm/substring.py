"""Removal of repeated passages by prefix-partitioned suffix trees.

Suffixes are split by variable-length word prefixes into groups that fit in memory; each group is sorted, the lengths of common prefixes
between neighbours give its suffix tree, and the internal nodes at least ``window`` words deep are the repeated passages. A node with a
smaller document id below it removes its whole depth from the other leaves: a word goes if a window that covers it also starts in a
document with a smaller id.

Only suffixes that can begin a maximal repeat become leaves: those whose first window is *left-diverse*, that is, stands after different
words (or at the start of a text) in different places. Two documents' longest common passage always begins at such a window in both.
Leaves end where repeated windows end, and after ``depth`` words at most. A passage longer than that has further leaves: of each
``depth - window + 1`` consecutive windows the one with the smallest hash, so that leaves follow each other closely enough to cover the
passage and stand alike in all its copies. A window that stands in very many places (``class_suffixes``) gets a leaf of ``window`` words, and
the window after it a leaf of its own, so that no prefix gathers more leaves than a task holds. Four passes run over blocks of documents:

1. *anchors*: every window has the smallest hash of its 5-word runs as anchor. Equal windows have equal anchors, so only windows whose
   anchor lies in several documents can repeat across documents. The same pass counts short prefixes; those with too many suffixes are
   replaced by longer ones.
2. *lefts*: the words before equal windows meet by the windows' hashes, which tells the left-diverse ones.
3. *trees*: the leaves go to the group of their prefix, once for each block and distinct leaf with the smallest id there, sorted and
   without the words that they share with the leaf before. The depth of a leaf's deepest node with a smaller id goes back to its block.
4. *removal*: each block drops the covered words.

All that is shuffled is summed up in a block first: a passage that stands in a third of all documents is one entry a block. Copies of
whole texts are known by SHA-256 and take no part in the trees. Trees tell words apart by 32-bit codes, so the word after a passage is
taken for equal by mistake about once in 4 x 10^9 leaves. Lost executors cost recomputed tasks only; the plan has no state outside Spark.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, mixed, ranges, release_memory, require, ship_by_value, span_hashes, text_buffers, word_table

ship_by_value(__name__)

WINDOW = 13
ANCHOR = 5
#: Bytes of text in a block, and suffixes in a group, on average at most.
BLOCK_BYTES = 8_000_000
GROUP_SUFFIXES = 1_000_000
#: Words of a leaf at most, and places of a window beyond which its leaf has the window's words only.
DEPTH = 64
CLASS_SUFFIXES = 20_000
#: Lengths in words that a prefix can have, short of the window.
PREFIXES = (1, 2, 4, 8)
#: Documents without id come after all others.
LAST_ID = 2**63 - 1

MESSAGE = "grp int, block int, kind int, body binary, ids array<bigint>"
#: ids of COPIES are ids and keys of texts; of SHARED, a block's frequent prefixes with their counts, or on the way back heavy prefixes.
COPIES, SHARED, NODES, LEFTS = 0, 1, 2, 3


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed planes of bytes."""
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return len(arrays[0]).to_bytes(8, "little") + len(body).to_bytes(8, "little") + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    body = pa.decompress(blob[16:], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind in kinds:
        dtype = np.dtype(kind)
        width = dtype.itemsize
        planes = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype.base).reshape((n, *dtype.shape)) if n else np.zeros((0, *dtype.shape), dtype.base))
        at += n * width
    return out


def messages(rows: list[tuple[int, int, int, bytes, np.ndarray | None]]) -> pa.Table:
    grp, block, kind, body, ids = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table(
        {
            "grp": pa.array(grp, pa.int32()),
            "block": pa.array(block, pa.int32()),
            "kind": pa.array(kind, pa.int32()),
            "body": pa.array(body, pa.binary()),
            "ids": pa.array(ids, pa.list_(pa.int64())),
        }
    )


def runs(order_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal sorted keys."""
    return np.flatnonzero(np.concatenate([[True], order_keys[1:] != order_keys[:-1]])) if len(order_keys) else np.zeros(0, np.int64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def text_key(text: bytes | memoryview) -> tuple[int, int]:
    """The first 120 bits of a text's SHA-256, as in the messages of copies."""
    sha = hashlib.sha256(text).hexdigest()
    return int(sha[:15], 16), int(sha[15:30], 16)


def copies_of(got: dict[int, list]) -> set[tuple[int, int, int]]:
    return {key for ids in got[COPIES] for key in zip(ids[::3], ids[1::3], ids[2::3], strict=True)}


class Block:
    """The windows of a block's documents, without those of copies."""

    def __init__(self, docs: pa.Table, copies: set[tuple[int, int, int]], window: int, anchor: int):
        self.ids = docs.column("did").to_numpy()
        data, offsets = text_buffers(docs.column("text"))
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.words, self.at = word_table(data, offsets)
        n = np.diff(self.at)
        self.copy = np.isin(self.ids, np.array(list({i for i, *_ in copies}), np.int64))
        body = memoryview(data)
        for r in np.flatnonzero(self.copy):
            # other texts may stand under the id of a copy
            self.copy[r] = (int(self.ids[r]), *text_key(body[offsets[r] : offsets[r + 1]])) in copies
        count = np.where(self.copy, 0, np.maximum(n - window + 1, 0))
        #: Of each window: its first word and its document's row.
        self.first = ranges(self.at[:-1], count)
        self.row = np.repeat(np.arange(len(count)), count)
        self.anchors = np.zeros(0, np.uint64)
        if len(self.first):
            at = np.arange(len(self.words) - anchor + 1)
            low = span_hashes(self.words, at, at + anchor)
            size, wide = 1, window - anchor + 1
            while size * 2 <= wide:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < wide:
                low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
            self.anchors = low[self.first]
        self.window = window

    def prefix(self, which: np.ndarray, words: int) -> np.ndarray:
        at = self.first[which]
        return span_hashes(self.words, at, at + words)

    def survivors(self, shared: np.ndarray) -> np.ndarray:
        """The windows whose anchor lies in several documents."""
        if not len(self.anchors):
            return np.zeros(0, np.int64)
        heads = runs(self.anchors)
        flags = among(self.anchors[heads], shared)
        return np.flatnonzero(np.repeat(flags, np.diff(np.append(heads, len(self.anchors)))))


def received(right: pa.Table) -> dict[int, list]:
    got: dict[int, list] = {COPIES: [], SHARED: [], NODES: [], LEFTS: []}
    for grp, kind, body, ids in zip(*(right.column(c).to_pylist() for c in ("grp", "kind", "body", "ids")), strict=True):
        got[kind].append({COPIES: ids, SHARED: (body, ids), NODES: (grp, body), LEFTS: body}[kind])
    return got


def heavy_of(got: dict[int, list]) -> np.ndarray:
    return np.sort(joined([np.array(ids, np.int64).view(np.uint64) for _, ids in got[SHARED] if ids], "u8"))


def joined(parts: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def tagged(h: np.ndarray, words: int) -> np.ndarray:
    return mixed(h + np.uint64(words))


def coded(words: np.ndarray) -> np.ndarray:
    """32-bit codes of words; 0 is none."""
    return np.maximum((words >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def class_of(h: np.ndarray) -> np.ndarray:
    """40 bits of a window's hash: windows taken for equal only add leaves."""
    return h >> np.uint64(24)


def last_true(flags: np.ndarray) -> np.ndarray:
    """The last place up to each one where the flag is set, or -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1)) if len(flags) else np.zeros(0, np.int64)


def leaves_of(which: np.ndarray, row: np.ndarray, h: np.ndarray, diverse: np.ndarray, heavy: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows (their numbers ascending, their rows and hashes) begin a leaf, and how many words each leaf would have."""
    n = len(which)
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    follows = np.concatenate([[False], (which[1:] == which[:-1] + 1) & (row[1:] == row[:-1])])
    head = last_true(~follows)
    heads = np.flatnonzero(~follows)
    stop = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    begins = diverse.copy()
    wide = depth - window + 1
    if n >= wide:
        low, size = h.copy(), 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        # a stretch has a smallest window for each of its spans; equal ones are all taken
        at = np.flatnonzero(head[wide - 1 :] <= np.arange(n - wide + 1))
        for a in range(wide):
            to = at + a
            begins[to] |= h[to] == low[at]
    # after a heavy window that begins a leaf, the next one does, too
    linked = follows.copy()
    linked[1:] &= heavy[:-1]
    begin, broken = last_true(begins), last_true(~linked)
    begins = (begin >= 0) & (begin >= broken)
    return begins, np.where(heavy, window, np.minimum(stop - np.arange(n) + window - 1, depth))


def leaf_codes(codes: np.ndarray, first: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """One row of codes a leaf, filled up with 0."""
    column = np.arange(depth)
    at = np.minimum(first[:, None] + column, len(codes) - 1)
    return np.where(column < length[:, None], codes[at], np.uint32(0))


def sorting(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of codes, and the number of words that each sorted one shares with the one before."""
    keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    by = rows[order]
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = by[1:] != by[:-1]
        # equal rows share all their words, not what fills them up
        common[1:] = np.where(differ.any(1), differ.argmax(1), (by[1:] != 0).sum(1))
    return order, common


def distinct(rows: np.ndarray, length: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different leaves, their lengths, words shared with the one before and smallest ids; and the leaf of each row."""
    order, common = sorting(rows)
    same = common == length[order]
    same[1:] &= length[order][1:] == length[order][:-1]
    same[:1] = False
    heads = np.flatnonzero(~same)
    leaf = np.empty(len(rows), np.int64)
    leaf[order] = np.cumsum(~same) - 1
    return rows[order][heads], length[order][heads], common[heads], np.minimum.reduceat(who[order], heads), leaf


def front_coded(rows: np.ndarray, length: np.ndarray, common: np.ndarray, low: np.ndarray) -> bytes:
    column = np.arange(rows.shape[1])
    tails = rows[(column >= common[:, None]) & (column < length[:, None])]
    head = pack(length.astype(np.uint8), common.astype(np.uint8), low)
    return len(head).to_bytes(8, "little") + head + pack(tails)


def front_decoded(blob: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes, and their smallest ids."""
    size = 8 + int.from_bytes(blob[:8], "little")
    length, common, low = unpack(blob[8:size], "u1", "u1", "i8")
    (tails,) = unpack(blob[size:], "u4")
    column, place = np.arange(depth), np.arange(len(length))
    rows = np.zeros((len(length), depth), np.uint32)
    rows[(column >= common[:, None]) & (column < length[:, None])] = tails
    for c in range(depth):
        rows[:, c] = np.where(c < length, rows[np.maximum.accumulate(np.where(common <= c, place, 0)), c], 0)
    return rows, low


def deepest(common: np.ndarray, low: np.ndarray, window: int, depth: int) -> np.ndarray:
    """For each leaf of a sorted group the depth of its deepest internal node, ``window`` or more, that has a smaller id below it; else 0.

    A node is an interval of leaves that share so many words; the tree is walked from its deepest nodes up.
    """
    found = np.zeros(len(low), np.int64)
    for level in range(depth, window - 1, -1):
        if not (common == level).any():
            continue
        heads = np.flatnonzero(common < level)
        least = np.repeat(np.minimum.reduceat(low, heads), np.diff(np.append(heads, len(low))))
        found[(found == 0) & (least < low)] = level
    return found


def dedup_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES, depth: int = DEPTH, class_suffixes: int = CLASS_SUFFIXES) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_text, passages for every row of docs (doc_id, text; other columns are not read).

    passages are the maximal repeats for which words go, as first word (from 0) and number of words: those that no other contains. One
    longer than ``depth`` words comes in pieces of up to that many, which overlap by ``window`` - 1 words or more; a copy of a whole text is one passage.

    Words are runs without ASCII white space; a null text has none. Rows that share an id never remove words from each other. Rows
    without id come after all others: they lose what stands in a document with id, and remove nothing. An empty table gives an empty
    result. kept_text has the kept words joined by one space.
    """
    require(docs, ["doc_id", "text"])
    if not anchor <= window <= depth <= 255:
        raise ValueError("anchor <= window <= depth <= 255 must hold")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    text = F.coalesce("text", F.lit(""))
    # the text's hash as well, so that rows without id, or with one id, are spread
    place = F.xxhash64(did, text)
    light = materialise(docs.select(did.alias("did"), place.alias("place"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("size")))
    size = light.agg(F.sum("size")).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    block_of = lambda hashed: F.pmod(hashed, F.lit(n_blocks)).cast("int").alias("block")

    twice = light.groupBy("sha").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most").select("sha", "least")
    # one row for a text and a block, so that no text's copies meet row by row
    held = light.groupBy("sha", block_of(F.col("place"))).agg(F.collect_set("did").alias("dids"))
    halves = ", ".join(f"cast(conv(substring(sha, {k}, 15), 16, 10) as bigint)" for k in (1, 16))
    copies = (
        held.join(twice, "sha")
        .selectExpr("block", f"flatten(transform(filter(dids, d -> d > least), d -> array(d, {halves}))) as key")
        .groupBy("block")
        .agg(F.flatten(F.collect_list("key")).alias("ids"))
        .select(F.lit(0).alias("grp"), "block", F.lit(COPIES).alias("kind"), F.lit(None).cast("binary").alias("body"), "ids")
    )
    blocks = docs.select(block_of(place), "doc_id", did.alias("did"), F.col("text").cast("binary").alias("text"))

    def anchors_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        own = int(left.column("block")[0].as_py())
        b = Block(left, copies_of(received(right)), window, anchor)
        out = []
        frequent, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(b.anchors):
            # a run ends with its document, too
            heads = np.union1d(runs(b.anchors), runs(b.row))
            keys, who = b.anchors[heads], b.ids[b.row[heads]]
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            heads = runs(keys)
            keys, low, high = keys[heads], np.minimum.reduceat(who, heads), np.maximum.reduceat(who, heads)
            # A prefix with twice group_suffixes suffixes in all has this many in some block.
            least, which = max(1, group_suffixes // n_blocks), np.arange(len(b.first))
            found_keys, found_counts = [], []
            for words in PREFIXES:
                if words >= window or len(which) < least:
                    break
                h = tagged(b.prefix(which, words), words)
                cell = (h & np.uint64(0xFFFF)).astype(np.int64)
                many = np.bincount(cell, minlength=1 << 16)[cell] >= least
                which, h = which[many], h[many]
                u, inverse, c = np.unique(h, return_inverse=True, return_counts=True)
                found_keys.append(u[c >= least])
                found_counts.append(c[c >= least])
                which = which[c[inverse] >= least]
            if found_keys:
                frequent, counts = np.concatenate(found_keys), np.concatenate(found_counts).astype(np.int64)
            bucket, home = ((x % np.uint64(n_blocks)).astype(np.int64) for x in (keys, frequent))
            order, asked = np.argsort(bucket, kind="stable"), np.argsort(home, kind="stable")
            cuts, ends = (np.searchsorted(x, np.arange(n_blocks + 1)) for x in (bucket[order], home[asked]))
            for g in range(n_blocks):
                i, j = order[cuts[g] : cuts[g + 1]], asked[ends[g] : ends[g + 1]]
                if len(i) or len(j):
                    pairs = np.column_stack([frequent[j].view(np.int64), counts[j]]).reshape(-1) if len(j) else None
                    out.append((g, own, SHARED, pack(keys[i], low[i], high[i]), pairs))
        return messages(out)

    def shared_of(t: pa.Table) -> pa.Table:
        """Anchors of several documents, to the blocks that have them; prefixes heavy in all blocks together, to every block."""
        bodies, owners = t.column("body").to_pylist(), t.column("block").to_numpy()
        asked = [np.array(ids, np.int64).reshape(-1, 2) for ids in t.column("ids").to_pylist() if ids]
        heavy = None
        if asked:
            pairs = np.concatenate(asked)
            keys, inverse = np.unique(pairs[:, 0], return_inverse=True)
            heavy = keys[np.bincount(inverse, pairs[:, 1]) >= group_suffixes]
        parts = [unpack(x, "u8", "i8", "i8") for x in bodies]
        keys = np.concatenate([x[0] for x in parts])
        owner = np.repeat(owners, [len(x[0]) for x in parts])
        low, high = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        order = np.argsort(keys, kind="stable")
        heads = runs(keys[order])
        several = np.minimum.reduceat(low[order], heads) < np.maximum.reduceat(high[order], heads)
        flags = np.repeat(several, np.diff(np.append(heads, len(order))))
        i = order[flags]
        i = i[np.argsort(owner[i], kind="stable")]
        if heavy is not None and len(heavy):
            cuts = np.searchsorted(owner[i], np.arange(n_blocks + 1))
            return messages([(0, g, SHARED, pack(keys[i[cuts[g] : cuts[g + 1]]]), heavy) for g in range(n_blocks)])
        heads = np.append(runs(owner[i]), len(i)) if len(i) else []
        return messages([(0, int(owner[i[a]]), SHARED, pack(keys[i[a:z]]), None) for a, z in zip(heads[:-1], heads[1:], strict=True)])

    def windows_of(left: pa.Table, got: dict[int, list]):
        b = Block(left, copies_of(got), window, anchor)
        which = b.survivors(np.sort(joined([unpack(body, "u8")[0] for body, _ in got[SHARED]], "u8")))
        at = b.first[which]
        return b, which, span_hashes(b.words, at, at + window)

    def lefts_of(left: pa.Table, right: pa.Table) -> pa.Table:
        """The words before the windows that can repeat, to be compared by the windows' hashes."""
        if not left.num_rows:
            return messages([])
        own = int(left.column("block")[0].as_py())
        b, which, h = windows_of(left, received(right))
        if not len(which):
            return messages([])
        at = b.first[which]
        before = np.where(at == b.at[b.row[which]], np.uint32(0), coded(b.words[at - 1]))
        h = class_of(h)
        order = np.argsort(h, kind="stable")
        heads = runs(h[order])
        least, most = np.minimum.reduceat(before[order], heads), np.maximum.reduceat(before[order], heads)
        before, count, h = np.where(least == most, least, np.uint32(0)), np.diff(np.append(heads, len(order))).astype(np.uint32), h[order][heads]
        bucket = (h % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_blocks + 1))
        parts = [(g, order[cuts[g] : cuts[g + 1]]) for g in range(n_blocks)]
        return messages([(g, own, LEFTS, pack(h[i], before[i], count[i]), None) for g, i in parts if len(i)])

    def diverse_of(t: pa.Table) -> pa.Table:
        """Classes of windows that are left-diverse (1) or heavy (2), to the blocks that have them."""
        parts = [unpack(x, "u8", "u4", "u4") for x in t.column("body").to_pylist()]
        owner = np.repeat(t.column("block").to_numpy(), [len(x[0]) for x in parts])
        h, before, count = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.argsort(h, kind="stable")
        heads = runs(h[order])
        least, most = np.minimum.reduceat(before[order], heads), np.maximum.reduceat(before[order], heads)
        flag = ((least == 0) | (least < most)) + 2 * (np.add.reduceat(count[order].astype(np.int64), heads) > class_suffixes)
        flags = np.empty(len(h), np.uint8)
        flags[order] = np.repeat(flag, np.diff(np.append(heads, len(h))))
        i = np.flatnonzero(flags)
        i = i[np.lexsort((h[i], owner[i]))]
        cuts = np.append(runs(owner[i]), len(i)) if len(i) else []
        return messages([(0, int(owner[i[a]]), LEFTS, pack(h[i[a:z]], flags[i[a:z]]), None) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])

    def leaves(left: pa.Table, got: dict[int, list]):
        """The block, and of each leaf its first word, length, document's id and group."""
        b, which, h = windows_of(left, got)
        known = [unpack(x, "u8", "u1") for x in got[LEFTS]]
        key, flag = joined([x[0] for x in known], "u8"), joined([x[1] for x in known], "u1")
        order = np.argsort(key)
        key, flag = key[order], flag[order]
        flags = np.zeros(len(which), np.uint8)
        if len(key):
            at = np.minimum(np.searchsorted(key, class_of(h)), len(key) - 1)
            flags = np.where(key[at] == class_of(h), flag[at], 0)
        begins, length = leaves_of(which, b.row[which], h, (flags & 1) > 0, (flags & 2) > 0, window, depth)
        which, h, length = which[begins], h[begins], length[begins]
        heavy = heavy_of(got)
        group, open_ = h.copy(), np.arange(len(which))
        for words in PREFIXES:
            if words >= window or not len(open_):
                break
            key = tagged(b.prefix(which[open_], words), words)
            group[open_] = key
            open_ = open_[among(key, heavy)]
        group[open_] = h[open_]
        return b, b.first[which], length, b.ids[b.row[which]], (group % np.uint64(n_blocks)).astype(np.int64)

    def by_group(b: Block, first: np.ndarray, length: np.ndarray, who: np.ndarray, group: np.ndarray):
        """Of each group the places of its leaves, and the different ones of them."""
        codes = coded(b.words)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(n_blocks + 1))
        for g in range(n_blocks):
            i = order[cuts[g] : cuts[g + 1]]
            if len(i):
                yield g, i, distinct(leaf_codes(codes, first[i], length[i], depth), length[i], who[i])

    def suffixes_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        own = int(left.column("block")[0].as_py())
        return messages([(g, own, NODES, front_coded(*found[:4]), None) for g, _, found in by_group(*leaves(left, received(right)))])

    def tree_of(t: pa.Table) -> pa.Table:
        """The suffix tree of a group: sorted leaves and the common words of neighbours."""
        grp, owners = int(t.column("grp")[0].as_py()), t.column("block").to_numpy()
        parts = [front_decoded(x, depth) for x in t.column("body").to_pylist()]
        sizes = [len(x[1]) for x in parts]
        low, place = np.concatenate([x[1] for x in parts]), np.concatenate([np.arange(n) for n in sizes])
        order, common = sorting(np.concatenate([x[0] for x in parts]))
        found = np.zeros(len(low), np.uint8)
        found[order] = deepest(common, low[order], window, depth)
        ends = np.cumsum(sizes)
        out = []
        for own, a, z in zip(owners.tolist(), ends - sizes, ends, strict=True):
            i = a + np.flatnonzero(found[a:z])
            if len(i):
                out.append((grp, own, NODES, pack(place[i].astype(np.uint32), found[i]), None))
        release_memory()
        return messages(out)

    def removed_of(left: pa.Table, right: pa.Table) -> pa.Table:
        got = received(right)
        n_rows = left.num_rows
        n_words, n_removed, kept, passages = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), [b""] * n_rows, [[] for _ in range(n_rows)]
        if n_rows:
            b, first, length, who, group = leaves(left, got)
            n_words = np.diff(b.at)
            reach = np.zeros(len(first), np.int64)
            nodes = dict(got[NODES])
            for g, i, (_, _, _, low, leaf) in by_group(b, first, length, who, group):
                found = np.zeros(len(low), np.int64)
                if g in nodes:
                    at, deep = unpack(nodes[g], "u4", "u1")
                    found[at] = deep
                # another document of this block has the same leaf
                reach[i] = np.where(who[i] > low[leaf], length[i], found[leaf])
            # leaves stand in the order of their words; those that another contains are left out
            end = first + reach
            most = np.maximum.accumulate(end) if len(end) else end
            whole = np.flatnonzero((reach > 0) & (end > np.concatenate([[0], most[:-1]])))
            steps = np.zeros(len(b.words) + 1, np.int64)
            np.add.at(steps, first[whole], 1)
            np.add.at(steps, end[whole], -1)
            of = np.searchsorted(b.at, first[whole], "right") - 1
            for r, start, words in zip(of.tolist(), (first[whole] - b.at[of]).tolist(), reach[whole].tolist(), strict=True):
                passages[r].append([start, words])
            gone = np.cumsum(steps[:-1]) > 0
            for r in np.flatnonzero(b.copy & (n_words >= window)):
                gone[b.at[r] : b.at[r + 1]] = True
                passages[r] = [[0, int(n_words[r])]]
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_removed = sums[b.at[1:]] - sums[b.at[:-1]]
            body = memoryview(b.data)
            for r in range(n_rows):
                words = bytes(body[b.offsets[r] : b.offsets[r + 1]]).split()
                if n_removed[r]:
                    words = [w for w, x in zip(words, gone[b.at[r] : b.at[r + 1]].tolist(), strict=True) if not x]
                kept[r] = b" ".join(words)
            release_memory()
        return pa.table(
            {
                "doc_id": left.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "passages": pa.array(passages, pa.list_(pa.list_(pa.int64()))),
            }
        )

    grouped = lambda: blocks.groupBy("block")
    anchors = grouped().cogroup(copies.groupBy("block")).applyInArrow(anchors_of, MESSAGE)
    shared = anchors.groupBy("grp").applyInArrow(shared_of, MESSAGE).unionByName(copies)
    lefts = grouped().cogroup(shared.groupBy("block")).applyInArrow(lefts_of, MESSAGE)
    told = shared.unionByName(lefts.groupBy("grp").applyInArrow(diverse_of, MESSAGE))
    suffixes = grouped().cogroup(told.groupBy("block")).applyInArrow(suffixes_of, MESSAGE)
    nodes = suffixes.groupBy("grp").applyInArrow(tree_of, MESSAGE)
    out = grouped().cogroup(told.unionByName(nodes).groupBy("block")).applyInArrow(removed_of, "doc_id bigint, n_words bigint, n_removed bigint, kept binary, passages array<array<bigint>>")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "passages")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The same digest by one dictionary, for tests."""
    least: dict[tuple[bytes, ...], int] = {}
    split = [(LAST_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, LAST_ID))
    out = []
    for (own, _), (i, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((own, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out
