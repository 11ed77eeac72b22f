"""Near duplicates by 64-bit SimHash and the generalised pigeonhole principle.

Two fingerprints within ``distance`` bits agree, in at least one of the parts that the bits are split into, up to that part's threshold,
if the thresholds plus one sum up to distance + 1. Bits that are set together are grouped into one part, so that the other parts tell
more. For each fingerprint a dynamic program over the parts chooses the thresholds (-1: the part isn't probed) with the fewest
candidates, estimated from histograms of each part's halves over all fingerprints. The fingerprint probes all values within the
threshold of its own; candidates are verified on all bits.

Equal fingerprints meet once, so groups of copies cost nothing here. A probed cell with more than ``dense`` fingerprints would give all
its pairs; its fingerprints are instead linked exactly through midpoints: two fingerprints are at most two bits apart if and only if
some value is at most one bit from both, and at most 65 fingerprints share such a value.

Texts that are alike to some share, ``alike``, differ in more bits than two, at which each value probed is met by many strangers. There the
cells are narrowed by the number of shingles, which must be as near as the share says, candidates within the distance are verified on 16
min-wise hashes of the shingles as well, and a cell's links leave its task as a spanning forest, not as pairs. Cells with more than
``crowd`` rows are cut into a grid of smaller ones.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, meet, mixed, ranges, release_memory, require, row_key, ship_by_value, sized, text_buffers, with_key
from chronoloom.llm.components import connected_components

ship_by_value(__name__)

BITS = 64
DISTANCE = 2
PARTS = 3
SHINGLE = 3
SEED = 42
DENSE = 256
#: For texts alike to a share: five-word shingles, and the distance and parts that hold most texts 0.8 alike.
ALIKE_SHINGLE = 5
ALIKE_DISTANCE = 12
ALIKE_PARTS = 7
ALIKE = 0.8
#: Of 16 min-wise hashes so many must agree.
MINIMA = 16
LEAST_MINIMA = 10
CROWD = 200_000
#: Candidates that are compared at a time.
COMPARED = 500_000

_MINIMA_FACTORS = np.random.default_rng(7).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes | None, shingle: int) -> Iterator[bytes]:
    words = (text or b"").lower().split()
    if len(words) < shingle:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))


def sketch(text: bytes | None, shingle: int = ALIKE_SHINGLE, seed: int = SEED) -> tuple[int, int, bytes]:
    """The fingerprint, the number of shingles, and one byte of each of the min-wise hashes."""
    counts, n, least = np.zeros(BITS, np.int64), 0, np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    shingles = shingles_of(text, shingle)
    while part := [xxhash.xxh64_digest(s, seed) for s in itertools.islice(shingles, 20_000)]:
        raw = np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int32)
        own = np.unique(raw.view(">u8").ravel().astype(np.uint64))
        for k, factor in enumerate(_MINIMA_FACTORS):
            # a product's high bits depend on all bits of the hash
            least[k] = min(least[k], (own * factor).min())
        n += len(part)
    bits = np.packbits(2 * counts > n).tobytes() if n else bytes(8)
    return int.from_bytes(bits, "big"), n, (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    shingles = shingles_of(text, shingle)
    digest, counts, n = xxhash.xxh64_digest, np.zeros(BITS, np.int64), 0
    while part := [digest(s, seed) for s in itertools.islice(shingles, 50_000)]:
        counts += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, sketched: bool = False) -> DataFrame:
    """doc_id, h (row_key's hash of the text) and fp (the 64 bits as a signed long) of every row; the fp of a text without words is zero.

    sketched adds n, the number of shingles, and minima, 16 bytes.
    """
    require(docs, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, names = [batch.column(0), batch.column(1)], ["doc_id", "h", "fp"]
            if sketched:
                own = [sketch(t.as_py(), shingle, seed) for t in batch.column(2)]
                head += [pa.array([signed(f) for f, _, _ in own], pa.int64()), pa.array([n for _, n, _ in own], pa.int64()), pa.array([m for _, _, m in own], pa.binary())]
                names += ["n", "minima"]
            else:
                head.append(pa.array([signed(fingerprint(t.as_py(), shingle, seed)) for t in batch.column(2)], pa.int64()))
            yield pa.RecordBatch.from_arrays(head, names)
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text"))["h"].alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, h bigint, fp bigint" + (", n bigint, minima binary" if sketched else ""))


def gathered(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint side by side, the first lowest."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def bit_groups(fps: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Splits the bits into parts of nearly equal size, correlated bits together. What comes to the driver is one 64 by 64 table."""

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for frame in frames:
            raw = frame.fp.to_numpy().view(np.uint64)
            bits = ((raw[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
            n += len(raw)
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype(np.int64)})

    rows = fps.select("fp").mapInPandas(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    together = np.zeros(BITS * BITS + 1)
    for r in rows:
        together[r.cell] = r.n
    n, together = max(1.0, together[-1]), together[:-1].reshape(BITS, BITS)
    share = np.diag(together) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    alike = np.abs(together / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    sizes = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    free, groups = set(range(BITS)), []
    for size in sizes:
        group = [max(sorted(free), key=lambda b: sum(alike[b, c] for c in free))]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: sum(alike[b, c] for c in group))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_counts(counts: np.ndarray, width: int, distance: int) -> np.ndarray:
    """near[t, v]: how many of the counted values differ from v in exactly t bits."""
    near = np.zeros((distance + 1, len(counts)))
    near[0] = counts
    for bit in range(width):
        flipped = np.arange(len(counts)) ^ (1 << bit)
        moved = near[:, flipped]
        near = np.vstack([near[:1], near[1:] + moved[:-1]])
    return near


def part_estimates(fps: DataFrame, groups: list[list[int]], distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each part the counts of its two halves' values by distance: tables of at most 2**11 values each, whatever the input."""
    cells = []
    for p, bits in enumerate(groups):
        half = len(bits) // 2
        for h, own in enumerate((bits[:half], bits[half:])):
            value = F.lit(0).cast("long")
            for k, b in enumerate(own):
                value = value.bitwiseOR(F.shiftleft(F.shiftright("fp", b).bitwiseAND(F.lit(1)), k))
            cells.append(F.struct(F.lit(2 * p + h).alias("half"), value.cast("long").alias("value")))
    rows = fps.select(F.explode(F.array(*cells)).alias("c")).groupBy("c").count().select("c.half", "c.value", "count").collect()
    out = []
    for p, bits in enumerate(groups):
        half = len(bits) // 2
        tables = []
        for h, width in enumerate((half, len(bits) - half)):
            counts = np.zeros(1 << width)
            for r in rows:
                if r.half == 2 * p + h:
                    counts[r.value] = r["count"]
            tables.append(near_counts(counts, width, distance))
        out.append((tables[0], tables[1], half))
    return out


def thresholds(costs: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """costs[p, t + 1, i]: candidates of fingerprint i in part p at threshold t, zero at -1. The cheapest thresholds, one row a part.

    Dynamic program over parts: best[s] is the least cost with thresholds plus one summing up to s.
    """
    parts, _, n = costs.shape
    goal = distance + 1
    best = np.full((goal + 1, n), np.inf)
    best[0] = 0
    chosen = np.zeros((parts, goal + 1, n), np.int8)
    for p in range(parts):
        options = np.stack([np.stack([best[s - t] + costs[p, t] if t <= s else np.full(n, np.inf) for t in range(goal + 1)]) for s in range(goal + 1)])
        chosen[p] = options.argmin(1)
        best = options.min(1)
    out, left = np.zeros((parts, n), np.int8), np.full(n, goal)
    for p in reversed(range(parts)):
        t = chosen[p][left, np.arange(n)]
        out[p] = t - 1
        left -= t
    return out


def allocated(raw: np.ndarray, groups: list[list[int]], estimates: list, total: int, distance: int, probe_cost: float = 1.0, most: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts' values of fingerprints, and the thresholds that the dynamic program gives each of them, at most ``most`` in a part."""
    costs = np.full((len(groups), distance + 2, len(raw)), np.inf)
    costs[:, 0] = 0
    values = [gathered(raw, bits) for bits in groups]
    for p, (low, high, half) in enumerate(estimates):
        a, b = low[:, values[p] & ((1 << half) - 1)], high[:, values[p] >> half]
        found, probes = 0.0, 0
        for t in range(min(distance, most) + 1):
            found = found + sum(a[i] * b[t - i] for i in range(t + 1)) / total
            probes += math.comb(len(groups[p]), t)
            costs[p, t + 1] = found + probe_cost * probes
    return values, thresholds(costs, distance)


def flips_within(width: int, threshold: int) -> Iterator[int]:
    for t in range(threshold + 1):
        for places in itertools.combinations(range(width), t):
            yield sum(1 << k for k in places)


def links(fps: DataFrame, n: int, distance: int = DISTANCE, parts: int = PARTS, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that join all within the distance: every such pair, or in dense cells a star of each group."""
    if distance > 2:
        raise ValueError("midpoints of dense cells need a distance of at most 2")
    groups = bit_groups(fps, parts)
    estimates, total = part_estimates(fps, groups, distance), max(1, n)

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = frame.fp.to_numpy().view(np.uint64)
            yield pd.concat([pd.DataFrame({"part": p, "value": gathered(raw, bits), "fp": frame.fp.to_numpy()}) for p, bits in enumerate(groups)])

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, raw = frame.fp.to_numpy(), frame.fp.to_numpy().view(np.uint64)
            values, chosen = allocated(raw, groups, estimates, total, distance)
            for p, bits in enumerate(groups):
                for flip in flips_within(len(bits), distance):
                    use = chosen[p] >= flip.bit_count()
                    if use.any():
                        yield pd.DataFrame({"part": p, "value": values[p][use] ^ flip, "fp": own[use]})

    schema = "part int, value long, fp long"
    index, asked = fps.select("fp").mapInPandas(entries, schema), fps.select("fp").mapInPandas(probes, schema)
    cells = materialise(index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("part", "value"))
    n_cells = cells.count()
    sparse = index
    if n_cells:
        sparse = index.join(sized(cells, n_cells), ["part", "value"], "left_anti")
    pairs = (
        asked.withColumnRenamed("fp", "a")
        .join(sparse.withColumnRenamed("fp", "b"), ["part", "value"])
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    if not n_cells:
        return pairs
    crowd = index.unionByName(asked).join(sized(cells, n_cells), ["part", "value"], "left_semi").select("fp").distinct()
    reach = [F.lit(0).cast("long"), *(F.lit(signed(1 << b)).cast("long") for b in range(BITS))]
    middle = F.explode(F.array(*(F.col("fp").bitwiseXOR(x) for x in (reach if distance == 2 else reach[:1]))))
    if distance < 2:
        middle = F.explode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed((1 << 64) - 1 - (1 << b)))) for b in range(BITS)))) if distance else middle
    met = crowd.select("fp", middle.alias("m"))
    star = met.groupBy("m").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return pairs.unionByName(star.where("a <> b"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as links of each node with its component's smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def cell_links(cell: np.ndarray, asks: np.ndarray, fp: np.ndarray, n: np.ndarray, minima: np.ndarray, distance: int, alike: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between entries and askers of the same cell. Rows are sorted by cell, entries before askers."""
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(cell)))
    entries = size - np.add.reduceat(asks.astype(np.int64), heads) if len(heads) else size
    row = np.flatnonzero(asks)
    of = np.searchsorted(heads, row, "right") - 1
    first, count = heads[of], entries[of]
    row, first, count = row[count > 0], first[count > 0], count[count > 0]
    sums = np.concatenate([[0], np.cumsum(count)])
    left, right, held, at = [], [], 0, 0
    none = np.zeros(0, fp.dtype)
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + COMPARED, "right")) - 1)
        x, y = np.repeat(row[at:to], count[at:to]), ranges(first[at:to], count[at:to])
        near = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= distance
        x, y = x[near], y[near]
        other = (fp[x] != fp[y]) & (np.minimum(n[x], n[y]) >= alike * np.maximum(n[x], n[y]))
        x, y = x[other], y[other]
        same = (minima[x] == minima[y]).sum(1) >= least
        left.append(fp[x[same]])
        right.append(fp[y[same]])
        held += int(same.sum())
        if held > COMPARED:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], len(a)
        at = to
    return forest(np.concatenate(left), np.concatenate(right)) if held else (none, none)


def alike_links(nodes: DataFrame, total: int, distance: int = ALIKE_DISTANCE, parts: int = ALIKE_PARTS, alike: float = ALIKE, least: int = LEAST_MINIMA, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints which at most ``distance`` bits, numbers of shingles as near as the share ``alike``
    and ``least`` equal min-wise hashes link. nodes: fp, n, minima, each fp once."""
    groups = bit_groups(nodes, parts)
    estimates, total, step = part_estimates(nodes, groups, distance), max(1, total), math.log(1 / alike)

    def cells(frames: Iterator[pd.DataFrame], asking: bool) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = frame.fp.to_numpy().view(np.uint64)
            # numbers of shingles near enough lie in one step or in two neighbouring ones
            level = np.floor(np.log(np.maximum(frame.n.to_numpy(), 1)) / step).astype(np.int64) + 1
            rest = {"fp": frame.fp.to_numpy(), "n": frame.n.to_numpy(), "minima": frame.minima.to_numpy()}

            def rows(p: int, value: np.ndarray, level: np.ndarray, use: np.ndarray) -> pd.DataFrame:
                key = ((np.int64(p) << 12 | level) << 40 | value)[use]
                return pd.DataFrame({"key": key, "asks": asking} | {k: v[use] for k, v in rest.items()})

            if asking:
                # a row that is sent costs as much as some hundred comparisons
                values, chosen = allocated(raw, groups, estimates, total, distance, 100.0)
                for p, bits in enumerate(groups):
                    for flip in flips_within(len(bits), int(chosen[p].max(initial=-1))):
                        use = chosen[p] >= flip.bit_count()
                        if use.any():
                            yield rows(p, values[p] ^ flip, level, use)
            else:
                every = np.ones(len(raw), bool)
                for p, bits in enumerate(groups):
                    value = gathered(raw, bits)
                    yield rows(p, value, level, every)
                    yield rows(p, value, level + 1, every)
        release_memory()

    schema = "key long, asks boolean, fp long, n long, minima binary"
    entries = nodes.select("fp", "n", "minima").mapInPandas(lambda frames: cells(frames, False), schema)
    asked = nodes.select("fp", "n", "minima").mapInPandas(lambda frames: cells(frames, True), schema)
    full = materialise(entries.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key", F.ceil(F.col("rows") / crowd).cast("int").alias("k")))
    n_full = full.count()
    every = entries.unionByName(asked)
    if n_full:
        # an entry stands in one row of the grid and all columns, an asker in one column and all rows
        met = every.join(sized(full, n_full), "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        place = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i * F.col("k") + own)).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: own * F.col("k") + j))
        every = met.withColumn("part", F.explode(place.cast("array<long>"))).drop("k")
    else:
        every = every.withColumn("part", F.lit(0).cast("long"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
            changes = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            end = len(key) if last else int(changes[-1]) if len(changes) else 0
            held[:] = t.slice(end).combine_chunks().to_batches()
            if end:
                cell = np.zeros(end, np.int64)
                cell[changes[changes < end]] = 1
                minima, _ = text_buffers(t.column("minima").slice(0, end))
                a, b = cell_links(
                    np.cumsum(cell), t.column("asks").slice(0, end).to_numpy(), t.column("fp").slice(0, end).to_numpy(), t.column("n").slice(0, end).to_numpy(), minima.reshape(-1, MINIMA), distance, alike, least
                )
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        size, due = 0, 200_000
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= due:
                yield from run(False)
                size = sum(b.num_rows for b in held)
                due = max(200_000, 2 * size)
        if held:
            yield from run(True)
        held.clear()
        release_memory()

    sorted_ = every.repartition("key", "part").sortWithinPartitions("key", "part", "asks")
    return sorted_.select("key", "part", "asks", "fp", "n", "minima").mapInArrow(found, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, parts: int = PARTS, shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE, alike: float | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, fp, root and component_id of every row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id among all rows whose fingerprints are joined by links of at most ``distance`` bits, and with
    ``alike`` as ``alike_links`` says; root is the component's smallest fingerprint, h a hash of the text. Texts with one fingerprint are
    linked. A null or wordless text has the fingerprint zero, linked like any other (with alike, to its like only). Rows without id join
    the others; a component without any id has the component_id null. Repeated rows each give a row. Texts of any length are read whole. An
    empty table gives an empty result.
    """
    found = materialise(fingerprints(docs, shingle, seed, alike is not None))
    least = F.min("doc_id").alias("least")
    if alike is None:
        nodes = materialise(found.groupBy("fp").agg(least))
        pairs = links(nodes, nodes.count(), distance, parts, dense)
    else:
        nodes = materialise(found.groupBy("fp").agg(least, F.min(F.struct("h", "n", "minima")).alias("one")).select("fp", "least", "one.n", "one.minima"))
        pairs = alike_links(nodes, nodes.count(), distance, parts, alike, crowd=crowd)
    roots = connected_components(pairs)
    named = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(named.select("fp", "root").join(first, "root"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates, all columns kept, whatever their names: of each component the row with the smallest
    doc_id, ids before nulls.

    Of several such rows the one with the smallest text hash stays; rows alike in that too are copies, and one of them stays. Texts are
    moved only if more rows stay than can be broadcast, and for copies under one id.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    found = materialise(near_duplicates(docs, **options).select("doc_id", "h", "root"))
    kept = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("doc_id"), F.col("best.h").alias("h"))
    times = found.groupBy("doc_id", "h").agg((F.count("*") > 1).alias("repeated"))
    kept = materialise(kept.join(times, kept["doc_id"].eqNullSafe(times["doc_id"]) & (kept["h"] == times["h"])).select(kept["doc_id"], kept["h"], "repeated"))
    rows, h = with_key(docs)
    once, again = kept.where("not repeated").drop("repeated"), kept.where("repeated").drop("repeated")
    n_once, n_again = once.count(), again.count()
    out = meet(rows, h, once, "left_semi", n_once)
    if n_again:
        out = out.unionByName(meet(rows, h, again, "left_semi", n_again).dropDuplicates(["doc_id", h]))
    return out.drop(h)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
