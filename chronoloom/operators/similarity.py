"""Vector similarity: pairs, nearest rows, greedy leader clusters, merging and its log."""

from __future__ import annotations

import itertools
import operator
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import dot, stable_id
from chronoloom.sources.tables import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Rows of a pack, on average; rows of a pack that are multiplied at a time; pairs that are summed exactly at a time.
PACK, TILE, SUMS = 8192, 256, 16384


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose id and vector are whole, with the vector's length; others are similar to none."""
    return rows.where(F.col("id").isNotNull() & ~F.exists("vector", F.isnull)).withColumn("vector", F.col("vector").cast("array<double>")).withColumn("n", F.size("vector"))


def _packs(rows: DataFrame) -> DataFrame:
    """One row per big, n, of and lot of rows (id, block, vector, big, n, of, lot): ids, codes (one for each block in the pack, in order) and the
    vectors' numbers, as 32-bit ones where that loses nothing."""
    kind = dict(rows.dtypes)

    def pack(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(frame.block, use_na_sentinel=False)[0].astype(np.int32)
        order = np.argsort(codes, kind="stable")
        data = np.array(frame.vector.tolist(), np.float64).reshape(len(frame), -1)[order]
        with np.errstate(over="ignore"):
            small = data.astype(np.float32)
        data = small if np.array_equal(small, data) else data
        return pd.DataFrame({"big": [keys[0]], "n": [keys[1]], "of": [keys[2]], "lot": [keys[3]], "ids": [frame.id.to_numpy()[order]], "codes": [codes[order].tobytes()], "data": [data.tobytes()]})

    schema = f"big {kind['big']}, n int, of long, lot long, ids array<{kind['id']}>, codes binary, data binary"
    return rows.select("id", "block", "vector", "big", "n", "of", "lot").groupBy("big", "n", "of", "lot").applyInPandas(pack, schema)


def _numbers(data: bytes, rows: int, n: int) -> np.ndarray:
    found = np.frombuffer(data, np.float32 if len(data) == 4 * rows * n else np.float64) if rows * n else np.zeros(0)
    return found.reshape(rows, n).astype(np.float64)


def _exact(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of x[p] and y[q], summed in the order of the numbers, as dot() does it."""
    sims = np.zeros(len(p))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(0, len(p), SUMS):
            for column in (x[p[k : k + SUMS]] * y[q[k : k + SUMS]]).T:
                sims[k : k + SUMS] += column
    return sims


def _whole(sim: str) -> Column:
    """NaN, which pandas gives back as null."""
    return F.coalesce(sim, F.lit(float("nan")))


def _rounding(x: np.ndarray, y: np.ndarray) -> float:
    """More than the sums of a product of matrices can be off."""
    with np.errstate(over="ignore", invalid="ignore"):
        longest = [np.sqrt(np.einsum("rw,rw->r", v, v).max(initial=0.0)) for v in (x, y)]
    return 8 * (x.shape[1] + 1) * np.finfo(float).eps * float(longest[0]) * float(longest[1])


def _alike(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and similarities of pairs of x and y, or of x, each once, with a similarity of threshold or more (NaN is more)."""
    same, y = y is None, x if y is None else y
    least = threshold - _rounding(x, y)
    for k in range(0, len(x), TILE):
        start = k if same else 0
        with np.errstate(over="ignore", invalid="ignore"):
            met = ~(x[k : k + TILE] @ y[start:].T < least)
        p, q = np.nonzero(np.triu(met, 1) if same else met)
        for m in range(0, len(p), TILE * TILE):
            left, right = p[m : m + TILE * TILE] + k, q[m : m + TILE * TILE] + start
            sims = _exact(x, y, left, right)
            kept = ~(sims < threshold)
            yield left[kept], right[kept], sims[kept]


def pairs(vectors: DataFrame, threshold: float, block: str | None = "block") -> DataFrame:
    """a, b, sim of unit vectors (id, block, vector) in one block with a < b and a similarity of threshold or more; ids are unique.

    All rows of a block are compared. A block of more than ``PACK`` rows is dealt into packs by hashes of ids, smaller blocks share packs; a task
    gets two packs at a time, multiplies them as matrices and sums what may be similar again, exactly. Memory is bounded by the packs, one
    block's work is spread over all tasks; work and copies of rows grow with the square of a block's rows.
    """
    rows = _usable(vectors.select("id", F.col(block).alias("block") if block else F.lit(0).alias("block"), "vector")).where("block is not null")
    counts = settled(rows.groupBy("block", "n").agg(F.count("*").alias("m"), F.ceil(F.count("*") / PACK).alias("of")))
    shared = counts.agg(F.ceil(F.sum(F.when(F.col("of") == 1, F.col("m"))) / PACK)).first()[0] or 1
    dealt = rows.join(counts, ["block", "n"]).withColumn("big", F.when(F.col("of") > 1, F.col("block")))
    packs = _packs(dealt.withColumn("lot", F.when(F.col("of") > 1, F.pmod(F.xxhash64("id"), "of")).otherwise(F.pmod(F.xxhash64("block"), F.lit(shared)))))
    meets = F.when(F.col("of") > 1, F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).otherwise(F.array("lot"))
    cells = packs.withColumn("other", F.explode(meets)).withColumn("i", F.least("lot", "other")).withColumn("j", F.greatest("lot", "other")).drop("other")
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = [row for frame in frames for row in frame.itertuples(index=False)]
        own = [_numbers(row.data, len(row.ids), row.n) for row in met]
        x, ids = own[0], np.asarray(met[0].ids)
        if len(met) == 2:
            parts = [(ids, np.asarray(met[1].ids), _alike(x, own[1], threshold))]
        elif met[0].i != met[0].j:  # the other pack got no rows
            parts = []
        else:
            ends = [0, *(np.flatnonzero(np.diff(np.frombuffer(met[0].codes, np.int32))) + 1), len(ids)]
            parts = ((ids[s:e], ids[s:e], _alike(x[s:e], None, threshold)) for s, e in itertools.pairwise(ends))
        for left, right, found in parts:
            for p, q, sims in found:
                a, b = left[p], right[q]
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                kept = a != b
                yield pd.DataFrame({"a": a[kept], "b": b[kept], "sim": sims[kept]})

    found = cells.groupBy("big", "n", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, sim double")
    return found.withColumn("sim", _whole("sim"))


def bucket_pairs(vectors: DataFrame, threshold: float, planes: int = 8, tables: int = 16, seed: int = 5) -> DataFrame:
    """a, b, sim of unit vectors (id, vector) of any block, a < b, similarity of threshold or more: only rows that lie on the same side of
    all planes of some table are compared, so a pair may be missed, and every pair given is exact.

    With cosine s the sides of one plane agree with probability 1 - acos(s) / pi; planes and tables set the share of pairs found.
    """
    first = vectors.select(F.size("vector").alias("n")).first()
    width = first.n if first else 1
    drawn = np.random.default_rng(seed).normal(size=(tables, planes, width))

    @F.pandas_udf("array<long>")
    def keys(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        side = np.einsum("tpw,rw->rtp", drawn, np.array(rows.tolist(), np.float64)) > 0
        return pd.Series(list((side * (1 << np.arange(planes))).sum(2) + (np.arange(tables) << planes)))

    entries = vectors.select("id", F.explode(keys("vector")).alias("cell"))
    met = entries.select(F.col("id").alias("a"), "cell").join(entries.select(F.col("id").alias("b"), "cell"), "cell").where("a < b").select("a", "b").distinct()
    left, right = vectors.select(F.col("id").alias("a"), F.col("vector").alias("u")), vectors.select(F.col("id").alias("b"), F.col("vector").alias("v"))
    return met.join(left, "a").join(right, "b").withColumn("sim", dot(F.col("u"), F.col("v"))).where(F.col("sim") >= threshold).select("a", "b", "sim")


#: Open links that one task decides one after the other, at most; so few that another round would take longer; a share of links that shows that rounds don't get on.
MOST_LINKS, FEW_LINKS, SLOW = 1_000_000, 10_000, 0.9


def _in_order(open_: DataFrame, most: int, whole: bool) -> DataFrame:
    """The first ``most`` open links (a, b, sim, led), by b and a, decided one row after the other: id, leader, sim. The last row may have more
    links than were read: it is decided only by a leader among them."""
    kind = open_.schema["b"].dataType.simpleString()

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["b", "a"])
        leads, out = {}, []
        last = None if whole or not len(frame) else frame.b.iloc[-1]
        for b, links in itertools.groupby(zip(frame.b, frame.a, frame.sim, frame.led), key=operator.itemgetter(0)):
            # an undecided row without open links is no b, and leads
            hit = next(((b, a, sim) for _, a, sim, led in links if led or leads.get(a, True)), None)
            leads[b] = hit is None
            if hit or whole or b != last:
                out.append(hit or (b, b, 1.0))
        return pd.DataFrame(out, columns=["id", "leader", "sim"])

    return open_.orderBy("b", "a").limit(most).groupBy().applyInPandas(decide, f"id {kind}, leader {kind}, sim double")


def leaders_of(rows: DataFrame, pairs: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """Greedy leader clusters of rows (id) in the order of ids, from pairs (a, b, sim) of similar rows with a < b: id, leader, sim.

    In rounds: links to rows that follow go; a row without links leads, and a row whose first link is to a leader follows it. Rounds are few
    (11 for 51,282 rows of ten blocks) unless rows hang on each other in a long chain. Where a round leaves most links open, or few are left, the first
    ``most_links`` are decided in order by one task, so any chain ends, and no block meets in one task.
    """
    decided, links = [], None
    todo, open_ = settled(rows.select("id")), settled(pairs.select("a", "b", "sim", F.lit(False).alias("led")))
    while not todo.isEmpty():
        before, links = links, open_.count()
        if before is not None and 0 < links and (links <= FEW_LINKS or links > SLOW * before):
            now = _in_order(open_, most_links, links <= most_links)
        else:
            first = open_.groupBy("b").agg(F.min(F.struct("a", "sim", "led")).alias("first"))
            alone = todo.join(first, todo["id"] == first["b"], "left_anti").select("id", F.col("id").alias("leader"), F.lit(1.0).alias("sim"))
            now = alone.unionByName(first.where("first.led").select(F.col("b").alias("id"), F.col("first.a").alias("leader"), F.col("first.sim").alias("sim")))
        decided.append(settled(now))
        todo = settled(todo.join(decided[-1], "id", "left_anti"))
        heads = reduce(DataFrame.unionByName, decided).where("id = leader").select(F.col("id").alias("a"), F.lit(True).alias("led"))
        alive = heads.unionByName(todo.select(F.col("id").alias("a"), F.lit(False).alias("led")))
        open_ = settled(open_.drop("led").join(alive, "a").join(todo.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "sim", "led"))
    return reduce(DataFrame.unionByName, decided) if decided else todo.select("id", F.col("id").alias("leader"), F.lit(1.0).alias("sim"))


def near_comments(comments: DataFrame, embedded: Callable[[Column], Column], threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Comments (subject, seq, source_id, body) without those that are much like an earlier one of their subject, and the log of merges."""
    vectors = comments.select(F.col("source_id").alias("id"), "seq", F.col("subject").alias("block"), embedded(F.col("body")).alias("vector"))
    members = leaders(vectors, threshold)
    return comments.join(members.where("id = leader").select(F.col("id").alias("source_id")), "source_id", "left_semi"), merge_log(members, "artifact")


def canonical_claims(claims: DataFrame, members: DataFrame) -> DataFrame:
    """claims (claim_id, …, confidence, excerpt, source_id, seq) merged by their clusters (members: id, leader, sim): the leader's own
    words, the highest confidence, the evidence of all in order, all sources, their number, and the mean similarity to the leader."""
    joined = claims.join(members.select(F.col("id").alias("claim_id"), "leader", "sim"), "claim_id")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("excerpt", F.lit("")) != "", F.struct("seq", "claim_id", F.struct("source_id", F.col("subject").alias("issue_id"), "excerpt", F.col("created_at").alias("timestamp")).alias("e"))))), lambda x: x["e"])
    sums = joined.groupBy("leader").agg(
        F.bround(F.max("confidence"), 3).alias("confidence"), said.alias("evidence"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("support_count"),
        F.avg(F.when(F.col("claim_id") != F.col("leader"), F.col("sim"))).alias("similarity"),
    )
    own = claims.select(F.col("claim_id").alias("leader"), "claim_type", "subject", "predicate", "object", "value")
    named = stable_id(12, F.col("claim_type"), F.col("subject"), F.col("predicate"), null="None")
    return own.join(sums, "leader").select(named.alias("claim_id"), F.col("leader").alias("first_claim_id"), "claim_type", "subject", "predicate", "object", "value", "confidence", "evidence", "source_ids", "support_count", "similarity", F.lit("active").alias("status"))


def nearest(vectors: DataFrame, query: list[float], k: int, above: float | None = None) -> DataFrame:
    """The k rows nearest to a vector, ties by id, then those above a similarity."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.select("id", dot(F.col("vector"), asked).alias("sim")).orderBy(F.desc("sim"), "id").limit(k)
    return out.where(F.col("sim") > above) if above is not None else out


#: Queries in a pack, on average.
QUERY_PACK = 4096


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, above: float | None = None) -> DataFrame:
    """qid, id, sim, place: the k rows nearest to each query (qid, vector), ties by id, then those above a similarity; qids are unique.

    Every pack of queries meets every pack of rows once. The task multiplies them as matrices, some queries at a time, sums what could be among the
    k best again, exactly, and hands on the k best of each query. Memory is bounded by the packs; no vector goes through the driver.
    """
    kind, qkind = vectors.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    asked, rows = _usable(queries.select(F.col("qid").alias("id"), "vector")), _usable(vectors.select("id", "vector"))
    count = lambda df, size, name: df.groupBy("n").agg(F.ceil(F.count("*") / size).alias(name))
    counts = settled(count(asked, QUERY_PACK, "i").join(count(rows, PACK, "j"), "n"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        lots = df.join(counts, "n").select("id", F.lit(0).alias("block"), "vector", F.col(other).alias("big"), "n", F.col(own).alias("of"), F.pmod(F.xxhash64("id"), own).alias("lot"))
        return _packs(lots).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("big") - 1)))

    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    cells = dealt(asked, "i", "j").select("n", F.col("lot").alias("i"), F.col("other").alias("j"), F.col("ids").alias("qids"), none(kind).alias("ids"), "data")
    cells = cells.unionByName(dealt(rows, "j", "i").select("n", F.col("other").alias("i"), F.col("lot").alias("j"), none(qkind).alias("qids"), "ids", "data"))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = sorted((row for frame in frames for row in frame.itertuples(index=False)), key=lambda row: row.qids is None)
        if len(met) < 2:  # the other pack got no rows
            return
        qids, ids = np.asarray(met[0].qids), np.asarray(met[1].ids)
        x, y = _numbers(met[0].data, len(qids), met[0].n), _numbers(met[1].data, len(ids), met[1].n)
        slack = _rounding(x, y)
        for s in range(0, len(x), TILE):
            with np.errstate(over="ignore", invalid="ignore"):
                sims = x[s : s + TILE] @ y.T
                # all that could be among the k best, ties and rounding included
                least = np.partition(sims, -k, axis=1)[:, -k][:, None] if len(y) > k else np.full((len(sims), 1), -np.inf)
                near = ~(sims < (least if above is None else np.fmax(least, above)) - slack)
            p, q = np.nonzero(near)
            found = pd.DataFrame({"p": p + s, "id": ids[q], "sim": _exact(x, y, p + s, q)})
            found = found.sort_values(["p", "sim", "id"], ascending=[True, False, True], na_position="first").groupby("p", sort=False).head(k)
            yield pd.DataFrame({"qid": qids[found.p.to_numpy()], "id": found.id.to_numpy(), "sim": found.sim.to_numpy()})

    found = cells.groupBy("n", "i", "j").applyInPandas(best, f"qid {qkind}, id {kind}, sim double").withColumn("sim", _whole("sim"))
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "id"))).where(F.col("place") <= k)
    return top.where(F.col("sim") > above) if above is not None else top


def leaders(vectors: DataFrame, threshold: float) -> DataFrame:
    """Greedy leader clusters in each block of unit vectors (id, block, vector), in the order of seq, if there is one, and id: id, leader, sim.

    A row joins the earliest leader that is similar enough, else it leads. A block's leaders are held in memory; blocks are independent.
    """

    order = ["seq", "id"] if "seq" in vectors.columns else ["id"]

    def run(frames: pd.DataFrame) -> pd.DataFrame:
        frame = frames.sort_values(order)
        rows = np.array(frame.vector.tolist(), np.float64)
        ids, heads, found, sims = frame.id.to_numpy(), [], [], []
        for i in range(len(rows)):
            near = rows[heads] @ rows[i] if heads else np.zeros(0)
            hit = np.flatnonzero(near >= threshold)
            if len(hit):
                found.append(ids[heads[hit[0]]])
                sims.append(float(near[hit[0]]))
            else:
                heads.append(i)
                found.append(ids[i])
                sims.append(1.0)
        return pd.DataFrame({"id": ids, "leader": found, "sim": sims})

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select(*order, "block", "vector").groupBy("block").applyInPandas(run, f"id {kind}, leader {kind}, sim double")


def merged(members: DataFrame) -> DataFrame:
    """members (id, leader, sim, confidence, evidence): the leader's highest confidence, evidence in the members' order, support, mean similarity."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "evidence"))), lambda x: x.evidence), "|")
    return members.groupBy("leader").agg(F.bround(F.max("confidence"), 3).alias("confidence"), ordered.alias("evidence"), F.count("*").alias("support_count"), F.avg(F.when(F.col("id") != F.col("leader"), F.col("sim"))).alias("similarity"))


def merge_log(members: DataFrame, kind: str) -> DataFrame:
    """One row per cluster of several: merge_id follows from kind, members and target, so a second run logs the same."""
    others = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("leader"), F.col("id")))), lambda x: x.cast("string")), ",")
    out = members.groupBy("leader").agg(others.alias("merged_ids"), F.count("*").alias("size")).where("size > 1")
    sims = members.where("id <> leader").groupBy("leader").agg(F.avg("sim").alias("similarity"))
    out = out.join(sims, "leader", "left")
    return out.select(F.bround("similarity", 6).alias("similarity"), stable_id(12, F.lit(kind), F.col("merged_ids"), F.col("leader")).alias("merge_id"), F.lit(kind).alias("merge_type"), F.col("leader").alias("target_id"), "merged_ids", F.concat(F.lit("cluster of "), F.col("size")).alias("reason"), F.lit("active").alias("status"))


def with_snapshots(log: DataFrame, members: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Adds snapshot, the rows that each merge changed (of the members other than the leader, and the leader), as JSON in the order of ids."""
    was = members.join(rows, members["id"] == rows[key]).groupBy("leader").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(*(rows[c] for c in rows.columns)).alias("row")))), lambda x: x["row"])).alias("snapshot"))
    return log.join(was, log["target_id"] == was["leader"], "left").select(*log.columns, "snapshot")
