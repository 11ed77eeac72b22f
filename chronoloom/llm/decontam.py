"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a mask over consecutive words: words under a 1 are hashed, words under a 0 may differ. Each benchmark item and each document
gives the hashes of all positions under every seed; equal hashes are hits, which fix how item and document lie on each other. Around each
hit the item's words are compared with the document's: the item counts as leaked if, somewhere in it, ``window`` consecutive words (all,
in shorter items) agree with the document in at least ``least_share`` of their places. So substituted words do not hide a leak.

The seeds miss nothing that the comparison would accept: of every way to choose the places of the words that may differ, in 16 words or
any shorter item down to 10, some position of some seed has ones on the others only (a test tries all of them). Items of 7 to 9 words are
asked by seeds of their own, and items of fewer are found where all their words stand unchanged.

The benchmark's hashes are broadcast if they are few, its words if their bytes are, else both sides are shuffled; so are the hits with the
documents they verify.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_BYTES, materialise, meet, require, row_key, sized, sized_bytes, with_key

SEEDS = ("111011", "1101011", "11100101")
#: Items of fewer than LONG words, and of SHORT at least, are asked by these.
SHORT_SEEDS = ("1111", "11101")
LONG, SHORT = 10, 7
WINDOW = 16
LEAST_SHARE = 0.8


def words_of(column: str) -> str:
    return rf"filter(split(lower(coalesce({column}, '')), r'[^\p{{L}}\p{{N}}]+', -1), w -> w <> '')"


def seed_hashes(seeds: tuple[str, ...], codes: str = "codes") -> list[str]:
    """SQL for the hashes of all positions under each seed, of an array of words' hashes."""
    out = []
    for seed in seeds:
        k, span, places = int(seed, 2), len(seed), [i for i, c in enumerate(seed) if c == "1"]
        own = ", ".join("c" if i == 0 else f"get({codes}, i + {i})" for i in places)
        out.append(f"transform(slice({codes}, 1, greatest(size({codes}) - {span - 1}, 0)), (c, i) -> xxhash64({k}, {own}))")
    return out


def positions(df: DataFrame, keys: list[str], seeds: tuple[str, ...]) -> DataFrame:
    """keys, pos, hash of every seed at every position of codes."""
    hashed = df.selectExpr(*keys, *(f"{x} as s{k}" for k, x in enumerate(seed_hashes(seeds))))
    flat = hashed.selectExpr(*keys, *(f"size(s{k}) as n{k}" for k in range(len(seeds))), f"posexplode(concat({', '.join(f's{k}' for k in range(len(seeds)))})) as (at, hash)")
    pos = "at"
    for k in range(len(seeds) - 1):
        before = " + ".join(f"n{j}" for j in range(k + 1))
        pos = f"case when at >= {before} then at - ({before}) else {pos} end"
    return flat.selectExpr(*keys, f"{pos} as pos", "hash")


def find(
    docs: DataFrame, benchmark: DataFrame, seeds: tuple[str, ...] = SEEDS, short_seeds: tuple[str, ...] = SHORT_SEEDS, window: int = WINDOW, least_share: float = LEAST_SHARE, limit: int = 200_000, limit_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per leaked item and row key of docs: doc_id, h (row_key's hash of the text), item_id, start (word of the document), matched, share.

    docs: doc_id, text. benchmark: item_id, text. Other columns of either, whatever their names, are not read. Null and empty texts have no
    words and are never found. Items of fewer than ``SHORT`` words are found where all their words stand unchanged. Items with equal words
    count as the one with the smallest id. Repeated rows share their findings. Of equally good places the first counts. Texts of any
    length are read whole; an empty table on either side gives an empty result.
    """
    require(docs, ["doc_id", "text"])
    require(benchmark, ["item_id", "text"])
    items = materialise(
        benchmark.selectExpr("item_id", f"{words_of('text')} as iwords").groupBy("iwords").agg(F.min("item_id").alias("item_id")).selectExpr("item_id", "iwords").where(F.size("iwords") > 0)
    )
    item_codes = items.selectExpr("item_id", "transform(iwords, w -> xxhash64(w)) as codes")
    n = F.size("codes")
    lengths = [r.n for r in items.select(F.least(F.size("iwords"), F.lit(LONG)).alias("n")).distinct().orderBy("n").collect()]
    asked, masks = positions(item_codes.where(n >= LONG), ["item_id"], seeds), list(seeds) if LONG in lengths else []
    if any(SHORT <= k < LONG for k in lengths):
        asked = asked.unionByName(positions(item_codes.where((n >= SHORT) & (n < LONG)), ["item_id"], short_seeds))
        masks += short_seeds
    for k in lengths:
        if k < SHORT:
            asked = asked.unionByName(positions(item_codes.where(n == k), ["item_id"], ("1" * k,)))
            masks += [] if "1" * k in masks else ["1" * k]
    asked = materialise(asked.select("item_id", F.col("pos").alias("ipos"), "hash"))
    n_asked, item_bytes = asked.count(), F.octet_length(F.array_join("iwords", " "))
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text"))["h"].alias("h"), "text")
    coded = rows.selectExpr("doc_id", "h", f"transform({words_of('text')}, w -> xxhash64(w)) as codes")
    hits = (
        positions(coded, ["doc_id", "h"], tuple(masks) or seeds)
        .join(sized(asked, n_asked, limit), "hash")
        .select("doc_id", "h", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        .distinct()
    )
    hits = materialise(hits).select(F.col("doc_id").alias("kid"), F.col("h").alias("kh"), "item_id", "diagonal")
    keys = materialise(hits.select("kid", "kh").distinct())
    # words are told apart for documents with hits only
    near = rows.join(sized(keys, keys.count(), limit), rows["doc_id"].eqNullSafe(keys["kid"]) & (rows["h"] == keys["kh"]), "left_semi").select("doc_id", "h", F.expr(words_of("text")).alias("words"))
    laid = near.join(sized(hits, hits.count(), limit), near["doc_id"].eqNullSafe(hits["kid"]) & (near["h"] == hits["kh"])).join(sized_bytes(items, item_bytes, limit_bytes), "item_id")
    same = laid.selectExpr("doc_id", "h", "item_id", "diagonal", f"least({window}, size(iwords)) as wide", "transform(iwords, (w, j) -> case when get(words, diagonal + j) = w then 1 else 0 end) as same")
    sums = same.selectExpr("doc_id", "h", "item_id", "diagonal", "wide", "same", "transform(sequence(0, size(same) - wide), s -> aggregate(slice(same, s + 1, wide), 0, (a, x) -> a + x)) as matches")
    scored = sums.selectExpr("doc_id", "h", "item_id", "diagonal", "array_max(matches) as matched", "array_max(matches) / wide as share", "greatest(0, diagonal + array_position(matches, array_max(matches)) - 1) as start")
    best = F.max(F.struct("share", "matched", (-F.col("diagonal")).alias("earlier"), "start")).alias("best")
    return scored.where(F.col("share") >= least_share).groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "h", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.matched").cast("long").alias("matched"), F.col("best.share").alias("share"))


def summary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, item_id (the best, smallest of equals), start, share. None found: nulls and 0."""
    best = F.min(F.struct((-F.col("share")).alias("s"), "item_id", "start"))
    per = materialise(found.groupBy("doc_id", "h").agg(F.count("*").alias("n_items"), best.alias("b")))
    rows, h = with_key(docs.select("doc_id", "text"))
    out = meet(rows, h, per, "left", per.count())
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("b.item_id").alias("item_id"), F.col("b.start").alias("start"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found, all columns kept, whatever their names."""
    found = materialise(find(docs, benchmark, **options).select("doc_id", "h").distinct())
    rows, h = with_key(docs)
    return meet(rows, h, found, "left_anti", found.count()).drop(h)
