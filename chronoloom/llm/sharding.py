"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash of their id and ranked; rank r of n stands at (2 r - 1) / (2 n) of the way. Sorting
all rows by that share interleaves the sources in proportion, and cutting the order into stretches of equal length gives shards that each
have the whole mixture. Counts differ by at most one row.

Neither ranking brings a source, or all rows, into one task: rows are range-partitioned by the whole sort key, to which the number that
Spark gives each row is added last, so that even a third of all rows alike in everything are split. A row's rank is its place in its
partition plus the rows of the partitions before. Equal texts are not kept together: interleaving has no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import fresh, materialise, quoted, require, sized

SHARDS = 8
SEED = "mix-1"
#: Bits of monotonically_increasing_id that count the rows of a partition; the others are the partition's number.
_ROW_BITS = 33


def shuffle_key(seed: str) -> str:
    """SQL for 60 bits of the MD5 of seed and id."""
    return f"cast(conv(substring(md5(cast(concat('{seed}:', coalesce(cast(doc_id as string), 'null')) as binary)), 1, 15), 16, 10) as bigint)"


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of all rows; evaluated once. One row a partition is all that meets in a task."""
    made, part, before = fresh(df, "made", "part", "before")
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(made, F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright(made, _ROW_BITS).alias(part)).agg(F.count("*").alias("n"))
    firsts = materialise(counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)))
    joined = placed.join(sized(firsts, firsts.count()), F.shiftright(made, _ROW_BITS) == F.col(part))
    return joined.withColumn(name, F.col(made).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col(before)).drop(made, part, before)


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, stratum: str = "source", keep: bool = False) -> DataFrame:
    """Gives every row of docs (doc_id, text and the stratum's column) doc_id, size, text_crc32, shard and slot.

    size is the text's UTF-8 bytes plus one, one for null. A null stratum is a stratum of its own. Rows that share an id (or have none)
    follow each other by text; rows alike in stratum, id and text can be exchanged without a difference. Rows of two sources with equal
    shares are in the order of the sources' names. Equal texts are not kept together: only the rows' number is held even. Texts of any
    length count by their size. Other columns are not read; with keep, all columns of docs come along in a struct named row. An empty
    table gives an empty result.
    """
    require(docs, ["doc_id", "text", stratum])
    light = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").__add__(1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(quoted(stratum)).cast("string")), F.lit("null")).alias("stratum"),
        F.expr(shuffle_key(seed)).alias("key"),
        F.monotonically_increasing_id().alias("n"),
        *([F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")] if keep else []),
    )
    rows = ["row"] if keep else []
    # evaluated once, so that n stays what it is
    placed = numbered(materialise(light), ["stratum", "key", "doc_id", "text_crc32", "size", "n"], "place")
    sizes = materialise(placed.groupBy("stratum").agg(F.min("place").alias("first"), F.count("*").alias("of")))
    total = sizes.agg(F.sum("of")).first()[0] or 0
    shares = placed.join(sized(sizes, sizes.count()), "stratum").withColumn("share", (2.0 * (F.col("place") - F.col("first") + 1) - 1.0) / (2.0 * F.col("of")))
    mixed = numbered(shares.select("doc_id", "size", "text_crc32", "stratum", "share", *rows), ["share", "stratum"], "at")
    return (
        mixed.withColumn("shard", F.floor(F.col("at") * shards / F.lit(max(1, total))).cast("int"))
        .withColumn("slot", F.col("at") - F.ceil(F.col("shard").cast("long") * F.lit(total) / F.lit(shards)).cast("long"))
        .select("doc_id", "size", "text_crc32", "shard", "slot", *rows)
    )


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes all rows of docs into one folder per shard, in the order of their slots. A column shard of docs is replaced."""
    assigned = assign(docs, keep=True, **options)
    (slot,) = fresh(docs, "slot")
    rows = assigned.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "shard"), "shard", F.col("slot").alias(slot))
    rows.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").mode("overwrite").parquet(path)


def digest(assigned: DataFrame) -> DataFrame:
    return assigned.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL for doc_id, shard, slot and size; CRC-32 is not in DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, coalesce(text, '') AS text,
       coalesce('=' || source, 'null') AS stratum,
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key FROM documents),
r AS (SELECT *, (2.0::DOUBLE * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) - 1.0) / (2.0::DOUBLE * count(*) OVER (PARTITION BY stratum)) AS share FROM d),
a AS (SELECT *, row_number() OVER (ORDER BY share, stratum) - 1 AS pos, count(*) OVER () AS total FROM r),
s AS (SELECT *, CAST(floor(pos * {SHARDS} / total::DOUBLE) AS INTEGER) AS shard FROM a)
SELECT doc_id, shard, pos - CAST(ceil(shard * total / {SHARDS}.0::DOUBLE) AS BIGINT) AS slot, size FROM s
"""
