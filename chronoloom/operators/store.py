"""Store operations as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.sources.tables import keyed, optional


def upsert(current: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """current with the rows of new in place of those with the same key; of several new rows the last in order counts."""
    if order:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current and those rows of new whose key it lacks: known rows are never refreshed."""
    return current.unionByName(new.join(current.select(key), key, "left_anti"))


def supersede(claims: DataFrame, replaced: DataFrame) -> DataFrame:
    """claims (claim_id, status) with those in replaced (claim_id, superseded_by) marked."""
    joined = claims.join(replaced, "claim_id", "left")
    return joined.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def superseded(claims: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """The same, with the new claims (the columns of claims) in the table, in place of those with their ids."""
    return upsert(supersede(claims, replaced), new.withColumn("superseded_by", F.lit(None).cast("string")), "claim_id")


def upsert_entities(entities: DataFrame, aliases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with the new ones in place of those with their ids, and the alias map with the new ones' names leading to them."""
    names = F.array_union(F.filter(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: a != ""), F.array("canonical_name"))
    own = new.select(F.explode(names).alias("name"), "entity_id").groupBy(F.lower("name").alias("alias")).agg(F.max("entity_id").alias("entity_id"))
    return upsert(entities, new, "entity_id"), upsert(aliases, own, "alias")


#: The tables of a store, and the key under which the last of several rows counts.
ARTIFACTS = {"entities": "entity_id", "canonical_claims": "claim_id", "events": None, "merge_log": "merge_id", "aliases": "alias", "states": None, "conflicts": None, "edges": None}


def load(spark: SparkSession, folder: str, schemas: dict[str, str], order: str = "seq") -> dict[str, DataFrame]:
    """The store's tables by name; one that is missing is empty, with its schema. Of rows with one key the last in order counts."""
    out = {}
    for name, key in ARTIFACTS.items():
        if name in schemas:
            df = optional(spark, f"{folder}/{name}", schemas[name])
            out[name] = keyed(df, key, order) if key and order in df.columns else df
    return out


def save(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes tables into a new folder beside the old, so that a table can be written that is read from the old one; gives the paths."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in tables]


def first_with_rows(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, or the last: canonical claims, and claims where there are none yet."""
    for df in tables[:-1]:
        if not df.isEmpty():
            return df
    return tables[-1]


def paged(df: DataFrame, order: str, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page and, in one row, the total of the rows it is from."""
    return page(df, order, offset, limit), df.agg(F.count("*").alias("total"))


def most_common(df: DataFrame, *columns: str) -> DataFrame:
    """Values and their counts, the most frequent first, equals by value."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def reverse_merges(log: DataFrame, current: DataFrame, snapshots: DataFrame, reversed_ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Undoes active merges (merge_id in reversed_ids): the log marked, and current with the snapshots' rows (merge_id, row columns) back."""
    asked = reversed_ids.select("merge_id").distinct().withColumn("__asked", F.lit(True))
    marked = log.join(asked, "merge_id", "left").withColumn("__now", F.coalesce("__asked", F.lit(False)) & (F.col("status") == "active"))
    back = snapshots.join(marked.where("__now").select("merge_id"), "merge_id", "left_semi").drop("merge_id")
    status = F.when(F.col("__now"), "reversed").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("__asked", "__now"), upsert(current, back.dropDuplicates([key]), key)


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def listed(df: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every given value; a missing status is active."""
    for name, value in equal.items():
        if value is not None:
            df = df.where((F.coalesce("status", F.lit("active")) if name == "status" else F.col(name)) == F.lit(value))
    return df


def search_claims(claims: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Claims with the text in their own words or their evidence; with a limit the first in the order of seq."""
    low = F.lit(text.lower())
    own: Column = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "value"))
    out = claims.where(own.contains(low) | F.lower("excerpt").contains(low))
    return out.orderBy("seq", "claim_id").limit(limit) if limit else out


def claims_of(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims whose subject or object is among names (name, lower case). Both ends are exploded and equi-joined, not joined by OR."""
    ends = claims.select("claim_id", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower(F.coalesce("object", F.lit("")))))).alias("name"))
    hit = ends.join(names, "name", "left_semi").select("claim_id").distinct()
    return claims.join(hit, "claim_id", "left_semi")


def metrics(claims: DataFrame, **others: DataFrame) -> DataFrame:
    """Counts, mean confidence and evidence coverage of claims in one aggregate, and total_<name> of each other table.

    A table named merges gives active_merges as well.
    """
    n = F.count("*")
    evidenced = F.count_if(F.coalesce("excerpt", F.lit("")) != "")
    out = claims.agg(
        n.alias("total_claims"), F.count_if(F.col("status") == "active").alias("active_claims"), F.bround(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"),
        evidenced.alias("claims_with_evidence"), F.bround(evidenced / F.greatest(n, F.lit(1)), 3).alias("evidence_coverage"),
    )
    for name, df in others.items():
        counts = [F.count("*").alias(f"total_{name}")]
        if name == "merges":
            counts.append(F.count_if(F.col("status") == "active").alias("active_merges"))
        out = out.join(F.broadcast(df.agg(*counts)), F.lit(True))  # one row each
    return out
