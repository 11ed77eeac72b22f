"""Readers: Parquet tables, optional datasets, and the canonical event stream of the test tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from chronoloom.functions.scalar import stable_id

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet dataset, or an empty one with the schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def settled(df: DataFrame) -> DataFrame:
    """A small table that is read several times, evaluated once: a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only a local session that names no folder gets a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="chronoloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keyed(df: DataFrame, key: str, order: str = "seq", last: bool = True) -> DataFrame:
    """One row per key: the last in order, as a keyed load keeps it, or the first."""
    best = F.max_by if last else F.min_by
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(best(rest, order).alias("row")).select(key, "row.*").select(*df.columns)


def canonical_events(events: DataFrame) -> DataFrame:
    """The events table as an issue tracker's stream: seq, source_id, subject, ts (ISO-8601 text), actor, event_type, assignee, label."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    name = (
        F.when(kind == "signup", "IssueCreated").when(kind == "purchase", "IssueClosed")
        .when(kind == "view", F.when(k < 20, "IssueReopened").otherwise("CommentAdded"))
        .when(kind == "click", F.when(k % 2 == 0, "AssignedTo").otherwise("Unassigned"))
        .otherwise(F.when(k % 3 != 0, "LabelAdded").otherwise("LabelRemoved"))
    )
    return events.select(
        F.col("event_id").alias("seq"),
        stable_id(16, F.lit("evt"), F.col("event_id")).alias("source_id"),
        F.concat(F.lit("issue_"), F.col("user_id")).alias("subject"),
        F.date_format("ts", ISO).alias("ts"),
        F.concat(F.lit("user_"), k % 20).alias("actor"),
        name.alias("event_type"),
        F.when(kind == "click", F.concat(F.lit("user_"), F.floor(k / 2) % 5)).alias("assignee"),
        F.when(kind == "error", F.concat(F.lit("label_"), F.floor(k / 3) % 7)).alias("label"),
    )


def comments(conversations: DataFrame) -> DataFrame:
    """Conversation turns as comments: subject, seq, actor, source_id and a body with a reference and, now and then, a decision word."""
    n = F.col("conv_id") * 100 + F.col("turn")
    body = F.concat(F.col("text"), F.lit(" #"), n % 50, F.when(n % 5 == 0, " Approved").otherwise(""), F.when(n % 7 == 0, " duplicate").otherwise(""))
    return conversations.select(F.concat(F.lit("issue_"), F.col("conv_id")).alias("subject"), n.alias("seq"), F.col("role").alias("actor"), stable_id(16, F.lit("turn"), n).alias("source_id"), body.alias("body"))


def first_of(df: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """First-wins distinct."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
