"""Seven conflict detectors and their rollup. Each gives conflict_type, severity, issue_id and its own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import first_truthy, seconds_between


def consistency(events: DataFrame, snapshot_closed: DataFrame) -> DataFrame:
    """Issues (issue_id in snapshot_closed) said to be closed without a closing event."""
    created = events.where("event_type = 'IssueCreated'").groupBy(F.col("subject").alias("issue_id")).agg(F.max_by("ts", "seq").alias("created_at"))
    closed = events.where("event_type = 'IssueClosed'").select(F.col("subject").alias("issue_id")).distinct()
    return created.join(snapshot_closed, "issue_id", "left_semi").join(closed, "issue_id", "left_anti").select(F.lit("state_consistency_gap").alias("conflict_type"), F.lit("medium").alias("severity"), "issue_id", "created_at")


def irregularity(intervals: DataFrame, flap_seconds: float = 60.0) -> DataFrame:
    """Reopenings, repeated states and changes of state within flap_seconds, counted by issue; issues without any are left out."""
    order = Window.partitionBy("issue_id").orderBy("valid_from", "seq")
    rows = intervals.withColumn("was", F.lag("state").over(order)).withColumn("gap", seconds_between(F.lag("valid_from").over(order), F.col("valid_from")))
    out = rows.groupBy("issue_id").agg(
        F.count_if((F.col("was") == "closed") & (F.col("state") == "open")).alias("reopen_count"),
        F.count_if(F.col("was") == F.col("state")).alias("redundant_count"),
        F.count_if((F.col("was") != F.col("state")) & (F.abs("gap") < flap_seconds)).alias("flap_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "seq", "state"))), lambda x: F.concat(x.state, F.lit("@"), x.valid_from)), " → ").alias("path"),
    )
    severity = F.when((F.col("reopen_count") > 1) | (F.col("flap_count") > 0), "high").otherwise("medium")
    return out.where("reopen_count + redundant_count + flap_count > 0").select(F.lit("state_irregularity").alias("conflict_type"), severity.alias("severity"), "issue_id", "reopen_count", "redundant_count", "flap_count", "path")


def rapid_closure(events: DataFrame, minutes: float = 10.0) -> DataFrame:
    """Issues closed within minutes of their creation; the last event of each kind counts."""
    last = lambda kind: F.max_by("ts", F.when(F.col("event_type") == kind, F.col("seq")))
    out = events.where(F.col("event_type").isin("IssueCreated", "IssueClosed")).groupBy(F.col("subject").alias("issue_id")).agg(last("IssueCreated").alias("created_at"), last("IssueClosed").alias("closed_at"))
    out = out.withColumn("minutes", seconds_between(F.col("created_at"), F.col("closed_at")) / 60).where((F.col("minutes") > 0) & (F.col("minutes") <= minutes))
    return out.select(F.lit("rapid_closure").alias("conflict_type"), F.when(F.col("minutes") > 5, "low").otherwise("medium").alias("severity"), "issue_id", "created_at", "closed_at", F.bround("minutes", 1).alias("minutes"))


def duplicate_labels(events: DataFrame) -> DataFrame:
    """Labels added to an issue twice or more."""
    out = events.where("event_type = 'LabelAdded'").groupBy(F.col("subject").alias("issue_id"), "label").agg(F.count("*").alias("times"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ts"))), lambda x: x.ts), ",").alias("added_at"))
    return out.where("times >= 2").select(F.lit("duplicate_label").alias("conflict_type"), F.lit("low").alias("severity"), "issue_id", "label", "times", "added_at")


def contradictions(claims: DataFrame) -> DataFrame:
    """Subjects and predicates with two or more claims and more than one distinct value (object where there is no value)."""
    said = first_truthy(F.col("value"), F.col("object"))
    out = claims.groupBy("subject", "predicate").agg(F.count("*").alias("n_claims"), F.array_sort(F.collect_set(said)).alias("values"))
    return out.where((F.col("n_claims") >= 2) & (F.size("values") > 1)).select(F.lit("contradictory_claims").alias("conflict_type"), F.lit("high").alias("severity"), F.col("subject").alias("issue_id"), "predicate", "n_claims", F.array_join("values", ",").alias("values"))


def ownership(events: DataFrame) -> DataFrame:
    """Issues assigned to several people, in the order of their first assignment."""
    out = events.where("event_type = 'AssignedTo'").groupBy(F.col("subject").alias("issue_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "assignee"))), lambda x: x.assignee)).alias("owners"))
    return out.where(F.size("owners") > 1).select(F.lit("ownership_change").alias("conflict_type"), F.when(F.size("owners") > 2, "medium").otherwise("low").alias("severity"), "issue_id", F.array_join("owners", ",").alias("owners"))


def out_of_order(events: DataFrame, arrival: str = "seq") -> DataFrame:
    """Events that arrived after a later one of the same subject. Over time-sorted input, as the plain detector sees it, there are none."""
    before = F.lag("ts").over(Window.partitionBy("subject").orderBy(arrival))
    return events.withColumn("before", before).where("ts < before").select(F.lit("temporal_anomaly").alias("conflict_type"), F.lit("low").alias("severity"), F.col("subject").alias("issue_id"), "source_id", "before", "ts")


def detected(events: DataFrame, intervals: DataFrame, claims: DataFrame, snapshot_closed: DataFrame, flap_seconds: float = 60.0, minutes: float = 10.0, arrival: str = "seq") -> list[DataFrame]:
    """The findings of all seven detectors, each with its own columns."""
    return [consistency(events, snapshot_closed), irregularity(intervals, flap_seconds), rapid_closure(events, minutes), duplicate_labels(events), contradictions(claims), ownership(events), out_of_order(events, arrival)]


def report(conflicts: list[DataFrame]) -> DataFrame:
    """All findings in one table, columns that a detector has not null."""
    out = conflicts[0]
    for c in conflicts[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def rollup(conflicts: list[DataFrame]) -> DataFrame:
    """Counts by severity and by type, and the total, in one pass."""
    every = conflicts[0].select("conflict_type", "severity")
    for c in conflicts[1:]:
        every = every.unionByName(c.select("conflict_type", "severity"))
    return every.groupingSets([["severity"], ["conflict_type"], []], "severity", "conflict_type").agg(F.count("*").alias("n")).select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("conflict_type", F.lit("*")).alias("conflict_type"), "n")
