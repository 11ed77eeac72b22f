"""Validity intervals and as-of queries. Intervals are half-open; a null start is always past, a null end always to come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The state after each event.
STATES = {"IssueCreated": "open", "IssueClosed": "closed", "IssueReopened": "open"}


def state_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, state in STATES.items():
        out = F.when(event_type == name, state).otherwise(out)
    return out


def state_intervals(events: DataFrame) -> DataFrame:
    """issue_id, state, caused_by, actor, source_id, seq, valid_from, valid_until: a state holds until the subject's next state event."""
    order = Window.partitionBy("subject").orderBy(F.coalesce("ts", F.lit("")), "seq")
    return (
        events.where(F.col("event_type").isin(*STATES))
        .withColumn("valid_until", F.lead("ts").over(order))
        .select(F.col("subject").alias("issue_id"), state_of(F.col("event_type")).alias("state"), F.col("event_type").alias("caused_by"), "actor", "source_id", "seq", F.col("ts").alias("valid_from"), "valid_until")
    )


def paired_intervals(events: DataFrame, opens: str, closes: str, value: str) -> DataFrame:
    """issue_id, value, source_id, seq, valid_from, valid_until: a closing event ends the latest interval still open for subject and value.

    Windows only: the depth of open intervals is a running sum that unmatched closes do not push below zero, and at one depth opening and
    closing events alternate.
    """
    order = [F.coalesce("ts", F.lit("")), F.col("seq")]
    key = ["subject", value]
    running = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = Window.partitionBy(*key).orderBy(*order)
    rows = (
        events.where(F.col("event_type").isin(opens, closes) & (F.coalesce(F.col(value), F.lit("")) != ""))
        .withColumn("step", F.when(F.col("event_type") == opens, 1).otherwise(-1))
        .withColumn("level", F.sum("step").over(running))
        .withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(running)))
        .withColumn("before", F.coalesce(F.lag("depth").over(steps), F.lit(0)))
        .where((F.col("step") == 1) | (F.col("before") > 0))
        .withColumn("at", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("before")))
    )
    level = Window.partitionBy(*key, "at").orderBy(*order)
    return rows.withColumn("valid_until", F.lead("ts").over(level)).where("step = 1").select(F.col("subject").alias("issue_id"), F.col(value).alias("value"), "source_id", "seq", F.col("ts").alias("valid_from"), "valid_until")


def covers(at: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def state_as_of(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """probes (issue_id, at): adds the state of the last interval that covers the time, ``unknown`` without one. An equi-join on the issue."""
    own = intervals.select(F.col("issue_id").alias("__id"), "state", "valid_from", "valid_until", "seq")
    joined = probes.join(own, (F.col("issue_id") == F.col("__id")) & covers(F.col("at"), F.col("valid_from"), F.col("valid_until")), "left")
    last = F.max_by("state", F.struct("valid_from", "seq"))
    return joined.groupBy(*probes.columns).agg(F.coalesce(last, F.lit("unknown")).alias("state"))


def values_as_of(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """probes (issue_id, at): adds the sorted distinct values whose intervals cover the time, joined by commas."""
    own = intervals.select(F.col("issue_id").alias("__id"), "value", "valid_from", "valid_until")
    joined = probes.join(own, (F.col("issue_id") == F.col("__id")) & covers(F.col("at"), F.col("valid_from"), F.col("valid_until")), "left")
    return joined.groupBy(*probes.columns).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("held"))
