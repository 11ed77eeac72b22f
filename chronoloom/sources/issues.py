"""Nested issue records to a flat event stream, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import first_truthy, stable_id

_USER = "STRUCT<login STRING>"
SCHEMA = (
    f"number BIGINT, title STRING, body STRING, html_url STRING, state STRING, created_at STRING, closed_at STRING, updated_at STRING, user {_USER}, closed_by {_USER}, labels ARRAY<STRUCT<name STRING>>, "
    f"assignees ARRAY<{_USER}>, comments_data ARRAY<STRUCT<id BIGINT, body STRING, created_at STRING, html_url STRING, user {_USER}>>, "
    f"timeline_events ARRAY<STRUCT<id BIGINT, event STRING, created_at STRING, actor {_USER}, user {_USER}, assignee {_USER}, label STRUCT<name STRING>, milestone STRUCT<title STRING>>>"
)

#: Tracker events and the events they become. The texts of their evidence, below, are fixed as well.
KINDS = {
    "closed": "IssueClosed",
    "reopened": "IssueReopened",
    "assigned": "AssignedTo",
    "unassigned": "Unassigned",
    "labeled": "LabelAdded",
    "unlabeled": "LabelRemoved",
    "milestoned": "MilestoneSet",
    "referenced": "Referenced",
    "cross-referenced": "Referenced",
}


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A file with one JSON array of issues, or with one issue a line, which is read by many tasks.

    has_pull_request tells whether the key pull_request is there: one with null counts as present, which a declared schema cannot say.
    """
    text = spark.read.text(path) if lines else spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    issue = text.where(F.col("value") != "").select(F.from_json("value", SCHEMA).alias("i"), F.array_contains(F.json_object_keys("value"), "pull_request").alias("has_pull_request"))
    return issue.where("i is not null").select("i.*", "has_pull_request")


def _event(kind, actor, ts, sid, text, extra=None, full=None, url=None, start=None, end=None) -> F.Column:
    none = F.lit(None)
    return F.struct(
        kind.alias("event_type"), actor.alias("actor"), ts.alias("timestamp"), sid.alias("source_id"), F.substring(text, 1, 500).alias("evidence"), (none.cast("string") if full is None else full).alias("evidence_full"),
        (none.cast("string") if url is None else url).alias("source_url"), (none if start is None else start).cast("int").alias("char_offset_start"), (none if end is None else end).cast("int").alias("char_offset_end"), (_extra() if extra is None else extra).alias("extra"),
    )


def _extra(**given) -> F.Column:
    kinds = {"labels": "array<string>", "state": "string", "is_pull_request": "boolean", "assignee": "string", "label": "string", "milestone": "string", "synthetic": "boolean"}
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def _id(*parts) -> F.Column:
    return stable_id(16, *parts)


def events(issues: DataFrame) -> DataFrame:
    """One row per event, with seq in the order of time, first occurrence of each source_id only.

    Created and comment events, tracker events by the table above (an assignment or labelling without its object is dropped; one whose
    object has no name is kept, as ``unknown`` or without a name), a closing where the issue is closed without one, and an assignment for
    each assignee where there is none. Identifiers hash the kind, the subject and the tracker's own id, which may be missing.
    """
    subject = F.concat(F.lit("issue_"), F.col("number"))
    base = issues.select("*", subject.alias("subject"))
    who = lambda person, other: F.when(F.col(person).isNotNull(), F.coalesce(F.col(f"{person}.login"), F.lit(other))).otherwise(other)
    url, title, body = F.col("html_url"), F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    created = base.select("subject", "number", F.lit(0).alias("part"), F.lit(0).alias("pos"), _event(
        F.lit("IssueCreated"), who("user", "unknown"), F.col("created_at"), _id(F.lit("IssueCreated"), F.col("subject")), title,
        _extra(labels=F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>")), state=F.col("state"), is_pull_request=F.col("has_pull_request")),
        full=F.when(body != "", F.substring(body, 1, 2000)).otherwise(title), url=F.coalesce(url, F.lit("")),
    ).alias("e"))
    said = base.select("subject", "number", F.posexplode("comments_data").alias("pos", "c"))
    words = F.coalesce("c.body", F.lit(""))
    said = said.select("subject", "number", F.lit(1).alias("part"), "pos", _event(
        F.lit("CommentAdded"), who("c.user", "unknown"), F.col("c.created_at"), _id(F.lit("CommentAdded"), F.col("subject"), F.col("c.id")), words,
        full=words, url=F.col("c.html_url"), start=F.lit(0), end=F.least(F.length(words), F.lit(500)),
    ).alias("e"))
    line = base.select("subject", "number", F.coalesce(url, F.lit("")).alias("html_url"), F.posexplode("timeline_events").alias("pos", "t"))
    told = F.col("t.event")
    kind = F.coalesce(*(F.when(told == k, v) for k, v in KINDS.items()))
    actor = F.when(F.col("t.actor").isNotNull(), F.coalesce("t.actor.login", F.lit("system"))).otherwise(F.coalesce("t.user.login", F.lit("system")))
    assignee, label, milestone = F.when(F.col("t.assignee").isNotNull(), F.coalesce("t.assignee.login", F.lit("unknown"))), F.when(F.col("t.label").isNotNull(), F.coalesce("t.label.name", F.lit(""))), F.col("t.milestone.title")
    evidence = (
        F.when(told == "closed", F.lit("Issue closed")).when(told == "reopened", F.lit("Issue reopened")).when(told == "assigned", F.concat(F.lit("Assigned to "), assignee))
        .when(told == "unassigned", F.concat(F.lit("Unassigned "), assignee)).when(told == "labeled", F.concat(F.lit("Label added: "), label)).when(told == "unlabeled", F.concat(F.lit("Label removed: "), label))
        .when(told == "milestoned", F.concat(F.lit("Milestone set: "), F.coalesce(milestone, F.lit("")))).otherwise(F.concat(F.lit("Referenced in event "), F.coalesce(F.col("t.id").cast("string"), F.lit(""))))
    )
    extra = _extra(assignee=F.when(told.isin("assigned", "unassigned"), assignee), label=F.when(told.isin("labeled", "unlabeled"), label), milestone=F.when(told == "milestoned", milestone))
    line = line.select("subject", "number", F.lit(2).alias("part"), "pos", "t", _event(kind, actor, F.col("t.created_at"), _id(F.coalesce("t.event", F.lit("")), F.col("subject"), F.col("t.id")), evidence, extra, url=F.col("html_url")).alias("e"))
    # A dropped row still takes its source_id: the first of an id decides before rows are dropped.
    line = line.withColumn("n", F.row_number().over(Window.partitionBy("e.source_id").orderBy("number", "pos"))).where("n = 1")
    fit = F.col("e.event_type").isNotNull() & (~told.isin("assigned", "unassigned") | F.col("t.assignee").isNotNull()) & (~told.isin("labeled", "unlabeled") | F.col("t.label").isNotNull())
    line = line.where(fit).select("subject", "number", "part", "pos", "e")
    closed = line.where("e.event_type = 'IssueClosed'").select("subject").distinct()
    ended = base.where("state = 'closed'").join(closed, "subject", "left_anti").select("subject", "number", F.lit(3).alias("part"), F.lit(0).alias("pos"), _event(
        F.lit("IssueClosed"), who("closed_by", "system"), first_truthy(F.col("closed_at"), F.col("updated_at"), F.col("created_at")), _id(F.lit("IssueClosed"), F.col("subject"), F.lit("synthetic")),
        F.lit("Issue state is 'closed' (synthesized from snapshot)"), _extra(synthetic=F.lit(True)), url=F.coalesce(url, F.lit("")),
    ).alias("e"))
    assigned = line.where("e.event_type = 'AssignedTo'").select("subject").distinct()
    own = base.join(assigned, "subject", "left_anti").select("subject", "number", "created_at", "html_url", F.posexplode("assignees").alias("pos", "a")).withColumn("name", F.coalesce("a.login", F.lit("unknown")))
    owned = own.select("subject", "number", F.lit(4).alias("part"), "pos", _event(
        F.lit("AssignedTo"), F.lit("system"), F.col("created_at"), _id(F.lit("AssignedTo"), F.col("subject"), F.col("name"), F.lit("synthetic")),
        F.concat(F.lit("Assigned to "), F.col("name"), F.lit(" (from snapshot)")), _extra(assignee=F.col("name"), synthetic=F.lit(True)), url=F.coalesce(url, F.lit("")),
    ).alias("e"))
    every = created.unionByName(said).unionByName(line).unionByName(ended).unionByName(owned)
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("e.source_id").orderBy("part", "number", "pos"))).where("n = 1")
    # part 0 to 2 of one issue stand together, then closings, then assignments
    return first.select("subject", "e.*", F.struct(F.coalesce("e.timestamp", F.lit("")).alias("t"), F.when(F.col("part") < 3, 0).otherwise(F.col("part")).alias("late"), "number", "part", "pos").alias("seq"))
