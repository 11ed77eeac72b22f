"""Rule-derived claims, their validation, deduplication and quality gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalar import any_of, clamped, first_truthy, issue_numbers, json_array, seconds_between, stable_id, stripped
from chronoloom.sources.tables import first_of

#: Words that mark a decision, words that mark a comment worth reading, types a claim can have.
DECISIONS = ("approved", "merged", "rejected", "wontfix", "resolved", "duplicate", "confirmed", "accepted")
SIGNALS = ("decision", "decided", "agreed", "approved", "rejected", "blocked", "duplicate", "depends", "fixes", "closes")
TYPES = ("StatusChange", "Assignment", "Reference", "Decision", "LabelAction", "DependsOn", "Duplicates", "Blocks", "Fixes", "Performance", "OwnershipChange", "Generic")
#: Types that a model's claim can have; others become Generic.
EXTRACTED = ("Reference", "DependsOn", "Duplicates", "Blocks", "Fixes", "Decision", "Assignment", "StatusChange", "Performance", "Generic")


def claim(kind: str, predicate: str | Column, obj: Column, value: Column, confidence: Column | float, excerpt: Column) -> Column:
    predicate = F.lit(predicate) if isinstance(predicate, str) else predicate
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(kind).alias("claim_type"), predicate.alias("predicate"), obj.cast("string").alias("object"), value.cast("string").alias("value"), confidence.alias("confidence"), excerpt.alias("excerpt"))


#: Of the claims that rules make.
RULES = {"model": "rule-engine", "schema_version": "1.0", "prompt_hash": "rule-based"}


def _finished(rows: DataFrame) -> DataFrame:
    """seq, subject, source_id, ts, c (a claim), and source_url if there: adds identifiers; of equal identifiers the first stays."""
    out = rows.select(
        stable_id(12, F.col("c.claim_type"), F.col("subject"), F.col("c.predicate"), F.col("c.object"), F.col("c.value"), F.col("source_id")).alias("claim_id"),
        "c.claim_type", "subject", "c.predicate", "c.object", "c.value", "c.confidence", F.substring("c.excerpt", 1, 500).alias("excerpt"), "source_id", F.lit("active").alias("status"),
        stable_id(16, F.col("c.claim_type"), F.col("subject"), F.col("c.predicate"), F.col("c.object"), F.col("c.value"), null="None").alias("content_hash"),
        F.col("ts").alias("created_at"), "seq",
    )
    return first_of(out, ["claim_id"])


def with_evidence(claims: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """claims with evidence (an array of one excerpt, its source, url, time and offsets), source_ids, support_count and extraction_meta.

    urls (source_id, source_url): where sources stand; a source that stands in it twice gives one url.
    """
    known = claims
    if urls is None:
        known = claims.withColumn("source_url", F.lit(""))
    else:
        known = claims.join(urls.groupBy("source_id").agg(F.min("source_url").alias("source_url")), "source_id", "left")
    meta = F.struct(*(F.lit(v).alias(k) for k, v in RULES.items()), F.col("confidence"), F.current_timestamp().alias("extracted_at"))
    item = F.struct("excerpt", "source_id", F.coalesce("source_url", F.lit("")).alias("source_url"), F.col("created_at").alias("timestamp"), F.lit(0).alias("char_offset_start"), F.least(F.length("excerpt"), F.lit(500)).alias("char_offset_end"))
    return known.select(*claims.columns, F.array(item).alias("evidence"), F.array("source_id").alias("source_ids"), F.lit(1).alias("support_count"), meta.alias("extraction_meta"))


def in_time_order(claims: DataFrame) -> DataFrame:
    """Claims by their time, those without one first, and by seq where times are equal."""
    return claims.orderBy(F.coalesce("created_at", F.lit("")), "seq", "claim_id")


def event_claims(events: DataFrame) -> DataFrame:
    """Claims of status, assignment, label, pull request and reference events: a fan-out inside each row, without joins.

    Of the columns that only nested sources fill, labels (of a created issue), is_pull_request and synthetic, those that are there count.
    """
    kind, actor, none = F.col("event_type"), F.col("actor"), F.lit(None).cast("string")
    has = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in events.columns else F.lit(False)
    label, assignee = F.col("label"), F.coalesce("assignee", "actor")
    said = lambda verb, who: F.concat_ws(" ", F.col("subject"), F.lit(verb), who)
    sure = F.when(has("synthetic"), 0.85).otherwise(0.95)
    rules = F.array(
        F.when(kind == "IssueCreated", claim("StatusChange", "created_by", actor, F.lit("open"), 0.95, said("created by", actor))),
        F.when((kind == "IssueCreated") & has("is_pull_request"), claim("Reference", "is_pull_request", F.lit("true"), F.lit("PR"), 0.99, F.concat(F.col("subject"), F.lit(" is a pull request")))),
        F.when(kind == "IssueClosed", claim("StatusChange", "closed_by", actor, F.lit("closed"), sure, said("closed by", actor))),
        F.when(kind == "IssueReopened", claim("StatusChange", "reopened_by", actor, F.lit("open"), 0.95, said("reopened by", actor))),
        F.when(kind == "AssignedTo", claim("Assignment", "assigned_to", assignee, none, 0.90, said("assigned to", assignee))),
        F.when(kind == "Unassigned", claim("OwnershipChange", "unassigned", assignee, none, 0.90, said("unassigned from", assignee))),
        F.when(kind == "LabelAdded", claim("Reference", "labeled", label, none, 0.95, said("labeled", label))),
        F.when(kind == "LabelRemoved", claim("Reference", "label_removed", label, none, 0.95, said("label removed", label))),
        F.when(kind == "Referenced", claim("Reference", "externally_referenced", actor, none, 0.70, said("referenced by", actor))),
    )
    found = F.array_compact(rules)
    if "labels" in events.columns:
        held = F.when(kind == "IssueCreated", F.transform("labels", lambda x: claim("Reference", "has_label", x, none, 0.95, F.concat(F.col("subject"), F.lit(" labeled '"), x, F.lit("' at creation")))))
        found = F.concat(found, F.coalesce(held, F.filter(found, lambda _: F.lit(False))))
    return _finished(events.select("seq", "subject", "source_id", "ts", F.explode(found).alias("c")))


def comment_claims(comments: DataFrame) -> DataFrame:
    """Claims of comments (subject, seq, actor, source_id, body): who discussed, which issues are named, which decision words occur."""
    actor, none, low = F.col("actor"), F.lit(None).cast("string"), F.lower("body")
    excerpt = F.substring("body", 1, 300)
    named = F.transform(issue_numbers(F.col("body")), lambda n: claim("Reference", "references", F.concat(F.lit("issue_"), n), none, 0.75, excerpt))
    decided = F.array_compact(F.array(*(F.when(low.contains(w), claim("Decision", f"decision_{w}", actor, F.lit(w), 0.60, excerpt)) for w in DECISIONS)))
    rules = F.concat(F.array(claim("Generic", "discussed_by", actor, none, 0.80, F.concat_ws(" ", actor, F.lit("commented on"), F.col("subject")))), named, decided)
    return _finished(comments.select("seq", "subject", "source_id", F.lit(None).cast("string").alias("ts"), F.explode(rules).alias("c")))


def rapid_closure_claims(intervals: DataFrame, minutes: float = 10.0) -> DataFrame:
    """Issues whose last close came within minutes after their first opening."""
    first = F.min_by(F.struct("valid_from", "actor"), F.when(F.col("state") == "open", F.struct("valid_from", "seq")))
    last = F.max_by(F.struct("valid_from", "actor"), F.when(F.col("state") == "closed", F.struct("valid_from", "seq")))
    spans = intervals.groupBy("issue_id").agg(first.alias("o"), last.alias("c")).withColumn("minutes", seconds_between(F.col("o.valid_from"), F.col("c.valid_from")) / 60)
    found = spans.where((F.col("minutes") > 0) & (F.col("minutes") <= minutes))
    return found.select(F.col("issue_id").alias("subject"), F.lit("rapid_closure").alias("predicate"), F.col("c.actor").alias("object"), F.concat(F.lit("closed_in_"), F.bround("minutes", 0).cast("long"), F.lit("_min")).alias("value"), F.lit(0.85).alias("confidence"))


def validated(raw: DataFrame, least: float = 0.3) -> DataFrame:
    """Extracted claims (claim_type, subject, predicate, object, value, confidence, excerpt) brought into form; unfit ones go."""
    kind = F.when(F.col("claim_type").isin(*EXTRACTED), F.col("claim_type")).otherwise("Generic")
    out = raw.withColumn("claim_type", kind).withColumn("predicate", first_truthy(F.col("predicate"), F.lower("claim_type"))).withColumn("confidence", clamped(F.col("confidence")))
    fit = (F.col("confidence") >= least) & (first_truthy(F.col("excerpt"), F.col("subject")).isNotNull())
    return out.where(fit).withColumn("confidence", F.bround("confidence", 3)).withColumn("excerpt", F.substring("excerpt", 1, 500))


def signal_comments(comments: DataFrame, words: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Comments worth an extraction: 20 or more characters, and a reference or a signal word."""
    low = F.lower("body")
    return comments.where((F.length(stripped(F.col("body"))) >= 20) & (F.col("body").contains("#") | low.contains("issue") | any_of([low.contains(w) for w in words])))


def run_totals(comments: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: comments processed and skipped, claims that a model gave, and unique ones that stayed."""
    one = lambda df, *c: df.agg(*c)
    picked = signal_comments(comments).select("seq").withColumn("__hit", F.lit(1))
    counts = one(comments.select("seq").join(picked, "seq", "left"), F.count("__hit").alias("processed"), F.count_if(F.col("__hit").isNull()).alias("skipped"))
    parts = [one(raw, F.count("*").alias("raw_claims")), one(kept, F.count("*").alias("unique_claims"))]
    for part in parts:
        counts = counts.join(F.broadcast(part), F.lit(True))  # one row each
    return counts


FIELDS = "array<struct<claim_type: string, subject: string, object: string, predicate: string, value: string, confidence: string, excerpt: string>>"
PROMPT = (
    "List the relations that this comment on an issue states, as a JSON array and nothing else; [] if there are none. Each has the fields claim_type ("
    + ", ".join(EXTRACTED)
    + "), subject, object or null, predicate (a short verb phrase), value or null, confidence (0 to 1) and excerpt (the words of the comment that say so).\n"
)


def prompt(comment: Column, issue: Column, author: Column, most: int = 3000) -> Column:
    return F.concat(F.lit(PROMPT), F.lit("Issue: "), issue, F.lit("\nAuthor: "), F.coalesce(author, F.lit("unknown")), F.lit("\nComment:\n"), F.substring(comment, 1, most))


def extracted(comments: DataFrame, complete: Callable[[Column], Column], least: float = 0.3) -> DataFrame:
    """Claims that a model finds in comments (subject, seq, actor, source_id, body) worth an extraction, in form, each content once.

    complete gives the model's answer to a prompt. An answer that cannot be read gives no claims. A claim without subject is about its
    comment's issue. The first of equal claims, by comment and place in the answer, stays.
    """
    asked = signal_comments(comments).select("seq", "source_id", F.col("subject").alias("issue_id"), complete(prompt(F.col("body"), F.col("subject"), F.col("actor"))).alias("raw"))
    found = asked.select("seq", "source_id", "issue_id", F.posexplode(json_array(F.col("raw"), FIELDS)).alias("pos", "c")).where("c is not null")
    fit = validated(found.select("seq", "pos", "source_id", "issue_id", "c.*"), least).withColumn("subject", F.coalesce("subject", "issue_id"))
    named = fit.withColumn("content_hash", stable_id(16, F.col("claim_type"), F.col("subject"), F.col("object"), F.col("predicate"), null="None")).withColumn("at", F.struct("seq", "pos"))
    return first_of(named, ["content_hash"], "at").drop("at", "pos")


def quality_gate(claims: DataFrame, least: float = 0.3, review: float = 0.4) -> DataFrame:
    """claims (confidence, n_evidence): adds passes and needs_review."""
    return claims.withColumn("passes", (F.col("confidence") >= least) & (F.col("n_evidence") >= 1)).withColumn("needs_review", F.col("confidence") < review)
