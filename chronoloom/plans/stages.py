"""The batch pipeline as named stages that read and write tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import claims, conflicts, entities, graph, models, retrieval, similarity, store, temporal
from chronoloom.sources import issues
from chronoloom.sources.tables import settled

Stage = Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]]

#: Claims this similar are one claim.
SIMILAR_CLAIMS = 0.85
EXAMPLES = ["Did someone reopen issue_3 after it was closed?", "List the work that user_2 took over in January", "Where does label_1 occur twice?", "Show decisions about issue_1"]


def transform(spark: SparkSession, path: str, folder: str) -> None:
    """Writes the events of a file of nested issues to the folder, numbered in the order of time, and its comments with whole bodies."""
    flat = issues.events(issues.read(spark, path))
    flat.select("seq", "source_id", "subject", F.col("timestamp").alias("ts"), "actor", "event_type", "evidence", "source_url", "extra.*").write.mode("overwrite").parquet(f"{folder}/events")
    flat.where("event_type = 'CommentAdded'").select("subject", "seq", "actor", "source_id", F.col("evidence_full").alias("body")).write.mode("overwrite").parquet(f"{folder}/comments")


def _dedup(read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Claims of one subject that are alike become their first; the rest and the log of merges. Subjects are clustered apart."""
    rows = read("claims")
    text = F.concat_ws(" ", "claim_type", "subject", "predicate", "object", "value")
    vectors = rows.select(F.col("claim_id").alias("id"), "seq", F.col("subject").alias("block"), models.embedded(text).alias("vector"))
    members = similarity.leaders(vectors, SIMILAR_CLAIMS)
    members = settled(members)
    first = members.where("id = leader").select(F.col("id").alias("claim_id"))
    sums = similarity.canonical_claims(rows, members).select(F.col("first_claim_id").alias("claim_id"), F.col("confidence").alias("__c"), "evidence", "source_ids", "support_count", "similarity")
    kept = rows.join(first, "claim_id", "left_semi").join(sums, "claim_id").withColumn("confidence", F.col("__c")).drop("__c")
    log = similarity.with_snapshots(similarity.merge_log(members, "claim"), members, rows, "claim_id")
    return {"canonical_claims": kept, "merge_log": log}


def _retrieve(read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """Items, citations and packs of the example questions, by keywords and by vectors."""
    names, said = read("entities"), store.first_with_rows(read("canonical_claims"), read("claims"))
    asked = names.sparkSession.createDataFrame(list(enumerate(EXAMPLES, 1)), "qid int, question string")
    words, vectors = retrieval.question_words(asked), asked.select("qid", models.embedded(F.col("question")).alias("vector"))
    near = lambda rows, k: similarity.nearest_each(vectors, rows.select("id", models.embedded(F.col("text")).alias("vector")), k, retrieval.SIMILAR)
    found = settled(retrieval.resolve(words, names, near(retrieval.entity_text(names), retrieval.SIMILAR_ENTITIES)))
    top = settled(retrieval.score_claims(words, found, said, near(retrieval.claim_text(said), retrieval.SIMILAR_CLAIMS)))
    evidence = settled(retrieval.evidence(top, read("events"), found))
    items = retrieval.items(top, evidence)
    surfaced = retrieval.conflicts_of(found, read("contradictions"))
    return {"items": items, "citations": retrieval.citations(top, evidence), "packs": retrieval.packs(asked, found, evidence, items, surfaced)}


STAGES: dict[str, Stage] = {
    "temporal": lambda read: {
        "states": temporal.state_intervals(read("events")),
        "assignments": temporal.paired_intervals(read("events"), "AssignedTo", "Unassigned", "assignee"),
        "labels": temporal.paired_intervals(read("events"), "LabelAdded", "LabelRemoved", "label"),
    },
    "claims": lambda read: {"claims": claims.event_claims(read("events"))},
    "entities": lambda read: {"entities": entities.all_entities(read("events")), "aliases": entities.alias_map(entities.all_entities(read("events")))},
    "conflicts": lambda read: {"irregularities": conflicts.irregularity(read("states")), "contradictions": conflicts.contradictions(read("claims")), "ownership": conflicts.ownership(read("events"))},
    "graph": lambda read: {"nodes": graph.nodes(read("entities")), "edges": graph.event_edges(read("events"), read("aliases"))},
    "dedup": _dedup,
    "retrieve": _retrieve,
}


def run(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, list[str]]:
    """Runs the stages in order over the tables of a folder that has events. Returns the tables each stage wrote."""
    wrote: dict[str, list[str]] = {}
    for name in names or list(STAGES):
        if name not in STAGES:
            raise ValueError(f"unknown stage: {name}")
        for table, df in STAGES[name](lambda t: spark.read.parquet(f"{folder}/{t}")).items():
            df.write.mode("overwrite").parquet(f"{folder}/{table}")
            wrote.setdefault(name, []).append(table)
    return wrote
