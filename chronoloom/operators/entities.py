"""Entities from events, alias maps, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalar import stable_id

COLUMNS = ("entity_id", "entity_type", "canonical_name", "aliases", "n_sources", "first_seen", "last_seen")


def _named(kind: str, key: Column) -> Column:
    return stable_id(12, F.lit(kind), F.lower(key))


def persons(events: DataFrame) -> DataFrame:
    """Actors other than none, system and unknown, by lower-cased name; the first spelling is canonical."""
    known = events.where((F.coalesce("actor", F.lit("")) != "") & ~F.col("actor").isin("system", "unknown"))
    out = known.groupBy(F.lower("actor").alias("key")).agg(
        F.min_by("actor", "seq").alias("canonical_name"), F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("aliases"), F.countDistinct("source_id").alias("n_sources"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return out.select(_named("Person", F.col("key")).alias("entity_id"), F.lit("Person").alias("entity_type"), *COLUMNS[2:])


def issues(events: DataFrame) -> DataFrame:
    out = events.where(F.col("subject").startswith("issue_")).groupBy("subject").agg(F.countDistinct("source_id").alias("n_sources"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.select(_named("Issue", F.col("subject")).alias("entity_id"), F.lit("Issue").alias("entity_type"), F.col("subject").alias("canonical_name"), F.lit("").alias("aliases"), "n_sources", "first_seen", "last_seen")


def labels(events: DataFrame) -> DataFrame:
    """Both times are those of the label's first event."""
    known = events.where(F.coalesce("label", F.lit("")) != "")
    out = known.groupBy(F.lower("label").alias("key")).agg(
        F.min_by("label", "seq").alias("canonical_name"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("aliases"), F.countDistinct("source_id").alias("n_sources"), F.min_by("ts", "seq").alias("first_seen")
    )
    return out.select(_named("Label", F.col("key")).alias("entity_id"), F.lit("Label").alias("entity_type"), "canonical_name", "aliases", "n_sources", "first_seen", F.col("first_seen").alias("last_seen"))


def all_entities(events: DataFrame) -> DataFrame:
    return persons(events).unionByName(issues(events)).unionByName(labels(events))


def labelled_issues(events: DataFrame) -> DataFrame:
    """Issues and pull requests (a subject any of whose events says so) as entities, with their labels: those of the last event that has
    some. events has labels (an array) and is_pull_request besides."""
    some = F.when(F.size("labels") > 0, F.col("seq"))
    facts = events.where(F.col("subject").startswith("issue_")).groupBy(F.col("subject").alias("canonical_name")).agg(F.max_by("labels", some).alias("held"), F.bool_or(F.coalesce("is_pull_request", F.lit(False))).alias("pull"))
    kind = F.when(F.col("pull"), "PullRequest").otherwise("Issue")
    out = issues(events).drop("entity_id", "entity_type").join(facts, "canonical_name")
    return out.select(stable_id(12, kind, F.col("canonical_name")).alias("entity_id"), kind.alias("entity_type"), *COLUMNS[2:], F.struct(F.coalesce("held", F.array().cast("array<string>")).alias("labels")).alias("properties"))


def merged_persons(entities: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons joined into their leaders (members: id, leader, sim of greedy clusters): the entities that stay, with the aliases of all and
    the times of the leader, and the alias map that leads every name there. Entities of other kinds stay as they are."""
    led = entities.join(members.select(F.col("id").alias("entity_id"), "leader"), "entity_id", "left").withColumn("leader", F.coalesce("leader", "entity_id"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("aliases", ","), lambda a: a != "")))))
    every = led.groupBy("leader").agg(F.array_join(names, ",").alias("__aliases"), F.sum("n_sources").alias("__n"))
    kept = entities.join(every.withColumnRenamed("leader", "entity_id"), "entity_id").select(*(F.col("__aliases").alias(c) if c == "aliases" else F.col("__n").alias(c) if c == "n_sources" else F.col(c) for c in entities.columns))
    return kept, alias_map(led.withColumn("entity_id", F.col("leader")))


def find(entities: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """names (name): adds entity_id by the alias map, else by an entity's own name, else null. Two equi-joins on the lower-cased name."""
    own = entities.groupBy(F.lower("canonical_name").alias("__low")).agg(F.min("entity_id").alias("__own"))
    asked = names.withColumn("__low", F.lower("name")).join(aliases.select(F.col("alias").alias("__low"), F.col("entity_id").alias("__alias")), "__low", "left").join(own, "__low", "left")
    return asked.withColumn("entity_id", F.coalesce("__alias", "__own")).drop("__low", "__alias", "__own")


#: Later kinds overwrite earlier ones in the alias map.
RANK = {"Person": 0, "Issue": 1, "PullRequest": 1, "Label": 2}


def alias_map(entities: DataFrame) -> DataFrame:
    """alias (lower case) and entity_id, one row per alias; of several entities the last kind wins."""
    rank = F.coalesce(*(F.when(F.col("entity_type") == k, r) for k, r in RANK.items()), F.lit(9))
    names = F.array_union(F.filter(F.split("aliases", ","), lambda a: a != ""), F.array("canonical_name"))
    rows = entities.select(F.explode(names).alias("name"), "entity_id", rank.alias("rank"))
    return rows.groupBy(F.lower("name").alias("alias")).agg(F.max_by("entity_id", F.struct("rank", "entity_id")).alias("entity_id"))


def search(entities: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Entities with the text in their name or aliases, in the order of ids."""
    low = F.lit(text.lower())
    out = entities.where(F.lower("canonical_name").contains(low) | F.lower(F.regexp_replace("aliases", ",", " ")).contains(low))
    return out.orderBy("entity_id").limit(limit) if limit else out
