"""Question to ranked, cited items, as relational plans over many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.scalar import issue_references, keywords

ENTITIES, CLAIMS, EVIDENCE, CITATIONS, CONFLICTS, MENTIONED = 10, 15, 30, 20, 5, 5
#: How many entities and claims a question's vector can add, and how similar they must be.
SIMILAR_ENTITIES, SIMILAR_CLAIMS, SIMILAR = 5, 10, 0.3


def few(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Hints a broadcast of a table made from questions if its counted rows are within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def question_words(questions: DataFrame) -> DataFrame:
    """questions (qid, question): qid, words, refs."""
    return questions.select("qid", keywords(F.col("question")).alias("words"), issue_references(F.col("question")).alias("refs"))


def entity_text(entities: DataFrame) -> DataFrame:
    """id and text of entities, for an embedding."""
    return entities.select(F.col("entity_id").alias("id"), F.concat_ws(" ", "entity_type", "canonical_name", F.translate("aliases", ",", " ")).alias("text"))


def claim_text(claims: DataFrame) -> DataFrame:
    """id and text of claims, for an embedding."""
    return claims.select(F.col("claim_id").alias("id"), F.concat_ws(" ", "claim_type", "subject", "predicate", "object", "value").alias("text"))


def resolve(words: DataFrame, entities: DataFrame, similar: DataFrame | None = None, most: int = ENTITIES) -> DataFrame:
    """qid, entity_id, name, names, score, place: 1.0 for a named issue, 0.8 for a keyword inside a name or alias, else the similarity in
    similar (qid, id, sim), if given. names has the lower-cased name and aliases. Questions are few and broadcast."""
    low = F.lower("canonical_name")
    aliases = F.filter(F.split(F.lower(F.coalesce("aliases", F.lit(""))), ","), lambda a: a != "")
    named = entities.select("entity_id", low.alias("name"), F.array_distinct(F.concat(F.array(low), aliases)).alias("names"))
    every = F.array_join("names", "\n")
    joined = named.join(F.broadcast(words), F.exists("words", lambda w: F.contains(every, w)) | F.array_contains("refs", F.col("name")))
    scored = joined.select("qid", "entity_id", "name", "names", F.when(F.array_contains("refs", F.col("name")), 1.0).otherwise(0.8).alias("score"))
    if similar is not None:
        new = similar.select("qid", F.col("id").alias("entity_id"), F.col("sim").alias("score")).join(scored, ["qid", "entity_id"], "left_anti")
        scored = scored.unionByName(named.join(few(new), "entity_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("qid", "entity_id", "name", "names", "score", "place")


def score_claims(words: DataFrame, resolved: DataFrame, claims: DataFrame, similar: DataFrame | None = None, most: int = CLAIMS) -> DataFrame:
    """qid, claim_id, score, place: 0.7 for each entity at either end, 0.3 for each keyword in predicate and value, 0.2 for each in the
    evidence, 0.2 of the confidence; above 0.2 only. With similar (qid, id, sim) half of the similarity is added to these, and claims
    that are similar only score 0.8 of it.

    A question's few words and entities are broadcast and all is scored inside a claim's row; only the best rows of each task move."""
    known = resolved.groupBy("qid").agg(F.collect_list(F.array_union("names", F.array("entity_id"))).alias("known"))
    asked = words.select("qid", "words").join(known, "qid", "left").withColumn("known", F.coalesce("known", F.array().cast("array<array<string>>")))
    text, evidence = F.lower(F.concat_ws(" ", "predicate", F.coalesce("value", F.lit("None")))), F.lower(F.coalesce("excerpt", F.lit("")))
    hits = lambda c: F.size(F.filter("words", lambda w: F.contains(c, w)))
    ends = F.array(F.lower("subject"), F.lower(F.coalesce("object", F.lit(""))))
    # the questions, a stated set, stand as one array beside each claim: all pairs are scored where the claim lies
    every = few(asked.agg(F.collect_list(F.struct("qid", "words", "known")).alias("asked")))
    said = claims.join(every, F.lit(True)).select("*", F.explode("asked").alias("one")).select(*claims.columns, "one.*")
    scored = said.withColumn("in_text", hits(text)).withColumn("in_evidence", hits(evidence)).withColumn("n", F.size(F.filter("known", lambda names: F.arrays_overlap(names, ends))))
    score = 0.7 * F.col("n") + 0.3 * F.col("in_text") + 0.2 * F.col("in_evidence") + 0.2 * F.col("confidence")
    scored = scored.withColumn("score", F.round(score, 6))
    if similar is not None:
        scored = scored.join(few(similar.select("qid", F.col("id").alias("claim_id"), "sim")), ["qid", "claim_id"], "left")
        scored = scored.withColumn("score", F.round(F.when(F.col("score") > 0.2, F.col("score") + 0.5 * F.coalesce("sim", F.lit(0.0))).otherwise(0.8 * F.col("sim")), 6)).where("score is not null")
    else:
        scored = scored.where("score > 0.2")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "claim_id")
    top = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return top.select("qid", "claim_id", "subject", "source_id", "excerpt", F.bround("score", 3).alias("score"), "place")


def evidence(top: DataFrame, events: DataFrame, resolved: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """qid, source_id, from_claim, issue_id, excerpt, kind, place: the claims' own evidence (kind 0), once per source and beginning of the
    excerpt, then events of the resolved issues (kind 1), once per source."""
    own = top.where(F.coalesce("excerpt", F.lit("")) != "").select("qid", "source_id", F.col("claim_id").alias("from_claim"), F.lower("subject").alias("issue_id"), "excerpt", F.lit(0).alias("kind"), F.col("place").cast("long").alias("at"))
    names = few(resolved.select("qid", F.col("name").alias("issue_id")).distinct())
    other = events.select("source_id", F.lower("subject").alias("issue_id"), F.col("seq").alias("at")).join(names, "issue_id")
    other = other.select("qid", "source_id", F.lit(None).cast("string").alias("from_claim"), "issue_id", F.lit("").alias("excerpt"), F.lit(1).alias("kind"), "at")
    every = own.unionByName(other)
    once = Window.partitionBy("qid", F.concat("source_id", F.substring("excerpt", 1, 50))).orderBy("kind", "at")
    first = every.withColumn("n", F.row_number().over(once)).where("n = 1")
    order = Window.partitionBy("qid").orderBy("kind", "at", "source_id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("qid", "source_id", "from_claim", "issue_id", "excerpt", "kind", "place")


def snippets(top: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """qid, rank, claim_id, source_id, issue_id, excerpt, p: each of the first claims' own evidence, then at most three events of its subject."""
    near = found.where("kind = 1").withColumn("n", F.row_number().over(Window.partitionBy("qid", "issue_id").orderBy("place"))).where("n <= 3")
    shown = top.where(F.col("place") <= most).select("qid", "claim_id", F.col("place").alias("rank"), F.lower("subject").alias("issue_id"))
    columns = ("qid", "rank", "claim_id", "source_id", "issue_id", "excerpt", F.col("place").alias("p"))
    own = found.where("kind = 0").withColumnRenamed("from_claim", "claim_id").join(shown.drop("issue_id"), ["qid", "claim_id"]).select(*columns)
    return own.unionByName(shown.join(near, ["qid", "issue_id"]).select(*columns))


def items(top: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """qid, rank, claim_id, score, sources, grounding: each claim's evidence and at most three events of its subject."""
    sources = snippets(top, found, most).groupBy("qid", "claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "source_id"))), lambda x: x.source_id), ",").alias("sources"))
    out = top.where(F.col("place") <= most).join(sources, ["qid", "claim_id"], "left")
    return out.select("qid", F.col("place").alias("rank"), "claim_id", "score", F.coalesce("sources", F.lit("")).alias("sources"), F.when(F.col("sources").isNotNull(), "grounded").otherwise("ungrounded").alias("grounding"))


def citations(top: DataFrame, found: DataFrame, most_items: int = 10, most: int = CITATIONS) -> DataFrame:
    """qid, place, rank, source_id, issue_id, excerpt: the first snippets of all items, in the order of the items."""
    order = Window.partitionBy("qid").orderBy("rank", "p", "source_id")
    out = snippets(top, found, most_items).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return out.select("qid", "place", "rank", "source_id", "issue_id", F.substring("excerpt", 1, 200).alias("excerpt"))


def conflicts_of(resolved: DataFrame, conflicts: DataFrame, most: int = CONFLICTS) -> DataFrame:
    """qid, issue_id, conflict_type, severity, place: conflicts of the resolved entities by issue_id, or by subject where conflicts have
    that column, each once, by type and issue."""
    names = few(resolved.select("qid", F.col("name").alias("low")).distinct())
    keys = [F.lower("issue_id"), *([F.lower("subject")] if "subject" in conflicts.columns else [])]
    ends = conflicts.select("issue_id", "conflict_type", "severity", F.monotonically_increasing_id().alias("n"), F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("low"))
    met = ends.join(names, "low").dropDuplicates(["qid", "n"])
    order = Window.partitionBy("qid").orderBy("conflict_type", "issue_id", "severity")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("qid", "issue_id", "conflict_type", "severity", "place")


def packs(questions: DataFrame, resolved: DataFrame, found: DataFrame, shown: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row per question (qid, question): the entities mentioned, the items' claims in rank order, and counts of what was found."""
    listed = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), ",")
    parts = [
        resolved.where(F.col("place") <= MENTIONED).groupBy("qid").agg(listed("entity_id", "place").alias("entities_mentioned")),
        found.groupBy("qid").agg(F.count("*").alias("total_evidence_count")),
        shown.groupBy("qid").agg(listed("claim_id", "rank").alias("claims"), F.count_if(F.col("grounding") == "grounded").alias("n_grounded")),
        conflicts.groupBy("qid").agg(F.count("*").alias("n_conflicts")),
    ]
    out = questions.select("qid", "question")
    for part in parts:
        out = out.join(part, "qid", "left")
    return out.na.fill("").na.fill(0)
