"""Property graph: nodes, edges, bounded neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from chronoloom.sources.tables import settled

#: The colour of each kind of node, and that of all others.
COLOURS = {"Issue": "#4A90D9", "Person": "#50C878", "Label": "#F5A623", "PullRequest": "#9B59B6", "Claim": "#E74C3C", "Milestone": "#1ABC9C"}
OTHER = "#95A5A6"


def colour(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, c) for k, c in COLOURS.items()), F.lit(OTHER))


def nodes(entities: DataFrame) -> DataFrame:
    """id, label, type, color, aliases, first_seen, last_seen, and properties, if entities have them."""
    rest = [c for c in ("properties",) if c in entities.columns]
    return entities.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("label"), F.col("entity_type").alias("type"), colour(F.col("entity_type")).alias("color"), "aliases", "first_seen", "last_seen", *rest)


def resolved(rows: DataFrame, name: str, aliases: DataFrame, out: str) -> DataFrame:
    """Adds the entity (entity_id under the name out) that a name stands for: by the lower-cased name, else without ``issue_`` in it; null
    where neither is an alias. Two equi-joins with the alias map, which has one row an alias."""
    known = lambda key, value: aliases.select(F.col("alias").alias(key), F.col("entity_id").alias(value))
    asked = rows.withColumn("__low", F.lower(name)).withColumn("__short", F.lower(F.replace(F.col(name), F.lit("issue_"), F.lit(""))))
    met = asked.join(known("__low", "__own"), "__low", "left").join(known("__short", "__other"), "__short", "left")
    return met.withColumn(out, F.when(F.coalesce(F.col(name), F.lit("")) != "", F.coalesce("__own", "__other"))).drop("__low", "__short", "__own", "__other")


def event_edges(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """from_id, to_id, type, source_id, ts, and evidence, if events have it: created and commented (actor to issue), assigned_to and
    labeled (issue to other). Edges with an end that is no entity are left out. Of a comment 200 characters are evidence."""
    kind = F.col("event_type")
    ends = (
        F.when(kind == "IssueCreated", F.struct(F.col("actor").alias("a"), F.col("subject").alias("b"), F.lit("created").alias("t")))
        .when(kind == "AssignedTo", F.struct(F.col("subject").alias("a"), F.col("assignee").alias("b"), F.lit("assigned_to").alias("t")))
        .when(kind == "LabelAdded", F.struct(F.col("subject").alias("a"), F.col("label").alias("b"), F.lit("labeled").alias("t")))
        .when(kind == "CommentAdded", F.struct(F.col("actor").alias("a"), F.col("subject").alias("b"), F.lit("commented").alias("t")))
    )
    rest = [F.when(kind == "CommentAdded", F.substring("evidence", 1, 200)).otherwise(F.col("evidence")).alias("evidence")] if "evidence" in events.columns else []
    rows = events.select("source_id", "ts", ends.alias("e"), *rest).where("e is not null").select("*", "e.a", "e.b", F.col("e.t").alias("type"))
    met = resolved(resolved(rows, "a", aliases, "from_id"), "b", aliases, "to_id").where("from_id is not null and to_id is not null")
    return met.select("from_id", "to_id", "type", "source_id", "ts", *(["evidence"] if rest else []))


def _ends(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    met = resolved(resolved(claims, "subject", aliases, "from_id"), "object", aliases, "other").where("from_id is not null")
    return met.where("other is not null or coalesce(object, '') <> ''")


def claim_edges(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """from_id, to_id, label, type, claim_id, confidence, evidence, source_ids, status: subject to object; an object that is no entity
    becomes a node of the claim's own."""
    to = F.coalesce("other", F.concat(F.lit("claim_"), F.col("claim_id")))
    return _ends(claims, aliases).select("from_id", to.alias("to_id"), F.coalesce("predicate", F.lit("related_to")).alias("label"), F.coalesce("claim_type", F.lit("Generic")).alias("type"), "claim_id", "confidence", F.array("excerpt").alias("evidence"), F.array("source_id").alias("source_ids"), "status")


def claim_nodes(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Nodes of claims whose object is no entity: id, label (predicate → object), type, color, and claim_type, confidence and value."""
    own = _ends(claims, aliases).where("other is null")
    return own.select(F.concat(F.lit("claim_"), F.col("claim_id")).alias("id"), F.concat_ws(" → ", F.coalesce("predicate", F.lit("")), "object").alias("label"), F.lit("Claim").alias("type"), F.lit(COLOURS["Claim"]).alias("color"), "claim_type", "confidence", "value").dropDuplicates(["id"])


def neighbours(edges: DataFrame, start: str | int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Ids within depth steps, either way along edges (from_id, to_id), and the bag of edges met: one row each time an edge has an end
    in the frontier. Each step is evaluated once, so the edges are read once a step; each frontier leaves out what was visited before."""
    spark = edges.sparkSession
    first = spark.range(1).select(F.lit(start).cast(edges.schema["from_id"].dataType).alias("id"))
    visited, frontier, met = first, first, None
    for _ in range(depth):
        front = frontier.select("id")
        both = edges.withColumn("__end", F.explode(F.array("from_id", "to_id"))).withColumn("__far", F.when(F.col("__end") == F.col("from_id"), F.col("to_id")).otherwise(F.col("from_id")))
        step = settled(both.join(front, F.col("__end") == F.col("id"), "left_semi"))
        met = step.select(*edges.columns) if met is None else met.unionByName(step.select(*edges.columns))
        frontier = settled(step.select(F.col("__far").alias("id")).distinct().join(visited, "id", "left_anti"))
        visited = visited.unionByName(frontier)
    return visited, met if met is not None else edges.limit(0)


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str | int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes (id) within depth steps of one, and the edges met."""
    ids, met = neighbours(edges, start, depth)
    return nodes.join(ids, "id", "left_semi"), met


def highlighted(nodes: DataFrame, edges: DataFrame, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Nodes whose column is among the values, and the edges (from_id, to_id) between two of them."""
    shown = nodes.where(F.col(column).isin(*values))
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return shown, kept.select(*edges.columns)


def nodes_of(edges: DataFrame, nodes: DataFrame, column: str, values: list) -> tuple[DataFrame, DataFrame]:
    """Edges whose column is among the values, and the nodes at their ends."""
    shown = edges.where(F.col(column).isin(*values))
    ends = shown.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi"), shown


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n, and the totals under the type *."""
    rows = nodes.select(F.lit("node").alias("kind"), "type").unionByName(edges.select(F.lit("edge").alias("kind"), "type"))
    return rows.groupingSets([["kind", "type"], ["kind"]], "kind", "type").agg(F.count("*").alias("n")).select("kind", F.coalesce("type", F.lit("*")).alias("type"), "n")


def tooltips(edges: DataFrame) -> DataFrame:
    """Adds title, an edge's first three pieces of evidence or its one, at most 300 characters, and color by its status."""
    many = isinstance(edges.schema["evidence"].dataType, ArrayType)
    title = F.array_join(F.slice("evidence", 1, 3), "\n") if many else F.col("evidence")
    status = F.col("status") if "status" in edges.columns else F.lit(None).cast("string")
    return edges.withColumn("title", F.substring(F.coalesce(title, F.lit("")), 1, 300)).withColumn("color", F.when(status == "active", "#666").otherwise("#999"))


def html(nodes: DataFrame, edges: DataFrame, path: str, most: int = 500) -> None:
    """A drawing of at most so many nodes, with their colours and tooltips: the limit is the feature, as a page cannot show more.

    Nodes stand on a circle; a text that moves over one shows its name, over an edge its title.
    """
    import html as text
    import math
    from pathlib import Path

    shown = nodes.orderBy("id").limit(most).collect()
    at = {r["id"]: (500 + 450 * math.cos(2 * math.pi * k / max(1, len(shown))), 500 + 450 * math.sin(2 * math.pi * k / max(1, len(shown)))) for k, r in enumerate(shown)}
    ids = nodes.orderBy("id").limit(most).select("id")
    own = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    own = tooltips(own) if "evidence" in own.columns else own.withColumn("title", F.lit("")).withColumn("color", F.lit("#999"))
    lines = own.orderBy("from_id", "to_id").limit(4 * most).collect()
    parts = []
    for r in lines:
        (x, y), (u, v) = at[r["from_id"]], at[r["to_id"]]
        parts.append(f'<line x1="{x:.0f}" y1="{y:.0f}" x2="{u:.0f}" y2="{v:.0f}" stroke="{r["color"]}"><title>{text.escape(str(r["title"]))}</title></line>')
    for r in shown:
        x, y = at[r["id"]]
        parts.append(f'<circle cx="{x:.0f}" cy="{y:.0f}" r="{10 if r["type"] == "Issue" else 7}" fill="{r["color"]}"><title>{text.escape(str(r["label"]))} ({r["type"]})</title></circle>')
    Path(path).write_text(f'<!doctype html><meta charset="utf-8"><svg viewBox="0 0 1000 1000">{"".join(parts)}</svg>', encoding="utf-8")
