"""URL filter by a temporal list join, in DataFrame functions only.

A list is a table of dated entries: on a day, a host or domain is added or removed. Each entry's validity runs until the next entry of
the same kind and value. A capture, fetched at some time, is blocked if an addition covers that time for its host or any domain above it.

The join is an equi-join on the host or domain with the validity as a further condition. An entry's intervals do not overlap, so a capture
meets one interval at most for each of its host's suffixes, and a host with a third of all captures costs as much as any other rows. The
list is broadcast if it is short, else both sides are shuffled, and Spark splits a frequent host's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import fresh, materialise, quoted, require, sized

#: Kinds of entries: host matches the whole host only, domain the host and all hosts under it.
KINDS = ("host", "domain")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """entries (kind, value, action add or remove, at timestamp, reason) as intervals kind, value, reason, valid_from, valid_to (null: open).

    Of entries of the same kind and value at the same time the removal counts. Entries with a null or unknown field are left out.
    """
    known = entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("at").isNotNull()).withColumn("value", F.lower("value"))
    one = known.groupBy("kind", "value", "at").agg(F.max(F.struct("action", "reason")).alias("e"))
    after = F.lead("at").over(Window.partitionBy("kind", "value").orderBy("at"))
    return one.withColumn("valid_to", after).where(F.col("e.action") == "add").select("kind", "value", F.col("e.reason").alias("reason"), F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds to every row of captures (url, fetched_at) host, blocked, rule_kind, rule_value, reason and listed_since.

    Of several rules that cover the fetch the longest value counts, a host before a domain. A null URL, one without a host, and a null
    fetch time are never blocked. Rows are judged one by one, so repeated rows each give a row. Two entries of one rule at the same time are
    one. Columns of the result that captures has already are replaced; others of any name stay. An empty table gives an empty result.
    """
    require(captures, ["url", "fetched_at"])
    rules = materialise(validity(entries))
    kept = captures.drop("host", "blocked", "rule_kind", "rule_value", "reason", "listed_since")
    met_host, met_at, rule = fresh(kept, "met_host", "met_at", "rule")
    named = kept.withColumn("host", host_of(F.col("url")))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = named.select("host", "fetched_at").where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).distinct()
    asked = asked.select("host", "fetched_at", F.explode(above).alias("value"))
    covers = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))) & ((F.col("kind") == "domain") | (F.col("value") == F.col("host")))
    order = F.struct(F.length("value").alias("n"), F.col("kind").alias("rule_kind"), F.col("value").alias("rule_value"), "reason", F.col("valid_from").alias("listed_since"))
    met = asked.join(sized(rules, rules.count(), 200_000), "value").where(covers).groupBy(F.col("host").alias(met_host), F.col("fetched_at").alias(met_at)).agg(F.max(order).alias(rule))
    met = materialise(met)
    out = named.join(sized(met, met.count(), 200_000), (named["host"] == met[met_host]) & (named["fetched_at"] == met[met_at]), "left")
    return out.select(*map(quoted, named.columns), F.col(rule).isNotNull().alias("blocked"), *(F.col(rule)[c].alias(c) for c in ("rule_kind", "rule_value", "reason", "listed_since")))
