"""The registered query of each corpus operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontam, language_id, license_scan, packing, quality, secrets, sharding, simhash, substring, url_filter
from chronoloom.llm.common import table

#: A dated list over hosts of the test pages; days are of 2024.
LIST = [
    ("domain", "tionsh.example.net", "add", "2024-02-01", "spam"), ("domain", "tionsh.example.net", "remove", "2024-05-01", "appeal"), ("domain", "tionsh.example.net", "add", "2024-09-15", "spam"),
    ("domain", "cheap-pills.example.com", "add", "2023-06-01", "pharma"),
    ("host", "blog.tionble.example.com", "add", "2024-03-10", "copied"), ("host", "blog.tionble.example.com", "remove", "2024-08-20", "fixed"),
    ("domain", "thther.example.org", "add", "2024-01-05", "adult"), ("host", "m.thther.example.org", "remove", "2024-02-05", "no such addition"),
    ("host", "m.tiontion.example.com", "add", "2024-06-30", "malware"), ("domain", "tiontion.example.com", "add", "2024-10-01", "malware"),
    ("domain", "ththth.example.org", "add", "2024-04-01", "spam"), ("domain", "ththth.example.org", "add", "2024-07-01", "spam again"), ("domain", "ththth.example.org", "remove", "2024-07-01", "same day"),
    ("host", "ththan.example.net", "add", "2025-01-01", "later than all captures"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.digest(docs, language_id.fit(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontam.summary(docs, decontam.find(docs, table(spark, sf_dir, "benchmark")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_passages(table(spark, sf_dir, "documents")))


def captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; each page gets one in 2024 that follows from its id."""
    return pages.select("page_id", "url", F.expr("timestamp_seconds(1704067200 + (page_id * 7919 % 8784) * 3600)").alias("fetched_at"))


def url_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIST, "kind string, value string, action string, at string, reason string").withColumn("at", F.to_timestamp("at"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(captures(table(spark, sf_dir, "pages")), url_list(spark))
    return judged.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "blocked", "rule_kind", "rule_value", "reason", F.unix_seconds("listed_since").alias("listed_s"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_license_scan, op3_sharding, op4_packing, op5_simhash, op6_decontamination, op7_quality, op8_secrets, op9_substrings, op10_url_filter)
}

_LIST_SQL = ", ".join(f"('{k}', '{v}', '{a}', epoch(TIMESTAMP '{d}'), '{r}')" for k, v, a, d, r in LIST)

ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": f"""
WITH raw(kind, value, action, listed, reason) AS (VALUES {_LIST_SQL}),
one AS (SELECT kind, value, listed, max(action) AS action, arg_max(reason, action) AS reason FROM raw GROUP BY ALL),
spans AS (SELECT *, lead(listed) OVER (PARTITION BY kind, value ORDER BY listed) AS until FROM one),
rules AS (SELECT * FROM spans WHERE action = 'add'),
p AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.+$', ''), '') AS host,
      1704067200 + (page_id * 7919 % 8784) * 3600 AS fetched_s FROM pages),
m AS (SELECT page_id, p.host, fetched_s, rules.* FROM p LEFT JOIN rules ON listed <= fetched_s AND (until IS NULL OR fetched_s < until)
      AND (p.host = value OR (kind = 'domain' AND ends_with(p.host, '.' || value)))),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(value) DESC, kind DESC) AS k FROM m)
SELECT page_id, host, CAST(fetched_s AS BIGINT) AS fetched_s, value IS NOT NULL AS blocked, kind AS rule_kind, value AS rule_value, reason, CAST(listed AS BIGINT) AS listed_s FROM b WHERE k = 1
""",
}
