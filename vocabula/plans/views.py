"""Current state of the domain tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocabula.semantics import latest
from vocabula.session import table


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each glossary term; null aliases and locations are empty."""
    t = latest(table(spark, sf_dir, "glossary_terms"), "id", "arrivedAt", "row_id")
    return t.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "codeLocations": F.coalesce("codeLocations", F.array().cast(dict(t.dtypes)["codeLocations"]))})


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scan of each concept."""
    return latest(table(spark, sf_dir, "code_concepts"), "id", "scannedAt", "concept_row")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each work item."""
    t = latest(table(spark, sf_dir, "work_items"), "id", "receivedAt", "item_row")
    return t.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "assignees": F.coalesce("assignees", F.array().cast("array<string>"))})


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each usage event."""
    w = Window.partitionBy("event_id").orderBy("receivedAt", "ts", "type", "query", "client", "termIds")
    return table(spark, sf_dir, "usage_signals").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pull request once, though it may have been fetched twice."""
    t = table(spark, sf_dir, "pull_requests").withColumn("_files", F.coalesce(F.size("changedFiles"), F.lit(-1)))
    return latest(t, "number", "_files").drop("_files")


TERMS_SQL = "terms AS (SELECT * REPLACE (coalesce(aliases, []) AS aliases, coalesce(codeLocations, []) AS codeLocations) FROM glossary_terms QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrivedAt DESC, row_id DESC) = 1)"
CONCEPTS_SQL = "concepts AS (SELECT * FROM code_concepts QUALIFY row_number() OVER (PARTITION BY id ORDER BY scannedAt DESC, concept_row DESC) = 1)"
ITEMS_SQL = "items AS (SELECT * REPLACE (coalesce(labels, []) AS labels, coalesce(assignees, []) AS assignees) FROM work_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY receivedAt DESC, item_row DESC) = 1)"
SIGNALS_SQL = "signals AS (SELECT * FROM usage_signals QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY receivedAt, ts NULLS FIRST, type NULLS FIRST, query NULLS FIRST, client NULLS FIRST, termIds NULLS FIRST) = 1)"
REQUESTS_SQL = "requests AS (SELECT * FROM pull_requests QUALIFY row_number() OVER (PARTITION BY number ORDER BY coalesce(len(changedFiles), -1) DESC) = 1)"

#: White space in the wide sense, for the SQL side's regular expressions.
SPACE_SQL = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
