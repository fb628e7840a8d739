"""Streaming queries over the event log, equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocabula.plans.search import ORACLE as _BATCH
from vocabula.plans.views import SIGNALS_SQL
from vocabula.session import ship
from vocabula.streaming import folds


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return folds.usage_stream(spark, f"{sf_dir}/usage_signals.parque[t]")  # a pattern, as the table may be a file or a folder


def stream_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.coupling(_stream(spark, sf_dir))


def stream_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.usage_counts(_stream(spark, sf_dir))


QUERIES = {"stream_coupling": stream_coupling, "stream_enrichment": stream_enrichment}
ORACLE = {
    "stream_coupling": _BATCH["coupling_fold"],
    "stream_enrichment": f"WITH {SIGNALS_SQL} SELECT term_id, type, count(*) AS events FROM (SELECT type, unnest(termIds) AS term_id FROM signals) WHERE term_id IS NOT NULL GROUP BY ALL",
}
