"""Search results re-ranked by usage, and measures of how much that changes and how good results are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import glossary, signals
from vocabula.scale import global_rank


#: Hits up to which their ids are broadcast to the log; the log is shuffled to them beyond it.
NEAR = 100_000


def enriched_search(terms: DataFrame, query: str, usage: DataFrame, category: str | None = None, weight: float = d.ENRICHMENT_WEIGHT) -> DataFrame:
    """All hits with base_relevance (by place), enrichment, boost and combined score, and both places. Order by enriched_rank.

    The log is reduced to the hits before it is aggregated."""
    hits = glossary.listed(glossary.search(terms, query), category=category)
    ranked = global_rank(hits.select("id", "name", "confidence", F.size("codeLocations").alias("locations"), "score"), [F.col("score").desc(), F.col("id")], "base_rank")
    n = ranked.count()
    ids = ranked.select(F.col("id").alias("term_id"))
    ids = F.broadcast(ids) if n <= NEAR else ids
    enriched = signals.enrichment(usage, ids)
    boosts = signals.boosts(signals.query_terms(usage, ids), enriched)
    mine = boosts.filter(F.col("query") == F.lit(query.strip().lower())).select(F.col("term_id").alias("id"), "boost")
    scored = (
        ranked.join(enriched.select(F.col("term_id").alias("id"), F.col("score").alias("enrichment")), "id", "left")
        .join(mine, "id", "left")
        .na.fill(0.0, ["enrichment", "boost"])
        .withColumn("base_relevance", (F.lit(n) - F.col("base_rank") + 1) / F.lit(max(n, 1)))
    )
    scored = scored.withColumn("combined", F.round(F.lit(1 - weight) * F.col("base_relevance") + F.lit(weight) * F.col("enrichment") + F.col("boost"), 9))
    return global_rank(scored, [F.col("combined").desc(), F.col("base_rank")], "enriched_rank").withColumn("applied", (F.col("enrichment") > 0) | (F.col("boost") > 0))


def impact(results: DataFrame) -> DataFrame:
    """One row: hits whose place changed, enriched hits, mean enrichment."""
    moved = F.count_if(F.col("base_rank") != F.col("enriched_rank"))
    return results.agg(moved.alias("reordered"), F.count_if("applied").alias("enriched"), F.round(F.coalesce(F.avg("enrichment"), F.lit(0.0)), 9).alias("mean_enrichment"), (moved > 0).alias("material"))


def quality(results: DataFrame) -> DataFrame:
    """One row: 0 for no results, else 0.10 + 0.35 with locations + 0.25 mean enrichment + 0.25 confirmed, at most 1."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    q = F.lit(0.10) + F.lit(0.35) * share(F.col("locations") > 0) + F.lit(0.25) * F.avg("enrichment") + F.lit(0.25) * share(F.col("confidence").isin("manual", "ai-verified"))
    return results.agg(F.count(F.lit(1)).alias("results"), F.when(F.count(F.lit(1)) > 0, F.round(F.least(F.lit(1.0), q), 9)).otherwise(F.lit(0.0)).alias("quality"))
