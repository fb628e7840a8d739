"""Queries on the glossary: look-up, change, filter, search, coupling and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import glossary as g
from vocabula.operators import ranking as r
from vocabula.operators import signals as s
from vocabula.plans import views
from vocabula.plans.views import SIGNALS_SQL, TERMS_SQL

QUERY, CATEGORY, NOW = "ledger", "billing", "2026-01-01T00:00:00.000Z"


def store_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocabula.session import table

    return g.violations(table(spark, sf_dir, "glossary_terms"))


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.presented(g.get_term(views.terms(spark, sf_dir), name=QUERY))


def term_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every learned term as a new glossary term."""
    from vocabula.session import table

    t = views.terms(spark, sf_dir)
    new = table(spark, sf_dir, "learned_terms").select(F.concat(F.lit("learned-"), F.col("learned_id").cast("string")).alias("id"), "name", F.coalesce("definition", F.lit("")).alias("definition"), "codeLocations")
    return g.create(t, new, NOW).select("id", "name", "confidence", "createdAt", F.size("codeLocations").alias("locations"), F.col("source.adapter").alias("adapter"))


def term_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence raised for every term that an event verified."""
    verified = views.signals(spark, sf_dir).filter("type = 'term-verified'").select(F.explode("termIds").alias("id")).distinct().withColumn("confidence", F.lit("ai-verified"))
    return g.update(views.terms(spark, sf_dir), verified, NOW).select("id", "name", "confidence", "updatedAt")


def term_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.terms(spark, sf_dir)
    kept, gone = g.remove(t, t.filter("deletedAt IS NOT NULL"))
    return kept.select("id", F.lit("kept").alias("state")).unionByName(gone.select("id", F.lit("removed").alias("state")))


def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.listed(views.terms(spark, sf_dir), category=CATEGORY, confidence="manual").select("id", "name", "category")


def terms_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.by_file(views.terms(spark, sf_dir), "Internal/").select("id", "name")


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.search(views.terms(spark, sf_dir), QUERY).select("id", "name", "score")


def search_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.query_context(views.terms(spark, sf_dir), QUERY).select("id", "name", "score", "coupled")


def label_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.labels(views.terms(spark, sf_dir))


def terms_presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.presented(views.terms(spark, sf_dir))


def resource_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.categories(views.terms(spark, sf_dir))


def resource_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.status(views.terms(spark, sf_dir))


# coupling and enrichment --------------------------------------------------------------------------------------------
def coupling_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.coupling(s.daily(s.coupling_events(views.signals(spark, sf_dir))))


def enrichment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.enrichment(views.signals(spark, sf_dir))
    return e.select("term_id", "access_count", "query_hits", F.size("patterns").alias("patterns"), "location_additions", "alias_additions", "verified", "score")


def term_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.patterns(views.signals(spark, sf_dir)).select("term_id", "query", "n")


def alias_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.suggested_aliases(s.enrichment(views.signals(spark, sf_dir)), views.terms(spark, sf_dir))


def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all terms whose name matches the query."""
    ids = g.search(views.terms(spark, sf_dir), QUERY).select(F.col("id").alias("term_id"))
    return s.related(views.signals(spark, sf_dir), ids)


def query_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.signals(spark, sf_dir)
    return s.boosts(s.query_terms(u), s.enrichment(u))


def enrichment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.state_statistics(s.enrichment(views.signals(spark, sf_dir)))


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.recent_log(views.signals(spark, sf_dir)).select("event_id", "type")


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.enriched_search(views.terms(spark, sf_dir), QUERY, views.signals(spark, sf_dir))


def enriched_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("id", "base_rank", "enriched_rank", "enrichment", "boost", "combined")


def enrichment_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.impact(_enriched(spark, sf_dir))


def search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.quality(_enriched(spark, sf_dir))


# SQL ----------------------------------------------------------------------------------------------------------------
def _alias(q: str) -> str:
    return f"list_filter(list_transform(aliases, lambda a: lower(a)), lambda a: contains(a, '{q}'))[1]"


def score_sql(q: str) -> str:
    return f"""(CASE WHEN lower(name) = '{q}' THEN 100 WHEN contains(lower(name), '{q}') THEN 50 ELSE 0 END
      + CASE WHEN {_alias(q)} = '{q}' THEN 80 WHEN {_alias(q)} IS NOT NULL THEN 40 ELSE 0 END
      + CASE WHEN contains(lower(definition), '{q}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(category), '{q}') THEN 20 ELSE 0 END)"""


_HITS = f"{TERMS_SQL}, hits AS (SELECT * FROM (SELECT *, {score_sql(QUERY)}::INT AS score FROM terms) WHERE score > 0)"
_SIG = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.USAGE_SIGNAL.items()) + " END"
_POINTS = " + ".join(f"{k} * {v}::DOUBLE" for k, v in d.SIGNAL_SCORES.items())
_COUNTS = ", ".join(f"count(*) FILTER (signal = '{k}') AS {k}" for k in d.SIGNAL_SCORES)
_DAYS = f"""{SIGNALS_SQL}, ev AS (SELECT DISTINCT event_id, unnest(termIds) AS term_id, {_SIG} AS signal, ts::DATE AS day FROM signals),
days AS (SELECT term_id, day, {_COUNTS} FROM ev WHERE term_id IS NOT NULL AND signal IS NOT NULL GROUP BY ALL),
steps AS (SELECT *, {_POINTS} AS points, row_number() OVER (PARTITION BY term_id ORDER BY day) AS n, lag(day) OVER (PARTITION BY term_id ORDER BY day) AS seen FROM days),
fold AS (SELECT term_id, n, day, least(1.0::DOUBLE, points) AS score FROM steps WHERE n = 1
  UNION ALL SELECT f.term_id, t.n, t.day, least(1.0::DOUBLE, CASE WHEN date_diff('day', t.seen, t.day) >= {d.DECAY_DAYS + 1} THEN f.score * 0.5::DOUBLE ELSE f.score END + t.points)
  FROM fold f JOIN steps t ON t.term_id = f.term_id AND t.n = f.n + 1)"""
_SUMS = ", ".join(f"sum({k})::BIGINT AS {k}" for k in d.SIGNAL_SCORES)
_ENR = f"""{SIGNALS_SQL}, ent AS (SELECT event_id, ts, type, lower(trim(query)) AS q, unnest(termIds) AS term_id FROM signals WHERE NOT (type = 'query' AND coalesce(trim(query), '') = '')),
kept AS (SELECT * FROM ent WHERE term_id IS NOT NULL),
qt AS (SELECT q AS query, term_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM kept WHERE type = 'query' GROUP BY ALL),
pat AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY ts, event_id, query) AS n FROM qt QUALIFY n <= {d.MAX_PATTERNS}),
np AS (SELECT term_id, count(*) AS patterns FROM pat GROUP BY term_id),
counts AS (SELECT term_id, count(*) FILTER (type = 'access') AS access_count, count(*) FILTER (type = 'query') AS query_hits, count(*) FILTER (type = 'code-location-added') AS location_additions,
  count(*) FILTER (type = 'alias-added') AS alias_additions, bool_or(type = 'term-verified') AS verified FROM kept GROUP BY term_id),
enr AS (SELECT c.*, coalesce(n.patterns, 0)::INT AS patterns, round(least(1.0::DOUBLE, least(log2(access_count + 1.0::DOUBLE) * 0.05::DOUBLE, 0.20::DOUBLE) + least(coalesce(n.patterns, 0) * 0.08::DOUBLE, 0.25::DOUBLE)
  + least(location_additions * 0.15::DOUBLE, 0.25::DOUBLE) + least(alias_additions * 0.10::DOUBLE, 0.15::DOUBLE) + CASE WHEN verified THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END), 9) AS score
  FROM counts c LEFT JOIN np n USING (term_id)),
boosts AS (SELECT query, term_id, round(least(0.10::DOUBLE + least(access_count * 0.02::DOUBLE, 0.10::DOUBLE) + least(query_hits * 0.01::DOUBLE, 0.10::DOUBLE), 0.30::DOUBLE), 9) AS boost FROM qt JOIN enr USING (term_id))"""
_RANK = f"""{_HITS}, {_ENR}, based AS (SELECT id, confidence, len(codeLocations) AS locations, row_number() OVER (ORDER BY score DESC, id) AS base_rank, count(*) OVER () AS n FROM hits),
comb AS (SELECT b.*, coalesce(e.score, 0.0::DOUBLE) AS enrichment, coalesce(o.boost, 0.0::DOUBLE) AS boost FROM based b LEFT JOIN enr e ON e.term_id = b.id LEFT JOIN boosts o ON o.term_id = b.id AND o.query = '{QUERY}'),
full_ AS (SELECT *, round(0.7::DOUBLE * ((n - base_rank + 1)::DOUBLE / n) + 0.3::DOUBLE * enrichment + boost, 9) AS combined FROM comb),
ranked AS (SELECT *, row_number() OVER (ORDER BY combined DESC, base_rank) AS enriched_rank, enrichment > 0 OR boost > 0 AS applied FROM full_)"""
_SHOWN = """id, name, definition, aliases, category, tags, confidence, source.adapter AS adapter, len(codeLocations)::INT AS locations, coalesce(coupling.score, 0.0::DOUBLE) AS coupling_score, coalesce(coupling.signals, 0)::BIGINT AS coupling_signals"""

QUERIES = {
    f.__name__: f
    for f in (
        store_validate, term_lookup, term_create, term_upsert, term_delete, list_filtered, terms_by_file, search_ranked, search_coupled, label_stream, terms_presented,
        resource_categories, resource_status, coupling_fold, enrichment_scores, term_patterns, alias_suggestions, related_terms, query_boost, enrichment_stats, signal_log,
        enriched_search, enrichment_impact, search_quality,
    )
}
ORACLE = {
    "store_validate": "SELECT id, unnest(list_filter([CASE WHEN id IS NULL THEN 'id must be a string' END, CASE WHEN name IS NULL THEN 'name must be a string' END, CASE WHEN definition IS NULL THEN 'definition must be a string' END, CASE WHEN createdAt IS NULL THEN 'createdAt must be a string' END, CASE WHEN updatedAt IS NULL THEN 'updatedAt must be a string' END, CASE WHEN aliases IS NULL THEN 'aliases must be a list' END, CASE WHEN codeLocations IS NULL THEN 'codeLocations must be a list' END], lambda x: x IS NOT NULL)) AS rule FROM glossary_terms",
    "term_lookup": f"WITH {_HITS} SELECT {_SHOWN} FROM hits ORDER BY score DESC, id LIMIT 1",
    "term_create": f"""WITH {TERMS_SQL} SELECT id, name, confidence, createdAt, len(codeLocations)::INT AS locations, source.adapter AS adapter FROM terms
        UNION ALL SELECT 'learned-' || learned_id, name, 'manual', '{NOW}', coalesce(len(codeLocations), 0)::INT, 'manual' FROM learned_terms""",
    "term_upsert": f"""WITH {TERMS_SQL}, {SIGNALS_SQL}, v AS (SELECT DISTINCT unnest(termIds) AS id FROM signals WHERE type = 'term-verified')
        SELECT t.id, t.name, CASE WHEN v.id IS NULL THEN confidence ELSE 'ai-verified' END AS confidence, CASE WHEN v.id IS NULL THEN updatedAt ELSE '{NOW}' END AS updatedAt FROM terms t LEFT JOIN v USING (id)""",
    "term_delete": f"WITH {TERMS_SQL} SELECT id, CASE WHEN deletedAt IS NULL THEN 'kept' ELSE 'removed' END AS state FROM terms",
    "list_filtered": f"WITH {TERMS_SQL} SELECT id, name, category FROM terms WHERE category = '{CATEGORY}' AND confidence = 'manual'",
    "terms_by_file": f"WITH {TERMS_SQL} SELECT id, name FROM terms WHERE len(list_filter(codeLocations, lambda x: contains(lower(x.filePath), 'internal/'))) > 0",
    "search_ranked": f"WITH {_HITS} SELECT id, name, score FROM hits",
    "search_coupled": f"WITH {_HITS} SELECT id, name, score, coalesce(coupling.score, 0.0::DOUBLE) AS coupled FROM hits ORDER BY coupled DESC, score DESC, id LIMIT 10",
    "label_stream": f"""WITH {TERMS_SQL}, l AS (SELECT id, definition, codeLocations, unnest(list_distinct(list_concat([name], aliases))) AS label FROM terms)
        SELECT id, label, left(definition, 200) AS definition, codeLocations[1].filePath AS path, codeLocations[1].symbol AS symbol FROM l WHERE regexp_replace(label, '[{views.SPACE_SQL}]', '', 'g') <> ''""",
    "terms_presented": f"WITH {TERMS_SQL} SELECT {_SHOWN} FROM terms",
    "resource_categories": f"WITH {TERMS_SQL} SELECT coalesce(category, 'uncategorized') AS category, count(*) AS terms FROM terms GROUP BY 1",
    "resource_status": f"""WITH {TERMS_SQL} SELECT count(*) AS terms, count(*) FILTER (confidence = 'ai-suggested') AS ai_suggested, count(*) FILTER (confidence = 'ai-verified') AS ai_verified,
        count(*) FILTER (confidence = 'manual') AS manual, count(*) FILTER (len(codeLocations) > 0) AS with_locations, count(*) FILTER (coupling IS NOT NULL) AS coupled FROM terms""",
    "coupling_fold": f"WITH RECURSIVE {_DAYS}, ends AS (SELECT term_id, arg_max(score, n) AS score, max(day) AS last_seen FROM fold GROUP BY term_id) SELECT term_id, round(score, 9) AS score, ({' + '.join(d.SIGNAL_SCORES)})::BIGINT AS signals, last_seen, {', '.join(d.SIGNAL_SCORES)} FROM ends JOIN (SELECT term_id, {_SUMS} FROM days GROUP BY term_id) USING (term_id)",
    "enrichment_scores": f"WITH {_ENR} SELECT term_id, access_count, query_hits, patterns, location_additions, alias_additions, verified, score FROM enr",
    "term_patterns": f"WITH {_ENR} SELECT term_id, query, n::INT AS n FROM pat",
    "alias_suggestions": f"WITH {TERMS_SQL}, {_ENR} SELECT term_id, query AS alias FROM pat JOIN terms t ON t.id = term_id WHERE NOT list_contains(list_transform(t.aliases, lambda a: lower(trim(a))), query)",
    "related_terms": f"WITH {_HITS}, {_ENR} SELECT p.term_id, q.term_id AS other_id, count(*) AS shared FROM pat p JOIN hits h ON h.id = p.term_id JOIN qt q USING (query) WHERE q.term_id <> p.term_id GROUP BY ALL",
    "query_boost": f"WITH {_ENR} SELECT * FROM boosts",
    "enrichment_stats": f"WITH {_ENR} SELECT count(*) AS terms, count(*) FILTER (verified) AS verified, sum(access_count)::BIGINT AS accesses, sum(query_hits)::BIGINT AS query_hits, round(avg(score), 6) AS mean_score FROM enr",
    "signal_log": f"WITH {SIGNALS_SQL} SELECT event_id, type FROM signals ORDER BY ts DESC, event_id DESC LIMIT {d.MAX_LOG}",
    "enriched_search": f"WITH {_RANK} SELECT id, base_rank, enriched_rank, enrichment, boost, combined FROM ranked",
    "enrichment_impact": f"WITH {_RANK} SELECT count(*) FILTER (base_rank <> enriched_rank) AS reordered, count(*) FILTER (applied) AS enriched, round(coalesce(avg(enrichment), 0.0::DOUBLE), 9) AS mean_enrichment, count(*) FILTER (base_rank <> enriched_rank) > 0 AS material FROM ranked",
    "search_quality": f"""WITH {_RANK} SELECT count(*) AS results, round(coalesce(least(1.0::DOUBLE, 0.10::DOUBLE + 0.35::DOUBLE * avg((locations > 0)::INT) + 0.25::DOUBLE * avg(enrichment)
        + 0.25::DOUBLE * avg((confidence IN ('manual', 'ai-verified'))::INT)), 0.0::DOUBLE), 9) AS quality FROM ranked""",
}
