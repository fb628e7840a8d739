"""Coupling signals and usage enrichment, folded from the event log.

The coupling fold halves the score after a long pause, adds a signal's points and caps at 1. Within a day it never halves and addition commutes,
so a day is one step min(1, score + points): days are aggregated map-side and only a term's days, bounded by the calendar, are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.scale import Scratch, total
from vocabula.semantics import lookup

SIGNALS = list(d.SIGNAL_SCORES)


def coupling_events(usage: DataFrame) -> DataFrame:
    """(term_id, signal, day) of usage events, one per term and event; events of unknown kinds are none."""
    return (
        usage.select(F.explode(F.array_distinct("termIds")).alias("term_id"), lookup(F.col("type"), d.USAGE_SIGNAL).alias("signal"), F.to_date("ts").alias("day"))
        .filter("term_id IS NOT NULL AND signal IS NOT NULL AND day IS NOT NULL")
    )


def daily(events: DataFrame) -> DataFrame:
    """(term_id, day, one count per signal): also the state of the streaming form."""
    return events.groupBy("term_id", "day").agg(*[F.count_if(F.col("signal") == s).alias(s) for s in SIGNALS])


def _fold(days: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("date").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        # the pause runs from midnight of the last day to some time of this one
        halved = F.when(F.date_diff(x["day"], acc["seen"]) >= d.DECAY_DAYS + 1, acc["score"] * 0.5).otherwise(acc["score"])
        return F.struct(F.least(F.lit(1.0), halved + x["points"]).alias("score"), x["day"].alias("seen"))

    return F.aggregate(days, start, step)


def coupling(days: DataFrame) -> DataFrame:
    """(term_id, score, signals, last_seen, one count per signal) from daily()."""
    points = sum((F.col(s) * F.lit(w) for s, w in d.SIGNAL_SCORES.items()), F.lit(0.0))
    folded = days.withColumn("points", points).groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("day", "points"))).alias("days"), *[F.sum(s).alias(s) for s in SIGNALS])
    return folded.select(
        "term_id",
        F.round(_fold(F.col("days"))["score"], 9).alias("score"),
        sum((F.col(s) for s in SIGNALS), F.lit(0)).cast("long").alias("signals"),
        F.element_at("days", -1)["day"].alias("last_seen"),
        *SIGNALS,
    )


# enrichment ---------------------------------------------------------------------------------------------------------
def normalized_query(q: Column) -> Column:
    return F.lower(F.trim(q))


def _of(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the terms asked for (column term_id), of all if none are given. The rest of the log is left before anything is shuffled."""
    return rows if ids is None else rows.join(ids.select("term_id"), "term_id", "left_semi")


def query_terms(usage: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(query, term_id, first_ts, first_event): each query with the terms it found; blank queries are none."""
    rows = usage.filter(F.col("type") == "query").select(normalized_query(F.col("query")).alias("query"), F.explode("termIds").alias("term_id"), "ts", "event_id")
    first = _of(rows.filter("query <> '' AND term_id IS NOT NULL"), ids).groupBy("query", "term_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("query", "term_id", F.col("f.ts").alias("first_ts"), F.col("f.event_id").alias("first_event"))


def patterns(usage: DataFrame, most: int = d.MAX_PATTERNS, ids: DataFrame | None = None) -> DataFrame:
    """The first `most` distinct queries of each term, in order of appearance."""
    w = Window.partitionBy("term_id").orderBy("first_ts", "first_event", "query")
    return query_terms(usage, ids).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)


def enrichment(usage: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(term_id, access_count, query_hits, patterns, location_additions, alias_additions, verified, last_accessed, score) of every term
    that an event names; repeats of a term within an event count."""
    kind = F.col("type")
    blank = (kind == "query") & (F.coalesce(normalized_query(F.col("query")), F.lit("")) == "")
    rows = usage.filter(~blank).select(F.explode("termIds").alias("term_id"), "type", "ts").filter("term_id IS NOT NULL")
    counts = _of(rows, ids).groupBy("term_id").agg(
        F.count_if(kind == "access").alias("access_count"),
        F.count_if(kind == "query").alias("query_hits"),
        F.count_if(kind == "code-location-added").alias("location_additions"),
        F.count_if(kind == "alias-added").alias("alias_additions"),
        F.bool_or(kind == "term-verified").alias("verified"),
        F.max(F.when(kind == "access", F.col("ts"))).alias("last_accessed"),
    )
    found = patterns(usage, ids=ids).groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("n", "query"))).alias("p")).select("term_id", F.col("p.query").alias("patterns"))
    joined = counts.join(found, "term_id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    return joined.withColumn("score", F.round(score(), 9))


def _part(amount: Column, rule: tuple[float, float]) -> Column:
    return F.least(amount * F.lit(rule[0]), F.lit(rule[1]))


def score() -> Column:
    parts = (
        _part(F.log2(F.col("access_count") + F.lit(1.0)), d.ENRICH_ACCESS)
        + _part(F.size("patterns"), d.ENRICH_PATTERN)
        + _part(F.col("location_additions"), d.ENRICH_LOCATION)
        + _part(F.col("alias_additions"), d.ENRICH_ALIAS)
        + F.when(F.col("verified"), F.lit(d.ENRICH_VERIFIED)).otherwise(F.lit(0.0))
    )
    return F.least(F.lit(1.0), parts)


def suggested_aliases(enriched: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, alias): patterns that are not yet an alias."""
    known = terms.select(F.col("id").alias("term_id"), F.transform("aliases", lambda a: F.lower(F.trim(a))).alias("known"))
    return enriched.join(known, "term_id").select("term_id", F.explode(F.array_except("patterns", "known")).alias("alias"))


def boosts(found: DataFrame, enriched: DataFrame) -> DataFrame:
    """(query, term_id, boost) of each query and term that met before."""
    raw = F.lit(0.10) + F.least(F.col("access_count") * F.lit(0.02), F.lit(0.10)) + F.least(F.col("query_hits") * F.lit(0.01), F.lit(0.10))
    return found.select("query", "term_id").join(enriched, "term_id").select("query", "term_id", F.round(F.least(raw, F.lit(0.30)), 9).alias("boost"))


#: Rows of the given terms that are broadcast at a time, pairs of terms that a task counts, and the most tasks it takes.
NEAR_ROWS, TASK_PAIRS, MOST_TASKS = 100_000, 1_000_000, 10_000


def related(usage: DataFrame, ids: DataFrame) -> DataFrame:
    """(term_id, other_id, shared): terms found by the queries of the given terms (at most 50 each).

    Pairs grow with the product of the terms of a query. All queries of another term are in one task, and blocks of the given terms are
    brought there, so pairs are counted where they are formed and none of them is shuffled.
    """
    scratch = Scratch(usage.sparkSession)
    mine = scratch.cut(patterns(usage, ids=ids).select("term_id", "query"))
    asked = mine.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    others = scratch.cut(query_terms(usage).select("query", F.col("term_id").alias("other_id")).join(asked, "query").select("query", "other_id", "n"))
    blocks = max(1, -(-mine.count() // NEAR_ROWS))
    tasks = -(-total(others, "n") // (TASK_PAIRS * blocks))
    tasks = max(int(usage.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, tasks))
    near = others.select("query", "other_id").repartition(tasks, "other_id")
    out = None
    for i in range(blocks):
        own = mine if blocks == 1 else mine.filter(F.pmod(F.xxhash64("term_id"), F.lit(blocks)) == i)
        pairs = near.join(F.broadcast(own), "query").filter("term_id <> other_id").groupBy("term_id", "other_id").agg(F.count(F.lit(1)).alias("shared"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def recent_log(usage: DataFrame, most: int = d.MAX_LOG) -> DataFrame:
    return usage.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(most)


def state_statistics(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count(F.lit(1)).alias("terms"), F.count_if("verified").alias("verified"), F.sum("access_count").alias("accesses"), F.sum("query_hits").alias("query_hits"), F.round(F.avg("score"), 6).alias("mean_score"))
