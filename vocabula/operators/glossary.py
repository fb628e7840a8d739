"""Glossary terms: validation, changes, filters and scored search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.semantics import wide_trim


# changes ------------------------------------------------------------------------------------------------------------
def create(terms: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Appends terms. Missing lists are empty, source and confidence are manual, a given coupling is dropped; names need not be unique."""
    kinds = dict(terms.dtypes)
    have = set(new.columns)

    def given(c: str, default: Column) -> Column:
        value = F.coalesce(F.col(c).cast(kinds[c]), default.cast(kinds[c])) if c in have else default.cast(kinds[c])
        return value.alias(c)

    defaults = {"aliases": F.array(), "codeLocations": F.array(), "tags": F.array(), "confidence": F.lit("manual"), "createdAt": F.lit(now), "updatedAt": F.lit(now)}
    source = F.named_struct(F.lit("adapter"), F.lit("manual"), F.lit("externalId"), F.lit(None), F.lit("url"), F.lit(None))
    columns = [
        F.lit(None).cast(kinds[c]).alias(c) if c == "coupling" else given(c, source) if c == "source" else given(c, defaults.get(c, F.lit(None))) for c in terms.columns
    ]
    return terms.unionByName(new.select(*columns))


def update(terms: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Sets the non-null fields of `changes` (one row per id); id and createdAt stay, updatedAt moves. Lists are replaced as a whole."""
    fields = [c for c in changes.columns if c in terms.columns and c not in ("id", "createdAt", "updatedAt")]
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = terms.join(new, "id", "left")
    out = {c: F.coalesce(f"_new_{c}", c) for c in fields} | {"updatedAt": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updatedAt"))}
    return joined.withColumns(out).select(*terms.columns)


def remove(terms: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms that stay and a snapshot of those removed."""
    keys = ids.select("id").distinct()
    return terms.join(keys, "id", "left_anti"), terms.join(keys, "id", "left_semi")


def violations(terms: DataFrame) -> DataFrame:
    """(id, rule): one row per broken rule. Tags, source and confidence are not checked."""
    text = ["id", "name", "definition", "createdAt", "updatedAt"]
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} must be a string")) for c in text] + [F.when(F.col(c).isNull(), F.lit(f"{c} must be a list")) for c in ("aliases", "codeLocations")]
    return terms.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


# filters ------------------------------------------------------------------------------------------------------------
def listed(terms: DataFrame, category: str | None = None, tag: str | None = None, confidence: str | None = None, adapter: str | None = None) -> DataFrame:
    """Conjunction of the filters given; an empty one counts as none."""
    if category:
        terms = terms.filter(F.col("category") == category)
    if tag:
        terms = terms.filter(F.array_contains("tags", tag))
    if confidence:
        terms = terms.filter(F.col("confidence") == confidence)
    if adapter:
        terms = terms.filter(F.col("source.adapter") == adapter)
    return terms


def by_file(terms: DataFrame, path: str) -> DataFrame:
    """Terms with a location whose path holds the text, in any case."""
    return terms.filter(F.exists("codeLocations", lambda x: F.contains(F.lower(x["filePath"]), F.lit(path.lower()))))


# search -------------------------------------------------------------------------------------------------------------
def relevance(query: str) -> Column:
    """Points of a term. The first alias that holds the query decides the alias points, even if a later one equals it."""
    q = F.lit(query.strip().lower())
    p = d.SEARCH_POINTS
    name = F.lower("name")
    alias = F.try_element_at(F.filter(F.transform("aliases", F.lower), lambda a: F.contains(a, q)), F.lit(1))
    return (
        F.when(name == q, p["name"]).when(F.contains(name, q), p["name_part"]).otherwise(0)
        + F.when(alias == q, p["alias"]).when(alias.isNotNull(), p["alias_part"]).otherwise(0)
        + F.when(F.contains(F.lower("definition"), q), p["definition"]).otherwise(0)
        + F.when(F.contains(F.lower("category"), q), p["category"]).otherwise(0)
    )


def search(terms: DataFrame, query: str) -> DataFrame:
    """Terms with points for the query, in column `score`; a blank query finds none. Order by score descending, then id."""
    if not query.strip():
        return terms.withColumn("score", F.lit(0)).limit(0)
    return terms.withColumn("score", relevance(query)).filter(F.col("score") > 0)


def query_context(terms: DataFrame, query: str, category: str | None = None, limit: int = 10) -> DataFrame:
    """Search hits by coupling first, points second, as the look-up of a prompt wants them."""
    hits = listed(search(terms, query), category=category).withColumn("coupled", F.coalesce("coupling.score", F.lit(0.0)))
    return hits.orderBy(F.col("coupled").desc(), F.col("score").desc(), "id").limit(min(limit, 100))


def get_term(terms: DataFrame, term_id: str | None = None, name: str | None = None) -> DataFrame:
    """By id first; else the best hit for the name."""
    by_id = terms.filter(F.col("id") == F.lit(term_id)).withColumn("prefer", F.lit(0)).withColumn("score", F.lit(0))
    hit = search(terms, name or "").withColumn("prefer", F.lit(1))
    return by_id.unionByName(hit, allowMissingColumns=True).orderBy("prefer", F.col("score").desc(), "id").limit(1).drop("prefer")


def presented(terms: DataFrame) -> DataFrame:
    """Flat output form with defaults for a missing coupling."""
    return terms.select(
        "id", "name", "definition", "aliases", "category", "tags", "confidence",
        F.col("source.adapter").alias("adapter"),
        F.size("codeLocations").alias("locations"),
        F.coalesce("coupling.score", F.lit(0.0)).alias("coupling_score"),
        F.coalesce("coupling.signals", F.lit(0)).cast("long").alias("coupling_signals"),
    )


def labels(terms: DataFrame, most: int = 200) -> DataFrame:
    """(id, label, definition, path, symbol): one row per name and alias, with the first location."""
    first = F.get("codeLocations", F.lit(0))
    return terms.select(
        "id",
        F.explode(F.array_distinct(F.filter(F.concat(F.array("name"), "aliases"), lambda x: wide_trim(x) != ""))).alias("label"),
        F.left("definition", F.lit(most)).alias("definition"),
        first["filePath"].alias("path"),
        first["symbol"].alias("symbol"),
    )


def cold_start(terms: DataFrame, message: str = "The glossary has no terms yet.", how: Sequence[str] = ("Run the bootstrap", "Import items", "Add terms")) -> DataFrame:
    """(cold_start, message, how): one row of guidance if the store is empty, else no row. Looks at one term at most."""
    one = terms.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return one.select(F.lit(True).alias("cold_start"), F.lit(message).alias("message"), F.array(*[F.lit(x) for x in how]).alias("how"))


# resources ----------------------------------------------------------------------------------------------------------
def categories(terms: DataFrame) -> DataFrame:
    return terms.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("terms"))


def status(terms: DataFrame) -> DataFrame:
    """One row: terms by confidence, with locations, with coupling."""
    return terms.agg(
        F.count(F.lit(1)).alias("terms"),
        *[F.count_if(F.col("confidence") == c).alias(c.replace("-", "_")) for c in d.CONFIDENCE_RANK],
        F.count_if(F.size("codeLocations") > 0).alias("with_locations"),
        F.count_if(F.col("coupling").isNotNull()).alias("coupled"),
    )
