"""A glossary from code alone: concepts worth a term, their names, aliases and categories, with mapped locations."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.functions import naming
from vocabula.operators import mapping as m
from vocabula.semantics import SPACE, lookup, strings, wide_trim


def worthy() -> Column:
    """Of a concept (kind, name, exported). Constants never are."""
    kind, name = F.col("kind"), F.lower("name")
    exported = F.coalesce("exported", F.lit(False))
    return F.coalesce(
        F.when(kind.isin("class", "interface", "enum"), exported)
        .when(kind == "module", exported & ~name.isin(d.GENERIC_MODULES))
        .when(kind == "directory", ~name.isin(d.GENERIC_DIRECTORIES))
        .when(kind == "function", exported & (F.length("name") > 3))
        .when(kind.isin("namespace", "term", "definition"), True)
        .when(kind == "section", ~name.isin(d.GENERIC_SECTIONS)),
        F.lit(False),
    )


def category(path: Column) -> Column:
    """First segment that names a domain."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~F.contains(x, F.lit(".")) & ~F.array_contains(strings(*d.NON_DOMAIN_DIRECTORIES), F.lower(x)))
    return F.get(parts, F.lit(0))


def aliases(name: Column, human: Column) -> Column:
    words = F.split(human, rf"[{SPACE}]+")
    own = F.when((name != human) & (name != F.regexp_replace(human, rf"[{SPACE}]", "")), name)
    initials = F.when(F.size(words).between(2, 5), F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), ""))
    return F.array_compact(F.array(own, F.when(F.length(initials) >= 2, initials)))


def inferred_terms(concepts: DataFrame, order: str) -> DataFrame:
    """One term per distinct name: of equal names the one of the most telling kind, then the first in `order`."""
    human = naming.humanize(F.col("name"))
    told = " found in ", ". This term was auto-discovered during codebase bootstrap and may represent an organizational concept."
    made = F.concat(F.upper(F.left("kind", F.lit(1))), F.substring("kind", 2, 100), F.lit(' "'), F.col("name"), F.lit('"' + told[0]), F.col("filePath"), F.lit(told[1]))
    rows = concepts.filter(worthy()).select(
        wide_trim(F.lower("name")).alias("key"),
        F.struct(lookup(F.col("kind"), d.KIND_ORDER, F.lit(99)).alias("k"), F.col(order).alias("o")).alias("ord"),
        F.col("id").alias("concept_id"),
        human.alias("name"),
        F.when(F.length("description") > 10, F.col("description")).otherwise(made).alias("definition"),
        aliases(F.col("name"), human).alias("aliases"),
        category(F.col("filePath")).alias("category"),
        F.array("kind", "language", F.lit("bootstrap")).alias("tags"),
    )
    rest = [c for c in rows.columns if c not in ("key", "ord")]
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("key", "r.*")


def preview(concepts: DataFrame, order: str) -> DataFrame:
    """(term_name, concept_id, confidence): inferred terms with their mapped concepts. Terms of one name share all candidates, each with its best confidence."""
    terms = inferred_terms(concepts, order)
    mapped = m.mappings(m.term_tokens(terms.withColumnRenamed("concept_id", "id")), m.concept_tokens(concepts))
    return mapped.groupBy("term_name", "concept_id").agg(F.max("confidence").alias("confidence"))


def chosen_terms(ingested: DataFrame | None, inferred: DataFrame) -> DataFrame:
    """(name, definition, term_source): the terms of an adapter, or those inferred from code where there is no adapter or it has none."""
    cols = ["name", "definition"]
    own = inferred.select(*cols, F.lit("codebase-inferred").alias("term_source"))
    if ingested is None or ingested.isEmpty():
        return own
    return ingested.select(*cols, F.lit("adapter").alias("term_source"))


def within(seconds: float, spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """Runs the jobs of an extraction and cancels them when they take longer than it may: TimeoutError then."""
    sc, group, late = spark.sparkContext, f"extract-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    clock = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "extraction", interruptOnCancel=True)
    clock.start()
    try:
        out = work()
    except Exception as e:
        if not late.is_set():
            raise
        raise TimeoutError(f"the extraction took more than {seconds} s") from e
    finally:
        clock.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
    if late.is_set():
        raise TimeoutError(f"the extraction took more than {seconds} s")
    return out


def run(concepts: DataFrame, order: str, ingested: DataFrame | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """The whole run: terms, their mapped locations, and what was done in numbers. A dry run has no locations."""
    inferred = inferred_terms(concepts, order)
    terms = chosen_terms(ingested, inferred)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    numbers = count(concepts, "concepts").union(terms.groupBy(F.concat(F.lit("terms:"), "term_source").alias("measure")).agg(F.count(F.lit(1)).alias("n")))
    out = {"terms": terms, "numbers": numbers}
    if not dry_run:
        out["locations"] = preview(concepts, order)
    return out
