"""Code affected by a change of terms: matched terms, their locations by file, and a summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import glossary
from vocabula.semantics import lookup

FILE_LEVEL = "(file-level)"


def matched_terms(terms: DataFrame, query: str, min_confidence: str | None = None, with_locations: bool = True, most: int = d.MAX_IMPACT_TERMS) -> DataFrame:
    """The `most` best hits, best first, in column term_ord; the limit is the feature."""
    hits = glossary.search(terms, query)
    if min_confidence:
        hits = hits.filter(lookup(F.col("confidence"), d.CONFIDENCE_RANK, F.lit(0)) >= d.CONFIDENCE_RANK[min_confidence])
    if with_locations:
        hits = hits.filter(F.size("codeLocations") > 0)
    top = hits.select("id", "name", "definition", "confidence", "codeLocations", "score").orderBy(F.col("score").desc(), "id").limit(most)
    return top.select(F.struct((-F.col("score")).alias("less"), "id").alias("term_ord"), "id", "name", "definition", "confidence", "codeLocations")


def symbols(matched: DataFrame, relationships: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """(filePath, ord, symbol, term_id, term_name, relationship, first_line, last_line, note): the first of each symbol, term and
    relationship in a file; a location without symbol is file level."""
    rows = matched.select("term_ord", F.col("id").alias("term_id"), F.col("name").alias("term_name"), F.posexplode("codeLocations").alias("at", "loc"))
    if relationships is not None:
        rows = rows.filter(F.col("loc.relationship").isin(*relationships))
    if path:
        rows = rows.filter(F.contains(F.lower("loc.filePath"), F.lit(path.lower())))
    rows = rows.select(
        F.col("loc.filePath").alias("filePath"),
        F.struct("term_ord", "at").alias("ord"),
        F.when(F.coalesce("loc.symbol", F.lit("")) == "", FILE_LEVEL).otherwise(F.col("loc.symbol")).alias("symbol"),
        "term_id",
        "term_name",
        F.col("loc.relationship").alias("relationship"),
        F.col("loc.lineRange.start").alias("first_line"),
        F.col("loc.lineRange.end").alias("last_line"),
        F.col("loc.note").alias("note"),
    )
    key = ["filePath", "symbol", "term_id", "relationship"]
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*key, "r.*")


def files(found: DataFrame) -> DataFrame:
    """One row per file: symbols in order, distinct relationships and terms by first appearance. Order by n_symbols descending, path.

    A file's symbols come from at most MAX_IMPACT_TERMS terms, so the lists are bounded by their locations.
    """
    item = F.struct("ord", "symbol", "relationship", "term_id", "term_name")
    g = found.groupBy("filePath").agg(F.sort_array(F.collect_list(item)).alias("s"))
    return g.select(
        "filePath",
        F.size("s").alias("n_symbols"),
        F.col("s.symbol").alias("symbols"),
        F.array_distinct("s.relationship").alias("relationships"),
        F.array_distinct("s.term_id").alias("term_ids"),
        F.array_distinct("s.term_name").alias("term_names"),
    )


def in_display_order(affected: DataFrame) -> DataFrame:
    return affected.orderBy(F.col("n_symbols").desc(), F.collate("filePath", "UNICODE"))


def summary(matched: DataFrame, found: DataFrame) -> DataFrame:
    """(measure, key, n): totals, symbols by relationship, terms by confidence (before location filters)."""
    total = lambda df, name, c: df.agg(c.cast("long").alias("n")).select(F.lit("total").alias("measure"), F.lit(name).alias("key"), "n")
    by = lambda df, name, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    return (
        total(matched, "terms", F.count(F.lit(1)))
        .union(total(found, "files", F.countDistinct("filePath")))
        .union(total(found, "symbols", F.count(F.lit(1))))
        .union(by(found, "relationship", "relationship"))
        .union(by(matched, "confidence", "confidence"))
    )
