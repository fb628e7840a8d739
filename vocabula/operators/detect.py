"""Glossary labels found in prompts and tool output.

A label matches in any case where no ASCII letter, digit or underscore adjoins it, so also next to Hangul. All labels are one automaton, built
once per worker process from a broadcast of labels up to a checked size; above it, parts of texts that stand free are looked up in a table of
bits and joined with the labels that are equal to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocabula.operators import substrings as sub
from vocabula.scale import cut
from vocabula.semantics import wide_trim

MAX_AUTOMATON = 2_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _free(text: str, start: int, end: int) -> bool:
    return (start == 0 or text[start - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD)


def matches(texts: DataFrame, labels: DataFrame, key: str, text: str, most: int = MAX_AUTOMATON) -> DataFrame:
    """Distinct (key, term_id, label): of a term the label that stands first in the text, of one place the longest.

    labels: (id, label); blank labels match nothing, null texts neither.
    """
    kept = labels.select(F.col("id").alias("term_id"), F.lower("label").alias("low"), "label").filter(wide_trim(F.col("label")) != "")
    size = kept.agg(F.sum(F.length("low")).alias("n")).first()["n"] or 0
    rows = texts.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter(F.length("text") > 0)
    kind = rows.schema["key"].dataType.simpleString()
    found = _automaton(rows, kept, kind) if size <= most else _joined(rows, kept)
    return found.groupBy("key", "term_id").agg(F.min_by("label", F.struct("at", (-F.length("label")).alias("n"), "label")).alias("label"))


_built: dict = {}


def _automaton(rows: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    import ahocorasick

    by: dict[str, list[tuple[str, str]]] = {}
    for r in labels.collect():
        by.setdefault(r["low"], []).append((r["term_id"], r["label"]))
    shared, name = rows.sparkSession.sparkContext.broadcast(by), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vocabula.operators.detect import _built  # of the worker process, not a copy that travels with the function

        a = _built.get(name)
        if a is None:
            a = ahocorasick.Automaton()
            for low, owners in shared.value.items():
                a.add_word(low, (len(low), owners))
            a.make_automaton() if len(a) else None
            _built.clear()  # one at a time
            _built[name] = a
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for end, (n, owners) in a.iter(t) if len(a) else ():
                    if _free(t, end + 1 - n, end + 1):
                        out += [(k, i, label, end + 1 - n) for i, label in owners]
            if out:
                types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], ["key", "term_id", "label", "at"])

    return rows.mapInArrow(run, f"key {kind}, term_id string, label string, at long")


def _joined(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Parts of a text that stand free and may be labels meet the labels that are equal to them."""
    labels = cut(labels)
    return sub.found(rows, labels, free=True).join(labels, "low").select("key", "term_id", "label", "at")


def tool_texts(calls: DataFrame, key: str, tool: str, given: str, result: str, own: str) -> DataFrame:
    """(key, text): what tools were given and returned, but for calls of tools whose names begin with `own` and blank texts."""
    text = F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(result, F.lit("")))
    return calls.filter(~F.startswith(F.coalesce(tool, F.lit("")), F.lit(own))).select(F.col(key).alias("key"), text.alias("text")).filter(wide_trim(F.col("text")) != "")


def best(found: DataFrame, terms: DataFrame, most: int = 10) -> DataFrame:
    """The `most` most coupled terms of each text; ties by id."""
    score = terms.select(F.col("id").alias("term_id"), F.coalesce("coupling.score", F.lit(0.0)).alias("coupled"))
    w = Window.partitionBy("key").orderBy(F.col("coupled").desc(), "term_id")
    return found.join(score, "term_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def context_lines(top: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, rank, line): name with its first location and relationship, and the definition."""
    first = F.get("codeLocations", F.lit(0))
    place = F.when(first.isNull(), "").otherwise(F.concat(F.lit(" ("), first["filePath"], F.when(first["symbol"].isNotNull(), F.concat(F.lit("#"), first["symbol"])).otherwise(""), F.lit(", "), first["relationship"], F.lit(")")))
    info = terms.select(F.col("id").alias("term_id"), F.concat("name", place, F.lit(": "), F.left("definition", F.lit(200))).alias("line"))
    return top.join(info, "term_id").select("key", "rank", "line")


def advice(found: DataFrame) -> DataFrame:
    """One signal per text and term, for the coupling fold."""
    return found.select("key", "term_id", F.lit("prompt").alias("signal"))
