"""How often every distinct value occurs and in how many records, with the too rare and too common ones marked.

Heavy values are detected by a mergeable sketch over all rows, which only decides the way they are counted. They are broadcast as
slots of an exact counter array that each task keeps for its rows, so no occurrence of a heavy value is shuffled; the same pass hands
the remaining occurrences on, and one exchange by value counts them. Both tables are united.

A record that was delivered again is one record. Records with several rows are found by their ids alone, in the pass that counts
records; for heavy values only the rows of such records are looked at once more, and what they counted too often is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut

#: Slots of the local counter arrays: a fixed bound.
HEAVY_SLOTS = 512
#: Ids of redelivered records up to which they are broadcast (some 50 bytes each); they meet the rows in a shuffle join beyond it.
NEAR = 500_000


def rows(df: DataFrame, src: str, record: str, value: str, many: bool = False) -> DataFrame:
    """(src, record, values), one row per row with at least one value; null and empty values are none. Values are compared exactly as
    written. values: (value, first) sorted, first = 1 at the first place of a value in its row."""
    every = F.col(value) if many else F.array(value)
    kept = F.array_sort(F.filter(every, lambda v: v.isNotNull() & (v != "")))
    return (
        df.select(F.lit(src).alias("src"), F.col(record).cast("string").alias("record"), kept.alias("values"))
        .filter(F.size("values") > 0)
        .select("src", "record", F.transform("values", lambda v, i: F.struct(v.alias("value"), ((i == 0) | (v != F.get("values", i - 1))).cast("long").alias("first"))).alias("values"))
    )


def _occurrences(rows_: DataFrame) -> DataFrame:
    return rows_.select("src", "record", F.explode("values").alias("v")).select("src", "record", "v.value", "v.first")


def heavy_values(rows_: DataFrame, slots: int = HEAVY_SLOTS) -> list[tuple[str, str]]:
    """At most `slots` values that the sketch holds to be the most frequent; a mistake costs time, never a count."""
    key = "concat(src, '\u001f', value)"
    top = _occurrences(rows_).selectExpr(f"approx_top_k({key}, {slots}, {slots * 32}) AS top").first()[0] or []
    least = 64
    return [tuple(x["item"].split("\u001f", 1)) for x in top if x["count"] >= least]


_COUNTED = "src string, value string, record string, slot long, occurrences long, records long"


def _count_heavy(slots: int):
    """Counts occurrences that have a slot in place, and hands the others on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        occ, rec = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        for b in batches:
            slot = b.column("slot")
            heavy = slot.is_valid()
            at = slot.drop_null().to_numpy()
            occ += np.bincount(at, minlength=slots)
            rec += np.bincount(at, weights=b.column("first").filter(heavy).to_numpy(), minlength=slots).astype(np.int64)
            if len(at) < len(b):
                rest = b.filter(slot.is_null())
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([rest.column("src"), rest.column("value"), rest.column("record"), none, pa.array(np.ones(len(rest), np.int64)), none], names)
        hit = np.flatnonzero(occ)
        no = pa.nulls(len(hit), pa.string())
        yield pa.RecordBatch.from_arrays([no, no, no, pa.array(hit), pa.array(occ[hit]), pa.array(rec[hit])], names)

    return count


def _again(rows_: DataFrame, repeated: DataFrame, near: bool, table: DataFrame) -> DataFrame:
    """(slot, again): how many rows too many the redelivered records gave each heavy value."""
    side = F.broadcast(repeated) if near else repeated
    return (
        _occurrences(rows_.join(side, ["src", "record"], "left_semi"))
        .join(F.broadcast(table), ["src", "value"])
        .groupBy("slot", "src", "record")
        .agg((F.sum("first") - 1).alias("again"))
        .groupBy("slot")
        .agg(F.sum("again").alias("again"))
    )


def frequencies(rows_: DataFrame, slots: int = HEAVY_SLOTS, near: int = NEAR) -> DataFrame:
    """(src, value, occurrences, records, n) of rows(): n = records of the source with at least one value.

    A record that is delivered again is one record, all its occurrences count. Empty input gives no rows.
    """
    spark = rows_.sparkSession
    heavy = heavy_values(rows_, slots)
    table = spark.createDataFrame([(s, v, i) for i, (s, v) in enumerate(heavy)], "src string, value string, slot long")
    # ids of records alone: their number, and those with several rows
    per = rows_.groupBy("src", "record").agg(F.count(F.lit(1)).alias("rows"))
    named = cut(per.groupBy("src", F.when(F.col("rows") > 1, F.col("record")).alias("record")).agg(F.count(F.lit(1)).alias("n")))
    n = named.groupBy("src").agg(F.sum("n").alias("n"))  # one row per source
    repeated = named.filter("record IS NOT NULL").select("src", "record")
    again = _again(rows_, repeated, repeated.count() <= near, table)

    counted = _occurrences(rows_).join(F.broadcast(table), ["src", "value"], "left").mapInArrow(_count_heavy(slots), _COUNTED)
    key: list[Column | str] = ["slot", "src", "value"]
    # one exchange: the rest by value, of a heavy value one row per task
    sums = (
        counted.repartition(*key)
        .groupBy(*key, "record")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .groupBy(*key)
        .agg(F.sum("occurrences").alias("occurrences"), F.coalesce(F.sum("records"), F.count(F.lit(1))).alias("records"))
    )
    named_heavy = table.select("slot", F.col("src").alias("hs"), F.col("value").alias("hv"))
    out = (
        sums.join(F.broadcast(named_heavy), "slot", "left")
        .join(F.broadcast(again), "slot", "left")
        .select(F.coalesce("src", "hs").alias("src"), F.coalesce("value", "hv").alias("value"), "occurrences", (F.col("records") - F.coalesce("again", F.lit(0))).alias("records"))
    )
    return out.join(F.broadcast(n), "src")


def marked(freq: DataFrame, common_part: int = 50) -> DataFrame:
    """Adds mark: `common` if common_part times the value's records exceeds n, else `rare` if it is in one record, else null.

    A value in the only record of few is both; it is `rare` first, as it tells nothing about any other record.
    """
    return freq.withColumn("mark", F.when(F.col("records") == 1, "rare").when(F.col("records") * common_part > F.col("n"), "common"))
