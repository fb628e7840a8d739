"""References to records that do not exist (yet, or any more).

References are pre-aggregated per key and period with the earliest and latest time, which settles most groups as a whole: a group
is sound if its target lives through all of its times and orphaned if through none. Only rows of groups that are not sound are
looked at one by one. Groups that hold a large share of the references are checked by a broadcast (their number is bounded, see
scale.py), all others by a shuffle join; both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut, join_on_groups, total

REFERENCE = ("src", "space", "row_key", "ref_key", "at")
KEYS = ["space", "ref_key", "period"]


def references(df: DataFrame, src: str, space: str, row_key: str, ref: str, at: str, many: bool = False) -> DataFrame:
    """References of one table. Null and blank ones are none; one that repeats within a row counts once."""
    key = F.explode(F.array_distinct(ref)) if many else F.col(ref)
    return (
        df.select(F.lit(src).alias("src"), F.lit(space).alias("space"), F.col(row_key).alias("row_key"), key.alias("ref_key"), F.col(at).alias("at"))
        .filter(F.col("ref_key").isNotNull() & (F.regexp_replace("ref_key", r"[\s 　]+", "") != ""))
        .withColumn("period", F.date_format("at", "yyyy-MM"))
    )


def lifetimes(df: DataFrame, space: str, key: str, since: str, until: str) -> DataFrame:
    """From the earliest `since` of a key's rows, inclusive, to its `until`, exclusive (null: for good)."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.lit(space).alias("space"), F.col(key).alias("ref_key")).agg(F.min(since).alias("since"), F.max(until).alias("until"))


def orphans(refs: DataFrame, alive: DataFrame) -> DataFrame:
    """Distinct (src, row_key, ref_key, period) of the references whose target is not alive at their time.

    A reference without a time is sound if the target ever existed. Empty inputs give no rows; repeated rows give one case.
    """
    refs = refs.withColumn("period", F.coalesce("period", F.lit("")))
    seen = refs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("at").alias("timed"))
    judged = seen.join(alive, ["space", "ref_key"], "left").withColumn(
        "sound",
        F.col("since").isNotNull()
        & ((F.col("timed") == 0) | ((F.col("since") <= F.col("lo")) & (F.col("until").isNull() | (F.col("hi") < F.col("until"))))),
    )
    judged = cut(judged.select(*KEYS, "n", "since", "until", "sound"))
    rows = total(judged, "n")
    missing = F.col("since").isNull() | (F.col("at") < F.col("since")) | (F.col("at") >= F.col("until"))
    found = join_on_groups(refs, judged.filter(~F.col("sound")), KEYS, "n", rows, F.coalesce(missing, F.lit(False)))
    return found.select("src", "row_key", "ref_key", "period").distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table and period."""
    return found.groupBy("src", "period").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_key").alias("missing_keys"))
