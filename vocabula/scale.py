"""Building blocks that keep plans safe at any size: lineage cuts and joins that survive hot keys.

A hot key is one that holds at least 1/HOT_SHARE of all rows, so there are never more than HOT_SHARE of them: that bound is what
makes it safe to broadcast them. Everything else goes through a shuffle.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula.session import checkpoint_folder

#: At most so many keys can each hold 1/HOT_SHARE of the rows.
HOT_SHARE = 1024


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of an iterative plan, written in the shared checkpoint folder. They cut lineage as checkpoint() does, but their sizes are
    known: estimates of checkpoints are those of the plans behind them, and joined with each other round by round they grow beyond all
    bounds. drop() removes what a round has replaced, and what is left goes with the application."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._remove, self.folder)

    def cut(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, keep: Sequence[DataFrame]) -> None:
        """Removes all tables but those of the DataFrames to keep, as cut() returned them."""
        kept = {id(df) for df in keep}
        for key, (_, path) in self.paths.items():
            if key not in kept:
                self._remove(path)

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:  # the session is still there
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the stages that run now, for a caller that shows how far a long plan is."""
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in infos if i is not None]


def total(df: DataFrame, weight: str) -> int:
    return df.agg(F.sum(weight)).first()[0] or 0


def is_hot(weight: str, rows: int, share: int = HOT_SHARE) -> Column:
    """True for at most `share` of the keys whose weights add up to `rows`."""
    return (F.col(weight) * F.lit(share) >= F.lit(rows)) & (F.col(weight) > 1)


def join_on_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str, n_rows: int, condition: Column | None = None) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per key, `weight` rows each on the other side), safe for hot keys.

    Hot groups (no more than HOT_SHARE by the pigeonhole principle) are broadcast, so the rows of a hot key stay where they are;
    the rest meets in a shuffle join. `groups` should have been cut, as it is read twice. Both sides' keys must not be null.
    """
    keys = list(keys)
    hot = groups.filter(is_hot(weight, n_rows))
    cold = groups.filter(~is_hot(weight, n_rows))
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    out = near.unionByName(far)
    return out if condition is None else out.filter(condition)


def hot_keys(weights: DataFrame, keys: Sequence[str], weight: str, n_rows: int, least: int = 1000) -> DataFrame | None:
    """The keys of at least `least` rows that is_hot() holds to be hot, at most HOT_SHARE of them; None if there are none."""
    hot = weights.filter(is_hot(weight, n_rows) & (F.col(weight) >= least)).select(*keys)
    return None if hot.isEmpty() else hot


def join_beside(rows: DataFrame, side: DataFrame, hot: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Inner join with `side` (one row per key), where the keys in `hot` (see hot_keys) are met by broadcast and all others by shuffle."""
    keys = list(keys)
    if hot is None:
        return rows.join(side, keys)
    near = rows.join(F.broadcast(side.join(F.broadcast(hot), keys, "left_semi")), keys)
    return near.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(side, keys))


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) in a total order without sorting in one task: range partitions are numbered on their own and
    shifted by the sizes of those before them. The order should have no ties, else tied rows are numbered in any order."""
    from pyspark.sql import Window

    order = list(order)
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count().orderBy("_part").collect()  # one row per partition
    before, shift = 0, {}
    for r in sizes:
        shift[r["_part"]] = before
        before += r["count"]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    if not shift:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in shift.items() for x in kv]), F.col("_part").cast("long"))
    return parts.withColumn(name, local + offset).drop("_part")
