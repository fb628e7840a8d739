"""Items that stand together in baskets: pair counts and how much more often than chance.

Items are counted under 64-bit hashes, made different for different items, and get their names back only for pairs that survive. Ordinary baskets emit their pairs in place; baskets of more than `chunk` items are split into chunks whose
products are spread over tasks. Counts combine on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut

CHUNK = 32


def baskets(df: DataFrame, src: str, record: str, items: str) -> DataFrame:
    """(src, record, items): an item once per record, null items dropped, redelivered records merged, empty ones left out."""
    kept = df.select(F.lit(src).alias("src"), F.col(record).alias("record"), F.array_compact(F.array_distinct(items)).alias("items")).filter(F.size("items") > 0)
    return (
        kept.groupBy("src", "record")
        .agg(F.collect_set("items").alias("sets"))
        .select("src", "record", F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.array_distinct(F.flatten("sets"))).alias("items"))
    )


def _within(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _across(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))


def pair_counts(hashed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(src, a, b, n_ab) with a < b from (src, record, items: sorted distinct array of longs).

    A huge basket goes as one row per chunk; these are spread before they are paired, so that no task writes all chunk pairs of a basket.
    """
    small = hashed.filter((F.size("items") > 1) & (F.size("items") <= chunk)).select("src", F.explode(_within(F.col("items"))).alias("p"))
    count = F.floor((F.size("items") - 1) / chunk).cast("int") + 1
    chunks = (
        hashed.filter(F.size("items") > chunk)
        .select("src", "record", count.alias("k"), F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("items", i * chunk + 1, F.lit(chunk)))).alias("i", "part"))
        .repartition("src", "record", "i")
    )
    # each chunk is sent to the cells of its row and column; a cell gets the two chunks it multiplies, on the diagonal one
    cells = chunks.select("src", "record", "i", "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).select("src", "record", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.struct("i", "part").alias("c"))
    met = cells.groupBy("src", "record", "lo", "hi").agg(F.min("c").alias("x"), F.max("c").alias("y"))
    pairs = F.when(F.col("lo") == F.col("hi"), _within(F.col("x.part"))).otherwise(_across(F.col("x.part"), F.col("y.part")))
    both = small.unionByName(met.select("src", F.explode(pairs).alias("p"))).select("src", "p.a", "p.b")
    return both.groupBy("src", "a", "b").agg(F.count(F.lit(1)).alias("n_ab"))


Coder = Callable[[Column, int], Column]


def _code(x: Column, level: int) -> Column:
    return F.xxhash64(x) if level == 0 else F.xxhash64(F.lit(level), x)


def _coder(terms: DataFrame, code: Coder) -> Callable[[Column], Column]:
    """A 64-bit number for every term, different for different ones. Terms that share a number (of ten billion terms some three) get
    another one, until none do; so few come to the driver."""
    again: list[list[str]] = []

    def number(x: Column) -> Column:
        out = code(x, 0)
        for level, words in enumerate(again, 1):
            out = F.when(x.isin(*words), code(x, level)).otherwise(out)
        return out

    while True:
        coded = terms.select("src", number(F.col("term")).alias("h"), "term")
        shared = coded.groupBy("src", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("src", "h").collect()
        if not shared:
            return number
        again.append(sorted({r["term"] for r in coded.filter(F.col("h").isin(*[r["h"] for r in shared])).collect()}))


def associations(records: DataFrame, least: int = 1, chunk: int = CHUNK, code: Coder = _code) -> DataFrame:
    """(src, term_a, term_b, n, n_a, n_b, n_ab, lift) of all pairs with n_ab >= least; term_a < term_b in byte order.

    lift = n_ab * n / (n_a * n_b). Items are counted under 64-bit numbers that differ for different items.
    """
    terms = cut(records.select("src", F.explode("items").alias("term")).groupBy("src", "term").agg(F.count(F.lit(1)).alias("n_term")))
    number = _coder(terms, code)
    hashed = records.select("src", "record", F.array_sort(F.transform("items", number)).alias("items"))
    pairs = pair_counts(hashed, chunk).filter(F.col("n_ab") >= least)
    names = terms.filter(F.col("n_term") >= least).select("src", number(F.col("term")).alias("h"), "term", "n_term")
    n = records.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    left = names.select("src", F.col("h").alias("a"), F.col("term").alias("t1"), F.col("n_term").alias("n1"))
    right = names.select("src", F.col("h").alias("b"), F.col("term").alias("t2"), F.col("n_term").alias("n2"))
    joined = pairs.join(left, ["src", "a"]).join(right, ["src", "b"]).join(F.broadcast(n), "src")  # one row per source
    swap = F.col("t1") > F.col("t2")
    out = joined.select(
        "src",
        F.least("t1", "t2").alias("term_a"),
        F.greatest("t1", "t2").alias("term_b"),
        "n",
        F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n_a"),
        F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n_b"),
        "n_ab",
    )
    return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
