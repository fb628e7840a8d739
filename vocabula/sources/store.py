"""Glossary stores: one JSON document with a map of terms, or Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCATION = "struct<filePath: string, symbol: string, lineRange: struct<start: int, end: int>, relationship: string, note: string>"
TERM = (
    f"struct<id: string, name: string, definition: string, aliases: array<string>, codeLocations: array<{LOCATION}>, category: string, tags: array<string>, "
    "source: struct<adapter: string, externalId: string, url: string>, confidence: string, "
    "coupling: struct<score: double, signals: bigint, sources: array<struct<type: string, count: bigint>>, lastSeen: string>, createdAt: string, updatedAt: string>"
)
STORE = f"version string, organization string, lastModified string, terms map<string, {TERM}>, _corrupt_record string"
VERSION = "1.0.0"


#: Terms that one JSON document may hold, and the name of the pointer to the current version.
MAX_DOCUMENT = 200_000
POINTER = "_CURRENT"


class StoreError(ValueError):
    """A store that cannot be read; `code` is PARSE_ERROR or VALIDATION_ERROR."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, organization: str = "default", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Terms and the one-row description (version, organization, lastModified). A missing path is an empty store."""
    if not _exists(spark, path):
        empty = spark.createDataFrame([], f"t {TERM}").select("t.*")
        return empty, spark.createDataFrame([(VERSION, organization, None)], "version string, organization string, lastModified string")
    doc = spark.read.schema(STORE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    meta = doc.select("version", "organization", "lastModified")
    if strict:
        broken = doc.filter("_corrupt_record IS NOT NULL").limit(1).count()
        if broken:
            raise StoreError("PARSE_ERROR", f"{path} is not a JSON document of a store")
        problems = [r["problem"] for r in problems_of(meta, doc).collect()]  # one document, so a handful
        if problems:
            raise StoreError("VALIDATION_ERROR", "; ".join(problems))
    return doc.select(F.explode("terms").alias("_key", "t")).select("t.*"), meta


def problems_of(meta: DataFrame, doc: DataFrame) -> DataFrame:
    """What is wrong with a store's frame: parts that are missing, and another major version."""
    major = F.split("version", r"\.")[0]
    rules = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("version", "organization", "lastModified", "terms")]
    rules.append(F.when(major != VERSION.split(".")[0], F.lit("the major version is not supported")))
    return doc.select(F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another in one step, so there is no moment without one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    how = getattr(jvm, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    jvm.FileContext.getFileContext(jvm.Path(target).toUri(), spark._jsc.hadoopConfiguration()).rename(jvm.Path(source), jvm.Path(target), options)


def write(terms: DataFrame, path: str, organization: str, now: str, most: int = MAX_DOCUMENT) -> None:
    """One JSON document, as other tools read it. It is staged and renamed over the old one in one step: readers see the old or the new.

    The document is one value in one task, so glossaries of more than `most` terms are refused; they belong in write_parquet().
    """
    spark = terms.sparkSession
    n = terms.count()
    if n > most:
        raise StoreError("TOO_LARGE", f"{n} terms are more than one document may hold ({most})")
    columns = [F.col(c) for c in terms.columns if c in _fields()]
    doc = terms.select(F.struct(*columns).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("t.id"), F.col("t")))).alias("terms"))
    out = doc.select(F.lit(VERSION).alias("version"), F.lit(organization).alias("organization"), F.lit(now).alias("lastModified"), "terms")
    stage = f"{path}.{uuid.uuid4().hex}"
    out.coalesce(1).write.json(stage)
    source = spark._jvm.org.apache.hadoop.fs.Path(stage)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-"))
    _replace(spark, part.toString(), path)
    fs.delete(source, True)


def _fields() -> set[str]:
    return set("id name definition aliases codeLocations category tags source confidence coupling createdAt updatedAt".split())


def write_parquet(terms: DataFrame, path: str) -> str:
    """A store of any size: a new version beside the others, then the pointer to it is renamed over the old one. Returns the version.

    Readers of the old version keep it; drop_versions() removes what the pointer does not name.
    """
    spark = terms.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    terms.write.parquet(f"{path}/{version}")
    stage = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}.{version}")
    out = stage.getFileSystem(spark._jsc.hadoopConfiguration()).create(stage, True)
    out.writeBytes(version)
    out.close()
    _replace(spark, stage.toString(), f"{path}/{POINTER}")
    return version


def _current(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(f"{path}/{_current(spark, path)}")


def drop_versions(spark: SparkSession, path: str) -> None:
    """Removes all versions but the current one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, kept = root.getFileSystem(spark._jsc.hadoopConfiguration()), _current(spark, path)
    for x in fs.listStatus(root):
        if x.getPath().getName().startswith("v-") and x.getPath().getName() != kept:
            fs.delete(x.getPath(), True)
