"""Work items and pull requests from JSON documents, and source corpora from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula.operators import items as it

ITEM = (
    "struct<id: string, title: string, description: string, type: string, status: string, labels: array<string>, assignees: array<string>, projectId: string, "
    "parentId: string, url: string, createdAt: string, updatedAt: string, customFields: string>"
)
IMPORT = f"organization string, projects array<struct<id: string, name: string, description: string, url: string, updatedAt: string, items: array<{ITEM}>>>, items array<{ITEM}>"
REQUEST = (
    "number bigint, title string, body string, url string, mergedAt string, labels array<string>, "
    "changedFiles array<struct<filename: string, status: string, additions: bigint, deletions: bigint, patch: string>>"
)


def work_items(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """Flat items with project, those within projects first; inline text beats a file. Rows without an id get numbers."""
    if text is not None:
        doc = spark.createDataFrame([(text,)], "json string").select(F.from_json("json", IMPORT).alias("d")).select("d.*")
    elif path is not None:
        doc = spark.read.schema(IMPORT).option("multiLine", True).json(path)
    else:
        raise ValueError("a path or a text is needed")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(doc.dtypes)[c]))
    doc = doc.withColumns({"projects": empty("projects"), "items": empty("items")})
    flat = it.flatten_import(doc).drop("projectId").withColumnRenamed("project_id", "projectId")
    empty_list = F.array().cast("array<string>")
    flat = flat.withColumns({"labels": F.coalesce("labels", empty_list), "assignees": F.coalesce("assignees", empty_list)})
    return it.numbered_ids(flat, ["group", "ord"])


def projects(items: DataFrame) -> DataFrame:
    """(projectId, name): the projects of flat items; items without one belong to `default`."""
    return items.groupBy("projectId").agg(F.coalesce(F.max("project_name"), F.col("projectId")).alias("name"))


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).option("multiLine", True).json(path)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path relative to the folder, length, content) of its files; what cannot be decoded has replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    inner = F.expr(f"substring(path, {len(full) + 1})")
    from vocabula.operators import scan

    # left out before their content is decoded
    return scan.discovered(files.withColumn("path", inner)).select("path", "length", F.decode("content", "UTF-8").alias("content"))
