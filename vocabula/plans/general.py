"""Queries of the general training-data problems (3, 4 and 7) over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula.operators import hierarchy as tree_ops
from vocabula.operators import nested
from vocabula.operators import orphans as orphan_ops
from vocabula.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    ref = orphan_ops.references
    refs = (
        ref(t("usage_signals"), "usage_signals", "term", "event_id", "termIds", "ts", many=True)
        .unionByName(ref(t("affected_files"), "affected_files", "term", "file_row", "termIds", "analyzedAt", many=True))
        .unionByName(ref(t("term_enrichments"), "term_enrichments", "term", "enrichment_id", "termId", "savedAt"))
        .unionByName(ref(t("code_concepts"), "code_concepts", "concept", "concept_row", "parentId", "scannedAt"))
    )
    alive = orphan_ops.lifetimes(t("glossary_terms"), "term", "id", "arrivedAt", "deletedAt").unionByName(
        orphan_ops.lifetimes(t("code_concepts"), "concept", "id", "scannedAt", "removedAt")
    )
    return orphan_ops.orphans(refs, alive)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("src", "row_key", "ref_key")


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_ops.orphan_counts(_orphans(spark, sf_dir))


_P3_SQL = """
WITH refs AS (
  SELECT 'usage_signals' AS src, 'term' AS space, event_id AS row_key, unnest(termIds) AS ref_key, ts AS at FROM usage_signals
  UNION ALL SELECT 'affected_files', 'term', file_row, unnest(termIds), analyzedAt FROM affected_files
  UNION ALL SELECT 'term_enrichments', 'term', enrichment_id, termId, savedAt FROM term_enrichments
  UNION ALL SELECT 'code_concepts', 'concept', concept_row, parentId, scannedAt FROM code_concepts),
alive AS (
  SELECT 'term' AS space, id AS ref_key, min(arrivedAt) AS since, max(deletedAt) AS until FROM glossary_terms GROUP BY id
  UNION ALL SELECT 'concept', id, min(scannedAt), max(removedAt) FROM code_concepts GROUP BY id),
found AS (
  SELECT DISTINCT r.src, r.row_key, r.ref_key, strftime(r.at, '%Y-%m') AS period
  FROM refs r LEFT JOIN alive a ON a.space = r.space AND a.ref_key = r.ref_key
  WHERE trim(r.ref_key) <> '' AND (a.since IS NULL OR r.at < a.since OR r.at >= a.until))
"""

#: List -> name of its children and key of the object that holds it.
LISTS = {"aliases": ("alias", "id"), "codeLocations": ("codeLocation", "id"), "changedFiles": ("changedFile", "number")}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested.flatten(table(spark, sf_dir, "raw_records"), "record_id", "payload", LISTS)
    return flat.select("record_id", "parent_key", "child", "ord").distinct()


def p4_raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files and code locations of raw records, with their fields."""
    flat = nested.flatten(table(spark, sf_dir, "raw_records"), "record_id", "payload", LISTS).filter("child <> 'alias'")
    get = lambda *names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names])
    return flat.select("record_id", "parent_key", "child", "ord", get("filePath", "filename").alias("file"), get("relationship", "status").alias("role"), get("lineRange.start").alias("first_line")).distinct()


def p4_term_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.explode_list(table(spark, sf_dir, "glossary_terms"), ["row_id", "id"], "codeLocations")
    return rows.select("row_id", "id", "ord", "filePath", "symbol", F.col("lineRange.start").alias("first_line"), F.col("lineRange.end").alias("last_line"), "relationship", "note")


def p4_term_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.explode_list(table(spark, sf_dir, "glossary_terms"), ["row_id", "id"], "aliases").withColumnRenamed("value", "alias")


def p4_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request may have been fetched twice: its files are counted once."""
    return nested.explode_list(table(spark, sf_dir, "pull_requests"), ["number"], "changedFiles").distinct()


def _tree(spark: SparkSession, sf_dir: str, with_path: bool) -> DataFrame:
    links = tree_ops.links(table(spark, sf_dir, "work_items"), "work_items", "id", "parentId").unionByName(
        tree_ops.links(table(spark, sf_dir, "code_concepts"), "code_concepts", "id", "parentId")
    )
    return tree_ops.hierarchy(links, with_path)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, False).select("src", "node_id", "root_id", "depth")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, True)


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_ops.descendants(_tree(spark, sf_dir, True))


_P7_SQL = """
WITH RECURSIVE given AS (
  SELECT 'work_items' AS src, id, max(CASE WHEN trim(parentId) <> '' THEN parentId END) AS parent FROM work_items GROUP BY id
  UNION ALL SELECT 'code_concepts', id, max(CASE WHEN trim(parentId) <> '' THEN parentId END) FROM code_concepts GROUP BY id),
linked AS (SELECT g.src, g.id, p.id AS parent FROM given g LEFT JOIN given p ON p.src = g.src AND p.id = g.parent),
tree AS (
  SELECT src, id AS node_id, id AS root_id, 0::BIGINT AS depth, [id] AS path FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.src, l.id, t.root_id, t.depth + 1, list_append(t.path, l.id) FROM tree t JOIN linked l ON l.src = t.src AND l.parent = t.node_id),
flat AS (SELECT src, node_id, depth, unnest(path) AS ancestor_id, generate_subscripts(path, 1) - 1 AS place FROM tree),
below AS (SELECT src, ancestor_id AS node_id, count(*) - 1 AS descendants FROM flat GROUP BY src, ancestor_id)
"""

#: Every object and list of a payload at any depth, JSON carried as text included.
_P4_SQL = """
WITH RECURSIVE node AS (
  SELECT record_id, ('[' || payload || ']')::JSON AS j FROM raw_records WHERE json_valid(payload)
  UNION ALL
  SELECT record_id, CASE WHEN json_type(c) = 'VARCHAR' THEN (c->>'$')::JSON ELSE c END FROM (
    SELECT record_id, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1'))) ELSE json_extract(j, '$[*]') END) AS c
    FROM node WHERE json_type(j) IN ('OBJECT', 'ARRAY'))
  WHERE json_type(c) IN ('OBJECT', 'ARRAY') OR (json_type(c) = 'VARCHAR' AND regexp_matches(c->>'$', '^\\s*[\\[{"]') AND json_valid(c->>'$'))),
held AS (
  SELECT record_id, j->>'$.id' AS parent_key, 'alias' AS child, j->'$.aliases' AS v FROM node WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT record_id, j->>'$.id', 'codeLocation', j->'$.codeLocations' FROM node WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT record_id, j->>'$.number', 'changedFile', j->'$.changedFiles' FROM node WHERE json_type(j) = 'OBJECT'),
opened AS (SELECT * REPLACE (CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') AND json_type((v->>'$')::JSON) = 'ARRAY' THEN (v->>'$')::JSON ELSE v END AS v) FROM held WHERE v IS NOT NULL),
listed AS (SELECT record_id, parent_key, child, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS items FROM opened),
flat AS (SELECT record_id, parent_key, child, k - 1 AS ord, items[k] AS item FROM (SELECT *, unnest(generate_series(1, len(items))) AS k FROM listed))
"""

_P4_TERMS = "SELECT row_id, id, unnest(generate_series(1, len({0}))) AS k, {0} AS items FROM glossary_terms WHERE {0} IS NOT NULL"

QUERIES = {
    "p3_found": p3_found,
    "p3_periods": p3_periods,
    "p4_found": p4_found,
    "p4_raw_files": p4_raw_files,
    "p4_term_locations": p4_term_locations,
    "p4_term_aliases": p4_term_aliases,
    "p4_changed_files": p4_changed_files,
    "p7_found": p7_found,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
}
ORACLE = {
    "p3_found": _P3_SQL + "SELECT src, row_key, ref_key FROM found",
    "p3_periods": _P3_SQL + "SELECT src, period, count(*) AS orphans, count(DISTINCT ref_key) AS missing_keys FROM found GROUP BY src, period",
    "p4_found": _P4_SQL + "SELECT DISTINCT record_id, parent_key, child, ord FROM flat WHERE item IS NOT NULL AND json_type(item) <> 'NULL'",
    "p4_raw_files": _P4_SQL
    + """SELECT DISTINCT record_id, parent_key, child, ord, coalesce(item->>'$.filePath', item->>'$.filename') AS file, coalesce(item->>'$.relationship', item->>'$.status') AS role,
        item->>'$.lineRange.start' AS first_line FROM flat WHERE item IS NOT NULL AND json_type(item) <> 'NULL' AND child <> 'alias'""",
    "p4_term_locations": f"""SELECT row_id, id, (k - 1)::BIGINT AS ord, items[k].filePath AS filePath, items[k].symbol AS symbol,
        items[k].lineRange.start AS first_line, items[k].lineRange."end" AS last_line, items[k].relationship AS relationship, items[k].note AS note
        FROM ({_P4_TERMS.format("codeLocations")}) WHERE items[k] IS NOT NULL""",
    "p4_term_aliases": f"""SELECT row_id, id, (k - 1)::BIGINT AS ord, items[k] AS alias FROM ({_P4_TERMS.format("aliases")}) WHERE items[k] IS NOT NULL""",
    "p4_changed_files": """SELECT DISTINCT number, (k - 1)::BIGINT AS ord, items[k].filename AS filename, items[k].status AS status, items[k].additions AS additions,
        items[k].deletions AS deletions, items[k].patch AS patch
        FROM (SELECT number, unnest(generate_series(1, len(changedFiles))) AS k, changedFiles AS items FROM pull_requests WHERE changedFiles IS NOT NULL) WHERE items[k] IS NOT NULL""",
    "p7_found": _P7_SQL
    + """SELECT g.src, g.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth
        FROM given g LEFT JOIN tree t ON t.src = g.src AND t.node_id = g.id""",
    "p7_paths": _P7_SQL
    + """SELECT g.src, g.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1) AS depth, b.descendants, t.path
        FROM given g LEFT JOIN tree t ON t.src = g.src AND t.node_id = g.id LEFT JOIN below b ON b.src = g.src AND b.node_id = g.id""",
    "p7_descendants": _P7_SQL + "SELECT src, ancestor_id, node_id AS descendant_id, depth - place AS distance FROM flat WHERE place < depth",
}
