"""Queries on work items, pull requests and inferred terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import bootstrap as b
from vocabula.operators import items as it
from vocabula.operators import prlearn as pr
from vocabula.plans import views
from vocabula.plans.views import CONCEPTS_SQL, ITEMS_SQL, REQUESTS_SQL, TERMS_SQL
from vocabula.plans.views import SPACE_SQL as SP


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.resolved(views.items(spark, sf_dir))


def items_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", "item_type", "item_kind", "status_category", it.page_kind(F.col("kind")).alias("page_kind"), it.status_category(F.coalesce("status", F.lit("")), d.PAGE_STATUS).alias("page_status"))


def items_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.listed(_items(spark, sf_dir), category="done", labels=["backend", "frontend"], since="2025-01-01T00:00:00.000Z", text="plan").select("id", "title", "updatedAt")


def items_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.page(_items(spark, sf_dir), ["item_row"], 100, 100).select("id", "title")


def items_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.as_terms(_items(spark, sf_dir), "item_row")


def items_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    return it.extraction_statistics(i, it.as_terms(i, "item_row"))


def item_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.term_candidates(_items(spark, sf_dir), "item_row")


def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.custom_fields(views.items(spark, sf_dir)).select(F.col("key").alias("id"), "name", "tag")


def items_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).groupBy("projectId").agg(F.count(F.lit(1)).alias("items"), F.max("updatedAt").alias("updated"))


def pr_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.candidate_terms(views.requests(spark, sf_dir))


def pr_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.locations(views.requests(spark, sf_dir))


def pr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.learned(views.requests(spark, sf_dir), views.terms(spark, sf_dir))


def pr_merge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.merged_locations(views.requests(spark, sf_dir), views.terms(spark, sf_dir)).select("name_key", "filePath", "relationship")


def infer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.inferred_terms(views.concepts(spark, sf_dir), "concept_row")


def bootstrap_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.preview(views.concepts(spark, sf_dir), "concept_row")


# SQL ----------------------------------------------------------------------------------------------------------------
def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in table.items()) + f" ELSE '{default}' END"


def _trim(s: str) -> str:
    return f"regexp_replace({s}, '^[{SP}]+|[{SP}]+$', '', 'g')"


_list = lambda xs: "[" + ", ".join(_quote(x) for x in xs) + "]"
_RES = f"""{ITEMS_SQL}, res AS (SELECT *, {_map(_trim("lower(type)"), d.ITEM_TYPES, "task")} AS item_type, {_map(_trim("lower(coalesce(status, ''))"), d.ITEM_STATUS, "unknown")} AS status_category,
  coalesce(status, '') AS status_label, {_map(_trim("lower(kind)"), d.PAGE_KINDS, "page")} AS page_kind, {_map(_trim("lower(coalesce(status, ''))"), d.PAGE_STATUS, "unknown")} AS page_status FROM items)"""
_ITERMS = f"""iterms AS (SELECT {_trim("lower(title)")} AS key, item_row, {_trim("title")} AS name,
  CASE WHEN coalesce(description, '') = '' THEN upper(left(item_type, 1)) || substr(item_type, 2) || ' from JSON import' || CASE WHEN coalesce(projectId, '') <> '' THEN ' in project "' || projectId || '"' ELSE '' END
    || CASE WHEN status_label <> '' THEN ' (status: ' || status_label || ')' ELSE '' END || '.' WHEN length(description) > 500 THEN left(description, 500) || '...' ELSE description END AS definition,
  projectId AS category, list_concat(labels, [item_type, 'json-import'], CASE WHEN status_label <> '' THEN ['status:' || regexp_replace(lower(status_label), '[{SP}]+', '-', 'g')] ELSE [] END) AS t0, id AS externalId, url
  FROM res WHERE {_trim("title")} <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY item_row) = 1)"""
_META = " OR ".join(f"contains(lower(name), {_quote(m)})" for m in d.META_HEADINGS)
_PR = f"""{REQUESTS_SQL}, pt0 AS (SELECT number, -1 AS ord, {_trim(f"regexp_replace(regexp_replace(coalesce(title, ''), '{d.COMMIT_PREFIX}', ''), '^\\[.+?\\]\\s*', '')")} AS name FROM requests
  UNION ALL SELECT number, ord, name FROM (SELECT number, (k - 1)::INT AS ord, {_trim("regexp_extract(l[k], '^##[ \\t\\r]+(.+)', 1)")} AS name FROM (SELECT number, l, unnest(generate_series(1, len(l))) AS k FROM (SELECT number, string_split(coalesce(body, ''), chr(10)) AS l FROM requests))
    WHERE regexp_matches(l[k], '^##[ \\t\\r]+[^ ]')) WHERE NOT ({_META})),
pt AS (SELECT * FROM pt0 WHERE length(name) > 3),
pf AS (SELECT number, (k - 1)::INT AS ord, f[k].filename AS filePath, f[k].status AS status, 'From PR: ' || f[k].additions || ' additions, ' || f[k].deletions || ' deletions' AS note
  FROM (SELECT number, changedFiles AS f, unnest(generate_series(1, len(changedFiles))) AS k FROM requests)),
pl AS (SELECT number, ord, filePath, CASE WHEN contains(filePath, 'test') OR contains(filePath, 'spec') THEN 'tests' WHEN contains(filePath, 'config') THEN 'configures' WHEN status = 'added' THEN 'defines' ELSE 'implements' END AS relationship, note
  FROM pf WHERE coalesce(status, '') <> 'removed' AND len(list_filter({_list(d.CODE_EXTENSIONS)}, lambda e: ends_with(filePath, e))) > 0),
names AS (SELECT lower(name) AS name_key, name, number, ord FROM pt),
known AS (SELECT lower(name) AS name_key, arg_min(id, id) AS term_id, arg_min(codeLocations, id) AS have FROM terms GROUP BY 1),
had AS (SELECT DISTINCT name_key, x.filePath AS filePath FROM (SELECT name_key, unnest(have) AS x FROM known)),
files AS (SELECT DISTINCT name_key, filePath FROM names JOIN pl USING (number)),
fresh AS (SELECT name_key, count(*) AS new_files FROM files f WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.name_key = f.name_key AND h.filePath = f.filePath) GROUP BY 1)"""
_human = "array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g'), '[" + SP + "]+'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ')"

QUERIES = {
    f.__name__: f
    for f in (items_resolved, items_filter, items_page, items_terms, items_stats, item_candidates, item_fields, items_projects, pr_terms, pr_locations, pr_merge, pr_merge_files, infer_terms, bootstrap_preview)
}
ORACLE = {
    "items_resolved": f"WITH {_RES} SELECT id, item_type, {_map('item_type', d.TYPE_KIND, 'other')} AS item_kind, status_category, page_kind, page_status FROM res",
    "items_filter": f"WITH {_RES} SELECT id, title, updatedAt FROM res WHERE status_category = 'done' AND list_has_any(labels, ['backend', 'frontend']) AND updatedAt >= '2025-01-01T00:00:00.000Z' AND (contains(lower(title), 'plan') OR coalesce(contains(lower(description), 'plan'), false))",
    "items_page": f"WITH {ITEMS_SQL} SELECT id, title FROM items ORDER BY item_row LIMIT 100 OFFSET 100",
    "items_terms": f"WITH {_RES}, {_ITERMS} SELECT name, definition, category, list_filter(t0, lambda x, i: list_position(t0, x) = i) AS tags, externalId, url FROM iterms",
    "items_stats": f"""WITH {_RES}, {_ITERMS} SELECT 'type:' || item_type AS measure, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'items', count(*) FROM res UNION ALL SELECT 'terms', count(*) FROM iterms
        UNION ALL SELECT 'skipped', (SELECT count(*) FROM res) - (SELECT count(*) FROM iterms)""",
    "item_candidates": f"""WITH RECURSIVE {_RES}, t AS (SELECT projectId, {_trim("lower(title)")} AS key, {_trim("title")} AS term, id, item_row, coalesce(description, '') AS text, item_type || ' in ' || coalesce(projectId, 'unknown project') AS made,
          row_number() OVER (PARTITION BY projectId, key ORDER BY item_row) AS n FROM res WHERE {_trim("title")} <> ''),
        f AS (SELECT projectId, key, n, term, CASE WHEN text = '' THEN made ELSE left(text, 200) END AS context FROM t WHERE n = 1
          UNION ALL SELECT f.projectId, f.key, t.n, f.term, CASE WHEN length(t.text) > length(f.context) THEN left(t.text, 200) ELSE f.context END FROM f JOIN t ON t.projectId IS NOT DISTINCT FROM f.projectId AND t.key = f.key AND t.n = f.n + 1),
        c AS (SELECT projectId, key, count(*) AS frequency, count(DISTINCT id) AS n_items FROM t GROUP BY ALL)
        SELECT c.projectId, f.term, c.frequency, c.n_items, f.context FROM c JOIN f ON f.projectId IS NOT DISTINCT FROM c.projectId AND f.key = c.key AND f.n = c.frequency""",
    "item_fields": f"""WITH {ITEMS_SQL}, k AS (SELECT id, customFields AS j, unnest(json_keys(customFields)) AS name FROM items WHERE json_valid(customFields)),
        v AS (SELECT id, name, json_extract(j, '$."' || name || '"') AS v FROM k)
        SELECT id, name, CASE WHEN json_type(v) = 'VARCHAR' THEN 'string' WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN json_type(v) = 'BOOLEAN' THEN 'boolean'
          WHEN json_type(v) = 'ARRAY' AND len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN 'multi_select' ELSE 'unknown' END AS tag FROM v""",
    "items_projects": f"WITH {ITEMS_SQL} SELECT projectId, count(*) AS items, max(updatedAt) AS updated FROM items GROUP BY 1",
    "pr_terms": f"WITH {TERMS_SQL}, {_PR} SELECT number, ord, name FROM pt",
    "pr_locations": f"WITH {TERMS_SQL}, {_PR} SELECT number, ord, filePath, relationship, note FROM pl",
    "pr_merge": f"""WITH {TERMS_SQL}, {_PR} SELECT n.name_key, arg_min(n.name, (n.number, n.ord)) AS name, CASE WHEN any_value(k.term_id) IS NULL THEN 'created' ELSE 'updated' END AS action, any_value(k.term_id) AS term_id,
        coalesce(any_value(f.new_files), 0) AS new_files, count(DISTINCT n.number) AS requests FROM names n LEFT JOIN known k USING (name_key) LEFT JOIN fresh f USING (name_key) GROUP BY n.name_key""",
    "pr_merge_files": f"""WITH {TERMS_SQL}, {_PR} SELECT name_key, filePath, arg_max(relationship, (number, ord)) AS relationship FROM (SELECT DISTINCT n.name_key, n.number, l.ord, l.filePath, l.relationship FROM names n JOIN pl l USING (number)) x
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT lower(name) AS nk, unnest(codeLocations) AS c FROM terms) y WHERE y.nk = x.name_key AND y.c.filePath = x.filePath) GROUP BY name_key, filePath""",
    "infer_terms": f"""WITH {CONCEPTS_SQL}, w AS (SELECT *, {_human} AS human, {_map("kind", {k: f"{v:02d}" for k, v in d.KIND_ORDER.items()}, "99")} AS ko FROM concepts WHERE CASE WHEN kind IN ('class', 'interface', 'enum') THEN exported
          WHEN kind = 'module' THEN exported AND lower(name) NOT IN ({", ".join(map(_quote, d.GENERIC_MODULES))}) WHEN kind = 'directory' THEN lower(name) NOT IN ({", ".join(map(_quote, d.GENERIC_DIRECTORIES))})
          WHEN kind = 'function' THEN exported AND length(name) > 3 WHEN kind IN ('namespace', 'term', 'definition') THEN true WHEN kind = 'section' THEN lower(name) NOT IN ({", ".join(map(_quote, d.GENERIC_SECTIONS))}) ELSE false END),
        o AS (SELECT *, {_trim("lower(name)")} AS key, string_split(human, ' ') AS hw FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY ko, concept_row) = 1)
        SELECT key, id AS concept_id, human AS name, CASE WHEN length(description) > 10 THEN description ELSE upper(left(kind, 1)) || substr(kind, 2) || ' "' || name || '" found in ' || filePath || '. This term was auto-discovered during codebase bootstrap and may represent an organizational concept.' END AS definition,
          list_filter([CASE WHEN name <> human AND name <> regexp_replace(human, '[{SP}]', '', 'g') THEN name END, CASE WHEN len(hw) BETWEEN 2 AND 5 THEN array_to_string(list_transform(hw, lambda x: upper(left(x, 1))), '') END], lambda x: x IS NOT NULL) AS aliases,
          list_filter(string_split(filePath, '/'), lambda x: x <> '' AND NOT contains(x, '.') AND NOT list_contains({_list(d.NON_DOMAIN_DIRECTORIES)}, lower(x)))[1] AS category, [kind, language, 'bootstrap'] AS tags FROM o""",
}
