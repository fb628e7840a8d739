"""Queries that compose operators into runs: bootstrap, learning, look-ups, validation, kept indexes, stores and adapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula.operators import bootstrap as b
from vocabula.operators import detect, docs, glossary
from vocabula.operators import items as it
from vocabula.operators import mapping as m
from vocabula.operators import prlearn as pr
from vocabula.plans import ingest, mapping, texts, views
from vocabula.plans.views import CONCEPTS_SQL, ITEMS_SQL, TERMS_SQL
from vocabula.session import checkpoint_folder, table
from vocabula.sources import registry, store


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# bootstrap ----------------------------------------------------------------------------------------------------------
def bootstrap_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = it.resolved(views.items(spark, sf_dir))
    run = b.run(views.concepts(spark, sf_dir), "concept_row", it.as_terms(i, "item_row"), dry_run=True)
    return run["terms"]


def bootstrap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adapter without terms: they are inferred from code."""
    i = it.resolved(views.items(spark, sf_dir)).limit(0)
    return b.run(views.concepts(spark, sf_dir), "concept_row", it.as_terms(i, "item_row"), dry_run=True)["terms"]


def bootstrap_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.run(views.concepts(spark, sf_dir), "concept_row", None, dry_run=True)["numbers"]


# learning -----------------------------------------------------------------------------------------------------------
def pr_learn_dry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.run_numbers(pr.learned(views.requests(spark, sf_dir), views.terms(spark, sf_dir)), dry_run=True)


# items --------------------------------------------------------------------------------------------------------------
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = it.resolved(views.items(spark, sf_dir))
    first = i.agg(F.min("id")).first()[0]
    return it.get_item(i, first).select("id", "title", "item_type", "status_category")


def project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    return it.get_project(i, i.agg(F.max("projectId")).first()[0])


def items_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = it.resolved(views.items(spark, sf_dir))
    return it.extracted(i, ["item_row"], types=["epic", "bug"], since="2025-03-01T00:00:00.000Z", most=50).select("id", "item_type", "updatedAt")


def items_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir).withColumn("priority", F.get_json_object("customFields", "$.priority"))
    return it.item_problems(i).select("id", "problems")


def schema_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference list as the schema of one database."""
    v = table(spark, sf_dir, "canonical_values").withColumn("kind", F.when(F.col("field") == "status", "status").otherwise("select"))
    lists = v.groupBy("field", "kind").agg(F.sort_array(F.collect_list("canonical")).alias("options"))
    entry = F.struct("field", F.struct(F.col("kind").alias("type"), "options"))
    return it.schema_terms(lists.agg(F.map_from_entries(F.collect_list(entry)).alias("properties")).withColumn("id", F.lit("work")))


def property_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = [("Title", "title"), ("Notes", "rich_text"), ("Kind", "select"), ("Phase", "status"), ("Labels", "multi_select"), ("Team", "select")]
    return spark.createDataFrame(sorted(it.property_roles(schema, {"category": "Group"}).items()), "role string, property string")


# glossary -----------------------------------------------------------------------------------------------------------
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the glossary, and of an empty one."""
    t = views.terms(spark, sf_dir)
    rows = [glossary.cold_start(x).select(F.lit(name).alias("store"), "cold_start", "message") for name, x in (("full", t), ("empty", t.limit(0)))]
    return rows[0].unionByName(rows[1])


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "store")
    t = views.terms(spark, sf_dir)
    store.write_parquet(t.limit(0), path)
    store.write_parquet(t, path)
    return store.read_parquet(spark, path).select("id", "name", "definition", "aliases", F.size("codeLocations").alias("locations"), F.col("coupling.score").alias("coupled"))


def postings_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a first run, as a second one reads them."""
    path = _place(spark, "postings")
    m.save_postings(m.postings(m.concept_tokens(views.concepts(spark, sf_dir))), path)
    return m.load_postings(spark, path)


# adapters -----------------------------------------------------------------------------------------------------------
def adapters_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listing(spark, *registry.built_in())


def adapters_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, scm = registry.built_in()
    items.register("memory", registry.memory_source([("a", "A")], "id string, title string"))
    rows = [registry.test_connection(spark, g, n, c) for g, n, c in ((items, "memory", {}), (items, "none", {}), (scm, "github", {}))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = registry.memory_source([(f"m{i}", f"Item {i}") for i in range(10)], "id string, title string")
    return it.page(source(spark), ["id"], 4, 3)


# detection in tool output -------------------------------------------------------------------------------------------
def _tool_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "affected_files").withColumns({"tool": F.get("relationships", F.lit(0)), "result": F.array_join("termNames", " ")})
    texts_ = detect.tool_texts(calls, "file_row", "tool", "filePath", "result", own="conf")
    return detect.matches(texts_, glossary.labels(views.terms(spark, sf_dir)), "key", "text")


def tool_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tool_found(spark, sf_dir).select("key", "term_id")


def tool_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that the texts of tools advise, by term."""
    return detect.advice(_tool_found(spark, sf_dir)).groupBy("term_id", "signal").agg(F.count(F.lit(1)).alias("n"))


# markdown -----------------------------------------------------------------------------------------------------------
def doc_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.term_rows(table(spark, sf_dir, "documents")).filter("method = 'bold'").select("doc_id", "term", "line")


# SQL ----------------------------------------------------------------------------------------------------------------
_INFERRED = ingest.ORACLE["infer_terms"]
_TOOL_HIT = f"""WITH {TERMS_SQL}, lab AS (SELECT DISTINCT id, lower(unnest(list_concat([name], aliases))) AS label FROM terms),
tx AS (SELECT file_row AS key, lower(filePath || ' ' || array_to_string(termNames, ' ')) AS text FROM affected_files WHERE NOT starts_with(coalesce(relationships[1], ''), 'conf')),
hit AS (SELECT DISTINCT t.key, l.id AS term_id FROM tx t JOIN lab l ON contains(t.text, l.label) AND regexp_replace(l.label, '[{views.SPACE_SQL}]', '', 'g') <> ''
  WHERE regexp_matches(t.text, '(^|[^a-z0-9_])' || regexp_escape(l.label) || '($|[^a-z0-9_])'))"""
QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_run, bootstrap_fallback, bootstrap_numbers, pr_learn_dry, item_lookup, project_lookup, items_extracted, items_valid, schema_terms, property_map, cold_start,
        store_roundtrip, postings_kept, adapters_list, adapters_status, memory_items, tool_terms, tool_advice, doc_bold,
    )
}
ORACLE = {
    "bootstrap_run": f"SELECT name, definition, 'adapter' AS term_source FROM ({ingest.ORACLE['items_terms']})",
    "bootstrap_fallback": f"SELECT name, definition, 'codebase-inferred' AS term_source FROM ({_INFERRED})",
    "bootstrap_numbers": f"WITH {CONCEPTS_SQL} SELECT 'concepts' AS measure, count(*) AS n FROM concepts UNION ALL SELECT 'terms:codebase-inferred', count(*) FROM ({_INFERRED})",
    "pr_learn_dry": f"SELECT 'would be ' || action AS action, count(*) AS names, sum(new_files)::BIGINT AS new_files FROM ({ingest.ORACLE['pr_merge']}) GROUP BY 1",
    "item_lookup": f"SELECT r.id, i.title, r.item_type, r.status_category FROM ({ingest.ORACLE['items_resolved']}) r JOIN (WITH {ITEMS_SQL} SELECT id, title FROM items) i USING (id) WHERE r.id = (SELECT min(id) FROM work_items)",
    "project_lookup": f"WITH {ITEMS_SQL} SELECT projectId, count(*) AS items, max(updatedAt) AS updated FROM items WHERE projectId = (SELECT max(projectId) FROM items) GROUP BY projectId",
    "items_extracted": f"""SELECT r.id, r.item_type, i.updatedAt FROM ({ingest.ORACLE['items_resolved']}) r JOIN (WITH {ITEMS_SQL} SELECT id, item_row, updatedAt FROM items) i USING (id)
        WHERE r.item_type IN ('epic', 'bug') AND i.updatedAt >= '2025-03-01T00:00:00.000Z' ORDER BY i.item_row LIMIT 50""",
    "items_valid": f"""WITH {ITEMS_SQL} SELECT id, list_filter([CASE WHEN NOT coalesce(regexp_full_match(id, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}'), false) THEN 'id' END,
        CASE WHEN NOT coalesce(type IN ('initiative', 'epic', 'story', 'task', 'subtask', 'bug', 'feature', 'milestone'), false) THEN 'type' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END,
        CASE WHEN NOT coalesce(status IN ('backlog', 'todo', 'in-progress', 'in-review', 'done', 'cancelled'), false) THEN 'status' END,
        CASE WHEN NOT coalesce(json_extract_string(CASE WHEN json_valid(customFields) THEN customFields END, '$.priority') IN ('critical', 'high', 'medium', 'low', 'none'), false) THEN 'priority' END,
        CASE WHEN url IS NOT NULL AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^ ]+$') THEN 'url' END,
        CASE WHEN NOT coalesce(regexp_matches(createdAt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?Z$'), false) THEN 'createdAt' END,
        CASE WHEN NOT coalesce(regexp_matches(updatedAt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?Z$'), false) THEN 'updatedAt' END], lambda x: x IS NOT NULL) AS problems FROM items""",
    "schema_terms": "SELECT 'work' AS database_id, canonical AS title, CASE field WHEN 'status' THEN 'status' ELSE 'label' END AS type, field AS property FROM canonical_values WHERE field IN ('status', 'type')",
    "property_map": "SELECT * FROM (VALUES ('title', 'Title'), ('description', 'Notes'), ('type', 'Kind'), ('status', 'Phase'), ('labels', 'Labels'), ('category', 'Group')) t(role, property)",
    "cold_start": "SELECT 'empty' AS store, true AS cold_start, 'The glossary has no terms yet.' AS message UNION ALL SELECT 'full', true, 'The glossary has no terms yet.' WHERE NOT EXISTS (SELECT 1 FROM glossary_terms)",
    "store_roundtrip": f"WITH {TERMS_SQL} SELECT id, name, definition, aliases, len(codeLocations)::INT AS locations, coupling.score AS coupled FROM terms",
    "adapters_list": "SELECT * FROM (VALUES ('pm', 'json', 'JSON import', false), ('pm', 'pages', 'Pages of a database', false), ('scm', 'github', 'Pull requests', false)) t(type, name, title, made)",
    "adapters_status": "SELECT * FROM (VALUES ('memory', true, 'connected'), ('none', false, 'there is no adapter none'), ('github', false, 'github needs path')) t(name, connected, message)",
    "memory_items": "SELECT 'm' || i AS id, 'Item ' || i AS title FROM range(4, 7) t(i)",
    "tool_terms": _TOOL_HIT + " SELECT key, term_id FROM hit",
    "tool_advice": _TOOL_HIT + " SELECT term_id, 'prompt' AS signal, count(*) AS n FROM hit GROUP BY term_id",
    "doc_bold": texts.ORACLE["doc_terms"].replace(texts.ORACLE["doc_terms"][len(texts._TERMS) :], " SELECT doc_id, term, line FROM kept WHERE method = 2"),
}


ORACLE["postings_kept"] = mapping.ORACLE["postings"]
# terms inferred from code, mapped as terms of a glossary are
_PREVIEW = mapping.ORACLE["mapping_topk"].replace(TERMS_SQL, f"terms AS (SELECT concept_id AS id, name, definition, aliases FROM ({_INFERRED}))")
ORACLE["bootstrap_preview"] = _PREVIEW[: _PREVIEW.rindex(" SELECT term_id")] + " SELECT t.name AS term_name, top.concept_id, max(top.confidence) AS confidence FROM top JOIN terms t ON t.id = top.term_id GROUP BY ALL"
