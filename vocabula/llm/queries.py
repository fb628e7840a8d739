"""Queries of the training-data problems over the standard tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from vocabula.llm import canonical, cooccurrence, frequency, keyword_spam, leaks, packing, value_mapping
from vocabula.session import table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# 1 ------------------------------------------------------------------------------------------------------------------
def _p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.records(table(spark, sf_dir, "glossary_terms"), "glossary_terms", "row_id", "name", "aliases").unionByName(
        canonical.records(table(spark, sf_dir, "learned_terms"), "learned_terms", "learned_id", "name")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.duplicates(_p1_records(spark, sf_dir)).select("src", "keep_id", "dup_id")


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.distinct_records(_p1_records(spark, sf_dir))


_P1_SQL = r"""
WITH forms AS (
  SELECT 'glossary_terms' AS src, row_id AS id, regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g') AS name,
    list_sort(list_distinct(list_transform(coalesce(aliases, []), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')))) AS al
  FROM glossary_terms
  UNION ALL SELECT 'learned_terms', learned_id, regexp_replace(lower(name), '[^\p{L}\p{N}]+', '', 'g'), [] FROM learned_terms),
groups AS (SELECT src, name, al, min(id) AS keep_id, count(*) AS copies FROM forms GROUP BY src, name, al)
"""


# 2 ------------------------------------------------------------------------------------------------------------------
def _p2(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    baskets = cooccurrence.baskets(table(spark, sf_dir, "usage_signals"), "usage_signals", "event_id", "termIds").unionByName(
        cooccurrence.baskets(table(spark, sf_dir, "affected_files"), "affected_files", "file_row", "termIds")
    )
    return cooccurrence.associations(baskets, least)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _p2(spark, sf_dir, 8)
    return a.filter("n_ab * n >= 4 * n_a * n_b").select("src", "term_a", "term_b")


def p2_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least two records, with their counts and lift."""
    return _p2(spark, sf_dir, 2)


_P2_SQL = """
WITH items AS (
  SELECT DISTINCT 'usage_signals' AS src, event_id AS rec, unnest(termIds) AS term FROM usage_signals
  UNION SELECT DISTINCT 'affected_files', file_row, unnest(termIds) FROM affected_files),
kept AS (SELECT * FROM items WHERE term IS NOT NULL),
one AS (SELECT src, term, count(*) AS n FROM kept GROUP BY src, term),
total AS (SELECT src, count(DISTINCT rec) AS n FROM kept GROUP BY src),
pairs AS (
  SELECT a.src, a.term AS term_a, b.term AS term_b, count(*) AS n_ab
  FROM kept a JOIN kept b ON a.src = b.src AND a.rec = b.rec AND a.term < b.term GROUP BY ALL),
scored AS (
  SELECT p.src, p.term_a, p.term_b, t.n, a.n AS n_a, b.n AS n_b, p.n_ab, p.n_ab * t.n / (a.n::DOUBLE * b.n) AS lift
  FROM pairs p JOIN one a ON a.src = p.src AND a.term = p.term_a JOIN one b ON b.src = p.src AND b.term = p.term_b
  JOIN total t ON t.src = p.src)
"""


# 5 ------------------------------------------------------------------------------------------------------------------
def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _union(
        [
            frequency.rows(table(spark, sf_dir, "usage_signals"), "usage_signals", "event_id", "query"),
            frequency.rows(table(spark, sf_dir, "term_enrichments"), "term_enrichments", "enrichment_id", "queryPatterns", many=True),
            frequency.rows(table(spark, sf_dir, "work_items"), "work_items", "id", "labels", many=True),
        ]
    )
    return frequency.marked(frequency.frequencies(rows))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).filter("mark IS NOT NULL").select("src", "value", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).select("src", "value", "occurrences", "records", "mark")


_P5_SQL = """
WITH occ AS (
  SELECT 'usage_signals' AS src, event_id::VARCHAR AS rec, query AS value FROM usage_signals
  UNION ALL SELECT 'term_enrichments', enrichment_id::VARCHAR, unnest(queryPatterns) FROM term_enrichments
  UNION ALL SELECT 'work_items', id, unnest(labels) FROM work_items),
kept AS (SELECT * FROM occ WHERE value IS NOT NULL AND value <> ''),
total AS (SELECT src, count(DISTINCT rec) AS n FROM kept GROUP BY src),
counts AS (SELECT src, value, count(*) AS occurrences, count(DISTINCT rec) AS records FROM kept GROUP BY src, value),
marked AS (
  SELECT c.*, CASE WHEN records = 1 THEN 'rare' WHEN records * 50 > t.n THEN 'common' END AS mark
  FROM counts c JOIN total t USING (src))
"""


# 6 ------------------------------------------------------------------------------------------------------------------
FIELDS = ["status", "type", "kind"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = value_mapping.cells(table(spark, sf_dir, "work_items"), "item_row", FIELDS)
    return value_mapping.assign(cells, table(spark, sf_dir, "canonical_values")).withColumnRenamed("key", "item_row").distinct()


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct typed value with its entry, or reported as unmatched."""
    cells = value_mapping.cells(table(spark, sf_dir, "work_items"), "item_row", FIELDS)
    return value_mapping.decide(cells, table(spark, sf_dir, "canonical_values"))


# 8 ------------------------------------------------------------------------------------------------------------------
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = [r["capacity"] for r in table(spark, sf_dir, "pack_sizes").select("capacity").distinct().collect()]
    return packing.containers(table(spark, sf_dir, "documents"), capacities)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir))


# 9 ------------------------------------------------------------------------------------------------------------------
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# 10 -----------------------------------------------------------------------------------------------------------------
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_spam.spam(table(spark, sf_dir, "documents"), lang="lang").distinct()


#: Cleaning, numbered tokens and Jaccard of every distinct value with every spelling of its field.
_P6_SQL = r"""
WITH cell AS (
  SELECT item_row, 'status' AS field, status AS raw FROM work_items UNION ALL SELECT item_row, 'type', type FROM work_items UNION ALL SELECT item_row, 'kind', kind FROM work_items),
kept AS (SELECT * FROM cell c WHERE regexp_replace(coalesce(raw, ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '', 'g') <> ''
  AND NOT EXISTS (SELECT 1 FROM canonical_values v WHERE v.field = c.field AND v.canonical = c.raw)),
s0 AS (SELECT field, raw, trim(regexp_replace(raw, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS t FROM (SELECT DISTINCT field, raw FROM kept)),
s1 AS (SELECT field, raw, regexp_replace(t, '([\p{L}\p{N}])[^\p{L}\p{N}]{0,4}\([^()]*\)\s*$', '\1') AS t FROM s0),
s2 AS (SELECT field, raw, regexp_replace(regexp_replace(t, '(?i)\s*,\s*says\s.*$', ''), '(?i)\s+(as\s+of|since)\s+.*$', '') AS t FROM s1),
s3 AS (SELECT field, raw, regexp_replace(regexp_replace(t, '\s*/\s*[A-Za-z]{2,4}-[0-9]+\s*$', ''), '([\p{L}\p{N}])[^\p{L}\p{N}]+[0-9]+[^\p{L}\p{N}]*$', '\1') AS t FROM s2),
s4 AS (SELECT field, raw, regexp_replace(t, '^[^\p{L}\p{N}]*[0-9]+[^\p{L}\p{N}]+(.*\p{L})', '\1') AS t FROM s3),
s5 AS (SELECT field, raw, regexp_replace(regexp_replace(t, '(?i)^[^\p{L}\p{N}]*(status|type|kind)\s*:\s*', ''), '(?i)^[^\p{L}\p{N}]*now\s+', '') AS t FROM s4),
val AS (SELECT field, raw, regexp_replace(lower(regexp_replace(t, '^\s*[A-Z]{2,4}:\s*', '')), '[^\p{L}\p{N}]+', '', 'g') AS value FROM s5),
form AS (SELECT DISTINCT value_id, field, regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') AS form FROM (SELECT value_id, field, unnest(list_prepend(canonical, coalesce(alternates, []))) AS w FROM canonical_values)),
spelt AS (SELECT DISTINCT value_id, field, form, spelling FROM (SELECT *, unnest([form, left(form, 1) || regexp_replace(form[2:], '[aeiou]', '', 'g'), regexp_replace(form, '[aeiou]', '', 'g')]) AS spelling FROM form) WHERE form <> '' AND (spelling = form OR length(spelling) > 1)),
word AS (SELECT DISTINCT value AS w FROM val WHERE value <> '' UNION SELECT spelling FROM spelt),
tok AS (SELECT w, unnest(list_concat(string_split(w, ''), list_transform(range(0, length(w) + 1), lambda i: ('<' || w || '>')[i + 1 : i + 2]), list_transform(range(1, length(w) - 1), lambda i: w[i] || w[i + 2]))) AS t FROM word),
bag AS (SELECT w, t, count(*) AS n FROM tok GROUP BY w, t),
size AS (SELECT w, sum(n) AS n FROM bag GROUP BY w),
pair AS (SELECT v.field, v.value, s.value_id, s.form, s.spelling FROM (SELECT DISTINCT field, value FROM val WHERE value <> '') v JOIN spelt s USING (field)),
shared AS (SELECT a.w AS value, b.w AS spelling, sum(least(a.n, b.n)) AS n FROM bag a JOIN bag b USING (t) WHERE b.w IN (SELECT spelling FROM spelt) GROUP BY ALL),
scored AS (SELECT p.*, h.n / (x.n + y.n - h.n) AS jaccard FROM pair p JOIN shared h USING (value, spelling) JOIN size x ON x.w = p.value JOIN size y ON y.w = p.spelling),
best AS (SELECT field, value, value_id, form, jaccard FROM scored WHERE jaccard >= 0.4 QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY jaccard DESC, value_id, form) = 1)
"""

_P9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS k FROM d)),
ig AS (SELECT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS k FROM i))
"""

QUERIES = {"p1_found": p1_found, "p1_copies": p1_copies, "p2_found": p2_found, "p2_lift": p2_lift, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_values": p6_values, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found}
ORACLE = {
    "p6_found": _P6_SQL + "SELECT DISTINCT k.item_row, k.field, coalesce(b.value_id, -1)::BIGINT AS value_id FROM kept k JOIN val v USING (field, raw) LEFT JOIN best b USING (field, value)",
    "p6_values": _P6_SQL
    + """SELECT k.field, k.raw, count(*) AS rows, coalesce(any_value(b.value_id), -1)::BIGINT AS value_id, any_value(b.form) AS form, any_value(b.jaccard) AS jaccard
        FROM kept k JOIN val v USING (field, raw) LEFT JOIN best b USING (field, value) GROUP BY k.field, k.raw""",
    "p9_found": _P9_SQL + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p1_found": _P1_SQL + "SELECT f.src, g.keep_id, f.id AS dup_id FROM forms f JOIN groups g USING (src, name, al) WHERE f.id <> g.keep_id",
    "p1_copies": _P1_SQL + "SELECT src, keep_id, copies FROM groups",
    "p2_found": _P2_SQL + "SELECT src, term_a, term_b FROM scored WHERE n_ab >= 8 AND n_ab * n >= 4 * n_a * n_b",
    "p2_lift": _P2_SQL + "SELECT src, term_a, term_b, n, n_a, n_b, n_ab, lift FROM scored WHERE n_ab >= 2",
    "p5_found": _P5_SQL + "SELECT src, value, mark FROM marked WHERE mark IS NOT NULL",
    "p5_counts": _P5_SQL + "SELECT src, value, occurrences, records, mark FROM marked",
}
