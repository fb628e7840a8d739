"""Queries on texts: markdown terms, source scans, work items from free text, label detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula import patterns as p
from vocabula.operators import detect, docs, glossary, scan
from vocabula.operators import textparse as tp
from vocabula.plans import views
from vocabula.plans.views import CONCEPTS_SQL, ITEMS_SQL, TERMS_SQL
from vocabula.session import table


# markdown -----------------------------------------------------------------------------------------------------------
def _doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.term_rows(table(spark, sf_dir, "documents"))


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_terms(spark, sf_dir).select("doc_id", "term", "kind", "line", "level")


def doc_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_terms(spark, sf_dir).filter("method = 'header'").select("doc_id", "term", "line", "level")


def doc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_terms(spark, sf_dir).filter("method = 'table-cell'").select("doc_id", "term", "line")


# sources ------------------------------------------------------------------------------------------------------------
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, length): a source text for each file of code_concepts, with a declaration per concept of a kind that languages declare."""
    c = views.concepts(spark, sf_dir).filter(F.col("language").isin("typescript", "javascript", "python") & F.col("kind").isin("class", "function", "constant", "interface", "enum"))
    n = F.col("name")
    out = F.when(F.coalesce("exported", F.lit(False)), "export ").otherwise("")
    py = F.when(F.col("kind") == "class", F.concat(F.lit("class "), n, F.lit(":\n    pass"))).when(F.col("kind") == "constant", F.concat(F.upper(n), F.lit(" = 1"))).otherwise(F.concat(F.lit("def "), n, F.lit("():\n    return 1")))
    ts = (
        F.when(F.col("kind") == "class", F.concat(out, F.lit("class "), n, F.lit(" {\n  run(x) { return x }\n}")))
        .when(F.col("kind") == "constant", F.concat(F.lit("export const "), n, F.lit(" = 1")))
        .when(F.col("kind") == "function", F.concat(out, F.lit("function "), n, F.lit("(a, b) {\n  return a\n}")))
        .when(F.col("kind") == "interface", F.concat(out, F.lit("interface "), n, F.lit(" {\n}")))
        .otherwise(F.concat(out, F.lit("enum "), n, F.lit(" {\n}")))
    )
    text = F.when(F.col("language") == "python", py).otherwise(ts)
    # a file has no more concepts than lines, so its list is bounded by its size
    files = c.select(F.col("filePath").alias("path"), F.struct("concept_row", text.alias("t")).alias("s")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), "\n").alias("content"))
    return files.withColumn("length", F.length("content"))


def scan_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scanned(scan.discovered(corpus(spark, sf_dir))).select("id", "name", "kind", "line", "endLine", "exported", "language", "parentId")


def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scanned(corpus(spark, sf_dir)).filter("kind IN ('class', 'interface', 'enum')")
    return found.select("filePath", "name").distinct()


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.statistics(views.concepts(spark, sf_dir))


def scan_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.directories(views.concepts(spark, sf_dir).select(F.col("filePath").alias("path")).distinct())


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.concepts(spark, sf_dir).select(F.col("filePath").alias("path"), F.lit(1).alias("length")).distinct()
    return scan.discovered(files).select("path")


# free text ----------------------------------------------------------------------------------------------------------
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select("id", F.concat_ws("\n", "title", "description").alias("text"))


def nl_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.intent_rows(_notes(spark, sf_dir), "id", "text")


def nl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.parsed(_notes(spark, sf_dir), "id", "text")


def nl_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.entity_rows(_notes(spark, sf_dir), "id", "text")


def nl_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.title_rows(table(spark, sf_dir, "pull_requests"), "number", "body")


def nl_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.relation_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


def nl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tp.item_rows(_notes(spark, sf_dir), "id", "text")


# detection ----------------------------------------------------------------------------------------------------------
def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = views.terms(spark, sf_dir)
    prompts = table(spark, sf_dir, "affected_files").filter("query IS NOT NULL").select(F.col("file_row").alias("prompt_id"), F.concat(F.lit("change "), F.array_join("termNames", ", "), F.lit(" in "), F.col("filePath")).alias("text"))
    return detect.matches(prompts, glossary.labels(t), "prompt_id", "text"), t


def detect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[0].select("key", "term_id")


def detect_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, t = _found(spark, sf_dir)
    return detect.best(found, t).select("key", "term_id", "rank")


def detect_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, t = _found(spark, sf_dir)
    return detect.context_lines(detect.best(found, t), t)


# SQL ----------------------------------------------------------------------------------------------------------------
_q = lambda s: "'" + s.replace("'", "''") + "'"
_LINES = r"""l0 AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS line, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
l1 AS (SELECT doc_id, line, l[line] AS t, regexp_matches(l[line], '^[\s\x0B]*(```|~~~)') AS fence FROM l0),
lines AS (SELECT doc_id, line, t FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM l1) WHERE NOT fence AND n % 2 = 0)"""
_INLINE = "t"
for _rx, _to in ((r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*{1,2}([^*]+)\*{1,2}", r"\1"), (r"_{1,2}([^_]+)_{1,2}", r"\1"), (r"~~([^~]+)~~", r"\1"), (rf"[{views.SPACE_SQL}]+", " ")):
    _INLINE = f"regexp_replace({_INLINE}, {_q(_rx)}, {_q(_to)}, 'g')"
_INTENT = sorted(enumerate(p.INTENTS), key=lambda x: (-x[1][2], x[0]))
_match = lambda rx: f"regexp_matches(text, {_q(rx)}, 'i')"
_PAIR = "CASE WHEN " + _match(r"\bas\s+a\s+\w+.*I\s+want") + " THEN ['create', '0.95'] " + " ".join(f"WHEN {_match(rx)} THEN ['{name}', '{c}']" for _, (rx, name, c) in _INTENT) + (
    r" WHEN regexp_matches(text, '(^|\n)\s*([-*•]|\d+[.)])\s+') THEN CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 1 AND NOT regexp_matches(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '^\s*[-*•\d]') THEN ['decompose', '0.6'] ELSE ['create', '0.5'] END ELSE ['unknown', '0'] END"
)

_TERM_OK = "length(term) BETWEEN 2 AND 100 AND NOT regexp_full_match(term, '[0-9]+(\\.[0-9]+)?') AND regexp_matches(term, '[a-zA-Z0-9]') AND upper(term) NOT IN ('---', '***', '___', '...', 'TODO', 'FIXME', 'NOTE', 'TBD')"
_HEAD = r"'^#{1,6}\s+[^\r\n]+$'"
#: All term candidates: of a line and term in any case the first of header, bold text and table cell.
_TERMS = rf"""WITH {_LINES},
found AS (
  SELECT doc_id, line, 1 AS method, 0 AS o, length(regexp_extract(t, '^(#{{1,6}})[ \t]', 1)) AS level, trim(regexp_extract(t, '^#{{1,6}}\s+([^\r\n]+?)(?:\s+#+\s*)?$', 1)) AS t FROM lines WHERE regexp_matches(t, {_HEAD})
  UNION ALL SELECT doc_id, line, 2, o, NULL, b[o] FROM (SELECT *, unnest(generate_series(1, len(b))) AS o FROM (
    SELECT doc_id, line, list_concat(regexp_extract_all(t, '\*\*([^\r\n]+?)\*\*', 1), regexp_extract_all(t, '__([^\r\n]+?)__', 1)) AS b FROM lines WHERE NOT regexp_matches(t, {_HEAD})))
  UNION ALL SELECT doc_id, line, 3, o, NULL, b[o] FROM (SELECT *, unnest(generate_series(1, len(b))) AS o FROM (
    SELECT doc_id, line, string_split(regexp_replace(regexp_replace(t, '^\s*\|', ''), '\|\s*$', ''), '|') AS b FROM lines
    WHERE regexp_matches(t, '^\s*\|[^\r\n]+\|\s*$') AND NOT regexp_matches(t, '^\s*\|[\s:]*-+[\s:]*(\|[\s:]*-+[\s:]*)*\|\s*$')))),
cleaned AS (SELECT doc_id, line, method, o, level, trim({_INLINE.replace("(t,", "(trim(t),", 1)}) AS term FROM found),
kept AS (SELECT * FROM cleaned WHERE {_TERM_OK} QUALIFY row_number() OVER (PARTITION BY doc_id, line, lower(term) ORDER BY method, o) = 1)"""
_FILES = f"""WITH {CONCEPTS_SQL}, f AS (SELECT path, NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', '.git', '.next', '.nuxt', '__pycache__', '.venv', 'venv', '.env', 'coverage', '.cache',
  '.turbo', '.output', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml']) AND NOT regexp_matches(path, '([.]min[.]js|[.]min[.]css|[.]map|[.]lock)(/|$)') AS keep FROM (SELECT DISTINCT filePath AS path FROM concepts))"""
#: The source texts that corpus() makes, read line by line: declarations by language, blocks by their braces or indents.
_SCAN = rf"""WITH {CONCEPTS_SQL}, made AS (SELECT filePath AS path, concept_row, CASE WHEN language = 'python' THEN
    CASE kind WHEN 'class' THEN 'class ' || name || ':' || chr(10) || '    pass' WHEN 'constant' THEN upper(name) || ' = 1' ELSE 'def ' || name || '():' || chr(10) || '    return 1' END
  ELSE CASE kind WHEN 'class' THEN x || 'class ' || name || ' {{' || chr(10) || '  run(x) {{ return x }}' || chr(10) || '}}' WHEN 'constant' THEN 'export const ' || name || ' = 1'
    WHEN 'function' THEN x || 'function ' || name || '(a, b) {{' || chr(10) || '  return a' || chr(10) || '}}' WHEN 'interface' THEN x || 'interface ' || name || ' {{' || chr(10) || '}}' ELSE x || 'enum ' || name || ' {{' || chr(10) || '}}' END END AS t
  FROM (SELECT *, CASE WHEN exported THEN 'export ' ELSE '' END AS x FROM concepts) WHERE language IN ('typescript', 'javascript', 'python') AND kind IN ('class', 'function', 'constant', 'interface', 'enum')),
file AS (SELECT *, regexp_extract(path, '[.]([^./]+)$', 1) AS ext, regexp_extract(path, '([^/]+)[.][^./]+$', 1) AS stem FROM (SELECT path, string_agg(t, chr(10) ORDER BY concept_row, t) AS content FROM made GROUP BY path)),
f AS (SELECT *, CASE WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext IN ('js', 'jsx') THEN 'javascript' WHEN ext = 'py' THEN 'python' END AS language, string_split(content, chr(10)) AS l FROM file
  WHERE ext IN ('ts', 'tsx', 'js', 'jsx', 'py') AND len(string_split(path, '/')) <= 21 AND length(content) <= 1048576 AND NOT regexp_matches(path, '([.]min[.]js|[.]min[.]css|[.]map|[.]lock)(/|$)')
  AND NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', '.git', '.next', '.nuxt', '__pycache__', '.venv', 'venv', '.env', 'coverage', '.cache', '.turbo', '.output'])),
n AS (SELECT path, language, len(l) AS n, i, l[i] AS s, length(l[i]) - length(ltrim(l[i])) AS indent FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM f)),
hit AS (
  SELECT path, language, n, i, indent, 0 AS rank, 'class' AS kind, regexp_extract(s, '^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(\w+)', 1) AS name, starts_with(ltrim(s), 'export ') AS exported FROM n WHERE language <> 'python'
  UNION ALL SELECT path, language, n, i, indent, 1, 'function', regexp_extract(s, '^(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+(\w+)\s*\([^)]*\)', 1), starts_with(s, 'export ') FROM n WHERE language <> 'python'
  UNION ALL SELECT path, language, n, i, indent, 2, 'interface', regexp_extract(s, '^(?:export\s+(?:default\s+)?)?interface\s+(\w+)', 1), starts_with(s, 'export ') FROM n WHERE language = 'typescript'
  UNION ALL SELECT path, language, n, i, indent, 3, 'enum', regexp_extract(s, '^(?:export\s+)?(?:const\s+)?enum\s+(\w+)', 1), starts_with(s, 'export ') FROM n WHERE language = 'typescript'
  UNION ALL SELECT path, language, n, i, indent, 4, 'constant', regexp_extract(s, '^export\s+(?:const|let|var)\s+(\w+)\s*[=:]', 1), true FROM n WHERE language <> 'python' AND NOT contains(s, '=>') AND NOT contains(s, 'function') AND NOT contains(s, 'type ')
  UNION ALL SELECT path, language, n, i, indent, 0, 'class', name, NOT starts_with(name, '_') FROM (SELECT *, regexp_extract(s, '^class\s+(\w+)\s*(?:\([^)]*\))?\s*:', 1) AS name FROM n WHERE language = 'python')
  UNION ALL SELECT path, language, n, i, indent, 1, 'function', name, NOT starts_with(name, '_') FROM (SELECT *, regexp_extract(s, '^(?:async\s+)?def\s+(\w+)\s*\(', 1) AS name FROM n WHERE language = 'python')
  UNION ALL SELECT path, language, n, i, indent, 2, 'constant', regexp_extract(s, '^([A-Z][A-Z0-9_]+)\s*[=:]', 1), true FROM n WHERE language = 'python'),
depth AS (SELECT h.path, h.i, h.rank, m.i AS j, sum(length(m.s) - length(replace(m.s, '{{', '')) - length(m.s) + length(replace(m.s, '}}', ''))) OVER w AS d, sum(length(m.s) - length(replace(m.s, '{{', ''))) OVER w AS o
  FROM hit h JOIN n m ON m.path = h.path AND m.i >= h.i WHERE h.name <> '' AND h.language <> 'python' AND h.kind <> 'constant' WINDOW w AS (PARTITION BY h.path, h.i, h.rank ORDER BY m.i)),
stop AS (SELECT path, i, rank, min(j) AS e FROM depth WHERE o > 0 AND d <= 0 GROUP BY ALL
  UNION ALL SELECT h.path, h.i, h.rank, coalesce(min(m.i) - 1, any_value(h.n)) FROM hit h LEFT JOIN n m ON m.path = h.path AND m.i > h.i AND trim(m.s) <> '' AND NOT starts_with(ltrim(m.s), '#') AND m.indent <= h.indent
    WHERE h.name <> '' AND h.language = 'python' AND h.kind <> 'constant' GROUP BY ALL),
decl AS (SELECT h.*, s.e FROM hit h LEFT JOIN stop s USING (path, i, rank) WHERE h.name <> ''),
member AS (SELECT c.path, c.language, c.i AS owner, m.i, c.name AS cls, regexp_extract(m.s, '^\s+(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?(\w+)\s*\([^)]*\)', 1) AS name, c.exported, NULL::BIGINT AS e FROM decl c JOIN n m ON m.path = c.path AND m.i > c.i AND m.i <= coalesce(c.e, c.n)
  WHERE c.kind = 'class' AND c.language <> 'python' AND (NOT contains(m.s, '=') OR contains(m.s, '=>'))),
every AS (
  SELECT path AS id, stem AS name, 'module' AS kind, 1 AS line, len(l) AS endLine, CASE WHEN language = 'python' THEN NOT starts_with(stem, '_') OR stem = '__init__' ELSE regexp_matches(content, '\bexport\b') END AS exported, language, NULL AS parentId, -1 AS rank, 0 AS o, 0 AS oo FROM f
  UNION ALL SELECT path || '#' || name, name, kind, i, e, exported, language, path, rank, i, 0 FROM decl
  UNION ALL SELECT path || '#' || cls || '.' || name, name, 'function', i, e, exported, language, path || '#' || cls, 0, owner, i FROM member WHERE name <> '' AND name NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'super'))
SELECT id, name, kind, line, endLine, exported, language, parentId FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, o, oo) = 1"""
_TYPED = "(initiative|epic|story|task|subtask|bug|feature|milestone)"
#: Lines that are list items, typed titles, user stories, the only line, or stand before a list.
_TITLES = rf"""WITH n AS (SELECT number AS note_id, string_split(coalesce(body, ''), chr(10)) AS l FROM pull_requests),
x AS (SELECT note_id, i - 1 AS line, len(l) AS n, l[i] AS raw, trim(l[i], ' ' || chr(9) || chr(13)) AS bare, trim(coalesce(l[i - 1], ''), ' ' || chr(9) || chr(13)) AS before, trim(coalesce(l[i + 1], ''), ' ' || chr(9) || chr(13)) AS after
  FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM n)),
y AS (SELECT *, (length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13)))) // 2 AS indent, regexp_matches(bare, '^([-*•]|\d+[.)])\s+.+$') AS listed, regexp_matches(bare, '(?i)^{_TYPED}[:-]\s*.+$') AS typed,
  regexp_matches(bare, '(?i)^as\s+a\s+\w+(\s+\w+)*,?\s+I\s+want\s+.+$') AS story FROM x WHERE bare <> ''),
z AS (SELECT *, CASE WHEN listed THEN trim(regexp_extract(bare, '^(?:[-*•]|\d+[.)])\s+(.+)$', 1)) ELSE bare END AS t FROM y
  WHERE listed OR typed OR story OR n = 1 OR ((line = 0 OR (NOT regexp_matches(before, '^([-*•]|\d+[.)])\s+') AND regexp_matches(after, '^([-*•]|\d+[.)])\s+')))
    AND NOT regexp_matches(bare, '(?i)^(create|add|here\s+are|the\s+following|these\s+are|list\s+of)\b.*[:]\s*$'))),
w AS (SELECT *, regexp_extract(t, '(?i)^{_TYPED}[:-]\s*(.+)$', ['k', 'r']) AS a, regexp_extract(t, '(?i)^\[{_TYPED}\]\s*(.+)$', ['k', 'r']) AS b FROM z)
SELECT note_id, CASE WHEN story AND NOT listed THEN bare WHEN a.k <> '' THEN trim(a.r) WHEN b.k <> '' AND (listed OR NOT typed) THEN trim(b.r) ELSE t END AS title,
  CASE WHEN story AND NOT listed THEN 'story' WHEN a.k <> '' THEN lower(a.k) WHEN b.k <> '' THEN lower(b.k) END AS type, CASE WHEN n = 1 AND NOT listed AND NOT typed AND NOT story THEN 0 ELSE indent END AS indent, line FROM w"""
_CHILD = "CASE {} WHEN 'initiative' THEN 'epic' WHEN 'epic' THEN 'story' WHEN 'story' THEN 'task' WHEN 'task' THEN 'subtask' WHEN 'subtask' THEN 'subtask' WHEN 'bug' THEN 'task' WHEN 'feature' THEN 'story' WHEN 'milestone' THEN 'epic' ELSE 'task' END"
#: The first line over all later titles, then a title over the deeper one after it.
_RELATIONS = f"""WITH t AS ({_TITLES.replace("SELECT number AS note_id, string_split(coalesce(body, ''), chr(10)) AS l FROM pull_requests", "SELECT doc_id AS note_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents")}),
bl AS (SELECT * FROM t WHERE line > 0), ty AS (SELECT note_id, bool_or(type = 'epic') AS e, bool_or(type = 'story') AS s, bool_or(type IN ('task', 'subtask')) AS k FROM bl GROUP BY note_id),
hp AS (SELECT t.note_id, t.title, coalesce(t.type, CASE WHEN e THEN 'initiative' WHEN s THEN 'epic' WHEN k THEN 'story' ELSE 'epic' END) AS up FROM t JOIN ty USING (note_id) WHERE t.line = 0 AND t.indent = 0),
one AS (SELECT hp.note_id, hp.title AS parent, up AS parent_type, bl.title AS child, coalesce(bl.type, {_CHILD.format("up")}) AS child_type FROM hp JOIN bl USING (note_id)),
nxt AS (SELECT note_id, line, title AS parent, coalesce(type, 'epic') AS up, indent, lead(title) OVER w AS child, lead(type) OVER w AS ct, lead(indent) OVER w AS deep FROM t WINDOW w AS (PARTITION BY note_id ORDER BY line)),
two AS (SELECT note_id, parent, up AS parent_type, child, coalesce(ct, {_CHILD.format("up")}) AS child_type FROM nxt WHERE deep > indent
  AND NOT EXISTS (SELECT 1 FROM one o WHERE o.note_id = nxt.note_id AND o.parent = nxt.parent AND o.child = nxt.child) QUALIFY row_number() OVER (PARTITION BY note_id, parent, child ORDER BY line) = 1)
SELECT * FROM one UNION ALL SELECT * FROM two"""
_TOP = f"""WITH {TERMS_SQL}, lab AS (SELECT DISTINCT id, lower(unnest(list_concat([name], aliases))) AS label FROM terms), pr AS (SELECT file_row AS key, lower('change ' || array_to_string(termNames, ', ') || ' in ' || filePath) AS text FROM affected_files WHERE query IS NOT NULL),
hit AS (SELECT DISTINCT p.key, l.id AS term_id FROM pr p JOIN lab l ON contains(p.text, l.label) AND regexp_replace(l.label, '[{views.SPACE_SQL}]', '', 'g') <> '' WHERE regexp_matches(p.text, '(^|[^a-z0-9_])' || regexp_escape(l.label) || '($|[^a-z0-9_])')),
top AS (SELECT key, term_id, row_number() OVER (PARTITION BY key ORDER BY coalesce(t.coupling.score, 0) DESC, term_id) AS rank FROM hit JOIN terms t ON t.id = hit.term_id QUALIFY rank <= 10)"""

_NOTES = f"{ITEMS_SQL}, n AS (SELECT id AS note_id, coalesce(concat_ws(chr(10), title, description), '') AS text FROM items)"
_rows = lambda kind, table, flags="(?i)": [f"('{kind}', {i}, {_q(flags + rx)}, '{v}', {c})" for i, (rx, v, c) in enumerate(table, 100 * (not flags))]
_free = lambda kind, rxs, c: [f"('{kind}', {i}, {_q('(?i)' + rx)}, NULL, {c})" for i, rx in enumerate(rxs)]
_PATTERNS = ", ".join(
    [*_rows("item_type", p.ITEM_TYPES), *_rows("status", p.STATUSES), *_rows("priority", p.PRIORITIES), *_rows("priority", p.PRIORITY_CODES, ""), *_free("label", p.LABELS, 0.8), *_free("person", p.PERSONS, 0.7), *_free("date", p.DATES, 0.85)]
)
#: Matches get marks around them, so their places are the lengths of what stands before; of those that overlap, one is kept from the left.
_ENTITIES = f"""WITH RECURSIVE {_NOTES}, pat(kind, o, rx, value, c) AS (VALUES {_PATTERNS}),
m AS (SELECT note_id, kind, o, rx, value, c, string_split(regexp_replace(text, rx, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM n JOIN pat ON regexp_matches(text, rx)),
e0 AS (SELECT note_id, kind, o, rx, value, c::DOUBLE AS c, split_part(parts[k], chr(2), 1) AS raw, (list_sum(list_transform(parts[1 : k - 1], lambda x: length(x))) - (k - 2))::BIGINT AS start FROM (SELECT *, unnest(generate_series(2, len(parts))) AS k FROM m)),
e1 AS (SELECT *, start + length(raw) AS stop, regexp_extract(raw, rx, 1) AS g FROM e0),
e2 AS (SELECT * FROM e1 WHERE kind IN ('status', 'priority') UNION ALL SELECT * FROM e1 WHERE kind = 'item_type' QUALIFY row_number() OVER (PARTITION BY note_id, start ORDER BY o) = 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY note_id, kind ORDER BY start, c DESC, o) AS rn FROM e2),
walk AS (SELECT note_id, kind, rn, true AS kept, stop AS reached FROM seq WHERE rn = 1
  UNION ALL SELECT s.note_id, s.kind, s.rn, s.start >= w.reached, CASE WHEN s.start >= w.reached THEN s.stop ELSE w.reached END FROM walk w JOIN seq s ON s.note_id = w.note_id AND s.kind = w.kind AND s.rn = w.rn + 1),
ent AS (
  SELECT s.note_id, s.kind, s.raw, s.value, s.start, s.stop AS "end", s.c AS confidence, s.start AS ord FROM seq s JOIN walk w USING (note_id, kind, rn) WHERE w.kept
  UNION ALL SELECT note_id, kind, raw, v, start, stop, c, o * 1000000 + start FROM (SELECT *, lower(trim(unnest(string_split(g, ',')))) AS v FROM e1 WHERE kind = 'label') WHERE v <> ''
  UNION ALL SELECT note_id, kind, raw, trim(g), start, stop, c, o * 1000000 + start FROM e1 WHERE kind = 'date' OR (kind = 'person' AND trim(g) <> '' AND lower(trim(g)) NOT IN ({", ".join(map(_q, sorted(p.COMMON_WORDS)))})))"""
_NOTE_TITLES = _TITLES.replace("SELECT number AS note_id, string_split(coalesce(body, ''), chr(10)) AS l FROM pull_requests", f"SELECT note_id, string_split(text, chr(10)) AS l FROM (WITH {_NOTES} SELECT * FROM n)")

QUERIES = {
    f.__name__: f
    for f in (
        doc_terms, doc_headers, doc_cells, scan_concepts, scan_names, scan_stats, scan_directories, scan_files, nl_intent, nl_parse, nl_entities, nl_titles, nl_hierarchy,
        nl_items, detect_labels, detect_topk, detect_context,
    )
}
ORACLE = {
    "doc_headers": f"""WITH {_LINES}, h AS (SELECT doc_id, line, length(regexp_extract(t, '^(#{{1,6}})[ \\t]', 1)) AS level, trim({_INLINE.replace("(t,", "(x,", 1)}) AS term
        FROM (SELECT *, trim(regexp_extract(t, '^#{{1,6}}\\s+([^\\r\\n]+?)(?:\\s+#+\\s*)?$', 1)) AS x FROM lines WHERE regexp_matches(t, '^#{{1,6}}\\s+[^\\r\\n]+$')))
        SELECT doc_id, term, line, level FROM h WHERE length(term) BETWEEN 2 AND 100 AND NOT regexp_full_match(term, '\\d+(\\.\\d+)?') AND regexp_matches(term, '[a-zA-Z0-9]')
        AND upper(term) NOT IN ({", ".join(map(_q, sorted(docs.ARTIFACTS)))})""",
    "doc_terms": _TERMS + " SELECT doc_id, term, CASE method WHEN 1 THEN 'section' WHEN 2 THEN 'term' ELSE 'definition' END AS kind, line, level FROM kept",
    "doc_cells": _TERMS + " SELECT doc_id, term, line FROM kept WHERE method = 3",
    "scan_files": _FILES + """ SELECT path FROM f WHERE keep AND regexp_matches(path, '(?i)[^/][.](ts|tsx|js|jsx|py|md)$')""",
    "scan_directories": _FILES + f""", entries AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS entry, array_to_string(p[1:i - 1], '/') AS id FROM (SELECT p, unnest(generate_series(2, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM f WHERE keep))),
        dirs AS (SELECT id, regexp_extract(id, '([^/]+)$', 1) AS name, nullif(regexp_extract(id, '^(.*)/[^/]+$', 1), '') AS parent_id, count(*) AS children FROM entries GROUP BY id)
        SELECT *, CASE lower(name) {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in scan.DIRECTORIES.items())} ELSE 'Directory containing ' || children || CASE WHEN children = 1 THEN ' item' ELSE ' items' END END AS description FROM dirs""",
    "scan_concepts": _SCAN,
    "nl_entities": _ENTITIES + """ SELECT note_id, kind, raw, value, start, "end", confidence FROM ent""",
    "nl_items": _ENTITIES
    + rf""", tt AS ({_NOTE_TITLES}), fe AS (SELECT note_id, arg_min(value, ord) FILTER (kind = 'item_type') AS t, arg_min(value, ord) FILTER (kind = 'status') AS s, arg_min(value, ord) FILTER (kind = 'priority') AS pr,
          arg_min(value, ord) FILTER (kind = 'person' AND regexp_matches(raw, '(?i)assign|owner|@|for\s')) AS who, arg_min(value, ord) FILTER (kind = 'person' AND regexp_matches(raw, '(?i)reported|from\s')) AS by_whom,
          coalesce(list(value ORDER BY ord) FILTER (kind = 'label'), []) AS l FROM ent GROUP BY note_id)
        SELECT tt.note_id, line, trim(regexp_replace(regexp_replace(regexp_replace(title, '^\s*[-*•]\s+', ''), '^\s*\d+[.)]\s+', ''), '\s{{2,}}', ' ', 'g')) AS title, coalesce(type, t, 'task') AS type,
          CASE WHEN regexp_extract(title, '(?i)as\s+a\s+\w+(?:\s+\w+)*,?\s+I\s+want\s+(.+?),?\s+so\s+that\s+(.+)$', 2) <> '' THEN 'Acceptance criteria: ' || trim(regexp_extract(title, '(?i)so\s+that\s+(.+)$', 1)) ELSE '' END AS description,
          coalesce(s, 'backlog') AS status, coalesce(pr, 'none') AS priority, coalesce(list_filter(l, lambda x, i: list_position(l, x) = i), []) AS labels, who AS assignee, by_whom AS reporter FROM tt LEFT JOIN fe USING (note_id)""",
    "nl_parse": _ENTITIES
    + f""", it AS (WITH {ITEMS_SQL}, n AS (SELECT id AS note_id, concat_ws(chr(10), title, description) AS text FROM items) SELECT note_id, {_PAIR} AS v FROM n), tt AS ({_NOTE_TITLES}),
        j AS (SELECT n.note_id, n.text, it.v[1] AS intent, it.v[2]::DOUBLE AS sure, (SELECT count(*) FROM ent e WHERE e.note_id = n.note_id) AS n_entities, (SELECT avg(confidence) FROM ent e WHERE e.note_id = n.note_id) AS mean,
          (SELECT count(*) FROM tt WHERE tt.note_id = n.note_id) AS titles FROM n JOIN it USING (note_id)),
        k AS (SELECT *, CASE WHEN titles > 0 THEN titles WHEN trim(text) <> '' AND length(trim(text)) <= 200 THEN 1 ELSE 0 END AS n_items FROM j)
        SELECT note_id, intent, floor(least(1.0, 0.4::DOUBLE * sure + 0.3::DOUBLE * coalesce(mean, 0.5) + CASE WHEN n_items > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) * 100 + 0.5) / 100 AS confidence, n_entities, n_items FROM k""",
    "nl_titles": _TITLES,
    "nl_hierarchy": _RELATIONS,
    "scan_names": f"""WITH {CONCEPTS_SQL} SELECT DISTINCT filePath, name FROM concepts WHERE (language = 'typescript' AND kind IN ('class', 'interface', 'enum') AND (filePath LIKE '%.ts' OR filePath LIKE '%.tsx'))
        OR (language IN ('javascript', 'python') AND kind = 'class')""",
    "scan_stats": f"""WITH {CONCEPTS_SQL}, k AS (SELECT unnest([{", ".join(map(_q, d.CONCEPT_KINDS))}]) AS key)
        SELECT 'kind' AS measure, k.key, count(c.id) AS n FROM k LEFT JOIN concepts c ON c.kind = k.key GROUP BY k.key UNION ALL SELECT 'language', language, count(*) FROM concepts GROUP BY language""",
    "nl_intent": f"WITH {ITEMS_SQL}, n AS (SELECT id AS note_id, concat_ws(chr(10), title, description) AS text FROM items), m AS (SELECT note_id, {_PAIR} AS v FROM n) SELECT note_id, v[1] AS intent, v[2]::DOUBLE AS sure FROM m",
    "detect_topk": _TOP + " SELECT key, term_id, rank FROM top",
    "detect_context": _TOP + """ SELECT key, rank, t.name || coalesce(' (' || t.codeLocations[1].filePath || coalesce('#' || t.codeLocations[1].symbol, '') || ', ' || t.codeLocations[1].relationship || ')', '') || ': ' || left(t.definition, 200) AS line
        FROM top JOIN terms t ON t.id = top.term_id""",
    "detect_labels": f"""WITH {TERMS_SQL}, lab AS (SELECT DISTINCT id, lower(unnest(list_concat([name], aliases))) AS label FROM terms), pr AS (SELECT file_row AS key, lower('change ' || array_to_string(termNames, ', ') || ' in ' || filePath) AS text FROM affected_files WHERE query IS NOT NULL)
        SELECT DISTINCT p.key, l.id AS term_id FROM pr p JOIN lab l ON contains(p.text, l.label) AND regexp_replace(l.label, '[{views.SPACE_SQL}]', '', 'g') <> ''
        WHERE regexp_matches(p.text, '(^|[^a-z0-9_])' || regexp_escape(l.label) || '($|[^a-z0-9_])')""",
}
