"""Queries on affected code and suggested changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import impact as im
from vocabula.operators import suggest as sg
from vocabula.plans import views
from vocabula.plans.search import score_sql
from vocabula.plans.views import TERMS_SQL

QUERY = "ledger"
CHANGES = {
    "rename": sg.Change("rename", "Invoice Ledger", "Finance agreed on the new name.", new="Billing Journal"),
    "redefine": sg.Change("redefine", "Invoice Ledger", "It now holds credit notes too.", definition="All invoices and credit notes of a tenant"),
    "deprecate": sg.Change("deprecate", "Invoice Ledger", "Replaced by the billing journal"),
    "split": sg.Change("split", "Invoice Ledger", "Two teams own the parts.", split_into=("Invoice Log", "Credit Log")),
    "merge": sg.Change("merge", "Invoice Ledger", "One store is enough.", new="Billing Journal", merge_from=("Invoice Ledger", "Leave Ledger")),
    "relocate": sg.Change("relocate", "Invoice Ledger", "Moved with its owners.", location="packages/billing/ledger.ts"),
}


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.matched_terms(views.terms(spark, sf_dir), QUERY)


def impact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("id", "name", "confidence", F.size("codeLocations").alias("locations"))


def impact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.symbols(_matched(spark, sf_dir)).drop("ord")


def impact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.in_display_order(im.files(im.symbols(_matched(spark, sf_dir))))


def impact_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = im.matched_terms(views.terms(spark, sf_dir), QUERY, min_confidence="ai-verified")
    return im.files(im.symbols(m, relationships=["defines", "uses"], path="packages/")).select("filePath", "n_symbols", "relationships")


def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir)
    return im.summary(m, im.symbols(m))


def _suggest(kind: str, **options: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = im.symbols(_matched(spark, sf_dir))
        return sg.suggestions(found, im.files(found), CHANGES[kind], **options)

    query.__name__ = f"suggest_{kind}"
    return query


def suggest_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggest("rename", per_file=1, most=20, min_priority="recommended", with_tests=False)(spark, sf_dir)


def suggest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.summary(_suggest("rename")(spark, sf_dir))


# SQL ----------------------------------------------------------------------------------------------------------------
def _base(more: str = "true", loc: str = "true") -> str:
    return f"""WITH {TERMS_SQL}, matched AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS term_ord FROM (SELECT *, {score_sql(QUERY)} AS score FROM terms)
  WHERE score > 0 AND len(codeLocations) > 0 AND {more} QUALIFY term_ord <= {d.MAX_IMPACT_TERMS}),
locs AS (SELECT id AS term_id, name AS term_name, term_ord, k, codeLocations[k] AS loc FROM (SELECT *, unnest(generate_series(1, len(codeLocations))) AS k FROM matched)),
raw AS (SELECT loc.filePath AS filePath, CASE WHEN coalesce(loc.symbol, '') = '' THEN '(file-level)' ELSE loc.symbol END AS symbol, term_id, loc.relationship AS relationship, term_name,
  loc.lineRange.start AS first_line, loc.lineRange."end" AS last_line, loc.note AS note, term_ord, k FROM locs WHERE {loc}),
sym AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY filePath, symbol, term_id, relationship ORDER BY term_ord, k) = 1),
rels AS (SELECT filePath, list(relationship ORDER BY o) AS relationships FROM (SELECT filePath, relationship, min(term_ord * 100000 + k) AS o FROM sym GROUP BY ALL) GROUP BY filePath),
tids AS (SELECT filePath, list(term_id ORDER BY o) AS term_ids FROM (SELECT filePath, term_id, min(term_ord * 100000 + k) AS o FROM sym GROUP BY ALL) GROUP BY filePath),
tnames AS (SELECT filePath, list(term_name ORDER BY o) AS term_names FROM (SELECT filePath, term_name, min(term_ord * 100000 + k) AS o FROM sym GROUP BY ALL) GROUP BY filePath),
syms AS (SELECT filePath, count(*)::INT AS n_symbols, list(symbol ORDER BY term_ord, k) AS symbols FROM sym GROUP BY filePath),
files AS (SELECT filePath, n_symbols, symbols, relationships, term_ids, term_names FROM syms JOIN rels USING (filePath) JOIN tids USING (filePath) JOIN tnames USING (filePath))"""


QUERIES = {f.__name__: f for f in (impact_terms, impact_symbols, impact_files, impact_filtered, impact_summary)}
QUERIES |= {f"suggest_{k}": _suggest(k) for k in CHANGES} | {"suggest_capped": suggest_capped, "suggest_summary": suggest_summary}
ORACLE = {
    "impact_terms": _base() + " SELECT id, name, confidence, len(codeLocations)::INT AS locations FROM matched",
    "impact_symbols": _base() + " SELECT filePath, symbol, term_id, relationship, term_name, first_line, last_line, note FROM sym",
    "impact_files": _base() + " SELECT * FROM files",
    "impact_filtered": _base("confidence IN ('ai-verified', 'manual')", "loc.relationship IN ('defines', 'uses') AND contains(lower(loc.filePath), 'packages/')") + " SELECT filePath, n_symbols, relationships FROM files",
    "impact_summary": _base()
    + """ SELECT 'total' AS measure, 'terms' AS key, count(*) AS n FROM matched UNION ALL SELECT 'total', 'files', count(DISTINCT filePath) FROM sym UNION ALL SELECT 'total', 'symbols', count(*) FROM sym
        UNION ALL SELECT 'relationship', relationship, count(*) FROM sym GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM matched GROUP BY 2""",
}


# suggested changes: the rules as literals, apart from the table that the operator reads
_RENAMED = "CASE WHEN contains(symbol, '_') THEN 'billing_journal' WHEN contains(symbol, '-') THEN 'billing-journal' WHEN regexp_matches(symbol, '^[A-Z]') THEN 'BillingJournal' ELSE 'billingJournal' END"
_SHOWN = "CASE WHEN symbol = '(file-level)' THEN filePath ELSE symbol END"
_MAIN, _ALL = "relationship IN ('defines', 'implements')", "relationship IN ('defines', 'implements', 'uses', 'tests', 'configures')"
_REST = "relationship IN ('uses', 'tests', 'configures')"
_FILE, _SYMBOL = "symbol = '(file-level)'", "symbol <> '(file-level)'"
#: By change: condition, kind, priority, title, before, after (SQL), in order of generation.
_MADE = {
    "rename": [
        (f"{_ALL} AND {_FILE}", "comment-update", "recommended", "'Update references to \"Invoice Ledger\" in file comments'", "'// Related to: Invoice Ledger'", "'// Related to: Billing Journal'"),
        (f"{_MAIN} AND {_SYMBOL}", "symbol-rename", "critical", f"'Rename ' || symbol || ' → ' || {_RENAMED}", "symbol", _RENAMED),
        (f"relationship = 'uses' AND {_SYMBOL}", "symbol-rename", "recommended", f"'Update usage of ' || symbol || ' → ' || {_RENAMED}", "symbol", _RENAMED),
        (f"relationship = 'tests' AND {_SYMBOL}", "test-update", "recommended", f"'Update test references: ' || symbol || ' → ' || {_RENAMED}", "'describe(\"' || symbol || '\", () => {'", f"'describe(\"' || {_RENAMED} || '\", () => {{'"),
        (f"relationship = 'configures' AND {_SYMBOL}", "config-update", "recommended", "'Update configuration key: ' || symbol", "'invoice_ledger: ...'", "'billing_journal: ...'"),
        (f"{_ALL} AND {_SYMBOL}", "comment-update", "optional", "'Update comments referencing \"Invoice Ledger\" near ' || symbol", "'/** Handles Invoice Ledger logic */'", "'/** Handles Billing Journal logic */'"),
    ],
    "redefine": [
        ("relationship = 'defines'", "comment-update", "critical", f"'Update documentation for ' || {_SHOWN}", "'/** Invoice Ledger: (old definition) */'", "'/** Invoice Ledger: All invoices and credit notes of a tenant */'"),
        ("relationship IN ('implements', 'uses', 'tests', 'configures')", "comment-update", "recommended", f"'Update documentation for ' || {_SHOWN}", "'/** Invoice Ledger: (old definition) */'", "'/** Invoice Ledger: All invoices and credit notes of a tenant */'"),
        (_MAIN, "structural-refactor", "recommended", f"'Review ' || {_SHOWN} || ' implementation against new definition'", "'// Implementation based on old \"Invoice Ledger\" definition'", "'// Implementation updated for new \"Invoice Ledger\" definition' || chr(10) || '// All invoices and credit notes of a tenant'"),
    ],
    "deprecate": [
        (f"{_MAIN} AND {_SYMBOL}", "deprecation-marker", "critical", f"'Mark ' || {_SHOWN} || ' as deprecated'", "'function ' || symbol || '('", "'/** @deprecated Replaced by the billing journal */' || chr(10) || 'function ' || symbol || '('"),
        (f"{_MAIN} AND {_FILE}", "deprecation-marker", "critical", f"'Mark ' || {_SHOWN} || ' as deprecated'", "'// ' || filePath", "'// @deprecated Replaced by the billing journal' || chr(10) || '// ' || filePath"),
        (f"relationship = 'uses' AND {_SYMBOL}", "comment-update", "recommended", f"'Add deprecation notice for usage of ' || {_SHOWN}", "symbol || '('", "'// TODO: Invoice Ledger is deprecated — Replaced by the billing journal' || chr(10) || symbol || '('"),
        (f"relationship = 'uses' AND {_FILE}", "comment-update", "recommended", f"'Add deprecation notice for usage of ' || {_SHOWN}", "'// Uses Invoice Ledger'", "'// TODO: Invoice Ledger is deprecated — Replaced by the billing journal'"),
        ("relationship = 'tests'", "test-update", "optional", f"'Review test coverage for deprecated ' || {_SHOWN}", "'describe(\"' || symbol || '\", () => {'", "'describe(\"' || symbol || ' (deprecated)\", () => {' || chr(10) || '  // TODO: Remove when Invoice Ledger is fully retired'"),
        ("relationship = 'configures'", "comment-update", "recommended", "'Add deprecation notice in ' || filePath", "'// Invoice Ledger configuration'", "'// @deprecated Invoice Ledger configuration — Replaced by the billing journal'"),
    ],
    "split": [
        (f"{_MAIN} AND {_SYMBOL}", "structural-refactor", "critical", f"'Refactor ' || {_SHOWN} || ' — split \"Invoice Ledger\" into separate concerns'", "'class ' || symbol || ' { /* handles all Invoice Ledger concerns */ }'", "'class InvoiceLog { /* handles Invoice Log */ }' || chr(10) || 'class CreditLog { /* handles Credit Log */ }'"),
        (f"{_MAIN} AND {_FILE}", "structural-refactor", "critical", f"'Refactor ' || {_SHOWN} || ' — split \"Invoice Ledger\" into separate concerns'", "'// ' || filePath || ' — monolithic Invoice Ledger implementation'", "'class InvoiceLog { /* handles Invoice Log */ }' || chr(10) || 'class CreditLog { /* handles Credit Log */ }'"),
        (_REST, "comment-update", "recommended", f"'Review ' || {_SHOWN} || ' — determine which new term applies'", "'// Uses Invoice Ledger'", "'// TODO: Determine which of \"Invoice Log\", \"Credit Log\" this should reference'"),
    ],
    "merge": [
        (f"{_MAIN} AND {_SYMBOL}", "structural-refactor", "critical", f"'Consolidate ' || {_SHOWN} || ' into unified ' || {_RENAMED}", "'class ' || symbol || ' { /* partial implementation */ }'", f"'class ' || {_RENAMED} || ' {{ /* consolidated from \"Invoice Ledger\", \"Leave Ledger\" */ }}'"),
        (f"{_MAIN} AND {_FILE}", "structural-refactor", "critical", f"'Consolidate ' || {_SHOWN} || ' into unified BillingJournal'", "'// ' || filePath", "'class BillingJournal { /* consolidated from \"Invoice Ledger\", \"Leave Ledger\" */ }'"),
        (_REST, "symbol-rename", "recommended", f"'Update ' || {_SHOWN} || ' to reference merged term \"Billing Journal\"'", "'// References ' || term_name", "'// References Billing Journal'"),
    ],
    "relocate": [
        (f"{_MAIN} AND {_SYMBOL}", "structural-refactor", "critical", f"'Move ' || {_SHOWN} || ' to packages/billing/ledger.ts'", "'// ' || filePath || chr(10) || 'export function ' || symbol || '('", "'// packages/billing/ledger.ts' || chr(10) || 'export function ' || symbol || '('"),
        (f"{_MAIN} AND {_FILE}", "structural-refactor", "critical", f"'Move ' || {_SHOWN} || ' to packages/billing/ledger.ts'", "'// ' || filePath || chr(10) || '// Invoice Ledger implementation'", "'// packages/billing/ledger.ts' || chr(10) || '// Invoice Ledger implementation (relocated)'"),
        (f"relationship = 'uses' AND {_SYMBOL}", "import-update", "critical", f"'Update import path for ' || {_SHOWN}", "'import { ' || symbol || ' } from \"(old location)\"'", "'import { ' || symbol || ' } from \"packages/billing/ledger\"'"),
        (f"relationship = 'uses' AND {_FILE}", "import-update", "critical", f"'Update import path for ' || {_SHOWN}", "'import { ... } from \"(old location)\"'", "'import { ... } from \"packages/billing/ledger\"'"),
        ("relationship IN ('tests', 'configures')", "comment-update", "recommended", f"'Update reference to Invoice Ledger location in ' || {_SHOWN}", "'// See ' || filePath || ' for Invoice Ledger'", "'// See packages/billing/ledger.ts for Invoice Ledger'"),
    ],
}
_MOVED = "regexp_replace(filePath, 'invoice-ledger', 'billing-journal', 'gi')"
_BARE = lambda x: f"regexp_replace({x}, '\\.[^.]+$', '')"
_COLS = "filePath, kind, priority, title, symbol, relationship, before, after, term_id, auto"
#: Paths in dictionary order: marks before letters, case last.
_UNICODE = "translate(lower(filePath), '_-./', chr(33) || chr(34) || chr(35) || chr(36)), filePath DESC"


def _suggest_sql(change: str, files: str = "true", priority: str = "true", per_file: int = 20, most: int = 100) -> str:
    parts = [
        f"""SELECT filePath, '{kind}' AS kind, '{prio}' AS priority, {title} AS title, symbol, relationship, {before} AS before, {after} AS after, term_id,
        {"true" if kind == "symbol-rename" and change == "rename" else "false"} AS auto, n_symbols, filePath AS place, term_ord, k, {i} AS emit FROM s WHERE {where}"""
        for i, (where, kind, prio, title, before, after) in enumerate(_MADE[change])
    ]
    if change == "rename":
        last = f"""FROM (SELECT f.*, (SELECT max(term_ord * 100000 + k) FROM sym WHERE sym.filePath = f.filePath) AS o FROM files f WHERE contains(lower(filePath), 'invoice-ledger') AND {files})"""
        parts.append(f"SELECT filePath, 'file-rename', 'recommended', 'Rename file to match new term name', NULL, relationships[1], filePath, {_MOVED}, term_ids[1], false, n_symbols, filePath, o // 100000, o % 100000, 100 {last}")
        parts.append(
            f"""SELECT '(dependent files)', 'import-update', 'recommended', 'Update imports referencing ' || filePath, NULL, 'uses', 'import {{ ... }} from "./' || {_BARE("filePath")} || '"',
            'import {{ ... }} from "./' || {_BARE(_MOVED)} || '"', term_ids[1], false, n_symbols, filePath, o // 100000, o % 100000, 101 {last}"""
        )
    rank = "CASE priority WHEN 'critical' THEN 2 WHEN 'recommended' THEN 1 ELSE 0 END"
    return f"""{_base()}, s AS (SELECT sym.*, f.n_symbols FROM sym JOIN files f USING (filePath) WHERE {files}), made AS ({" UNION ALL ".join(parts)}),
numbered AS (SELECT *, row_number() OVER (ORDER BY n_symbols DESC, place, term_ord, k, emit) AS number FROM made),
capped AS (SELECT * FROM numbered WHERE {priority} QUALIFY row_number() OVER (PARTITION BY filePath ORDER BY number) <= {per_file}),
shown AS (SELECT 'suggestion-' || number AS suggestion_id, {_COLS} FROM capped ORDER BY {rank} DESC, {_UNICODE}, number LIMIT {most})"""


ORACLE |= {f"suggest_{k}": _suggest_sql(k) + " SELECT * FROM shown" for k in _MADE}
ORACLE["suggest_capped"] = _suggest_sql("rename", "NOT list_contains(relationships, 'tests')", "priority IN ('critical', 'recommended')", 1, 20) + " SELECT * FROM shown"
ORACLE["suggest_summary"] = (
    _suggest_sql("rename")
    + """ SELECT 'kind' AS measure, kind AS key, count(*) AS n FROM shown GROUP BY kind UNION ALL SELECT 'priority', priority, count(*) FROM shown GROUP BY priority
    UNION ALL SELECT 'total', 'files', count(DISTINCT filePath) FROM shown UNION ALL SELECT 'total', 'auto', count(*) FILTER (auto) FROM shown"""
)
