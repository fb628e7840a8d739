"""Suggested code changes for a change of a term, generated from a table of rules over affected symbols.

A rule applies to a kind of change, some relationships and symbols or file-level references; its texts are formats with named fields.
Rules are joined to symbols by these keys, so all kinds of change share one plan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.functions import naming
from vocabula.operators import impact
from vocabula.scale import global_rank
from vocabula.semantics import lookup

DEPENDENTS = "(dependent files)"


@dataclass(frozen=True)
class Change:
    """A change of a term: rename, redefine, deprecate, split, merge or relocate."""

    kind: str
    old: str
    description: str = ""
    new: str | None = None
    definition: str | None = None
    split_into: Sequence[str] = field(default_factory=tuple)
    merge_from: Sequence[str] = field(default_factory=tuple)
    location: str | None = None


_DEF, _USE, _TEST, _CONF = "defines", "uses", "tests", "configures"
_MAIN = (_DEF, "implements")
_REST = (_USE, _TEST, _CONF)
_ANY = (*_MAIN, *_REST)

#: Change, relationships, level, kind, priority, title, before, after, auto-applicable; in order of generation.
RULES = [
    ("rename", _ANY, "file", "comment-update", "recommended", 'Update references to "{old}" in file comments', "// Related to: {old}", "// Related to: {new}", False),
    ("rename", _MAIN, "symbol", "symbol-rename", "critical", "Rename {symbol} → {renamed}", "{symbol}", "{renamed}", True),
    ("rename", (_USE,), "symbol", "symbol-rename", "recommended", "Update usage of {symbol} → {renamed}", "{symbol}", "{renamed}", True),
    ("rename", (_TEST,), "symbol", "test-update", "recommended", "Update test references: {symbol} → {renamed}", 'describe("{symbol}", () => {{', 'describe("{renamed}", () => {{', False),
    ("rename", (_CONF,), "symbol", "config-update", "recommended", "Update configuration key: {symbol}", "{old_snake}: ...", "{new_snake}: ...", False),
    ("rename", _ANY, "symbol", "comment-update", "optional", 'Update comments referencing "{old}" near {symbol}', "/** Handles {old} logic */", "/** Handles {new} logic */", False),
    ("redefine", (_DEF,), "any", "comment-update", "critical", "Update documentation for {shown}", "/** {old}: (old definition) */", "/** {old}: {meaning} */", False),
    ("redefine", ("implements", *_REST), "any", "comment-update", "recommended", "Update documentation for {shown}", "/** {old}: (old definition) */", "/** {old}: {meaning} */", False),
    ("redefine", _MAIN, "any", "structural-refactor", "recommended", "Review {shown} implementation against new definition", '// Implementation based on old "{old}" definition', '// Implementation updated for new "{old}" definition\n// {meaning}', False),
    ("deprecate", _MAIN, "symbol", "deprecation-marker", "critical", "Mark {shown} as deprecated", "function {symbol}(", "/** @deprecated {description} */\nfunction {symbol}(", False),
    ("deprecate", _MAIN, "file", "deprecation-marker", "critical", "Mark {shown} as deprecated", "// {file}", "// @deprecated {description}\n// {file}", False),
    ("deprecate", (_USE,), "symbol", "comment-update", "recommended", "Add deprecation notice for usage of {shown}", "{symbol}(", "// TODO: {old} is deprecated — {brief}\n{symbol}(", False),
    ("deprecate", (_USE,), "file", "comment-update", "recommended", "Add deprecation notice for usage of {shown}", "// Uses {old}", "// TODO: {old} is deprecated — {brief}", False),
    ("deprecate", (_TEST,), "any", "test-update", "optional", "Review test coverage for deprecated {shown}", 'describe("{symbol}", () => {{', 'describe("{symbol} (deprecated)", () => {{\n  // TODO: Remove when {old} is fully retired', False),
    ("deprecate", (_CONF,), "any", "comment-update", "recommended", "Add deprecation notice in {file}", "// {old} configuration", "// @deprecated {old} configuration — {brief}", False),
    ("split", _MAIN, "symbol", "structural-refactor", "critical", 'Refactor {shown} — split "{old}" into separate concerns', "class {symbol} {{ /* handles all {old} concerns */ }}", "{classes}", False),
    ("split", _MAIN, "file", "structural-refactor", "critical", 'Refactor {shown} — split "{old}" into separate concerns', "// {file} — monolithic {old} implementation", "{classes}", False),
    ("split", _REST, "any", "comment-update", "recommended", "Review {shown} — determine which new term applies", "// Uses {old}", "// TODO: Determine which of {parts} this should reference", False),
    ("merge", _MAIN, "symbol", "structural-refactor", "critical", "Consolidate {shown} into unified {renamed}", "class {symbol} {{ /* partial implementation */ }}", "class {renamed} {{ /* consolidated from {merged} */ }}", False),
    ("merge", _MAIN, "file", "structural-refactor", "critical", "Consolidate {shown} into unified {pascal}", "// {file}", "class {pascal} {{ /* consolidated from {merged} */ }}", False),
    ("merge", _REST, "any", "symbol-rename", "recommended", 'Update {shown} to reference merged term "{new}"', "// References {term}", "// References {new}", False),
    ("relocate", _MAIN, "symbol", "structural-refactor", "critical", "Move {shown} to {target}", "// {file}\nexport function {symbol}(", "// {target}\nexport function {symbol}(", False),
    ("relocate", _MAIN, "file", "structural-refactor", "critical", "Move {shown} to {target}", "// {file}\n// {old} implementation", "// {target}\n// {old} implementation (relocated)", False),
    ("relocate", (_USE,), "symbol", "import-update", "critical", "Update import path for {shown}", 'import {{ {symbol} }} from "(old location)"', 'import {{ {symbol} }} from "{module}"', False),
    ("relocate", (_USE,), "file", "import-update", "critical", "Update import path for {shown}", 'import {{ ... }} from "(old location)"', 'import {{ ... }} from "{module}"', False),
    ("relocate", (_TEST, _CONF), "any", "comment-update", "recommended", "Update reference to {old} location in {shown}", "// See {file} for {old}", "// See {target} for {old}", False),
]


def _text(template: str, fields: dict[str, Column]) -> Column:
    parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) if i % 2 == 0 else fields[p] for i, p in enumerate(re.split(r"(?<!\{)\{(\w+)\}", template))]
    return F.concat(*parts)


def _py_case(name: str, style: str) -> str:
    words = [w for w in re.split(r"[\s\-_]+", name) if w]
    return {"snake": "_", "kebab": "-"}[style].join(w.lower() for w in words) if style != "pascal" else "".join(w[:1].upper() + w[1:].lower() for w in words)


def _fields(change: Change) -> dict[str, Column]:
    new = change.new or change.old
    short = lambda s, n: s if len(s) <= n else s[: n - 3] + "..."
    meaning = change.definition or change.description
    target = change.location or "(new location not specified)"
    quoted = lambda names: ", ".join(f'"{n}"' for n in names)
    fixed = {
        "old": change.old,
        "new": new,
        "old_snake": _py_case(change.old, "snake"),
        "new_snake": _py_case(new, "snake"),
        "pascal": _py_case(new, "pascal"),
        "meaning": short(meaning, 80),
        "brief": short(change.description, 60),
        "description": change.description,
        "parts": quoted(change.split_into) or "(new terms not specified)",
        "classes": "\n".join(f"class {_py_case(n, 'pascal')} {{ /* handles {n} */ }}" for n in change.split_into) or f"// Split {change.old} into separate concerns",
        "merged": quoted(change.merge_from or [change.old]),
        "target": target,
        "module": re.sub(r"\.[^.]+$", "", target),
    }
    row = {
        "symbol": F.col("symbol"),
        "file": F.col("filePath"),
        "term": F.col("term_name"),
        "shown": F.when(F.col("symbol") == impact.FILE_LEVEL, F.col("filePath")).otherwise(F.col("symbol")),
        "renamed": naming.in_convention(F.lit(new), naming.convention(F.col("symbol"))),
    }
    return {k: F.lit(v) for k, v in fixed.items()} | row


_OUT = ["filePath", "kind", "priority", "title", "symbol", "relationship", "before", "after", "term_id", "auto", "file_ord", "ord", "emit"]


def generated(found: DataFrame, affected: DataFrame, change: Change) -> DataFrame:
    """All suggestions, one row each, with their place of generation (file_ord, ord, emit)."""
    fields = _fields(change)
    placed = found.join(affected.select("filePath", F.struct((-F.col("n_symbols")).alias("less"), "filePath").alias("file_ord")), "filePath")
    made = []
    for emit, (kind_of_change, relationships, level, kind, priority, title, before, after, auto) in enumerate(RULES):
        if kind_of_change != change.kind:
            continue
        here = F.col("relationship").isin(*relationships)
        if level != "any":
            at_file = F.col("symbol") == impact.FILE_LEVEL
            here = here & (at_file if level == "file" else ~at_file)
        texts = [_text(t, fields).alias(n) for t, n in ((title, "title"), (before, "before"), (after, "after"))]
        made.append(F.when(here, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), *texts, F.lit(auto).alias("auto"), F.lit(emit).alias("emit"))))
    if not made:
        raise ValueError(f"no rules for a change of kind {change.kind!r}")
    rows = placed.select("filePath", "symbol", "relationship", "term_id", "file_ord", "ord", F.explode(F.array_compact(F.array(*made))).alias("m"))
    rows = rows.select("filePath", "symbol", "relationship", "term_id", "file_ord", "ord", "m.*").select(*_OUT)
    return rows.unionByName(_file_renames(found, affected, change)) if change.kind == "rename" else rows


def _file_renames(found: DataFrame, affected: DataFrame, change: Change) -> DataFrame:
    """A file whose path holds the old name in kebab case is renamed, and imports of it follow; after the file's symbols."""
    old, new = _py_case(change.old, "kebab"), _py_case(change.new or change.old, "kebab")
    last = found.groupBy("filePath").agg(F.max("ord").alias("ord"))
    rows = affected.filter(F.contains(F.lower("filePath"), F.lit(old))).join(last, "filePath")
    moved = F.regexp_replace("filePath", "(?i)" + re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))
    bare = lambda c: F.regexp_replace(c, r"\.[^.]+\z", "")
    quote = lambda c: F.concat(F.lit('import { ... } from "./'), bare(c), F.lit('"'))

    def out(path: Column, kind: str, title: Column, relationship: Column, before: Column, after: Column, emit: int) -> DataFrame:
        return rows.select(
            path.alias("filePath"), F.lit(kind).alias("kind"), F.lit("recommended").alias("priority"), title.alias("title"), F.lit(None).cast("string").alias("symbol"),
            relationship.alias("relationship"), before.alias("before"), after.alias("after"), F.get("term_ids", F.lit(0)).alias("term_id"), F.lit(False).alias("auto"),
            F.struct((-F.col("n_symbols")).alias("less"), "filePath").alias("file_ord"), "ord", F.lit(emit).alias("emit"),
        )

    path = F.col("filePath")
    first = F.coalesce(F.get("relationships", F.lit(0)), F.lit("defines"))
    return out(path, "file-rename", F.lit("Rename file to match new term name"), first, path, moved, 100).unionByName(
        out(F.lit(DEPENDENTS), "import-update", F.concat(F.lit("Update imports referencing "), path), F.lit("uses"), quote(path), quote(moved), 101)
    )


def suggestions(
    found: DataFrame, affected: DataFrame, change: Change, with_tests: bool = True, with_configs: bool = True, kinds: Sequence[str] | None = None,
    min_priority: str | None = None, per_file: int = d.MAX_PER_FILE, most: int = d.MAX_SUGGESTIONS,
) -> DataFrame:
    """Suggestions by priority, path and place of generation. Files that tests or configurations relate to can be left out as a whole;
    the cap per file takes the first generated, before the order by priority; both caps are the feature."""
    for wanted, relationship in ((with_tests, "tests"), (with_configs, "configures")):
        if not wanted:
            affected = affected.filter(~F.array_contains("relationships", relationship))
    rows = global_rank(generated(found, affected, change), ["file_ord", "ord", "emit"], "number").withColumn("suggestion_id", F.concat(F.lit("suggestion-"), F.col("number").cast("string")))
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(*kinds))
    rank = lookup(F.col("priority"), d.PRIORITY_RANK)
    if min_priority:
        rows = rows.filter(rank >= d.PRIORITY_RANK[min_priority])
    first = Window.partitionBy("filePath").orderBy("number")
    capped = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_file)
    ordered = capped.orderBy(rank.desc(), F.collate("filePath", "UNICODE"), "number").limit(most)
    return ordered.select("suggestion_id", "filePath", "kind", "priority", "title", "symbol", "relationship", "before", "after", "term_id", "auto")


def summary(rows: DataFrame) -> DataFrame:
    """(measure, key, n): by kind, by priority, files and auto-applicable ones."""
    by = lambda c: rows.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("measure"), "key", "n")
    one = lambda k, c: rows.agg(c.cast("long").alias("n")).select(F.lit("total").alias("measure"), F.lit(k).alias("key"), "n")
    return by("kind").union(by("priority")).union(one("files", F.countDistinct("filePath"))).union(one("auto", F.count_if("auto")))
