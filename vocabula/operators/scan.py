"""Source corpora as concepts: discovery of files and directories, declarations by language, statistics.

Files are rows (path, content) and each is parsed on its own in an Arrow pass, so a scan is embarrassingly parallel and a broken file
costs only itself. Parsers are registered by extension.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.operators import docs
from vocabula.semantics import lookup, strings

#: Path segments and endings that are left out, extensions that are read, and meanings of directory names (fixed values).
EXCLUDED = "node_modules dist build .git .next .nuxt __pycache__ .venv venv .env coverage .cache .turbo .output package-lock.json yarn.lock pnpm-lock.yaml".split()
EXCLUDED_ENDINGS = [".min.js", ".min.css", ".map", ".lock"]
INCLUDED = ["ts", "tsx", "js", "jsx", "py", "md"]
MAX_SIZE, MAX_DEPTH = 1 << 20, 20
DIRECTORIES = {
    "src": "Main source code directory", "lib": "Library code directory", "utils": "Utility functions and helpers", "helpers": "Helper functions and modules",
    "models": "Data models and schemas", "types": "Type definitions", "interfaces": "Interface definitions", "services": "Service layer (business logic)",
    "controllers": "Request handlers / controllers", "routes": "Route definitions", "middleware": "Middleware functions", "config": "Configuration files",
    "tests": "Test files", "test": "Test files", "__tests__": "Test files", "spec": "Test specification files", "components": "UI components",
    "pages": "Page-level components or views", "views": "View templates or components", "hooks": "Custom hooks", "store": "State management", "api": "API layer",
    "auth": "Authentication and authorization", "db": "Database layer", "database": "Database layer", "migrations": "Database migrations",
    "scripts": "Utility scripts", "assets": "Static assets", "public": "Public/static files", "adapters": "Adapter implementations",
    "providers": "Provider implementations", "core": "Core/shared functionality", "common": "Shared/common code", "shared": "Shared modules",
    "features": "Feature modules", "modules": "Application modules", "domain": "Domain logic", "entities": "Domain entities",
    "repositories": "Data access repositories", "resolvers": "GraphQL resolvers or similar", "handlers": "Event or request handlers",
    "events": "Event definitions and handlers", "jobs": "Background jobs or tasks", "queues": "Queue definitions", "workers": "Worker processes",
    "cli": "Command-line interface", "plugins": "Plugin modules", "extensions": "Extension modules",
}


# discovery ----------------------------------------------------------------------------------------------------------
def excluded(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.array_contains(strings(*EXCLUDED), s) | F.exists(strings(*EXCLUDED_ENDINGS), lambda e: F.endswith(s, e)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def discovered(files: DataFrame, size: str = "length") -> DataFrame:
    """Files (path relative to the root, length) that a scan reads."""
    depth = F.size(F.split("path", "/")) - 1
    return files.filter(~excluded(F.col("path")) & extension(F.col("path")).isin(INCLUDED) & (F.col(size) <= MAX_SIZE) & (depth <= MAX_DEPTH))


def directories(paths: DataFrame) -> DataFrame:
    """(id, name, parent_id, children, description) of the directories above files that are not left out; children are files and directories."""
    parts = F.split("path", "/")
    entries = paths.filter(~excluded(F.col("path"))).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("entry")
    )
    parent = F.regexp_extract("entry", r"^(.*)/[^/]+\z", 1)
    counts = entries.distinct().select(parent.alias("id"), "entry").filter("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("children"))
    name = F.regexp_extract("id", r"([^/]+)\z", 1)
    unknown = F.concat(F.lit("Directory containing "), F.col("children").cast("string"), F.when(F.col("children") == 1, " item").otherwise(" items"))
    above = F.regexp_extract("id", r"^(.*)/[^/]+\z", 1)
    return counts.select("id", name.alias("name"), F.when(above != "", above).alias("parent_id"), "children", F.coalesce(lookup(F.lower(name), DIRECTORIES), unknown).alias("description"))


# parsers ------------------------------------------------------------------------------------------------------------
Concept = tuple  # name path, kind, line, end line, description, parent path or None, exported


def _brace_end(lines: list[str], at: int) -> int | None:
    """Number of the first line where the braces opened since `at` are closed again; braces in texts count too."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        opened = opened or "{" in lines[i]
        depth += lines[i].count("{") - lines[i].count("}")
        if opened and depth <= 0:
            return i + 1
    return None


def _statement_end(lines: list[str], at: int) -> int | None:
    """Of at most 50 lines the first that holds a semicolon or, behind the first one, starts at the margin."""
    return next((i + 1 for i in range(at, min(at + 50, len(lines))) if ";" in lines[i] or (i > at and lines[i][:1].strip())), None)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _indent_end(lines: list[str], at: int) -> int:
    """Number of lines up to the next that is indented no deeper; empty and comment lines do not count."""
    deep = _indent(lines[at])
    return next((i for i in range(at + 1, len(lines)) if lines[i].strip() and lines[i].lstrip()[0] != "#" and _indent(lines[i]) <= deep), len(lines))


def _no_end(lines: list[str], at: int) -> None:
    return None


def _docstring(lines: list[str], at: int) -> str | None:
    bare = lines[at].strip() if at < len(lines) else ""
    if m := re.match(r'(?P<q>"""|\'\'\')(?P<text>.+?)(?P=q)', bare):
        return m["text"].strip()
    if bare[:3] in ('"""', "'''") and any(x.strip().endswith(bare[:3]) for x in lines[at + 1 : at + 20]):
        return bare[3:].strip() or lines[at + 1].strip() or None
    return None


@dataclass(frozen=True)
class Rule:
    """One kind of declaration. Groups of `form`: name, and as they apply export, async, params, bases, deep. Rules of one rank exclude
    each other on a line, the first one wins; concepts come out by rank, then by line."""

    rank: int
    kind: str
    form: re.Pattern
    end: Callable[[list[str], int], int | None]
    about: Callable[[dict, list[str], int], str]
    exported: Callable[[dict], bool]
    fits: Callable[[dict, str], bool] = lambda g, line: True
    member: "Rule | None" = None


@dataclass(frozen=True)
class Grammar:
    rules: tuple[Rule, ...]
    module: Callable[[str, str], tuple[str, bool]]  # description and whether it is exported, by name and content


def parse(path: str, content: str, grammar: Grammar) -> list[Concept]:
    """The module and its declarations: every line is held against every rule of the grammar, members within their owner's lines."""
    lines = content.split("\n")
    name = posixpath.splitext(posixpath.basename(path))[0]
    about, seen = grammar.module(name, content)
    found: list[tuple[int, int, list[Concept]]] = []
    for i, line in enumerate(lines):
        taken: set[int] = set()
        for r in grammar.rules:
            m = None if r.rank in taken else r.form.match(line)
            if m is None or not r.fits(m.groupdict(), line):
                continue
            taken.add(r.rank)
            g, end = m.groupdict(), r.end(lines, i)
            own: list[Concept] = [(g["name"], g["name"], r.kind, i + 1, end, r.about(g, lines, i), "", r.exported(g))]
            for j in range(i + 1, end or len(lines)) if r.member else ():
                k = r.member.form.match(lines[j])
                if k and r.member.fits(k.groupdict(), lines[j]):
                    h = {**k.groupdict(), "owner_exported": own[0][-1]}
                    own.append((f"{g['name']}.{h['name']}", h["name"], r.member.kind, j + 1, r.member.end(lines, j), r.member.about(h, lines, j), g["name"], r.member.exported(h)))
            found.append((r.rank, i, own))
    found.sort(key=lambda x: x[:2])
    return [("", name, "module", 1, len(lines), about, None, seen), *(c for _, _, own in found for c in own)]


def _word(exported: bool) -> str:
    return "Exported" if exported else "Internal"


def _called(g: dict, exported: bool) -> str:
    params = g["params"].strip()
    return f"{_word(exported)} {'async ' if g['async'] else ''}function {g['name']}" + (f" with parameters ({params})" if params else "")


def _marked(g: dict) -> bool:
    return bool(g["export"])


def _ts_module(name: str, content: str) -> tuple[str, bool]:
    m = re.match(r"/\*\*\s*\n([\s\S]*?)\*/", content)
    told = (re.sub(r"^\s*\*\s?", "", x).strip() for x in m[1].split("\n")) if m else ()
    return next((x for x in told if x and not x.startswith("@")), f"Module {name}"), re.search(r"\bexport\b", content, re.A) is not None


def _py_module(name: str, content: str) -> tuple[str, bool]:
    m = re.match(r'(?:#[^\n]*\n)*\s*(?:"""([\s\S]*?)"""|\'\'\'([\s\S]*?)\'\'\')', content)
    told = (x.strip() for x in (m[1] or m[2] or "").split("\n")) if m else ()
    return next((x for x in told if x), f"Module {name}"), not name.startswith("_") or name == "__init__"


#: Forms of declarations by language, and words that are no methods (fixed values).
FORMS = {
    "ts class": r"^\s*(?P<export>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>\w+)",
    "ts method": r"^\s+(?:static\s+)?(?P<async>async\s+)?(?:get\s+|set\s+)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)",
    "ts function": r"^(?P<export>export\s+(?:default\s+)?)?(?P<async>async\s+)?function\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)",
    "ts arrow": r"^(?P<export>export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?P<async>async\s+)?\(?(?P<params>[^)=]*)\)?\s*=>",
    "ts interface": r"^(?P<export>export\s+(?:default\s+)?)?interface\s+(?P<name>\w+)",
    "ts type": r"^(?P<export>export\s+)?type\s+(?P<name>\w+)\s*=",
    "ts enum": r"^(?P<export>export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)",
    "ts constant": r"^export\s+(?:const|let|var)\s+(?P<name>\w+)\s*[=:]",
    "py class": r"^class\s+(?P<name>\w+)\s*(?:\((?P<bases>[^)]*)\))?\s*:",
    "py def": r"^(?P<deep>\s{4})?(?:async\s+)?def\s+(?P<name>\w+)\s*\(",
    "py constant": r"^(?P<name>[A-Z][A-Z0-9_]+)\s*[=:]",
}
NO_METHOD = frozenset("if for while switch catch return new super".split())
_FORMS = {k: re.compile(v, re.A) for k, v in FORMS.items()}

_METHOD = Rule(
    0, "function", _FORMS["ts method"], _no_end, lambda g, *_: _called(g, g["owner_exported"]), lambda g: g["owner_exported"],
    lambda g, line: g["name"] not in NO_METHOD and ("=" not in line or "=>" in line),
)
_AT_MARGIN = lambda g, line: not line[:2].isspace() or len(line) < 2 or line.strip().startswith("export ")
_SHAPE = lambda g, *_: f"{_word(_marked(g))} interface defining the shape of {g['name']}"
_CALL = lambda g, *_: _called(g, _marked(g))
_UNTYPED = (
    Rule(0, "class", _FORMS["ts class"], _brace_end, lambda g, *_: f"{_word(_marked(g))} class {g['name']}", _marked, member=_METHOD),
    Rule(1, "function", _FORMS["ts function"], _brace_end, _CALL, _marked, _AT_MARGIN),
    Rule(1, "function", _FORMS["ts arrow"], lambda x, i: _brace_end(x, i) or _statement_end(x, i), _CALL, _marked, _AT_MARGIN),
    Rule(4, "constant", _FORMS["ts constant"], _no_end, lambda g, *_: f"Exported constant {g['name']}", lambda g: True, lambda g, line: not any(x in line for x in ("=>", "function", "type "))),
)
_TYPED = (
    Rule(2, "interface", _FORMS["ts interface"], _brace_end, _SHAPE, _marked),
    Rule(2, "interface", _FORMS["ts type"], _statement_end, _SHAPE, _marked),
    Rule(3, "enum", _FORMS["ts enum"], _brace_end, lambda g, *_: f"{_word(_marked(g))} enum {g['name']}", _marked),
)
_PY_METHOD = Rule(
    0, "function", _FORMS["py def"], _indent_end, lambda g, x, i: _docstring(x, i + 1) or f"Method {g['name']}",
    lambda g: not g["name"].startswith("_") or g["name"].startswith("__"), lambda g, line: bool(g["deep"]),
)
_PUBLIC = lambda g: not g["name"].startswith("_")
_PYTHON = (
    Rule(0, "class", _FORMS["py class"], _indent_end, lambda g, x, i: _docstring(x, i + 1) or f"Class {g['name']}" + (f" extending {g['bases'].strip()}" if (g["bases"] or "").strip() else ""), _PUBLIC, member=_PY_METHOD),
    Rule(1, "function", _FORMS["py def"], _indent_end, lambda g, x, i: _docstring(x, i + 1) or f"Function {g['name']}", _PUBLIC, lambda g, line: not g["deep"]),
    Rule(2, "constant", _FORMS["py constant"], _no_end, lambda g, *_: f"Constant {g['name']}", lambda g: True),
)
TYPESCRIPT, JAVASCRIPT, PYTHON = Grammar(_UNTYPED + _TYPED, _ts_module), Grammar(_UNTYPED, _ts_module), Grammar(_PYTHON, _py_module)


def parse_markdown(path: str, content: str) -> list[Concept]:
    return [(term, term, docs.KIND[how], line, None, context or term, None, False) for term, line, how, _, context in docs.candidates(content)]


#: Parser and language by extension; may be extended.
PARSERS: dict[str, tuple[Callable[[str, str], list[Concept]], str]] = {
    **{e: (lambda p, c: parse(p, c, TYPESCRIPT), "typescript") for e in ("ts", "tsx")},
    **{e: (lambda p, c: parse(p, c, JAVASCRIPT), "javascript") for e in ("js", "jsx", "mjs", "cjs")},
    "py": (lambda p, c: parse(p, c, PYTHON), "python"),
    **{e: (parse_markdown, "markdown") for e in ("md", "txt")},
}
_SCHEMA = "id string, name string, kind string, filePath string, line long, endLine long, description string, parentId string, exported boolean, language string, problem string"


def scanned(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Concepts of files (path, content), of one id the first; a file that fails gives one row with `problem` alone."""
    table = PARSERS if parsers is None else parsers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parse = table.get(posixpath.splitext(path)[1][1:].lower())
                if parse is None:
                    continue
                try:
                    if content is None:
                        raise ValueError("cannot be read")
                    seen = set()
                    for key, name, kind, line, end, about, parent, exported in parse[0](path, content):
                        i = f"{path}#{key}" if key else path
                        if i not in seen:
                            seen.add(i)
                            up = None if parent is None else f"{path}#{parent}" if parent else path
                            rows.append((i, name, kind, path, line, end, about, up, exported, parse[1], None))
                except Exception as e:  # one file's failure is its own
                    rows.append((None, None, None, path, None, None, None, None, None, parse[1], str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def statistics(concepts: DataFrame) -> DataFrame:
    """(measure, key, n): by kind, zero where there is none, and by language."""
    kinds = concepts.sparkSession.createDataFrame([(k,) for k in d.CONCEPT_KINDS], "key string")
    by_kind = concepts.groupBy(F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    full = kinds.join(by_kind, "key", "left").select(F.lit("kind").alias("measure"), "key", F.coalesce("n", F.lit(0)).alias("n"))
    return full.union(concepts.groupBy(F.col("language").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("language").alias("measure"), "key", "n"))
