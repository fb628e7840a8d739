"""Work items read from free text: intent, entities with spans, titles, parent-child relations and assembled items.

Spans and greedy choices between overlapping matches need regular expressions with offsets, which Spark has no expression for, so a text
is parsed in one Arrow pass; rows of all kinds come from that pass without a shuffle. Offsets count characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula import patterns as p

_A, _AI = re.A, re.A | re.I
_typed = lambda table, flags=_AI: [(re.compile(rx, flags), v, c) for rx, v, c in table]
_TYPES, _STATUSES, _INTENTS = _typed(p.ITEM_TYPES), _typed(p.STATUSES), _typed(p.INTENTS)
_PRIORITIES = _typed(p.PRIORITIES) + _typed(p.PRIORITY_CODES, _A)
_LABELS, _PERSONS, _DATES = ([re.compile(rx, _AI) for rx in rxs] for rxs in (p.LABELS, p.PERSONS, p.DATES))
_LIST, _LIST_LINE = re.compile(p.LIST_ITEM), re.compile(p.LIST_MARK)
_TYPED_TITLE, _BRACKETED = re.compile(p.TYPED_TITLE, re.I), re.compile(p.BRACKETED_TITLE, re.I)
_STORY, _SO_THAT, _META, _META_PREFIX = (re.compile(rx, _AI) for rx in (p.USER_STORY, p.STORY_GOAL, p.META_LINE, p.META_PREFIX))

Entity = tuple[str, str, str, int, int, float]  # kind, raw, value, start, end, confidence
Title = tuple[str, str | None, int, int]  # title, type, indent, line


def intent(text: str) -> tuple[str, float]:
    """The surest pattern, of equals the first; lists without one create or decompose; a user story always creates."""
    best, sure = "unknown", 0.0
    for rx, name, confidence in _INTENTS:
        if confidence > sure and rx.search(text):
            best, sure = name, confidence
    if best == "unknown" and re.search(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+", text):
        lines = [x for x in text.split("\n") if x.strip()]
        best, sure = ("decompose", 0.6) if len(lines) > 1 and not re.match(r"\s*[-*•\d]", lines[0]) else ("create", 0.5)
    if re.search(r"\bas\s+a\s+\w+.*I\s+want", text, _AI):
        best, sure = "create", 0.95
    return best, sure


def _apart(found: list[Entity]) -> list[Entity]:
    """From the left, of one start the surest; what overlaps an entity kept is left out."""
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e[3], -e[5])):
        if not out or e[3] >= out[-1][4]:
            out.append(e)
    return out


def entities(text: str, least: float = p.MIN_ENTITY_CONFIDENCE) -> list[Entity]:
    """By kind: item types, statuses, priorities, labels, persons, dates."""

    def valued(kind: str, table: list) -> list[Entity]:
        return [(kind, m[0], value, m.start(), m.end(), c) for rx, value, c in table for m in rx.finditer(text)]

    first: dict[int, Entity] = {}
    for e in valued("item_type", _TYPES):
        first.setdefault(e[3], e)
    out = _apart(list(first.values())) + _apart(valued("status", _STATUSES)) + _apart(valued("priority", _PRIORITIES))
    for rx in _LABELS:
        for m in rx.finditer(text):
            out += [("label", m[0], x.strip().lower(), m.start(), m.end(), 0.8) for x in m[1].split(",") if x.strip()]
    for rx in _PERSONS:
        for m in rx.finditer(text):
            if (name := m[1].strip()) and name.lower() not in p.COMMON_WORDS:
                out.append(("person", m[0], name, m.start(), m.end(), 0.7))
    for rx in _DATES:
        out += [("date", m[0], m[1].strip(), m.start(), m.end(), 0.85) for m in rx.finditer(text)]
    return [e for e in out if e[5] >= least]


def _title(line: str) -> tuple[str, str | None]:
    m = _TYPED_TITLE.match(line) or _BRACKETED.match(line)
    return (m[2].strip(), m[1].lower()) if m else (line, None)


def titles(text: str) -> list[Title]:
    lines = text.split("\n")
    out: list[Title] = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        indent = (len(line) - len(line.lstrip())) // 2
        if m := _LIST.match(bare):
            out.append((*_title(m[1].strip()), indent, i))
        elif m := _TYPED_TITLE.match(bare):
            out.append((m[2].strip(), m[1].lower(), indent, i))
        elif _STORY.match(bare):
            out.append((bare, "story", indent, i))
        elif len(lines) == 1:
            out.append((*_title(bare), 0, i))
        elif i == 0 or (not _LIST_LINE.match(lines[i - 1].strip()) and i + 1 < len(lines) and _LIST_LINE.match(lines[i + 1].strip())):
            if not _META.match(bare):
                out.append((*_title(bare), indent, i))
    return out


def relations(found: list[Title]) -> list[tuple[str, str, str, str]]:
    """(parent, parent type, child, child type): the first line over all later titles, then a title over the deeper one after it."""
    out: list[tuple[str, str, str, str]] = []
    head = next((t for t in found if t[2] == 0 and t[3] == 0), None)
    below = [t for t in found if t[3] > 0]
    if head and below:
        types = {t[1] for t in below}
        parent = head[1] or ("initiative" if "epic" in types else "epic" if "story" in types else "story" if types & {"task", "subtask"} else "epic")
        out = [(head[0], parent, t[0], t[1] or p.CHILD_TYPE.get(parent, "task")) for t in below]
    known = {(a, c) for a, _, c, _ in out}
    for up, down in zip(found, found[1:]):
        if down[2] > up[2] and (up[0], down[0]) not in known:
            parent = up[1] or "epic"
            out.append((up[0], parent, down[0], down[1] or p.CHILD_TYPE.get(parent, "task")))
            known.add((up[0], down[0]))
    return out


def items(text: str, found: list[Title], have: list[Entity]) -> list[dict]:
    """One item per title; the first entity of each kind holds for all of them. A short text without titles is one item."""
    if not found:
        whole = text.replace("\n", " ").strip()
        bare = re.sub(r"^new\s+", "", _META_PREFIX.sub("", whole), flags=re.I).strip() if whole and len(whole) <= 200 else ""
        found = [(bare, None, 0, 0)] if bare else []
    first = lambda kind: next((e[2] for e in have if e[0] == kind), None)
    person = lambda rx: next((e[2] for e in have if e[0] == "person" and re.search(rx, e[1], re.I)), None)
    shared = {
        "status": first("status") or "backlog",
        "priority": first("priority") or "none",
        "labels": list(dict.fromkeys(e[2] for e in have if e[0] == "label")),
        "assignee": person(r"assign|owner|@|for\s"),
        "reporter": person(r"reported|from\s"),
    }
    out = []
    for title, kind, _, line in found:
        clean = re.sub(r"\s{2,}", " ", re.sub(r"^\s*\d+[.)]\s+", "", re.sub(r"^\s*[-*•]\s+", "", title))).strip()
        goal = _SO_THAT.search(title)
        out.append({"line": line, "title": clean, "type": kind or first("item_type") or "task", "description": f"Acceptance criteria: {goal[2].strip()}" if goal and goal[2] else "", **shared})
    return out


def certainty(sure: float, have: list[Entity], n_items: int) -> float:
    mean = sum(e[5] for e in have) / len(have) if have else 0.5
    return floor(min(1.0, 0.4 * sure + 0.3 * mean + (0.3 if n_items else 0.0)) * 100 + 0.5) / 100


# rows ---------------------------------------------------------------------------------------------------------------
def _rows(df: DataFrame, key: str, text: str, schema: str, make) -> DataFrame:
    kept = df.select(F.col(key).alias("note_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = kept.schema["note_id"].dataType.simpleString()
    names = ["note_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in make(t)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"note_id {kind}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(full))
    return kept.mapInArrow(run, full)


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(note_id, intent, confidence, n_entities, n_items): one row per text; null texts count as empty."""

    def make(t: str):
        name, sure = intent(t)
        have = entities(t)
        n = len(items(t, titles(t), have))
        yield name, certainty(sure, have, n), len(have), n

    return _rows(df, key, text, "intent string, confidence double, n_entities long, n_items long", make)


def intent_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, text, "intent string, sure double", lambda t: [intent(t)])


def entity_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, text, "kind string, raw string, value string, start long, end long, confidence double", entities)


def title_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, text, "title string, type string, indent long, line long", titles)


def relation_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, text, "parent string, parent_type string, child string, child_type string", lambda t: relations(titles(t)))


def item_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    cols = ["line", "title", "type", "description", "status", "priority", "labels", "assignee", "reporter"]
    make = lambda t: [tuple(i[c] for c in cols) for i in items(t, titles(t), entities(t))]
    return _rows(df, key, text, "line long, title string, type string, description string, status string, priority string, labels array<string>, assignee string, reporter string", make)
