"""Deeply nested JSON texts as flat child tables with links to their parents, by vectorised structural indexing.

A batch of payloads is one byte array. Quote, bracket and delimiter bitmaps give the tokens, a prefix sum over the brackets gives
every token's nesting depth, and a search among the opening brackets of the depth above gives its container. The grammar of JSON is
checked on neighbouring tokens, so a payload that is not well-formed yields nothing. Spans of the children are then read off the
token table. No payload is built as an object; texts that carry JSON themselves go through the same index again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(1, 9)
_STRUCT = np.zeros(256, np.uint8)
for _c, _k in zip(b"{}[]:,", range(1, 7)):
    _STRUCT[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_SCALAR_TEXT = re.compile(rb"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\Z")

#: Which kinds may follow in an array and an object, by the state of the token before: open, comma, colon, key, end of a value.
_AFTER_OPEN, _AFTER_COMMA, _AFTER_COLON, _AFTER_KEY, _AFTER_VALUE = range(5)
_VALUE_START = (OPEN_OBJ, OPEN_ARR, STRING, SCALAR)
_ALLOWED = np.zeros((2, 5, 9), bool)
for _state, _kinds in ((_AFTER_OPEN, (*_VALUE_START, CLOSE_ARR)), (_AFTER_COMMA, _VALUE_START), (_AFTER_VALUE, (COMMA, CLOSE_ARR))):
    _ALLOWED[0, _state, list(_kinds)] = True
for _state, _kinds in ((_AFTER_OPEN, (STRING, CLOSE_OBJ)), (_AFTER_COMMA, (STRING,)), (_AFTER_KEY, (COLON,)), (_AFTER_COLON, _VALUE_START), (_AFTER_VALUE, (COMMA, CLOSE_OBJ))):
    _ALLOWED[1, _state, list(_kinds)] = True


class Index:
    """Tokens of well-formed payloads, in order: kind, start, end (of a container too), payload, container (token, -1 at the top), is_key."""

    def __init__(self, payloads: list[bytes]):
        self.blob = b"\n".join(payloads) + b"\n"
        buf = self.buf = np.frombuffer(self.blob, np.uint8)
        lengths = np.fromiter(map(len, payloads), np.int64, len(payloads)) + 1
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        bad = np.zeros(len(payloads), bool)
        of = lambda pos: np.searchsorted(bounds, pos, "right") - 1

        # quotes that are not escaped, and what stands between them
        slash = np.flatnonzero(buf == 0x5C)
        fresh = np.ones(len(slash), bool)
        fresh[1:] = np.diff(slash) > 1
        run = slash[np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))] if len(slash) else slash
        escapes = slash[(slash - run) % 2 == 0]  # the backslashes that begin an escape
        escaped = np.zeros(len(buf) + 1, bool)
        escaped[escapes + 1] = True
        quotes = np.flatnonzero((buf == 0x22) & ~escaped[:-1])
        rec = of(quotes)
        count = np.bincount(rec, minlength=len(payloads))
        bad |= count % 2 == 1
        keep = ~bad[rec]
        quotes = quotes[keep]
        starts, ends = quotes[0::2], quotes[1::2]
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[starts] = 1
        edge[ends + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        bad[of(np.flatnonzero(inside & (buf < 0x20)))] = True
        bad[of(escapes[~inside[escapes]])] = True
        follow = buf[np.minimum(escapes + 1, len(buf) - 1)]
        bad[of(escapes[~_ESCAPABLE[follow]])] = True
        unicode_ = escapes[follow == 0x75]
        for k in range(2, 6):
            bad[of(unicode_[~_HEX[buf[np.minimum(unicode_ + k, len(buf) - 1)]]])] = True

        # tokens outside strings
        structural = np.where(inside, 0, _STRUCT[buf])
        marks = np.flatnonzero(structural)
        plain = ~inside & ~_SPACE[buf] & (structural == 0)
        plain_edge = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
        s0, s1 = plain_edge[0::2], plain_edge[1::2]
        bad[of(s0[~self._scalars(s0, s1)])] = True
        pos = np.concatenate((marks, starts, s0))
        kind = np.concatenate((structural[marks], np.full(len(starts), STRING, np.uint8), np.full(len(s0), SCALAR, np.uint8)))
        end = np.concatenate((marks + 1, ends + 1, s1))
        order = np.argsort(pos, kind="stable")
        pos, kind, end = pos[order], kind[order], end[order]
        rec = of(pos)
        good = ~bad[rec]
        pos, kind, end, rec = pos[good], kind[good], end[good], rec[good]

        # depth by prefix sum; brackets that do not close leave their payload out
        step = ((kind == OPEN_OBJ) | (kind == OPEN_ARR)).astype(np.int64) - ((kind == CLOSE_OBJ) | (kind == CLOSE_ARR))
        for _ in range(2):  # the second time without payloads whose depths would reach into the next
            sums = np.cumsum(step)
            first = np.flatnonzero(np.diff(rec, prepend=-1))
            base = np.zeros(len(rec), np.int64)
            if len(first):
                base = np.repeat(np.concatenate(([0], sums[first[1:] - 1])), np.diff(np.append(first, len(rec))))
            after = sums - base
            last = np.append(first[1:], len(rec)) - 1 if len(first) else first
            bad[rec[after < 0]] = True
            bad[rec[last[after[last] != 0]]] = True
            good = ~bad[rec]
            pos, kind, end, rec, step = pos[good], kind[good], end[good], rec[good], step[good]
            after = after[good]
        level = after - (step == 1)
        opens = np.flatnonzero(step == 1)
        key = (level[opens] + 1 << 42) | pos[opens]
        by_level = np.argsort(key, kind="stable")
        place = np.searchsorted(key[by_level], (level << 42) | pos) - 1
        container = np.where(level > 0, opens[by_level[np.maximum(place, 0)]] if len(opens) else -1, -1)

        # closing brackets belong to the open one of their level that stands last before them
        closes = np.flatnonzero(step == -1)
        if len(closes):
            mine = opens[by_level[np.searchsorted(key[by_level], (level[closes] + 1 << 42) | pos[closes]) - 1]]
            bad[rec[closes[kind[closes] != kind[mine] + 1]]] = True
            end[mine] = pos[closes] + 1

        # grammar: each pair of neighbours, in the container between them
        if len(kind):
            before = np.concatenate(([0], kind[:-1]))
            new = np.diff(rec, prepend=-1) != 0
            in_obj = (container >= 0) & (kind[np.maximum(container, 0)] == OPEN_OBJ)
            is_key = (kind == STRING) & in_obj & ((before == OPEN_OBJ) | (before == COMMA))
            state = np.full(len(kind), _AFTER_VALUE)
            state[step == 1], state[kind == COMMA], state[kind == COLON], state[is_key] = _AFTER_OPEN, _AFTER_COMMA, _AFTER_COLON, _AFTER_KEY
            room = np.where(step == 1, np.arange(len(kind)), container)  # container of the gap after a token
            gap = np.flatnonzero(~new)
            p = gap - 1
            ok = (room[p] >= 0) & _ALLOWED[(kind[np.maximum(room[p], 0)] == OPEN_OBJ).astype(int), state[p], kind[gap]]
            bad[rec[gap[~ok]]] = True
            bad[rec[new & ~np.isin(kind, _VALUE_START)]] = True
        else:
            is_key = np.zeros(0, bool)
        self.kind, self.start, self.end, self.payload, self.container, self.is_key = kind, pos, end, rec, container, is_key
        self.good = ~bad[rec]

    def _scalars(self, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
        """Whether each bare run of bytes is a number, true, false or null."""
        size = s1 - s0
        digits = np.concatenate(([0], np.cumsum(_DIGIT[self.buf])))
        easy = (digits[s1] - digits[s0] == size) & ((size == 1) | (self.buf[s0] != 0x30))
        known: dict[bytes, bool] = {}
        for i in np.flatnonzero(~easy):
            text = self.blob[s0[i] : s1[i]]
            if text not in known:
                known[text] = _SCALAR_TEXT.match(text) is not None
            easy[i] = known[text]
        return easy

    def raw(self, token: int) -> bytes:
        return self.blob[self.start[token] : self.end[token]]

    def text(self, token: int) -> str | None:
        """Text of a string or scalar; null for null."""
        raw = self.raw(token)
        if self.kind[token] == STRING:
            return json.loads(raw).encode("utf-8", "replace").decode() if 0x5C in raw else raw[1:-1].decode("utf-8", "replace")
        return None if raw == b"null" else raw.decode("utf-8", "replace")

    def keys(self, names: Iterable[str]) -> dict[str, np.ndarray]:
        """Key tokens of each name, well-formed payloads only; of a key that repeats in an object the last."""
        cand = np.flatnonzero(self.is_key & self.good)
        size = self.end[cand] - self.start[cand]
        out = {}
        slashed = [k for k in cand[size > 7] if 0x5C in self.raw(k)] if b"\\u" in self.blob else []
        for name in names:
            want = np.frombuffer(json.dumps(name, ensure_ascii=False).encode(), np.uint8)
            some = cand[size == len(want)]
            if len(some):
                some = some[(self.buf[self.start[some][:, None] + np.arange(len(want))] == want).all(axis=1)]
            more = [k for k in slashed if self.text(k) == name]
            some = np.sort(np.concatenate((some, np.array(more, np.int64)))) if more else some
            last = {c: k for c, k in zip(self.container[some].tolist(), some.tolist())}
            out[name] = np.array(sorted(last.values()), np.int64)
        return out


def _is_json(text: str | None) -> bool:
    return bool(text) and text.lstrip(" \t\r\n")[:1] in ("{", "[", '"') and text.lstrip(" \t\r\n") != '"'


def _entries(ix: Index, value: int, starts: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, str]]:
    """Place and JSON text of the children that a value holds."""
    kind = ix.kind[value]
    if kind == OPEN_ARR:
        tokens, owner = starts
        for i, t in enumerate(tokens[slice(*np.searchsorted(owner, [value, value + 1]))]):
            raw = ix.raw(t)
            if raw != b"null":
                yield i, raw.decode("utf-8", "replace")
        return
    raw = ix.raw(value)
    if raw == b"null":
        return
    if kind == STRING and _is_json(text := ix.text(value)):
        inner = Index([text.encode("utf-8", "replace")])
        if len(inner.kind) and inner.good.all():
            yield from _entries(inner, 0, _element_starts(inner))
            return
    yield 0, raw.decode("utf-8", "replace")


def _element_starts(ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that begin an entry of an array, with the array; sorted by array, then place."""
    in_arr = (ix.container >= 0) & (ix.kind[np.maximum(ix.container, 0)] == OPEN_ARR) if len(ix.kind) else np.zeros(0, bool)
    tokens = np.flatnonzero(in_arr & np.isin(ix.kind, _VALUE_START))
    order = np.argsort(ix.container[tokens], kind="stable")
    return tokens[order], ix.container[tokens][order]


def children(payloads: list[str], lists: Mapping[str, tuple[str, str]]) -> Iterator[tuple[int, str | None, str, int, str]]:
    """(payload number, parent key, child, ord, JSON text) of every entry of the named lists, wherever they stand.

    lists: name of the list -> (name of the child, key of the parent object). An object without that key takes the key under which
    it stands itself, and null if it has none.
    """
    todo = [(i, p) for i, p in enumerate(payloads) if p]
    while todo:
        ix = Index([p.encode("utf-8", "replace") for _, p in todo])
        number = [i for i, _ in todo]
        keys = ix.keys({*lists, *(k for _, k in lists.values())})
        starts = _element_starts(ix)
        parents = {k: dict(zip(ix.container[t].tolist(), t.tolist())) for k, t in keys.items()}
        for name, (child, parent) in lists.items():
            for k in keys[name].tolist():
                obj = int(ix.container[k])
                p = parents[parent].get(obj)
                at = ix.text(p + 2) if p is not None and ix.kind[p + 2] in (STRING, SCALAR) else None
                if at is None and obj > 1 and ix.kind[obj - 1] == COLON:
                    at = ix.text(obj - 2)
                for place, value in _entries(ix, k + 2, starts):
                    yield number[ix.payload[k]], at, child, place, value
        # texts that carry JSON; the lists' own texts were read above, as what stands in them is their entries
        lone = {int(k) + 2 for name in lists for k in keys[name]}
        strings = np.flatnonzero((ix.kind == STRING) & ~ix.is_key & ix.good)
        lead = ix.buf[ix.start[strings] + 1] if len(strings) else strings
        strings = strings[np.isin(lead, list(b'{[ "\\'))] if len(strings) else strings
        todo = [(number[ix.payload[t]], text) for t in strings.tolist() if t not in lone and _is_json(text := ix.text(t))]


def flatten(df: DataFrame, record: str, payload: str, lists: Mapping[str, tuple[str, str]], chunk: int = 1 << 20) -> DataFrame:
    """Distinct (record, parent_key, child, ord, value): one row per child. value is the child's JSON text.

    A lone value where a list is expected is a list of one; a null entry keeps its place but is no child; null, empty and broken
    payloads have none. If a key stands twice in an object, its last list counts, but what is nested deeper in either value is read. Rows are independent of each other, so nothing is shuffled but for the distinct rows of repeated records.
    """
    kept = df.select(F.col(record).alias("record"), F.col(payload).alias("payload")).filter(F.length("payload") > 1)
    lists = dict(lists)
    kind = kept.schema["record"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
                    size += len(texts[end])
                    end += 1
                rows = list(children(texts[at:end], lists))
                if rows:
                    number, parent, child, place, value = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([at + n for n in number])), pa.array(parent, pa.string()), pa.array(child), pa.array(place, pa.int64()), pa.array(value)],
                        ["record", "parent_key", "child", "ord", "value"],
                    )
                at = end

    return kept.mapInArrow(run, f"record {kind}, parent_key string, child string, ord long, value string").withColumnRenamed("record", record)


def explode_list(df: DataFrame, parent: list[str], items: str, prefix: str = "") -> DataFrame:
    """Typed counterpart for columns that are arrays already: parent keys, ord from 0, and the fields of each entry that is not null."""
    out = df.select(*parent, F.posexplode(items).alias("ord", "item")).filter(F.col("item").isNotNull())
    fields = [f.name for f in df.schema[items].dataType.elementType.fields] if hasattr(df.schema[items].dataType.elementType, "fields") else None
    values = [F.col(f"item.`{f}`").alias(prefix + f) for f in fields] if fields else [F.col("item").alias(prefix + "value")]
    return out.select(*parent, F.col("ord").cast("long").alias("ord"), *values)
