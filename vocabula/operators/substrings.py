"""Places of many texts where one of many strings stands, at any size of both sides.

Every string a text could hold is hashed in place: sums of characters times powers hash all parts of a text at once. A table of bits of the
strings that are looked for, of bounded size, tells which parts are worth a look; only these leave the pass, and an equi join on the whole
string decides. So nothing is collected, and no key is shared by strings that only begin alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table for each string, and the most bits it may have (16 MB): more strings than it is made for let more parts through, no fewer.
BITS_EACH, MAX_BITS = 32, 1 << 27
#: Characters that are hashed at a time, unless one text is longer.
CHUNK = 500_000
_PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(128, dtype=bool)
_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _bits(h: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h & np.uint64(mask), (h >> np.uint64(34)) & np.uint64(mask)


def _set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    byte = table[(bit >> np.uint64(3)).astype(np.int64)]
    return ((byte >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)


class _Hashed:
    """Texts one after the other, with what is needed to hash any part of them."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.codes)
        mixed = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(31))) * _powers(n, _BASE), dtype=np.uint64)])
        self.undo = _powers(n + 1, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.undo[start]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin, n = 0, 0
    for i, size in enumerate(sizes):
        if n and n + size > CHUNK:
            yield begin, i
            begin, n = i, 0
        n += size
    if sizes:
        yield begin, len(sizes)


def _pieces(bits: int) -> Callable:
    """From batches of (low) the pieces of their table that are not empty, as (piece, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in _chunks(list(map(len, texts))):
                h = _Hashed(texts[i:j])
                for at in _bits(h.of(h.first[:-1], h.first[1:]), bits - 1):
                    own[at.astype(np.int64)] = True
        for k in range(bits // _PIECE):
            piece = own[k * _PIECE : (k + 1) * _PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(piece).tobytes()], pa.binary())], ["piece", "bits"])

    return run


def _united(t: pa.Table) -> pa.Table:
    whole = np.zeros(_PIECE // 8, dtype=np.uint8)
    for x in t.column("bits").to_pylist():
        whole |= np.frombuffer(x, dtype=np.uint8)
    return pa.table([pa.array([t.column("piece")[0].as_py()], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["piece", "bits"])


def _whole(pieces: Iterable[tuple[int, bytes]], bits: int) -> bytes:
    whole = bytearray(bits // 8)
    for k, x in pieces:
        whole[k * _PIECE // 8 : (k + 1) * _PIECE // 8] = x
    return bytes(whole)


def _places(h: _Hashed, table: np.ndarray, lengths: list[int], bits: int, free: bool) -> Iterator[tuple[np.ndarray, int]]:
    """(starts in rising order, length) of the parts whose bits are set."""
    n = len(h.codes)
    begin = np.arange(n)
    if free:
        word = (h.codes < 128) & _WORD[np.minimum(h.codes, 127)]
        inside = h.first[1:-1]  # where one text ends and the next begins
        starts, ends = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
        starts[1:n], ends[:n] = ~word[: n - 1] if n else [], ~word
        starts[inside] = ends[inside] = True
        begin = np.flatnonzero(starts[:n])
    stop = h.first[np.searchsorted(h.first, begin, side="right")]
    for size in lengths:
        at = begin[begin + size <= stop]
        if free:
            at = at[ends[at + size]]
        for i in (0, 1):
            at = at[_set(table, _bits(h.of(at, at + size), bits - 1)[i])]
        if len(at):
            yield at, size


def _look(lengths: list[int], bits: int, table: Callable[[], bytes], free: bool) -> Callable:
    """From batches of (key, text) the parts that may be among the strings, as (key, low, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.frombuffer(table(), dtype=np.uint8)
        for b in batches:
            every = b.column(1).to_pylist()
            for i, j in _chunks(list(map(len, every))):
                h, best = _Hashed(every[i:j]), {}
                for at, size in _places(h, is_set, lengths, bits, free):
                    own = np.searchsorted(h.first, at, side="right") - 1
                    for k, x in zip(own.tolist(), (at - h.first[own]).tolist()):
                        best.setdefault((k, every[i + k][x : x + size]), x)
                if best:
                    keys = b.column(0).take(pa.array([i + k for k, _ in best], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([s for _, s in best], pa.string()), pa.array(list(best.values()), pa.int64())], ["key", "low", "at"])

    return run


def sizes(strings: DataFrame) -> dict[int, int]:
    """How many strings (column low) there are of each length."""
    return {r["n"]: r["count"] for r in strings.groupBy(F.length("low").alias("n")).count().collect()}


def table_bits(n: int) -> int:
    return 1 << max(16, min(MAX_BITS, BITS_EACH * max(1, n)).bit_length() - 1)


def found(texts: DataFrame, strings: DataFrame, free: bool) -> DataFrame:
    """(key, low, at): of each text (key, text) the first place, from 0, of each string (low) that it holds; empty strings are nowhere.

    free: only where no ASCII letter, digit or underscore adjoins. `strings` is read twice, so it should have been cut. What the table of
    bits let through by mistake is still in the result: join it with the strings.
    """
    lengths = sizes(strings)
    bits = table_bits(sum(lengths.values()))
    pieces = strings.select("low").mapInArrow(_pieces(bits), "piece int, bits binary").groupBy("piece").applyInArrow(_united, "piece int, bits binary")
    # at most MAX_BITS come to the driver
    shared = texts.sparkSession.sparkContext.broadcast(_whole(((r["piece"], r["bits"]) for r in pieces.collect()), bits))
    run = _look(sorted(n for n in lengths if n), bits, lambda: shared.value, free)
    return texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, low string, at long")
