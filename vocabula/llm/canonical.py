"""Duplicates hidden by formatting: canonical text, 128-bit key, counts with map-side combining, exact check of collisions.

Each table is read once, in one Arrow pass that composes characters (NFC), lowers their case, drops all but letters and digits, brings
lists into order and hashes the result; keys and ids are all that goes on. A second, independent hash tells different texts of one key
apart; only then are rows read again, and regrouped by their texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut, join_on_groups

_NO_WORD = re.compile(r"[\W_]+")
_KEYED = "src string, id long, key binary, proof long"


def canonical(text: str | None) -> str:
    """Letters and digits alone, composed, in lower case; null counts as empty."""
    if not text:
        return ""
    if text.isascii():
        return _NO_WORD.sub("", text.lower())
    # lower-casing may take a character apart, so characters are composed on both sides of it
    return _NO_WORD.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()))


def record_text(name: str | None, many: list[str | None] | None = None) -> str:
    """The canonical text of a row. Entries of `many` are a set; those without letter or digit count as an entry without text."""
    return canonical(name) + "\u001f" + "\u001e".join(sorted({canonical(x) for x in many or ()}))


def records(df: DataFrame, src: str, key: str, name: str, many: str | None = None) -> DataFrame:
    """(src, id, name, many) of the rows of one source; null lists are as empty ones."""
    return df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"), (F.col(many) if many else F.lit(None).cast("array<string>")).alias("many"))


def hashed(text: str) -> tuple[bytes, int]:
    """128-bit key and an independent 64-bit proof."""
    data = text.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_digest(data), xxhash.xxh64_intdigest(data) - (1 << 63)


def keyed(recs: DataFrame, hash_: Callable[[str], tuple[bytes, int]] = hashed) -> DataFrame:
    """(src, id, key, proof) of records()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [hash_(record_text(n, m)) for n, m in zip(b.column("name").to_pylist(), b.column("many").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("id"), pa.array([k for k, _ in pairs], pa.binary()), pa.array([p for _, p in pairs], pa.int64())], ["src", "id", "key", "proof"])

    return recs.mapInArrow(run, _KEYED)


def _texts(recs: DataFrame, keys: DataFrame, bad: DataFrame) -> DataFrame:
    """(src, id, text) of the members of keys that hold different texts (as good as never any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [record_text(n, m) for n, m in zip(b.column("name").to_pylist(), b.column("many").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("id"), pa.array(texts, pa.string())], ["src", "id", "text"])

    members = keys.join(bad.select("src", "key"), ["src", "key"], "left_semi").select("src", "id")
    return recs.join(members, ["src", "id"], "left_semi").mapInArrow(run, "src string, id long, text string")


def _groups(keys: DataFrame) -> DataFrame:
    """One row per 128-bit key: smallest id, copies, and whether an independent hash tells different texts apart."""
    return keys.groupBy("src", "key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"), (F.min("proof") != F.max("proof")).alias("collided"))


def distinct_records(recs: DataFrame, hash_: Callable[[str], tuple[bytes, int]] = hashed) -> DataFrame:
    """(src, keep_id, copies): one row per distinct record. No rows for empty input."""
    keys = keyed(recs, hash_)
    g = cut(_groups(keys))
    bad = g.filter("collided")
    sound = g.filter(~F.col("collided")).select("src", "keep_id", "copies")
    if bad.isEmpty():
        return sound
    exact = _texts(recs, keys, bad).groupBy("src", "text").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return sound.unionByName(exact.select("src", "keep_id", "copies"))


def duplicates(recs: DataFrame, hash_: Callable[[str], tuple[bytes, int]] = hashed) -> DataFrame:
    """(src, keep_id, dup_id): every row of a group but its smallest id. Ids are unique within a source."""
    keys = cut(keyed(recs, hash_))
    g = cut(_groups(keys).filter("copies > 1"))
    n, bad = g.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("collided"), F.lit(False))).first()
    found = join_on_groups(keys.select("src", "id", "key"), g.filter(~F.col("collided")), ["src", "key"], "copies", n)
    cols = ["src", "keep_id", F.col("id").alias("dup_id")]
    out = found.select(*cols)
    if bad:
        texts = cut(_texts(recs, keys, g.filter("collided")))
        out = out.unionByName(texts.join(texts.groupBy("src", "text").agg(F.min("id").alias("keep_id")), ["src", "text"]).select(*cols))
    return out.filter("keep_id <> dup_id")
