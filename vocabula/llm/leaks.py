"""Evaluation passages inside training texts: MinHash containment search by size class, verified by exact shingle containment.

What must be found is a run of RUN words of a passage anywhere in a document. Every run of a passage is one query set: its
RUN - SHINGLE + 1 shingles of five words. If a document holds the run, it contains the whole set, so the smallest shingle hash of
the set, its MinHash, is also the smallest of the same run in the document: containment 1 is found with certainty, at any length
of the document. Documents are partitioned by size: those of fewer than RUN words cannot hold a run and are left out, and longer
ones are cut into overlapping segments of bounded size, so the sketches of a very long text are spread over tasks like those of many short
ones. A document's sketch is the set of its runs' MinHashes, about one in five words.

The index of passages is broadcast up to `broadcast_runs` runs; beyond that, sketches of documents meet those of passages in a
shuffle join, in which sketches that stand in very many texts are met by broadcast. Either way each candidate is verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula.llm.words import Words, shingles, sliding_min
from vocabula.scale import cut, hot_keys, join_beside

RUN = 13
SHINGLE = 5
#: Characters of a segment; a word is rarely longer than a few dozen characters, so overlaps are measured in words below.
SEGMENT = 1 << 20
BROADCAST_RUNS = 2_000_000
#: Runs of passages with sketches of very many texts up to which they are broadcast.
HOT_ROWS = 1_000_000


def _run_minima(w: Words, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash of each run and the index of its first word; runs that cross texts are left out."""
    minima = sliding_min(shingles(w.hashes, shingle), run - shingle + 1)
    at = np.arange(len(minima))
    whole = w.text[at] == w.text[at + run - 1] if len(at) else np.zeros(0, bool)
    return minima[whole], at[whole]


def _chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in chunks of about `most` characters, so that the arrays stay small."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(i)
        texts.append(t or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def segments(docs: DataFrame, doc_id: str, text: str, size: int = SEGMENT, run: int = RUN) -> DataFrame:
    """(doc_id, text) by size class: texts of up to `size` characters as they are, longer ones cut at separators into pieces that
    overlap by at least `run` words, so no run is lost. A text that has none (one endless word) stays whole."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    short = d.filter(F.length("text") <= size)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = Words([t])
                if len(t.lower()) != len(t) or len(w.starts) < 2 * run:  # offsets would not fit the text
                    ids, out = [i], [t]
                else:
                    ids, out, k = [], [], 0
                    while k < len(w.starts):
                        end = max(int(np.searchsorted(w.ends, w.starts[k] + size, "right")), k + 2 * run)
                        end = min(end, len(w.starts))
                        ids.append(i)
                        out.append(t[w.starts[k] : w.ends[end - 1]])
                        k = len(w.starts) if end == len(w.starts) else end - run + 1
                for j, piece in zip(ids, out):
                    yield pa.RecordBatch.from_arrays([pa.array([j], b.schema.field(0).type), pa.array([piece])], ["doc_id", "text"])

    long = d.filter(F.length("text") > size)
    return short.unionByName(long.mapInArrow(pieces, long.schema).repartition(F.xxhash64("text")))


def _index(items: list[tuple[object, str]], run: int, shingle: int) -> tuple[np.ndarray, dict]:
    """Sorted MinHashes, and by each the runs of words and their items."""
    w = Words([t for _, t in items])
    minima, at = _run_minima(w, run, shingle)
    runs: dict[int, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    for m, a in zip(minima.tolist(), at.tolist()):
        runs[m][" ".join(w.words(a, a + run))].add(items[w.text[a]][0])
    return np.unique(minima), {m: {k: list(v) for k, v in r.items()} for m, r in runs.items()}


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = RUN, shingle: int = SHINGLE, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds at least `run` consecutive words of the passage.

    Null and empty texts and passages, and passages of fewer than `run` words, give no rows. Copies of documents count each.
    """
    kept = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).filter(F.length("passage") >= 2 * run - 1)
    bound = kept.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    types = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    parts = segments(docs, doc_id, text, run=run)
    if bound // 2 > broadcast_runs:  # a passage has fewer runs than half its characters
        return _by_shuffle(parts, kept, types, run, shingle)
    sc = docs.sparkSession.sparkContext
    index = sc.broadcast(_index([(r["item_id"], r["passage"]) for r in kept.collect()], run, shingle))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, runs = index.value
        for b in batches:
            for ids, texts in _chunks(b):
                w = Words(texts)
                minima, at = _run_minima(w, run, shingle)
                place = np.searchsorted(sketch, minima)
                hit = np.flatnonzero((place < len(sketch)) & (sketch[np.minimum(place, len(sketch) - 1)] == minima)) if len(sketch) else []
                found = set()
                for h in hit:
                    a = int(at[h])
                    for item in runs[int(minima[h])].get(" ".join(w.words(a, a + run)), ()):
                        found.add((ids[w.text[a]], item))
                if found:
                    yield pa.RecordBatch.from_pylist([{"doc_id": d, "item_id": i} for d, i in sorted(found)])

    return parts.mapInArrow(search, types).distinct()


def _by_shuffle(parts: DataFrame, items: DataFrame, types: str, run: int, shingle: int) -> DataFrame:
    """The same for an index of any size. Sketches meet in a shuffle join; a segment comes back for its candidates only."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b):
                w = Words(texts)
                minima, at = _run_minima(w, run, shingle)
                pairs = np.unique(np.stack([w.text[at].astype(np.uint64), minima]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], ["id", "minhash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, held in zip(*(b.column(k).to_pylist() for k in range(3))):
                w = Words([t, *(h["passage"] for h in held)])
                grams = shingles(w.hashes, run)
                mine: dict[int, list[int]] = defaultdict(list)  # runs of the text that some passage may hold
                wanted = {int(grams[j]) for i in range(1, len(held) + 1) for j in range(w.first[i], w.first[i + 1] - run + 1)}
                for k in np.flatnonzero(np.isin(grams[: max(int(w.first[1]) - run + 1, 0)], np.array(list(wanted), np.uint64))).tolist():
                    mine[int(grams[k])].append(k)
                for i, h in enumerate(held, 1):
                    if any(w.words(k, k + run) == w.words(j, j + run) for j in range(w.first[i], w.first[i + 1] - run + 1) for k in mine.get(int(grams[j]), ())[:1]):
                        yield pa.RecordBatch.from_pylist([{"doc_id": d, "item_id": h["item_id"]}])

    numbered = parts.withColumn("segment", F.xxhash64("text"))
    left = numbered.select(F.struct("doc_id", "segment").alias("key"), "text")
    flat = left.select(F.to_json("key").alias("id"), "text").mapInArrow(sketch, "id string, minhash long")
    right = cut(items.select(F.col("item_id").cast("string").alias("id"), F.col("passage").alias("text")).mapInArrow(sketch, "id string, minhash long").withColumnRenamed("id", "item"))
    # only runs that some passage has stay; what stands in very many texts is met by broadcast
    flat = cut(flat.join(right.select("minhash").distinct(), "minhash", "left_semi"))
    hot = hot_keys(flat.groupBy("minhash").agg(F.count(F.lit(1)).alias("n")), ["minhash"], "n", flat.count())
    if hot is not None and right.join(F.broadcast(hot), "minhash", "left_semi").count() > HOT_ROWS:
        hot = None  # left to the splitting of skewed partitions at run time
    pairs = join_beside(flat, right, hot, ["minhash"]).select("id", "item").distinct()
    asked = pairs.join(items.select(F.col("item_id").cast("string").alias("item"), "item_id", "passage"), "item").groupBy("id").agg(F.collect_list(F.struct("item_id", "passage")).alias("held"))
    # a text comes back once, with all its candidates
    found = asked.join(left.select(F.to_json("key").alias("id"), "key.doc_id", "text"), "id").select("doc_id", "text", "held")
    return found.mapInArrow(verify, types).distinct()
