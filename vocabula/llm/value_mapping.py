"""Freely typed values mapped to a reference list: prefix-filter set-similarity join, Jaccard verified exactly, best kept.

Values are aggregated to distinct ones, freed of comments and decoration and reduced to letters and digits. A value is the set of its
characters and of its ordered pairs of characters next to each other or one apart, numbered where they repeat: a slip, a swap or a cut end
changes few of them. Tokens are ordered by global rarity; only the rarest of either side, as many as a Jaccard of `least` demands, are
joined, length and positional filters thin the candidates, and Jaccard is verified on whole token sets. It alone decides and ranks: the
entry with the most similar spelling is meant, if it reaches `least`. Entries are also spelt without vowels, as people shorten them. The
rest is reported as unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut, join_on_groups, total

LEAST = 0.4
UNMATCHED = -1
#: Prefix tokens of the reference list up to which it is broadcast; both sides are shuffled beyond it.
NEAR = 200_000
_BLANK = r"[\s   -​  　﻿]+"
_NOT_WORD = r"[^\p{L}\p{N}]"
#: Comments behind and before a value, in the order they are taken off (fixed values): brackets, who said it, since when, a ticket, a number;
#: a number, the name of the field, "now", initials.
_BEHIND = [
    rf"(?<=[\p{{L}}\p{{N}}]){_NOT_WORD}{{0,4}}\([^()]*\)\s*$",
    r"(?i)\s*,\s*says\s.*$",
    r"(?i)\s+(?:as\s+of|since)\s+.*$",
    r"\s*/\s*[A-Za-z]{2,4}-\d+\s*$",
    rf"(?<=[\p{{L}}\p{{N}}]){_NOT_WORD}+\d+{_NOT_WORD}*$",
]
_BEFORE = [
    rf"^{_NOT_WORD}*\d+{_NOT_WORD}+(?=.*\p{{L}})",
    rf"(?i)^{_NOT_WORD}*(?:status|type|kind)\s*:\s*",
    rf"(?i)^{_NOT_WORD}*now\s+",
    r"^\s*[A-Z]{2,4}:\s*",
]


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), rf"{_NOT_WORD}+", "")


def cleaned(text: Column) -> Column:
    """Without comments and decoration: letters and digits, lower case."""
    out = F.trim(F.regexp_replace(text, _BLANK, " "))
    for pattern in (*_BEHIND, *_BEFORE):
        out = F.regexp_replace(out, pattern, "")
    return compact(out)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, "") == ""


def tokens(text: Column) -> Column:
    """Characters, pairs of neighbours (with both ends marked) and pairs that are one apart, numbered where they repeat: a set of three
    tokens for each character."""

    def cut_out(of: Column, n: int, width: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text) + n), lambda i: F.substring(of, i, F.lit(2)) if width == "pair" else F.substring(of, i, F.lit(1)))

    framed = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    apart = F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.concat(F.substring(text, i, F.lit(1)), F.substring(text, i + 2, F.lit(1)))))
    every = F.concat(cut_out(text, 0, "one"), cut_out(framed, 1, "pair"), F.coalesce(apart, F.array().cast("array<string>")))
    numbered = F.transform(every, lambda x, i: F.concat(x, F.size(F.filter(F.slice(every, 1, i + 1), lambda y: y == x)).cast("string")))
    return F.when(F.length(text) > 0, numbered).otherwise(F.array().cast("array<string>"))


def forms(reference: DataFrame, value_id: str = "value_id", field: str = "field", canonical: str = "canonical", alternates: str = "alternates") -> DataFrame:
    """(value_id, field, form, spelling): each entry's names, compact, and how they may be spelt: whole, and without vowels, with the
    first character or without it."""
    every = F.concat(F.array(canonical), F.coalesce(F.col(alternates), F.array().cast("array<string>")))
    out = reference.select(F.col(value_id).alias("value_id"), F.col(field).alias("field"), F.explode(every).alias("written"))
    out = out.select("value_id", "field", compact(F.col("written")).alias("form")).filter("form <> ''")
    bare = lambda c: F.regexp_replace(c, "[aeiou]", "")
    spelt = F.array("form", F.concat(F.left("form", F.lit(1)), bare(F.substring("form", 2, 1_000_000))), bare(F.col("form")))
    return out.withColumn("spelling", F.explode(F.array_distinct(spelt))).filter((F.col("spelling") == F.col("form")) | (F.length("spelling") > 1)).distinct()


def _ordered(strings: DataFrame, key: str, rarity: DataFrame) -> DataFrame:
    """(field, key, n, toks): tokens from rare to common."""
    return (
        strings.select("field", key, F.explode("toks").alias("tok"))
        .join(rarity, ["field", "tok"])
        .groupBy("field", key)
        .agg(F.sort_array(F.collect_list(F.struct("seen", "tok"))).alias("s"))
        .select("field", key, F.size("s").alias("n"), F.col("s.tok").alias("toks"))
    )


def similar(values: DataFrame, reference: DataFrame, least: float = LEAST, near: int = NEAR) -> DataFrame:
    """(field, value, form, jaccard): all pairs of distinct values and forms of a field with a Jaccard of at least `least`."""
    longest = reference.agg(F.max(F.length("form"))).first()[0] or 0
    # three tokens for each character: longer values cannot reach the similarity with any form
    v = values.filter((F.length("value") > 0) & (F.length("value") <= F.lit(int(longest / least + 1e-9)))).withColumn("toks", tokens(F.col("value")))
    r = reference.select("field", "form").distinct().withColumn("toks", tokens(F.col("form")))
    both = v.select("field", "toks").unionByName(r.select("field", "toks"))
    rarity = both.select("field", F.explode("toks").alias("tok")).groupBy("field", "tok").agg(F.count(F.lit(1)).alias("seen"))
    left, right = cut(_ordered(v, "value", rarity)), cut(_ordered(r, "form", rarity))

    def prefix(d: DataFrame, key: str, at: str, n: str) -> DataFrame:
        size = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
        return d.select("field", key, F.col("n").alias(n), F.posexplode(F.slice("toks", F.lit(1), size)).alias(at, "tok"))

    heads = prefix(right, "form", "j", "nf")
    small = total(right.select(F.size("toks").alias("n")), "n") <= near
    pairs = prefix(left, "value", "i", "nv").join(F.broadcast(heads) if small else heads, ["field", "tok"])
    need = F.ceil((F.col("nv") + F.col("nf")) * least / (1 + least) - 1e-9)
    pairs = pairs.filter((F.col("nf") >= F.col("nv") * least - 1e-9) & (F.col("nv") >= F.col("nf") * least - 1e-9))
    # a pair's first common token is the one with the smallest places; behind it no more can be shared than is left on either side
    first = pairs.filter(F.least(F.col("nv") - F.col("i"), F.col("nf") - F.col("j")) >= need).select("field", "value", "form").distinct()
    sets = right.select("field", "form", F.col("toks").alias("tf"))
    full = first.join(left.select("field", "value", F.col("toks").alias("tv")), ["field", "value"]).join(F.broadcast(sets) if small else sets, ["field", "form"])
    shared = F.size(F.array_intersect("tv", "tf"))
    return full.withColumn("jaccard", shared / (F.size("tv") + F.size("tf") - shared)).filter(F.col("jaccard") >= least).select("field", "value", "form", "jaccard")


def mapped(values: DataFrame, reference: DataFrame, least: float = LEAST) -> DataFrame:
    """(field, value, value_id, form, jaccard): the entry whose spelling is most similar to each distinct cleaned value, if one is similar
    enough. Ties: smaller value_id, then form."""
    spellings = reference.select("field", F.col("spelling").alias("form")).distinct()
    owners = reference.select("field", "spelling", "value_id", "form")
    pairs = similar(values, spellings, least).withColumnRenamed("form", "spelling").join(owners, ["field", "spelling"])
    best = pairs.groupBy("field", "value").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "value_id", "form")).alias("b"))
    return best.select("field", "value", "b.value_id", "b.form", (-F.col("b.less")).alias("jaccard"))


def cells(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, raw): one row per value that is not null or blank."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])).alias("c")
    return df.select(F.col(key).alias("key"), parts).select("key", "c.field", "c.raw").filter(~is_blank(F.col("raw")))


def decide(cells_: DataFrame, reference: DataFrame, least: float = LEAST) -> DataFrame:
    """(field, raw, rows, value_id, form, jaccard) of every distinct value that is not a canonical of its field exactly as written;
    value_id is UNMATCHED where no entry is meant."""
    raw = cells_.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("rows"))
    raw = cut(raw.join(reference.select("field", F.col("canonical").alias("raw")).distinct(), ["field", "raw"], "left_anti").withColumn("value", cleaned(F.col("raw"))))
    found = mapped(raw.select("field", "value").distinct(), forms(reference), least)
    return raw.join(found, ["field", "value"], "left").select("field", "raw", "rows", F.coalesce("value_id", F.lit(UNMATCHED)).cast("long").alias("value_id"), "form", "jaccard")


def assign(cells_: DataFrame, reference: DataFrame, least: float = LEAST) -> DataFrame:
    """(key, field, value_id) of every cell that decide() covers. A value that many rows share is joined by broadcast."""
    decided = cut(decide(cells_, reference, least))
    return join_on_groups(cells_, decided, ["field", "raw"], "rows", total(decided, "rows")).select("key", "field", "value_id")
