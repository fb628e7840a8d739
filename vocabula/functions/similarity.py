"""Similarities of token sets and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocabula.functions.tokens import squeeze

PREFIX_WEIGHT = 0.7


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _covered(a: Column, b: Column, weight: float) -> Column:
    """Mean over a's tokens: 1 if b has it, else the best length ratio of tokens of three characters or more, one the start of the other."""

    def best(x: Column) -> Column:
        near = F.filter(b, lambda y: (F.length(y) >= 3) & (F.startswith(y, x) | F.startswith(x, y)))
        ratio = F.transform(near, lambda y: F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y)) * F.lit(weight))
        return F.when(F.array_contains(b, x), F.lit(1.0)).when(F.length(x) >= 3, F.coalesce(F.array_max(ratio), F.lit(0.0))).otherwise(F.lit(0.0))

    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + best(x)) / F.size(a)


def partial_overlap(a: Column, b: Column, weight: float = PREFIX_WEIGHT) -> Column:
    """Geometric mean of both directions' coverage; if one is nothing, 0.7 times the other. a, b: distinct tokens.

    Most pairs have no token that starts another: then coverage is the share of common tokens, which needs no nested loops.
    """
    common = F.size(F.array_intersect(a, b)).cast("double")
    starts = lambda x: F.transform(F.filter(x, lambda t: F.length(t) >= 3), lambda t: F.left(t, F.lit(3)))
    near = F.arrays_overlap(starts(F.array_except(a, b)), starts(b)) | F.arrays_overlap(starts(a), starts(F.array_except(b, a)))

    def mean(ab: Column, ba: Column) -> Column:
        pair = F.array(F.struct(ab.alias("ab"), ba.alias("ba")))  # evaluated once
        return F.get(F.transform(pair, lambda p: F.when((p["ab"] == 0) | (p["ba"] == 0), F.greatest(p["ab"], p["ba"]) * 0.7).otherwise(F.sqrt(p["ab"] * p["ba"]))), F.lit(0))

    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(near, mean(_covered(a, b, weight), _covered(b, a, weight)))
        .when(common == 0, F.lit(0.0))
        .otherwise(F.sqrt((common / F.size(a)) * (common / F.size(b))))
    )


def exact_name(a: Column, b: Column) -> Column:
    """1 for equal normalized names, 0.95 without spaces, 0.6 times the length ratio if one holds the other (three characters or more)."""
    x, y = squeeze(a), squeeze(b)
    inner = (F.length(x) >= 3) & (F.length(y) >= 3)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(x == y, F.lit(0.95))
        .when(inner & F.contains(y, x), F.lit(0.6) * (F.length(x) / F.length(y)))
        .when(inner & F.contains(x, y), F.lit(0.6) * (F.length(y) / F.length(x)))
        .otherwise(F.lit(0.0))
    )


def alias_name(aliases: Column, b: Column) -> Column:
    """Best of 1 for an equal alias and 0.9 for one that is equal without spaces."""
    each = F.transform(aliases, lambda a: F.when(a == b, F.lit(1.0)).when(squeeze(a) == squeeze(b), F.lit(0.9)).otherwise(F.lit(0.0)))
    return F.when(b == "", F.lit(0.0)).otherwise(F.coalesce(F.array_max(each), F.lit(0.0)))


def best_overlap(sets: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sets, lambda a: partial_overlap(a, b))), F.lit(0.0))
