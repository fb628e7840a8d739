"""Case conventions of identifiers and small text helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocabula.semantics import SPACE


def _words(s: Column) -> Column:
    return F.filter(F.split(s, rf"[{SPACE}\-_]+"), lambda x: x != "")


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1_000_000)))


def pascal_case(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), _capital), "")


def camel_case(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), lambda x, i: F.when(i == 0, F.lower(x)).otherwise(_capital(x))), "")


def snake_case(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), F.lower), "_")


def kebab_case(s: Column) -> Column:
    return F.array_join(F.transform(_words(s), F.lower), "-")


def convention(s: Column) -> Column:
    """snake, kebab, pascal, camel or unknown; marks decide before case does."""
    return (
        F.when(F.contains(s, F.lit("_")), "snake_case")
        .when(F.contains(s, F.lit("-")), "kebab-case")
        .when(s.rlike("^[A-Z]"), "PascalCase")
        .when(s.rlike("[A-Z]"), "camelCase")
        .otherwise("unknown")
    )


def in_convention(name: Column, style: Column) -> Column:
    return (
        F.when(style == "PascalCase", pascal_case(name))
        .when(style == "snake_case", snake_case(name))
        .when(style == "kebab-case", kebab_case(name))
        .otherwise(camel_case(name))
    )


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 3)), F.lit("...")))


def quoted(s: Column) -> Column:
    r"""A literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def humanize(s: Column) -> Column:
    """Identifier as words, each with a capital first letter."""
    spaced = F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.regexp_replace(spaced, r"[_\-]+", " "), rf"[{SPACE}]+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1_000_000))), " ")
