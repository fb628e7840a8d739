"""Tokens of identifiers, paths and sentences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocabula.semantics import SPACE, strings

#: Words that tell nothing in a sentence (fixed values).
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his how i if in into is it its let may my no nor not of on or our own "
    "say she so some than that the their them then there these they this to too up us was we were what when which who whom why will with would you your"
).split()
#: Path segments that tell nothing (fixed values).
GENERIC_SEGMENTS = (
    "src lib dist build out bin test tests spec specs __tests__ __mocks__ node_modules vendor packages apps components utils helpers common "
    "shared core internal public private assets static config configs"
).split()
MIN_LENGTH = 2
_CUT = "\u0001"


def split_camel(token: Column) -> Column:
    """Parts of one token at changes of case and between letters and digits; a token without lower case stays whole."""
    s = F.regexp_replace(token, "([a-z])([A-Z])", f"$1{_CUT}$2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", f"$1{_CUT}$2")
    s = F.regexp_replace(s, r"([a-zA-Z])(\d)", f"$1{_CUT}$2")
    s = F.regexp_replace(s, r"(\d)([a-zA-Z])", f"$1{_CUT}$2")
    return F.when(F.upper(token) == token, F.array(token)).otherwise(F.split(s, _CUT))


def tokenize(text: Column) -> Column:
    """Lower-case tokens of at least two characters, in order, with repeats; null and blank texts have none."""
    rough = F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}_\-./\\]+"), lambda x: x != "")
    parts = F.flatten(F.transform(rough, split_camel))
    return F.filter(F.transform(parts, F.lower), lambda x: F.length(x) >= MIN_LENGTH)


def tokenize_path(path: Column) -> Column:
    """Distinct tokens of a file path without its extension and generic segments."""
    bare = F.regexp_replace(F.coalesce(path, F.lit("")), r"(?<=[^/])\.[^./]*\z", "")
    segments = F.filter(F.split(bare, r"[/\\]"), lambda x: (x != "") & ~F.array_contains(strings(*GENERIC_SEGMENTS), F.lower(x)))
    return F.array_distinct(F.flatten(F.transform(segments, tokenize)))


def tokenize_sentence(text: Column) -> Column:
    """Lower-case words without stop words; hyphens stay, all other marks and letters beyond ASCII separate."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^A-Za-z0-9_{SPACE}\-]", " "), rf"[{SPACE}]+")
    return F.filter(F.transform(words, F.lower), lambda x: (F.length(x) >= MIN_LENGTH) & ~F.array_contains(strings(*STOP_WORDS), x))


def normalize(text: Column) -> Column:
    """Form for comparison: lower case, joining marks as spaces, other marks gone, single spaces."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_\-]", " ")
    s = F.regexp_replace(s, rf"[^A-Za-z0-9_{SPACE}]", "")
    return F.trim(F.regexp_replace(s, rf"[{SPACE}]+", " "))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]", "")
