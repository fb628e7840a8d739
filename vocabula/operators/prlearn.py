"""Terms and code locations learned from pull requests, merged into a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.semantics import strings, wide_trim


def request_address(url: Column) -> Column:
    """owner, repository and number of a pull request's address anywhere in a text; null without one."""
    rx = r"github\.com/([^/\s]+)/([^/\s]+)/pull/(\d+)"
    found = url.rlike(rx)
    return F.when(found, F.struct(F.regexp_extract(url, rx, 1).alias("owner"), F.regexp_extract(url, rx, 2).alias("repo"), F.regexp_extract(url, rx, 3).cast("long").alias("number")))


def error_kind(message: Column) -> Column:
    has = lambda *w: F.coalesce(message.rlike("(?i)" + "|".join(w)), F.lit(False))
    return (
        F.when(has("401", "403"), "AUTH_ERROR").when(has("404"), "NOT_FOUND").when(has("429", "rate limit"), "RATE_LIMITED").when(has("network", "timeout", "econn", "fetch failed"), "NETWORK_ERROR").otherwise("UNKNOWN")
    )


def candidate_terms(prs: DataFrame) -> DataFrame:
    """(number, ord, name): the title without its prefix, and second-level headings of the body that are not usual ones."""
    title = wide_trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), d.COMMIT_PREFIX, ""), r"^\[.+?\]\s*", ""))
    first = prs.select("number", F.lit(-1).alias("ord"), title.alias("name"))
    lines = prs.select("number", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("ord", "line"))
    # a dot does not match a carriage return, so the heading ends before it
    heads = lines.filter(F.col("line").rlike(r"^##\s+\S")).select("number", "ord", wide_trim(F.regexp_extract("line", r"^##\s+(.+)", 1)).alias("name"))
    heads = heads.filter(~F.exists(strings(*d.META_HEADINGS), lambda w: F.contains(F.lower("name"), w)))
    return first.unionByName(heads).filter(F.length("name") > 3)


def relationship(path: Column, status: Column) -> Column:
    has = lambda w: F.contains(path, F.lit(w))
    return F.when(has("test") | has("spec"), "tests").when(has("config"), "configures").when(status == "added", "defines").otherwise("implements")


def locations(prs: DataFrame) -> DataFrame:
    """(number, ord, filePath, relationship, note) of changed code files that were not removed."""
    f = prs.select("number", F.posexplode("changedFiles").alias("ord", "f")).select("number", "ord", "f.*")
    code = F.exists(strings(*d.CODE_EXTENSIONS), lambda e: F.endswith("filename", e))
    note = F.concat(F.lit("From PR: "), F.col("additions").cast("string"), F.lit(" additions, "), F.col("deletions").cast("string"), F.lit(" deletions"))
    return f.filter((F.coalesce("status", F.lit("")) != "removed") & code).select("number", "ord", F.col("filename").alias("filePath"), relationship(F.col("filename"), F.col("status")).alias("relationship"), note.alias("note"))


def learned(prs: DataFrame, terms: DataFrame) -> DataFrame:
    """(name_key, name, action, term_id, new_files, requests): one row per learned name over all requests.

    A name that is a term's name (case aside; of equal names the smallest id) updates it with the files it does not have yet, else it
    creates a term with all of them. Names are aggregated before they meet the glossary, and files by an anti-join.
    """
    names = candidate_terms(prs).select(F.lower("name").alias("name_key"), "name", "number", "ord")
    files = names.select("name_key", "number").distinct().join(locations(prs).select("number", "filePath"), "number").select("name_key", "filePath").distinct()
    known = terms.groupBy(F.lower("name").alias("name_key")).agg(F.min_by(F.struct("id", "codeLocations"), "id").alias("t")).select("name_key", F.col("t.id").alias("term_id"), F.col("t.codeLocations").alias("have"))
    had = known.select("name_key", F.explode("have.filePath").alias("filePath")).distinct()
    fresh = files.join(had, ["name_key", "filePath"], "left_anti").groupBy("name_key").agg(F.count(F.lit(1)).alias("new_files"))
    one = names.groupBy("name_key").agg(F.min_by("name", F.struct("number", "ord")).alias("name"), F.countDistinct("number").alias("requests"))
    return (
        one.join(known.select("name_key", "term_id"), "name_key", "left")
        .join(fresh, "name_key", "left")
        .select("name_key", "name", F.when(F.col("term_id").isNull(), "created").otherwise("updated").alias("action"), "term_id", F.coalesce("new_files", F.lit(0)).alias("new_files"), "requests")
    )


def merged_locations(prs: DataFrame, terms: DataFrame) -> DataFrame:
    """(name_key, filePath, relationship, note): locations to add, of each file the last request's."""
    keys = candidate_terms(prs).select(F.lower("name").alias("name_key"), "number").distinct()
    every = keys.join(locations(prs), "number").groupBy("name_key", "filePath").agg(F.max_by(F.struct("relationship", "note"), F.struct("number", "ord")).alias("l"))
    had = terms.select(F.lower("name").alias("name_key"), F.explode("codeLocations.filePath").alias("filePath")).distinct()
    return every.join(had, ["name_key", "filePath"], "left_anti").select("name_key", "filePath", "l.relationship", "l.note")


def run_numbers(outcome: DataFrame, dry_run: bool = False) -> DataFrame:
    """(action, names, new_files) of learned(); a dry run counts the same but marks its actions as what would be done."""
    prefix = "would be " if dry_run else ""
    return outcome.groupBy(F.concat(F.lit(prefix), "action").alias("action")).agg(F.count(F.lit(1)).alias("names"), F.sum("new_files").alias("new_files"))
