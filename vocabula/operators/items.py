"""Work items and pages: flattening, normalisation, filters, terms and term candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabula import dictionaries as d
from vocabula.semantics import SPACE, lookup, strings, wide_trim


def folded(s: Column) -> Column:
    return wide_trim(F.lower(s))


def status_category(label: Column, table: dict[str, str] = d.ITEM_STATUS) -> Column:
    return lookup(folded(label), table, F.lit("unknown"))


def item_type(written: Column, default: str = "task") -> Column:
    return lookup(folded(written), d.ITEM_TYPES, F.lit(default))


def page_kind(written: Column, default: str = "page") -> Column:
    return lookup(folded(written), d.PAGE_KINDS, F.lit(default))


def resolved(items: DataFrame) -> DataFrame:
    """Adds the canonical type and kind and the status category; missing labels count as unknown."""
    t = item_type(F.col("type"))
    return items.withColumns(
        {"item_type": t, "item_kind": lookup(t, d.TYPE_KIND, F.lit("other")), "status_category": status_category(F.coalesce("status", F.lit(""))), "status_label": F.coalesce("status", F.lit(""))}
    )


def numbered_ids(items: DataFrame, order: Sequence[str], prefix: str = "json-item-") -> DataFrame:
    """Rows without id get numbers in the given order."""
    from vocabula.scale import global_rank

    without = global_rank(items.filter("id IS NULL"), list(order), "_n").withColumn("id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")
    return items.filter("id IS NOT NULL").unionByName(without)


def flatten_import(doc: DataFrame) -> DataFrame:
    """Items of an import document (projects with items, and items on their own): those within projects first. (group, ord, project, item)"""
    within = doc.select(F.posexplode("projects").alias("p", "project")).select(F.lit(0).alias("group"), "p", F.posexplode("project.items").alias("i", "item"), F.col("project.id").alias("project_id"), F.col("project.name").alias("project_name"))
    alone = doc.select(F.posexplode("items").alias("i", "item")).select(F.lit(1).alias("group"), F.lit(0).alias("p"), "i", "item", F.coalesce("item.projectId", F.lit("default")).alias("project_id"))
    names = doc.select(F.explode("projects").alias("q")).select(F.col("q.id").alias("project_id"), F.col("q.name").alias("project_name"))
    alone = alone.join(names, "project_id", "left")
    return within.unionByName(alone.select(*within.columns)).select("group", F.struct("p", "i").alias("ord"), "project_id", "project_name", "item.*")


def custom_fields(items: DataFrame, key: str = "id", column: str = "customFields") -> DataFrame:
    """(key, name, tag, value): each custom field of JSON objects with its runtime type: string, number, boolean, multi_select, unknown.

    Broken JSON has no fields; value is the text of strings and the JSON of all others.
    """
    named = items.select(F.col(key).alias("key"), F.explode(F.from_json(column, "map<string,string>")).alias("name", "text"), F.try_parse_json(column).alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), F.col("name"), F.lit("']")), "variant"))
    tag = (
        F.when(kind == "STRING", "string")
        .when(kind.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "multi_select")
        .otherwise("unknown")
    )
    return named.select("key", "name", tag.alias("tag"), F.col("text").alias("value"))


# filters ------------------------------------------------------------------------------------------------------------
def listed(items: DataFrame, project: str | None = None, category: str | None = None, labels: Sequence[str] | None = None, since: str | None = None, text: str | None = None) -> DataFrame:
    """Conjunction of the filters given; times are compared as ISO texts, `since` inclusive."""
    if project:
        items = items.filter(F.col("projectId") == project)
    if category:
        items = items.filter(F.col("status_category") == category)
    if labels:
        items = items.filter(F.arrays_overlap("labels", strings(*labels)))
    if since:
        items = items.filter(F.col("updatedAt") >= since)
    if text:
        q = F.lit(text.lower())
        items = items.filter(F.contains(F.lower("title"), q) | F.coalesce(F.contains(F.lower("description"), q), F.lit(False)))
    return items


def get_item(items: DataFrame, item_id: str) -> DataFrame:
    """The item of an id: one row or none."""
    return items.filter(F.col("id") == F.lit(item_id)).limit(1)


def get_project(items: DataFrame, project_id: str) -> DataFrame:
    """(projectId, items, updated) of one project; no row if it has no items."""
    return items.filter(F.col("projectId") == F.lit(project_id)).groupBy("projectId").agg(F.count(F.lit(1)).alias("items"), F.max("updatedAt").alias("updated"))


def extracted(items: DataFrame, order: Sequence[str], project: str | None = None, types: Sequence[str] | None = None, since: str | None = None, with_archived: bool = False, most: int | None = None) -> DataFrame:
    """Items that a run extracts: of a project, of canonical types, updated since a time (ISO text, inclusive), archived ones left out
    unless they are wanted (column archived, where there is one); at most `most`, the first in `order`."""
    items = listed(items, project=project, since=since)
    if types:
        items = items.filter(F.col("item_type").isin(*types))
    if not with_archived and "archived" in items.columns:
        items = items.filter(~F.coalesce(F.col("archived"), F.lit(False)))
    return items.orderBy(*order).limit(most) if most else items


# validation of assembled items --------------------------------------------------------------------------------------
def is_member(value: Column, members: Sequence[str]) -> Column:
    """Membership of a fixed list, exactly as written; null is none."""
    return F.coalesce(value.isin(*members), F.lit(False))


def item_problems(items: DataFrame) -> DataFrame:
    """Adds problems: names of the fields of an item (id, type, title, status, priority, url, createdAt, updatedAt) that break its rules, in
    this order. url may be missing, all others may not."""
    rules = {
        "id": F.coalesce(F.col("id").rlike(d.UUID_FORM), F.lit(False)),
        "type": is_member(F.col("type"), d.PM_ITEM_TYPES),
        "title": F.coalesce(F.length("title") > 0, F.lit(False)),
        "status": is_member(F.col("status"), d.PM_STATUSES),
        "priority": is_member(F.col("priority"), d.PM_PRIORITIES),
        "url": F.col("url").isNull() | F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$"),
        "createdAt": F.coalesce(F.col("createdAt").rlike(d.DATETIME_FORM), F.lit(False)),
        "updatedAt": F.coalesce(F.col("updatedAt").rlike(d.DATETIME_FORM), F.lit(False)),
    }
    return items.withColumn("problems", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))


def page(items: DataFrame, order: Sequence[str], cursor: int = 0, size: int = 100) -> DataFrame:
    """One page of a listing."""
    return items.orderBy(*order).offset(cursor).limit(size)


# terms --------------------------------------------------------------------------------------------------------------
def slug(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), rf"[{SPACE}]+", "-")


def as_terms(items: DataFrame, order: str, origin: str = "json-import", phrase: str = " from JSON import") -> DataFrame:
    """Terms of resolved() items with a title; of equal titles (case and outer spaces aside) the first."""
    title = wide_trim(F.col("title"))
    kind = F.col("item_type")
    label = F.col("status_label")
    made = F.concat(
        F.upper(F.left(kind, F.lit(1))), F.substring(kind, 2, 100), F.lit(phrase),
        F.when(F.coalesce("projectId", F.lit("")) != "", F.concat(F.lit(' in project "'), F.col("projectId"), F.lit('"'))).otherwise(""),
        F.when(label != "", F.concat(F.lit(" (status: "), label, F.lit(")"))).otherwise(""), F.lit("."),
    )
    text = F.col("description")
    definition = F.when(F.coalesce(text, F.lit("")) == "", made).when(F.length(text) > 500, F.concat(F.left(text, F.lit(500)), F.lit("..."))).otherwise(text)
    tags = F.array_distinct(F.concat("labels", F.array(kind, F.lit(origin)), F.when(label != "", F.array(F.concat(F.lit("status:"), slug(label)))).otherwise(F.array().cast("array<string>"))))
    rows = items.filter(title != "").select(
        folded(F.col("title")).alias("key"), F.col(order).alias("ord"), title.alias("name"), definition.alias("definition"), F.col("projectId").alias("category"), tags.alias("tags"), F.col("id").alias("externalId"), "url"
    )
    rest = [c for c in rows.columns if c not in ("key", "ord")]
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("r.*")


def extraction_statistics(items: DataFrame, terms: DataFrame) -> DataFrame:
    """(measure, n): items by type, items, terms, and items that gave no term of their own."""
    by = items.groupBy(F.concat(F.lit("type:"), F.col("item_type")).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    n = items.agg(F.lit("items").alias("measure"), F.count(F.lit(1)).alias("n"))
    t = terms.agg(F.lit("terms").alias("measure"), F.count(F.lit(1)).alias("n"))
    skipped = n.unionByName(t).agg(F.lit("skipped").alias("measure"), F.sum(F.when(F.col("measure") == "items", F.col("n")).otherwise(-F.col("n"))).alias("n"))
    return by.unionByName(n).unionByName(t).unionByName(skipped)


def term_candidates(items: DataFrame, order: str, min_frequency: int = 1) -> DataFrame:
    """(projectId, term, frequency, n_items, context): titles of a project with how often they occur.

    The context is a snippet of 200 characters that gives way to any longer description on the way: so the last description of
    more than 200 characters if there is one, else the first of the longest snippets. Both are mergeable aggregates.
    """
    rows = items.filter(wide_trim(F.col("title")) != "").select(
        "projectId", folded(F.col("title")).alias("key"), F.col(order).alias("ord"), wide_trim(F.col("title")).alias("term"), "id", F.coalesce("description", F.lit("")).alias("text"), "item_type"
    )
    long = F.length("text") > 200
    fallback = F.concat("item_type", F.lit(" in "), F.coalesce("projectId", F.lit("unknown project")))
    g = rows.groupBy("projectId", "key").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.countDistinct("id").alias("n_items"),
        F.min_by("term", "ord").alias("term"),
        F.max_by(F.left("text", F.lit(200)), F.when(long, F.col("ord"))).alias("last_long"),
        F.max(F.when(long, 1)).alias("any_long"),
        F.max(F.when(F.col("text") != "", F.struct(F.length("text").alias("n"), (-F.col("ord")).alias("o"), "text"))).alias("best"),
        F.min_by(F.when(F.col("text") == "", fallback), "ord").alias("first_made"),
    )
    short = F.when(F.col("first_made").isNull(), F.col("best.text")).when(F.coalesce(F.col("best.n"), F.lit(0)) > F.length("first_made"), F.col("best.text")).otherwise(F.col("first_made"))
    return g.filter(F.col("frequency") >= min_frequency).select("projectId", "term", "frequency", "n_items", F.when(F.col("any_long") == 1, F.col("last_long")).otherwise(short).alias("context"))


# pages of external databases ----------------------------------------------------------------------------------------
def schema_terms(databases: DataFrame) -> DataFrame:
    """(database_id, title, type, property): options of status properties, of selects that name a taxonomy and of multi-selects that
    name labels, from (id, properties: map of structs with type and options)."""
    p = databases.select(F.col("id").alias("database_id"), F.explode("properties").alias("property", "p"))
    name = F.lower("property")
    has = lambda words: F.exists(strings(*words), lambda w: F.contains(name, w))
    kind = F.col("p.type")
    wanted = (kind == "status") | ((kind == "select") & has(d.TAXONOMY_WORDS)) | ((kind == "multi_select") & has(d.LABEL_WORDS))
    return p.filter(wanted).select("database_id", F.explode("p.options").alias("title"), F.when(kind == "status", "status").otherwise("label").alias("type"), "property")


#: Roles of a database's properties: names that have them, in order, and the type that has them (fixed values). By name first or by type first.
ROLES = {
    "title": ("type", [], "title", "Name"),
    "description": ("name", ["description", "summary", "details"], "rich_text", ""),
    "type": ("name", ["type", "item type", "kind"], None, ""),
    "status": ("type", ["status", "state", "stage"], "status", ""),
    "labels": ("name", ["tags", "labels", "areas", "domains", "components"], "multi_select", ""),
    "category": ("name", ["category", "area", "domain", "team"], None, ""),
}


def property_roles(schema: Sequence[tuple[str, str]], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Property of each role in a database's schema, (name, type) in order: the one named explicitly, else found by name (in any case) or type,
    else the default."""

    def found(first: str, names: list[str], kind: str | None) -> str | None:
        by_name = next((p for n in names for p, _ in schema if p.lower() == n), None)
        by_type = next((p for p, t in schema if kind is not None and t == kind), None)
        return (by_type or by_name) if first == "type" else (by_name or by_type)

    return {role: (explicit or {}).get(role) or found(first, names, kind) or default for role, (first, names, kind, default) in ROLES.items()}


def property_values(pages: DataFrame, column: str = "properties") -> DataFrame:
    """(id, name, tag, value): property values of pages (JSON text: name -> tagged value) as tagged values; other kinds are left out."""
    p = pages.select("id", F.explode(F.from_json(column, "map<string,string>")).alias("name", "json"))
    get = lambda path: F.get_json_object("json", path)
    kind = get("$.type")
    plain = lambda field: F.array_join(F.transform(F.from_json(get(f"$.{field}"), "array<struct<plain_text:string>>"), lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")
    names = F.to_json(F.transform(F.from_json(get("$.multi_select"), "array<struct<name:string>>"), lambda x: x["name"]))
    rules = [
        ("title", "string", plain("title")),
        ("rich_text", "string", plain("rich_text")),
        ("select", "select", get("$.select.name")),
        ("multi_select", "multi_select", names),
        ("status", "select", get("$.status.name")),
        ("number", "number", get("$.number")),
        ("checkbox", "boolean", get("$.checkbox")),
        ("url", "url", get("$.url")),
        ("date", "date", get("$.date.start")),
        ("created_time", "date", get("$.created_time")),
        ("last_edited_time", "date", get("$.last_edited_time")),
    ]
    made = F.coalesce(*[F.when((kind == k) & v.isNotNull(), F.struct(F.lit(t).alias("tag"), v.alias("value"))) for k, t, v in rules])
    return p.select("id", "name", made.alias("m")).filter("m IS NOT NULL").select("id", "name", "m.*")
