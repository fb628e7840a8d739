import json
import urllib.error

import pytest

from vocabula.operators import items as it
from vocabula.sources import imports, pages, registry, store

NOW = "2026-01-01T00:00:00.000Z"


def term(i, name, **more):
    return {"id": i, "name": name, "definition": "d", "aliases": ["x"], "codeLocations": [], "tags": [], "confidence": "manual", "createdAt": NOW, "updatedAt": NOW, **more}


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store.json")
    (tmp_path / "store.json").write_text(json.dumps({"version": "1.2.0", "organization": "o", "lastModified": NOW, "terms": {"a": term("a", "A"), "b": term("b", "B", category="c")}}))
    terms, meta = store.read(spark, path)
    assert {r["id"]: r["category"] for r in terms.collect()} == {"a": None, "b": "c"}
    out = str(tmp_path / "out.json")
    store.write(terms, out, "o", NOW)
    again, meta = store.read(spark, out)
    assert sorted(map(str, again.collect())) == sorted(map(str, terms.collect()))
    assert meta.first()["version"] == store.VERSION
    store.write_parquet(terms, str(tmp_path / "p"))
    assert store.read_parquet(spark, str(tmp_path / "p")).count() == 2


def test_store_missing_broken_and_wrong_version(spark, tmp_path):
    terms, meta = store.read(spark, str(tmp_path / "none.json"), "org")
    assert terms.count() == 0 and meta.first()["organization"] == "org"
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    with pytest.raises(store.StoreError) as e:
        store.read(spark, str(bad))
    assert e.value.code == "PARSE_ERROR"
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"version": "2.0.0", "organization": "o", "lastModified": NOW, "terms": {}}))
    with pytest.raises(store.StoreError) as e:
        store.read(spark, str(old))
    assert e.value.code == "VALIDATION_ERROR"


def test_items_within_projects_come_first(spark):
    doc = {"projects": [{"id": "p1", "name": "One", "items": [{"id": "a", "title": "A"}, {"title": "B"}]}], "items": [{"title": "C", "projectId": "p1"}, {"title": "D"}]}
    rows = {r["title"]: r for r in imports.work_items(spark, text=json.dumps(doc)).collect()}
    assert {t: r["id"] for t, r in rows.items()} == {"A": "a", "B": "json-item-1", "C": "json-item-2", "D": "json-item-3"}
    assert rows["C"]["project_name"] == "One" and rows["D"]["projectId"] == "default" and rows["D"]["labels"] == []
    assert {r["projectId"]: r["name"] for r in imports.projects(imports.work_items(spark, text=json.dumps(doc))).collect()} == {"p1": "One", "default": "default"}


def test_pages_replay_and_property_values(spark, tmp_path):
    db = tmp_path / "db"
    db.mkdir()
    props = {"Name": {"type": "title", "title": [{"plain_text": "T"}, {"plain_text": "1"}]}, "N": {"type": "number", "number": 3}, "S": {"type": "status", "status": {"name": "Doing"}}, "P": {"type": "people"}, "M": {"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, "C": {"type": "checkbox", "checkbox": True}, "E": {"type": "select", "select": None}}
    page = lambda i, **k: {"id": i, "url": "u", "created_time": NOW, "last_edited_time": NOW, "archived": False, "properties": props} | k
    (db / "0.json").write_text(json.dumps({"results": [page("1"), page("2", archived=True)], "has_more": True, "next_cursor": "c"}))
    (db / "1.json").write_text(json.dumps({"results": [page("3"), page("4", last_edited_time="2020")], "has_more": False, "next_cursor": None}))
    spark.dataSource.register(pages.PagesSource)
    rows = spark.read.format("pages").option("base", str(tmp_path)).option("databases", "db").option("modifiedAfter", "2021").load()
    assert sorted(r["id"] for r in rows.collect()) == ["1", "3"]
    assert spark.read.format("pages").option("base", str(tmp_path)).option("databases", "db").option("maxItems", "1").load().count() == 1
    values = {r["name"]: (r["tag"], r["value"]) for r in it.property_values(rows.filter("id = '1'")).collect()}
    assert values == {"Name": ("string", "T1"), "N": ("number", "3"), "S": ("select", "Doing"), "M": ("multi_select", '["a","b"]'), "C": ("boolean", "true")}


def test_schema_terms(spark):
    rows = [("d", {"Status": ("status", ["A"]), "Type": ("select", ["B"]), "Colour": ("select", ["no"]), "Team": ("multi_select", ["C"])})]
    df = spark.createDataFrame(rows, "id string, properties map<string,struct<type:string,options:array<string>>>")
    assert sorted((r["title"], r["type"]) for r in it.schema_terms(df).collect()) == [("A", "status"), ("B", "label"), ("C", "label")]


def test_retries():
    assert pages.retry_delay(0, jitter=lambda: 0) == 1 and pages.retry_delay(9, jitter=lambda: 1) == 30 and pages.retry_delay(0, "7") == 7
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "m", None, None)
        return {"ok": 1}

    assert pages.with_retries(call, waits.append) == {"ok": 1} and len(waits) == 2
    with pytest.raises(urllib.error.HTTPError):
        pages.with_retries(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "m", None, None)), waits.append)
    assert pages.normalize_id("0" * 32) == "00000000-0000-0000-0000-000000000000"


def test_registry(spark):
    pm, scm = registry.built_in()
    assert pm.has("json") and not pm.get("json")
    read = pm.get_or_create("json", {"text": '{"items": [{"title": "x"}]}'})
    assert read(spark).count() == 1 and pm.get("json") is read
    with pytest.raises(ValueError):
        scm.create("github", {})
    pm.register("own", object())
    assert [(r["name"], r["made"]) for r in registry.listing(spark, pm, scm).collect()] == [("json", True), ("pages", False), ("own", True), ("github", False)]
    assert registry.scm_adapter("https://gitlab.com/a/b") == "gitlab" and registry.scm_adapter("https://x.org") is None
    assert registry.config_problems({"token": "x", "databases": ["q"], "other": 1}) == ["unknown key other", "the token has no known prefix", "not a database id: q"]
    assert pm.remove("own") and pm.remove_factory("pages") and not pm.has("pages")


def test_corpus_leaves_out(spark, tmp_path):
    for p in ("src/a.ts", "node_modules/x.ts", "b.min.js", "README.md", "c.bin"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("export class A {}")
    assert sorted(r["path"] for r in imports.corpus(spark, str(tmp_path)).collect()) == ["README.md", "src/a.ts"]
