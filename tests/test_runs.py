"""Runs, look-ups, validation, stores with versions, adapters and tool output on small fixtures."""

import time

import pytest
from pyspark.sql import functions as F

from vocabula.operators import bootstrap, detect, glossary, items, prlearn
from vocabula.scale import progress
from vocabula.sources import registry, store

UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def test_items_are_validated(spark):
    ok = (UUID, "bug", "T", "todo", "none", None, "2025-01-01T00:00:00Z", "2025-01-01T00:00:00.5Z")
    rows = [ok, (None,) * 8, ("x", "Bug", "", "open", "P1", "not a url", "2025", "yesterday"), (*ok[:5], "https://a.b/c", *ok[6:])]
    df = spark.createDataFrame(rows, "id string, type string, title string, status string, priority string, url string, createdAt string, updatedAt string")
    got = [r["problems"] for r in items.item_problems(df).collect()]
    every = ["id", "type", "title", "status", "priority", "createdAt", "updatedAt"]
    assert got == [[], every, [*every[:5], "url", *every[5:]], []]


def test_items_are_looked_up_and_extracted(spark):
    rows = [("a", "p", "bug", "2025-02-01", None), ("b", "p", "task", "2025-03-01", True), ("c", "q", "bug", None, False)]
    df = spark.createDataFrame(rows, "id string, projectId string, item_type string, updatedAt string, archived boolean")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(items.get_item(df, "b")) == ["b"] and ids(items.get_item(df, "z")) == []
    assert items.get_project(df, "p").first()["items"] == 2 and items.get_project(df, "z").count() == 0
    assert ids(items.extracted(df, ["id"])) == ["a", "c"] and ids(items.extracted(df, ["id"], with_archived=True, most=2)) == ["a", "b"]
    assert ids(items.extracted(df, ["id"], types=["bug"], since="2025-01-01")) == ["a"]


def test_roles_of_properties():
    schema = [("Heading", "title"), ("Summary", "rich_text"), ("More", "rich_text"), ("Stage", "select"), ("Tags", "multi_select")]
    assert items.property_roles(schema) == {"title": "Heading", "description": "Summary", "type": "", "status": "Stage", "labels": "Tags", "category": ""}
    assert items.property_roles([], {"type": "Sort"}) == {"title": "Name", "description": "", "type": "Sort", "status": "", "labels": "", "category": ""}


def test_cold_start(spark):
    t = spark.createDataFrame([("a",)], "id string")
    assert glossary.cold_start(t).count() == 0 and glossary.cold_start(t.limit(0), "none", ["do"]).collect() == [(True, "none", ["do"])]


def test_versions_of_a_store(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = (spark.createDataFrame([(x,)], "id string") for x in "ab")
    store.write_parquet(one, path)
    old = store.read_parquet(spark, path)
    store.write_parquet(two, path)
    assert old.first()["id"] == "a" and store.read_parquet(spark, path).first()["id"] == "b"
    store.drop_versions(spark, path)
    assert len(list((tmp_path / "s").glob("v-*"))) == 1 and store.read_parquet(spark, path).first()["id"] == "b"
    with pytest.raises(store.StoreError):
        store.write(two, str(tmp_path / "d.json"), "o", "now", most=0)


def test_adapters(spark):
    pm, scm = registry.built_in()
    pm.register("memory", registry.memory_source([("a", 1)], "id string, n long"))
    status = lambda g, n, c: registry.test_connection(spark, g, n, c).first()
    assert status(pm, "memory", {})["connected"] and not status(pm, "pages", {})["connected"] and status(scm, "x", {})["message"] == "there is no adapter x"
    assert not status(scm, "github", {"path": "/nowhere/at/all"})["connected"]
    assert progress(spark) == []


def test_terms_of_a_bootstrap(spark):
    own = spark.createDataFrame([("A", "a")], "name string, definition string")
    source = lambda d: d.first()["term_source"]
    assert source(bootstrap.chosen_terms(own, own)) == "adapter"
    assert source(bootstrap.chosen_terms(None, own)) == source(bootstrap.chosen_terms(own.limit(0), own)) == "codebase-inferred"
    assert bootstrap.within(60, spark, lambda: own).count() == 1
    slow = F.udf(lambda x: time.sleep(20) or x, "string")
    with pytest.raises(TimeoutError):
        bootstrap.within(1, spark, lambda: own.select(slow("name")).collect())


def test_dry_run(spark):
    done = spark.createDataFrame([("created", 2), ("created", 1), ("updated", 0)], "action string, new_files long")
    assert sorted(map(tuple, prlearn.run_numbers(done, dry_run=True).collect())) == [("would be created", 2, 3), ("would be updated", 1, 0)]


def test_tool_texts(spark):
    rows = [(1, "Read", "src/Ledger.ts", None), (2, "own_tool", "ledger", "x"), (3, None, None, " "), (4, None, "", "the ledger!")]
    calls = spark.createDataFrame(rows, "k long, tool string, i string, o string")
    texts = detect.tool_texts(calls, "k", "tool", "i", "o", own="own_")
    labels = spark.createDataFrame([("t", "ledger"), ("u", "src")], "id string, label string")
    found = detect.matches(texts, labels, "key", "text")
    assert sorted((r["key"], r["term_id"]) for r in found.collect()) == [(1, "t"), (1, "u"), (4, "t")]
    assert {r["signal"] for r in detect.advice(found).collect()} == {"prompt"}


@pytest.mark.parametrize("name", ["detect_labels", "tool_terms", "detect_topk", "detect_context", "tool_advice"])
def test_detection_beyond_the_automaton(spark, monkeypatch, name):
    """No label meets a place by three characters, and the rows are those of the automaton."""
    import __spark_entry__ as entry

    want = sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(detect.matches, "__defaults__", (0,))
    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "window#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(map(tuple, got.collect())) == want
