"""Search, folds, impact, suggestions, text and source parsers."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocabula.operators import detect, docs, glossary, hierarchy, impact, items, nested, orphans, prlearn, ranking, scan, signals, substrings, suggest
from vocabula.operators import textparse as tp
from vocabula.scale import global_rank
from vocabula.sources.store import TERM

NOW = "2026-01-01T00:00:00.000Z"


def terms(spark, *rows):
    base = {"definition": "", "aliases": [], "codeLocations": [], "category": None, "tags": [], "source": None, "confidence": "manual", "coupling": None, "createdAt": NOW, "updatedAt": NOW}
    return spark.createDataFrame([{"t": base | r} for r in rows], f"t {TERM}").select("t.*")


def loc(path, symbol=None, relationship="defines"):
    return {"filePath": path, "symbol": symbol, "lineRange": None, "relationship": relationship, "note": None}


# search -------------------------------------------------------------------------------------------------------------
def test_search_points(spark):
    t = terms(spark, {"id": "1", "name": "Sprint Velocity", "aliases": ["velocity", "SV"]}, {"id": "2", "name": "Other", "aliases": ["auth flow", "auth"]}, {"id": "3", "name": "N", "definition": "about velocity", "category": "velocity"})
    assert {r["id"]: r["score"] for r in glossary.search(t, " Velocity ").collect()} == {"1": 130, "3": 30}
    assert {r["id"]: r["score"] for r in glossary.search(t, "auth").collect()} == {"2": 40}
    assert glossary.search(t, "  ").count() == 0 and glossary.search(t.limit(0), "x").count() == 0


def test_changes(spark):
    t = terms(spark, {"id": "1", "name": "A", "coupling": {"score": 0.5, "signals": 1, "sources": [], "lastSeen": "2025-01-01"}}, {"id": "2", "name": "B"})
    new = glossary.create(t, t.filter("id = '1'").withColumn("id", F.lit("9")), NOW)
    assert new.filter("id = '9'").first()["coupling"] is None and new.count() == 3
    up = glossary.update(t, spark.createDataFrame([("2", "C")], "id string, name string"), "later")
    assert {r["id"]: (r["name"], r["updatedAt"]) for r in up.collect()} == {"1": ("A", NOW), "2": ("C", "later")}
    kept, gone = glossary.remove(t, spark.createDataFrame([("1",), ("1",), ("x",)], "id string"))
    assert [r["id"] for r in kept.collect()] == ["2"] and [r["id"] for r in gone.collect()] == ["1"]
    assert glossary.violations(terms(spark, {"id": None, "name": "A", "aliases": None})).count() == 2
    assert [r["id"] for r in glossary.query_context(t, "a").collect()] == ["1"]
    assert glossary.get_term(t, term_id="2", name="A").first()["id"] == "2"


# folds --------------------------------------------------------------------------------------------------------------
def test_coupling_decay(spark):
    days = [("manual", "2024-01-01"), ("pr", "2024-03-01"), ("prompt", "2024-12-01")]
    rows = [("t", s, dt.date.fromisoformat(x)) for s, x in days] + [("u", "manual", dt.date(2024, 1, 1))] * 9
    got = {r["term_id"]: r for r in signals.coupling(signals.daily(spark.createDataFrame(rows, "term_id string, signal string, day date"))).collect()}
    assert (got["t"]["score"], got["t"]["signals"]) == (0.30, 3) and got["u"]["score"] == 1.0


def test_decay_limit(spark):
    def score(second):
        rows = [("t", "manual", dt.date(2024, 1, 1)), ("t", "manual", second)]
        return signals.coupling(signals.daily(spark.createDataFrame(rows, "term_id string, signal string, day date"))).first()["score"]

    assert score(dt.date(2024, 1, 1) + dt.timedelta(180)) == 0.4 and score(dt.date(2024, 1, 1) + dt.timedelta(181)) == 0.3


def test_enrichment(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(1, at, "query", ["t", "u"], " Ab ", None), (2, at, "query", ["t"], "cd", None), (3, at, "query", ["t"], " ", None), (4, at, "code-location-added", ["t"], None, None), (5, at, "term-verified", ["t"], None, None)]
    rows += [(6 + i, at, "access", ["t"], None, None) for i in range(3)] + [(20, at, "access", None, None, None)]
    u = spark.createDataFrame(rows, "event_id long, ts timestamp, type string, termIds array<string>, query string, client string")
    e = {r["term_id"]: r for r in signals.enrichment(u).collect()}
    assert e["t"]["score"] == pytest.approx(0.61) and e["t"]["patterns"] == ["ab", "cd"]
    b = {(r["query"], r["term_id"]): r["boost"] for r in signals.boosts(signals.query_terms(u), signals.enrichment(u)).collect()}
    assert b[("ab", "t")] == pytest.approx(0.18)
    assert [tuple(r) for r in signals.related(u, spark.createDataFrame([("u",)], "term_id string")).collect()] == [("u", "t", 1)]


def test_quality(spark):
    r = spark.createDataFrame([(1, 0.61, "manual", 1, 1), (0, 0.0, "ai-suggested", 2, 2)], "locations int, enrichment double, confidence string, base_rank int, enriched_rank int")
    assert ranking.quality(r).first()["quality"] == pytest.approx(0.47625)
    assert ranking.quality(r.limit(0)).first()["quality"] == 0


def test_global_rank(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 37, F.lit(101)))
    got = sorted((r["rank"], r["x"], r["id"]) for r in global_rank(df, [F.col("x").desc(), F.col("id")]).collect())
    assert [g[0] for g in got] == list(range(1, 1001)) and [g[1:] for g in got] == sorted((g[1:] for g in got), key=lambda v: (-v[0], v[1]))
    assert global_rank(df.limit(0), ["x"]).count() == 0


# impact -------------------------------------------------------------------------------------------------------------
def test_rename_suggestions(spark):
    t = terms(spark, {"id": "1", "name": "Sprint Velocity", "codeLocations": [loc("src/metrics/velocity.ts", "calculateVelocity"), loc("src/metrics/velocity.ts", "calculateVelocity"), loc("src/sprint-velocity/a.ts", None, "tests")]})
    found = impact.symbols(impact.matched_terms(t, "velocity"))
    files = impact.files(found)
    change = suggest.Change("rename", "Sprint Velocity", "why", new="Iteration Throughput")
    rows = suggest.suggestions(found, files, change).collect()
    assert [(r["kind"], r["priority"], r["after"]) for r in rows if r["filePath"] == "src/metrics/velocity.ts"] == [("symbol-rename", "critical", "iterationThroughput"), ("comment-update", "optional", "/** Handles Iteration Throughput logic */")]
    assert [r["after"] for r in rows if r["kind"] == "file-rename"] == ["src/iteration-throughput/a.ts"]
    assert [r["kind"] for r in rows if r["filePath"] == suggest.DEPENDENTS] == ["import-update"]
    assert {r["filePath"] for r in suggest.suggestions(found, files, change, with_tests=False).collect()} == {"src/metrics/velocity.ts"}
    assert len(suggest.suggestions(found, files, change, per_file=1, most=2).collect()) == 2
    for kind in ("redefine", "deprecate", "split", "merge", "relocate"):
        assert suggest.suggestions(found, files, suggest.Change(kind, "Sprint Velocity", "why")).count() >= 2
    with pytest.raises(ValueError):
        suggest.suggestions(found, files, suggest.Change("other", "x"))


# texts --------------------------------------------------------------------------------------------------------------
def test_intent_and_titles():
    assert tp.intent("Create an epic") == ("create", 0.85) and tp.intent("- a\n- b") == ("create", 0.5) and tp.intent("Plan\n- a") == ("decompose", 0.6)
    assert tp.intent("As a user, I want x") == ("create", 0.95) and tp.intent("") == ("unknown", 0.0)
    assert tp.certainty(0.85, [], 1) == 0.79
    assert [(t[0], t[1]) for t in tp.titles("Big plan:\n- Epic: One\n  - [Task] Two\n1. Three")] == [("Big plan:", None), ("One", "epic"), ("Two", "task"), ("Three", None)]


def test_entities_and_relations():
    e = tp.entities("High priority bug report, assigned to Kim Lee, due Jan 5, 2026 #api P1 p1")
    assert [(x[0], x[2]) for x in e] == [("item_type", "bug"), ("priority", "high"), ("priority", "high"), ("label", "api"), ("person", "Kim Lee"), ("date", "due Jan 5, 2026"), ("date", "Jan 5, 2026")]
    assert all("High priority bug report, assigned to Kim Lee, due Jan 5, 2026 #api P1 p1"[x[3] : x[4]] == x[1] for x in e)
    assert tp.relations(tp.titles("Head\n- Story: a\n  - b")) == [("Head", "epic", "a", "story"), ("Head", "epic", "b", "story"), ("a", "story", "b", "task")]


def test_text_rows(spark):
    df = spark.createDataFrame([(1, "Create task x"), (2, None), (3, ""), (4, "y " * 50_000)], "id long, t string")
    assert tp.parsed(df, "id", "t").count() == 4 and tp.entity_rows(df.limit(0), "id", "t").count() == 0
    assert tp.item_rows(df, "id", "t").filter("note_id = 1").first()["type"] == "task"


def test_markdown():
    text = "# **Auth** flow #\n```\n# no\n```\n**Bold** and __Bold__\n| Term | `Code` |\n|---|:-:|\n# CR\r\n| 12 | TODO |"
    assert [(c[0], c[1], c[2]) for c in docs.candidates(text)] == [("Auth flow", 1, "header"), ("Bold", 5, "bold"), ("Term", 6, "table-cell"), ("Code", 6, "table-cell")]
    assert docs.candidates("") == []


def test_sources(spark):
    ts = "/**\n * Entry\n */\nexport class A {\n  async run(x) {\n    if (x) { return }\n  }\n}\nexport const f = async (a) => a;\nconst K = 1;\nexport const LIMIT = 2;\nexport enum E {\n}\n"
    got = {(c[0], c[2]): c for c in scan.parse("a/b.ts", ts, scan.TYPESCRIPT)}
    assert got[("A", "class")][3:5] == (4, 8) and got[("A.run", "function")][5].startswith("Exported async function run")
    assert {k for k in got} == {("", "module"), ("A", "class"), ("A.run", "function"), ("f", "function"), ("LIMIT", "constant"), ("E", "enum")} and got[("", "module")][5] == "Entry"
    py = '"""Top."""\nMAX = 1\nclass _C(B):\n    """Doc."""\n    def m(self):\n        pass\n\ndef f():\n    return 1\n'
    assert [(c[0], c[2], c[3], c[4], c[5]) for c in scan.parse("x.py", py, scan.PYTHON)] == [("", "module", 1, 10, "Top."), ("_C", "class", 3, 7, "Doc."), ("_C.m", "function", 5, 7, "Method m"), ("f", "function", 8, 10, "Function f"), ("MAX", "constant", 2, None, "Constant MAX")]
    rows = scan.scanned(spark.createDataFrame([("a.ts", ts), ("b.py", None), ("c.zip", "x")], "path string, content string")).collect()
    assert sum(r["problem"] is None for r in rows) == 6 and [r["filePath"] for r in rows if r["problem"]] == ["b.py"]
    d = {r["id"]: (r["children"], r["description"]) for r in scan.directories(spark.createDataFrame([("src/x/a.ts",), ("src/x/b.ts",), ("dist/c.ts",)], "path string")).collect()}
    assert d == {"src": (1, "Main source code directory"), "src/x": (2, "Directory containing 2 items")}


def test_pull_requests(spark):
    prs = spark.createDataFrame([(1, "feat: Add payment module", "## Payment Gateway\n## Test Plan\n## Preview mode", [{"filename": "a/pay.ts", "status": "added"}, {"filename": "b.md", "status": "added"}, {"filename": "latest.ts", "status": "modified"}, {"filename": "gone.ts", "status": "removed"}]), (2, None, None, None)], "number long, title string, body string, changedFiles array<struct<filename:string,status:string,additions:long,deletions:long>>")
    assert [r["name"] for r in prlearn.candidate_terms(prs).orderBy("ord").collect()] == ["Add payment module", "Payment Gateway"]
    assert {r["filePath"]: r["relationship"] for r in prlearn.locations(prs).collect()} == {"a/pay.ts": "defines", "latest.ts": "tests"}
    t = terms(spark, {"id": "x", "name": "payment gateway", "codeLocations": [loc("a/pay.ts")]})
    assert {r["name"]: (r["action"], r["new_files"]) for r in prlearn.learned(prs, t).collect()} == {"Add payment module": ("created", 2), "Payment Gateway": ("updated", 1)}
    url = spark.createDataFrame([("see https://github.com/o/r/pull/12/files",), ("x",)], "u string").select(prlearn.request_address(F.col("u")).alias("a"), prlearn.error_kind(F.col("u")).alias("e")).collect()
    assert tuple(url[0]["a"]) == ("o", "r", 12) and url[1]["a"] is None and url[1]["e"] == "UNKNOWN"


@pytest.mark.parametrize("most", [10_000, 0])
def test_detect(spark, most):
    labels = spark.createDataFrame([("1", "auth"), ("1", "Auth Service"), ("2", "c++"), ("3", "용어"), ("4", " "), ("5", "x_y"), ("6", "db")], "id string, label string")
    texts = spark.createDataFrame([(1, "the auth service"), (2, "auth도 author"), (3, "C++ and 용어를"), (4, None), (5, "ax_y x_y"), (6, "DB"), (7, "mdb")], "k long, t string")
    got = {(r["key"], r["term_id"], r["label"]) for r in detect.matches(texts, labels, "k", "t", most=most).collect()}
    assert got == {(1, "1", "Auth Service"), (2, "1", "auth"), (3, "2", "c++"), (3, "3", "용어"), (5, "5", "x_y"), (6, "6", "db")}


def test_candidates_context(spark):
    rows = [("p", "A", "1", 1, "", "task"), ("p", "a ", "2", 2, "x" * 300, "task"), ("p", "A", "3", 3, "y" * 250, "bug"), ("p", "B", "4", 4, "", "bug"), ("p", "B", "5", 5, "short", "bug"), ("p", " ", "6", 6, "", "bug")]
    df = spark.createDataFrame(rows, "projectId string, title string, id string, ord int, description string, item_type string")
    assert {r["term"]: (r["frequency"], r["context"]) for r in items.term_candidates(df, "ord").collect()} == {"A": (3, "y" * 200), "B": (2, "bug in p")}


# general training-data operators ------------------------------------------------------------------------------------
def test_orphans(spark):
    at = lambda s: dt.datetime.fromisoformat(s)
    rows = [(1, ["a", "a", "b", None, " "], at("2025-01-05")), (2, ["a"], at("2024-12-31")), (3, ["a"], at("2025-02-01")), (4, None, None), (5, ["a", "zz"], None)] + [(100 + i, ["a"], at("2025-01-06")) for i in range(3000)]
    refs = orphans.references(spark.createDataFrame(rows, "k long, ids array<string>, at timestamp").withColumn("space", F.lit("clash")), "s", "term", "k", "ids", "at", many=True)
    alive = orphans.lifetimes(spark.createDataFrame([("a", at("2025-01-03"), None), ("a", at("2025-01-01"), at("2025-02-01")), ("c", at("2020-01-01"), None)], "id string, f timestamp, u timestamp"), "term", "id", "f", "u")
    got = orphans.orphans(refs, alive)
    assert sorted((r["row_key"], r["ref_key"]) for r in got.collect()) == [(1, "b"), (2, "a"), (3, "a"), (5, "zz")]
    assert {r["period"]: r["orphans"] for r in orphans.orphan_counts(got).collect()} == {"2025-01": 1, "2024-12": 1, "2025-02": 1, "": 1}
    assert orphans.orphans(refs.limit(0), alive).count() == 0 and orphans.orphans(refs, alive.limit(0)).count() > 3000


@pytest.mark.parametrize("slow", [1, 10**6])
def test_hierarchy(spark, monkeypatch, slow):
    monkeypatch.setattr(hierarchy, "SLOW", slow)
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("d", "zz"), ("e", "f"), ("f", "e"), ("g", "e"), ("h", "g"), ("i", "i"), ("j", " "), (None, "a")] + [(f"x{i}", "a") for i in range(40)] + [(f"y{i}", f"y{i - 1}") for i in range(1, 12)] + [("y0", "c")]
    nodes = hierarchy.links(spark.createDataFrame(rows, "id string, p string").withColumn("node", F.lit(1)), "s", "id", "p")
    tree = hierarchy.hierarchy(nodes, with_path=True)
    got = {r["node_id"]: (r["root_id"], r["depth"], r["descendants"], r["path"]) for r in tree.collect()}
    parent = {n: p for n, p in rows if n}
    for n in parent:
        path, seen = [n], {n}
        while (p := parent[path[0]]) in parent and p not in seen:
            path.insert(0, p)
            seen.add(p)
        loop = parent[path[0]] in seen
        want = ("", -1, None, None) if loop else (path[0], len(path) - 1, got[n][2], path)
        assert got[n] == want
    assert got["a"][2] == 54 and got["x1"][2] == 0 and len(got) == len(parent)
    assert hierarchy.descendants(tree).filter("ancestor_id = 'c'").count() == 12
    assert hierarchy.hierarchy(nodes.limit(0)).count() == 0


def test_long_chains_and_random_trees(spark):
    import random

    rnd = random.Random(4)
    up = {f"c{i}": f"c{i - 1}" if i else None for i in range(300)} | {f"l{i}": f"l{(i + 1) % 40}" for i in range(40)} | {"t0": "l7", "t1": "t0", "t2": "t1"}
    for i in range(150):
        up[f"r{i}"] = None if i < 3 else f"r{rnd.randrange(max(0, i - 4), i)}" if rnd.random() < 0.9 else f"c{rnd.randrange(200)}"
    nodes = spark.createDataFrame([("s", k, p) for k, p in up.items()], "src string, node string, parent string")
    got = {r["node_id"]: r for r in hierarchy.hierarchy(nodes).collect()}
    below, place = dict.fromkeys(up, 0), {}
    for k in up:
        path = [k]
        while up[path[-1]] is not None and len(path) <= 600:
            path.append(up[path[-1]])
        root = up[path[-1]] is None
        place[k] = (path[-1], len(path) - 1) if root else ("", -1)
        for x in path[1:] if root else ():
            below[x] += 1
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == place
    assert all(got[k]["descendants"] == (below[k] if place[k][0] else None) for k in up)


LISTS = {"aliases": ("alias", "id"), "changedFiles": ("changedFile", "number")}


def test_nested(spark):
    rows = [
        (1, '{"terms": {"k": {"id": "a", "aliases": ["x", null, "y"]}, "m": {"aliases": "lone"}}}'),
        (2, '"{\\"number\\": 7, \\"changedFiles\\": {\\"filename\\": \\"f\\"}}"'),
        (3, '{"id": 1, "aliases": ["x"]'),
        (4, None),
        (5, ""),
        (6, '[{"id": "b", "aliases": null}, {"id": "c", "aliases": [], "aliases": [[1], {"id": "d", "aliases": ["é\\u0041"]}]}]'),
        (1, '{"id": "a", "aliases": ["x"]}'),
        (7, '{"id": "e", "aliases": ["' + "z" * 300_000 + '"]}'),
        (8, '{"id": "e", "aliases": "[\\"p\\", null, \\"q\\"]"}'),
    ]
    df = spark.createDataFrame(rows, "rid long, payload string").withColumn("child", F.lit("clash"))
    got = sorted((r["rid"], r["parent_key"], r["child"], r["ord"]) for r in nested.flatten(df, "rid", "payload", LISTS).drop("value").distinct().collect())
    assert got == [(1, "a", "alias", 0), (1, "a", "alias", 2), (1, "m", "alias", 0), (2, "7", "changedFile", 0), (6, "c", "alias", 0), (6, "c", "alias", 1), (6, "d", "alias", 0), (7, "e", "alias", 0), (8, "e", "alias", 0), (8, "e", "alias", 2)]
    assert nested.flatten(df.limit(0), "rid", "payload", LISTS).count() == 0


def _held(texts, strings, free):
    """The passes of substrings.found() on lists, joined with the strings."""
    bits = substrings.table_bits(len(strings))
    parts = [list(strings[:2]), list(strings[2:])]  # two tasks
    made = [b for p in parts for b in substrings._pieces(bits)(iter([pa.RecordBatch.from_arrays([pa.array(p, pa.string())], ["low"])]))]
    by: dict = {}
    for b in made:
        by.setdefault(b.column(0)[0].as_py(), []).append(b)
    one = [substrings._united(pa.Table.from_batches(x)).to_pylist()[0] for x in by.values()]
    table = substrings._whole([(r["piece"], r["bits"]) for r in one], bits)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["key", "text"])
    run = substrings._look(sorted({len(x) for x in strings if x}), bits, lambda: table, free)
    return {(r["key"], r["low"], r["at"]) for b in run(iter([batch])) for r in b.to_pylist() if r["low"] in set(strings)}


@pytest.mark.parametrize("chunk", [500_000, 7])
@pytest.mark.parametrize("free", [True, False])
def test_parts_of_texts(monkeypatch, free, chunk):
    """detect_labels, detect_topk, detect_context, tool_terms, tool_advice: labels beyond the automaton, against the definition."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(5)
    texts = ["", "", *("".join(rng.choice("ab_ ]결\U0001f600") for _ in range(rng.randrange(40))) for _ in range(400)), ""]
    strings = sorted({"".join(rng.choice("ab_ ]결\U0001f600") for _ in range(rng.randrange(7))) for _ in range(300)})

    def first(t, s):
        stands = (i for i in range(len(t) - len(s) + 1) if t.startswith(s, i) and (not free or detect._free(t, i, i + len(s))))
        return next(stands, None)

    want = {(k, s, first(t, s)) for k, t in enumerate(texts) for s in strings if s and first(t, s) is not None}
    assert len(want) > 500 and _held(texts, strings, free) == want


def test_labels_that_begin_alike_leave_few_rows():
    """detect_labels: places met all labels with the same three characters, here 3,000 for each place."""
    labels = [f"retry job {i}" for i in range(3000)]
    assert _held(["the retry job 17, retry job 170", "xretry job 5 retry job 3000"], labels, True) == {(0, "retry job 17", 4), (0, "retry job 170", 18)}


def test_labels_beyond_the_automaton_meet_whole_texts(spark):
    labels = spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "concat('Retry job ', id) AS label")
    labels = labels.union(spark.createDataFrame([("k", "결제 한도"), ("p", "[• x]!"), ("q", "x]"), ("r", "Retry"), ("s", "retry"), ("z", "")], labels.schema))
    rows = [(1, "the retry JOB 17, retry job 170"), (2, "결제 한도는 결제 한도"), (3, "a[• x]!b [• x]! _x] x]"), (4, ""), (5, None), (7, "xretry retry_ retry job 30000"), (8, "Retry job 5")]
    texts = spark.createDataFrame(rows, "k long, t string")
    want = {(1, "17"), (1, "170"), (1, "r"), (1, "s"), (2, "k"), (3, "p"), (3, "q"), (7, "r"), (7, "s"), (8, "5"), (8, "r"), (8, "s")}
    for most in (0, detect.MAX_AUTOMATON):
        assert {(r["key"], r["term_id"]) for r in detect.matches(texts, labels, "k", "t", most=most).collect()} == want


@pytest.mark.parametrize("near_rows", [100_000, 3])
def test_related_terms_are_counted_where_they_meet(spark, monkeypatch, near_rows):
    """related_terms: pairs of terms were shuffled to be counted."""
    monkeypatch.setattr(signals, "NEAR_ROWS", near_rows)
    found = {"q1": "abcd", "q2": "abx", "q3": "ay", "q4": "zz", " Q1 ": "e"}
    rows = [(i, dt.datetime(2025, 1, 1, 0, i), "query", list(t), q) for i, (q, t) in enumerate(found.items())]
    u = spark.createDataFrame(rows, "event_id long, ts timestamp, type string, termIds array<string>, query string")
    got = signals.related(u, spark.createDataFrame([(x,) for x in "abq"], "term_id string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(other_id" in plan and "hashpartitioning(term_id" not in plan
    by = {"q1": set("abcde"), "q2": set("abx"), "q3": set("ay"), "q4": {"z"}}
    want = {(t, o): n for t in "ab" for o in "abcdexyz" if t != o and (n := sum(t in s and o in s for s in by.values()))}
    assert {(r["term_id"], r["other_id"]): r["shared"] for r in got.collect()} == want
