"""Operators for training data against brute force, with nulls, empty and long values, ties, copies, empty tables and clashing columns."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vocabula.llm import canonical, cooccurrence, frequency, keyword_spam, leaks, packing, tokens, value_mapping
from vocabula.llm.words import Words, shingles, sliding_min

CLASH = ["src", "key", "text_", "total", "blocks", "shard", "record", "items", "many", "value"]


def clash(df):
    """Columns by names that operators use inside."""
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# 1 canonical duplicates ---------------------------------------------------------------------------------------------
def test_duplicates(spark):
    rows = [(1, "Auth Flow", ["b", "A."]), (2, "auth-flow!", ["a", "B", "b"]), (3, "AUTHFLOW", None), (4, "auth flow", []), (5, None, None), (6, "", []), (7, "é", None), (8, "é", []), (9, "x" * 100_000, None), (10, "X" * 100_000, [])]
    rows += [(100 + i, "Hot name" if i % 2 else " hot  NAME ", ["z"]) for i in range(3000)]
    df = clash(spark.createDataFrame(rows, "id long, name string, aliases array<string>"))
    recs = canonical.records(df, "t", "id", "name", "aliases")
    got = {(r["keep_id"], r["dup_id"]) for r in canonical.duplicates(recs).collect()}
    assert got == {(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)} | {(100, 100 + i) for i in range(1, 3000)}
    copies = {r["keep_id"]: r["copies"] for r in canonical.distinct_records(recs).collect()}
    assert copies == {1: 2, 3: 2, 5: 2, 7: 2, 9: 2, 100: 3000}
    assert canonical.duplicates(recs.limit(0)).count() == 0 and canonical.distinct_records(recs.limit(0)).count() == 0


def test_collisions_are_told_apart(spark):
    one_key = lambda text: (b"same", canonical.hashed(text)[1])
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "id long, name string")
    recs = canonical.records(rows, "t", "id", "name")
    assert [(r["keep_id"], r["dup_id"]) for r in canonical.duplicates(recs, one_key).collect()] == [(1, 3)]
    assert {r["keep_id"]: r["copies"] for r in canonical.distinct_records(recs, one_key).collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("a, b", [("\u212b", "\u00c5"), ("\uf900", "\u8c48"), ("e\u0301", "\u00c9"), ("\u1112\u1161\u11ab", "\ud55c"), ("A-b_c", "abc"), ("\u0130", "i\u0307")])
def test_composed_forms_agree(a, b):
    assert canonical.canonical(a) == canonical.canonical(b) != ""


# 2 co-occurrence ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk", [2, 3, 32])
def test_pairs(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(i, [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(0, 9))] + [None] * (i % 2)) for i in range(120)] + [(500, None), (501, []), (3, ["q", "a"])]
    df = clash(spark.createDataFrame(rows, "rid long, terms array<string>"))
    got = {(r["term_a"], r["term_b"]): (r["n"], r["n_a"], r["n_b"], r["n_ab"]) for r in cooccurrence.associations(cooccurrence.baskets(df, "t", "rid", "terms"), chunk=chunk).collect()}
    sets = defaultdict(set)
    for i, x in rows:
        sets[i] |= {v for v in x or [] if v is not None}
    sets = [s for s in sets.values() if s]
    one = Counter(v for s in sets for v in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    assert got == {p: (len(sets), one[p[0]], one[p[1]], c) for p, c in two.items()}


def test_items_that_share_a_hash(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["c", "d"])], "rid long, terms array<string>")
    worst = lambda x, level: F.xxhash64(F.lit(level), x) if level > 1 else F.lit(7).cast("long") + F.when(x == "d", 1).otherwise(0)
    got = {(r["term_a"], r["term_b"]): r["n_ab"] for r in cooccurrence.associations(cooccurrence.baskets(df, "t", "rid", "terms"), code=worst).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "d"): 1}


def test_huge_basket(spark):
    df = spark.createDataFrame([(1, [f"t{i:04d}" for i in range(700)]), (2, ["t0001", "t0699"])], "rid long, terms array<string>")
    got = cooccurrence.associations(cooccurrence.baskets(df, "t", "rid", "terms"))
    assert got.count() == 700 * 699 // 2 and got.filter("n_ab = 2").count() == 1
    assert cooccurrence.associations(cooccurrence.baskets(df.limit(0), "t", "rid", "terms")).count() == 0


# 5 frequencies ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("slots, near", [(1, 0), (4, 10**6), (512, 0)])
def test_frequencies(spark, slots, near):
    rnd = random.Random(slots)
    rows = [(i % 350, [rnd.choice(["hot", "hot", "warm", "", f"v{rnd.randint(0, 60)}", "y" * 5000]) for _ in range(rnd.randint(0, 4))] + [None] * (i % 3 == 0)) for i in range(400)] + [(9999, None)]
    occ = frequency.rows(clash(spark.createDataFrame(rows, "rid long, vs array<string>")), "t", "rid", "vs", many=True)
    got = {r["value"]: (r["occurrences"], r["records"], r["n"], r["mark"]) for r in frequency.marked(frequency.frequencies(occ, slots, near)).collect()}
    flat = [(i, v) for i, vs in rows for v in vs or [] if v]
    n = len({i for i, _ in flat})
    occurrences, records = Counter(v for _, v in flat), Counter(v for _, v in set(flat))
    assert got == {v: (c, records[v], n, "rare" if records[v] == 1 else "common" if records[v] * 50 > n else None) for v, c in occurrences.items()}
    assert frequency.frequencies(occ.limit(0)).count() == 0


# 6 value mapping ----------------------------------------------------------------------------------------------------
REFERENCE = [(1, "status", "backlog", ["icebox", "someday pile", "백로그"]), (2, "status", "in-progress", ["under way"]), (3, "status", "done", None), (4, "kind", "bug", ["defect"])]


def test_mapping_of_values(spark):
    ref = clash(spark.createDataFrame(REFERENCE, "value_id long, field string, canonical string, alternates array<string>"))
    typed = {"Backlog": 1, "abcklog!": 1, "2 - icebx": 1, "백로그 as of Monday": 1, "smdy pl": 1, "somed ypile (Red team)": 1, "(done)": 3, "status: Done": 3, "DNV: in progress": 2, "UNDER  WAY / AB-1": 2, "in-progr": 2, "purple": -1, "key vault 18": -1, "🙂": -1, "x" * 100_000: -1}
    rows = [(i, s, None) for i, s in enumerate(typed)] + [(50, "backlog", "bgu"), (51, None, " "), (52, " ", "feature")] + [(1000 + i, "BACKLOG", None) for i in range(2500)]
    cells = value_mapping.cells(clash(spark.createDataFrame(rows, "rid long, status string, kind string")), "rid", ["status", "kind"])
    got = {(r["key"], r["field"]): r["value_id"] for r in value_mapping.assign(cells, ref).collect()}
    assert got == {(i, "status"): v for i, v in enumerate(typed.values())} | {(50, "kind"): 4, (52, "kind"): -1} | {(1000 + i, "status"): 1 for i in range(2500)}
    assert value_mapping.assign(cells.limit(0), ref).count() == 0
    assert {r["value_id"] for r in value_mapping.assign(cells, ref.limit(0)).collect()} == {-1}


def test_similarity_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    make = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    values, forms = sorted({make() for _ in range(60)}), sorted({make() for _ in range(15)})
    v = spark.createDataFrame([("f", x) for x in values], "field string, value string")
    r = spark.createDataFrame([("f", x) for x in forms], "field string, form string")

    def toks(s):
        out, n = set(), Counter()
        for t in [*s, *[a + b for a, b in zip("^" + s, s + "$")], *[a + b for a, b in zip(s, s[2:])]]:
            n[t] += 1
            out.add((t, n[t]))
        return out

    want = {(a, b) for a in values for b in forms if len(toks(a) & toks(b)) / len(toks(a) | toks(b)) >= 0.5 - 1e-9}
    assert {(x["value"], x["form"]) for x in value_mapping.similar(v, r, 0.5).collect()} == want


# 8 packing ----------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "ledger", "token", "용어"]) for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "long word " * 700), (903, texts[0]), (904, "a" * 3000)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.RANKS}")
    size = {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    got = packing.containers(df, [128, 512, None, 0], shard_docs=100).collect()
    for capacity in (128, 512):
        mine = [r for r in got if r["capacity"] == capacity]
        fill, pieces, slots = Counter(), defaultdict(list), set()
        for r in mine:
            fill[r["container_id"]] += r["tokens"]
            pieces[r["doc_id"]].append((r["start_token"], r["tokens"]))
            slots.add((r["container_id"], r["slot"]))
        assert max(fill.values()) <= capacity and len(slots) == len(mine) and set(pieces) == set(size)
        for i, p in pieces.items():
            p.sort()
            assert sum(n for _, n in p) == size[i] and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and (len(p) == 1 or size[i] > capacity)
        assert 1 - sum(fill.values()) / (len(fill) * capacity) < 0.06
    assert packing.containers(df.limit(0), [128]).count() == 0 and packing.containers(df, []).count() == 0
    assert {r["capacity"] for r in packing.fill(packing.containers(df, [128])).collect()} == {128}


def test_neighbours_share_words():
    import numpy as np

    docs = [[1, 2, 3], [1, 2, 9], [7, 8, 9], [4, 5, 6], [1, 2, 3]] + [[20 + i] for i in range(20)]
    df = Counter(t for d in docs for t in d)
    idf = np.array([np.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0.0 for t in range(50)])
    ix = packing.Shard([np.array(d) for d in docs], [np.ones(len(d), np.uint8) for d in docs], np.array([len(d) for d in docs]), idf, 3.0)
    s = ix.scores(0)
    assert s[4] > s[1] > s[2] == 0


def shard_of(docs):
    import numpy as np

    df = Counter(t for d in docs for t in d)
    idf = np.array([np.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0.0 for t in range(1000)])
    return packing.Shard([np.array(d) for d in docs], [np.ones(len(d), np.uint8) for d in docs], np.array([len(d) for d in docs]), idf, 3.0)


def test_neighbours_fill_small_windows():
    import numpy as np

    docs = [[1, 2, 3], [1, 2, 3], [7, 8, 9]] + [[20 + i] for i in range(20)]
    sizes = np.array([300, 100, 212] + [290] * 20)
    first = [d for box, _, d, _, _ in packing.pack(shard_of(docs), sizes, 512) if box == 0]
    assert first[:2] == [0, 1]  # the neighbour, though text 2 would close the gap to the token


def test_neighbours_come_from_all_shards(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfghjklmnp") + rnd.choice("aeiou") for _ in range(4))
    pages = [" ".join(word() for _ in range(20)) for _ in range(60)]
    df = clash(spark.createDataFrame([(i, pages[i // 2]) for i in range(120)], "doc_id long, text string"))
    enc = tokens.encoding(f"{tokens.FOLDER}/{tokens.RANKS}")
    capacity = 2 * max(len(enc.encode_ordinary(p)) for p in pages)
    boxes = lambda n: {r["doc_id"]: r["container_id"] for r in packing.containers(df, [capacity], shard_docs=n).collect()}
    many, one = boxes(10), boxes(1000)
    assert len(many) == 120 and all(many[i] == many[i + 1] for i in range(0, 120, 2))  # copies meet, wherever their hash puts them
    assert len(set(one.values())) == len(set(many.values())) and all(one[i] == one[i + 1] for i in range(0, 120, 2))


@pytest.mark.parametrize("capacity", [40, 150])
def test_every_neighbour_is_asked_for(capacity):
    import numpy as np

    rnd = random.Random(capacity)
    docs = [sorted({rnd.randrange(300) for _ in range(rnd.randint(1, 12))}) for _ in range(400)]
    sizes = np.array([rnd.choice([0, 5, rnd.randint(1, 60)]) for _ in docs])
    ix = shard_of(docs)
    rows = list(packing.pack(ix, sizes, capacity))
    assert np.array_equal(np.bincount([r[2] for r in rows], [r[4] for r in rows], len(docs)), sizes) and len({r[:2] for r in rows}) == len(rows)
    unused = np.array([rnd.random() < 0.7 for _ in docs])
    seeds, gaps = np.arange(50), np.array([rnd.randint(0, 40) for _ in range(50)])
    row, text, score = ix.nearest([ix.terms[x] for x in seeds], gaps, seeds, np.full(50, 3), unused, sizes)
    lists = packing.Lists(seeds[row], text, score)
    for s, gap in zip(seeds.tolist(), gaps.tolist()):
        want = [(x, d) for d, x in enumerate(ix.scores(s)) if x > 0 and unused[d] and sizes[d] <= gap and d != s]
        near, whole = lists.of(s)
        best = sorted((x for x, _ in want), reverse=True)[: len(near)]
        assert np.allclose([ix.scores(s)[d] for d in near], best, rtol=1e-4) and len(set(near)) == len(near) >= min(3, len(want)) and (not whole or len(near) == len(want))


def test_nearest_of_many_that_close_the_gap():
    import numpy as np

    docs = [[1, 2, 3]] + [[20 + i] for i in range(70)] + [[1, 2, 3]]
    first = [d for box, _, d, _, _ in packing.pack(shard_of(docs), np.array([300] + [212] * 70 + [211]), 512) if box == 0]
    assert first[:2] == [0, 71]


def test_lists_of_shards_are_merged():
    import numpy as np

    rnd = random.Random(11)
    docs = [sorted({rnd.randrange(300) for _ in range(rnd.randint(1, 12))}) for _ in range(400)]
    sizes = np.array([rnd.randint(1, 60) for _ in docs])
    ix, seeds, k = shard_of(docs), np.arange(60), np.array([rnd.choice([1, 3, 400]) for _ in range(60)])
    gaps, unused = np.array([rnd.randint(0, 60) for _ in seeds]), np.array([rnd.random() < 0.7 for _ in docs])
    held, floor = packing.NO_HITS, np.zeros(len(seeds), np.float32)
    for shard in range(5):  # the texts of a shard only, then what it and those before it told
        mine = packing.Candidates(ix, unused & (np.arange(400) % 5 == shard), sizes)
        hits = mine.nearest([ix.terms[s] for s in seeds], gaps, seeds, k, floor)
        *held, floor = packing.best(*map(np.concatenate, zip(held, hits)), k)
        assert (np.bincount(held[0][held[1] >= 0], minlength=len(seeds)) <= k).all()  # however many shards there are
    lists = packing.Lists(*held)
    for s, gap, n in zip(seeds.tolist(), gaps.tolist(), k.tolist()):
        score = ix.scores(s)
        want = sorted((x for d, x in enumerate(score) if x > 0 and unused[d] and sizes[d] <= gap and d != s), reverse=True)
        near, whole = lists.of(s)
        assert np.allclose([score[d] for d in near], want[: len(near)], rtol=1e-4) and len(near) >= min(n, len(want)) and whole == (len(near) == len(want) and not floor[s])


def test_packing_leaves_little_on_disk(spark):
    from pathlib import Path

    from vocabula.session import checkpoint_folder

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(1500)]
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = held()
    packed = packing.containers(spark.createDataFrame(rows, "doc_id long, text string"), [2048])
    left = held() - before
    assert packed.agg(F.sum("tokens"), F.countDistinct("doc_id")).first()[1] == 1500 and left < 0.5 * sum(len(t) for _, t in rows)


def test_memory_of_a_round_is_bounded(monkeypatch):
    """p8_containers: the task that fills held objects of all texts, and the lists of a share of all seeds, which grow with the texts."""
    import tracemalloc

    import numpy as np

    rnd = random.Random(4)
    sizes = np.array([rnd.randint(1, 400) for _ in range(1000)] * 400)
    tracemalloc.start()
    p = packing.Packing(sizes, 512)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 16 * len(sizes)
    monkeypatch.setattr(packing, "TOLD", 20_000, raising=False)
    seeds, gaps, k = p.questions()
    assert len(seeds) == len(gaps) == len(k) >= 64 and k.sum() <= 20_000
    assert p.rest[seeds].min() >= np.sort(sizes)[-len(seeds)]
    # however little a round may ask, all texts are placed
    monkeypatch.setattr(packing, "TOLD", 1, raising=False)
    docs = [sorted({rnd.randrange(300) for _ in range(rnd.randint(1, 12))}) for _ in range(600)]
    sizes = np.array([rnd.choice([0, 5, rnd.randint(1, 60), 400]) for _ in docs])
    rows = list(packing.pack(shard_of(docs), sizes, 150))
    assert np.array_equal(np.bincount([r[2] for r in rows], [r[4] for r in rows], len(docs)), sizes) and len({r[:2] for r in rows}) == len(rows)
    fill = np.bincount([r[0] for r in rows], [r[4] for r in rows]).astype(int)
    assert fill.max() <= 150 and fill.sum() > 0.9 * 150 * len(fill)


def test_counts_are_whole(spark):
    import numpy as np

    df = spark.createDataFrame([(1, " token" * 70_000)], "doc_id long, text string")
    r = packing.sized(df, "doc_id", "text", f"{tokens.FOLDER}/{tokens.RANKS}").filter("n_tokens IS NOT NULL").first()
    assert np.frombuffer(r["counts"], np.uint32).sum() == r["n_tokens"] >= 70_000


# 9 leaks ------------------------------------------------------------------------------------------------------------
def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks(spark, most):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)] + ["É", "용어", "x_y"]
    item = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(item(rnd.choice([5, 13, 14, 40])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        parts = item(rnd.randint(0, 60))
        src = (items[rnd.randrange(12)][1]).split()
        a = rnd.randint(0, max(0, len(src) - 13))
        k = rnd.choice([12, 13, 20])
        docs.append((i, rnd.choice([" ", " - ", "\n> "]).join(parts + [x.upper() for x in src[a : a + k]] + item(9))))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "q " * 400_000 + items[3][1] + " z" * 400_000), (104, "k" * 1_500_000)]
    grams = lambda t: {tuple(x[i : i + 13]) for x in [words_of(t)] for i in range(len(x) - 12)}
    want = {(d, i) for i, p in items for d, t in docs if grams(p) & grams(t)}
    got = leaks.leaks(clash(spark.createDataFrame(docs, "doc_id long, text string")), clash(spark.createDataFrame(items, "item_id long, passage string")), broadcast_runs=most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leaks.leaks(empty, spark.createDataFrame(items, "item_id long, passage string"), broadcast_runs=most).count() == 0


def test_words():
    import numpy as np

    w = Words(["Ab c_d ÉÜ", "", "x1 x1"])
    assert w.words(0, 6) == ["ab", "c", "d", "éü", "x1", "x1"] and w.first.tolist() == [0, 4, 4, 6] and w.hashes[4] == w.hashes[5]
    x = np.array([5, 3, 8, 1, 9, 7, 2], np.uint64)
    for k in range(1, 8):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]
    assert len(shingles(x, 8)) == 0 and len(shingles(x, 5)) == 3


# 10 keyword spam ----------------------------------------------------------------------------------------------------
PROSE = "The ledger store keeps every invoice that a tenant has sent, and it is checked by the billing team before the end of the month. "
SPAM = {
    1: "best price coupon best price coupon code best price coupon online best price coupon. " * 6,
    2: "\n".join(f"- [cheap licence {i}](https://shop.example/p/{i})" for i in range(12)),
    3: "#best_price #coupon #cheap-licence #download #price #deal " * 6,
    4: "Keywords: coupon, price, deal, licence\nTags: cheap, download, coupon, price\nBrand: plan, deal, store, price\n" * 3,
    5: "plan matrix | billing | review gate | plan matrix | billing | review gate | plan matrix | billing | plan matrix",
    6: PROSE + "\n\n" + "\n".join(f"coupon deal -> https://shop.example/{i}/best-price" for i in range(12)),
    8: "cheap licence coupon wholesale price discount bundle deal store brand outlet voucher sale promo rebate clearance bargain offer trial download software template planner roadmap tracker backlog ranking review comparison alternative",
    9: "Why sprint board? sprint board team wiki sprint board team wiki. Get team wiki, coupon, team wiki and coupon team wiki now! Best near me near me for sprint board. " * 3,
    10: PROSE + "\n\n" + "backlog app; term mapper; near me; term mapper; backlog app; near me; near me; term mapper; backlog app; " * 4,
    11: "\n".join(["최저가", "동의 기록", "기획 템플릿", "동의 기록", "로드맵 앱", "용어집 무료"] * 8),
    7: "할인 쿠폰 추천 순위 할인 쿠폰 추천 순위 할인 쿠폰 무료 할인 쿠폰 추천 순위 할인 쿠폰 추천 순위 할인 쿠폰 무료. " * 4,
}
HAM = {
    20: PROSE * 3,
    21: PROSE + "\n- [docs](https://docs.example/a)\n#billing #ledger\nLabels: stock, import\n" + PROSE,
    22: "\n".join(f"- {PROSE}" for _ in range(6)),
    23: "\n".join(f"2025-06-10T18:00:0{i}.000Z INFO parser.resetLedger took {i} ms" for i in range(9)),
    24: "```\n" + "const a = b(1);\n" * 20 + "```",
    25: "| Term | Meaning |\n|---|---|\n| ledger | The store that keeps what was sent. |\n| token | A key that is given to a user. |",
    26: "Call Kim.",
    27: "",
    28: None,
    29: "\n".join("- [ ] Each team will check the ledger before the end of the sprint." for _ in range(12)),
    31: "\n".join(f"- {who} will rename the locale pack by {day}." for who in ("Lantern team", "Copper squad", "Quarry guild") for day in ("Monday", "Friday", "Thursday")),
    30: "이번 스프린트에서는 감사 기록 정의를 먼저 정리한다. 배포 뒤에는 재고 예약을 하루 동안 지켜본다. " * 3,
}


def test_spam(spark):
    rows = list(SPAM.items()) + list(HAM.items()) + [(1000 + i, PROSE * 2) for i in range(40)] + [(50, SPAM[1])]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in keyword_spam.spam(df).collect()) == sorted([*SPAM, 50])
    assert keyword_spam.spam(df.limit(0)).count() == 0
    french = "Le service garde chaque facture que le client envoie. Son équipe vérifie tous les comptes avant la fin du mois. " * 4
    foreign = spark.createDataFrame([(1, french, "fr-FR"), (2, SPAM[9], "fr"), (3, SPAM[1], "unknown"), (4, PROSE, None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in keyword_spam.spam(foreign, lang="lang").collect()) == [2, 3]
    assert keyword_spam.spam(spark.createDataFrame([(1, "coupon deal " * 100_000), (2, PROSE)], "doc_id long, text string")).count() == 1
