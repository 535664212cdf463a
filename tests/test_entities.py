"""Groups of entities, their merge, linking and context, boards: hand-computed cases and plain Python."""

import math
import random
from collections import Counter
from datetime import datetime
from itertools import combinations

import pytest

from colloquy.operators import entities as E, graph as G, index as X, report as M


def pairs(spark, rows):
    return spark.createDataFrame(rows, "duplicate_id long, canonical_id long")


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, 2), (2, 3), (3, 1)], {2: 1, 3: 1}),
        ([(1, 2), (2, 1)], {2: 1}),
        ([(5, 9), (5, 7)], {5: 7, 9: 7}),
        ([(1, 9), (2, 9)], {1: 9, 2: 9}),
        ([(4, 4)], {}),
        ([(k + 1, k) for k in range(1, 40)], dict.fromkeys(range(2, 41), 1)),
        ([(k, k % 37 + 1) for k in range(1, 38)], dict.fromkeys(range(2, 38), 1)),
    ],
)
def test_canonical_map(spark, rows, want):
    assert {r.duplicate_id: r.canonical_id for r in E.canonical_map(pairs(spark, rows)).collect()} == want


def test_components(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(150)]
    label = {x: x for r in rows for x in r}
    for _ in range(400):
        for a, b in rows:
            label[a] = label[b] = min(label[a], label[b])
    got = G.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == label and len(got) == len(label)


def test_merge_of_edges_and_descriptions(spark):
    own = spark.createDataFrame([(1, "  "), (2, "two"), (3, "three"), (4, "four"), (5, None)], "id long, description string")
    asked = pairs(spark, [(2, 1), (3, 1), (9, 4), (5, 8)])
    mapping = E.canonical_map(pairs(spark, [(2, 1), (3, 1)]))
    assert {r.id: r.description for r in E.merged_descriptions(own, mapping).collect()} == {1: "two", 4: "four", 5: ""}
    edges = spark.createDataFrame([(1, "x", 2), (2, "x", 4), (3, "x", 4), (4, "y", 3), (4, "x", 4), (5, "x", 4)], "src long, rel string, dst long")
    assert {tuple(r) for r in E.merged_edges(edges, mapping).collect()} == {(1, "x", 4), (4, "y", 1), (4, "x", 4), (5, "x", 4)}
    report = {(r.canonical_id, r.duplicate_id, r.outcome, r.edges) for r in E.merge_report(own, edges, asked).collect()}
    assert report == {(1, 2, "merge", 2), (1, 3, "merge", 2), (4, 9, "skipped", 0), (8, 5, "no canonical", 0)}


def test_persist(spark):
    t = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([(7, "person", "Ada", "poet", 2, t(3), t(4)), (8, "tool", "Loom", "", 1, t(1), t(1))], "id long, entity_type string, name string, description string, mention_count long, first_seen_at timestamp, last_seen_at timestamp")
    rows = [
        ("person", " ADA ", "Poet", 1, 0.4, "s" * 300, t(1)),
        ("person", "ada", "engineer", 1, 3.0, "later", t(9)),
        ("person", "Bo", None, 2, -1.0, None, t(5)),
        ("person", "bo", "cook", 3, None, "x", t(6)),
        ("planet", "Mars", "red", 3, 0.5, "x", t(6)),
        ("tool", "  ", "blank", 3, 0.5, "x", t(6)),
    ]
    got, mentions = E.persist(old, spark.createDataFrame(rows, "entity_type string, name string, description string, message_id long, relevance double, snippet string, created_at timestamp"), ["person", "tool"])
    found = {r.name: r for r in got.collect()}
    assert set(found) == {"Ada", "Loom", "Bo"}
    assert tuple(found["Ada"]) == (7, "person", "Ada", "poet | engineer", 4, t(1), t(9)) and found["Loom"].mention_count == 1
    assert tuple(found["Bo"])[2:] == ("Bo", "cook", 2, t(5), t(6)) and found["Bo"].id >= 1 << 62
    bo = found["Bo"].id
    seen = {(r.entity_id, r.message_id): (r.relevance, r.snippet) for r in mentions.collect()}
    assert seen == {(7, 1): (0.4, "s" * 200), (bo, 2): (0.0, ""), (bo, 3): (0.5, "x")}


def test_link(spark, tmp_path):
    names = [(1, "Dream Loom", 50), (2, "dream loom engine", 3), (3, "Ada", 1), (4, "Loom", 1), (5, "The Grid", 400), (6, "Engine", 0), (7, "ada", 9)]
    own = spark.createDataFrame([(i, i % 2, n, c) for i, n, c in names], "id long, entity_type int, name string, mention_count long")
    index = X.build(own.selectExpr("id as doc_id", "name as text"), str(tmp_path / "n"), buckets=2, stem=False)
    said = {1: 'We met Ada near the "Dream Loom".', 2: "they use Grid Loom here", 3: "Here the Engine of Ada stopped", 4: "we saw the loom", 5: "", 6: "i do"}
    got = {}
    for r in E.link(spark.createDataFrame(list(said.items()), "message_id long, text string"), own, index).collect():
        got.setdefault(r.message_id, {})[r.entity_id] = (round(r.score, 6), r.place)
    # 1: equal names; "ada" is the one of the smallest type, then id. 2: the phrase holds no name, but "Grid" and "Loom" stand alone, too.
    grid = round(min(0.9, 0.6 * min(1, math.log(401) / 3)), 6)
    assert got[1] == {1: (0.95, 1), 3: (0.95, 2), 4: (0.95, 3)}
    assert got[2] == {4: (0.95, 1), 5: (grid, 2)}
    assert got[3] == {6: (0.95, 1), 3: (0.95, 2)}
    assert got[4] == {4: (0.95, 1)} and 5 not in got and 6 not in got


def test_context_block(spark):
    rows = [("q", 1, "Ada", "person", 3, "d" * 100, ["one", "two", "three", "four"]), ("q", 2, "Loom", "tool", 1, None, None), ("q", 3, "Grid", "place", 2, "g" * 900, []), ("q", 4, "Last", "x", 1, "short", [])]
    table = spark.createDataFrame(rows, "qid string, rank int, name string, entity_type string, mention_count int, description string, snippets array<string>")
    ada = "**Ada** (person, referenced 3 times):\n" + "d" * 100 + '\n\nRecent context:\n- "one"\n- "two"\n- "three"\n\n'
    loom = "**Loom** (tool, referenced 1 times):\n(no description)\n\n"
    grid = "**Grid** (place, referenced 2 times):\n" + "g" * 200 + "...\n\n"
    head = "\n## Known Context\n"
    for budget, want in ((2000, None), (800, head + ada + loom + grid), (len(head + ada + loom + grid), head + ada + loom + grid), (len(head + ada + loom + grid) - 1, head + ada + loom), (len(head + ada), head + ada), (20, head)):
        got = E.context_block(table, budget).first().context
        whole = head + ada + loom + grid.replace("g" * 200 + "...\n", "g" * 900 + "\n") + "**Last** (x, referenced 1 times):\nshort\n\n"
        assert got == (whole if want is None else want)


def test_cards(spark):
    t = lambda d: datetime(2024, 2, d)
    rows = [(1, "feature", "completed", t(1), t(1)), (2, "feature", "shipped", t(1), t(2)), (3, "book", "planning", t(1), t(2)), (4, "feature", "archived", t(1), t(2)), (5, "feature", "not_started", t(16), t(16)), (6, "feature", "review", None, None), (7, "project", "review", t(10), None)]
    own = spark.createDataFrame(rows, "id int, entity_type string, status string, created_at timestamp, updated_at timestamp")
    got = {r.id: (r.column, r.age, r.shown) for r in M.cards(own, M.ITEM_COLUMNS, "2024-02-16 00:00:00").collect()}
    assert got == {1: ("Done", 15, False), 2: ("Done", 15, True), 5: ("Backlog", 0, True), 6: ("Review", 0, True)}
    assert {r.column: (r.n, r.shown, r.oldest) for r in M.board(own, M.ITEM_COLUMNS, "2024-02-16").collect()} == {"Done": (2, 1, 15), "Backlog": (1, 1, 0), "Review": (1, 1, 0)}
    assert [r.id for r in M.cards(own, M.ITEM_COLUMNS, "2024-02-16", "book").collect()] == [3]


def test_surface_draws_by_weight(spark):
    """Over many seeds, a row comes first about as often as its share of the weights; none is drawn twice."""
    rows = spark.createDataFrame([(i, w, f"c{i}") for i, w in enumerate([1.0, 2.0, 3.0, 4.0, 0.0, None])], "id long, weight double, content string")
    first = [M.surface(rows, seed, 4).collect() for seed in range(60)]
    assert all(sorted(r.id for r in d) == [0, 1, 2, 3] and [r.place for r in d] == [0, 1, 2, 3] for d in first)
    heads = [d[0].id for d in first]
    assert 12 <= heads.count(3) <= 36 and heads.count(0) <= 16 and M.surface(rows, 5, 2).collect() == M.surface(rows, 5, 2).collect()
    turns = M.surfaced({"a": rows, "b": rows.filter("id = 1")}, 5, 3, most=1).collect()
    assert {(r.turn, r.kind) for r in turns} == {(0, "a"), (2, "a"), (4, "a"), (1, "b")} and {r.content for r in turns} == {"c"}


def test_write_back(spark):
    insights = spark.createDataFrame([(1, "Alpha beta", 0.9), (2, "alpha BETA gamma", 0.5), (3, "new", 0.9), (4, "ew", 0.9), (5, "x" * 60, 0.9), (6, "zzz", 0.1), (7, "", 0.9), (8, None, 0.9)], "id int, title string, confidence double")
    items = spark.createDataFrame([("The Alpha Beta plan",), ("brand New",), ("x" * 41,), (None,)], "title string")
    assert sorted(r.id for r in G.write_back(insights, items).collect()) == [2]
    assert sorted(r.id for r in G.write_back(insights, items.limit(0)).collect()) == [1, 2, 3, 4, 5]


def test_variants_have_ids_of_their_own(spark, tmp_path):
    from colloquy.plans import bindings

    data = "/root/testdata/sf0.001/"
    spark.range(1500).selectExpr("id as s_suppkey", "concat('Supplier ', id) as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("lineitem", "orders"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}{name}.parquet")
    ids = [r.id for r in bindings.entities(spark, str(tmp_path), True).select("id").collect()]
    assert len(ids) == len(set(ids)) == 1500 + 3 * 150


def test_pairs_are_counted_in_more_tasks_as_they_grow(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id % 50 as message_id", "id as entity_id")
    monkeypatch.setattr(G, "DEALT", 1000)
    edges = G.cooccurrence(rows.union(rows.selectExpr("message_id + 50", "entity_id")), "message_id")
    assert "REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.agg({"weight": "min", "a": "count"}).first().asDict() == {"min(weight)": 2, "count(a)": 50 * 40 * 39 // 2}


@pytest.mark.parametrize("most", [10**9, 20_000])
def test_many_pairs_are_counted_in_rounds(spark, monkeypatch, most):
    """78,000 pairs in groups of 40, 44,850 in one of 300 (seven blocks of 50), nulls: each round shuffles a part, and leaves none."""
    rows = spark.range(2000).selectExpr("id % 50 AS message_id", "id AS entity_id")
    rows = rows.union(rows.selectExpr("message_id + 50", "entity_id")).union(spark.range(300).selectExpr("200", "id")).union(spark.sql("SELECT null, 1 UNION ALL SELECT null, 2 UNION ALL SELECT 1, null"))
    monkeypatch.setattr(G, "ROUND", most)
    monkeypatch.setattr(G.paired, "__defaults__", (50,))
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList()
    before = sc._jsc.sc().dagScheduler().nextStageId()
    edges = G.cooccurrence(rows, "message_id")
    got = {(r.a, r.b): r.weight for r in edges.collect()}
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    written = [stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() >= before]
    want = Counter(p for k in range(50) for p in combinations(range(k, 2000, 50), 2) for _ in range(2)) + Counter(combinations(range(300), 2))
    assert got == {p: n for p, n in want.items() if n >= 2}
    assert (max(written) > 100_000) == (most > 122_850) and (most > 122_850 or max(written) < 30_000)
