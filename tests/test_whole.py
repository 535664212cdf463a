"""Queries without SQL against brute force: whole inputs, nothing left out."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from colloquy.operators import graph as G, ingest as N, intent as I
from colloquy.plans import bindings as B
from colloquy.plans.queries import QUERIES
from test_units import plain_chunks

DATA = "/root/testdata/sf0.001"


def test_clusters_start_from_the_best(spark):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    ids, v = np.array(rows["vec_id"]), np.array(rows["embedding"], dtype=float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    place, quality = {int(i): k for k, i in enumerate(ids)}, {int(i): i * 37 % 101 / 100 for i in ids}
    seeds = sorted(quality, key=lambda i: (-quality[i], i))[:50]
    assert max(seeds) >= 50
    found = []
    for s in seeds:
        score = v @ v[place[s]]
        near = sorted((int(i) for i in ids if i != s), key=lambda i: (-score[place[i]], i))[:10]
        near = [i for i in near if score[place[i]] > 0.3 and i % 40 != s % 40][:5]
        own = sorted([s, *near])
        if len(own) >= 3:
            found.append((-sum(quality[i] for i in own) / len(own) * len({i % 40 for i in own}) / len(own), s, own))
    want, used = {}, set()
    for score, s, own in sorted(found):
        if not used & set(own):
            want[s] = (",".join(map(str, own)), round(-score, 6))
            used |= set(own)
    assert want and {r.seed: (r.members, r.score) for r in QUERIES["insight_clusters"](spark, DATA).collect()} == want


def brandes(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = dict.fromkeys(near, 0.0)
    for s in near:
        level, sigma, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    order.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w] / 2
    return out


def test_betweenness_of_a_long_path(spark):
    n = 68
    own = spark.createDataFrame([(i, i + 1, 1) for i in range(n)], "a int, b int, weight int")
    assert {r.id: r.betweenness for r in G.betweenness(own).collect()} == {i: i * (n - i) for i in range(n + 1)}


def test_betweenness_of_all_parts(spark):
    parts = defaultdict(set)
    rows = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_orderkey", "l_partkey"]).to_pydict()
    orders = set(pq.read_table(f"{DATA}/orders.parquet", columns=["o_orderkey"]).to_pydict()["o_orderkey"])
    for o, p in zip(rows["l_orderkey"], rows["l_partkey"], strict=True):
        if o in orders:
            parts[o].add(p)
    weight = Counter(pair for ps in parts.values() for pair in combinations(sorted(ps), 2))
    want = brandes(pair for pair, w in weight.items() if w >= 2)
    got = {r.id: r.betweenness for r in QUERIES["betweenness_centrality"](spark, DATA).collect()}
    assert max(got.values()) > 0 and got == pytest.approx(want, abs=2e-6)


def test_payloads_of_all_chunks(spark):
    got = defaultdict(dict)
    for r in QUERIES["chunk_payloads"](spark, DATA).collect():
        assert r.chunk_index not in got[r.id]
        got[r.id][r.chunk_index] = (r.conversation_id, r.created_at, r.salience, r.chunk_text)
    longer = 0
    for m in B.messages(spark, DATA).collect():
        whole, q = f"Q: {m.user_prompt}\nA: {m.model_response}", m.user_prompt
        head = f"Q: {q[:150].strip()}{'...' if len(q) > 150 else ''}\nA: " if q else ""
        parts = [(0, 0, whole)] if len(whole) <= 500 else plain_chunks(m.model_response, -1, 400, 50, 40, head)
        quality = m.message_id * 37 % 101 / 100 if m.message_id % 5 else 0.5
        want = {i: (m.conversation_id, m.created_at, quality, text) for i, (_, _, text) in enumerate(parts) if i or m.message_id % 3}
        assert got.pop(m.message_id, {}) == want
        longer += len(parts) > 1
    assert longer and not got


KEYED = "message_id long, conversation_id long, keywords array<string>"


def test_common_keywords_count(spark):
    """A keyword of over 1,000 messages is evidence like any other."""
    n = 1010
    rows = spark.createDataFrame([(i, i, ["common", f"own{i}"], 0.6) for i in range(n)], f"{KEYED}, quality_score double")
    got = G.keyword_similarity(rows, 0.3)
    assert [tuple(r) for r in got.groupBy("jaccard").count().collect()] == [(1 / 3, n * (n - 1) // 2)]


@pytest.mark.parametrize("least", [0.1, 0.3, 0.5, 0.7, 1.0])
def test_keyword_similarity(spark, least):
    rng = random.Random(5)
    rows = [(i, i % 30, [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(12))]) for i in range(120)] + [(500, 1, None), (501, 2, ["w0", None])]
    sets = {m: (c, set(k or ()) - {None}) for m, c, k in rows}
    want = {}
    for a, b in combinations(sorted(sets), 2):
        (ca, x), (cb, y) = sets[a], sets[b]
        if ca != cb and x & y and len(x & y) / len(x | y) >= least:
            want[a, b] = len(x & y) / len(x | y)
    scored = [(*r, 0.9) for r in rows] + [(900 + r[0], r[1], r[2], 0.5) for r in rows]  # 0.5 is not over the bound
    got = G.keyword_similarity(spark.createDataFrame(scored, f"{KEYED}, quality_score double"), least).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want
    assert all(r.shared == sorted(sets[r.a][1] & sets[r.b][1]) for r in got)


def test_titles_of_several_words(spark):
    items = [("n1", "NATION_1"), ("n10", "NATION_10"), ("p2", "Big Red Barn"), ("p3", "Red"), ("p4", "C++ (\\Eold)"), ("p1", "big red barn"), ("p5", "Größe"), ("c1", "Customer#000000001"), ("p6", " - ")]
    texts = ["show NATION_10 now", "show nation_1.", "list the big red barn", "find big, red barns", "what is c++ (\\eold) for", "find größe", "show customer#000000001", "show redder", "show - nothing"]
    want = ["n10", "n1", "p1", "p3", "p4", "p5", "c1", None, None]
    got = I.recommend_actions(spark.createDataFrame(list(enumerate(texts)), "message_id int, user_prompt string"), spark.createDataFrame(items, "id string, title string"))
    assert [r.item_id for r in got.orderBy("message_id").collect()] == want


def test_numbers_in_order(spark):
    ids = random.Random(7).sample(range(-50, 400), 300)
    own = spark.createDataFrame([(i,) for i in ids], "id long")
    for width in (7, 10_000):
        assert [tuple(r) for r in N.numbered(own, "id", "k", width).orderBy("k").collect()] == [(i, k) for k, i in enumerate(sorted(ids))]


def test_messages_are_numbered_in_parts(spark):
    plan = QUERIES["entity_sources"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(message_id" not in plan
