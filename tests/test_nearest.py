"""Exact vector search against all distances, on clustered, equal and awkward vectors."""

import numpy as np
import pyarrow as pa
import pytest

from colloquy.operators import nearest as V


def table(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], f"{name} long, vector array<double>, list string, ring int")


def brute(points, queries, k, skip_own):
    out = set()
    for q, v in queries:
        u = np.array(v) / np.linalg.norm(v)
        near = sorted((-round(float(u @ (np.array(p) / np.linalg.norm(p))), 12), i) for i, p in points if not (skip_own and i == q))
        out |= {(q, i, round(-s, 6)) for s, i in near[:k]}
    return out


@pytest.mark.parametrize("block,skip_own", [(4096, True), (16, False)])
def test_nearest(spark, block, skip_own):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    rows = [(i, centres[i % 6] * rng.uniform(0.5, 2) + rng.normal(size=12) * 0.2) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a large group of equal vectors
    rows += [(2000 + i, rng.normal(size=12)) for i in range(40)]
    odd = [(3000, None), (3001, [0.0] * 12), (3002, [1.0] * 11), (3003, [float("nan")] * 12), (3004, [None] * 12), (3005, [float("inf")] * 12), (3006, []), (None, [1.0] * 12)]
    queries = [r for r in rows if r[0] % 7 == 0] + [(9000 + i, rng.normal(size=12)) for i in range(10)]
    points = table(spark, rows + odd, "point_id").repartition(5)
    got = V.nearest(points, table(spark, queries + odd, "qid"), 10, skip_own, block).collect()
    assert len(got) == 10 * len(queries) and {(r.qid, r.point_id, round(r.score, 6)) for r in got} == brute(rows, queries, 10, skip_own)


def test_few_points(spark):
    one = table(spark, [(1, [1.0, 0.0])], "point_id")
    asked = table(spark, [(1, [1.0, 1.0]), (2, [0.0, 1.0])], "qid")
    assert [(r.qid, r.point_id, r.score) for r in V.nearest(one, asked, 3).collect()] == [(2, 1, 0.0)]
    assert V.nearest(one.limit(0), asked, 3).collect() == [] and V.nearest(one, asked.limit(0), 3).collect() == []


def test_tight_clusters(spark):
    """Queries inside tight clusters, whose bound leaves out most rings."""
    rng = np.random.default_rng(3)
    rows = [(i, np.eye(20)[i % 20] + rng.normal(size=20) * 0.01) for i in range(2000)]
    got = V.nearest(table(spark, rows, "point_id"), table(spark, rows[::100], "qid"), 5).collect()
    assert {(r.qid, r.point_id, round(r.score, 6)) for r in got} == brute(rows, rows[::100], 5, True)


def test_pieces():
    """What tasks compute or hand on at once is bounded, whatever the batches; no row is lost."""
    batches = [pa.record_batch([pa.array(range(n))], names=["i"]) for n in (0, 5000, 3, 1)]
    got = list(V._pieces(batches, 100, 2000))
    assert max(b.num_rows for b in got) == 20 and [x for b in got for x in b["i"].to_pylist()] == [x for b in batches for x in b["i"].to_pylist()]
    assert [b.num_rows for b in V._pieces(batches[2:], 9999, 100)] == [1, 1, 1, 1]


@pytest.mark.parametrize("cells", [1, 300])
def test_small_pieces(spark, cells):
    rng = np.random.default_rng(cells)
    rows = [(i, rng.normal(size=8)) for i in range(400)]
    got = V.nearest(table(spark, rows, "point_id").repartition(2), table(spark, rows[::9], "qid").repartition(1), 7, cells=cells).collect()
    assert {(r.qid, r.point_id, round(r.score, 6)) for r in got} == brute(rows, rows[::9], 7, True)
