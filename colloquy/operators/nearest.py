"""Exact nearest vectors by cosine: lists around pivots, rings by distance, and the triangle inequality to skip them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import written

#: Lists, rings of a list and sampled vectors, at most: what every task is sent has this bound, whatever the table's size.
LISTS, RINGS, SAMPLE = 1024, 64, 4096
#: Vectors and queries that one task compares at a time.
BLOCK = 4096
#: Numbers that a task computes, or hands on, in one array: its memory has this bound, whatever number of rows and rings it is given.
CELLS = 1 << 19
#: What rounding may add to a distance between unit vectors.
SLACK = 1e-6


def _unit(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pieces(batches, width: int, cells: int):
    """The rows of all batches, so few at a time that ``width`` numbers for each stay within ``cells``, a row at least."""
    step = max(1, cells // max(1, width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))


def _pivots(sample: np.ndarray, n: int, steps: int = 3) -> np.ndarray:
    """Centres of a sample of unit vectors; any would give right results, good ones skip more."""
    own = sample[:n].copy()
    for _ in range(steps):
        near = _distances(sample, own).argmin(1)
        for k in range(n):
            if (near == k).any():
                own[k] = sample[near == k].mean(0)
    return own


def _proper(rows: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Rows whose vector can be compared: no null and no component that is null or not finite, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    return rows.filter(F.coalesce(fine & (F.size(vector) > 0 if size is None else F.size(vector) == size), F.lit(False)))


def nearest(points: DataFrame, queries: DataFrame, k: int, skip_own: bool = True, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(qid, point_id, score): the k points of highest cosine for each query (qid, vector), ties by point_id; exact.

    Points go to the nearest of about as many pivots as the root of their number, and in a list to one of its rings by
    their distance from the pivot. A query first asks the rings that may hold its nearest points, as many as hold k; the worst
    score found then bounds the rest: a ring whose nearest possible point, by the triangle inequality, lies beyond is
    skipped. Vectors meet as Arrow blocks, by matrix products; rings of over ``block`` points and rings asked by over ``block``
    queries are dealt over more tasks, so no task holds all points of a list or all queries. A task's arrays hold ``cells``
    numbers, or those of one row; a query's rings are handed on in parts of that size.

    Vectors that are null, zero or not finite, or of another length than most points have, take no part. With
    ``skip_own`` a point whose id is the query's is left out. Results are written to the shared folder and read back.
    """
    spark, schema = points.sparkSession, "qid long, point_id long, score double"
    kind = "array<double>"
    rows = _proper(points.select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast(kind).alias("v")).filter("point_id is not null"), "v")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows, n, need = rows.filter(F.size("v") == sizes.d), sizes["count"], k + skip_own
    lists = max(1, min(LISTS, round(n**0.5)))
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("point_id"), "point_id").limit(min(SAMPLE, 4 * lists)).collect()])
    pivots = _pivots(sample / np.sqrt((sample * sample).sum(1))[:, None], min(lists, len(sample)))

    def assign(batches):
        for b in _pieces(batches, max(pivots.shape), cells):
            far = _distances(_unit(b.column("v")), pivots)
            near = far.argmin(1)
            yield pa.record_batch([b.column("point_id"), b.column("v"), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near], pa.float64())], names=["point_id", "v", "list", "r"])

    listed = written(rows.mapInArrow(assign, f"point_id long, v {kind}, list int, r double"), "nearest-lists")
    spans = listed.groupBy("list").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    spans = spans.select("list", "low", F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)).alias("width"), F.least(F.ceil(F.col("n") / block), F.lit(RINGS)).alias("rings"))
    ring = F.least(F.floor((F.col("r") - F.col("low")) / F.col("width") * F.col("rings")), F.col("rings") - 1).cast("int")
    ringed = listed.join(F.broadcast(spans), "list").select("point_id", "v", "list", "r", ring.alias("ring"))  # a row per list
    found = ringed.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("list", "ring").collect()  # LISTS * RINGS at most
    own = {c: np.array([r[c] for r in found]) for c in ("list", "ring", "n", "low", "high")}

    def choose(batches, again: bool):
        """The rings that a query asks: at first the nearest ones that hold enough points, then all others within its bound."""
        for b in _pieces(batches, max(len(found), *pivots.shape), cells):
            far = _distances(_unit(b.column("v")), pivots)[:, own["list"]]
            least = np.maximum(np.maximum(far - own["high"], own["low"] - far), 0) - SLACK
            order = np.lexsort((far, least), axis=1)
            enough = (np.cumsum(own["n"][order], axis=1) < need).sum(1) + 1
            bounds = b.column("bound").to_numpy(zero_copy_only=False) if again else [0.0] * b.num_rows
            picked = []
            for i in range(b.num_rows):
                first = order[i, : enough[i]]
                if again:
                    rest = np.flatnonzero(least[i] <= bounds[i] + SLACK)
                    first = np.setdiff1d(rest, first)
                picked.append(first)
            which, at = np.concatenate(picked).astype(np.int32), np.repeat(np.arange(b.num_rows), [*map(len, picked)])
            pairs = pa.record_batch([pa.array(at), pa.array(own["list"][which], pa.int32()), pa.array(own["ring"][which], pa.int32())], names=["at", "list", "ring"])
            for some in _pieces([pairs], sizes.d, cells):  # a query's vector goes along to each of its rings
                yield pa.record_batch([b.column("qid").take(some.column("at")), b.column("v").take(some.column("at")), some.column("list"), some.column("ring")], names=["qid", "v", "list", "ring"])

    def compare(key, some: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if some.num_rows and asked.num_rows:
            ids, q = some["point_id"].to_numpy(), asked["qid"].to_numpy()
            u, v = _unit(asked["v"].combine_chunks()), _unit(some["v"].combine_chunks())
            step, kept = max(1, cells // len(v)), []
            for begin in range(0, len(u), step):
                rough = u[begin : begin + step] @ v.T
                if skip_own:
                    rough[q[begin : begin + step, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(rough, begin):
                    # A product's last digits depend on its block's shape; those that may be among the best are scored pair by pair.
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-9) if len(row) > k else np.arange(len(row))
                    near = near[row[near] > -np.inf]
                    score = (v[near] * u[i]).sum(1)
                    best = np.lexsort((ids[near], -score))[:k]
                    kept.append((np.full(len(best), q[i]), ids[near][best], score[best]))
            out = [np.concatenate(c) for c in zip(*kept, strict=True)]
        return pa.table({"qid": pa.array(out[0], pa.int64()), "point_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def meet(asked: DataFrame) -> DataFrame:
        asked = written(asked, "nearest-asked")
        per = asked.groupBy("list", "ring").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
        sizes = spark.createDataFrame([(int(r["list"]), int(r["ring"]), -(-int(r.n) // block)) for r in found], "list int, ring int, parts int")
        both = F.broadcast(written(per.join(F.broadcast(sizes), ["list", "ring"]), "nearest-rings"))  # a row per ring
        left = ringed.join(both, ["list", "ring"]).withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        right = asked.join(both, ["list", "ring"]).withColumn("turn", F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["list", "ring", "part", "turn"]
        met = left.select(*keys, "point_id", "v").groupBy(*keys).cogroup(right.select(*keys, "qid", "v").groupBy(*keys)).applyInArrow(compare, schema)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "point_id"))
        return written(met.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n"), "nearest-found")

    asks = _proper(queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast(kind).alias("v")), "v", sizes.d)
    asks = written(asks.filter("qid is not null"), "nearest-queries")
    asked = f"qid long, v {kind}, list int, ring int"
    first = meet(asks.mapInArrow(lambda b: choose(b, False), asked))
    worst = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).otherwise(F.lit(9.0)).alias("bound"))
    bound = asks.join(worst.hint("merge"), "qid", "left").select("qid", "v", F.coalesce("bound", F.lit(9.0)).alias("bound"))
    rest = meet(bound.mapInArrow(lambda b: choose(b, True), asked))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "point_id"))
    return written(first.union(rest).withColumn("_n", place).filter(F.col("_n") <= k).drop("_n"), "nearest")
