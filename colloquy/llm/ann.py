"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling over rotated column blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .work import lookup, saved


@dataclass
class Index:
    """rotation: an orthogonal matrix; centroids: the lists' rotated centres; sample: rotated vectors that bound a query's search."""

    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def fit(vectors: np.ndarray, lists: int, sample: int = 2000, steps: int = 8, seed: int = 7) -> Index:
    """Rotation and k-means of a sample of vectors (rows, in any number of dimensions)."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(vectors.shape[1],) * 2))[0]
    x = vectors @ rotation
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(steps):
        near = np.concatenate([_squares(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return Index(rotation, centroids, x[:sample])


def scan(query: np.ndarray, columns: np.ndarray, bound: float, k: int, width: int = 16, epsilon: float = 2.1) -> np.ndarray:
    """Rows of one list (``columns``: dimensions by rows, rotated) that may be among the k nearest of the query.

    After every ``width`` dimensions a hypothesis test abandons rows: under a random rotation the distance in d of D
    dimensions, scaled by D / d, exceeds the true one by a factor over 1 + epsilon / sqrt(d) only rarely. ``bound`` is
    the squared distance that k rows are known to lie within; the first rows tighten it.
    """
    size, n = columns.shape
    if n > 4 * k:
        some = ((columns[:, : 4 * k] - query[:, None]) ** 2).sum(0)
        bound = min(bound, np.partition(some, k - 1)[k - 1])
    alive, part = np.arange(n), np.zeros(n)
    for d in range(0, size, width):
        block = columns[d : d + width]
        part = part + ((block[:, alive] - query[d : d + width, None]) ** 2).sum(0)
        done = min(d + width, size)
        factor = (1 + epsilon / np.sqrt(done)) ** 2 * done / size if done < size else 1 + 1e-9
        keep = part <= bound * factor + 1e-12
        alive, part = alive[keep], part[keep]
        if not len(alive):
            break
    return alive


def _flat(column, dtype=np.float64) -> np.ndarray:
    return np.array(column.to_pylist(), dtype)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, probe: float = 0.5, per_root: float = 2.5, fit_on: int = 20_000, most_lists: int = 4096, block: int = 4096) -> DataFrame:
    """The k nearest rows of each query row (vec_id divisible by ``every``): query_id, rank, vec_id, score.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. The
    index is fitted on ``fit_on`` vectors at most (those with the smallest hash of their id) and holds every vector, in
    ``per_root`` times as many lists as the root of their number, ``most_lists`` at most. A query probes the part
    ``probe`` of the lists, and more where they hold fewer than four times the vectors that a result needs.

    Equal vectors are searched once: a group is searched for by one of its queries and found as one candidate with
    its k + 1 smallest ids, which is all that a result can need. Lists are scanned in blocks of about ``block``
    vectors, and asked in blocks of about ``block`` queries, so a crowded or much asked list is many tasks. Vectors that are null, zero, or hold a null or a component that is not
    finite take no part, nor do those of another length than most have; a null vec_id takes no part. Repeated rows
    count once. Fewer candidates than k are all returned; an empty table gives no rows. Other columns are not read.
    """
    spark, most = vectors.sparkSession, k + 1
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes.d).withColumn("same", F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y")))
    place = Window.partitionBy("same").orderBy("vec_id")
    firsts = saved(rows.withColumn("place", F.dense_rank().over(place)).filter(F.col("place") <= most).dropDuplicates(["same", "vec_id"]), "ann-firsts")
    own = saved(firsts.filter("place = 1").select("same", F.col("vec_id").alias("id"), "v"), "ann-vectors")
    members = firsts.groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most

    n = own.count()
    lists = max(1, min(most_lists, round(per_root * n**0.5)))
    sample = np.array([r.v for r in own.orderBy(F.xxhash64("id"), "id").limit(fit_on).collect()])
    shared = spark.sparkContext.broadcast(fit(sample, lists))
    probes = max(1, int(np.ceil(probe * lists)))

    def assign(batches):
        index = shared.value
        for b in batches:
            if b.num_rows:
                x = _flat(b.column("v")) @ index.rotation
                yield pa.record_batch([pa.array(_squares(x, index.centroids).argmin(1), pa.int32()), b.column("id"), b.column("v"), pa.array(list(x), pa.list_(pa.float64()))], names=["list", "id", "v", "r"])

    def ask(batches):
        index, held = shared.value, sizes
        own = _squares(index.sample, index.centroids).argmin(1)  # the lists of the sample
        for b in batches:
            if b.num_rows:
                x = _flat(b.column("v")) @ index.rotation
                far, order = _squares(x, index.sample), np.argsort(_squares(x, index.centroids), axis=1, kind="stable")
                to, bound = [], []
                for row, near in zip(far, order, strict=True):
                    enough = int(np.searchsorted(np.cumsum(held[near]), 4 * most)) + 1
                    to.append(near[: max(probes, enough)])
                    # In the probed lists, as many vectors as a result needs lie within the bound.
                    known = row[np.isin(own, to[-1])]
                    bound.append(np.partition(known, most - 1)[most - 1] * (1 + 1e-9) if len(known) >= most else np.inf)
                yield pa.record_batch([pa.array(to, pa.list_(pa.int32())), b.column("id"), b.column("v"), pa.array(list(x), pa.list_(pa.float64())), pa.array(bound, pa.float64())], names=["lists", "query", "v", "r", "bound"])

    def compare(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if candidates.num_rows and queries.num_rows:
            ids, plain = candidates["id"].to_numpy(), _flat(candidates["v"])
            columns = np.ascontiguousarray(_flat(candidates["r"]).T)
            for q, v, r, bound in zip(queries["query"].to_pylist(), _flat(queries["v"]), _flat(queries["r"]), queries["bound"].to_pylist(), strict=True):
                near = scan(r, columns, bound, most)
                score = np.sqrt(((plain[near] - v) ** 2).sum(1))
                best = np.lexsort((ids[near], score))[:most]
                out.append((np.full(len(best), q), ids[near][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    listed = saved(own.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>, r array<double>"), "ann-lists")
    counts = listed.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = saved(counts, "ann-blocks")  # a row per list
    sizes = np.zeros(lists, np.int64)
    for row in counts.collect():
        sizes[row["list"]] = row["n"]
    blocks = counts.drop("n")
    parts = listed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    asking = rows.filter(F.col("vec_id") % every == 0).select("same", F.col("vec_id").alias("query_id")).distinct()
    groups = saved(asking.groupBy("same").agg(F.count("*").alias("w")), "ann-queries")
    questions = own.join(groups.hint("merge"), "same").select("id", "v").mapInArrow(ask, "lists array<int>, query long, v array<double>, r array<double>, bound double")
    questions = saved(questions.withColumn("list", F.explode("lists")).drop("lists"), "ann-questions")
    asked = saved(questions.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("turns")), "ann-turns")  # a row per list
    both = blocks.join(asked.hint("merge"), "list")
    parts = parts.join(F.broadcast(asked), "list").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    questions = questions.join(F.broadcast(both), "list").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int"))
    questions = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "turns")
    per = ["list", "block", "turn"]
    met = parts.groupBy(*per).cogroup(questions.groupBy(*per)).applyInArrow(compare, "query long, id long, score double")
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).filter(F.col("place") <= most)
    named = own.select("same", "id").join(members.hint("merge"), "same").select("same", "id", "ids")
    best = saved(best, "ann-best")
    hits, total = best.groupBy("id").agg(F.count("*").alias("w")), max(1, best.count())
    known = saved(named.join(hits.hint("merge"), "id").select("id", "w", "ids"), "ann-names")
    found = lookup(best, known, "id", "w", total, ["query"]).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))  # k + 1 at most
    answers = found.join(named.select(F.col("id").alias("query"), "same").hint("merge"), "query").join(groups.hint("merge"), "same").select("same", "w", "found")
    asked = lookup(asking, saved(answers, "ann-answers"), "same", "w", max(1, asking.count()), ["query_id"])
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["score"].alias("score"), i.alias("vec_id")))))
    ranked = F.slice(F.array_sort(F.filter(flat, lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
    return asked.filter("found is not null").select("query_id", F.posexplode(ranked).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
