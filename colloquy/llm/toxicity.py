"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .langid import held_out
from .ngrams import fold, grams, join, mixed
from .tokens import blocks
from .work import saved

SIZES, BITS = (3, 4, 5, 6), 18


@dataclass
class Model:
    """weights: for each hashed n-gram its coefficient times its log-count ratio, 0 for those without a say."""

    weights: np.ndarray
    bias: float


def _present(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every hashed n-gram that occurs in a text, once each; ``wanted`` marks the features to look for."""
    flat, bounds = join([fold(t) for t in texts])
    found = []
    for n in SIZES:
        code, starts = grams(flat, bounds, n)
        slot = (mixed(code, 7) >> np.uint64(64 - BITS)).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), np.diff(starts))
        if wanted is not None:
            keep = wanted[slot]
            slot, of = slot[keep], of[keep]
        found.append((of << BITS) | slot)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _logistic(of: np.ndarray, slot: np.ndarray, value: np.ndarray, labels: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Coefficients and bias of a penalised logistic regression on sparse rows, by accelerated gradient steps."""
    n, m = len(labels), len(value)
    size = np.bincount(of, value[slot] ** 2, n)
    rate = 1.0 / (0.25 * (size.max(initial=0) + 1) / 4 + penalty)
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # the rarer label counts more
    rate /= weight.max()
    w, b, pw, pb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(steps):
        push = k / (k + 3)
        yw, yb = w + push * (w - pw), b + push * (b - pb)
        score = np.bincount(of, yw[slot] * value[slot], n) + yb
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * weight / n
        pw, pb = w, b
        w = yw - rate * (np.bincount(slot, gap[of] * value[slot], m) + penalty * yw / n)
        b = yb - rate * gap.sum()
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, least_z: float = 4.0, penalty: float = 1.0, steps: int = 600) -> Model:
    """Learn from the labelled documents that are not held out.

    At most ``per_class`` documents of each label are used, those with the smallest hash of their id: a bound on the
    sample alone. Counts of documents per hashed n-gram and label are summed on the cluster (2^18 n-grams at most
    reach the driver); n-grams whose log-count ratio lies ``least_z`` standard errors or more from that of the sample
    are kept, and the regression is fitted on their ratios, the rarer label counting more. Labels other than 0 and 1, and labels of unknown documents, are left out. With one class or none
    the score is constant.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    flat = Model(np.zeros(1 << BITS), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n0 + n1 else -20.0)
    if not n0 or not n1:
        return flat
    ids = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = saved(ids[0].union(ids[1]), "toxicity-ids")  # two times per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = saved(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")

    def count(batches):
        seen = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            rows, toxic = b.column("text").to_pylist(), b.column("toxic").to_numpy()
            for i, k in blocks(rows):
                of, slot = _present(rows[i:k], None)
                for c in (0, 1):
                    seen[c] += np.bincount(slot[toxic[i:k][of] == c], minlength=1 << BITS)
        some = np.flatnonzero(seen.sum(axis=0))
        yield pa.record_batch([pa.array(some), pa.array(seen[0][some]), pa.array(seen[1][some])], names=["slot", "clean", "toxic"])

    sums = sample.mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    m0, m1 = size.get(0, 0), size.get(1, 0)
    if not m0 or not m1:
        return flat
    q, p = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = sums["slot"].to_numpy()
    q[at], p[at] = sums["clean"].to_numpy(), sums["toxic"].to_numpy()
    ratio = np.log((p + 1) / (m1 + 2)) - np.log((q + 1) / (m0 + 2))
    error = np.sqrt(np.maximum(1 / (p + 1) - 1 / (m1 + 2), 0) + np.maximum(1 / (q + 1) - 1 / (m0 + 2), 0))
    wanted = np.abs(ratio) >= least_z * np.maximum(error, 1e-9)
    if not wanted.any():
        return flat
    number = np.cumsum(wanted) - 1

    def features(batches):
        for b in batches:
            rows = b.column("text").to_pylist()
            for i, k in blocks(rows):
                of, slot = _present(rows[i:k], wanted)
                cuts = np.searchsorted(of, np.arange(1, k - i))
                yield pa.record_batch([b.column("toxic").slice(i, k - i), pa.array([x.astype("<i4").tobytes() for x in np.split(number[slot], cuts)], pa.binary())], names=["toxic", "features"])

    rows = sample.mapInArrow(features, "toxic int, features binary").toArrow()
    truth = rows["toxic"].to_numpy().astype(float)
    lists = [np.frombuffer(x, "<i4") for x in rows["features"].to_pylist()]
    of, slot = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
    w, b = _logistic(of, slot, ratio[wanted], truth, penalty, steps)
    weights = np.zeros(1 << BITS)
    weights[wanted] = w * ratio[wanted]
    return Model(weights, b)


def score(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, held_out, score (probability of label 1), predicted (1 from 0.5 on) and ``extra``.

    A null or empty text gets the bias alone; whole texts of any length are read; a null doc_id is not held out;
    repeated rows give a row each, an empty table none; other columns are no input. Rows stay in their partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        wanted = own.weights != 0
        for b in batches:
            texts, out = [t or "" for t in b.column("text").to_pylist()], []
            for i, k in blocks(texts):
                of, slot = _present(texts[i:k], wanted)
                z = np.bincount(of, own.weights[slot], k - i) + own.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(flat, pa.float64()), pa.array((flat >= 0.5).astype(np.int32)), *(b.column(c) for c in extra)], names=["doc_id", "held_out", "score", "predicted", *extra])

    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *(c for c in extra if c not in ("doc_id", "text")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + "".join(f", `{c}` {kinds[c]}" for c in extra))
