"""Keyword and vector retrieval over whole query sets, and the blend of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens
from .nearest import nearest


#: Query terms that are sent to all tasks; more of them are joined by shuffle.
ASKED = 10_000


def inverted_index(docs: DataFrame, pattern: str = r"[a-z]{3,}") -> DataFrame:
    """(doc_id, term, tf, dl): term counts and the document's length in terms."""
    words = docs.select("doc_id", tokens(F.col("text"), pattern).alias("w")).withColumn("dl", F.size("w"))
    return words.select("doc_id", "dl", F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, pattern: str = r"[a-z]{3,}", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score) of documents that hold all terms of a query (qid, term).

    Words that no query asks for are dropped before anything is counted or shuffled; what is kept of the others is a
    length per document.
    """
    words = docs.select("doc_id", tokens(F.col("text"), pattern).alias("w")).select("doc_id", F.size("w").alias("dl"), "w").filter("dl > 0")
    stats = words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    wanted = queries.distinct()
    wanted = wanted.join(wanted.groupBy("qid").agg(F.count("*").alias("need")).hint("merge"), "qid")
    asked = wanted.select("term").distinct()
    few = wanted.limit(ASKED + 1).count() <= ASKED  # a row per query and term
    each = words.select("doc_id", "dl", F.explode("w").alias("term"))
    hit = each.join(F.broadcast(asked) if few else asked.hint("merge"), "term").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    hit = hit.join(F.broadcast(df) if few else df.hint("merge"), "term").join(F.broadcast(wanted) if few else wanted.hint("merge"), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("qid", "doc_id", "need").agg(F.sum(part).alias("score"), F.count("*").alias("found")).filter("found = need").select("qid", "doc_id", "score")


def phrase_search(docs: DataFrame, phrases: DataFrame, pattern: str = "[a-z]+") -> DataFrame:
    """R2: (qid, doc_id) of documents that hold the words of a phrase (qid, phrase) in a row.

    By positions: a phrase's words and a document's meet by word, and a place where all of them line up is a hit.
    """
    wanted = phrases.select("qid", tokens(F.col("phrase"), pattern).alias("p")).select("qid", F.size("p").alias("need"), F.posexplode("p").alias("i", "term"))
    asked = wanted.select("term").distinct()
    few = wanted.limit(ASKED + 1).count() <= ASKED  # a row per query and word
    each = docs.select("doc_id", F.posexplode(tokens(F.col("text"), pattern)).alias("at", "term"))
    met = each.join(F.broadcast(asked) if few else asked.hint("merge"), "term").join(F.broadcast(wanted) if few else wanted.hint("merge"), "term")
    lined = met.groupBy("qid", "doc_id", "need", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("n"))
    return lined.filter("n = need").select("qid", "doc_id").distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def top_k(rows: DataFrame, per: list[str], order: list[Column], k: int) -> DataFrame:
    """K3: the first k rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rank") <= k)


def vector_search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The points' columns but the vector, with qid, score and rank: the k nearest points of each query
    (qid, vector) by cosine, exact; a point with the query's id is left out. Filter the points first for R6, rank within
    a collection by filtering to it."""
    hits = nearest(points, queries, k)
    own = points.drop("vector").join(hits.hint("merge"), "point_id")
    return top_k(own, ["qid"], [F.desc("score"), F.col("point_id")], k)


def to_embed(chunks: DataFrame, messages: DataFrame, metadata: DataFrame, points: DataFrame) -> DataFrame:
    """Payload rows of chunks that have no point yet: (id, chunk_index, conversation_id, created_at, salience, chunk_text)."""
    both = chunks.join(messages.select(F.col("message_id").alias("id"), "conversation_id", "created_at").hint("merge"), "id").join(metadata.select(F.col("message_id").alias("id"), "quality_score").hint("merge"), "id", "left")
    return both.join(points.select("id", "chunk_index").hint("merge"), ["id", "chunk_index"], "left_anti").select("id", "chunk_index", "conversation_id", "created_at", F.coalesce("quality_score", F.lit(0.5)).alias("salience"), "chunk_text")


def first_wins(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of lists in their order; of rows with the same key the first list's stays."""
    all_rows = None
    for k, rows in enumerate(lists):
        rows = rows.withColumn("source", F.lit(k))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    return all_rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("source", F.desc("score")))).filter("_n = 1").drop("_n")


def graph_affinity(hits: DataFrame, edges: DataFrame, factor: float = 0.1, seeds: int = 3, fan: int = 10) -> DataFrame:
    """Hits with graph_boost and score raised by it: conversations near the best ones gain by the strongest edge."""
    means = hits.groupBy("qid", "conversation_id").agg(F.avg("score").alias("m"))
    best = top_k(means, ["qid"], [F.desc("m"), F.col("conversation_id")], seeds).select("qid", "conversation_id")
    both = edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))
    near = best.join(both.hint("merge"), F.col("conversation_id") == F.col("a"))
    near = top_k(near, ["qid", "a"], [F.desc("weight"), F.col("b")], fan).groupBy("qid", F.col("b").alias("conversation_id")).agg(F.max("weight").alias("w"))
    near = near.join(best.hint("merge"), ["qid", "conversation_id"], "left_anti")
    boost = F.coalesce(factor * F.col("w"), F.lit(0.0))
    return hits.join(near.hint("merge"), ["qid", "conversation_id"], "left").withColumn("graph_boost", boost).withColumn("score", F.col("score") + boost).drop("w")


def entity_sources(mentions: DataFrame, messages: DataFrame, wanted: DataFrame, per_entity: int = 5, most: int = 10) -> DataFrame:
    """(qid, message_id, text, score) of the newest messages that mention a query's entities (qid, entity_id)."""
    both = mentions.join(wanted, "entity_id").join(messages, "message_id")
    text = F.when(F.length("model_response") > 0, F.col("model_response")).otherwise(F.col("user_prompt"))
    rows = both.withColumn("text", text).filter(F.length("text") >= 20)
    each = top_k(rows, ["qid", "entity_id"], [F.desc("created_at"), F.desc("message_id")], per_entity).drop("rank").dropDuplicates(["qid", "message_id"])
    return top_k(each, ["qid"], [F.desc("created_at"), F.desc("message_id")], most).select("qid", "message_id", "text", F.lit(0.7).alias("score"))


def temporal_decay(score: Column, ts: Column, as_of: str, floor: float = 0.15, days: float = 14.0, historical: Column | None = None) -> Column:
    """The score times floor + (1 - floor) * exp(-days / e-folding time); untouched without a date or for questions about the past."""
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400))
    kept = score * (floor + (1 - floor) * F.exp(-age / days))
    skip = ts.isNull() if historical is None else ts.isNull() | historical
    return F.when(skip, score).otherwise(kept)


def composite(score: Column, salience: Column) -> Column:
    """Neutral and missing salience leave the score."""
    return F.when((salience == 0) | (salience == 0.5) | salience.isNull(), score).otherwise(score * (0.5 + salience))


def select_context(hits: DataFrame, threshold: float = 0.3, most: int = 10, per_parent: int = 3, keyword: Column | None = None) -> DataFrame:
    """Hits (qid, point_id, parent_id, score, n_chars) with a reject reason, null for those that are kept. Hits by
    ``keyword`` may have any score."""
    order = [F.desc("score"), F.col("point_id")]
    low = F.col("score") <= threshold if keyword is None else (F.col("score") <= threshold) & ~keyword
    passing = (F.col("n_chars") >= 50) & ~low
    r = hits.withColumn("_ok", passing).withColumn("_parent", F.row_number().over(Window.partitionBy("qid", "_ok", "parent_id").orderBy(*order)))
    r = r.withColumn("_mine", F.col("_ok") & (F.col("_parent") <= per_parent))
    before = F.sum(F.col("_mine").cast("int")).over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_before", F.coalesce(before, F.lit(0)))
    reason = F.when(F.col("n_chars") < 50, "short").when(low, "score").when(F.col("_before") >= most, "over max").when(F.col("_parent") > per_parent, "diversity")
    return r.withColumn("reason", reason).drop("_ok", "_parent", "_mine", "_before")


def light_context(hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The first three of the five best hits above the threshold."""
    return top_k(top_k(hits, ["qid"], [F.desc("score"), F.col("point_id")], 5).filter(F.col("score") > threshold).drop("rank"), ["qid"], [F.desc("score"), F.col("point_id")], 3)


def usage_signal(hit_words: Column, response_words: Column) -> Column:
    """The share of a hit's keywords that occur among the response's."""
    return F.when(F.size(hit_words) > 0, F.size(F.array_intersect(hit_words, response_words)) / F.size(hit_words)).otherwise(F.lit(0.0))


def salience_fold(start: Column, usages: Column, floor: float = 0.1) -> Column:
    """Salience after usages in order: above 0.3 it gains 0.03 of the usage up to 1, below 0.1 it loses 0.01 down to the floor."""
    return F.aggregate(usages, start.cast("double"), lambda s, u: F.when(u > 0.3, F.least(F.lit(1.0), s + 0.03 * u)).when(u < 0.1, F.greatest(F.lit(floor), s - 0.01)).otherwise(s))


def rerank_feedback(salience: Column, scores: Column, gain: float = 0.05) -> Column:
    """Salience after rerank scores in order: each adds ``gain`` of itself, up to 1."""
    return F.aggregate(scores, salience.cast("double"), lambda s, x: F.least(F.lit(1.0), s + gain * x))


def rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Given scores (qid, point_id, rerank) put in order; a missing one counts as 0."""
    both = hits.drop("rank").join(scores.hint("merge"), ["qid", "point_id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
    return top_k(both, ["qid"], [F.desc("rerank"), F.col("point_id")], k)
