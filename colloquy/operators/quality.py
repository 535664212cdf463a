"""Scoring of messages, its propagation to points, pruning and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import intent, keywords, quality_score, salience_floor


def score_unscored(messages: DataFrame, metadata: DataFrame, n: int = 10) -> DataFrame:
    """Q1: (message_id, quality_score, keywords) of messages whose metadata has no score yet; empty ones get 0."""
    todo = messages.join(metadata.filter("quality_score is null").select("message_id"), "message_id", "left_semi")
    words = keywords(todo.select(F.col("message_id").alias("id"), F.concat_ws(" ", "user_prompt", "model_response").alias("text")), n)
    words = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda s: s["keyword"]).alias("keywords"))
    score = quality_score(F.col("user_prompt"), F.col("model_response"))
    own = todo.select("message_id", score.alias("quality_score"))
    return own.join(words.hint("merge"), own.message_id == words.id, "left").select("message_id", "quality_score", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def propagate_salience(points: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q2: (point_id, salience) from the quality of the point's message; points without a score keep theirs. An
    evaluated salience_score of the metadata, where there is one, goes before what quality makes of the point's own."""
    evaluated = F.col("salience_score") if "salience_score" in metadata.columns else F.lit(None).cast("double")
    both = points.join(metadata.select("message_id", "quality_score", evaluated.alias("_evaluated")), "message_id", "left")
    s, q = F.col("salience"), F.col("quality_score")
    derived = F.when(q < 0.15, s * 0.3).when(q < 0.4, s * 0.7).when(q > 0.7, s + 0.1).otherwise(s)
    clipped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_evaluated", derived))), 4)
    return both.select("point_id", F.when(q.isNull(), s).otherwise(F.greatest(clipped, salience_floor(q))).alias("salience"))


def prunable(points: DataFrame, metadata: DataFrame, messages: DataFrame, as_of: str, age_days: int = 7, quality: float = 0.1, salience: float = 0.1) -> DataFrame:
    """Q3: (message_id) of old messages of low quality, synced if the metadata says (salience_synced), all of whose
    points have low salience and were never retrieved."""
    low = points.groupBy("message_id").agg(F.bool_and((F.col("salience") < salience) & F.col("last_retrieved").isNull()).alias("low")).filter("low")
    old = messages.filter(F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {age_days} days"))
    poor = metadata.filter(F.col("quality_score") < quality)
    if "salience_synced" in metadata.columns:
        poor = poor.filter("salience_synced")
    return poor.join(old.hint("merge"), "message_id", "left_semi").join(low.hint("merge"), "message_id", "left_semi").select("message_id")


def mining_queue(messages: DataFrame, metadata: DataFrame, since: int, least: float = 0.6) -> DataFrame:
    """Q4: (message_id, intent) past a watermark, of good quality, both sides present."""
    good = metadata.filter(F.col("quality_score") >= least).select("message_id")
    rows = messages.filter((F.col("message_id") > since) & (F.length("user_prompt") > 0) & (F.length("model_response") > 0)).join(good, "message_id", "left_semi")
    return rows.select("message_id", intent(F.col("user_prompt")).alias("intent"))


def format_threads(messages: DataFrame, target: DataFrame, cut: int = 800) -> DataFrame:
    """Q5: (conversation_id, thread): numbered turns cut to ``cut`` characters; target messages (message_id) are marked."""
    marked = messages.join(target.select("message_id", F.lit(" <<<").alias("mark")), "message_id", "left")
    line = F.concat(F.lit("["), F.col("sequence").cast("string"), F.lit("] "), F.substring("user_prompt", 1, cut), F.lit(" / "), F.substring("model_response", 1, cut), F.coalesce("mark", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("sequence", line.alias("line"))))
    return marked.groupBy("conversation_id").agg(F.array_join(F.transform(turns, lambda s: s["line"]), "\n").alias("thread"))
