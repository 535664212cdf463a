"""Turn building, registries, upserts and duplicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import content_hash, stripped


def _islands(turns: DataFrame) -> DataFrame:
    """Number the stretches that begin with a user turn; 0 before the first."""
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.filter(F.col("role").isin("user", "assistant")).withColumn("tri", users).filter("tri > 0")


def _numbered(triplets: DataFrame) -> DataFrame:
    return triplets.withColumn("sequence", F.row_number().over(Window.partitionBy("conv_id").orderBy("tri")).cast("long"))


def claude_triplets(turns: DataFrame) -> DataFrame:
    """(conv_id, sequence, user_prompt, model_response); assistants up to the next user are merged by line feeds."""
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    t = _islands(turns).groupBy("conv_id", "tri").agg(
        F.coalesce(F.max(F.when(F.col("role") == "user", F.col("text"))), F.lit("")).alias("user_prompt"),
        F.array_join(F.transform(said, lambda s: s["text"]), "\n").alias("model_response"),
    )
    return _numbered(t.filter("user_prompt <> '' or model_response <> ''")).select("conv_id", "sequence", "user_prompt", "model_response")


def google_turns(turns: DataFrame) -> DataFrame:
    """The last response before the next user turn wins; user turns without a response are dropped."""
    t = _islands(turns).groupBy("conv_id", "tri").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_prompt"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("model_response"))
    return _numbered(t.filter("user_prompt is not null and model_response is not null")).select("conv_id", "sequence", "user_prompt", "model_response")


def clean_thought(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+", " ")


def document_heads(docs: DataFrame) -> DataFrame:
    """(id, title, word_count): a heading among the first five lines, else the id; texts are trimmed, empty ones dropped."""
    text = stripped(F.col("content"))
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n")
    title = F.regexp_extract(head, r"(?m)^#{1,3} +(.+)$", 1)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    return docs.filter(F.length(text) > 0).select("id", F.when(title != "", title).otherwise(F.col("id").cast("string")).alias("title"), words.alias("word_count"))


def registry_delta(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(file_path, content_hash, state): new, changed, unchanged; failed files are tried again as changed."""
    known = registry.select("file_path", F.col("content_hash").alias("known"), "status")
    both = files.join(known, "file_path", "left")
    state = F.when(F.col("known").isNull(), "new").when((F.col("known") != F.col("content_hash")) | (F.col("status") == "failed"), "changed").otherwise("unchanged")
    return both.select("file_path", "content_hash", state.alias("state"))


def stale_chunks(chunks: DataFrame, delta: DataFrame, key: str = "file_path") -> DataFrame:
    """The chunks that stay when changed records lose theirs."""
    return chunks.join(delta.filter("state = 'changed'").select(key), key, "left_anti")


def new_documents(incoming: DataFrame, existing_titles: DataFrame) -> DataFrame:
    """Documents whose title is not known, and of equal contents among them only the first by id."""
    fresh = incoming.join(existing_titles.select("title").distinct(), "title", "left_anti").withColumn("hash", content_hash(F.col("content")))
    first = fresh.groupBy("hash").agg(F.min("id").alias("id"))
    return fresh.join(first, ["hash", "id"], "left_semi")


def orphans(items: DataFrame) -> DataFrame:
    """Items whose parent is missing."""
    return items.filter("parent_id is not null").join(items.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def insert_or_ignore(base: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Rows of an import whose key is not there yet."""
    return more.join(base.select(key), key, "left_anti")


def apply_patches(base: DataFrame, patches: DataFrame, key: str = "id", order: str = "at", clear: str | None = "__null__") -> DataFrame:
    """Keyed upsert. A null in a patch means no change, ``clear`` in a string column means null; the last patch of a key counts; ``deleted`` removes."""
    last = patches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
    deleted = F.coalesce(F.col("p.deleted"), F.lit(False)) if "deleted" in patches.columns else F.lit(False)
    both = base.alias("b").join(last.alias("p"), key, "full").filter(~deleted)

    def value(c: str) -> Column:
        if c == key or c not in last.columns:
            return F.col(key if c == key else f"b.{c}")
        merged = F.coalesce(F.col(f"p.{c}"), F.col(f"b.{c}"))
        is_text = clear is not None and dict(base.dtypes)[c] == "string"
        return F.when(F.col(f"p.{c}") == clear, None).otherwise(merged).alias(c) if is_text else merged.alias(c)

    return both.select(*(value(c) for c in base.columns))


def expire(rows: DataFrame, column: str, as_of: str, days: int, only: Column | None = None) -> DataFrame:
    """Rows younger than ``days``; with ``only``, others stay whatever their age."""
    young = F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return rows.filter(young | ~only if only is not None else young)


def missing_metadata(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """A default row for each message without one."""
    return messages.join(metadata, "message_id", "left_anti").select("message_id", F.lit(0.0).alias("quality_score"), F.lit("").alias("labels"))


def repaired_dates(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(message_id, created_at, repaired): messages take their conversation's date where the days differ."""
    both = messages.join(conversations.select("conversation_id", F.col("created_at").alias("born")), "conversation_id")
    off = F.to_date("created_at") != F.to_date("born")
    return both.select("message_id", F.when(off, F.col("born")).otherwise(F.col("created_at")).alias("created_at"), off.alias("repaired"))


def rewrite(texts: DataFrame, rules: list[tuple[str, str]], high: int = 20) -> DataFrame:
    """(id, content, replacements, flag): ordered regex rewrites with their count."""
    content, count = F.col("content"), F.lit(0)
    for pattern, to in rules:
        count = count + F.regexp_count(content, F.lit(pattern))
        content = F.regexp_replace(content, pattern, to)
    flag = F.when(F.col("replacements") == 0, "zero").when(F.col("replacements") > high, "high").otherwise("ok")
    return texts.select("id", content.alias("content"), count.cast("long").alias("replacements")).withColumn("flag", flag)


def exact_duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Groups of equal rows as (hash, n, first_id): a row per group, not per pair."""
    return rows.select("id", key.alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def duplicate_links(rows: DataFrame, key: Column) -> DataFrame:
    """(id, first_id): every duplicate with the first row of its group."""
    own = rows.select("id", key.alias("hash"))
    return own.join(exact_duplicates(rows, key), "hash").filter("id <> first_id").select("id", "first_id")


def numbered(rows: DataFrame, by: str, name: str, width: int = 1_000_000) -> DataFrame:
    """Rows with their place from 0 in the order of a unique whole number, counted within ranges of ``width`` numbers;
    only the ranges' totals come together in one task."""
    own = rows.withColumn("_range", F.floor(F.col(by) / width))
    totals = own.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return own.withColumn("_at", within).join(totals.select("_range", F.coalesce(before, F.lit(0)).alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
