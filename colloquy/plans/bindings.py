"""The engine's tables as built from the Parquet tables of a data folder.

Everything is integer arithmetic and constants, so that the same tables can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import claude_triplets

AS_OF = "2024-02-15 00:00:00"


#: Lines that one task groups.
LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after(hours=0, minutes=0):
    """2024-01-01 plus columns of hours and minutes."""
    seconds = F.lit(1704067200) + F.lit(hours) * 3600 + F.lit(minutes) * 60 if not hasattr(hours, "cast") else F.lit(1704067200) + hours * 3600 + (minutes if hasattr(minutes, "cast") else F.lit(minutes)) * 60
    return F.timestamp_seconds(seconds)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: message_id, conversation_id, sequence, user_prompt, model_response, created_at."""
    t = claude_triplets(table(spark, sf_dir, "conversations"))
    made = after(F.col("conv_id"), F.col("sequence"))
    return t.select((F.col("conv_id") * 1000 + F.col("sequence")).alias("message_id"), F.col("conv_id").alias("conversation_id"), "sequence", "user_prompt", "model_response", made.alias("created_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: id, title, content, doc_type, source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.col("lang").alias("doc_type"), "source")


def mentions(spark: SparkSession, sf_dir: str, entity: str = "l_suppkey") -> DataFrame:
    """The smallest rowid of each (entity, message)."""
    lines = table(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, lines.count() // LINES + 1)  # so a task's memory does not grow with the table
    orders = table(spark, sf_dir, "orders").repartition(parts, "o_orderkey")
    both = lines.repartition(parts, "l_orderkey").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rowid"), F.col(entity).alias("entity_id"), F.col("l_orderkey").alias("message_id"), F.col("o_custkey").alias("conversation_id"), F.col("l_discount").alias("relevance"), F.col("l_shipdate").alias("created_at"))
    rest = F.struct("rowid", "conversation_id", "relevance", "created_at")
    return rows.groupBy("message_id", "entity_id").agg(F.min(rest).alias("r")).select("r.rowid", "entity_id", "message_id", "r.conversation_id", "r.relevance", "r.created_at")


def entities(spark: SparkSession, sf_dir: str, variants: bool = False) -> DataFrame:
    """Suppliers with their mentions summed up; ``variants`` adds names to find duplicates among,
    with ids beyond those of the suppliers: theirs plus one, two or three times the next multiple of 1,000."""
    supplier = table(spark, sf_dir, "supplier")
    seen = mentions(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))
    base = supplier.join(seen, supplier.s_suppkey == seen.entity_id, "left").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6).alias("entity_type"), F.col("s_name").alias("name"), F.coalesce("n", F.lit(0)).alias("mention_count"), "first_seen_at", "last_seen_at", F.lit(0.5).alias("salience"))
    if not variants:
        return base
    digit = F.col("id") % 10
    step = supplier.agg((F.floor(F.max("s_suppkey") / 1000) * 1000 + 1000).alias("step"))  # one row
    more = [(1, F.concat(F.lit("The "), F.col("name"))), (2, F.concat(F.col("name"), F.lit("s"))), (3, F.upper("name"))]
    for d, name in more:
        own = entities(spark, sf_dir).filter(digit == d).join(F.broadcast(step))
        base = base.union(own.select((F.col("id") + d * F.col("step")).alias("id"), "entity_type", name.alias("name"), F.lit(0).cast("long").alias("mention_count"), "first_seen_at", "last_seen_at", "salience"))
    return base


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector points of two collections."""
    v = F.col("vec_id")
    made = after(v)
    return table(spark, sf_dir, "embeddings").select(v.alias("point_id"), F.col("embedding").alias("vector"), (v % 2).alias("collection"), (v % 40).alias("conversation_id"), F.floor(v / 3).alias("parent_id"), ((v % 11) / 10).alias("salience"), made.alias("created_at"), F.when(v % 4 != 0, made).alias("last_retrieved"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records."""
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("operation"), (F.col("user_id") % 9).alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))


#: The statuses of items, in the order of c_custkey % 8.
STATUSES = ("not_started", "planning", "in_progress", "blocked", "review", "completed", "shipped", "archived")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as top level, customers below them."""
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("c_custkey") % 8 + 1).cast("int"))
    top = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("project").alias("entity_type"), F.lit("top").alias("domain"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("title"), F.lit("in_progress").alias("status"), F.lit(1).cast("long").alias("priority"))
    low = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("feature"), "c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name", status, (1 + F.col("c_custkey") % 5).cast("long"))
    return top.union(low)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("task_type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target_item_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), F.col("o_orderdate").alias("created_at"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task implements an item."""
    return tasks(spark, sf_dir).select(F.lit("task").alias("source_type"), F.col("id").cast("string").alias("source_id"), F.lit("item").alias("target_type"), F.col("target_item_id").alias("target_id"), F.lit("implements").alias("relationship_type"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message, with scores and keywords."""
    from ..functions.text import keywords

    m = F.col("message_id")
    own = messages(spark, sf_dir)
    words = keywords(own.select(m.alias("id"), F.concat_ws(" ", "user_prompt", "model_response").alias("text")), 5).groupBy("id").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    return own.join(words.hint("merge"), m == F.col("id"), "left").select("message_id", F.when(m % 5 != 0, (m * 37) % 101 / 100).alias("quality_score"), ((m * 13) % 5000).alias("latency_total_ms"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application logs."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), level.alias("level"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("module"), F.col("event_type").alias("message"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file registry."""
    status = F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("skipped")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("ingestion_type"), status.alias("status"), (F.col("doc_id") % 7).alias("entity_count"))
