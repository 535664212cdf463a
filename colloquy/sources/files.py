"""Readers and writers of exports, texts, graphs and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import stripped

CLAUDE = "uuid string, name string, created_at string, chat_messages array<struct<sender: string, text: string, content: array<struct<type: string, thinking: string, text: string, name: string>>>>"
GOOGLE = "runSettings struct<model: string>, systemInstruction struct<parts: array<struct<text: string>>>, chunkedPrompt struct<chunks: array<struct<role: string, isThought: boolean, text: string, parts: array<struct<text: string>>>>>"
QUEST = "anchor struct<parent_node_label: string, parent_node_name: string, parent_node_id: string>, topology_plan struct<nodes_to_create: array<struct<label: string, properties: map<string, string>>>, relationships_to_create: array<struct<start_node: string, end_node: string, type: string>>>"


def _stem(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_claude_export(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, title, created_at, turn, role, text, thinking, tools); blocks of a kind joined by line feeds."""
    rows = spark.read.schema(CLAUDE).option("multiLine", True).json(path)
    turns = rows.select(F.col("uuid").alias("conv_id"), F.col("name").alias("title"), "created_at", F.posexplode("chat_messages").alias("turn", "m"))
    part = lambda kind, field: F.array_join(F.transform(F.filter("m.content", lambda b: (b["type"] == kind) & b[field].isNotNull()), lambda b: b[field]), "\n")
    text = part("text", "text")
    role = F.when(F.col("m.sender") == "human", "user").otherwise("assistant")
    return turns.select("conv_id", "title", "created_at", "turn", role.alias("role"), F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce("m.text", F.lit(""))).alias("text"), part("thinking", "thinking").alias("thinking"), part("tool_use", "name").alias("tools"))


def read_google_export(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, title, model, system, turn, role, thought, text); files without chunks are dropped."""
    rows = spark.read.schema(GOOGLE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.filter(F.size("chunkedPrompt.chunks") > 0)
    system = F.array_join(F.transform("systemInstruction.parts", lambda p: p["text"]), " ")
    turns = rows.select(F.sha2("file", 256).alias("conv_id"), _stem(F.col("file")).alias("title"), F.col("runSettings.model").alias("model"), system.alias("system"), F.posexplode("chunkedPrompt.chunks").alias("turn", "c"))
    parts = F.array_join(F.transform("c.parts", lambda p: p["text"]), "\n")
    text = F.when(F.coalesce(parts, F.lit("")) != "", parts).otherwise(F.coalesce("c.text", F.lit("")))
    return turns.select("conv_id", "title", "model", "system", "turn", F.when(F.col("c.role") == "user", "user").otherwise("assistant").alias("role"), F.coalesce("c.isThought", F.lit(False)).alias("thought"), text.alias("text"))


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("md", "txt"), exclude: str | None = None) -> DataFrame:
    """(file_path, title, content, word_count, modified, content_hash) of text files; empty ones are dropped."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), stripped(F.col("value")).alias("content"))
    rows = rows.filter(F.col("file_path").rlike(r"\.(" + "|".join(extensions) + ")$") & (F.length("content") > 0))
    if exclude:
        rows = rows.filter(~F.col("file_path").rlike(exclude))
    title = F.regexp_extract(F.array_join(F.slice(F.split("content", "\n"), 1, 5), "\n"), r"(?m)^#{1,3} +(.+)$", 1)
    named = F.when(title != "", title).otherwise(F.translate(_stem(F.col("file_path")), "_-", "  "))
    return rows.select("file_path", named.alias("title"), "content", F.size(F.split("content", r"\s+")).alias("word_count"), "modified", F.sha2("content", 256).alias("content_hash"))


def read_quest(spark: SparkSession, path: str) -> DataFrame:
    """(title, content, n_nodes, n_relationships); files without an anchor or nodes are dropped."""
    rows = spark.read.schema(QUEST).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.filter(F.col("anchor").isNotNull() & (F.size("topology_plan.nodes_to_create") > 0))
    line = lambda n: F.concat_ws(": ", n["properties"]["name"], n["properties"]["content"])
    title = F.coalesce("anchor.parent_node_name", "anchor.parent_node_label", _stem(F.col("file")))
    return rows.select(title.alias("title"), F.array_join(F.transform("topology_plan.nodes_to_create", line), "\n").alias("content"), F.size("topology_plan.nodes_to_create").alias("n_nodes"), F.greatest(F.size("topology_plan.relationships_to_create"), F.lit(0)).alias("n_relationships"))


def export_platform(tables: dict[str, DataFrame], path: str, version: str = "0.6.0") -> None:
    """One JSON line per row, tagged with its table and the schema version, dealt over as many files as there are partitions."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(version).alias("schema_version"), F.lit(name).alias("table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.union(rows)
    out.write.mode("errorifexists").json(path)


def import_platform(spark: SparkSession, path: str, schemas: dict[str, str], version: str = "0.6.0") -> dict[str, DataFrame]:
    """The tables of an export; rows of another version are refused."""
    rows = spark.read.schema("schema_version string, `table` string, row string").json(path)
    if rows.filter(F.col("schema_version") != version).limit(1).count():
        raise ValueError("the export has another schema version")
    return {name: rows.filter(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*") for name, schema in schemas.items()}


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as Parquet; an import reads them in place of what was there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def inventory(spark: SparkSession, root: str, extensions: tuple[str, ...], skip: tuple[str, ...] = (".git", "node_modules"), markers: str = r"(pyproject\.toml|package\.json)$") -> DataFrame:
    """(directory, files, bytes, is_project) below a root; only paths and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    files = files.withColumn("parts", F.split("path", "/")).filter(~F.arrays_overlap("parts", F.array(*map(F.lit, skip))))
    wanted = F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$")
    directory = F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/")
    return files.groupBy(directory.alias("directory")).agg(F.count_if(wanted).alias("files"), F.coalesce(F.sum(F.when(wanted, F.col("length"))), F.lit(0)).alias("bytes"), F.bool_or(F.col("path").rlike(markers)).alias("is_project"))
