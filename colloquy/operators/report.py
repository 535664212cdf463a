"""Listings, roll-ups, boards, coverage, alerts and gates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F


def listing(rows: DataFrame, order: list[Column], n: int, **equal) -> DataFrame:
    """Rows equal in every argument that is given, in order, cut."""
    for c, v in equal.items():
        rows = rows if v is None else rows.filter(F.col(c) == v)
    return rows.orderBy(*order).limit(n)


def like(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Case-insensitive substring; % and _ stand for themselves."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.filter(F.col(column).ilike(f"%{escaped}%"))


def roles(turns: DataFrame, role: str | None = None, prefix: str | None = None) -> DataFrame:
    """P3."""
    return turns.filter(F.col("role") == role if role is not None else F.col("role").startswith(prefix))


def json_field(column: str, path: str, kind: str) -> Column:
    """A value of a JSON text, null where it is not there or of another kind."""
    return F.get_json_object(column, path).try_cast(kind)


def json_or_raw(column: str) -> Column:
    """(parsed, raw): a JSON object's fields as texts; for anything else, the text as it stands."""
    parsed = F.from_json(column, "map<string, string>")
    good = parsed.isNotNull() & F.col(column).rlike(r"^\s*\{")
    return F.struct(F.when(good, parsed).alias("parsed"), F.when(~F.coalesce(good, F.lit(False)), F.col(column)).alias("raw"))


def display(items: DataFrame, date: str | None = None) -> DataFrame:
    """Ids cut to eight characters, enums in title case, a date cut to the minute (16 characters)."""
    shown = [F.date_format(date, "yyyy-MM-dd HH:mm").alias(date)] if date else []
    return items.select(F.substring("id", 1, 8).alias("id"), F.initcap(F.replace("status", F.lit("_"), F.lit(" "))).alias("status"), "title", *shown)


def signals(rows: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows in which any of the words stands in any of the columns."""
    return rows.filter(functools.reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for c in columns for w in words)))


#: Priorities by name, in their order.
RANKS = ("critical", "high", "normal", "low")


def priority_rank(name: Column) -> Column:
    """K2: the place of a named priority, unknown ones last."""
    return functools.reduce(lambda c, x: c.when(F.lower(name) == x[1], x[0]), enumerate(RANKS), F.when(F.lit(False), -1)).otherwise(len(RANKS))


def active(items: DataFrame, n: int = 20) -> DataFrame:
    """Open items by priority, titles and ids breaking ties."""
    return items.filter(~F.col("status").isin("completed", "shipped", "archived")).orderBy("priority", "title", "id").limit(n)


def open_tasks(tasks: DataFrame, n: int = 20) -> DataFrame:
    """Tasks that are not done, by the rank of their priority's name, the oldest first."""
    return tasks.filter(~F.col("status").isin("completed", "failed", "cancelled")).orderBy(priority_rank(F.col("priority")), "created_at", "id").limit(n)


def needs_retrieval(text: Column, stopwords: list[str]) -> Column:
    """P10: three words or more between white space, two of them no stopwords."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return (F.size(words) >= 3) & (F.size(F.filter(words, lambda w: ~w.isin(stopwords))) >= 2)


def with_children_of(parents: DataFrame, rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Parents with those of their rows (key, entity_type) that have one type, all parents kept."""
    own = rows.withColumnRenamed(key, "_key")
    return parents.join(own.hint("merge"), (parents[key] == F.col("_key")) & (F.col("entity_type") == kind), "left").drop("_key")


def conversations_of(messages: DataFrame, matches: Column) -> DataFrame:
    """The distinct conversations of the messages that match."""
    return messages.filter(matches).select("conversation_id").distinct()


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """The number of different pairs (a, b), either way round."""
    return pairs.agg(F.countDistinct(F.struct(F.least("a", "b"), F.greatest("a", "b"))).alias("pairs"))


def used_means(hits: DataFrame, used: Column) -> DataFrame:
    """(qid, used, mean_score, mean_salience) over the hits of each query that were used."""
    return hits.filter(used).groupBy("qid").agg(F.count("*").alias("used"), F.avg("score").alias("mean_score"), F.avg("salience").alias("mean_salience"))


def edges_touching(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, direction, other, relationship_type) of relationships at either end of a node (id)."""
    out = rels.join(nodes, F.col("source_id") == F.col("id")).select("id", F.lit("out").alias("direction"), F.col("target_id").alias("other"), "relationship_type")
    return out.union(rels.join(nodes, F.col("target_id") == F.col("id")).select("id", F.lit("in"), "source_id", "relationship_type"))


def with_recent_children(parent: DataFrame, child: DataFrame, key: str, order: list[Column], value: str, n: int = 20) -> DataFrame:
    """Parents with the list of their newest children."""
    recent = child.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n)
    lists = recent.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda s: s[value]).alias("recent"))
    return parent.join(lists, key, "left")


def count_by(rows: DataFrame, **columns: str) -> DataFrame:
    """A1: (metric, value, n) for several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for m, c in columns.items()))).alias("p")
    return rows.select(pairs).groupBy("p.metric", "p.value").agg(F.count("*").alias("n"))


def conversation_rollup(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, turns, last_turn, chars, tokens); ``conversations`` (conv_id) keeps those without a turn. A token is
    counted for every four characters begun."""
    size = F.length("text")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.sum(size).alias("chars"), F.sum(F.ceil(size / 4)).alias("tokens"))
    if conversations is None:
        return own
    return conversations.join(own.hint("merge"), "conv_id", "left").fillna(0, ["turns", "chars", "tokens"])


def document_frequency(docs: DataFrame, words: Column) -> DataFrame:
    """(term, df): each term once per document."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def batch_stopwords(df_table: DataFrame, n_docs: int, threshold: float, least: int = 5, most: int = 500) -> DataFrame:
    """The terms that max(least, n * threshold) documents or more hold, the most frequent first."""
    return df_table.filter(F.col("df") >= max(least, int(n_docs * threshold))).orderBy(F.desc("df"), "term").limit(most)


def introspection(metadata: DataFrame, n: int = 50, top: int = 5) -> DataFrame:
    """A10: (keyword, n): the most frequent keywords of the last n scored rows."""
    last = metadata.filter("quality_score is not null").orderBy(F.desc("message_id")).limit(n)
    return last.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(top)


def introspection_summary(metadata: DataFrame, n: int = 50, top: int = 5, shown: int = 3) -> DataFrame:
    """A10: one row: how many of the last n scored rows there are, their mean score, their most frequent keywords, and the
    first rationales among them, the newest first."""
    last = metadata.filter("quality_score is not null").orderBy(F.desc("message_id")).limit(n)
    said = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.length("rationale") > 0, F.struct((-F.col("message_id")).alias("k"), "rationale")))), 1, shown), lambda s: s["rationale"])
    one = last.agg(F.count("*").alias("rows"), F.avg("quality_score").alias("mean_score"), said.alias("rationales"))
    common = introspection(metadata, n, top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "keyword"))), lambda s: s["keyword"]).alias("keywords"))
    return one.join(F.broadcast(common))  # one row each


def last_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """W3."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")


def next_sequence(existing: DataFrame, appended: DataFrame, group: str, number: str, order: str) -> DataFrame:
    """Appended rows numbered on from the highest number of their group."""
    top = existing.groupBy(group).agg(F.max(number).alias("_top"))
    w = Window.partitionBy(group).orderBy(order)
    return appended.join(top, group, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).drop("_top")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """W6."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def elapsed_bands(rows: DataFrame, group: str, ts: str, key: str, bounds: list[int], names: list[str]) -> DataFrame:
    """Minutes since the row before in the group, in bands; ``key`` breaks ties of time."""
    gap = F.floor((F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(Window.partitionBy(group).orderBy(ts, key)))) / 60)
    band = functools.reduce(lambda c, b: c.when(F.col("minutes") < b[0], b[1]), zip(bounds, names, strict=False), F.when(F.col("minutes").isNull(), "first"))
    return rows.withColumn("minutes", gap).withColumn("band", band.otherwise(names[-1]))


def surface(rows: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """K5: (place, id, content): ``n`` of the rows (id, weight, content) by chance, none twice, each draw by weight.

    Each row has an exponential key, -ln(u) / weight with u a hash of its id and the seed; the n smallest keys are such a draw
    (Efraimidis and Spirakis). One top-n over all tasks, and the same rows for the same seed. Rows without a weight above 0 are
    never drawn.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    key = -F.log((u + 0.5) / 4294967296) / F.col("weight")
    drawn = rows.filter("weight > 0").select("id", "content", key.alias("key")).orderBy("key", "id").limit(n)
    return drawn.withColumn("place", F.row_number().over(Window.orderBy("key", "id")) - 1).select("place", "id", "content")  # n rows


def surfaced(kinds: dict[str, DataFrame], turns: int, seed: int, most: int = 1200) -> DataFrame:
    """K5: (turn, kind, id, content): what comes up in each of so many turns, the kinds in rotation, each a table as surface() reads,
    contents cut. A kind with fewer rows than turns leaves its later turns out."""
    out = None
    for k, (kind, rows) in enumerate(kinds.items()):
        drawn = surface(rows, seed + k, -(-(turns - k) // len(kinds)))
        own = drawn.select((F.col("place") * len(kinds) + k).cast("long").alias("turn"), F.lit(kind).alias("kind"), "id", F.substring("content", 1, most).alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def sprint_view(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """M1: (id, children, shipped, in_progress, tasks, completed): all parents at once."""
    kids = items.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.count_if(F.col("status") == "shipped").alias("shipped"), F.count_if(F.col("status") == "in_progress").alias("in_progress"))
    done = tasks.join(items.select(F.col("id").alias("target_item_id"), "parent_id"), "target_item_id").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"))
    return kids.join(done, "id", "left").na.fill(0, ["tasks", "completed"])


#: The columns of the boards with their titles and statuses, the types that are no cards, and the days for which finished
#: cards are shown.
ITEM_COLUMNS = {"Backlog": ["not_started"], "Planning": ["planning"], "In Progress": ["in_progress"], "Blocked": ["blocked"], "Review": ["review"], "Done": ["completed", "shipped"]}
TASK_COLUMNS = {"Pending": ["pending"], "Processing": ["processing"], "Review": ["review"], "Done": ["completed"], "Failed": ["failed", "retry", "dlq"]}
CONTAINERS = ["project", "book", "chapter"]
DONE_DAYS = 14


def cards(rows: DataFrame, columns: dict[str, list[str]], as_of: str, kind: str | None = None) -> DataFrame:
    """M2: the rows (status, created_at, updated_at, and entity_type where there is one) that a board shows, with its ``column``, their
    ``age`` in whole days and whether they are ``shown``: finished ones are for 14 days after their last change. One ``kind``
    of items may be asked for; without one, containers are left out. Statuses that have no column are, too."""
    at = F.lit(as_of).cast("timestamp")
    column = functools.reduce(lambda c, x: c.when(F.col("status").isin(x[1]), x[0]), columns.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    if "entity_type" in rows.columns:
        rows = rows.filter(F.col("entity_type") == kind if kind else ~F.col("entity_type").isin(CONTAINERS))
    whole = lambda c: F.greatest(F.lit(0), F.floor((F.unix_timestamp(at) - F.unix_timestamp(c)) / 86400)).cast("long")
    recent = F.unix_timestamp("updated_at") >= F.unix_timestamp(at) - DONE_DAYS * 86400
    return rows.withColumn("column", column).filter("column is not null").withColumn("age", F.coalesce(whole("created_at"), F.lit(0))).withColumn("shown", (F.col("column") != "Done") | F.coalesce(recent, F.lit(False)))


def board(rows: DataFrame, columns: dict[str, list[str]], as_of: str, kind: str | None = None) -> DataFrame:
    """M2: (column, n, shown, oldest): all and shown cards of each column that has any, and the age of the oldest shown one."""
    own = cards(rows, columns, as_of, kind)
    return own.groupBy("column").agg(F.count("*").alias("n"), F.count_if("shown").alias("shown"), F.max(F.when(F.col("shown"), F.col("age"))).alias("oldest"))


def parents(items: DataFrame) -> DataFrame:
    """M3, J6."""
    return items.join(items.select(F.col("parent_id").alias("id")).filter("id is not null").distinct(), "id", "left_semi").select("id", "title")


def coverage(messages: DataFrame, metadata: DataFrame, chunked: DataFrame) -> DataFrame:
    """M4: one row: messages, scored, keyworded, chunked."""
    both = messages.select("message_id").join(metadata, "message_id", "left").join(chunked.select("message_id", F.lit(1).alias("c")), "message_id", "left")
    return both.agg(F.count("*").alias("messages"), F.count("quality_score").alias("scored"), F.count_if(F.size("keywords") > 0).alias("keyworded"), F.count("c").alias("chunked"))


def alerts(messages: DataFrame, metadata: DataFrame, points: DataFrame, nodes: DataFrame, runs: DataFrame, collections: list, cycles: list[str]) -> DataFrame:
    """M5: (level, message), a row for each rule that applies, a single ok where none does.

    Rules: cycles that ran without output (runs: name, n), collections without points, a graph without nodes, messages
    without metadata. Every rule is a count of one table.
    """
    spark = messages.sparkSession
    own = runs.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 0").select("name")
    idle = spark.createDataFrame([(i, c) for i, c in enumerate(cycles)], "i int, name string").join(own.hint("merge"), "name", "left_anti")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]), ", ")
    idle = idle.agg(F.count("*").alias("n"), names.alias("names")).filter("n > 0").select(F.lit("warning").alias("level"), F.concat(F.lit("cycles producing 0 output: "), "names").alias("message"))
    held = points.select(F.col("collection").cast("string").alias("name")).distinct()
    empty = spark.createDataFrame([(str(c),) for c in collections], "name string").join(held.hint("merge"), "name", "left_anti")
    empty = empty.select(F.lit("warning"), F.concat(F.lit("collection '"), "name", F.lit("' has 0 points")))
    bare = nodes.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("warning"), F.lit("graph has 0 nodes"))
    missing = messages.join(metadata.select("message_id").hint("merge"), "message_id", "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    missing = missing.select(F.lit("warning"), F.concat(F.col("n").cast("string"), F.lit(" messages missing metadata")))
    found = idle.union(empty).union(bare).union(missing)
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("ok"), F.lit("All systems healthy"))
    return found.union(none)


def gate_report(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """M6: (gate, result): PASS where an aggregate condition holds, else FAIL."""
    one = rows.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("gate"), F.when(F.col(n), "PASS").otherwise("FAIL").alias("result")) for n in checks))
    return one.select(F.explode(pairs).alias("g")).select("g.gate", "g.result")


def turn_metrics(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """M7: (conversation_id, turns, mean_latency, mean_quality, last_turn, last_latency): means, and the latest turn's own."""
    both = messages.join(metadata.hint("merge"), "message_id", "left")
    own = [F.count("*").alias("turns"), F.round(F.avg("latency_total_ms"), 6).alias("mean_latency"), F.round(F.avg("quality_score"), 6).alias("mean_quality")]
    return both.groupBy("conversation_id").agg(*own, F.max("sequence").alias("last_turn"), F.max_by("latency_total_ms", "sequence").alias("last_latency"))


def run_counters(logs: DataFrame) -> DataFrame:
    """M8: (module, runs, errors, latest)."""
    return logs.groupBy("module").agg(F.count("*").alias("runs"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.max("id").alias("latest"))
