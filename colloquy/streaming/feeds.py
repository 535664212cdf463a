"""Change feeds, incremental runs and stateful folds on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.intent import advance, observed
from ..operators.ingest import registry_delta

KEY = ["entity_type", "entity_id"]


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each (entity_type, entity_id), by id."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("id")))).filter("_n = 1").drop("_n")


def merged(snapshot: DataFrame | None, changes: DataFrame) -> DataFrame:
    """A snapshot (entity_type, entity_id, payload, id) after changes; deletions remove, later ids win, so that
    changes applied twice give the same snapshot. Deleted keys stay as rows without payload: tombstones."""
    new = latest_changes(changes).select(*KEY, F.when(F.col("operation") != "DELETE", F.col("payload")).alias("payload"), "id")
    if snapshot is None:
        return new
    return snapshot.unionByName(new).withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("id")))).filter("_n = 1").drop("_n")


def live(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter("payload is not null")


#: What a sink keeps beside its snapshot: changes that wait for another attempt, and those set aside.
WAITING = "entity_type long, entity_id long, id long, operation string, payload string, attempts int, error string"


def accepts(changes: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """An attempt that every change passes."""
    return changes.withColumn("error", F.lit(None).cast("string"))


def parses(changes: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """An attempt: payloads of rows that are no deletions must be JSON. Adds ``error``, null where the change can be applied."""
    bad = (F.col("operation") != "DELETE") & F.try_parse_json("payload").isNull()
    return changes.withColumn("error", F.when(bad, "payload is no JSON"))


def parent_known(changes: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """An attempt: what parses(), and a row whose payload names a ``parent`` of its type needs that row, in the snapshot or among
    the changes at hand."""
    rows = parses(changes, snapshot)
    there = rows.filter("error is null and operation <> 'DELETE'").select("entity_type", F.col("entity_id").alias("_p"))
    if snapshot is not None:
        there = there.union(live(snapshot).select("entity_type", "entity_id"))
    parent = F.try_variant_get(F.try_parse_json("payload"), "$.parent", "long")
    both = rows.withColumn("_p", parent).join(there.distinct().withColumn("_there", F.lit(True)).hint("merge"), ["entity_type", "_p"], "left")
    missing = F.col("error").isNull() & F.col("_p").isNotNull() & F.col("_there").isNull()
    return both.withColumn("error", F.when(missing, "parent is not there").otherwise(F.col("error"))).select(*changes.columns, "error")


def attempt_all(snapshot: DataFrame | None, waiting: DataFrame | None, changes: DataFrame, attempt=accepts, most: int = 3, known: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot, waiting, set aside) after one round: new changes and those that wait are tried; what fails waits for the next
    round, up to ``most`` attempts, and is then set aside with its error. Types that are not ``known`` are set aside at once.

    A change that succeeds late does not undo later ones of its key: the highest id wins.
    """
    fresh = changes.select(*KEY, "id", "operation", "payload", F.lit(0).alias("attempts"))
    own = fresh if waiting is None else fresh.unionByName(waiting.select(*fresh.columns))
    strange = F.lit(False) if known is None else ~F.col("entity_type").isin(known)
    tried = attempt(own.filter(~strange), snapshot).withColumn("attempts", F.col("attempts") + 1)
    good, bad = tried.filter("error is null"), tried.filter("error is not null")
    aside = bad.filter(F.col("attempts") >= most).unionByName(own.filter(strange).withColumn("error", F.lit("unknown type")))
    columns = [c.split()[0] for c in WAITING.split(", ")]
    return merged(snapshot, good), bad.filter(F.col("attempts") < most).select(*columns), aside.select(*columns)


def _pointer(spark: SparkSession, path: str) -> str | None:
    """The newest complete round that the pointer beside a sink's rounds names, if there is one."""
    try:
        name = spark.read.text(f"{path}/_pointer.d").orderBy(F.desc("value")).first()
    except AnalysisException:
        return None
    return None if name is None else name.value.split(" ")[1]


def _part(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    name = _pointer(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}/{part}")


def apply_cdc(stream: DataFrame, path: str, checkpoint: str, attempt=accepts, most: int = 3, known: list[int] | None = None) -> StreamingQuery:
    """One sink of a change feed: its snapshot, the changes that wait and those set aside, under ``path``.

    Each batch writes the three tables of its round and then adds a line to the pointer, so readers see whole rounds. A batch that
    Spark runs again after a crash starts from the round before it and replaces nothing that readers saw. Every sink is a
    query with its own folder and checkpoint: one that fails or lags does not hold up another.
    """

    def batch(changes: DataFrame, number: int) -> None:
        spark = changes.sparkSession
        last = _pointer(spark, path)
        if last is not None and int(last.split("-")[0]) >= number:
            return  # this batch was completed before the crash
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        parts = attempt_all(_part(spark, path, "snapshot"), _part(spark, path, "waiting"), changes.select("id", "operation", *KEY, "payload"), attempt, most, known)
        for part, rows in zip(("snapshot", "waiting", "aside"), parts, strict=True):
            rows.write.parquet(f"{path}/{name}/{part}")
        spark.range(1).select(F.lit(f"{number:012d} {name}").alias("value")).write.mode("append").text(f"{path}/_pointer.d")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """What a sink has built so far, without deleted keys."""
    return live(_part(spark, path, "snapshot"))


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """The changes that a sink will try again with its next batch."""
    return _part(spark, path, "waiting")


def set_aside(spark: SparkSession, path: str) -> DataFrame:
    """All changes that a sink gave up, of every complete round."""
    names = [r.value.split(" ")[1] for r in spark.read.text(f"{path}/_pointer.d").collect()]  # a line per batch
    return spark.read.parquet(*[f"{path}/{n}/aside" for n in names])


def diff_snapshots(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, operation, payload): INSERT, UPDATE or DELETE by a full join and a comparison of all columns."""
    row = lambda df: df.select(key, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("payload"))
    both = row(old).withColumnRenamed("payload", "was").join(row(new), key, "full")
    kind = F.when(F.col("was").isNull(), "INSERT").when(F.col("payload").isNull(), "DELETE").when(F.col("was") != F.col("payload"), "UPDATE")
    return both.select(key, kind.alias("operation"), F.coalesce("payload", "was").alias("payload")).filter("operation is not null")


class _Hypotheses(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("hypotheses", "name string", "confidence double, seen int, first int, last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        turns = pd.concat(list(rows)).sort_values("sequence")
        state = {k[0]: tuple(v) for k, v in self.state.iterator()} if self.state.exists() else {}
        out = []
        for t in turns.itertuples():
            state = advance(state, t.name, t.confidence, int(t.sequence))
            out += [(key[0], int(t.sequence), n, *v) for n, v in state.items()]
        self.state.clear()
        for n, v in state.items():
            self.state.updateValue((n,), v)
        yield pd.DataFrame(out, columns=["conversation_id", "sequence", "name", "confidence", "seen", "first", "last"])

    def close(self) -> None:
        pass


def stream_hypotheses(messages: DataFrame) -> DataFrame:
    """S3: intent hypotheses over a stream of messages; needs the RocksDB state store."""
    return observed(messages).groupBy("conversation_id").transformWithStateInPandas(_Hypotheses(), "conversation_id long, sequence int, name string, confidence double, seen int, first int, last int", "append", "none")


class _Salience(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("salience", "salience double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = self.value.get()[0] if self.value.exists() else 0.5
        for u in pd.concat(list(rows)).sort_values("at")["usage"]:
            s = min(1.0, s + 0.03 * u) if u > 0.3 else max(0.1, s - 0.01) if u < 0.1 else s
        self.value.update((s,))
        yield pd.DataFrame({"point_id": [key[0]], "salience": [s]})

    def close(self) -> None:
        pass


def stream_salience(usages: DataFrame) -> DataFrame:
    """Salience by point over a stream of usages (point_id, at, usage)."""
    return usages.groupBy("point_id").transformWithStateInPandas(_Salience(), "point_id long, salience double", "update", "none")


def process_since(mentions: DataFrame, mark: int, key: str = "entity_id", order: str = "rowid") -> tuple[DataFrame, DataFrame]:
    """All rows of the keys that have rows past a mark, for their full recount, and the new mark (one row)."""
    touched = mentions.filter(F.col(order) > mark).select(key).distinct()
    return mentions.join(touched, key, "left_semi"), mentions.agg(F.max(order).alias("mark"))


def ingest_files(stream: DataFrame, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Keep a registry of files up to date from a stream of them (file_path, content_hash): a row (file_path,
    content_hash, state, status, batch) for each that is new or changed. Use it with the source ``changed_files``, which
    also sees edits; a batch that runs again adds nothing."""

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        try:
            whole = spark.read.parquet(registry_path)
        except AnalysisException:
            whole = spark.createDataFrame([], "file_path string, content_hash string, state string, status string, batch long")
        if whole.filter(F.col("batch") == number).limit(1).count():
            return
        known = whole.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("batch")))).filter("_n = 1").select("file_path", "content_hash", "status")
        delta = registry_delta(files.select("file_path", "content_hash").distinct(), known).filter("state <> 'unchanged'")
        delta.select("file_path", "content_hash", "state", F.lit("ok").alias("status"), F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(registry_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
