"""Shared folders, written tables and skew-safe lookups for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can write to: spark.checkpoint.dir.

    Where the setting is missing, a temporary folder is made in local mode alone; a cluster would not share it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = _own.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _own[sc.applicationId] = base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


#: Spark deletes a query's shuffle files as soon as it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The paths that saved() and new_path() have given out and release() has not deleted yet."""
    return list(_tables)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder whose readers are done."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        if name in _tables:
            _tables.remove(name)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)


def drop(*read: DataFrame) -> None:
    """Delete the tables that saved() gave as these DataFrames, once nothing will read them again."""
    for df in read:
        folders = {f.rpartition("/")[0].removeprefix("file://") for f in df.inputFiles()}
        release(df.sparkSession, [p for p in _tables if p.removeprefix("file://").rstrip("/") in folders])


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path (local, file:, hdfs: or an object store) and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put_file(path: str, write) -> None:
    """Write a file under another name and move it into place, so that a retried task replaces it whole."""
    fs, name = open_fs(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, name)


def make_dir(path: str) -> str:
    fs, name = open_fs(path)
    fs.create_dir(name, recursive=True)
    return path


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, unique: list[str], share: int = 2000) -> DataFrame:
    """Left outer join to a table with one row per key, safe for keys that hold a large share of ``left``.

    ``weight`` is a column of ``right``: the number of left rows with that key, out of ``total``. At most
    ``share`` keys can hold ``total / share`` rows or more, so that part of ``right`` is broadcast with a proven
    bound of ``share`` rows; the other keys are joined by shuffle, none with more than one part in ``share``.
    ``unique`` names left columns that spread the rows of hot keys over the shuffle.
    """
    names = [c for c in right.columns if c not in (key, weight)]
    hot = F.col(weight) * share >= total
    few = right.filter(hot).select(F.col(key).alias("_k"), F.struct(*names).alias("_h"))
    many = right.filter(~hot).select(F.struct(F.col(key).alias("k"), F.lit(0).alias("salt")).alias("_s"), F.struct(*names).alias("_m"))
    marked = left.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("_k")), "left")
    salt = F.when(F.col("_h").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*unique), F.lit(1 << 30)).cast("int"))
    marked = marked.withColumn("_s", F.struct(F.col(key).alias("k"), salt.alias("salt")))
    joined = marked.join(many.hint("merge"), "_s", "left")
    return joined.select(*[left[c] for c in left.columns], *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_m.{c}")).alias(c) for c in names])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (id, component), component the smallest id reachable.

    In each round an id takes the smallest label among its own, its neighbours' and those that neighbours of ids with
    its label have, and then the label of the id that its label names, so that whole trees are hooked together and
    chains shorten by leaps: few rounds for long paths, too. Every round is written to the shared folder and the one
    before deleted; labels of much linked ids and of large components go by lookup(), which gathers them in no task.
    """
    both = saved(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).union(edges.select(b, a)).filter("id <> other").distinct(), "cc-edges")
    degree = both.groupBy("id").agg(F.count("*").alias("w"))
    labels = saved(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "cc-labels")
    links, ids = max(1, both.count()), max(1, labels.count())
    while True:
        own = labels.join(degree.hint("merge"), "id").select(F.col("id").alias("other"), "component", "w")
        near = lookup(both, own, "other", "w", links, ["id"]).groupBy("id").agg(F.min("component").alias("near"))
        met = labels.join(near.hint("merge"), "id")
        hooks = met.groupBy(F.col("component").alias("id")).agg(F.min("near").alias("hook"))
        step = met.join(hooks.hint("merge"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near", "hook").alias("component"))
        step = saved(step, "cc-labels")
        if not step.filter("was <> component").limit(1).count():
            drop(labels, both)
            return step.select("id", "component")
        named = step.groupBy("component").agg(F.count("*").alias("w"))
        named = named.join(step.select(F.col("id").alias("component"), F.col("component").alias("root")).hint("merge"), "component")
        leapt = lookup(step.select("id", "component"), named, "component", "w", ids, ["id"]).select("id", F.coalesce("root", "component").alias("component"))
        leapt = saved(leapt, "cc-labels")
        drop(labels, step)
        labels = leapt
