"""Sinks of a change feed with bad rows and crashes, and a stream of edited files."""

import hashlib
import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from colloquy.streaming import feeds
from colloquy.streaming.files import changed_files

SCHEMA = "id long, operation string, entity_type long, entity_id long, payload string"


def feed(spark, folder, batches):
    """One file per batch; a stream that takes one file at a time."""
    for n, rows in enumerate(batches):
        if not (folder / f"{n:03d}").exists():
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(folder / f"{n:03d}"))
            for f in (folder / f"{n:03d}").glob("*.json"):
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "*"))


def one(i, op, key, parent=None, raw=None, kind=1):
    return (i, op, kind, key, raw if raw is not None else json.dumps({"v": i, "parent": parent}))


BATCHES = [
    [one(1, "INSERT", 1), one(2, "INSERT", 2, raw="not json"), one(3, "INSERT", 3, parent=9), one(4, "INSERT", 4, kind=7)],
    [one(5, "UPDATE", 1), one(6, "INSERT", 2), one(7, "INSERT", 8, parent=77)],
    [one(8, "INSERT", 9), one(9, "DELETE", 1, raw="")],
    [one(10, "UPDATE", 3, parent=9)],
    [one(11, "INSERT", 12)],
]


def by_rounds(spark, attempt, known=(1,)):
    """The batch form: the same rounds without a stream."""
    snap = wait = None
    aside = []
    for rows in BATCHES:
        snap, wait, gone = feeds.attempt_all(snap, wait, spark.createDataFrame(rows, SCHEMA), attempt, 3, list(known))
        aside += gone.collect()
        snap, wait = (spark.createDataFrame(x.collect(), x.schema) for x in (snap, wait))
    return rows_of(feeds.live(snap)), rows_of(wait), sorted(map(tuple, aside))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_two_sinks_with_bad_rows(spark, tmp_path):
    source = tmp_path / "feed"
    source.mkdir()
    stream = feed(spark, source, BATCHES)
    sinks = {"nodes": feeds.parses, "edges": feeds.parent_known}
    for name, attempt in sinks.items():
        feeds.apply_cdc(stream, str(tmp_path / name), str(tmp_path / f"{name}-c"), attempt, 3, [1]).awaitTermination()
    for name, attempt in sinks.items():
        path = str(tmp_path / name)
        want = by_rounds(spark, attempt)
        assert (rows_of(feeds.snapshot(spark, path)), rows_of(feeds.waiting(spark, path)), rows_of(feeds.set_aside(spark, path))) == want
    nodes = {r.entity_id: r.id for r in feeds.snapshot(spark, str(tmp_path / "nodes")).collect()}
    edges = {r.entity_id: r.id for r in feeds.snapshot(spark, str(tmp_path / "edges")).collect()}
    assert nodes == {2: 6, 3: 10, 8: 7, 9: 8, 12: 11} and edges == {2: 6, 3: 10, 9: 8, 12: 11}
    gone = {(r.id, r.attempts, r.error) for r in feeds.set_aside(spark, str(tmp_path / "edges")).collect()}
    assert gone == {(2, 3, "payload is no JSON"), (4, 0, "unknown type"), (7, 3, "parent is not there")}


@pytest.mark.parametrize("at", [0, 2, 4])
def test_a_crash_in_one_sink_leaves_the_other(spark, tmp_path, at):
    """The first sink dies in its batch ``at``, after its tables are computed or before; run again it ends as if it had not."""
    source, seen = tmp_path / "feed", []
    source.mkdir()
    stream = feed(spark, source, BATCHES)

    def fails_once(rows, snapshot):
        seen.append(1)
        if len(seen) == at + 1:
            raise RuntimeError("lost")
        return feeds.parent_known(rows, snapshot)

    path, checkpoint = str(tmp_path / "a"), str(tmp_path / "a-c")
    with pytest.raises(StreamingQueryException):
        feeds.apply_cdc(stream, path, checkpoint, fails_once, 3, [1]).awaitTermination()
    other = str(tmp_path / "b")
    feeds.apply_cdc(stream, other, str(tmp_path / "b-c"), feeds.parent_known, 3, [1]).awaitTermination()
    feeds.apply_cdc(stream, path, checkpoint, fails_once, 3, [1]).awaitTermination()
    for p in (path, other):
        assert (rows_of(feeds.snapshot(spark, p)), rows_of(feeds.waiting(spark, p)), rows_of(feeds.set_aside(spark, p))) == by_rounds(spark, feeds.parent_known)


def test_edited_files(spark, tmp_path):
    folder, registry, checkpoint = tmp_path / "files", str(tmp_path / "registry"), str(tmp_path / "c")
    (folder / "deep").mkdir(parents=True)

    def put(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    def run():
        feeds.ingest_files(changed_files(spark, str(folder), suffixes=".md,.txt", settle=0, bytes=10), registry, checkpoint).awaitTermination()
        return {(os.path.basename(r.file_path), r.content_hash, r.state) for r in spark.read.parquet(registry).collect()}

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    put("a.md", "one", 1000)
    put("deep/b.txt", "two", 1001)
    put("c.bin", "left out", 1002)
    first = {("a.md", sha("one"), "new"), ("b.txt", sha("two"), "new")}
    assert run() == first and run() == first  # nothing new the second time
    put("a.md", "edited", 1003)
    put("deep/b.txt", "two", 1004)  # touched, the same text
    put("d.md", "", 1005)
    second = first | {("a.md", sha("edited"), "changed"), ("d.md", sha(""), "new")}
    assert run() == second
    put("a.md", "one", 1006)
    assert run() == second | {("a.md", sha("one"), "changed")}
