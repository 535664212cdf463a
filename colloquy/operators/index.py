"""A kept index of words for keyword and phrase search: postings of blocks of documents, in buckets by word, updated in segments."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stem import porter
from ..sources.shared import shuffles_removed, written
from .retrieve import top_k

#: Words: ASCII letters and digits and all that is not ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of words, terms or queries that are sent to all tasks; more of them are joined by shuffle.
SENT = 300_000
#: Documents that a task splits at once; words and documents of a block, as far as whole documents go.
AT_ONCE, BLOCK_WORDS, BLOCK_DOCS = 500, 1_000_000, 10_000
#: Documents that a task of a search goes through, tasks at most beyond twice Spark's own number, and queries that it answers (best documents kept at once).
SHARD, SHARDS, ASKS, BEST = 50_000, 512, 100_000, 4_000_000
#: Queries in a row that brings them to a task, cells of a table and pairs of query and document that are at work at once.
PACK, CELLS, PAIRS = 10_000, 1 << 24, 1_000_000
_POSTINGS = "word string, block string, docs array<long>, tfs array<int>, positions array<int>, segment int, bucket int"
_DOCS = "doc_id long, dl int, segment int"
#: Rows as tasks read them, ordered by shard and block: a shard's queries come first, then each block's documents and its postings.
_ROWS = {
    "shard": "long", "block": "string", "t": "long", "docs": "array<long>", "rows": "array<int>", "tfs": "array<int>", "positions": "array<int>", "norms": "array<double>", "weight": "double",
    "asks": "array<struct<ask: long, best: int, slots: array<array<long>>>>",
}


def words(text: Column, pattern: str = WORDS) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def stemmed(rows: DataFrame, word: str = "word", name: str = "term", stem: bool = True) -> DataFrame:
    """Rows with the stem of each word. Stems are made once for each different word and joined back; a word that is in most
    rows makes a skewed partition of a merge join of two shuffled tables, which Spark splits as it runs."""
    if not stem:
        return rows.withColumn(name, F.col(word))
    known = rows.select(F.col(word).alias("_word")).distinct().select("_word", porter(F.col("_word")).alias(name))
    return rows.join(known.hint("merge"), F.col(word) == F.col("_word")).drop("_word")


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the number in each row."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1 and so on, n[i] of them, for each i."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _posted(pattern: str, tag: str):
    """Rows of blocks of whole documents (doc_id, lower-case text): for each different word its documents, how often each holds
    it, and where, one after another; for the word null all documents of the block and their numbers of words."""

    def block(name: str, ids: list[pa.Array], n: list[np.ndarray], held: list[pa.Array]) -> pa.RecordBatch:
        own, n = pa.concat_arrays(ids).to_numpy(zero_copy_only=False), np.concatenate(n)
        both = pa.chunked_array(held).unify_dictionaries()
        code = np.concatenate([np.asarray(c.indices, dtype=np.int64) for c in both.chunks])
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        word = np.flatnonzero(np.diff(code[first], prepend=-1))
        docs, tfs = np.concatenate([own, own[row[first]]]), np.concatenate([n, np.diff(first, append=len(code))])
        starts = np.concatenate([[0], len(own) + word, [len(docs)]])
        at = np.concatenate([[0], first[word], [len(code)]])
        name = pa.array([name]).take(pa.array(np.zeros(len(word) + 1, dtype=np.int64)))
        texts = pa.concat_arrays([pa.nulls(1, pa.string()), both.chunk(0).dictionary.cast(pa.string()).take(pa.array(code[first[word]]))])
        return pa.RecordBatch.from_arrays([texts, name, _lists(docs, starts, pa.int64()), _lists(tfs, starts, pa.int32()), _lists(place[order], at, pa.int32())], ["word", "block", "docs", "tfs", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(pattern, re.ASCII).findall
        ids, n, held, docs, size, done = [], [], [], 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                each = [found(t) for t in part.column(1).to_pylist()]
                ids.append(part.column(0))
                n.append(np.array([len(w) for w in each], dtype=np.int64))
                held.append(pa.array(itertools.chain.from_iterable(each), pa.string()).dictionary_encode())
                docs, size = docs + part.num_rows, size + len(held[-1])
                if size >= BLOCK_WORDS or docs >= BLOCK_DOCS:
                    yield block(f"{tag}-{TaskContext.get().partitionId()}-{done}", ids, n, held)
                    ids, n, held, docs, size, done = [], [], [], 0, 0, done + 1
        if docs:
            yield block(f"{tag}-{TaskContext.get().partitionId()}-{done}", ids, n, held)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """(shard, block, rows) of rows in the order of _ROWS; the block of a shard's queries is empty."""
    held, own = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, block = batch.column("shard").to_numpy(), pc.fill_null(batch.column("block"), "")
        other = pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)).to_numpy(zero_copy_only=False) | (np.diff(shard) != 0)
        ends = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for low, high in itertools.pairwise(ends):
            now = (int(shard[low]), block[low].as_py())
            if held and now != own:
                yield *own, pa.Table.from_batches(held).combine_chunks()
                held = []
            own = now
            held.append(batch.slice(low, high - low))
    if held:
        yield *own, pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


class _Block:
    """Documents of a block that are there, in order, and its postings: local terms, each with its row numbers of documents."""

    def __init__(self, rows: pa.Table) -> None:
        none = rows.column("t").is_null()
        self.head, self.rest = rows.filter(none), rows.filter(pc.invert(none))
        self.ids = _flat(_column(self.head, "docs"))[0]
        self.t = _column(self.rest, "t").to_numpy(zero_copy_only=False).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(posting's row of the table, number of the document, tf, whether the document is there) of each entry by its id."""
        docs, n = _flat(_column(self.rest, "docs"))
        row = np.minimum(np.searchsorted(self.ids, docs), len(self.ids) - 1)
        return np.repeat(np.arange(len(n)), n), row, _flat(_column(self.rest, "tfs"))[0], self.ids[row] == docs


def _merged(k1: float, b: float, avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with the documents that are there and what their lengths weigh, and a row for each term, whose forms are
        put together."""
        names = ["block", "t", "docs", "rows", "tfs", "norms"]
        for _, name, rows in _groups(batches):
            own = _Block(rows)
            if not len(own.ids):
                continue
            of, row, tf, there = own.entries()
            terms, t = np.unique(own.t, return_inverse=True)
            key, tf = (t[of] * len(own.ids) + row)[there], tf[there]
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            t, row, tf = key[first] // len(own.ids), key[first] % len(own.ids), np.add.reduceat(tf, first) if len(first) else tf[:0]
            word = np.flatnonzero(np.diff(t, prepend=-1))
            norm = k1 * (1 - b + b * _flat(_column(own.head, "tfs"))[0] / avgdl)
            starts, none = np.concatenate([[0, 0], word[1:], [len(t)]]) if len(word) else np.array([0, 0]), np.full(len(word), len(own.ids))
            full = np.concatenate([[0, len(own.ids)], none])
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(word) + 1), pa.string()), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(terms[t[word]], pa.int64())]), _lists(own.ids, full, pa.int64()), _lists(row, starts, pa.int32()), _lists(tf, starts, pa.int32()), _lists(norm, full, pa.float64())], names)

    return run


class _Asks:
    """Queries of a shard: numbers, slots (starts by query), terms (starts by slot)."""

    def __init__(self, rows: pa.Table) -> None:
        own = _column(rows, "asks").flatten()
        self.number = own.field("ask").to_numpy(zero_copy_only=False)
        self.best = own.field("best")[0].as_py() if len(own) else None
        each, n = own.field("slots").flatten(), pc.list_value_length(own.field("slots")).to_numpy(zero_copy_only=False)
        self.slots, self.terms = _starts(n), each.flatten().to_numpy(zero_copy_only=False)
        self.starts = _starts(pc.list_value_length(each).to_numpy(zero_copy_only=False))

    def own_terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Each query's different terms, and their starts."""
        of = np.repeat(np.arange(len(self.number)), np.diff(self.starts[self.slots]))
        order = np.lexsort((self.terms, of))
        of, t = of[order], self.terms[order]
        new = (np.diff(of, prepend=-1) != 0) | (np.diff(t, prepend=t[:1] - 1) != 0) if len(t) else np.zeros(0, dtype=bool)
        return t[new], _starts(np.bincount(of[new], minlength=len(self.number)))


def _local(t: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of ``terms`` in the sorted ``t``; its length for one that is not there."""
    at = np.searchsorted(t, terms)
    return np.where(t[np.minimum(at, len(t) - 1)] == terms, at, len(t)) if len(t) else at


class _Kept:
    """The best documents of each query so far, by score rounded to nine places, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.key, self.doc, self.score, self.k = np.full((n, k), -1, dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros((n, k)), k

    def add(self, a: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        key = np.floor(score * 1e9 + 0.5).astype(np.int64)
        last = self.key[a, -1]
        better = (key > last) | ((key == last) & (doc < self.doc[a, -1]))
        a, doc, score, key = a[better], doc[better], score[better], key[better]
        if not len(a):
            return
        own = np.unique(a)
        old = self.key[own] >= 0
        a = np.concatenate([a, np.repeat(own, old.sum(axis=1))])
        key, doc, score = (np.concatenate([x, y[own][old]]) for x, y in ((key, self.key), (doc, self.doc), (score, self.score)))
        order = np.lexsort((doc, -key, a))
        a, key, doc, score = a[order], key[order], doc[order], score[order]
        start = np.flatnonzero(np.diff(a, prepend=-1))
        rank = np.arange(len(a)) - np.repeat(start, np.diff(start, append=len(a)))
        top = rank < self.k
        self.key[a[top], rank[top]], self.doc[a[top], rank[top]], self.score[a[top], rank[top]] = key[top], doc[top], score[top]


def _matches(asks: _Asks, own: _Block, row: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row number of a document) of the documents that fill all slots, some at a time, by sets of bits. ``starts`` of the
    row numbers of each local term."""
    n, wide = len(own.t), -(-len(own.ids) // 64)
    bits = np.zeros((n + 1, wide), dtype=np.uint64)
    step = max(1, CELLS // (wide * 64))
    for low in range(0, n, step):
        high = min(n, low + step)
        cells = np.zeros((high - low, wide * 64), dtype=bool)
        cells[np.repeat(np.arange(high - low), np.diff(starts[low : high + 1])), row[starts[low] : starts[high]]] = True
        bits[low:high] = np.packbits(cells, axis=1, bitorder="little").view(np.uint64)
    at, forms = _local(own.t, asks.terms), np.diff(asks.starts)
    mask, several = at[asks.starts[:-1]], np.flatnonzero(forms > 1)
    filled = np.logical_or.reduceat(at < n, asks.starts[:-1]) if len(forms) else np.zeros(0, dtype=bool)
    whole = np.flatnonzero(np.logical_and.reduceat(filled, asks.slots[:-1])) if len(filled) else several[:0]
    step = max(1, CELLS // 8 // wide)
    for part in (whole[i : i + step] for i in range(0, len(whole), step)):
        size, met = np.diff(asks.slots)[part], None
        for j in range(int(size.max())):
            on = np.flatnonzero(size > j)
            slot = asks.slots[part[on]] + j
            sets = bits[mask[slot]]
            for x in np.flatnonzero(forms[slot] > 1) if len(several) else ():
                sets[x] = np.bitwise_or.reduce(bits[at[asks.starts[slot[x]] : asks.starts[slot[x] + 1]]], axis=0)
            if met is None:
                met = sets
            else:
                met[on] &= sets
        a, word = np.nonzero(met)
        for low in range(0, len(a), PAIRS // 8):
            some = slice(low, low + PAIRS // 8)
            one, bit = np.nonzero(np.unpackbits(met[a[some], word[some]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield part[a[some][one]], word[some][one] * 64 + bit


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ask, doc_id, score): the best documents of a shard for each query, all that match where no number is asked for."""

    def rows(a: np.ndarray, doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(a), PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + PAIRS]) for x in (a, doc, score)], ["ask", "doc_id", "score"])

    def rest() -> Iterator[pa.RecordBatch]:
        if kept is not None:
            a, rank = np.nonzero(kept.key >= 0)
            yield from rows(asks.number[a], kept.doc[a, rank], kept.score[a, rank])

    asks = kept = None
    for _, name, table in _groups(batches):
        if not name:
            yield from rest()
            asks = _Asks(table)
            kept = None if asks.best is None else _Kept(len(asks.number), asks.best)
            own_terms, of = asks.own_terms()
            n_terms = np.diff(of)
            continue
        own = _Block(table)
        row, n = _flat(_column(own.rest, "rows"))
        starts, norm = _starts(n), _flat(_column(own.head, "norms"))[0]
        tf = _flat(_column(own.rest, "tfs"))[0]
        part = np.repeat(_column(own.rest, "weight").to_numpy(zero_copy_only=False), n) * tf / (tf + norm[row])
        key = np.repeat(np.arange(len(n)), n) * len(own.ids) + row
        local = _local(own.t, own_terms)
        for a, doc in _matches(asks, own, row, starts):
            score = np.zeros(len(a))
            for j in range(int(n_terms[a].max())):
                on = np.flatnonzero(n_terms[a] > j)
                t = local[of[a[on]] + j]
                on, t = on[t < len(n)], t[t < len(n)]
                want = t * len(own.ids) + doc[on]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                score[on] += np.where(key[at] == want, part[at], 0.0)
            if kept is None:
                yield from rows(asks.number[a], own.ids[doc], score)
            else:
                kept.add(a, own.ids[doc], score)
    yield from rest()


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ask, doc_id) of the documents that hold the terms of a query in a row."""

    def rows(asked: np.ndarray, low: np.ndarray, n: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, at in parts(asked, low, n):
            yield pa.RecordBatch.from_arrays([pa.array(asks.number[a]), pa.array(doc[at])], ["ask", "doc_id"])

    def parts(asked: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and what they meet: n from low on, some at a time."""
        end = np.cumsum(n)
        cut = np.searchsorted(end, np.arange(PAIRS, int(end[-1]) + PAIRS, PAIRS)) if len(end) else []
        for i, j in itertools.pairwise(np.unique(np.concatenate([[0], np.asarray(cut, dtype=np.int64) + 1, [len(asked)]]).clip(0, len(asked)))):
            yield np.repeat(asked[i:j], n[i:j]), _ranges(low[i:j], n[i:j])

    asks = None
    for _, name, table in _groups(batches):
        if not name:
            asks = _Asks(table)
            size = np.diff(asks.slots)
            continue
        own = _Block(table)
        if not len(own.ids):
            continue
        of, row, tf, there = own.entries()
        own_t, t = np.unique(own.t, return_inverse=True)
        place = _flat(_column(own.rest, "positions"))[0]
        t, row, there = np.repeat(t[of], tf), np.repeat(row, tf), np.repeat(there, tf)
        t, row, place = t[there], row[there], place[there]
        key = row * (int(place.max(initial=0)) + 2) + place
        order = np.argsort(key)
        key, t, row = key[order], t[order], row[order]
        local, docs = _local(own_t, asks.terms), len(own.ids)
        whole = np.logical_and.reduceat(local < len(own_t), asks.slots[:-1]) if len(local) else np.zeros(0, dtype=bool)
        one = np.flatnonzero(whole & (size == 1))
        held = np.unique(t * docs + row)
        first = local[asks.slots[one]] * docs
        low = np.searchsorted(held, first)
        yield from rows(one, low, np.searchsorted(held, first + docs) - low, own.ids[held % docs])
        start = np.flatnonzero(np.diff(key) == 1)
        two = t[start] * len(own_t) + t[start + 1]
        more = np.flatnonzero(whole & (size > 1))
        head = local[asks.slots[more]] * len(own_t) + local[asks.slots[more] + 1]
        short = size[more] == 2
        held = np.unique(two * docs + row[start])
        low = np.searchsorted(held, head[short] * docs)
        yield from rows(more[short], low, np.searchsorted(held, (head[short] + 1) * docs) - low, own.ids[held % docs])
        order = np.argsort(two, kind="stable")
        start, two = start[order], two[order]
        low = np.searchsorted(two, head[~short])
        for a, at in parts(more[~short], low, np.searchsorted(two, head[~short], "right") - low):
            at = start[at]
            for j in range(2, int(size[a].max(initial=0))):
                end = np.minimum(at + j, len(key) - 1)
                fits = (size[a] <= j) | ((key[end] == key[at] + j) & (t[end] == local[np.minimum(asks.slots[a] + j, len(local) - 1)]))
                a, at = a[fits], at[fits]
            both = np.unique(a * docs + row[at])
            yield pa.RecordBatch.from_arrays([pa.array(asks.number[both // docs]), pa.array(own.ids[both % docs])], ["ask", "doc_id"])


def _live_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _POSTINGS of each block, without the documents that are not there."""
    for _, name, table in _groups(batches):
        own = _Block(table)
        if not len(own.ids):
            continue
        of, row, tf, there = own.entries()
        n = np.bincount(of[there], minlength=len(own.t))
        kept = np.flatnonzero(n)
        starts = np.concatenate([[0, len(own.ids)], len(own.ids) + np.cumsum(n[kept])])
        place = _flat(_column(own.rest, "positions"))[0][np.repeat(there, tf)]
        at = np.concatenate([[0, 0], np.cumsum(np.bincount(of[there], tf[there], minlength=len(own.t)).astype(np.int64)[kept])])
        texts = pa.concat_arrays([pa.nulls(1, pa.string()), _column(own.rest, "word").take(pa.array(kept))])
        lists = [_lists(np.concatenate([own.ids, own.ids[row[there]]]), starts, pa.int64()), _lists(np.concatenate([_flat(_column(own.head, "tfs"))[0], tf[there]]), starts, pa.int32()), _lists(place, at, pa.int32())]
        yield pa.RecordBatch.from_arrays([texts, pa.array([name] * (len(kept) + 1), pa.string()), *lists], ["word", "block", "docs", "tfs", "positions"])


def _as_rows(rows: DataFrame) -> DataFrame:
    """Rows with all columns of _ROWS, null where they have none."""
    return rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast(kind).alias(n) for n, kind in _ROWS.items()))


@dataclass
class Index:
    """The index under ``path``: folders of postings, of stems and of documents, each with a column ``segment``.

    A block is some documents that one task has split together. A posting is a row for each word of a block, with the documents
    that hold it, how often and where; the row of a block without a word, in bucket -1, has all its documents and their lengths. Words
    are put together to terms where these are asked for. Nothing is shuffled to build it: each task writes its blocks to the buckets.
    A document's newest segment holds its words; postings of older ones are passed over, and go at the next compact().
    Postings are laid out by hash of their word in ``buckets`` folders and sorted by word within, so a search reads the
    buckets of its words, and in them the row groups that may hold one.
    """

    spark: SparkSession
    path: str
    buckets: int = 32
    pattern: str = WORDS
    stem: bool = True

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """(doc_id, dl, segment) of each document that is there: its newest segment's, unless that deleted it."""
        newest = self._table("docs", _DOCS).groupBy("doc_id").agg(F.max(F.struct("segment", "dl")).alias("d"))
        return newest.select("doc_id", "d.dl", "d.segment").filter("dl is not null")

    def _bucket(self, word: Column) -> Column:
        return F.when(word.isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, segment: int, deleted: DataFrame | None = None) -> None:
        """Write a segment of postings, the stems of its words and its documents."""
        rows = rows.withColumn("bucket", self._bucket(F.col("word"))).sortWithinPartitions("bucket", "word")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        own = self._table("postings", _POSTINGS).filter(F.col("segment") == segment)
        if self.stem:
            with shuffles_removed(self.spark):
                own.filter("bucket >= 0").select("word").distinct().select("word", porter(F.col("word")).alias("term")).write.mode("overwrite").parquet(f"{self.path}/stems/segment={segment}")
        lengths = own.filter("bucket = -1").select(F.explode(F.arrays_zip("docs", "tfs")).alias("d")).select(F.col("d.docs").alias("doc_id"), F.col("d.tfs").alias("dl"))
        if deleted is not None:
            lengths = lengths.union(deleted.select(F.col("doc_id").cast("long"), F.lit(None).cast("int")))
        lengths.write.mode("overwrite").parquet(f"{self.path}/docs/segment={segment}")

    def add(self, docs: DataFrame, segment: int, deleted: DataFrame | None = None) -> None:
        """Write a segment: the words of documents (doc_id, text), new or changed, and marks of deleted ones (doc_id).

        A null text has no words. Each text is read and split once, in a pass without a shuffle. A segment that is written again
        replaces what it held. Java and Python must read the pattern alike.
        """
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))
        self._write(own.mapInArrow(_posted(self.pattern, uuid.uuid4().hex[:12]), _POSTINGS.split(", segment")[0]), segment, deleted)

    def compact(self, path: str) -> Index:
        """The same index in one segment under another path, without what newer segments or deletions replaced."""
        small = Index(self.spark, path, self.buckets, self.pattern, self.stem)
        held = self._table("postings", _POSTINGS).filter("bucket >= 0").select("block", "word", "docs", "tfs", "positions").withColumns({"shard": F.lit(0).cast("long"), "t": F.lit(0).cast("long")})
        both = held.unionByName(self._there().withColumn("shard", F.lit(0).cast("long")), allowMissingColumns=True)
        small._write(both.repartition("block").sortWithinPartitions("block", "t").mapInArrow(_live_only, _POSTINGS.split(", segment")[0]), 0)
        return small

    def _there(self) -> DataFrame:
        """(block, docs, tfs) of each block: its documents that are there, in order, and their lengths."""
        each = self._table("postings", _POSTINGS).filter("bucket = -1").select("block", "segment", F.explode(F.arrays_zip("docs", "tfs")).alias("d")).select("block", "segment", F.col("d.docs").alias("doc_id"), F.col("d.tfs").alias("dl"))
        kept = each.join(self.documents().select("doc_id", "segment").hint("merge"), ["doc_id", "segment"])
        return kept.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "dl"))).alias("d")).select("block", F.col("d.doc_id").alias("docs"), F.col("d.dl").alias("tfs"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(block, t, docs, tfs, positions) of asked terms (term, t), a row for each form of a term in each block.

        Few forms, counted first, are sent to all tasks and prune buckets; more of them are joined by shuffle.
        """
        forms = terms.withColumnRenamed("term", "word")
        if self.stem:
            forms = self._table("stems", "word string, term string").join(_sent(terms), "term").select("word", "t").distinct()
        forms = written(forms.withColumn("b", self._bucket(F.col("word"))), "forms")
        few = [r.b for r in forms.select("b").distinct().collect()]  # `buckets` rows at most
        rows = self._table("postings", _POSTINGS).filter(F.col("bucket").isin(few)) if few else self._table("postings", _POSTINGS).limit(0)
        return rows.join(_sent(forms.drop("b")), "word").select("block", "t", "docs", "tfs", "positions")

    def normal(self, asked: DataFrame) -> DataFrame:
        """Asked words (…, word) with their terms, by the rule of the index."""
        return stemmed(asked, stem=self.stem)

    def _asks(self, asking: DataFrame, best: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of queries (qid, slots) the different ones, numbered: (qid, ask), (ask, best, slots of numbered terms), and (term, t)."""
        asks = written(asking.select("slots").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
        terms = written(asks.select(F.explode(F.flatten("slots")).alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
        each = asks.select("ask", F.posexplode("slots").alias("slot", "any")).select("ask", "slot", F.explode("any").alias("term")).join(_sent(terms), "term")
        slots = each.groupBy("ask", "slot").agg(F.collect_list("t").alias("any")).groupBy("ask").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "any"))), lambda s: s["any"]).alias("slots"))
        return asking.join(asks.hint("merge"), "slots").select("qid", "ask"), written(slots.select("ask", F.lit(best).cast("int").alias("best"), "slots"), "numbered"), terms

    def _dealt(self, rows: DataFrame, asks: DataFrame, docs: int) -> DataFrame:
        """Blocks (block, …) dealt out whole to tasks, each with all queries (ask, best, slots), or with some of very many."""
        n, best = asks.agg(F.count("*"), F.max("best")).first()
        chunks = max(1, -(-n // max(1, min(ASKS, BEST // max(1, best or 1)))))
        shards = max(2 * self.spark.sparkContext.defaultParallelism, min(SHARDS, docs // SHARD + 1))
        part = lambda m, *by: F.pmod(F.xxhash64("ask", *by), F.lit(m).cast("long"))
        packs = asks.groupBy(part(chunks).alias("chunk"), part(n // PACK + 1, F.lit(1)).alias("pack")).agg(F.collect_list(F.struct("ask", "best", "slots")).alias("asks"))
        packs = packs.select("asks", F.explode(F.sequence(F.col("chunk") * shards, F.col("chunk") * shards + shards - 1)).alias("shard"))
        first = F.pmod(F.xxhash64("block"), F.lit(shards).cast("long"))
        own = rows.withColumn("shard", first if chunks == 1 else F.explode(F.sequence(first, first + (chunks - 1) * shards, F.lit(shards).cast("long"))))
        both = _as_rows(packs).union(_as_rows(own))
        return both.repartitionById(chunks * shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "block", "t")

    def candidates(self, held: DataFrame, asks: DataFrame) -> DataFrame:
        """(ask, doc_id, score) of documents that fill all slots of a query (ask, best, slots): of each shard of documents the
        ``best`` ones. ``held``: of each block a row (block, docs, norms) and one (block, t, rows, tfs, weight) for each term."""
        n = held.filter("t is null").agg(F.sum(F.size("docs"))).first()[0] or 0
        return self._dealt(held, asks, n).mapInArrow(_best, "ask long, doc_id long, score double")

    def search(self, queries: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(qid, doc_id, score) by BM25 of the documents that hold, for every slot of a query (qid, slot, word), one of
        its words; the k best of each query, by score rounded to nine places, then doc_id.

        Queries that ask for the same terms are answered once. The asked postings of a block are put together in one task, which
        drops documents that are not there; counts of documents by term come from these, so they are those of the documents
        there. Then tasks go through whole blocks, one after another, find the documents of all queries by sets of bits, and hand on
        the k best of each query: what they hand on grows with the queries and the tasks, not with what matches.
        """
        slots = self.normal(queries.select("qid", "slot", "word")).groupBy("qid", "slot").agg(F.sort_array(F.collect_set("term")).alias("any"))
        asking = written(slots.groupBy("qid").agg(F.sort_array(F.collect_set("any")).alias("slots")), "asking")
        asking, asks, terms = self._asks(asking, k)
        n, avgdl = self.documents().filter("dl > 0").agg(F.count("*"), F.avg("dl")).first()
        rows = _as_rows(self.postings(terms).drop("positions").unionByName(self._there(), allowMissingColumns=True).withColumn("shard", F.lit(0).cast("long")))
        held = written(rows.repartition("block").sortWithinPartitions("block", "t").mapInArrow(_merged(k1, b, avgdl or 1.0), "block string, t long, docs array<long>, rows array<int>, tfs array<int>, norms array<double>"), "found")
        df = held.filter("t is not null").groupBy("t").agg(F.sum(F.size("rows")).alias("df"))
        weight = df.select("t", ((k1 + 1) * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
        first = self.candidates(held.filter("t is null").unionByName(held.filter("t is not null").join(_sent(written(weight, "weights")), "t"), allowMissingColumns=True), asks)
        ranked = first if k is None else top_k(first, ["ask"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)
        return asking.join(ranked.hint("merge"), "ask").drop("ask")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """R2: (qid, doc_id) of documents that hold the words of a phrase (qid, phrase) in a row, each by its term.

        Equal phrases are looked up once. The asked postings of a block meet in one task, which sorts them by their places:
        two that follow one another meet the phrases by their first two terms, the rest of a longer one goes by position. What is
        found is not shuffled unless there are very many phrases.
        """
        each = queries.select("qid", F.posexplode(words(F.col("phrase"), self.pattern)).alias("i", "word"))
        asking = written(self.normal(each).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "term"))), lambda x: F.array(x["term"])).alias("slots")), "asking")
        asking, asks, terms = self._asks(asking)
        n = self.documents().count()
        rows = self.postings(terms).unionByName(self._there(), allowMissingColumns=True)
        found = self._dealt(rows, asks, n).mapInArrow(_lined, "ask long, doc_id long")
        return found.join(_sent(written(asking, "numbers")), "ask").select("qid", "doc_id")


def _sent(rows: DataFrame) -> DataFrame:
    """A written table as the side of a join that is sent to all tasks, or shuffled if it has more than SENT rows."""
    return F.broadcast(rows) if rows.limit(SENT + 1).count() <= SENT else rows.hint("merge")


def build(docs: DataFrame, path: str, buckets: int = 32, pattern: str = WORDS, stem: bool = True) -> Index:
    """A new index of documents (doc_id, text)."""
    index = Index(docs.sparkSession, path, buckets, pattern, stem)
    index.add(docs, 0)
    return index


def update(index: Index, docs: DataFrame, states: DataFrame, segment: int) -> Index:
    """The index after a delta: ``states`` (doc_id, state) with new, changed, unchanged (as of N7) or deleted; only documents
    that are new or changed are read and split."""
    changed = states.filter(F.col("state").isin("new", "changed")).select("doc_id")
    index.add(docs.join(changed.hint("merge"), "doc_id", "left_semi"), segment, states.filter("state = 'deleted'").select("doc_id"))
    return index


def terms_of(queries: DataFrame, stopwords: list[str], most: int | None = None) -> DataFrame:
    """(qid, slot, word) of queries (qid, text): words of over one letter that are no stopwords, in order, ``most`` of
    them; a number also fills its slot padded with zeros to four and five digits."""
    stop = "^(" + "|".join(stopwords) + ")$"
    kept = F.filter(words(F.col("text")), lambda w: (F.length(w) > 1) & ~w.rlike(stop))
    own = queries.select("qid", F.posexplode(kept if most is None else F.slice(kept, 1, most)).alias("slot", "w"))
    wide = lambda n: F.when(F.length("w") < n, F.lpad("w", n, "0")).otherwise(F.col("w"))
    forms = F.when(F.col("w").rlike("^[0-9]+$"), F.array_distinct(F.array(F.col("w"), wide(4), wide(5)))).otherwise(F.array("w"))
    return own.select("qid", "slot", F.explode(forms).alias("word"))


def everywhere(indexes: dict[str, Index], queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, collection, doc_id, rank, score): the k best of each collection, with the constant score 0.5 that they enter a
    blend with. Filter the collections for one type."""
    out = None
    for name, index in indexes.items():
        found = index.search(queries, k).select("qid", F.lit(name).alias("collection"), "doc_id", "rank", F.lit(0.5).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out
