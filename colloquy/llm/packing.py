"""Packing of documents into token sequences: concatenate and cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tokens import BLOCK, blocks, encoder
from .work import saved


def _tokenize(tokenizer: str, end: int, lean: bool):
    names = ["part", "row", "doc_id", "before", "n", "ids"]

    def run(batches):
        part, coder, seen, row = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        for b in batches:
            texts = b.column("text")
            for i, k in blocks(texts, BLOCK):
                flat, n = coder.flat(texts.slice(i, k - i), end)
                at = np.cumsum(n) - n
                bounds = np.append(at, len(flat)) * coder.dtype.itemsize
                ids = pa.Array.from_buffers(pa.large_binary(), k - i, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                own = [pa.array(np.full(k - i, part, np.int32)), pa.array(np.arange(row, row + k - i)), b.column("doc_id").slice(i, k - i)]
                yield pa.record_batch([*own, pa.array(at + seen), pa.array(n), ids], names=names)
                seen, row = seen + len(flat), row + k - i
            pa.default_memory_pool().release_unused()
        if lean:
            coder.forget()

    return run


def _cut(length: int, keep_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        for b in batches:
            out = []
            for doc, first, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids")), strict=True):
                wide = raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    ids = wide[4 * start : 4 * (start + size)]
                    out.append((doc, start, size, zlib.crc32(ids), n, sequence, offset, ids if keep_ids else None))
                    start += size
            if out:
                *c, ids = zip(*out, strict=True)
                rows = [pa.array(x, pa.int64()) for x in c] + [pa.array(ids, pa.binary())]
                yield pa.record_batch(rows[: 7 + keep_ids], names=names[: 7 + keep_ids])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, keep_ids: bool = False, lean: bool = False) -> DataFrame:
    """Cut the concatenation of all documents into sequences of ``length`` ids; a row per piece of a document.

    First pass: every partition tokenizes its texts where they are and notes each document's place in it. Second
    pass: a prefix sum over the partitions' token totals (a row per partition) gives global offsets, and each document
    is cut at the multiples of ``length``; a piece that reaches a sequence's end continues in the next sequence, also
    over a partition's end. Nothing but the totals is shuffled, and only the very last sequence is shorter.

    A null text counts as empty (its one id is ``end``), a null doc_id stays null, repeated rows are packed each,
    an empty table gives no rows; other columns are not read. Columns: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``keep_ids``, the piece's ids as little-endian unsigned 32-bit integers. Workers keep the ids of
    words for their next tasks, a bounded number of them; with ``lean`` they free them after each task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = saved(rows.mapInArrow(_tokenize(tokenizer, end, lean), "part int, row long, doc_id long, before long, n long, ids binary"), "packing-ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the first pass
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    placed = ids.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("before")).alias("first"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(length, keep_ids), schema + ", ids binary" * keep_ids)


def sequences(pieces: DataFrame, length: int = 2048, pad: int = 0) -> DataFrame:
    """The sequences of pack(..., keep_ids=True): sequence_id, n_ids, padded ids and mask (lists of ``length``).

    A sequence whose length is a power of two stays as long as it is. A sequence has at most ``length`` pieces, so
    groups are bounded.
    """

    def build(batches):
        for b in batches:
            ids, masks = [], []
            for parts in b.column("parts").to_pylist():
                flat = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                room = 0 if len(flat) & (len(flat) - 1) == 0 else length - len(flat)
                ids.append(np.pad(flat, (0, room), constant_values=pad).astype(np.int64))
                masks.append(np.arange(len(ids[-1])) < len(flat))
            yield pa.record_batch([b.column("sequence_id"), b.column("n_ids"), pa.array(ids, pa.list_(pa.int64())), pa.array([m.tolist() for m in masks], pa.list_(pa.bool_()))], names=["sequence_id", "n_ids", "ids", "mask"])

    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(build, "sequence_id long, n_ids long, ids array<long>, mask array<boolean>")
