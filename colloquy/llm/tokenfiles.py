"""Token-id files: Arrow stream files with fixed-size-list batches, for zero-copy random access.

A file holds the ids of whole documents, one after the other, cut into sequences of equal length. Each record batch
has ``ids`` (fixed-size list of unsigned 16- or 32-bit ids) and ``mask`` (fixed-size list of booleans, false in the
padding of the last sequence). All batches but the last have the same number of sequences, so that sequence i is at a
known place and a memory map gives it without a copy. Beside it lies an index with a row per document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tokens import BLOCK, blocks, encoder
from .work import make_dir, new_path, open_fs, put_file, saved

MANIFEST = "part int, tokens string, index string, n_docs long, n_tokens long, n_sequences long"


class TokenFile:
    """Random access to one token file; local files are memory-mapped, other stores are read once."""

    def __init__(self, path: str):
        fs, name = open_fs(path)
        source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name).read_buffer()
        self.batches = [b for b in pa.ipc.open_stream(source) if b.num_rows]
        self.per_batch = self.batches[0].num_rows if self.batches else 1
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0
        self.flat = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view) and the mask of sequence i."""
        b, k = divmod(i, self.per_batch)
        return self.flat[b][k * self.length : (k + 1) * self.length], self.batches[b].column("mask")[k].values.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from position start of the file; a view where they lie in one batch."""
        size, found = self.per_batch * self.length, []
        while n > 0:
            b, k = divmod(start, size)
            found.append(self.flat[b][k : k + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint16)


def _writer(folder: str, tokenizer: str, id_column: str, end: int, length: int, per_batch: int):
    def write(batches):
        part, coder = TaskContext.get().partitionId(), encoder(tokenizer)
        kind = pa.from_numpy_dtype(coder.dtype)
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        paths = [f"{folder}/{name}-{part:06d}.arrow" for name in ("tokens", "index")]
        ids, sizes, seen = [], [], 0

        def tokens(out):
            nonlocal seen
            left, step = np.zeros(0, coder.dtype), length * per_batch

            def batch(flat, used):
                mask = pa.array(np.arange(len(flat)) < used)
                return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat, kind), length), pa.FixedSizeListArray.from_arrays(mask, length)], schema=schema)

            with pa.ipc.new_stream(out, schema) as to:
                for b in batches:
                    texts = b.column("text")
                    ids.append(b.column(id_column))
                    for i, k in blocks(texts, BLOCK):
                        flat, n = coder.flat(texts.slice(i, k - i), end)
                        sizes.append(n)
                        seen += len(flat)
                        left = np.concatenate([left, flat])
                        full = len(left) - len(left) % step
                        for at in range(0, full, step):
                            to.write_batch(batch(left[at : at + step], step))
                        left = left[full:]
                    pa.default_memory_pool().release_unused()
                if len(left):
                    to.write_batch(batch(np.pad(left, (0, -len(left) % length)), len(left)))

        put_file(paths[0], tokens)

        n = np.concatenate([np.zeros(0, np.int64), *sizes])

        def index(out):
            docs = pa.chunked_array(ids, ids[0].type if ids else pa.int64())
            table = pa.table({"doc": docs, "start": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n)})
            with pa.ipc.new_stream(out, table.schema) as to:
                to.write_table(table, max_chunksize=1 << 16)

        put_file(paths[1], index)
        row = {"part": part, "tokens": paths[0], "index": paths[1], "n_docs": len(n), "n_tokens": seen, "n_sequences": -(-seen // length)}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("index", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "n_sequences"))]))

    return write


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = 0, length: int = 2048, per_batch: int = 256) -> DataFrame:
    """Tokenize whole texts and write them in ascending doc_id order; one row per file, with its first position.

    A null text counts as empty, a null doc_id comes first; rows with the same doc_id stand by the hash of their text
    and then by the text, so any order of the input gives the same files' content. Only the columns doc_id and text
    are read. The texts are dealt out by range, never by the value of one key alone, and tokenized where they land;
    a file is moved into place whole, so a retried task replaces it.
    """
    make_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = saved(rows.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, "doc_id", end, length, per_batch), MANIFEST), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(batches):
    for b in batches:
        for row in b.to_pylist():
            if not row["n_docs"]:
                continue
            tokens = TokenFile(row["tokens"])
            fs, name = open_fs(row["index"])
            for x in pa.ipc.open_stream(pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name).read_buffer()):
                start, size = x.column("start").to_pylist(), x.column("n_tokens").to_pylist()
                crc = [zlib.crc32(tokens.span(s, n).astype("<u4").tobytes()) for s, n in zip(start, size, strict=True)]
                yield pa.record_batch([x.column("doc"), pa.array([row["first"] + s for s in start], pa.int64()), x.column("n_tokens"), pa.array(crc, pa.int64()), pa.array([row["tokens"].rpartition("/")[2]] * len(start))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])


def read_documents(files: DataFrame) -> DataFrame:
    """A row per document, out of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, file."""
    n = files.count()
    return files.repartition(max(1, n)).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files to the shared folder and return what reading them back gives."""
    return read_documents(saved(write_token_files(docs, tokenizer, new_path(spark, "tokens"), **options), "token-offsets"))
