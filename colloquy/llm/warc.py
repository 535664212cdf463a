"""WARC archives of web pages, compressed record by record with a dictionary that the file itself carries."""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .work import lookup, make_dir, new_path, open_fs, put_file, saved

#: Fixed values of the formats: the skippable frame that holds the dictionary, and the record's first line.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to, date: str, repeated: bool) -> bytes:
    """A response record, or a revisit record without the payload; the payload's digest and length are in the header."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    uri = quote(url or "", safe="%/:?#[]@!$&'()*+,;=~|{}^`\"<>\\")
    head = [f"WARC-Type: {'revisit' if repeated else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {uri or 'about:blank'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    body = b""
    if repeated:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        head.append("Content-Type: text/html; charset=utf-8")
        body = payload
    return VERSION + b"\r\n" + "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archive(out, records: list[bytes], sample_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 15, level: int = 3) -> tuple[int, int]:
    """Write the records of one file to a stream; (records, bytes) written.

    The dictionary is trained on records from all over the file, of about ``sample_bytes`` together and 16 KB of each
    at most (a bound on the fit alone; every record is compressed with it). Where they are too few to train on, their
    own bytes are the dictionary.
    """
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = [r[: 1 << 14] for r in records[::step]]
    try:
        raw = zstandard.train_dictionary(dictionary_bytes, sample, level=level).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(sample)[-dictionary_bytes:]
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    written = 8 + len(raw)
    for r in records:
        frame = press.compress(r)
        out.write(frame)
        written += len(frame)
    return len(records), written


def read_archive(source):
    """(header, body) of each record of an archive file, streamed; header names are in lower case."""
    head = source.read(8)
    known, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        known, rest = zstandard.ZstdCompressionDict(source.read(struct.unpack("<I", head[4:])[0])), b""
    plain = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    data, frame, begun = rest, plain.decompressobj(), False
    parts: list[bytes] = []
    while True:
        if not data:
            data = source.read(1 << 20)
            if not data:
                break
        parts.append(frame.decompress(data))
        begun = not frame.eof
        if frame.eof:
            data, frame = frame.unused_data, plain.decompressobj()
            chunk, parts = b"".join(parts), []
            header, _, body = chunk.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:])
            fields = {k.lower(): v for k, v in fields.items()}
            yield fields, body[: int(fields["content-length"])]
        else:
            data = b""
    if begun:
        raise ValueError("an archive ends inside a record")


#: Bytes of records after which a task begins its next archive: what it holds in memory to take a sample from.
ARCHIVE_BYTES = 1 << 26


def _writer(folder: str, date: str):
    columns = ("page_id", "url", "payload", "sha1", "refers_to", "again")

    def records(batches):
        for b in batches:
            for page, url, payload, sha1, to, again in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                yield record(page, url, payload, sha1, to, date, again)

    def archives(batches):
        held, size = [], 0
        for r in records(batches):
            held.append(r)
            size += len(r)
            if size >= ARCHIVE_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, own in enumerate(archives(batches)):
            path, done = f"{folder}/pages-{part:06d}-{k:04d}.warc.zst", []
            put_file(path, lambda out, own=own, done=done: done.append(write_archive(out, own)))
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([done[0][0]], pa.int64()), pa.array([done[0][1]], pa.int64())], names=["part", "path", "n_records", "n_bytes"])

    return run


def _reader(batches):
    page = lambda name: None if name is None or name == "<urn:page:null>" else int(name[10:-1])
    for b in batches:
        for row in b.to_pylist():
            fs, name = open_fs(row["path"])
            with fs.open_input_stream(name, compression=None) as source:
                out = []
                for h, body in read_archive(source):
                    kind = h["warc-type"]
                    sha1 = digest(body) if kind == "response" else h["warc-payload-digest"].removeprefix("sha1:")
                    out.append((page(h["warc-record-id"]), len(body) if kind == "response" else int(h["x-payload-length"]), sha1, kind, page(h.get("warc-refers-to")), row["path"].rpartition("/")[2]))
                    if len(out) == 4096:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)


def _rows(out):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def write_warc(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page; a row per archive file (part, path, n_records, n_bytes).

    Of pages with the same payload of ``least`` bytes or more, the one with the largest page_id is the response and
    the others are revisits that refer to it. A null html is an empty payload, a null url an empty one. A null page_id
    comes before all others; among repeated rows of the largest page_id each is a response, as nothing tells them
    apart. An empty table gives no files. Other columns are not read.

    Groups of equal payloads come from an aggregate of digests and page ids alone; only groups of two or more meet the
    pages again, the largest of them by a broadcast of bounded size, so no group gathers in one task.
    """
    make_dir(folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = saved(rows.filter(F.octet_length("payload") >= least).select("sha1", "page_id").groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("w")).filter("w > 1"), "warc-groups")
    n = groups.agg(F.sum("w")).first()[0] or 0
    known = lookup(rows, groups, "sha1", "w", max(1, n), ["page_id", "url"])
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    ready = known.select("page_id", "url", "payload", "sha1", again.alias("again"), F.when(again, F.col("first")).alias("refers_to"))
    return saved(ready.withColumn("sha1", _base32("sha1")).mapInArrow(_writer(folder, date), "part int, path string, n_records long, n_bytes long"), "warc-files")


def _base32(name: str):
    """Base32 of a SHA-1 given in hex: 32 digits of five bits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(0, 40, 10):
        number = F.conv(F.substring(name, k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(digits), F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and return a row per record as read back from them."""
    files = write_warc(pages, new_path(spark, "warc")).filter("n_records > 0")
    return files.repartition(max(1, files.count())).mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string")
