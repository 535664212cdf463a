"""Near-duplicate documents: one-permutation MinHash with optimal densification, banding and star-shaped candidates."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .work import components, drop, lookup, saved

WORDS, BANDS, ROWS = 5, 40, 5
BINS = BANDS * ROWS
#: 64-bit numbers that hold a document's parities.
PARITIES = 16
PARITY = [f"p{k}" for k in range(PARITIES)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TURN = np.array([0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1 | 1 for k in range(max(WORDS, ROWS))], np.uint64)


class _Hashes(dict):
    """The hash of each word, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's 5-word shingles; fewer words make one shingle, none an empty set."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _TURN[k]
    return np.unique(_mixed(total))


@lru_cache(maxsize=1)
def _attempts() -> np.ndarray:
    """For each attempt and bin, the bin that an empty bin asks for a value: the same for every document."""
    at = np.arange(BINS * 256, dtype=np.uint64).reshape(256, BINS) + np.uint64(1)
    return (_mixed(_mixed(at * _TURN[1])) % np.uint64(BINS)).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of the bins into which one permutation puts a set; empty bins borrow from the others."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for row in _attempts():
        if not len(empty):
            break
        got = full[row[empty]]
        values[empty[got]] = values[row[empty[got]]]
        empty = empty[~got]
    filled = np.flatnonzero(full)
    if len(empty):  # after 256 attempts: the next full bin
        values[empty] = values[filled[np.searchsorted(filled, empty) % len(filled)]]
    return _mixed(values)


def _sign(batches):
    for b in batches:
        n, print_, bands, marks = [], [], [], []
        for text in b.column("text").to_pylist():
            own = shingles(text)
            n.append(len(own))
            if len(own):
                v = signature(own)
                key = (v.reshape(BANDS, ROWS) * _TURN[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                print_.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(_mixed(key).view(np.int64))
                marks.append((v >> np.uint64(56)).astype(np.uint8).tobytes())
            else:
                print_.append(None)
                bands.append(None)
                marks.append(None)
        yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(print_, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "n", "print", "bands", "marks"])
    _words.clear()


def _agree(percent: int, n: np.ndarray) -> np.ndarray:
    """The share of bins in which signatures of sets of n shingles or more agree at the threshold, less five standard errors."""
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / np.minimum(n, BINS))


def _alike(percent: int):
    """Keep pairs whose signatures agree as those of pairs at the threshold do, but for one in millions."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("marks_a", "marks_b"))
                yield b.filter(pa.array((x == y).mean(axis=1) >= _agree(percent, b.column("n").to_numpy()))).select(["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        sets: dict[str, np.ndarray] = {}
        for b in batches:
            keep = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                if x not in sets:
                    if len(sets) > 200:
                        sets.clear()
                    sets[x] = shingles(x)
                u, v = sets[x], shingles(y)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _with(pairs: DataFrame, table: DataFrame, side: str, value: str, total: int, share: int) -> DataFrame:
    """Add to pairs the table's value of one side; safe for a document that is on that side of most pairs."""
    # What lookup() sends to all tasks is `share` values at most; of texts, only those of up to 2 ** 18 characters count as hot.
    w = pairs.groupBy(F.col(side).alias("_id")).agg(F.count("*").alias("_w"))
    right = w.join(table.select(F.col("id").alias("_id"), F.col(value).alias(f"{value}_{side}")).hint("merge"), "_id")
    other = "b" if side == "a" else "a"
    if value == "text":
        right = right.withColumn("_w", F.when(F.length(f"{value}_{side}") <= 1 << 18, F.col("_w")).otherwise(0))
    return lookup(pairs, right.withColumnRenamed("_id", side), side, "_w", total, [other], share)


def _parities(batches):
    """For each document and each of 64 * PARITIES hash buckets, whether it holds an odd number of shingles; and the shingles."""
    for b in batches:
        sets = [*map(shingles, b.column("text").to_pylist())]
        parity = np.zeros((len(sets), PARITIES), np.uint64)
        for row, s in zip(parity, sets, strict=True):
            bit = np.bincount((s & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
            row[:] = np.packbits(bit.astype(np.uint8), bitorder="little").view(np.uint64)
        columns = [pa.array(c) for c in np.ascontiguousarray(parity.T).view(np.int64)]
        own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.record_batch([b.column("id"), b.column("t"), n, *columns, own], names=["id", "t", "n", *PARITY, "shingles"])


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of buckets that hold several components: (id, component)."""
    now = members.join(labels.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("w")).filter("low <> high")
    mixed = saved(mixed.select("key", "w", F.lit(True).alias("mixed")), "minhash-mixed")
    n = mixed.agg(F.sum("w")).first()[0] or 0
    return saved(lookup(now, mixed, "key", "w", max(1, n), ["id"]).filter("mixed").select("id", "component").distinct(), "minhash-apart")


def met_apart(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of those documents in different components that could be linked, and all that are.

    An exact prefix filter: of its shingles in the order of how many of these documents have each, a document shares
    one of the first few with any that it is linked to. Shingles of its own come first in that order, so a variant
    that many edits set apart from the rest of its group has few or no entries. Three bounds that no linked pair
    exceeds follow: sizes and positions, as the first common shingle leaves room for a partner of a certain size; and
    parities, as a bucket that holds an odd number of shingles of only one of the two is a shingle that the other lacks.
    """
    own = texts.join(rest.select("id").hint("shuffle_hash"), "id", "left_semi").withColumn("t", F.xxhash64("text"))  # t: rows may share an id
    schema = ", ".join(f"{c} long" for c in ("id", "t", "n", *PARITY)) + ", shingles array<long>"
    known = saved(own.mapInArrow(_parities, schema), "minhash-shingles")
    each = known.select("id", "t", F.explode("shingles").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(often.hint("merge"), "h").groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))  # one document's
    rows = known.drop("shingles").join(shared.hint("merge"), ["id", "t"]).join(rest.hint("merge"), "id")
    at = F.col("n") - F.col("k") + F.col("i")
    rows = rows.select("id", "t", "n", "component", *PARITY, F.size("s").alias("k"), F.posexplode("s").alias("i", "x"))
    entries = rows.withColumn("room", F.floor((100 * F.col("n") - (100 + percent) * at) / percent)).filter(100 * F.col("room") >= percent * F.col("n"))
    entries = entries.select("id", "n", "component", "room", *PARITY, "x.h")
    differ = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in PARITY), F.lit(0))
    may = (F.col("a.room") >= F.col("b.n")) & (F.col("b.room") >= F.col("a.n")) & ((100 + percent) * differ <= (100 - percent) * (F.col("a.n") + F.col("b.n")))
    on = (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & may
    return saved(entries.alias("a").join(entries.alias("b").hint("merge"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), "minhash-near")


def linked(signed: DataFrame, docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Components over classes of equal sets: (id, component) for linked ones, and the classes (print, id, w).

    Star-shaped candidates first: in each bucket the document that shares most with others (by the sum of its buckets'
    sizes), so the original of a group of copies, is paired with all others of the bucket. Documents of buckets that
    still hold several components then meet by met_apart(), which loses no link. So a group of copies costs a pair for
    each, and no two documents that share a bucket stay unlinked for lack of a test.
    """
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("w"), *(F.first(c).alias(c) for c in ("n", "bands", "marks")))
    classes = saved(classes, "minhash-classes")
    rows = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("w")).filter("w > 1").withColumn("size", F.col("w"))
    sizes = saved(sizes, "minhash-buckets")
    total = max(1, sizes.agg(F.sum("w")).first()[0] or 0)
    found = saved(lookup(rows, sizes, "key", "w", total, ["id"]).filter("size is not null"), "minhash-members")
    score = found.groupBy("id").agg(F.sum("size").alias("score"))
    members = saved(found.join(score.hint("merge"), "id"), "minhash-members")
    drop(found)
    order = F.struct(-F.col("score"), F.col("id"), F.col("n")).alias("o")
    ids = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null").join(ids.hint("shuffle_hash"), "id", "left_semi")
    texts = saved(texts, "minhash-texts")
    marks = classes.select("id", "marks")

    def confirmed(near: DataFrame) -> DataFrame:
        n = near.count()
        if not n:
            return near
        both = _with(_with(near, texts, "b", "text", n, 200), texts, "a", "text", n, 200)
        links = saved(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long").distinct(), "minhash-links")
        drop(near)
        return links

    first = members.groupBy("key").agg(F.min(order).alias("o"))
    first = first.join(sizes.hint("merge"), "key").select("key", "w", F.col("o.id").alias("a"), F.col("o.n").alias("n_a"))
    pairs = lookup(members, first, "key", "w", total, ["id"]).select("a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b"))
    fits = f"a <> b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    pairs = saved(pairs.filter(fits).select("a", "b", F.least("n_a", "n_b").alias("n")).distinct(), "minhash-pairs")
    n = pairs.count()
    if n:
        near = _with(_with(pairs, marks, "b", "marks", n, 2000), marks, "a", "marks", n, 2000)
        links = confirmed(saved(near.mapInArrow(_alike(percent), "a long, b long").distinct(), "minhash-near"))
    else:
        links = pairs.select("a", "b")
    labels = components(links)
    rest = apart(members, labels)
    if rest.limit(1).count():
        more = confirmed(met_apart(rest, texts, percent))
        labels = components(saved(links.union(more), "minhash-links"))
    return labels, classes


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of 5-word shingles (words between
    white space, A-Z lower-cased; fewer words make one shingle). Candidates come from buckets of 40 bands of five
    bins of a one-permutation MinHash; a pair at the threshold shares none with a probability of about 2 in 100,000.
    Every link is confirmed on the full sets. Documents with equal sets make one class before buckets are formed; classes
    whose smallest doc_id is the same count as one.

    Texts that are null, empty or white space have no shingles and no links. A null doc_id takes no part: its
    component is null and it is kept. Rows with the same doc_id each get the component of their own text. An empty
    table gives no rows; other columns are not read.
    """
    signed = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign, "doc_id long, n long, print binary, bands array<long>, marks binary"), "minhash-signed")
    labels, classes = linked(signed, docs, percent)
    own = classes.select("print", "id", "w").join(labels.hint("merge"), "id", "left").select("print", "w", F.coalesce("component", "id").alias("found"))
    total = max(1, signed.count())
    found = lookup(signed.select("doc_id", "n", "print"), saved(own, "minhash-found"), "print", "w", total, ["doc_id"])
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    least = found.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return least.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
