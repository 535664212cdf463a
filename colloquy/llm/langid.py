"""Language identification by language-bitmask n-gram filters."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .ngrams import fold, grams, join, mixed, per_text
from .tokens import blocks

_LETTER = regex.compile(r"\p{L}")
SIZES = (3, 4, 5)
#: Bytes of texts that are judged at once: their n-grams take some 60 times as much memory.
BLOCK = 1 << 19


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


class Filters:
    """A bit-sliced Bloom filter: a row of the table has a bit for each language.

    An n-gram's rows are combined by AND, which gives the mask of all languages that (probably) contain it at once.
    64 languages make one table; more languages, more tables.
    """

    def __init__(self, languages: list[str], bits: int = 20, probes: int = 2):
        self.languages, self.bits, self.probes = languages, bits, probes
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(len(languages), 64))
        self.tables = [np.zeros(1 << bits, width) for _ in range(0, len(languages), 64)]

    def rows(self, code: np.ndarray) -> list[np.ndarray]:
        return [(mixed(code, t + 1) >> np.uint64(64 - self.bits)).astype(np.int64) for t in range(self.probes)]

    def add(self, language: int, code: np.ndarray) -> None:
        table = self.tables[language // 64]
        for r in self.rows(code):
            table[r] |= table.dtype.type(1 << language % 64)

    def close(self) -> Filters:
        """Note each language's rate of false positives: its share of set bits, to the power of the probes."""
        self.false = np.array([((self.tables[k // 64] >> self.tables[k // 64].dtype.type(k % 64)) & 1).mean() ** self.probes for k in range(len(self.languages))])
        return self

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language, the part of the text's n-grams that the language contains, corrected for false positives."""
        flat, bounds = join([fold(t) for t in texts])
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n in SIZES:
            code, starts = grams(flat, bounds, n)
            total += np.diff(starts)
            rows = self.rows(code)
            for t, table in enumerate(self.tables):
                mask = table[rows[0]]
                for r in rows[1:]:
                    mask &= table[r]
                for k in range(64 * t, min(64 * t + 64, len(self.languages))):
                    hits[:, k] += per_text((mask >> table.dtype.type(k % 64)) & table.dtype.type(1), starts)
        total = np.maximum(total, 1)[:, None]
        return np.clip((hits / total - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def fit(docs: DataFrame, per_language: int = 2000, least_share: float = 2e-5) -> Filters:
    """Learn the filters from text and lang of rows that are not held out.

    About ``per_language`` documents of each language are used (all, if there are fewer), those whose id's hash lies
    below a bound that its count sets: a bound on the sample alone. An n-gram is added to a language if it makes up ``least_share`` or more of the language's
    n-grams of its length, so no more than 1 / least_share n-grams of a length reach the driver for a language.
    """
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~held_out() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    own = Filters(languages)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = F.lit(False)
    for name, n in counts.items():
        near = near | ((F.col("lang") == name) & (place <= int((1 << 30) * min(1.0, per_language / n))))
    sample = known.filter(near)

    def count(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array([languages.index(x) for x in b.column("lang").to_pylist()])
            for i, k in blocks(texts):
                flat, bounds = join([fold(t) for t in texts[i:k]])
                for n in SIZES:
                    code, starts = grams(flat, bounds, n)
                    of = np.repeat(langs[i:k], np.diff(starts))
                    for lang in np.unique(of):
                        found, times = np.unique(code[of == lang], return_counts=True)
                        yield pa.record_batch([pa.array([lang] * len(found), pa.int32()), pa.array([n] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(times, pa.int64())], names=["lang", "n", "code", "times"])

    found = sample.select("text", "lang").mapInArrow(count, "lang int, n int, code long, times long").groupBy("lang", "n", "code").agg(F.sum("times").alias("times"))
    found = found.persist()
    totals = found.groupBy("lang", "n").agg(F.sum("times").alias("total"))  # a row per language and length
    common = found.join(F.broadcast(totals), ["lang", "n"]).filter(F.col("times") >= F.greatest(F.lit(2.0), least_share * F.col("total")))
    table = common.select("lang", "code").toArrow()
    found.unpersist()
    lang, code = table["lang"].to_numpy(), table["code"].to_numpy().view(np.uint64)
    for k in range(len(languages)):
        own.add(k, code[lang == k])
    return own.close()


def predict(docs: DataFrame, filters: Filters, extra: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (the winning language's corrected share) and ``extra``.

    ``und`` with score 0 for a null or empty text, one without a letter, or if no language was learned; ties go to the
    language that sorts first. Whole texts of any length are read; a null doc_id is not held out; repeated rows give a
    row each; other columns are no input. Rows stay in their partition, the filters go to the workers as one array. The text
    may lie in ``row``, a struct column named in ``extra``, so that it goes to the workers and back only once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for b in batches:
            whole = pc.fill_null(pc.struct_field(b.column(row), "text") if row else b.column("text"), "")
            for i, k in blocks(whole, BLOCK):
                part = whole.slice(i, k - i).to_pylist()
                if own.languages:
                    shares = own.shares(part)
                    best = shares.argmax(axis=1)
                    top = shares[np.arange(len(part)), best]
                else:
                    best, top = np.zeros(len(part), int), np.zeros(len(part))
                none = np.array([not own.languages or not _LETTER.search(t) for t in part])
                found, score = names[np.where(none, len(own.languages), best)], np.where(none, 0.0, top)
                same = [b.column(c).slice(i, k - i) for c in ("doc_id", "held_out", *extra)]
                yield pa.record_batch([*same[:2], pa.array(found, pa.string()), pa.array(score, pa.float64()), *same[2:]], names=["doc_id", "held_out", "lang_pred", "score", *extra])

    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), *([] if row else ["text"]), *(c for c in extra if c not in ("doc_id", "text")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in extra))


def identify(docs: DataFrame, **options) -> DataFrame:
    """fit() and predict() on one table."""
    return predict(docs, fit(docs, **options))
