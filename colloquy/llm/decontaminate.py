"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words."""

from __future__ import annotations

import pickle
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .work import make_dir, new_path, open_fs, put_file

#: Words: ASCII digits and letters, letters lower-cased, and whatever is not ASCII; all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings (in words) of a set of items; for each state the items that hold its substrings.

    ``window`` words of an item in a row make a match; an item of fewer words is matched as a whole.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        held: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}
        for item, text in items:
            last, path = 0, []
            for w in text:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)), held)
                path.append(last)
            for state in path:
                held[state].add(item)
            if 0 < len(text) < window:
                whole.setdefault(last, set()).add(item)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.size[self.link[state]] >= window:
                held[self.link[state]] |= held[state]
        # The shortest substring of window words or more that ends each state's own, one look instead of a climb.
        self.top = list(range(len(self.size)))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            if self.size[self.link[state]] >= window:
                self.top[state] = self.top[self.link[state]]
        self.items = [frozenset(h) if size >= window else frozenset() for h, size in zip(held, self.size, strict=True)]
        # Short items that end here: their number of words and ids, longest first, over the chain of links.
        self.short: list[tuple] = [()] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            own = ((self.size[state], frozenset(whole[state])),) if state in whole else ()
            self.short[state] = own + self.short[self.link[state]]

    def _add(self, last: int, w: int, held: list[set[int]]) -> int:
        def new(size: int, to: dict[int, int], link: int) -> int:
            self.size.append(size)
            self.next.append(to)
            self.link.append(link)
            held.append(set())
            return len(self.size) - 1

        def split(p: int, q: int) -> int:
            """The state of p's longest substring with w; q is divided where it also holds longer ones."""
            if self.size[q] == self.size[p] + 1:
                return q
            twin = new(self.size[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = twin
            while p >= 0 and self.next[p].get(w) == q:
                self.next[p][w] = twin
                p = self.link[p]
            return twin

        if (q := self.next[last].get(w)) is not None:
            return split(last, q)
        here, p = new(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = here
            p = self.link[p]
        if p >= 0:
            self.link[here] = split(p, self.next[p][w])
        return here

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (begin, end; joined where they touch or overlap) that windows cover, and the items they are of."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        step, link, size, short, window, top = self.next, self.link, self.size, self.short, self.window, self.top
        state = length = 0
        for i, w in enumerate(map(self.ids.get, text)):
            if w is None:
                state = length = 0
                continue
            while (to := step[state].get(w)) is None and state:
                state = link[state]
                length = size[state]
            if to is None:
                continue
            state, length = to, length + 1
            most = 0
            if length >= window:
                found |= self.items[top[state]]
                most = length
            for n, items in short[state]:
                if n <= length:
                    found |= items
                    most = max(most, n)
            if most:
                begin = i + 1 - most
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, found


@lru_cache(maxsize=1)
def _load(path: str) -> SuffixAutomaton:
    fs, name = open_fs(path)
    with fs.open_input_stream(name) as f:
        return pickle.loads(f.read())


def automata(benchmark: DataFrame, window: int = 10, most_words: int = 250_000) -> list[str]:
    """Build the automata of all items and write them to the shared folder; their paths.

    The items' words are counted first. Items of over ``most_words`` words are cut into pieces that overlap by a window
    less one word, so that each window lies in one of them. The pieces are dealt by hash into as many blocks as keep a block
    near ``most_words`` words; each block's automaton is built and written by a task of its own, and only its path goes to
    the driver, so a worker holds one block at a time, whatever the benchmark's and an item's size.
    """

    def cut(batches):
        for b in batches:
            out = []
            for item, text in zip(*(b.column(c).to_pylist() for c in ("item_id", "text")), strict=True):
                w = words(text)
                for piece, i in enumerate(range(0, max(len(w) - window + 1, 1), most_words)):
                    out.append((item, piece, b" ".join(w[i : i + most_words + window - 1]).decode()))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["item_id", "piece", "text"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * most_words)))
    if n > 1:
        items = items.mapInArrow(cut, "item_id long, piece long, text string")
    folder = make_dir(new_path(benchmark.sparkSession, "benchmark"))

    def build(rows: pa.Table) -> pa.Table:
        own = SuffixAutomaton([(i, words(t)) for i, t in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)], window)
        path = f"{folder}/{rows.column('block')[0].as_py():05d}.pickle"
        put_file(path, lambda out: out.write(pickle.dumps(own)))
        return pa.table({"path": [path]})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", *(["piece"] if n > 1 else [])), F.lit(n)))
    return sorted(r.path for r in blocks.groupBy("block").applyInArrow(build, "path string").collect())


def _gathered(batches, most: int):
    """Batches of about ``most`` bytes, so that several automata are each read once for many documents."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def match(docs: DataFrame, paths: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, n_words, spans (word ranges begin and end), item_ids (sorted as strings), ``extra``."""

    def run(batches):
        for b in _gathered(batches, 1 << 25) if len(paths) > 1 else batches:
            texts = b.column("text").to_pylist()
            n, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for path in paths or [None]:
                own = _load(path) if path else None
                for k, text in enumerate(texts):
                    w = words(text)  # of one text at a time
                    n[k] = len(w)
                    if own:
                        s, found = own.match(w)
                        spans[k] += s
                        items[k] |= found
            if len(paths) > 1:
                for k, s in enumerate(spans):
                    spans[k] = []
                    for a, e in sorted(s):
                        if spans[k] and spans[k][-1][1] >= a:
                            a, e = spans[k][-1][0], max(e, spans[k].pop()[1])
                        spans[k].append((a, e))
            places = pa.array([[{"begin": a, "end": e} for a, e in s] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            named = pa.array([sorted(map(str, x)) for x in items], pa.list_(pa.string()))
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), places, named, *(b.column(c) for c in extra)], names=["doc_id", "n_words", "spans", "item_ids", *extra])
        _load.cache_clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in extra if c not in ("doc_id", "text")))
    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in extra)
    return rows.mapInArrow(run, "doc_id long, n_words long, spans array<struct<begin: long, end: long>>, item_ids array<string>" + (", " + kinds if kinds else ""))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Words of documents that lie inside an occurrence of ``window`` consecutive words of a benchmark item.

    A null text has no words; null, empty or wordless items match nothing; repeated items count each under its id;
    repeated documents give a row each; an empty table gives no rows; an empty benchmark no hits. Columns other than
    the ids and texts are not read. Texts of any length are streamed whole through the automaton; documents stay in
    their partition, nothing is shuffled.
    """
    return match(docs, automata(benchmark, window))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_span: int = 0, most_coverage: float = 0.5) -> DataFrame:
    """The documents with contaminated spans cut out, and without documents that are mostly benchmark text.

    A span of more than ``most_span`` words is cut out of its text, from its first word's first character to its
    last word's last; a document of whose words more than the part ``most_coverage`` is hit goes. Other documents
    keep their rows as they are, null texts and ids, repeated rows and columns of any name, too; an empty table or
    benchmark changes nothing. n_chars, if there, is counted again for texts that change.
    """
    import regex

    token = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {b: b + 32 for b in range(65, 91)}

    def cut(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for text, spans in zip(texts, b.column("spans").to_pylist(), strict=True):
                spans = [s for s in spans or () if s["end"] - s["begin"] > most_span]
                if spans:
                    at = [m.span() for m in token.finditer(text.translate(lower))]
                    keep, last = [], 0
                    for s in spans:
                        keep.append(text[last : at[s["begin"]][0]])
                        last = at[s["end"] - 1][1]
                    text = "".join([*keep, text[last:]])
                out.append(text)
            yield pa.record_batch([pa.array(out, pa.string()), b.column("_own")], names=["text", "_own"])

    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_own"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    found = match(own, automata(benchmark, window), ("text", "_own")).filter(hit <= most_coverage * F.col("n_words"))
    kind = dict(own.dtypes)["_own"]
    done = found.select("text", "spans", "_own").mapInArrow(cut, f"text string, _own {kind}")
    out = {c: F.col(f"_own.{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        changed = ~F.col("text").eqNullSafe(F.col("_own.text"))
        out["n_chars"] = F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_own.n_chars"))
    return done.select(*(c.alias(n) for n, c in out.items()))
