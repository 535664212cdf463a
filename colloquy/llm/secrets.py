"""Secret scan: all rules in one automaton, one pass over the bytes of every text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .automata import backwards, build, parse


@dataclass(frozen=True)
class Rule:
    """A regex that ends in a repeated class; a match is kept if that last repeat has ``tail`` characters or more.

    Of two matches that overlap, the one that starts first must also be the first that can end; rules of a fixed
    head and a repeated class are so.
    """

    kind: str
    pattern: str
    tail: int = 1


#: The contract's three kinds, in its order. A run of hex digits counts from 16 on, which is the same as dropping shorter runs.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 14),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public token formats that the base kinds do not name.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 30),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("pem", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, nodes = rules, [parse(r.pattern) for r in rules]
        self.rows = build(nodes, True).linked()
        self.each = [build([n], True).linked()[0] for n in nodes]
        self.back = [build([backwards(n)], False) for n in nodes]
        self.on = [build([n], False) for n in nodes]

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rules) for every byte at which a match of some rule ends; the one pass over the text."""
        row, out = self.rows[0], []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                out.append((i + 1, row[256]))
        return out

    def next_end(self, data: bytes, k: int, at: int) -> int:
        """Where the first match of rule k that starts at ``at`` or later can end, -1 if none does."""
        row = self.each[k]
        for i in range(at, len(data)):
            row = row[data[i]]
            if row[256]:
                return i + 1
        return -1

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, leftmost and non-overlapping for each rule, by start and rule.

        A hit is followed back to its first start, no farther than the end of the match before; where there is none,
        as the hit began inside that match, the rule's own automaton goes on from that end. So each rule reads a byte
        a fixed number of times.
        """
        found, hits = [], self.hits(data)
        for k in range(len(self.rules)) if hits else ():
            done, last = 0, 0
            for end in (e for e, bits in hits if bits >> k & 1):
                if end <= done:
                    continue
                starts = self.back[k].ends(data, end, -1, last)
                if not starts:
                    end = self.next_end(data, k, last)
                    if end < 0:
                        break
                    starts = self.back[k].ends(data, end, -1, last)
                ends = self.on[k].ends(data, starts[-1])
                last = done = ends[-1]
                if ends[-1] - ends[0] + 1 >= self.rules[k].tail:
                    found.append((starts[-1], ends[-1], k))
        return sorted(found, key=lambda x: (x[0], x[2]))


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """A row per document: doc_id, spans (list of kind, start, end in code points; by start, then in the rules' order).

    A null or empty text has no spans, a null doc_id stays null, repeated rows give a row each, an empty table gives
    no rows; other columns are not read. Texts of any length are scanned whole, a document at a time. The automata
    are made in each worker from the rules; rows stay in their partition.
    """

    def run(batches):
        own = scanner(rules)
        kinds = [r.kind for r in rules]
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                data = text.encode()
                spans = own.spans(data)
                if spans and len(data) != len(text):
                    at, chars, place = 0, 0, {}
                    for x in sorted({p for s in spans for p in s[:2]}):
                        chars += len(data[at:x].decode())
                        at, place[x] = x, chars
                    spans = [(place[s], place[e], k) for s, e, k in spans]
                out.append([{"kind": kinds[k], "start": s, "end": e} for s, e, k in spans])
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what scan() returns."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
