"""Near-duplicate lines: an exact set-similarity join with prefix, positional and length filters, in DataFrame functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .work import drop, lookup, saved

#: log2 of the number of hash buckets in which words are counted for the order by rarity.
RANK_BITS = 18
#: White space inside a line besides the space.
BLANKS = "\t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the parts of a text between line feeds; a null text has none.

    Here and below, the outer form of explode keeps Spark from splitting a text twice, once to filter by the size.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).filter("line is not null")


def _parts(text: Column) -> Column:
    """The lower-cased text between white space, with empty parts; by a pattern only where there is more than spaces."""
    low, odd = F.lower(text), F.lit(False)
    for c in BLANKS:
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.split(low, r"[\x09-\x0D\x20]")).otherwise(F.split(low, " "))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def _words(lines: DataFrame) -> DataFrame:
    """In place of lines, the 56-bit hashes of their different words, how many those are (n) and words the line has (m)."""
    short = lambda w: F.shiftrightunsigned(F.xxhash64(w), 8)
    hashes = F.array_remove(F.transform(_parts(F.col("line")), short), short(F.lit("")))
    rows = lines.withColumn("hashes", hashes).drop("line").withColumn("m", F.size("hashes"))
    return rows.withColumn("hashes", F.array_distinct("hashes")).withColumn("n", F.size("hashes"))


def _ranks(rows: DataFrame) -> DataFrame:
    """One row with a number for each of 2 ** RANK_BITS hash buckets of words: how many lines' different words it holds, in thirds of
    a power of two from 1 on, at bit 56. A table, asked by a scalar subquery: its numbers are in no row and in no description of a plan.
    ``rows`` are documents or those of _words()."""
    words = rows if "hashes" in rows.columns else _words(_lines(rows))
    counts = words.select(F.explode_outer("hashes").alias("h")).filter("h is not null").groupBy(_bucket(F.col("h"), 56).alias("bucket")).agg(F.count("*").alias("n"))
    counts = counts.select("bucket", (1 + F.least(F.floor(3 * F.log2("n")), F.lit(126))).cast("long").alias("rank")).toArrow()  # 2 ** RANK_BITS rows at most, whatever the input
    ranks = np.ones(1 << RANK_BITS, np.int64)
    ranks[counts["bucket"].to_numpy()] = counts["rank"].to_numpy()
    return rows.sparkSession.createDataFrame([((ranks << 56).tolist(),)], "ranks array<bigint>")


def _bucket(h: Column, bits: int = 64) -> Column:
    """The first RANK_BITS of a hash of so many bits."""
    return F.shiftrightunsigned(h, bits - RANK_BITS)


def _overlap(percent: int, overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Sets of n_a and n_b tokens with that overlap reach the similarity."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _may(percent: int, a: str, b: str) -> Column:
    """Two entries of one token could be of similar lines, by three bounds that no similar pair exceeds.

    Position: with this as their first common token, lines share no more than what follows it, which bounds the size
    of the other line (``room``); at a line's first token this is the bound on lengths. Parity: bit k says whether an
    odd number of a line's tokens hash to k, so each differing bit is a token that only one of the lines has.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    apart = F.bit_count(col(a, "even").bitwiseXOR(col(b, "even"))) + F.bit_count(col(a, "odd").bitwiseXOR(col(b, "odd")))
    fits = (col(a, "room") >= col(b, "n")) & (col(b, "room") >= col(a, "n"))
    return fits & ((100 + percent) * apart <= (100 - percent) * (col(a, "n") + col(b, "n")))


def _tokens(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """In place of lines, or of the hashes of _words(), their different words as sorted numbers (the rank of the word's bucket, then
    its hash), and the parities of 128 hash buckets of them: of the even hashes, of the odd ones.

    Functions of array elements are interpreted, so each takes as few steps as it can: ranks lie where a number has them,
    and a word's bit is read from a short array.
    """
    words = rows if "hashes" in rows.columns else _words(rows)
    number = lambda counts: F.transform("hashes", lambda h: F.coalesce(counts[_bucket(h, 56)], F.lit(1 << 56)).bitwiseOR(h))
    # Named once, the subquery's column is put in place of its name and never becomes part of a row.
    tokens = F.element_at(F.transform(F.array("ranks"), number), 1)
    numbered = words.withColumn("ranks", ranks.scalar()).withColumn("tokens", tokens).drop("hashes", "ranks").withColumn("tokens", F.sort_array("tokens"))

    def parity(odd: int) -> Column:
        """Of tokens t with t & 1 equal to that, at bit t >> 1 & 63."""
        bits = F.array(*(F.lit(((1 << (k >> 1)) ^ (1 << 63)) - (1 << 63) if k & 1 == odd else 0).cast("long") for k in range(128)))
        seen = F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.coalesce(bits[t.bitwiseAND(F.lit(127))], F.lit(0))))
        return F.coalesce(seen, F.lit(0).cast("long"))  # never null, or joins would compute it twice, first to filter by it

    return numbered.withColumns({"even": parity(0), "odd": parity(1)})


def _entries(lines: DataFrame, percent: int) -> DataFrame:
    """The prefix index: a row (token, room) for each of a line's rarest tokens, as many as two similar lines need to
    share one, in place of the tokens. ``room`` is the size of the largest line that can be similar if this is the first
    token that both have."""
    size = (F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1).cast("int")
    names = [c for c in lines.columns if c != "tokens"]
    rows = lines.select(*names, F.posexplode_outer(F.slice("tokens", 1, size)).alias("at", "token")).filter("token is not null")
    return rows.select(*names, "token", F.floor((100 * F.col("n") - (100 + percent) * F.col("at")) / percent).cast("int").alias("room"))


def _perhaps(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those rows whose x is in ``keys``, and a few others: 2 ** (RANK_BITS + 6) bits of hash buckets, whatever the input, as a scalar
    subquery. With more keys than that it leaves out nothing, and nothing is lost; it only saves a shuffle of rows that no key meets."""
    bit = F.expr("cast(shiftrightunsigned(x, 40) & 63 as int)")
    marks = keys.groupBy(_bucket(F.col("x")).alias("bucket"), bit.alias("bit")).agg(F.lit(1)).groupBy("bucket")
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # 2 ** RANK_BITS rows at most, whatever the input
    table = np.zeros(1 << RANK_BITS, np.int64)
    table[marks["bucket"].to_numpy()] = marks["bits"].to_numpy()
    table = rows.sparkSession.createDataFrame([(table.tolist(),)], "marks array<bigint>")
    found = F.expr(f"shiftrightunsigned(marks[shiftrightunsigned(x, {64 - RANK_BITS})], cast(shiftrightunsigned(x, 40) & 63 as int)) & 1 = 1")
    return rows.withColumn("marks", table.scalar()).filter(found).drop("marks")


def similar_lines(docs: DataFrame, percent: int = 75, least: int = 5) -> DataFrame:
    """Groups of equal lines of ``least`` words or more that do not all stay: (hash, w, first, gone).

    ``first`` is the group's first place (doc_id, pos), ``w`` its number of lines; with ``gone`` an earlier line of
    other text is similar, so that the first line goes, too.

    Equal lines become one before their words are read, and words are split and hashed once, into a table. First the prefix
    index of all lines is joined with itself by token, in a semi join: it keeps the entries that have any partner
    within the bounds of _may(), and yields no pairs. Two similar lines both keep the entry of their first common token, so only
    these entries go on, and only their lines' words are fetched. Among them each
    line then meets the first line of each of its tokens. Those that no such line resembles meet all earlier lines of
    their tokens that the bounds leave, again in semi joins: the last compares words and stops at the first similar line. So
    a large group of similar lines costs a row for each token of its lines, and never a row for each two of them.
    """
    plain = _lines(docs).select(_hash(F.col("line")).alias("hash"), F.struct("doc_id", "pos").alias("first"), "line")
    groups = plain.groupBy("hash.x", "hash.y").agg(F.min("first").alias("f"), F.count("*").alias("w"), F.first("line").alias("line"))
    # Filtered once it is read: a filter by m would go below the words and split each line twice. Neither do joins need a repartition() before.
    words = saved(_words(groups), "line-words").filter(F.col("m") >= least).withColumn("hash", F.struct("x", "y"))

    ranks = _ranks(words)
    # x: 64 bits of a line's hash, which only have to tell lines of one token apart.
    entries = _entries(_tokens(words.select("x", "n", "hashes"), ranks), percent)
    bounds = _may(percent, "a", "b")
    near = entries.alias("a").join(entries.alias("b").hint("merge"), (F.col("a.token") == F.col("b.token")) & (F.col("a.x") != F.col("b.x")) & bounds, "left_semi")
    near = saved(near, "line-near")

    texts = _perhaps(words, near).join(near.select("x").distinct().hint("merge"), "x", "left_semi")
    texts = saved(texts.select("x", "hash", "f", "n", F.col("hashes").alias("tokens")), "line-texts")
    index = saved(near.join(texts.select("x", "f").hint("merge"), "x"), "line-entries")
    drop(near)
    hubs = index.groupBy("token").agg(F.min(F.struct("f", "x", "n", "room", "even", "odd")).alias("hub"), F.count("*").alias("w")).filter("w > 1")
    met = index.alias("b").join(hubs.select("token", "hub").hint("merge"), "token").filter((F.col("hub.f") < F.col("b.f")) & _may(percent, "hub", "b"))
    gone = verified(texts, saved(met.select(F.col("hub.x").alias("a"), F.col("b.x").alias("b")).distinct(), "line-pairs"), percent)
    later = index.join(gone.select("hash.x").hint("merge"), "x", "left_anti")
    earlier = (F.col("a.token") == F.col("b.token")) & (F.col("a.f") < F.col("b.f")) & bounds
    late = saved(later.alias("b").join(index.alias("a").hint("merge"), earlier, "left_semi"), "line-late")
    early = index.alias("a").join(late.alias("b").hint("merge"), earlier, "left_semi")
    tokens = texts.select("x", "tokens")
    early, last = (saved(rows.join(tokens.hint("merge"), "x"), "line-last") for rows in (early, late))
    alike = _overlap(percent, F.size(F.array_intersect("a.tokens", "b.tokens")), F.col("a.n"), F.col("b.n"))
    met = last.alias("b").join(early.alias("a").hint("merge"), earlier & alike, "left_semi").select("x").distinct()
    found = saved(texts.join(met.hint("merge"), "x", "left_semi").select("hash", F.col("f").alias("first")), "line-gone")
    drop(index, late, early, last)
    gone = gone.union(found).groupBy(F.col("hash").alias("b")).agg(F.min("first").alias("b_first"))
    copies = words.filter("w > 1").select("hash", F.col("f").alias("first"), "w")
    both = copies.join(gone.hint("merge"), F.col("hash") == F.col("b"), "full")
    return both.select(F.coalesce("hash", "b").alias("hash"), F.coalesce("w", F.lit(1)).alias("w"), F.coalesce("first", "b_first").alias("first"), F.col("b").isNotNull().alias("gone"))


def verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(hash, first) of the later lines of those pairs (a, b) of lines whose word sets reach the similarity.

    A line in very many pairs makes a skewed partition of a merge join of two shuffled tables, which Spark splits as it runs.
    """
    a = texts.select(F.col("x").alias("a"), F.col("tokens").alias("a_tokens"), F.col("n").alias("a_n"))
    b = texts.select(F.col("x").alias("b"), F.col("tokens").alias("b_tokens"), F.col("n").alias("b_n"), "hash", "f")
    met = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    alike = met.filter(_overlap(percent, F.size(F.array_intersect("a_tokens", "b_tokens")), F.col("a_n"), F.col("b_n")))
    found = saved(alike.groupBy("hash").agg(F.min("f").alias("first")), "line-gone")
    drop(pairs)
    return found


def removed_lines(docs: DataFrame, percent: int = 75, least: int = 5) -> DataFrame:
    """Lines that an earlier line of the table resembles: (doc_id, removed), removed the sorted line numbers from 0.

    Lines stand in the order of doc_id and line number. A line goes if an earlier one has a set of words (lower-cased,
    between white space) whose Jaccard similarity with its own is percent / 100 or more, whether that line goes itself
    or not. Lines of fewer than ``least`` words (all of them, repeats too) always
    stay. Documents that lose no line are left out.

    A null text has no lines, an empty one a single empty line; a null doc_id comes first; rows with the same doc_id
    share their places, so a line at the first place of its group stays in each. Other columns are not read.
    """
    groups = saved(similar_lines(docs, percent, least), "line-groups")
    lines = _lines(docs).select("doc_id", "pos", _hash(F.col("line")).alias("hash"))
    n = max(1, groups.agg(F.sum("w")).first()[0] or 0)
    known = lookup(lines, groups, "hash", "w", n, ["doc_id", "pos"]).filter("gone is not null")
    goes = F.col("gone") | ~F.struct("doc_id", "pos").eqNullSafe(F.col("first"))
    return known.filter(goes).groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def digest(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, removed (line numbers, comma-joined)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    both = own.join(removed.hint("merge"), own.doc_id.eqNullSafe(removed.doc_id), "left")
    return both.select(own.doc_id, "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame, keep_blank: bool = True) -> DataFrame:
    """The documents with those lines taken out of their texts; n_chars, if there, counts a text that changes. Without
    ``keep_blank``, documents go of which that leaves white space alone. Other columns stay, whatever their names."""
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("removed").alias("_gone"))
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*docs.columns).alias("_own"))
    both = own.join(gone.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")), "left")
    kept = F.filter(F.split("_own.text", "\n"), lambda line, i: ~F.array_contains("_gone", i))
    out = both.withColumn("_text", F.when(F.col("_gone").isNull(), F.col("_own.text")).otherwise(F.array_join(kept, "\n")))
    if not keep_blank:
        out = out.filter(F.col("_gone").isNull() | F.col("_text").rlike(r"[^\x09-\x0D\x20]"))
    columns = {c: F.col(f"_own.{c}") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        counted = F.length("_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_own.n_chars")).otherwise(counted)
    return out.select(*(c.alias(n) for n, c in columns.items()))
