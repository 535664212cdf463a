"""Chunking of long texts by folds over paragraphs and sentences, with offsets carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, stripped


def needs_chunking(text: Column, threshold: int = 3000) -> Column:
    """D4."""
    return F.length(text) > threshold


def _whole(text: Column, pattern: str) -> Column:
    """The parts of a text between a pattern, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), stripped), lambda s: s != "")


def _but_last(done: Column) -> Column:
    return F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))


def _joined(done: Column, text: Column, between: str) -> Column:
    """The list with the text put on to its last entry."""
    return F.concat(_but_last(done), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(between), text)))


def _state(done: Column, now: Column) -> Column:
    return F.struct(done.alias("done"), now.alias("now"))


def _closed(a: Column) -> Column:
    return F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])


def _hard(text: Column, most: Column) -> Column:
    """Pieces of ``most`` characters, cut at the last space of each if that lies in its second half."""

    def step(a, _):
        back = F.locate(" ", F.reverse(F.substring(a["now"], F.lit(1), most)))
        at = F.when((back > 0) & (most - back >= F.floor(most / 2)), most - back).otherwise(most)
        piece = F.regexp_replace(F.substring(a["now"], F.lit(1), at), r"\s+$", "")
        rest = F.regexp_replace(F.substring(a["now"], at + 1, F.length(a["now"])), r"^\s+", "")
        return F.when(F.length(a["now"]) > most, _state(F.concat(a["done"], F.array(piece)), rest)).otherwise(a)

    turns = F.sequence(F.lit(0), F.floor(2 * F.length(text) / most).cast("int") + 1)
    return F.aggregate(turns, _state(F.array().cast("array<string>"), text), step, _closed)


def _sentences(text: Column, most: Column, least: int) -> Column:
    """Sentences packed up to ``most`` characters; a longer one is cut hard, a short rest joins the piece before."""

    def step(a, s):
        longer = F.when(a["now"] == "", s).otherwise(F.concat(a["now"], F.lit(" "), s))
        cut = F.when(F.length(s) > most, _state(F.concat(_closed(a), _hard(s, most)), F.lit(""))).otherwise(_state(_closed(a), s))
        return F.when(F.length(longer) <= most, _state(a["done"], longer)).otherwise(cut)

    def end(a):
        short = (F.size(a["done"]) > 0) & (F.length(a["now"]) < least) & (a["now"] != "")
        return F.when(short, _joined(a["done"], a["now"], " ")).otherwise(_closed(a))

    return F.aggregate(_whole(text, r"(?<=[.!?])\s+"), _state(F.array().cast("array<string>"), F.lit("")), step, end)


def pieces(text: Column, most: Column, least: int = 200) -> Column:
    """The pieces of a trimmed text: paragraphs between blank lines packed up to ``most`` characters; short ones join the
    piece before; pieces that are too long then are split at the ends of sentences, or else cut."""

    def pack(a, p):
        longer = F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit("\n\n"), p))
        return F.when(F.length(longer) <= most, _state(a["done"], longer)).otherwise(_state(_closed(a), p))

    def merge(done, p):
        return F.when((F.size(done) > 0) & (F.length(p) < least), _joined(done, p, "\n\n")).otherwise(F.concat(done, F.array(p)))

    packed = F.aggregate(_whole(text, r"\n\n+"), _state(F.array().cast("array<string>"), F.lit("")), pack, _closed)
    merged = F.aggregate(packed, F.array().cast("array<string>"), merge)
    split = F.flatten(F.transform(merged, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(_sentences(p, most, least))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= most, F.array(text)).otherwise(split)


def located(text: Column, parts: Column) -> Column:
    """(p, start) of each piece: where its first 50 characters are found, looking on from the place after the last find."""
    kind = "array<struct<p: string, start: int>>"

    def step(a, p):
        found = F.position(F.substring(p, 1, 50), text, a["from"] + 1) - 1
        start = F.when(found < 0, a["from"]).otherwise(found)
        return F.struct(F.concat(a["out"], F.array(F.struct(p.alias("p"), start.cast("int").alias("start")))).alias("out"), F.greatest(start + 1, a["from"]).cast("int").alias("from"))

    return F.aggregate(parts, F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("from")), step, lambda a: a["out"])


def label_position(index: Column, total: Column) -> Column:
    """W5."""
    return F.when(total == 1, "only").when(index == 0, "first").when(index == total - 1, "last").otherwise("middle")


def chunk(rows: DataFrame, threshold: int = 3000, most: int = 2500, least: int = 200, overlap: int = 200, prefix: Column | None = None, whole: Column | None = None, before: Column | None = None, done: DataFrame | None = None) -> DataFrame:
    """(id, chunk_index, chunk_total, position, char_start, char_end, chunk_text) of rows (id, content).

    A text up to the threshold is one chunk: ``whole`` if given, else its prefix and content. Of a longer one each
    piece has the prefix, which the room for it shrinks by, and the overlap: the end of the piece before, from its first
    space on. Places are those of the piece in the trimmed content, moved on by ``before``. Blank texts have no chunk.
    ``done`` lists ids that have their chunks already.
    """
    if done is not None:
        rows = rows.join(done.select("id").distinct().hint("merge"), "id", "left_anti")
    head = F.lit("") if prefix is None else prefix
    full = F.concat(head, F.col("content")) if whole is None else whole
    measured = F.length("content") if whole is None else F.length(full)
    own = rows.filter(F.col("content").rlike(r"\S")).select("id", "content", head.alias("_head"), full.alias("_full"), measured.alias("_size"), (F.lit(0) if before is None else before).alias("_before"))
    room = F.when(F.length("_head") > 0, F.greatest(most - F.length("_head"), F.lit(2 * least))).otherwise(F.lit(most)).cast("int")
    split = let(F.struct(stripped(F.col("content")).alias("t"), room.alias("m")), lambda x: located(x["t"], pieces(x["t"], x["m"], least)))
    found = F.when(F.col("_size") > threshold, split).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).alias("start"))))

    def tail(p: Column) -> Column:
        end = F.when(F.length(p) > overlap, F.substring(p, -overlap, overlap)).otherwise(p)
        return let(end, lambda e: F.when(F.locate(" ", e) > 1, F.substring(e, F.locate(" ", e) + 1, F.length(e))).otherwise(e))

    def texts(z: Column) -> Column:
        lead = lambda i: let(tail(F.get(z, i - 1)["p"]), lambda o: F.when(o == "", "").otherwise(F.concat(o, F.lit(" "))))
        return F.transform(z, lambda x, i: F.struct(x["start"].alias("start"), x["p"].alias("p"), (F.when(i > 0, lead(i)).otherwise("") if overlap else F.lit("")).alias("lead"), F.size(z).alias("n")))

    out = own.select("id", "_head", "_full", "_size", "_before", F.posexplode(let(found, texts)).alias("chunk_index", "z"))
    one = F.col("z.p").isNull()
    start = F.when(one, 0).otherwise(F.col("_before") + F.col("z.start"))
    end = F.when(one, F.col("_size")).otherwise(F.col("_before") + F.col("z.start") + F.length("z.p"))
    text = F.when(one, F.col("_full")).otherwise(F.concat("_head", "z.lead", "z.p"))
    label = label_position(F.col("chunk_index"), F.col("z.n"))
    return out.select("id", "chunk_index", F.col("z.n").alias("chunk_total"), label.alias("position"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), text.alias("chunk_text"))


def chunk_messages(messages: DataFrame, threshold: int = 3000, most: int = 2500, least: int = 200, overlap: int = 200) -> DataFrame:
    """A message up to the threshold whole, as question and answer; of others the response in chunks, each after the
    first 150 characters of the prompt. Places are those in question and answer."""
    asked = stripped(F.substring("user_prompt", 1, 150))
    short = F.concat(F.lit("Q: "), asked, F.when(F.length("user_prompt") > 150, "...").otherwise(""), F.lit("\nA: "))
    whole = F.concat(F.lit("Q: "), F.col("user_prompt"), F.lit("\nA: "), F.col("model_response"))
    rows = messages.select(F.col("message_id").alias("id"), F.when(F.length(whole) > threshold, F.col("model_response")).otherwise(whole).alias("content"), F.when(F.length("user_prompt") > 0, short).otherwise("").alias("short"), whole.alias("whole"), (F.length("user_prompt") + 7).alias("before"))
    return chunk(rows, threshold, most, least, overlap, F.col("short"), F.col("whole"), F.col("before"))


def chunk_documents(docs: DataFrame, **options) -> DataFrame:
    """D3: documents (id, title, content), each chunk after the document's title."""
    return chunk(docs, prefix=F.when(F.length("title") > 0, F.concat("title", F.lit("\n"))).otherwise(""), **options)


def fetch(chunks: DataFrame, preview: int = 200) -> DataFrame:
    """D8."""
    return chunks.select("id", "chunk_index", F.substring("chunk_text", 1, preview).alias("preview"))


def coverage_totals(chunks: DataFrame) -> DataFrame:
    """A2: chunks, records, chunks per record."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("id").alias("records"), F.round(F.count("*") / F.greatest(F.countDistinct("id"), F.lit(1)), 2).alias("per_record"))
