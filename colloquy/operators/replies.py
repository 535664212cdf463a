"""Model replies as typed rows: JSON parsed as variants, checked, clamped and cut; what does not fit is kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import stripped

#: The types of entities, labels of registers, scores of a turn with their weights, and flags of drift.
TYPES = ["concept", "decision", "milestone", "person", "reference", "emotional_state", "attribute", "preference"]
REGISTERS = ["warm", "neutral", "clinical"]
TURN_SCORES = {"naturalness_score": 0.4, "attunement_score": 0.35, "tool_awareness_score": 0.25}
DRIFT_FLAGS = ["report_mode", "missed_tool_opportunity", "tone_mismatch", "over_structured", "under_engaged", "clinical_register"]


def unfenced(raw: Column) -> Column:
    """The text within a code fence that opens it, up to a last line that closes it; other texts trimmed."""
    text = stripped(raw)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(?:^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(text.startswith("```"), inner).otherwise(text)


def parsed(raw: Column, anywhere: bool = False) -> Column:
    """The reply's JSON object as a variant, null if it is none; with ``anywhere`` also from its first brace to its last one."""
    body = unfenced(raw)
    whole = F.try_parse_json(body)
    if anywhere:
        whole = F.coalesce(whole, F.try_parse_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1)))
    return F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole)


def number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def words(v: Column, path: str, most: int | None = None) -> Column:
    """A string, or what stands there in its place as text; empty where there is nothing. Cut to ``most`` characters."""
    text = F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    return text if most is None else F.substring(text, 1, most)


def strings(v: Column, path: str, most: int | None = None) -> Column:
    found = F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
    return found if most is None else F.slice(found, 1, most)


def clamped(x: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(default))))


def _within(x: Column) -> Column:
    return F.coalesce(x.between(0.0, 1.0), F.lit(False))


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(id, raw, value), the value worked out once for each row: a filter on it is not rewritten with all that it is made of."""
    return rows.select("id", "raw", F.explode(F.array(value)).alias(name))


def _eval(v: Column) -> tuple[Column, dict[str, Column]]:
    s, q = number(v, "$.salience_score"), number(v, "$.quality_score")
    return _within(s) & _within(q), {"salience_score": F.round(s, 3), "salience_reasoning": words(v, "$.salience_reasoning", 500), "quality_score": F.round(q, 3), "rationale": words(v, "$.quality_reasoning", 500), "topics": strings(v, "$.topics", 5), "emotional_register": words(v, "$.emotional_register")}


def _register(v: Column) -> tuple[Column, dict[str, Column]]:
    label, score = words(v, "$.register_label"), number(v, "$.register_score")
    lists = {c: strings(v, f"$.{c}", 3) for c in ("authentic_phrases", "performed_phrases", "topics")}
    return label.isin(REGISTERS) & _within(score), {"register_label": label, "register_score": F.round(score, 3), **lists, "rationale": words(v, "$.rationale", 500)}


def _synthesis(v: Column) -> tuple[Column, dict[str, Column]]:
    title, text = words(v, "$.insight_title"), words(v, "$.insight_text")
    return (title != "") & (text != ""), {"insight_title": F.substring(title, 1, 200), "insight_text": text, "themes": strings(v, "$.themes", 10), "connections": strings(v, "$.connections", 20), "confidence": clamped(number(v, "$.confidence"), 0.5)}


def _turn(v: Column) -> tuple[Column, dict[str, Column]]:
    scores = {c: F.round(clamped(number(v, f"$.{c}"), 0.0), 2) for c in TURN_SCORES}
    overall = sum((scores[c] * w for c, w in TURN_SCORES.items()), F.lit(0.0))
    flags = F.filter(strings(v, "$.drift_flags"), lambda f: f.isin(DRIFT_FLAGS))
    return F.lit(True), {**scores, "overall_score": F.round(overall, 2), "corrective_directive": words(v, "$.corrective_directive", 500), "drift_flags": flags}


SHAPES = {"eval": _eval, "register": _register, "synthesis": _synthesis, "turn": _turn}


def validated(replies: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """the replies (id, kind, raw) of one kind as typed rows, and those set apart (id, raw).

    eval and register need their scores between 0 and 1 and a known label; synthesis a title and a text; a turn's scores are clamped,
    missing ones 0, and weighted. Texts and lists are cut to their lengths. A reply that is null or no JSON object, and one
    that misses what it needs, is set apart.
    """
    v = F.col("_v")
    fits, columns = SHAPES[kind](v)
    rows = _once(replies.filter(F.col("kind") == kind), parsed(F.col("raw"), kind == "turn"), "_v")
    rows = _once(rows, F.struct(F.coalesce(v.isNotNull() & fits, F.lit(False)).alias("good"), *(c.alias(n) for n, c in columns.items())), "_r")
    return rows.filter("_r.good").select("id", *(f"_r.{n}" for n in columns)), rows.filter("not _r.good").select("id", "raw")


def entities(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a row (id, place, entity_type, name, description, relevance, context_snippet, attributes) for each valid entity of the
    replies of kind ``entity``, and the replies set apart, which are no JSON object with a list of entities.

    Entities of other types and those without a name are passed over; relevance is clamped, 0.5 where missing.
    """
    rows = _once(replies.filter("kind = 'entity'"), F.try_variant_get(parsed(F.col("raw")), "$.entities", "array<variant>"), "_e")
    each = rows.filter("_e is not null").select("id", F.posexplode("_e").alias("place", "_v"))
    v, name = F.col("_v"), stripped(words(F.col("_v"), "$.name"))
    good = each.filter(words(v, "$.entity_type").isin(TYPES) & (name != ""))
    out = good.select("id", "place", words(v, "$.entity_type").alias("entity_type"), F.substring(name, 1, 100).alias("name"), words(v, "$.description", 1000).alias("description"), clamped(number(v, "$.relevance"), 0.5).alias("relevance"), words(v, "$.context_snippet", 200).alias("context_snippet"), F.coalesce(words(v, "$.attributes"), F.lit("{}")).alias("attributes"))
    return out, rows.filter("_e is null").select("id", "raw")
