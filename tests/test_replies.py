"""Replies of models: shapes, checks, clamps and cuts, by hand."""

import json

import pytest

from colloquy.operators import replies as P


def table(spark, rows):
    return spark.createDataFrame([(i, k, r if r is None or isinstance(r, str) else json.dumps(r)) for i, k, r in rows], "id long, kind string, raw string")


def test_scores(spark):
    fine = {"salience_score": 0.12345, "quality_score": "0.5", "quality_reasoning": "r" * 600, "topics": list("abcdefg"), "emotional_register": None}
    rows = [(1, "eval", "```json\n" + json.dumps(fine) + "\n```"), (2, "eval", {"salience_score": 1.5, "quality_score": 0.5}), (3, "eval", "no json"), (4, "eval", None), (5, "eval", {"quality_score": 0.5}), (6, "eval", [1]), (7, "eval", ""), (8, "other", fine), (9, "eval", {"salience_score": 0, "quality_score": 1})]
    good, bad = P.validated(table(spark, rows), "eval")
    got = {r.id: r for r in good.collect()}
    assert set(got) == {1, 9} and sorted(r.id for r in bad.collect()) == [2, 3, 4, 5, 6, 7]
    assert (got[1].salience_score, got[1].quality_score, len(got[1].rationale), got[1].topics, got[1].emotional_register, got[1].salience_reasoning) == (0.123, 0.5, 500, list("abcde"), "", "")
    assert got[9].topics == []


def test_registers_and_syntheses(spark):
    rows = [(1, "register", {"register_label": "warm", "register_score": 0.98765, "authentic_phrases": list("abcd"), "topics": "x"}), (2, "register", {"register_label": "cold", "register_score": 0.5}), (3, "register", {"register_label": "warm"})]
    good, bad = P.validated(table(spark, rows), "register")
    (one,) = good.collect()
    assert (one.id, one.register_score, one.authentic_phrases, one.performed_phrases) == (1, 0.988, list("abc"), []) and {r.id for r in bad.collect()} == {2, 3}
    rows = [(1, "synthesis", {"insight_title": "t" * 300, "insight_text": "x", "confidence": 7, "themes": list("abcdefghijkl")}), (2, "synthesis", {"insight_title": "", "insight_text": "x"}), (3, "synthesis", {"insight_title": "a", "insight_text": "b"}), (4, "synthesis", {"insight_title": "a", "insight_text": "b", "confidence": -1})]
    good, bad = P.validated(table(spark, rows), "synthesis")
    got = {r.id: (len(r.insight_title), r.confidence, len(r.themes)) for r in good.collect()}
    assert got == {1: (200, 1.0, 10), 3: (1, 0.5, 0), 4: (1, 0.0, 0)} and [r.id for r in bad.collect()] == [2]


def test_turns(spark):
    rows = [(1, "turn", 'So: {"naturalness_score": 2, "attunement_score": 0.5, "tool_awareness_score": "x", "drift_flags": ["report_mode", "nope"], "corrective_directive": "d"} done'), (2, "turn", {}), (3, "turn", "none at all"), (4, "turn", {"drift_flags": "report_mode", "attunement_score": -3})]
    good, bad = P.validated(table(spark, rows), "turn")
    got = {r.id: (r.naturalness_score, r.attunement_score, r.tool_awareness_score, r.overall_score, r.drift_flags) for r in good.collect()}
    assert got[1][:3] == (1.0, 0.5, 0.0) and got[1][3] == pytest.approx(0.57, abs=0.011) and got[1][4] == ["report_mode"]
    assert got[2] == (0.0, 0.0, 0.0, 0.0, []) == got[4] and [r.id for r in bad.collect()] == [3]


def test_entities(spark):
    some = [{"entity_type": "person", "name": " Ada ", "relevance": 9, "description": "d" * 2000, "context_snippet": "s" * 300}, {"entity_type": "planet", "name": "Mars"}, {"entity_type": "concept", "name": ""}, "text", {"entity_type": "concept", "name": "n" * 200}, None]
    rows = [(1, "entity", {"entities": some}), (2, "entity", {"entities": "x"}), (3, "entity", {}), (4, "entity", {"entities": []}), (5, "entity", "{")]
    good, bad = P.entities(table(spark, rows))
    got = {(r.id, r.place): (r.name, r.relevance, len(r.description), len(r.context_snippet)) for r in good.collect()}
    assert got == {(1, 0): ("Ada", 1.0, 1000, 200), (1, 4): ("n" * 100, 0.5, 0, 0)} and {r.id for r in bad.collect()} == {2, 3, 5}
