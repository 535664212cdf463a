"""Rules of scores, intents, times and statuses against hand-computed cases and plain Python."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import ingest as N, intent as I, quality as Q


def column(spark, values, c, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", c(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("  ", ("acknowledgment", 0.9, "none", False)),
        ("/status now", ("command", 1.0, "none", False)),
        ("Hey, I'm feeling low", ("emotional", 0.8, "none", True)),
        (" Good  morning!! ", ("greeting", 0.95, "none", False)),
        ("hello there", ("acknowledgment", 0.4, "none", False)),
        ("got it.", ("acknowledgment", 0.9, "none", False)),
        ("Talk tomorrow", ("farewell", 0.9, "none", False)),
        ("Tell me more?", ("continuation", 0.85, "light", False)),
        ("What do you mean by that", ("clarification", 0.8, "light", False)),
        ("So how is the system today", ("meta", 0.8, "light", True)),
        ("find the roadmap", ("planning", 0.75, "full", True)),
        ("remind me about the trip", ("knowledge", 0.75, "full", True)),
        ("please write a poem", ("creative", 0.7, "full", True)),
        ("the weather in Ghent is mild", ("knowledge", 0.5, "full", True)),
        ("blue", ("acknowledgment", 0.4, "none", False)),
    ],
)
def test_route(spark, text, want):
    assert tuple(column(spark, [text], T.route)[0]) == want


def test_greeting_is_surer_at_first(spark):
    rows = spark.createDataFrame([(1, "hi"), (2, "hi")], "turn int, t string").select(T.route(F.col("t"), F.col("turn"))["confidence"].alias("c")).collect()
    assert [r.c for r in rows] == [0.95, 0.8]


def test_words_for_times_types_and_statuses(spark):
    past = ["back when we met", "In March 2020", "two years ago", "last fall", "our first chat", "in 1999", "tomorrow", "at last"]
    assert column(spark, past, T.is_historical) == [True] * 6 + [False] * 2
    titles = ["Chapter 2", "20240101 notes", "my log", "A survey", "Abstract of a study", "the ritual", "Sprint 4", "README", "book club", "soup"]
    assert column(spark, titles, T.doc_type) == ["chapter", "conversation", "journal", "research", "essay", "creative", "project_doc", "documentation", "session_notes", "general"]
    one = spark.createDataFrame([("Thoughts", "/x/Claude_Journal/a.md"), ("Thoughts", "/x/minutes_3.md")], "t string, p string")
    assert [r.d for r in one.select(T.doc_type(F.col("t"), F.col("p")).alias("d")).collect()] == ["entry", "session_notes"]
    phrases = ["move it to Done", "mark as in-progress", "it is not started", "set to review", "is started", "is shipped", "done", "as complete"]
    assert column(spark, phrases, T.status_enum) == ["completed", "in_progress", "not_started", "review", "in_progress", "shipped", None, "completed"]
    ago = [dt.datetime(2024, 2, 15, 0) - dt.timedelta(hours=h) for h in (-30, 5, 30, 100, 24 * 10, 24 * 61, 24 * 800)]
    assert column(spark, ago, lambda c: T.relative_time(c, "2024-02-15 00:00:00"), "timestamp") == ["", "today", "yesterday", "4 days ago", "1 week ago", "2 months ago", "2 years ago"]
    hours = [dt.datetime(2024, 12, 1, h) for h in (4, 5, 8, 12, 17, 21)]
    assert column(spark, hours, T.time_of_day, "timestamp") == ["night", "early morning", "morning", "afternoon", "evening", "night"]
    assert column(spark, hours, T.greeting, "timestamp") == ["Good evening", "Good morning", "Good morning", "Good afternoon", "Good evening", "Good evening"]
    assert column(spark, hours[:1], lambda c: T.season(c, -30.0), "timestamp") == ["summer"]
    assert column(spark, hours[:1], lambda c: T.climate(c)[0], "timestamp") == [2]
    assert column(spark, ["\n\t\n", "\n a\r\nb \t"], T.clean_text) == ["", "a\nb"]
    assert N.document_heads(spark.createDataFrame([(1, "\n\t "), (2, "\n## Head\nx y")], "id int, content string")).collect() == [(2, "Head", 4)]


def plain_quality(prompt, response, reasoning):
    if not response:
        return 0.0
    n, m = len(response.split()), len(prompt.split()) if prompt else 1
    score = 0.5 + (0.2 if len(reasoning) > 500 else 0.1 if len(reasoning) > 100 else 0.05 if reasoning else 0)
    score += -0.15 if n < 10 else 0.1 if n > 100 else 0
    score -= 0.1 if m > 20 and n / m < 0.3 else 0
    w = response.lower().split()
    score -= 0.15 if n > 20 and sum(c > 2 for c in Counter(zip(w, w[1:], w[2:], w[3:], strict=False)).values()) > 3 else 0
    score -= 0.1 if sum(p in response.lower() for p in T.BOILERPLATE) >= 2 else 0
    return max(0.0, min(1.0, round(score, 3)))


def test_quality(spark):
    cases = [("a b", "", ""), ("", "short", ""), ("why " * 30, "because it is so", "x" * 200), ("q", "one two three four five " * 10, "y"), ("q", " ".join(f"w{k}" for k in range(150)), "z" * 600)]
    cases += [("q", "Feel free to ask. I hope this helps you with all of it today", ""), ("q", "a b c d e f g h\n" * 2 + "x " * 9, ""), ("q", "\n\t ", "")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, r string, t string")
    got = [r.s for r in rows.select("i", T.quality_score(F.col("p"), F.col("r"), F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [plain_quality(*c) for c in cases]
    assert column(spark, [0.95, 0.9, 0.85, 0.7, 0.5, 0.49], T.salience_floor, "double") == [0.9, 0.9, 0.7, 0.6, 0.3, 0.0]


def test_score_unscored_and_evaluated_salience(spark):
    messages = spark.createDataFrame([(1, "hello world", "alpha alpha beta"), (2, "", ""), (3, "x", "y")], "message_id int, user_prompt string, model_response string")
    meta = spark.createDataFrame([(1, None, None), (2, None, None), (3, 0.5, None)], "message_id int, quality_score double, salience_score double")
    got = {r.message_id: (r.quality_score, r.keywords) for r in Q.score_unscored(messages, meta).collect()}
    assert got == {1: (0.35, ["alpha", "hello", "world", "beta"]), 2: (0.0, [])}
    meta = spark.createDataFrame([(1, 0.95, 0.2), (2, 0.1, None), (3, 0.75, None)], "message_id int, quality_score double, salience_score double")
    points = spark.createDataFrame([(10, 1, 0.5), (11, 2, 0.5), (12, 3, 0.5), (13, 9, 0.4)], "point_id int, message_id int, salience double")
    assert {r.point_id: r.salience for r in Q.propagate_salience(points, meta).collect()} == {10: 0.9, 11: 0.15, 12: 0.6, 13: 0.4}


def test_gates_and_retrospectives(spark):
    rows = [("c", k, "emotional", 0.1 * k + 0.2, k, 1, k) for k in range(1, 6)] + [("c", k, "planning", 0.5, k, 1, k) for k in range(1, 6)] + [("d", 5, "emotional", 0.9, 1, 5, 5)]
    rows += [("e", 2, "meta", 0.2, 1, 1, 2), ("e", 5, "meta", 0.7, 2, 1, 5)]
    states = spark.createDataFrame(rows, "conversation_id string, sequence int, name string, confidence double, seen int, first int, last int")
    got = {(r.conversation_id, r.name, r.finding) for r in I.retrospectives(states).collect()}
    assert got == {("c", "emotional", "sustained"), ("c", "emotional", "escalation"), ("c", "planning", "sustained"), ("e", "meta", "drift")}
    gates = {(r.conversation_id, r.sequence): (r.hold_planning, r.patience) for r in I.gates(states).collect()}
    assert gates["c", 1] == (False, False) and gates["c", 2] == (True, False) and gates["d", 5] == (False, False)
