"""Hand-computed cases for operators that SQL does not check."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import chunks, entities as E, graph as G, ingest as N, intent as I, retrieve as R
from colloquy.sources import files
from colloquy.streaming import feeds


def one(spark, col, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values))
    return rows.select(col.alias("x")).first().x


def test_point_id(spark):
    ns = uuid.NAMESPACE_DNS.hex
    got = one(spark, T.point_id(F.col("r"), F.col("i"), F.col("n"), ns), r="abc", i=7, n=3)
    assert got == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc_c007"))
    assert one(spark, T.point_id(F.col("r"), F.col("i"), F.col("n")), r="abc", i=0, n=1) == "abc"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("<think>a</think>b", ("a", "b")),
        ("a\nc</think>\n b", ("a\nc", "b")),
        ("<reasoning>x</reasoning> y <think>z</think>", ("z\n\nx", "y")),
        ("<think>a</think>b</think> c", ("a\n\nb", "c")),
        ("<think>a</reasoning>b</think>c", ("a</reasoning>b", "c")),
        ("x <think> y </think> z <think> open </think>", ("y\n\nopen", "x  z")),
        ("</think>only", ("", "only")),
        ("<think>a</think><think>open</reasoning>", ("a", "<think>open</reasoning>")),
        ("plain", ("", "plain")),
        ("", ("", "")),
    ],
)
def test_reasoning(spark, raw, want):
    a, b = T.split_reasoning(F.col("t"))
    assert one(spark, F.array(a, b), t=raw) == list(want)


def test_report_format(spark):
    raw = "# Title\ntext\n---\n```\n# code\n```\n\n\n\n**Bold**\nend"
    assert one(spark, T.strip_report_format(F.col("t")), t=raw) == "Title\ntext\n\n```\n# code\n```\n\nBold\nend"
    assert one(spark, T.strip_report_format(F.col("t")), t="a\n-_-\n*****\n**Note:** x\n**Note:**\nb") == "a\n\n**Note:** x\nNote:\nb"
    assert one(spark, T.strip_report_format(F.col("t"), "Ada"), t="text\n— Ada\n--  Ada \n- Adam") == "text\n\n- Adam"
    assert one(spark, T.strip_report_format(F.col("t")), t="x ```# a\n---``` y\n```open\n# h") == "x ```# a\n---``` y\n```open\nh"


def test_terms_and_candidates(spark):
    assert one(spark, T.fts_terms(F.col("t")), t="What is R 42, of 123456?") == ["42", "0042", "00042", "123456"]
    assert one(spark, T.entity_candidates(F.col("t")), t='saw Ada Lovelace and "the engine" near R12') == ["Ada Lovelace", "the engine", "R12", "Ada", "Lovelace"]
    assert one(spark, T.entity_candidates(F.col("t")), t="nothing capital anywhere here") == ["anywhere", "nothing", "capital"]
    assert one(spark, T.entity_candidates(F.col("t")), t="The C-Theory and 'old grid' of dream-LOOP in R7, not R7777. Next Ünal saw the Mill-race.") == ["The C-Theory", "old grid", "C-Theory", "dream-LOOP", "R7", "R7777", "Ünal", "Mill-race"]
    assert one(spark, T.entity_candidates(F.col("t")), t="we saw Then and the") == ["saw"]
    assert one(spark, T.entity_candidates(F.col("t")), t="") == []


def plain_pieces(text, most, least):
    """The rule of chunking, in plain Python."""

    def packed(units, between, most):
        out, now = [], ""
        for u in units:
            if len(now + between + u if now else u) <= most:
                now = now + between + u if now else u
            else:
                out += [now] if now else []
                now = u
        return out, now

    def sentences(p):
        out, now = [], ""
        for s in (s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()):
            if len(now + " " + s if now else s) <= most:
                now = now + " " + s if now else s
                continue
            out, now = [*out, now] if now else out, s
            if len(s) > most:
                while len(now) > most:
                    at = now.rfind(" ", 0, most)
                    at = at if at >= most // 2 else most
                    out.append(now[:at].rstrip())
                    now = now[at:].lstrip()
                out, now = [*out, now] if now else out, ""
        if now and out and len(now) < least:
            return [*out[:-1], out[-1] + " " + now]
        return [*out, now] if now else out

    if len(text) <= most:
        return [text] if text else []
    out, now = packed([p.strip() for p in re.split(r"\n\n+", text) if p.strip()], "\n\n", most)
    merged = []
    for p in [*out, now] if now else out:
        if merged and len(p) < least:
            merged[-1] += "\n\n" + p
        else:
            merged.append(p)
    return [x for p in merged for x in ([p] if len(p) <= most else sentences(p))]


def plain_chunks(text, threshold, most, least, overlap, head="", before=0, whole=None):
    if not text.strip():
        return []
    if len(text if whole is None else whole) <= threshold:
        full = head + text if whole is None else whole
        return [(0, len(text) if whole is None else len(whole), full)]
    text, out, at = text.strip(), [], 0
    parts = plain_pieces(text, max(most - len(head), 2 * least) if head else most, least)
    for i, p in enumerate(parts):
        start = text.find(p[:50], at)
        start = at if start < 0 else start
        at = max(start + 1, at)
        lead = ""
        if i:
            lead = parts[i - 1][-overlap:]
            lead = lead[lead.find(" ") + 1 :] if lead.find(" ") > 0 else lead
            lead = lead + " " if lead else ""
        out.append((before + start, before + start + len(p), head + lead + p))
    return out


LONG = [
    "", " \n ", "short", "One. " * 300, "word" * 900, "a b\n\n" * 500, "Ünï çödé! " * 200, "x" * 399 + " " + "y" * 800, " lead. " + "z " * 300 + "\n\n\n" + "Tail here? " * 60 + "\n\nend.",
    "\n\n".join(f"Paragraph {k} says {'more ' * (k * 7 % 40)}now." for k in range(40)), "no end " * 90 + "\n\n" + "tiny\n\n" + "q" * 395 + ".\n\n" + "w" * 30,
]


def test_chunks_by_plain_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LONG)], "id int, content string")
    got = {}
    for r in chunks.chunk(rows, 500, 400, 50, 40).orderBy("id", "chunk_index").collect():
        own = got.setdefault(r.id, [])
        assert r.chunk_index == len(own)
        own.append((r.char_start, r.char_end, r.chunk_text))
        assert r.position == ("only" if r.chunk_total == 1 else "first" if r.chunk_index == 0 else "last" if r.chunk_index == r.chunk_total - 1 else "middle")
    assert got == {i: w for i, t in enumerate(LONG) if (w := plain_chunks(t, 500, 400, 50, 40))}


def test_chunks_of_messages_and_documents(spark):
    asked = ["why", "Tell me " * 40, ""]
    messages = spark.createDataFrame([(i * 10 + k, q, t) for i, t in enumerate(LONG) for k, q in enumerate(asked)], "message_id int, user_prompt string, model_response string")
    got, want = {}, {}
    for r in chunks.chunk_messages(messages, 500, 400, 50, 40).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end, r.chunk_text))
    for i, t in enumerate(LONG):
        for k, q in enumerate(asked):
            whole, head = f"Q: {q}\nA: {t}", f"Q: {q[:150].strip()}{'...' if len(q) > 150 else ''}\nA: " if q else ""
            own = [(0, len(whole), whole)] if len(whole) <= 500 else plain_chunks(t, -1, 400, 50, 40, head, len(q) + 7)
            want |= {i * 10 + k: own} if own else {}
    assert got == want
    docs = spark.createDataFrame([(i, "Title" if i % 2 else "", t) for i, t in enumerate(LONG)], "id int, title string, content string")
    got = {}
    for r in chunks.chunk_documents(docs, threshold=500, most=400, least=50, overlap=40).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end, r.chunk_text))
    assert got == {i: w for i, t in enumerate(LONG) if (w := plain_chunks(t, 500, 400, 50, 40, "Title\n" if i % 2 else ""))}
    assert chunks.coverage_totals(chunks.chunk(docs.select("id", "content"), 500, 400, 50, 40)).first().records == len(got)
    assert chunks.fetch(chunks.chunk(docs.select("id", "content")), 3).filter("id = 2").first().preview == "sho"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "a int, b int, weight int")


@pytest.mark.parametrize(
    "pairs,want",
    [
        ([(1, 2), (2, 3), (3, 4)], {1: 0, 2: 2, 3: 2, 4: 0}),
        ([(1, 2), (1, 3), (1, 4), (1, 5)], {1: 6, 2: 0, 3: 0, 4: 0, 5: 0}),
        ([(1, 2), (2, 3), (3, 4), (4, 1)], {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5}),
        ([(1, 2)], {1: 0, 2: 0}),
    ],
)
def test_betweenness(spark, pairs, want):
    assert {r.id: r.betweenness for r in G.betweenness(edges(spark, *pairs)).collect()} == pytest.approx(want)


def test_crowded_pairs_are_whole(spark):
    rows = spark.createDataFrame([("g", i) for i in range(40)] + [("h", 1), ("h", 2)], "g string, i int")
    pairs, crowded = G.pairs_within(rows, "g", "i", crowd=7)
    assert pairs.count() == 40 * 39 // 2 + 1 and [r.g for r in crowded.collect()] == ["g"]


def test_greedy_clusters(spark):
    hits = spark.createDataFrame([(s, s, p, p, 0.9) for s, ps in {1: [10, 11], 2: [11, 12], 3: [12, 13], 4: [14, 15]}.items() for p in ps], "qid int, seed_conversation int, point_id int, conversation_id int, score double")
    quality = spark.createDataFrame([(i, 1.0 - i / 100) for i in range(20)], "point_id int, quality double")
    assert sorted(r.seed for r in G.clusters(hits, quality).collect()) == [1, 3, 4]


def test_entities(spark):
    chain = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "duplicate_id int, canonical_id int")
    assert {r.duplicate_id: r.canonical_id for r in E.canonical_map(chain).collect()} == {2: 1, 3: 1, 4: 1, 9: 8}
    names = spark.createDataFrame([(1, "Al"), (2, "Bo")], "id int, name string")
    pairs = spark.createDataFrame([("al", "Alan"), ("bo", "Bo")], "alias string, name string")
    got, missing = E.aliases(names, pairs)
    assert got.count() == 2 and [r.name for r in missing.collect()] == ["Alan"]


def test_salience_fold(spark):
    got = one(spark, R.salience_fold(F.lit(0.5), F.col("u")), u=[0.5, 0.05, 0.2, 1.0])
    assert got == pytest.approx(0.5 + 0.015 - 0.01 + 0.03)


def messages(spark):
    said = ["hello", "hello there", "hello", "plan the roadmap with me now", "what do you mean by that phrase", "hello", "i feel tired today my friend", "i feel worried about it all"]
    return spark.createDataFrame([(c, k + 1, t) for c in (1, 2) for k, t in enumerate(said[c - 1 :])], "conversation_id long, sequence int, user_prompt string")


def batch_states(spark):
    rows = I.hypotheses(messages(spark)).collect()
    return sorted((r.conversation_id, r.sequence, r.name, round(r.confidence, 9), r.seen, r.first, r.last) for r in rows)


def test_hypotheses_follow_the_rule(spark):
    want = []
    seen = {}
    for m in sorted(I.observed(messages(spark)).collect(), key=lambda r: (r.conversation_id, r.sequence)):
        seen[m.conversation_id] = I.advance(seen.get(m.conversation_id, {}), m.name, m.confidence, m.sequence)
        want += [(m.conversation_id, m.sequence, n, round(v[0], 9), *v[1:]) for n, v in seen[m.conversation_id].items()]
    assert batch_states(spark) == sorted(want)


def test_stream_of_hypotheses_equals_batch(spark, tmp_path):
    messages(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conversation_id long, sequence int, user_prompt string").parquet(str(tmp_path / "in"))
    query = feeds.stream_hypotheses(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("states").collect()
    assert sorted((r.conversation_id, r.sequence, r.name, round(r.confidence, 9), r.seen, r["first"], r["last"]) for r in rows) == batch_states(spark)


def test_cdc_stream_equals_batch(spark, tmp_path):
    rows = [(i, ["INSERT", "UPDATE", "DELETE"][i % 3], "t", i % 7, f"p{i}") for i in range(40)]
    feed = spark.createDataFrame(rows, "id long, operation string, entity_type string, entity_id long, payload string")
    for k in range(3):
        feed.filter(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
        feeds.apply_cdc(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = feeds.snapshot(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feeds.live(feeds.merged(None, feed)).select(*got.columns).collect()))


def test_readers(spark, tmp_path):
    claude = [{"uuid": "u", "name": "n", "created_at": "t", "chat_messages": [{"sender": "human", "text": "hi", "content": []}, {"sender": "assistant", "text": "", "content": [{"type": "thinking", "thinking": "mm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "t"}]}]}]
    (tmp_path / "c.json").write_text(json.dumps(claude))
    rows = files.read_claude_export(spark, str(tmp_path / "c.json")).orderBy("turn").collect()
    assert [(r.role, r.text, r.thinking, r.tools) for r in rows] == [("user", "hi", "", ""), ("assistant", "a\nb", "mm", "t")]
    google = {"runSettings": {"model": "m"}, "systemInstruction": {"parts": [{"text": "be"}, {"text": "kind"}]}, "chunkedPrompt": {"chunks": [{"role": "user", "text": "q"}, {"role": "model", "isThought": True, "text": "x", "parts": [{"text": "y"}]}]}}
    (tmp_path / "g.json").write_text(json.dumps(google))
    rows = files.read_google_export(spark, str(tmp_path / "g.json")).orderBy("turn").collect()
    assert [(r.title, r.system, r.role, r.thought, r.text) for r in rows] == [("g", "be kind", "user", False, "q"), ("g", "be kind", "assistant", True, "y")]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/my_note.md").write_text("# Head\nbody text")
    (tmp_path / "texts/other-note.txt").write_text("plain words here")
    (tmp_path / "texts/empty.md").write_text("  ")
    got = files.read_texts(spark, str(tmp_path / "texts"))
    assert sorted((r.title, r.word_count) for r in got.collect()) == [("Head", 4), ("other note", 3)]
    quest = {"anchor": {"parent_node_label": "L"}, "topology_plan": {"nodes_to_create": [{"label": "a", "properties": {"name": "N", "content": "C"}}], "relationships_to_create": []}}
    (tmp_path / "q.json").write_text(json.dumps(quest))
    r = files.read_quest(spark, str(tmp_path / "q.json")).first()
    assert (r.title, r.content, r.n_nodes, r.n_relationships) == ("L", "N: C", 1, 0)
    inv = {r.directory.rpartition("/")[2]: r.files for r in files.inventory(spark, str(tmp_path), ("md", "txt")).collect()}
    assert inv["texts"] == 3


def test_export_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent_id string")
    files.export_platform({"items": items}, str(tmp_path / "e"))
    back = files.import_platform(spark, str(tmp_path / "e"), {"items": "id string, parent_id string"})["items"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, items.collect()), key=str)
    with pytest.raises(ValueError):
        files.import_platform(spark, str(tmp_path / "e"), {}, version="9")
    assert N.insert_or_ignore(items.filter("id = 'a'"), back).collect() == [("b", "a")]
