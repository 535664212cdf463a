"""The kept index against plain Python, and the stemmer against a textbook form of its own."""

import math
import random
import re
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions.stem import porter
from colloquy.functions.text import SEARCH_STOPWORDS
from colloquy.operators import index as X

#: Words and stems as Porter's paper of 1980 prints them, step by step and whole.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit", "replacement": "replac", "adoption": "adopt", "homologou": "homolog", "communism": "commun",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "yes": "ye", "by": "by", "toy": "toi", "syzygy": "syzygi",
}
SUFFIXES = "s es ed ing ational tional enci izer alli ization ation ator alism iveness fulness ousness aliti biliti icate ative alize ical ful ness al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize e ll y eed".split()


def textbook(word):
    """Porter's algorithm by measures counted over letters."""
    if len(word) <= 2:
        return word

    def vowels(w):
        kinds = []
        for i, c in enumerate(w):
            kinds.append(c in "aeiou" or (c == "y" and i > 0 and not kinds[-1]))
        return kinds

    def m(w):
        k = vowels(w)
        return sum(a and not b for a, b in zip(k, k[1:], strict=False))

    def cvc(w):
        k = vowels(w)
        return len(w) > 2 and not k[-3] and k[-2] and not k[-1] and w[-1] not in "wxy"

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and not vowels(w)[-1]

    def by(w, rules, least):
        for s, r in sorted(rules, key=lambda x: -len(x[0])):
            if w.endswith(s):
                rest = w[: len(w) - len(s)]
                return rest + r if m(rest) > least and (s != "ion" or rest[-1:] in ("s", "t")) else w
        return w

    w = word
    w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1] if w.endswith("s") else w
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and any(vowels(w[: -len(s)])):
                w = w[: -len(s)]
                w = w + "e" if w.endswith(("at", "bl", "iz")) else w[:-1] if double(w) and w[-1] not in "lsz" else w + "e" if m(w) == 1 and cvc(w) else w
                break
    if w.endswith("y") and any(vowels(w[:-1])):
        w = w[:-1] + "i"
    two = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
    w = by(w, list(zip(two[::2], two[1::2], strict=True)), 0)
    w = by(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    w = by(w, [(s, "") for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()], 1)
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if m(w) > 1 and w.endswith("ll") else w


def test_stems(spark):
    rng = random.Random(5)
    parts = ["a", "b", "st", "y", "ee", "ll", "iz", "tr", "o", "at", "bl", "z", "ss", "x", "w", "é", "oy"]
    made = {"".join(rng.choices(parts, k=rng.randint(1, 4))) + rng.choice(["", *SUFFIXES]) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(6000)}
    words = sorted(made | set(KNOWN))
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", porter(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in KNOWN} == KNOWN
    assert got == {w: textbook(w) for w in words}


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def ranked(texts, queries, k, stem=textbook):
    """BM25 over all slots, by loops."""
    terms = {d: [stem(w) for w in split(t)] for d, t in texts.items()}
    n, avg = sum(bool(t) for t in terms.values()), sum(map(len, terms.values())) / max(1, sum(bool(t) for t in terms.values()))
    out = set()
    for qid, slots in queries.items():
        found = []
        for d, own in terms.items():
            asked = {stem(w) for s in slots for w in s}
            if all(any(stem(w) in own for w in s) for s in slots):
                score = 0
                for t in asked & set(own):
                    df, tf = sum(t in x for x in terms.values()), own.count(t)
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
                found.append((-round(score, 9), d))
        out |= {(qid, d, place, round(-s, 6)) for place, (s, d) in enumerate(sorted(found)[:k], 1)}
    return out


def test_index_with_updates(spark, tmp_path):
    rng = random.Random(4)
    words = ["running", "runs", "relational", "Relate", "cats", "cat", "the", "7", "0007", "über", "happy", "happiness", "x"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice([".", "", "!"])
    texts = {i: text() for i in range(60)} | {60: None, 61: "", 62: "cats " * 3000}
    table = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    asked = {1: "Runs cat", 2: "relating the happy", 3: "7", 4: "nothing", 5: "cat cats", 6: "the of"}
    queries = X.terms_of(spark.createDataFrame(list(asked.items()), "qid long, text string"), SEARCH_STOPWORDS)
    slots = {1: [["runs"], ["cat"]], 2: [["relating"], ["happy"]], 4: [["nothing"]], 5: [["cat"], ["cats"]]}  # 3: one digit is no term
    seen = lambda index: {(r.qid, r.doc_id, r["rank"], round(r.score, 6)) for r in index.search(queries, 7).collect()}
    index = X.build(table(texts), str(tmp_path / "a"), buckets=4)
    assert seen(index) == ranked(texts, slots, 7) and seen(index)
    for segment in (1, 2):
        changed = {i: text() for i in rng.sample(range(40), 9)} | {70 + segment: text()}
        gone = [40 + segment, 62] if segment == 1 else [70 + segment - 1]
        texts = {k: v for k, v in (texts | changed).items() if k not in gone}
        states = [(k, "changed") for k in changed] + [(k, "deleted") for k in gone] + [(k, "unchanged") for k in texts if k not in changed]
        X.update(index, table(texts), spark.createDataFrame(states, "doc_id long, state string"), segment)
        assert seen(index) == ranked(texts, slots, 7)
    small = index.compact(str(tmp_path / "b"))
    assert seen(small) == seen(index) and small.documents().count() == len(texts)
    phrases = {1: "Runs, cat", 2: "happy", 3: "cat the cats", 4: "", 5: "cat cat"}
    got = {tuple(r) for r in small.phrases(spark.createDataFrame(list(phrases.items()), "qid long, phrase string")).collect()}
    want = set()
    for q, p in phrases.items():
        p = [textbook(w) for w in split(p)]
        want |= {(q, d) for d, t in texts.items() for own in [[textbook(w) for w in split(t)]] if p and any(own[i : i + len(p)] == p for i in range(len(own)))}
    assert got == want
    both = X.everywhere({"a": index, "b": small}, queries, 3).collect()
    assert {(r.collection, r.qid, r.doc_id, r["rank"], r.score) for r in both} == {(c, q, d, k, 0.5) for c in "ab" for q, d, k, _ in ranked(texts, slots, 3)}


def test_numbers_fill_their_slot_in_any_width(spark, tmp_path):
    index = X.build(spark.createDataFrame([(1, "entry 0042"), (2, "entry 42"), (3, "entry 00042 x"), (4, "entry 420")], "doc_id long, text string"), str(tmp_path / "n"), buckets=2)
    queries = X.terms_of(spark.createDataFrame([(1, "the entry 42")], "qid long, text string"), SEARCH_STOPWORDS)
    assert {r.doc_id for r in index.search(queries).collect()} == {1, 2, 3}


def _shuffled(spark, run):
    """Rows that the stages of ``run`` wrote to shuffles."""
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList()
    before = sc._jsc.sc().dagScheduler().nextStageId()
    run()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() >= before)


def test_equal_queries_are_answered_once(spark, tmp_path):
    n = 300
    docs = spark.createDataFrame([(i, "alpha beta gamma alpha beta") for i in range(n)], "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "e"), buckets=2)
    queries = X.terms_of(docs.selectExpr("doc_id as qid", "text"), SEARCH_STOPWORDS)
    got = []
    assert _shuffled(spark, lambda: got.extend(index.search(queries, 3).collect())) < n * n
    assert sorted((r.qid, r.doc_id) for r in got) == [(q, d) for q in range(n) for d in range(3)]
    phrases = docs.selectExpr("doc_id as qid", "'beta gamma' as phrase").filter("qid % 3 = 0")
    assert _shuffled(spark, lambda: got.append(index.phrases(phrases).count())) < n * n // 3
    assert got[-1] == n * n // 3


def test_stems_beyond_those_sent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SENT", 1)
    text = "runs running Runs cat " + "x" * 80 + "s"
    index = X.build(spark.createDataFrame([(1, text), (2, "cat")], "doc_id long, text string"), str(tmp_path / "s"), buckets=2)
    got = {(r.qid, r.doc_id) for r in index.search(spark.createDataFrame([(1, 0, "run"), (2, 0, "cats"), (3, 0, "x" * 80)], "qid long, slot int, word string")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1)}
    assert index.phrases(spark.createDataFrame([(1, "run running"), (2, "running run cats"), (3, "run cat run")], "qid long, phrase string")).count() == 2


def test_documents_that_lack_a_term_do_not_meet_the_query(spark, tmp_path, monkeypatch):
    """400 different queries of two terms, each term in 20 documents and both in one: no 20 candidates for each of them."""
    size, real = [], X.Index.candidates

    def counted(self, held, sizes):
        out = real(self, held, sizes)
        size.append(out.count())
        return out

    monkeypatch.setattr(X.Index, "candidates", counted)
    docs = spark.createDataFrame([(i, f"a{i % 20}x b{i // 20}x 00{10 + i % 7}") for i in range(400)], "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "index"))
    found = index.search(X.terms_of(docs.selectExpr("doc_id AS qid", "text"), [], 2), 10).collect()
    assert sorted((r.qid, r.doc_id, r.rank) for r in found) == [(i, i, 1) for i in range(400)]
    assert size == [size[0]] and 400 <= size[0] <= 800
    numbers = index.search(X.terms_of(spark.createDataFrame([(1, "a3x 13"), (2, "a3x 013"), (3, "a3x zz")], "qid long, text string"), []), None).collect()
    assert {(r.qid, r.doc_id) for r in numbers} == {(q, i) for q in (1, 2) for i in range(400) if i % 20 == 3 and i % 7 == 3}


def test_an_index_is_built_in_one_pass_without_shuffling_postings(spark, tmp_path):
    """Texts are read once, and no (document, word) goes through a shuffle: only the different words do, for their stems."""
    read, n = spark.sparkContext.accumulator(0), 400

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.range(0, n, 1, 4).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 50), x -> concat('w', x)), ' ') AS text").mapInArrow(seen, "doc_id long, text string")
    assert _shuffled(spark, lambda: X.build(docs, str(tmp_path / "once"), buckets=4)) <= 50 * 4 * 4
    assert read.value == n


def test_an_update_shuffles_no_postings(spark, tmp_path):
    """Half of 200 documents changed: only states, ids and different words are shuffled; a search finds the new words alone."""
    docs = spark.range(200).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), x -> concat(if(id % 2 = 0, 'v', 'w'), x)), ' ') AS text")
    now = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, replace(text, 'v', 'u'), text) AS text")
    states = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 'changed', 'unchanged') AS state")
    index = X.build(docs, str(tmp_path / "u"), buckets=2)
    assert _shuffled(spark, lambda: X.update(index, now, states, 1)) <= 200 + 200 + 60 * 4 * 4
    found = index.search(spark.createDataFrame([(1, 0, "u7"), (2, 0, "v7"), (3, 0, "w7")], "qid long, slot int, word string")).collect()
    assert sorted((r.qid, r.doc_id) for r in found) == [(q, d) for q, rest in ((1, 0), (3, 1)) for d in range(200) if d % 2 == rest]


def test_what_a_search_shuffles_does_not_grow_with_what_matches(spark, tmp_path):
    """60 different queries that all of 300 documents match, the best three asked for."""
    n, terms = 300, [f"term{chr(97 + i)}x" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(terms) + " more" * (i % 7)) for i in range(n)], "doc_id long, text string")
    asked = [f"{a} {b}" for k, a in enumerate(terms) for b in terms[:k]][:60]
    index = X.build(docs, str(tmp_path / "all"), buckets=2)
    queries = X.terms_of(spark.createDataFrame(list(enumerate(asked)), "qid long, text string"), [])
    got = []
    assert _shuffled(spark, lambda: got.extend(index.search(queries, 3).collect())) < len(asked) * n // 2
    assert sorted((r.qid, r.doc_id, r["rank"]) for r in got) == [(q, 7 * d, d + 1) for q in range(len(asked)) for d in range(3)]


def test_found_phrases_are_not_shuffled(spark, tmp_path):
    """60 different phrases of two and three words, each in all of 300 documents."""
    n, terms = 300, [f"w{i}" for i in range(31)]
    docs = spark.createDataFrame([(i, " ".join(terms)) for i in range(n)], "doc_id long, text string")
    phrases = [f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)] + [" ".join(terms[i : i + 3]) for i in range(len(terms) - 2)] + ["w0 w2", "w1 w2 w4", "w3"]
    index = X.build(docs, str(tmp_path / "p"), buckets=2)
    found = []
    assert _shuffled(spark, lambda: found.extend(index.phrases(spark.createDataFrame(list(enumerate(phrases)), "qid long, phrase string")).collect())) < len(phrases) * n // 2
    assert {tuple(r) for r in found} == {(q, d) for q, p in enumerate(phrases) if p not in ("w0 w2", "w1 w2 w4") for d in range(n)} and len(found) == 60 * n


def test_blocks_bits_and_parts_of_any_size(spark, tmp_path, monkeypatch):
    """Blocks of few words, few documents and queries at once, several shards and packs: equal to plain Python, number forms too.
    What tasks do is done here, as a change of the module does not reach them."""
    for name, value in {"AT_ONCE": 3, "BLOCK_WORDS": 20, "BLOCK_DOCS": 7, "SHARD": 9, "ASKS": 5, "PACK": 2, "CELLS": 256, "PAIRS": 8, "SENT": 3}.items():
        monkeypatch.setattr(X, name, value)

    def here(self, f, schema):
        kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
        made = pa.Table.from_batches([b.cast(kinds) for b in f(iter(self.toArrow().to_batches(max_chunksize=5)))], kinds)
        return spark.createDataFrame(made.combine_chunks(), schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", here)
    monkeypatch.setattr(X, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(11)
    words = ["alpha", "beta", "gammas", "gamma", "delta", "42", "0042", "00042", "epsilon"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "parts"), buckets=3)
    asked = {q: rng.sample(words, 2) for q in range(20)}
    queries = X.terms_of(spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()], "qid long, text string"), [])
    forms = lambda w: list(dict.fromkeys([w, w.zfill(4), w.zfill(5)])) if w.isdigit() else [w]
    for k in (2, 200):
        got = {(r.qid, r.doc_id, r["rank"], round(r.score, 6)) for r in index.search(queries, k).collect()}
        assert got == ranked(texts, {q: [forms(w) for w in ws] for q, ws in asked.items()}, k)
    phrases = {q: " ".join(rng.choices(words, k=rng.randint(1, 4))) for q in range(40)}
    found = sorted(tuple(r) for r in index.phrases(spark.createDataFrame(list(phrases.items()), "qid long, phrase string")).collect())
    own = {d: [textbook(w) for w in split(t)] for d, t in texts.items()}
    want = {q: [textbook(w) for w in split(p)] for q, p in phrases.items()}
    assert found == [(q, d) for q, p in want.items() for d, t in own.items() if any(t[i : i + len(p)] == p for i in range(len(t)))]
