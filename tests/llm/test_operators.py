"""Each operator against a brute-force version, a round trip or held-out accuracy, on small tables with awkward rows."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import ann, automata, decontaminate, langid, lines, minhash, packing, secrets, tokenfiles, tokens, toxicity, warc, work

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def own_ids(text):
    return tokens.encoder(BPE).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    rng, e = random.Random(5), tokens.Encoder(BPE, most=50)
    alphabet = "ab éÉ'’.,!?\n\t \x00\x7f\xad　1²Ⅷ中文😀_-+sStdD<|>"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + ["a <|endoftext|> b", "<|endoftext|>", "word " * 5000]
    for i in range(0, len(texts), 300):
        assert e.encode(texts[i : i + 300]) == e.whole(texts[i : i + 300])
    assert e.encode([]) == []
    pool = "".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(400))
    wild = ["".join(rng.choices(pool + " " * 60 + ".\n\t", k=rng.randint(0, 80))) for _ in range(2000)]
    assert e.encode(wild) == e.whole(wild)


def test_packing(make, messy):
    docs = make(messy).repartition(3)
    got = packing.pack(docs, BPE, length=64, keep_ids=True).collect()
    ids = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length and r.offset + r.length <= 64
    for (doc, text), n in Counter(messy).items():
        want = [*own_ids(text), 1]
        pieces = sorted((r for r in got if r.doc_id == doc and r.doc_tokens == len(want)), key=lambda r: r.start)
        assert sum(r.length for r in pieces) % len(want) == 0
        if n == 1 and doc is not None:
            assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == want
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ids.get(r.sequence_id, 0)
        ids[r.sequence_id] = r.offset + r.length
    assert sorted(ids) == list(range(len(ids))) and all(ids[s] == 64 for s in list(sorted(ids))[:-1])
    whole = packing.sequences(packing.pack(docs, BPE, length=64, keep_ids=True), 64).collect()
    assert len(whole) == len(ids) and all(len(s.ids) in (64, s.n_ids) and sum(s.mask) == s.n_ids for s in whole)
    assert packing.pack(make([]), BPE).collect() == []


def test_token_files(spark, make, messy, tmp_path):
    folder = str(tmp_path / "files")
    files = tokenfiles.write_token_files(make(messy).repartition(5), BPE, folder, length=32, per_batch=4)
    got = sorted(tokenfiles.read_documents(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in messy), key=lambda i: (i is not None, i or 0))
    want = Counter((i, crc([*own_ids(t), 0]), len(own_ids(t)) + 1) for i, t in messy)
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    for f in files.filter("n_docs > 0").collect():
        one = tokenfiles.TokenFile(f.tokens)
        ids, mask = zip(*(one.sequence(i) for i in range(len(one))), strict=True)
        assert np.concatenate(mask).sum() == f.n_tokens and len(one) == f.n_sequences
        assert (np.concatenate(ids)[: f.n_tokens] == one.span(0, f.n_tokens)).all()
    assert tokenfiles.round_trip(spark, make([]), BPE).collect() == []


def brute_lines(texts, percent=75, least=5):
    seen, out = [], {}
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = []
        for p, line in enumerate([] if text is None else text.split("\n")):
            words = [w for w in re.split(r"[\x09-\x0D\x20]+", line.lower()) if w]
            s = frozenset(words)
            if len(words) >= least:
                if any((100 + percent) * len(s & o) >= percent * (len(s) + len(o)) and at != (doc, p) for at, o in seen):
                    gone.append(p)
                seen.append(((doc, p), s))
        out[doc] = gone
    return out



def test_line_dedup(make, messy):
    texts = [x for x in messy if x[0] is not None or x[1] is not None]
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    family = rng.sample(words, 24)
    for k in range(60):  # many lines that share their rarest words: several rounds over crowded tokens
        own = family[: 12 + k % 13] + rng.sample(words, k % 9)
        texts.append((1000 + k, "\n".join([" ".join(own), "Short.", " ".join(rng.sample(words, 9))])))
    docs = make(texts)
    got = {r.doc_id: r.removed for r in lines.removed_lines(docs).collect()}
    assert got == {d: g for d, g in brute_lines(texts).items() if g}
    rest = {r.doc_id: r.text for r in lines.without_lines(docs, lines.removed_lines(docs)).collect()}
    for doc, gone in brute_lines(texts).items():
        text = dict(texts)[doc]
        assert rest[doc] == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    assert lines.digest(make([]), lines.removed_lines(make([]))).collect() == []


def brute_components(texts, percent=75):
    sets = []
    for doc, text in texts:
        w = (text or "").encode().lower().split()
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def test_near_duplicates(make, messy):
    assert Counter(map(tuple, minhash.near_duplicates(make(messy)).collect())) == brute_components(messy)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(80)]
    chain = []
    for k in range(30):  # variants of which many are no copies of each other: several rounds in a bucket
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        chain.append((k, " ".join(own)))
    assert Counter(map(tuple, minhash.near_duplicates(make(chain)).collect())) == brute_components(chain)
    assert minhash.near_duplicates(make([])).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, (1 << 64) - 1, 2000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * 2 * share / (1 + share))], rng.integers(0, (1 << 64) - 1, 2000, dtype=np.uint64)])[:2000]
        x, y = minhash.signature(np.unique(a)), minhash.signature(np.unique(b))
        assert abs((x == y).mean() - share) < 0.13
    one = minhash.signature(np.array([7], np.uint64))
    assert len(set(one.tolist())) == 1


def test_warc(spark):
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b c/é", None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "é" * 5000), (6, "v", "solo"), (6, "v", "solo")]
    df = spark.createDataFrame([(*p, "r", 1, "d") for p in pages], "page_id long, url string, html string, record_type string, w long, sha1 string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, df).collect())
    want = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        top = max(j if j is not None else -1 for j, _, h in pages if (h or "") == (html or ""))
        want[(i, len(body), warc.digest(body), "response" if i == top else "revisit", None if i == top else top)] += 1
    assert got == want
    assert warc.round_trip(spark, df.limit(0)).collect() == []


def test_warc_archive_bytes():
    records = [warc.record(i, "http://x/é y", f"héllo {i} ".encode() * 50, warc.digest(b"x"), None, "d", False) for i in range(300)]
    for part in (records, records[:1], []):
        f = io.BytesIO()
        assert warc.write_archive(f, part)[0] == len(part)
        f.seek(0)
        assert [b for _, b in warc.read_archive(f)] == [f"héllo {i} ".encode() * 50 for i in range(len(part))]
    f = io.BytesIO()
    warc.write_archive(f, records)
    assert f.getvalue()[:4] == (0x184D2A5D).to_bytes(4, "little")
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(f.getvalue()[:-3])))


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(t):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16], key=lambda x: (x[0], x[2]))


def test_secrets(make):
    rng = random.Random(1)
    bits = ["password", "Token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "abc", "deadbeef01", "é", "=abcdefghijkl", "\n", "x", "ghp_", "/", "  ", "s", "kia"]
    texts = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(2000)] + [(2000, None), (2001, ""), (2002, "é" + "a0" * 200_000), (2002, "x"), (None, "token=abcdefghijklmno")]
    got = secrets.digest(secrets.scan(make(texts))).collect()
    names = ("assign", "access", "hex")
    want = []
    for doc, t in texts:
        spans = brute_spans(t or "")
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, e, k in spans)
        want.append((doc, *(sum(x[2] == k for x in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter(want)
    assert secrets.scan(make([(1, "x ghp_" + "a1" * 18)])).first().spans[0].kind == "github"


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,3}x?", "(?i:ab)+c", r"\d+\.\d{2}", "(a|ab)(c|bcd)", "a{0,2}b"])
def test_automata_agree_with_regexes(pattern):
    rng = random.Random(2)
    one = automata.build([automata.parse(pattern)], False)
    for _ in range(400):
        t = "".join(rng.choices("abcdABx1.2", k=rng.randint(0, 8)))
        want = [e for e in range(1, len(t) + 1) if re.fullmatch(pattern, t[:e])]
        assert one.ends(t.encode(), 0) == want


def test_decontamination(spark, make):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "É"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(12)] + [(50, None), (51, "A-b"), (51, "a, B"), (None, "c c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, " ".join(rng.choices([*words, "z"], k=rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "  x,A b. " + (items[3][1] + " ") * 500), (102, "q")]
    for window in (4, 10):
        got = decontaminate.digest(decontaminate.find(make(texts), bench, window)).collect()
        want = []
        for doc, t in texts:
            d = decontaminate.words(t)
            hit, found = set(), set()
            for item, x in items:
                w = decontaminate.words(x)
                for s in [w] if 0 < len(w) < window else [w[k : k + window] for k in range(len(w) - window + 1)]:
                    for k in range(len(d) - len(s) + 1):
                        if d[k : k + len(s)] == s:
                            hit.update(range(k, k + len(s)))
                            found.add(str(item))
            want.append((doc, len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        assert Counter(map(tuple, got)) == Counter(want)
    passage = " ".join(f"p{k}" for k in range(12))
    text = f"Keep this, {passage.upper()}. And that; really, much more text than was cut stays in here, it does."
    out = decontaminate.clean(make([(1, text), (2, passage), (3, None)]), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: text.replace(passage.upper(), ""), 3: None} and out.columns == make([]).columns


def test_blocks_of_benchmark_give_the_same(spark, make):
    rng = random.Random(6)
    bench = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=30))) for i in range(20)], "item_id long, text string")
    docs = make([(i, " ".join(rng.choices("abcdefgh", k=300))) for i in range(30)])
    one = decontaminate.digest(decontaminate.match(docs, decontaminate.automata(bench, 4))).collect()
    many = decontaminate.automata(bench, 4, most_words=60)
    assert len(many) > 1 and sorted(map(tuple, one)) == sorted(map(tuple, decontaminate.digest(decontaminate.match(docs, many)).collect()))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24)) * 3
    v = [(i, (centres[i % 12] + rng.normal(size=24)).tolist()) for i in range(1500)]
    v += [(2000 + i, v[0][1]) for i in range(40)] + [(2100, None), (2200, [0.0] * 24), (2300, [float("nan")] * 24), (2400, [1.0]), (None, v[1][1]), (2500, v[5][1]), (2500, v[5][1])]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in v], "vec_id long, embedding array<double>, w long, same string")
    got = ann.nearest(df).collect()
    good = [(i, np.array(x)) for i, x in v if i is not None and x is not None and len(x) == 24 and np.isfinite(x).all() and any(x)]
    good = {(i, x.tobytes()): (i, x) for i, x in good}.values()
    ids, m = np.array([i for i, _ in good]), np.array([x for _, x in good])
    queries = sorted({i for i in ids.tolist() if i % 100 == 0})
    hits = 0
    for q in queries:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        want = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in want})
    assert hits >= 0.9 * 10 * len(queries) and {r.query_id for r in got} == set(queries)
    few = df.filter("vec_id < 4")
    assert len(ann.nearest(few).collect()) == 3
    assert ann.nearest(df.limit(0)).collect() == []


WORDS = {"xx": ["kato", "mira", "solen", "pavi"], "yy": ["gruft", "streng", "wolk", "brand"]}


def labelled(n=300):
    rng = random.Random(9)
    return [(i, " ".join(rng.choices(WORDS["xx" if i % 2 else "yy"], k=rng.randint(3, 60))), "xx" if i % 2 else "yy") for i in range(n)]


def test_language(spark):
    rows = [(i, t, lang, 1) for i, t, lang in labelled()] + [(500, None, "xx", 1), (501, "", None, 1), (502, "123 !?", "yy", 1), (503, "kato " * 50_000, None, 1), (None, "gruft wolk streng", "yy", 1), (504, "日本", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == lang for i, _, lang in labelled())
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "xx" and got[None].lang_pred == "yy" and got[504].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labelled())
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang = 'q'")).collect()} == set()


def test_filters_for_many_languages():
    rng = np.random.default_rng(2)
    own = langid.Filters([f"l{k:03d}" for k in range(130)], bits=18)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 400)) for _ in range(130)]
    for k, t in enumerate(texts):
        flat, bounds = langid.join([langid.fold(t)])
        for n in langid.SIZES:
            own.add(k, langid.grams(flat, bounds, n)[0])
    assert (own.close().shares(texts).argmax(axis=1) == np.arange(130)).all()


def test_toxicity(spark):
    rng = random.Random(5)
    clean = ["river", "stone", "lamp", "garden", "paper", "window", "table", "cloud"]
    rows, labels = [], []
    for i in range(800):
        w = rng.choices(clean, k=rng.randint(5, 60))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Nastyword", "vilething"])
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(bad), 2))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "stone " * 50_000, 1), (None, "nastyword", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([*labels, (5000, 1, 2), (None, 1, 2), (1, None, 2)], "doc_id long, toxic int, score int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [(got[i].predicted, t) for i, t, _ in labels if got[i].held_out]
    assert len(held) > 100 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert len(got) == len(rows) and got[1000].predicted == got[1001].predicted == got[1002].predicted == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_language_against_plain_sets(make):
    """Shares and decisions of the bit-sliced filters against plain sets of n-grams; numbers are no letters."""
    rng = random.Random(12)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ßu", "ré", "tzo"], "cc": ["wi", "qua", "xe"]}
    texts = [(k, lang, " ".join("".join(rng.choices(parts, k=3)) for _ in range(30))) for k, (lang, parts) in enumerate(list(syllables.items()) * 40)]
    docs = make([(k, t) for k, _, t in texts]).drop("lang").join(make([]).sparkSession.createDataFrame([(k, lang) for k, lang, _ in texts], "doc_id long, lang string"), "doc_id")
    filters = langid.fit(docs, least_share=0.0)
    held = {k for k, _, _ in texts if zlib.crc32(str(k).encode()) % 5 == 0}
    fold = lambda t: f" {' '.join(re.sub(r'[0-9]', ' ', t.lower()).split())} ".encode()
    grams = lambda t: [(n, fold(t)[i : i + n]) for n in (3, 4, 5) for i in range(len(fold(t)) - n + 1)]
    known = {lang: Counter(g for k, own, t in texts if own == lang and k not in held for g in grams(t)) for lang in syllables}
    known = {lang: {g for g, n in c.items() if n >= 2} for lang, c in known.items()}
    asked = [t for k, _, t in texts if k in held] + ["kalo ßuré wiqua kamimi", "zzzz yyyy"]
    shares = filters.shares(asked)
    for row, text in zip(shares, asked, strict=True):
        own = grams(text)
        for value, lang in zip(row, filters.languages, strict=True):
            assert abs(value - sum(g in known[lang] for g in own) / len(own)) < 0.01
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, filters).collect()}
    assert all(got[k] == lang for k, lang, _ in texts)
    none = langid.predict(make([(1, "½ ②"), (2, "12 Ⅷ"), (3, None), (4, "")]), filters).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 4


def test_automata_are_built_by_tasks(spark, monkeypatch):
    def on_driver(*_):
        raise AssertionError("built on the driver")

    monkeypatch.setattr(decontaminate.SuffixAutomaton, "__init__", on_driver)
    bench = spark.createDataFrame([(i, f"word{i} and more of item {i}") for i in range(20)], "item_id long, text string")
    paths = decontaminate.automata(bench, 5, most_words=30)
    assert len(paths) > 1
    found = decontaminate.find(spark.createDataFrame([(1, "Word7 and more"), (2, "so Word7 and more of item 7"), (3, None)], "doc_id long, text string"), bench, 5)
    assert {r.doc_id: (r.n_words, r.item_ids) for r in found.collect()} == {1: (3, []), 2: (7, ["7"]), 3: (0, [])}
    assert decontaminate.automata(bench.filter("item_id < 0"), 4) == []


def test_toxicity_against_plain_sums(spark, make):
    """Ratios counted and scores summed in plain Python; the regression is where its gradient vanishes."""
    rng = random.Random(21)
    clean, bad = ["walk", "garden", "letter", "window", "summer", "paper"], ["grumbo", "snarv", "vilkat"]
    rows = []
    for k in range(240):
        toxic = int(k % 4 == 0)
        rows.append((k, " ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=rng.randint(1, 3)) if toxic else [])), toxic))
    docs, labels = make([(k, t) for k, t, _ in rows]), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, penalty=1.0, steps=4000)

    def slots(text):
        out, mask = set(), (1 << 64) - 1
        raw = f" {' '.join(text.split())} ".encode()
        for n in toxicity.SIZES:
            for i in range(len(raw) - n + 1):
                code = n
                for byte in raw[i : i + n]:
                    code = (code << 8 | byte) & mask
                x = (code + 7) * 0x9E3779B97F4A7C15 & mask
                x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
                out.add(x >> (64 - toxicity.BITS))
        return out

    learned = [(slots(t), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]
    m = Counter(y for _, y in learned)
    seen = {y: Counter(s for own, z in learned if z == y for s in own) for y in (0, 1)}
    ratio = {s: np.log((seen[1][s] + 1) / (m[1] + 2)) - np.log((seen[0][s] + 1) / (m[0] + 2)) for s in {*seen[0], *seen[1]}}
    kept = set(np.flatnonzero(model.weights).tolist())
    assert kept and kept <= set(ratio)
    for s, r in ratio.items():
        p, q = seen[1][s] + 1, seen[0][s] + 1
        error = np.sqrt(max(1 / p - 1 / (m[1] + 2), 0) + max(1 / q - 1 / (m[0] + 2), 0))
        assert (s in kept) == (abs(r) >= 4 * error) or s not in kept  # a coefficient may come out as 0
    z = {k: model.bias + sum(model.weights[s] for s in slots(t)) for k, t, _ in rows}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[k].score - 1 / (1 + np.exp(-z[k]))) < 1e-9 and got[k].predicted == (z[k] >= 0) for k in z)
    assert all(got[k].predicted == y for k, _, y in rows)
    share = m[1] / (m[0] + m[1])
    weigh = {1: (0.5 / share) ** 0.5, 0: (0.5 / (1 - share)) ** 0.5}
    gap = [(own, (1 / (1 + np.exp(-(model.bias + sum(model.weights[s] for s in own)))) - y) * weigh[y] / len(learned)) for own, y in learned]
    for s in kept:
        pull = sum(g for own, g in gap if s in own) * ratio[s] + model.weights[s] / ratio[s] / len(learned)
        assert abs(pull) < 1e-3
    assert abs(sum(g for _, g in gap)) < 1e-2


def test_components_of_long_chains(spark, monkeypatch):
    """Chains, stars and rings; the rounds do not grow with a chain's length."""
    rounds = []
    plain = work.saved
    monkeypatch.setattr(work, "saved", lambda df, name: rounds.append(name) or plain(df, name))
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    pairs = list(zip(ids, ids[1:], strict=False)) + [(1000, k) for k in range(1001, 1100)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(3000, 3000)]
    got = {r.id: r.component for r in work.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, 0), **dict.fromkeys(range(1000, 1100), 1000), **dict.fromkeys(range(2000, 2050), 2000)}
    assert rounds.count("cc-labels") < 30
    assert work.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_recall_of_neighbours(spark):
    """Every vector whose id is divisible by 50 against all: nine of ten true neighbours or more, with exact scores."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in table.collect())
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    got = {}
    for r in ann.nearest(table, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        distance = np.sqrt(((v - v[k]) ** 2).sum(1))
        near = sorted((d, i) for d, i in zip(distance.tolist(), ids.tolist(), strict=True) if i != ids[k])[:10]
        own = got[int(ids[k])]
        assert all(abs(s - distance[np.searchsorted(ids, i)]) < 1e-12 for i, s in own) and len(own) == 10
        hits += len({i for _, i in near} & {i for i, _ in own})
    assert hits >= 0.9 * 10 * len(got)


def test_group_of_similar_lines_makes_no_pairs(make, monkeypatch):
    """No line of the group resembles the first ones, but all later ones each other: no table grows with the group's square."""
    word, size, real = [f"w{k}" for k in range(20)], {}, lines.saved

    def counted(df, name):
        out = real(df, name)
        size[name] = max(size.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "saved", counted)
    apart = [{i, j, (j + 1) % 20} if j + 1 < 20 or i else {0, 19, 9} for j in range(20) for i in range(j)]
    texts = [(k, " ".join([*(w for i, w in enumerate(word) if i not in out), f"a{k}", f"b{k}", f"c{k}"])) for k, out in enumerate(apart)]
    texts += [(k, " ".join([*word[: k % 20], f"x{k}", *word[k % 20 + 1 :]])) for k in range(200, 400)]
    sets = [set(t.split()) for _, t in texts]
    gone = {k for at, (k, _) in enumerate(texts) if any(4 * len(sets[at] & x) >= 3 * len(sets[at] | x) for x in sets[:at])}
    assert len(gone) > 150 and {r.doc_id for r in lines.removed_lines(make(texts)).collect()} == gone
    assert max(size.values()) <= 6 * len(texts)


def test_only_entries_with_a_partner_go_past_the_first_join(make, monkeypatch):
    """Lines differ in one rare word each, of which no later table holds an entry; equal lines and lines of few words are read once and never."""
    size, real = {}, lines.saved

    def counted(df, name):
        out = real(df, name)
        size[name] = max(size.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "saved", counted)
    texts = [(2 * k + i, " ".join([f"own{2 * k + i}", *(f"w{k}_{j}" for j in range(19))])) for k in range(40) for i in range(2)]
    copies = [(1000 + k, "\n".join([texts[k % 4][1], "a few words", ""])) for k in range(60)]
    gone = {r.doc_id: r.removed for r in lines.removed_lines(make(texts + copies)).collect()}
    assert gone == {k: [0] for k in [*range(1, 80, 2), *range(1000, 1060)]}
    assert size["line-entries"] <= 5 * len(texts) and size["line-texts"] == len(texts)


def test_words_of_lines_sort_as_plain_numbers(make, messy):
    """No word's number may be null in the schema, or Spark sorts each line's numbers as objects."""
    docs = make(messy)
    tokens = lines._tokens(lines._lines(docs), lines._ranks(docs))
    assert not tokens.schema["tokens"].dataType.containsNull
    for r in tokens.join(lines._lines(docs), ["doc_id", "pos"]).dropDuplicates().collect():
        words = r.line.lower().split()
        bits = [0, 0]
        for t in r.tokens:
            bits[t & 1] ^= 1 << (t >> 1 & 63)
        assert (r.m, r.n) == (len(words), len(set(words))) and r.tokens == sorted(r.tokens)
        assert [b - (1 << 64) * (b >> 63) for b in bits] == [r.even, r.odd]


def test_language_of_texts_in_rows(make, messy, monkeypatch):
    """A text that lies in the row that is passed on goes to the workers once; answers are those of plain texts."""
    monkeypatch.setattr(langid, "BLOCK", 500)
    docs = make(messy)
    filters = langid.fit(docs, least_share=0.0)
    plain = langid.predict(docs, filters, ("text",))
    whole = langid.predict(docs.select("doc_id", F.struct("text", "lang").alias("_row")), filters, ("_row",), "_row")
    answers = lambda df: sorted(map(repr, df.collect()))
    assert answers(whole.select(*plain.columns[:-1], "_row.text")) == answers(plain) and "text" not in whole.columns and plain.count() == len(messy)
