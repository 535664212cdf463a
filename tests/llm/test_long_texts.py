"""Characters of any age in the encoder; long and repetitive texts in the scans, whose time must grow with the text."""

import random
import re
import time
import unicodedata

import pytest

from colloquy.llm import decontaminate, secrets, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_characters_of_any_age():
    """Characters that Unicode tables of different age see differently, and others, beside what pieces turn on."""
    rng, e = random.Random(8), tokens.Encoder(BPE)
    old, new = unicodedata.ucd_3_2_0, unicodedata
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in every if old.category(c)[0] != new.category(c)[0] or new.category(c) == "Cn" and ord(c) < 0x34000]
    some = rng.sample(changed, 6000) + rng.sample(every, 2000) + list("࢏౜೜㿃\x1c\x1d\x1e\x1f\x85\xa0᠎​ ﻿")
    texts = [t for c in some for t in (f"{c}'s", f"{c}'ll x", f" {c}", f"a{c}b {c}{c}.\n{c} 1{c}")]
    for i in range(0, len(texts), 4000):
        assert e.encode(texts[i : i + 4000]) == e.whole(texts[i : i + 4000])
    assert len(e.odd) > 100


def test_secrets_in_long_runs():
    own = secrets.Scanner(secrets.BASE)
    group = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(6)
    blob = lambda n: "".join(rng.choices("Zx9aB=f0", k=n))
    heads = ["secret: token: ", 'token="secret="', "secret=", "token:secret=api_key=", "password = token = ", "AKIA", ""]
    texts = [h + blob(n) for h in heads for n in (8, 40, 3000)] + [" ".join(rng.choice(heads) + blob(rng.randint(1, 30)) for _ in range(8)) for _ in range(300)]
    for t in texts:
        want = [(m.start(), m.end(), 0) for m in group.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]{16,}", t)]
        assert own.spans(t.encode()) == sorted(want, key=lambda x: (x[0], x[2]))
    for head in heads:  # linear: a megabyte takes seconds at most, where the square would take hours
        data = (head + blob(1_000_000)).encode()
        began = time.time()
        own.spans(data)
        assert time.time() - began < 20


def test_repetitive_items():
    """Equal words in a row: time grows with the text; hits and items as by plain windows."""
    own = decontaminate.SuffixAutomaton([(1, [b"a"] * 30_000), (2, [b"a", b"b"] * 20), (3, [b"a"] * 3)], 10)
    began = time.time()
    assert own.match([b"a"] * 100_000) == ([(0, 100_000)], {1, 3})
    assert time.time() - began < 10
    rng = random.Random(1)
    text = [rng.choice([b"a", b"a", b"a", b"b"]) for _ in range(3000)]
    items = {1: [b"a"] * 30, 2: [b"a", b"b"] * 20, 3: [b"a"] * 3, 4: [rng.choice([b"a", b"b"]) for _ in range(400)]}
    hit, ids = set(), set()
    for k, w in items.items():
        for i in range(max(len(w) - 9, 1)):
            for p in range(len(text)):
                if text[p : p + len(w[i : i + 10])] == w[i : i + 10]:
                    ids.add(k)
                    hit |= set(range(p, p + len(w[i : i + 10])))
    spans, found = decontaminate.SuffixAutomaton(list(items.items()), 10).match(text)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == ids


def test_one_long_item_is_many_blocks(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}" for _ in range(6000)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "short item here"), (3, None)], "item_id long, text string")
    texts = [(k, " ".join(words[i : i + 14])) for k, i in enumerate(range(0, 5980, 13))] + [(9000, "a short item here b"), (9001, "w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    paths = decontaminate.automata(benchmark, 10, most_words=500)
    assert len(paths) > 5
    got = decontaminate.digest(decontaminate.match(docs, paths)).drop("items_sha256")
    want = decontaminate.digest(decontaminate.match(docs, decontaminate.automata(benchmark, 10))).drop("items_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
