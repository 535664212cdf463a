"""URL filter, whitening and conversation repair against brute-force versions, with awkward rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from colloquy.llm import conversations, urls, whiten

TURNS = "conv_id long, turn long, role string, text string, uid long, part int, k int, edit string, digest string, _n int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "e", "d", 4) for r in rows], TURNS)


def cheapest(rows):
    """Least (cost, audit) by trying every state with every edit, rows as (role, fault)."""
    best = {"": (0, "", ())}  # kept roles' last initial -> cost, audit, output
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(best):
        for _ in range(3):
            for last, (c, a, o) in list(best.items()):
                for r in set(ok[last]) & set("ua"):
                    best[r] = min(best.get(r, (9e9,)), (c + 5, a + "I", (*o, (r, None))))
        return best

    for i, (role, fault) in enumerate(rows):
        nxt = {}
        for last, (c, a, o) in insert(dict(best)).items():
            tries = [(last, c + 2, a + "D", o)]
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                tries += [(role[:1], c + late, a + "K", (*o, (role[:1], i)))] * (role[:1] != "" and role[:1] in ok[last])
                tries += [(r, c + 1 + late, a + "R", (*o, (r, i))) for r in set(ok[last]) & set("ua")]
            for to, *x in tries:
                nxt[to] = min(nxt.get(to, (9e9,)), tuple(x))
        best = nxt
    return min(v for k, v in insert(best).items() if k in ("", "a"))


def every_way(rows):
    """The same by writing out all edits, for a few rows."""
    found = []
    options = [["D"] + ([] if f in ("blank", "duplicate") else ["K", "Ru", "Ra"]) for _, f in rows]
    places = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1))
    for edits in itertools.product(*options):
        for ins in places:
            roles, audit, cost = "", "", 0
            for k, (role, fault) in enumerate([*rows, ("", "")]):
                roles, audit, cost = roles + ins[k], audit + "I" * len(ins[k]), cost + 5 * len(ins[k])
                if k < len(rows):
                    e = edits[k]
                    roles += "" if e == "D" else role[:1] or "?" if e == "K" else e[1]
                    audit, cost = audit + e[0], cost + {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * (fault == "truncated" and e != "D")
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def plain_repair(rows):
    """The contract's columns of one conversation's rows (turn, role, text), by plain loops."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = cheapest([(r, f) for (_, r, _), f in zip(rows, faults, strict=True)])
    lines = [f"{role}:" if i is None else f"{rows[i][1] if rows[i][1][:1] == role[:1] and e == 'K' else role}:{rows[i][2]}" for (r, i), e in zip(out, audit.replace("D", ""), strict=True) for role in [{"u": "user", "a": "assistant"}.get(r, "system")]]
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_least_edits_by_every_way():
    rng = random.Random(2)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 3))]
        assert cheapest(rows)[:2] == every_way(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_blocks_meet_at_least_audit(size):
    rng, kinds = random.Random(size), ["", "truncated", "blank"]
    for n in [*range(1, 12), 200, 500]:
        rows = [(rng.choice(["system", "user", "assistant", "user", "tool"]), rng.choice(kinds)) for _ in range(n)]
        codes = bytes("sua".find(r[0][0]) % 4 + 4 * kinds.index(r[1]) for r in rows)
        blocks = [codes[i : i + size] for i in range(0, n, size)]
        cost, states = conversations.join_blocks([conversations.transfer(b) for b in blocks])
        audit = "".join(e for k, b in enumerate(blocks) for e in conversations.edits(b, states[k], states[k + 1])) + conversations.ENDS[states[-1]]
        assert (cost, audit) == cheapest(rows)[:2]


@pytest.mark.parametrize("block", [3, 2048])
def test_repair(spark, block):
    rng, rows = random.Random(9), []
    texts = ["Yes.", "No", " \t", "", "Why?", "a b c", "One.\nTwo!", None, "x" * 20_000 + ".", "Ça va ?", "end.\n \x0b"]
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 4]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += [(900, i, "user" if i % 2 else "assistant", f"w{i % 50}.") for i in range(600)]  # a long conversation
    rows += [(901, None, "user", "Same.")] * 40 + [(901, 7, "assistant", "Late.")]  # ties and repeated rows
    found = conversations.digest(chats(spark, rows), conversations.repair(chats(spark, rows), block)).collect()
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(r)
    assert {r.conv_id: tuple(r[1:]) for r in found} == {c: plain_repair(r) for c, r in convs.items()} and len(found) == len(convs)
    turns = conversations.repair(chats(spark, rows), block).turns.collect()
    for c in convs:
        own = sorted((r for r in turns if r.conv_id == c), key=lambda r: (r.part, r.block, r.k))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))


def test_damage_and_empty(spark):
    import zlib

    rows = [(c, t, "assistant", "Well. Done!") for c in (None, 3, -4) for t in (None, *range(40))] + [(5, 6, None, None)]
    want = []
    for c, t, role, text in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        text, role = ("" if n == 1 else text.translate({46: None, 33: None, 63: None}) if n == 2 else text), ("user" if n == 4 else role)
        want += [(c, t, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in conversations.damage(chats(spark, rows)).collect()), key=key) == sorted(want, key=key)
    none = chats(spark, [])
    assert conversations.digest(none, conversations.repair(conversations.damage(none))).collect() == []
    gone = conversations.digest(chats(spark, rows), conversations.repair(none)).collect()
    assert len(gone) == 4 and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_urls(spark):
    rng = random.Random(4)
    words = ["free", "casino", "bets", "win", "freedom", "news", "en", "adult", "spam"]
    made = ["".join(rng.choice(words) + rng.choice(["-", "", "/", ".", "é", "7", "_"]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = [None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/Free", "a://b://c/d?e#f", "http://example.net?free=win", "http://com/", "http://xcom/", "https://a.net/es/", "https://a.net/ES/", "https://net/fr/x", "http://example.com/en", "http://b.example.com/en/a\nb", "http://c.org/" + "free-" * 30_000, *(f"http://{m}" for m in made)]
    rows += rows[:9]
    pages = spark.createDataFrame([(None if i == 5 else i, u, "h", "p", 1, "r", "v", 2) for i, u in enumerate(rows)], "page_id long, url string, host string, path string, total int, rule string, verdict string, _url int")
    got = urls.judge(pages).collect()
    for r, (i, u) in zip(sorted(got, key=lambda r: 5 if r.page_id is None else r.page_id), enumerate(rows), strict=True):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), re.split(r"[?#]", rest[cut:])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        low = (u or "").lower()
        terms = {t for t in urls.WEIGHTS if re.search(f"(?<![a-z\x80-\U0010ffff]){t}(?![a-z\x80-\U0010ffff])", low)}
        strict = sum(urls.WEIGHTS[t] >= urls.LIMIT for t in terms)
        verdict = max(fits)[2] if fits else "block" if strict or len(terms) >= 2 else "allow"
        assert (r.host, r.path, r.rule, r.verdict, r.n_strict, r.n_soft) == (host, path, max(fits)[1] if fits else None, verdict, strict, len(terms) - strict), (i, u)
    assert urls.judge(pages.limit(0)).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, n long, component int, x string, whitened double")


@pytest.mark.parametrize("size,count", [(64, 400), (40, 60), (5, 30), (48, 20)])
def test_whitening(spark, size, count):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(count, size)) * np.linspace(0.05, 1, size)
    rows = [(i, list(v)) for i, v in enumerate(x)] + [(1, list(x[1]))] * 3 + [(None, list(x[2]))]
    awkward = [(900, None), (901, []), (902, [None] * size), (903, [float("nan")] * size), (904, [float("inf")] + [0.0] * (size - 1)), (905, [1.0] * (size + 1)), (906, [1e300] * size)]
    got = whiten.whiten(vectors(spark, rows + awkward).repartition(20)).collect()
    whole = np.floor(np.array([v for _, v in rows]) * 64).astype(np.int64) + 1_000_000
    n, sums = len(whole), whole.sum(0)
    centred = (whole * n - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.identity_error < 1e-9 for r in got} == {True}
    want = {i: (centred[at] @ u / np.sqrt(np.maximum(e, 1e-300)), int(((whole[at] * n - sums) ** 2).sum())) for at, (i, _) in enumerate(rows)}
    sign = {}
    for r in sorted(got, key=lambda r: (r.component, r.vec_id is None, r.vec_id)):
        value, deviation = want[r.vec_id][0][r.component - 1], want[r.vec_id][1]
        s = sign.setdefault(r.component, np.sign(value) * np.sign(r.whitened))
        assert abs(s * r.whitened - value) < 1e-7 and r.deviation == deviation and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9


def test_whitening_of_few(spark):
    assert whiten.whiten(vectors(spark, [])).collect() == []
    assert whiten.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whiten.whiten(vectors(spark, [(1, [1, 2, 3])] * 5)).collect() == []
    line = whiten.whiten(vectors(spark, [(i, [i, 2 * i, 0]) for i in range(4)])).collect()
    assert len(line) == 4 and {r.component for r in line} == {1} and {round(r.explained, 12) for r in line} == {1.0}
    big = whiten.whiten(vectors(spark, [(1, [2.0**44, 0]), (2, [0, 1.0])])).collect()
    assert {r.vec_id for r in big} == {1, 2} and all(r.deviation is None for r in big)
    even = whiten.whiten(vectors(spark, [(k, [float(k == d) - float(k == d + 3) for d in range(3)]) for k in range(6)])).collect()
    assert len(even) == 18 and max(r.identity_error for r in even) < 1e-9
