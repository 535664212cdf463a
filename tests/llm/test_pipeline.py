"""Each stage of the pipeline on its own input against brute force, over the smallest tables."""

import importlib.util
import zlib

import numpy as np
import pytest

from colloquy.llm import decontaminate, work
from test_operators import BPE, brute_components, brute_lines, own_ids

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, decontaminate.words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = work.saved(stage(spark, docs, DATA), f"test-{name}")
        before = {r.doc_id: r.text for r in docs.collect()}
        if name != "packing":
            assert out.dtypes == docs.dtypes
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language":
            assert after == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            gone = brute_lines(list(before.items()))
            want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in before.items()}
            assert after == {d: t for d, t in want.items() if not gone[d] or t.strip(" \t\n\r\x0b\x0c")}
        elif name == "near_dedup":
            assert set(after) == {d for d, _, _, kept in brute_components(list(before.items())) if kept}
        elif name == "decontamination":
            own = decontaminate.SuffixAutomaton(bench, 10)
            hit = {d: sum(e - s for s, e in own.match(decontaminate.words(t))[0]) for d, t in before.items()}
            assert {d: t for d, t in after.items() if not hit[d]} == {d: t for d, t in before.items() if not hit[d]}
            assert set(after) == {d for d, t in before.items() if hit[d] <= 0.5 * len(decontaminate.words(t))}
            assert any(hit.values()) and all(len(after[d]) < len(before[d]) for d in after if hit[d])
        else:
            rows = sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset))
            for d, t in before.items():
                ids, mine = [*own_ids(t), 1], [r for r in rows if r.doc_id == d]
                assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine] and sum(r.length for r in mine) == len(ids)
        docs = out


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, lang_pred int, removed string, spans string, n_words int, item_ids string, _id string, _hit int, kept string, hash string, f int"


def test_stages_on_awkward_rows(spark, messy):
    """Null and empty texts, a null id, repeated rows, no rows at all, and columns named as the operators' own."""
    import corpus_pipeline

    def table(texts):
        return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", None if t is None else len(t), 0.5, "h", 1, "r", "s", 2, "i", "x", 3, "k", "y", 4) for i, t in texts], CLASHING)

    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = work.saved(stage(spark, table(messy), DATA), f"test-{name}")
        got[name] = out.collect()
        assert stage(spark, table([]), DATA).collect() == []
        if name != "packing":
            assert out.dtypes == table([]).dtypes
            assert all(r.held_out == "h" and r.removed == "r" and r.f == 4 and (r.text is None or r.n_chars == len(r.text)) for r in got[name])
    lettered = [(i, t) for i, t in messy if t and any(c.isalpha() for c in t)]
    assert {(r.doc_id, r.text) for r in got["language"]} <= set(lettered) and len(got["language"]) > 0.9 * len(lettered)
    near = [(r.doc_id, r.text) for r in got["near_dedup"]]
    assert near.count((5, dict(messy[6:8])[5])) == 1 if (5, dict(messy[6:8])[5]) in near else True
    assert {(None, None), (1, None), (2, "")} <= set(near)
    assert len(got["decontamination"]) == len(messy) and {r.text for r in got["line_dedup"]} >= {None, ""}
