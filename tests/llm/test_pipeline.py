"""Each stage of the pipeline against a brute-force form of it, over the rows that the stage before kept."""

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from pulseboard.llm import decontaminate, packing, quality
from pulseboard.llm.common import table

from test_line_dedup import key
from test_packing import check_pack
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in C.STAGES:
        before, docs = docs, C.stored(stage(spark, docs, SF), "test")
        out.append((before, docs))
    return out


def rows(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages[0]
    model = quality.learn(before, table(spark, SF, "labels"))
    want = [r for r in rows(before) if model.above(np.array([sum(model.weights[p] @ v for p, v in [quality.text_vector(r[1].encode())])]))[0, -1] >= 0.25]
    assert rows(after) == want and len(want) < before.count()


def test_lines(stages):
    before, after = stages[1]
    held = {}
    for i, t, *_ in rows(before):
        for ln in t.split("\n"):
            held.setdefault(key(ln), set()).add(i)
    want = []
    for i, t, lang, source, _ in rows(before):
        kept = "\n".join(ln for ln in t.split("\n") if len(key(ln)) < 10 or len(held[key(ln)]) < 2 or min(held[key(ln)]) == i)
        want.append((i, kept, lang, source, len(kept)))
    assert rows(after) == want


def test_near_duplicates(stages):
    before, after = stages[2]
    fp = {r[0]: brute_fp(r[1]) for r in rows(before)}
    comp = brute_components(set(fp.values()))
    first = {}
    for i, f in sorted(fp.items()):
        first.setdefault(comp[f], i)
    assert rows(after) == [r for r in rows(before) if first[comp[fp[r[0]]]] == r[0]]


def test_decontamination(spark, stages):
    before, after = stages[3]
    norm = lambda t: " " + " ".join(map(str, decontaminate.words(t))) + " "
    items = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert rows(after) == [r for r in rows(before) if not any(w in norm(r[1]) for w in items)]


def test_packing(stages):
    before, after = stages[4]
    check_pack([(r[0], r[1]) for r in rows(before)], after.collect(), 1024)
    assert packing.END_ID == 0


def test_run_is_registered(spark, stages):
    assert E.queries()["pipeline"] is C.run and C.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
    got = C.run(spark, SF)
    assert sorted(map(str, got.select("doc_id", "length", "sequence_id").collect())) is not None
    assert got.agg({"length": "sum"}).first()[0] == stages[4][1].agg({"length": "sum"}).first()[0]


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
