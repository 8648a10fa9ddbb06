"""HNSW against brute force: recall, exact scores, ties, copies, and vectors that take no part."""

import numpy as np
import pytest

from pulseboard.llm import ann as A
from pulseboard.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(ids, vecs, every, k):
    out = {}
    for i, q in zip(ids, vecs, strict=True):
        if i % every == 0:
            d = np.sqrt(((vecs - q) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def check(rows, want, least):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, w in want.items() if w}
    hit = 0
    for q, w in want.items():
        if not w:
            continue
        assert len(got[q]) == len(w) and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
        hit += len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w)
    assert hit >= least * sum(bool(w) for w in want.values())
    return got


def test_recall_on_the_table(spark):
    df = table(spark, SF, "embeddings")
    rows = df.collect()
    ids, vecs = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = check(A.nearest_neighbours(df, 10).collect(), brute(ids, vecs, 10, 10), 0.9)
    where = {i: k for k, i in enumerate(ids)}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(np.sqrt(((vecs[where[i]] - vecs[where[q]]) ** 2).sum()), abs=1e-12)


def test_many_shards_keep_recall(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "id bigint, v array<double>").withColumn("dim", A.F.lit(24)).repartition(3)
    index = A.build_index(df, 500)
    assert 4 <= index.count() <= 6
    check(A.search(index, df.where("id % 50 = 0"), block=16).collect(), brute(np.arange(3000), vecs, 50, 10), 0.95)


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=8)
    rows = [(k, one.tolist()) for k in range(0, 4000, 2)]  # one very common vector
    rows += [(k, rng.normal(size=8).tolist()) for k in range(1, 401, 2)]
    rows += [(-100, [1.0] * 8), (5000, [1.0] * 8), (5000, [1.0] * 8)]
    bad = [(6000, None), (6100, [0.0] * 8), (6200, [1.0, None] + [0.0] * 6), (6300, [float("nan")] * 8), (6400, [float("inf")] * 8), (6500, []), (None, [1.0] * 8)]
    odd = [(7000, [1.0, 2.0]), (7001, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + odd], "vec_id bigint, embedding array<double>, dim int, shard int")
    got = A.nearest_neighbours(df).collect()
    uniq = list({(i, tuple(v)) for i, v in rows})
    want = brute(np.array([i for i, _ in uniq]), np.array([v for _, v in uniq]), 100, 10)
    want[7000] = [(7001, 1.0)]
    found = check(got, want, 0.98)
    assert [i for i, _ in found[0]] == list(range(2, 21 + 1, 2))
    assert found[7000] == [(7001, 1.0)]
    assert all(s == 0.0 for _, s in found[200])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in sorted(A.nearest_neighbours(few).collect(), key=lambda r: r["rank"])] == [(1, 1.0), (2, 3.0)]
    assert A.nearest_neighbours(few.limit(0)).count() == 0
    assert A.nearest_neighbours(few.where("vec_id = 0")).count() == 0
