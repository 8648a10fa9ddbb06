"""Extendible hashing against a bit-by-bit split in plain Python."""

import hashlib

import pytest

from pulseboard.llm import sharding as S
from llm_fixtures import make_docs, rng  # noqa: F401


def h60(i):
    return int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    out = {}

    def split(part, depth, bits):
        if sum(n for _, n in part) <= limit or depth == 60:
            for i, _ in part:
                out[i] = bits
            return
        for b in (0, 1):
            sub = [(i, n) for i, n in part if h60(i) >> (59 - depth) & 1 == b]
            if sub:
                split(sub, depth + 1, bits + str(b))
    split(rows, 0, "")
    return out


@pytest.mark.parametrize("limit", [10**9, 5000, 300])
def test_matches_brute_force(spark, make_docs, rng, limit):
    rows = [(k * 3, "é" * rng.choice([0, 1, 20, 100])) for k in range(400)]
    docs = make_docs(rows, extra=["h", "cell", "depth", "prefix"])
    got = S.shards(docs, limit).collect()
    want = brute([(i, len(t.encode())) for i, t in rows], limit)
    assert {r.doc_id: r.shard for r in got} == want and len(got) == len(rows)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
    assert all(r.shard_bytes == size[r.shard] <= limit and r.part == 0 for r in got)


def test_one_key_and_large_rows(spark, make_docs):
    rows = [(7, "x" * 50)] * 300 + [(None, "y" * 30)] * 10 + [(8, "z" * 5000), (9, None), (10, "")]
    got = S.shards(make_docs(rows), 200).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault((r.shard, r.part), []).append(r.n_bytes)
    assert all(sum(v) <= 200 or len(v) == 1 for v in size.values())
    assert all(r.shard_bytes == sum(size[r.shard, r.part]) and r.shard_docs == len(size[r.shard, r.part]) for r in got)
    assert len({(r.shard, r.part) for r in got if r.doc_id == 7}) == 300 // 4


def test_empty_table_and_plan(spark, make_docs):
    out = S.shards(make_docs([]), 100)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_write(spark, make_docs, tmp_path):
    docs = make_docs([(k, "x" * 10) for k in range(40)])
    S.write_shards(docs, S.shards(docs, 100), str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == 40 and set(docs.columns) <= set(back.columns)


def test_write_null_and_repeated_ids(spark, make_docs, tmp_path):
    """Every row is written once, to a part within the limit."""
    rows = [(7, "x" * 50 + str(k % 10)) for k in range(300)] + [(None, "y" * 30)] * 10 + [(None, None), (8, "z" * 5000), (9, None), (10, ""), (10, "")]
    docs = make_docs(rows, extra=["row", "key", "n_bytes", "number"]).repartition(4)
    S.write_shards(docs, S.shards(docs, 200), str(tmp_path / "out"))
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    size = {}
    for r in got:
        size.setdefault((r.shard, r.part), []).append(len(r.text or ""))
    assert all(sum(v) <= 200 or len(v) == 1 for v in size.values())
