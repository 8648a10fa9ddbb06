"""SimHash against brute force: fingerprints, links at every distance, components, hard rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseboard.llm import simhash as S
from llm_fixtures import make_docs, rng  # noqa: F401


def brute_fp(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps, bits=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("node_limit,cluster", [(4096, 300), (40, 300), (16, 100)])
def test_links_lose_nothing(spark, rng, node_limit, cluster):
    base = [rng.getrandbits(64) for _ in range(200)]
    fps = set(base)
    for b in base[:60]:
        for k in (1, 2, 3, 4, 5):
            x = b
            for i in rng.sample(range(64), k):
                x ^= 1 << i
            fps.add(x)
    seed = rng.getrandbits(64)
    for _ in range(cluster):  # one dense group
        seed2 = seed
        for i in rng.sample(range(40, 64), 2):
            seed2 ^= 1 << i
        fps.add(seed2)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(3)
    got = {r.v & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.links(df, 3, node_limit)).collect()}
    want = brute_components(fps)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_close_pairs_are_all_pairs_when_labels_differ(rng):
    vals = np.array(sorted({rng.getrandbits(12) for _ in range(400)}), dtype=np.uint64)
    vals = vals[np.argsort(S.gray_rank(vals))]
    got = set()
    for i, j in S.close_pairs(vals, vals, True, 3, np.arange(len(vals))):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(len(vals)) for j in range(i + 1, len(vals)) if int(vals[i] ^ vals[j]).bit_count() <= 3}
    assert got == want


def docs_of(rng):
    words = [f"W{k}é" for k in range(300)]
    rows = [(10 * k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200])))) for k in range(60)]
    rows += [(1001 + k, rows[20][1]) for k in range(5)] + [(2, rows[30][1]), (2, rows[30][1]), (None, rows[31][1]), (None, "alone here now")]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows += [(3000, long), (3001, long + " end"), (4000, ""), (4001, None), (4002, " \t\n")]
    return rows


def test_components_of_documents(spark, make_docs, rng):
    rows = docs_of(rng)
    docs = make_docs(rows, extra=["fp", "component_id", "root", "a"])
    got = S.simhash_components(docs).collect()
    fp = {t: brute_fp(t) for _, t in rows}
    comp = brute_components(set(fp.values()))
    first = {}
    for i, t in rows:
        r = comp[fp[t]]
        if i is not None:
            first[r] = min(first.get(r, i), i)
    want = sorted(((i, f"{fp[t]:016x}", first.get(comp[fp[t]])) for i, t in rows), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


def test_one_of_each_group_stays(spark, make_docs, rng):
    rows = docs_of(rng)
    docs = make_docs(rows, extra=["fp", "root", "id", "kept", "row"])
    got = S.keep_one_per_component(docs)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect())
    comps = {r.component_id for r in S.simhash_components(docs).collect()}
    assert ids == sorted(-1 if c is None else c for c in comps)


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    assert S.simhash_components(docs).count() == 0
    assert S.keep_one_per_component(docs).count() == 0


def test_partitioning_does_not_matter(spark, make_docs, rng):
    docs = make_docs(docs_of(rng))
    a = sorted(map(str, S.simhash_components(docs.repartition(1)).collect()))
    assert a == sorted(map(str, S.simhash_components(docs.repartition(F.col("doc_id"))).collect()))
