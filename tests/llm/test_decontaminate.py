"""Decontamination: planted copies and paraphrases found, clean documents left alone, the pieces by brute force."""

import numpy as np

from pulseboard.llm import decontaminate as D
from pulseboard.llm.common import table
from llm_fixtures import make_docs, rng  # noqa: F401

SF = "/root/testdata/sf0.1"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence(rng):
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(90))] for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a, b)


def test_svd_spans_the_passages(spark, rng):
    idf = np.ones(1 << D.BITS)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(20)) for _ in range(25)]
    frame = spark.createDataFrame([(k, bytearray(D.words(t).tobytes())) for k, t in enumerate(texts)], "place int, words binary")
    rows = D.passage_rows(frame, idf, 64, 32)
    features, basis = D.randomised_svd(rows, 25)
    a = np.zeros((25, len(features)))
    for r in rows.collect():
        a[r.place, np.searchsorted(features, r.features)] = r.weights
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-6)
    _, small = D.randomised_svd(rows, 10, rounds=6)
    best = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a @ small) ** 2 >= 0.97 * (best[:10] ** 2).sum()


def test_every_verbatim_item_is_found_and_nothing_else(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    norm = lambda t: " ".join(map(str, D.words(t)))
    items = [(r.item_id, " " + norm(r.text) + " ") for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [" " + norm(r.text) + " "] for i, w in items if w in t}
    got = {(r.doc_id, r.item_id): r for r in D.find_contamination(docs, bench).collect()}
    assert want <= set(got) and len(set(got) - want) <= 0.02 * len(want)
    assert len(want) > 100


ITEMS = ["Which river crosses the old town of Hallgarten before the mill? The stream named Weissach does so", "one two three four five six seven eight nine ten eleven twelve. thirteen fourteen fifteen"]


def filler(rng, n):
    return " ".join(f"filler{rng.randrange(400)}" for _ in range(n))


def test_paraphrase_needs_the_answer(spark, make_docs, rng):
    bench = spark.createDataFrame([(1, ITEMS[0], "stream named Weissach", 3), (2, ITEMS[1], None, 3), (3, None, None, 3), (4, "", None, 3)], "item_id bigint, text string, answer string, place int")
    para = "which river flows across the old town called Hallgarten before a mill?"
    rows = [(10, f"{filler(rng, 70)} {ITEMS[0]} {filler(rng, 33)}"), (11, ITEMS[1].upper().replace(" ", " -- ")), (12, f"{filler(rng, 21)} {para} it is the stream named Weissach {filler(rng, 50)}"),
            (13, f"{filler(rng, 21)} {para} nobody can tell {filler(rng, 50)}"), (14, None), (15, ""), (16, filler(rng, 60_000) + " " + ITEMS[1] + " " + filler(rng, 100)), (None, ITEMS[1])]
    rows += [(100 + k, filler(rng, 90)) for k in range(40)] + [(10, rows[0][1])]
    docs = make_docs(rows, extra=["words", "item_id", "cosine", "bad", "id", "row"])
    for block in (512, 1):
        got = {(r.doc_id, r.item_id) for r in D.find_contamination(docs, bench, block=block).collect()}
        assert got == {(10, 1), (11, 2), (12, 1), (16, 2), (None, 2)}
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [13, 14, 15] + list(range(100, 140))


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "some words in a row")], "item_id bigint, text string")
    docs = make_docs([(1, "some words in a row")])
    assert D.find_contamination(make_docs([]), bench).count() == 0
    assert D.find_contamination(docs, bench.limit(0)).count() == 0
    assert D.find_contamination(docs, bench).count() == 1


def test_short_items_and_paraphrases_near_the_share(spark, make_docs, rng):
    """Items of 3 to 12 words word for word, and paraphrases just above the share with the answer, among
    rarer words than their own; below the share nothing is found."""
    common = [f"w{k}" for k in range(300)]
    items, rows, want = [], [(5000 + k, " ".join(rng.choices(common, k=200)) + f" only{k}") for k in range(200)], set()
    for k in range(60):
        n = 3 + k % 10
        items.append((k, " ".join(rng.sample(common, n))))
        rows.append((k, f"{' '.join(f'x{rng.randrange(10**6)}' for _ in range(40))} {items[-1][1]} {' '.join(f'y{rng.randrange(10**6)}' for _ in range(40))}"))
        want.add((k, k))
    for k in range(100, 130):
        head, tail = rng.sample(common, 20), rng.sample(common, 5)
        items.append((k, " ".join(head) + ". " + " ".join(tail)))
        for doc, same in ((k, 10), (k + 100, 9)):  # 15 of 25 words are the share, 14 are below
            keep = set(rng.sample(range(20), same))
            said = [w if j in keep else f"z{rng.randrange(10**6)}" for j, w in enumerate(head)] + tail
            rows.append((doc, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(said) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))))
        want.add((k, k))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_contamination(make_docs(rows), bench).collect()}
    assert want <= got
    assert not [x for x in got if x[1] >= 100 and x[0] != x[1]]


def test_anchored_search_leaves_nothing_out(rng):
    """Against the check of every stretch of twice an item's length."""
    idf, pool = np.ones(1 << D.BITS), [f"w{k}" for k in range(12)]
    idf[D.words(" ".join(pool))] = [1 + k / 3 for k in range(12)]
    items = [D.Item(k, D.words(t).tolist(), D.words(t).tolist()[-2:]) for k, t in enumerate(" ".join(rng.choices(pool, k=n)) for n in (1, 2, 3, 3, 4, 5, 7, 9, 12))]
    docs = [D.words(" ".join(rng.choices([*pool * 3, *[f"far{k}" for k in range(30)]], k=n))) for n in (0, 1, 5, 30, 90, 200, 3)]
    features = np.unique(np.concatenate([x.words for x in items]))
    s = D.Searcher(items, idf, features, np.eye(len(features)), [(k, x.words) for k, x in enumerate(items)], 0.5)
    bounds, checks = np.concatenate([[0], np.cumsum([len(x) for x in docs])]), (0.8, 0.6, 0.8)
    got = {x[:2] for x in s.anchored(np.concatenate(docs), bounds, checks)}
    want = {(d, k) for d, w in enumerate(docs) for k, x in enumerate(items) for a in range(len(w)) if s.confirm(x, w[a:a + 2 * len(x.words)].tolist(), *checks)[2]}
    assert want <= got and len(want) > 5
