"""The language model: gradients by differences, probabilities that sum to one, batched scoring against a
plain loop, counts against brute force, and gain over the base on held-out documents."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pulseboard.llm import lm as L
from pulseboard.llm.common import table
from llm_fixtures import make_docs, rng  # noqa: F401

SF = "/root/testdata/sf0.01"


def small_vocabulary(head=40):
    words = [L.END] + [f"w{k}".encode() for k in range(79)]
    counts = np.arange(160, 80, -1)
    tokens, kinds = np.zeros(L.FORMS, np.int64), np.zeros(L.FORMS, np.int64)
    for w, n in zip(words[head:], counts[head:], strict=True):
        tokens[L.form(w)] += n
        kinds[L.form(w)] += 1
    return L.Vocabulary(words, counts, head, int(counts.sum()), 80, tokens, kinds)


def random_weights(v, seed=1):
    rng = np.random.default_rng(seed)
    p = L.start_weights(v)
    return {k: (x + rng.normal(size=x.shape) * 0.3 * (np.abs(x) < 1e8)).astype(np.float32) for k, x in p.items()}


def plain(p, units, v):
    """One document, one step at a time."""
    h, before, total = np.zeros((1, L.HIDDEN), np.float32), v.units, 0.0
    for u in units:
        h = L.step(p["emb"][[before]] @ p["wx"] + p["b"], h, p["wh"])[0]
        total += float(L.output(p, h, np.array([u]), v)[0])
        before = u
    return total


def test_unit_probabilities_sum_to_one():
    v = small_vocabulary()
    p, h = random_weights(v), np.random.default_rng(2).normal(size=(1, L.HIDDEN)).astype(np.float32)
    assert np.exp(L.output(p, np.repeat(h, v.units, 0), np.arange(v.units), v)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_through_whole_documents():
    v = small_vocabulary()
    p, rng = random_weights(v), np.random.default_rng(3)
    docs = [rng.integers(0, v.units, n) for n in (1, 2, 300, 64, 65, 128, 5, 200)]
    for lanes in (2, 3, 8):
        got = L.log_likelihoods(p, docs, v, lanes)
        assert got == pytest.approx([plain(p, d, v) for d in docs], rel=1e-4)
    assert len(L.log_likelihoods(p, [], v)) == 0


def test_gradients():
    v = small_vocabulary()
    p = {k: x.astype(np.float64) for k, x in random_weights(v).items()}
    rng = np.random.default_rng(4)
    units, targets = rng.integers(0, v.units, (5, 3)), rng.integers(0, v.units, (5, 3))
    reset, live = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    reset[0, 1], reset[3, 0], live[4, 2] = True, True, False
    h0 = rng.normal(size=(3, L.HIDDEN)) * 0.1

    def loss(q):
        h, total = h0, 0.0
        for t in range(5):
            h = L.step(q["emb"][units[t]] @ q["wx"] + q["b"], np.where(reset[t][:, None], 0, h), q["wh"])[0]
            total -= L.output(q, h, targets[t], v)[live[t]].sum()
        return total / live.sum()

    g, _ = L.gradients(p, units, targets, live, h0, reset, v)
    for k in p:
        flat = p[k].reshape(-1)
        for i in rng.choice(len(flat), 12, replace=False):
            if abs(flat[i]) > 1e8:
                continue
            e, keep = 1e-3, flat[i]
            flat[i] = keep + e
            up = loss(p)
            flat[i] = keep - e
            down = loss(p)
            flat[i] = keep
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-4, rel=2e-2), k


def brute(rows):
    toks = {k: (t or "").encode().lower().split() + [b""] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for k, ws in toks.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(i, held[k], len(toks[k]), sum(c[w] > 0 for w in toks[k]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[k]), 6)) for k, (i, _) in enumerate(rows)], key=str)


def rows_of(rng):
    pool = [f"Wort{k}" for k in range(30)] + ["Été", "naïve,", "end.", "a-b", " x", "日本"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 4, 70])))) for k in range(80)]
    return rows + [(200 + k, f"only here {k} new{k}") for k in range(20)] + [(300, None), (301, ""), (302, " \t\n"), (303, "long text " * 30_000), (None, "Wort1"), (4, rows[4][1])]


@pytest.mark.parametrize("known,head", [(100_000, 512), (20, 8)])
def test_counts_match_brute_force(spark, make_docs, rng, known, head):
    rows = rows_of(rng)
    got = L.score_documents(make_docs(rows, extra=["word", "n", "row", "rare"]).repartition(4), known=known, head=head, rounds=1, budget=2000).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_forms_of_a_list():
    words = [L.END, b"a", b"ab", b"ab.", b"c,", b"-", b".", b"7", "Été".lower().encode(), "日本.".encode(), b"x\x00", b"e9", "é".encode(), b"B2)"]
    assert L.forms(b" ".join(words), words).tolist() == [L.form(w) for w in words]
    assert L.forms(b"", [b""]).tolist() == [L.form(b"")]


def test_texts_are_split_once(spark, make_docs, rng):
    """Counting, training and scoring need the chunks only; these hold every token, also of a text with more
    distinct words than a short integer counts, and of empty, null and repeated ones."""
    rows = [*rows_of(rng), (400, " ".join(f"x{k}" for k in range(70_000))), (None, None), (400, "x1 x1 É")]
    docs = make_docs(rows).select("doc_id", "text").repartition(3)
    chunks = L.stored(L.split_texts(docs), "chunks").drop("text")
    got = []
    for r in chunks.collect():
        words, sizes = r.words.split(b" "), np.frombuffer(r.sizes, np.int64)
        places = np.frombuffer(r.places, L.place_kind(len(words)))
        learn, tally = np.frombuffer(r.learn, bool), np.frombuffer(r.tally, np.int64)
        assert len(r.ids) == len(sizes) == len(learn) and len(set(words)) == len(words) == len(tally)
        at = np.split(places, np.cumsum(sizes)[:-1])
        got += [(i, [words[k] for k in x]) for i, x in zip(r.ids, at, strict=True)]
        assert tally.tolist() == sum((np.bincount(x, minlength=len(words)) for x, k in zip(at, learn, strict=True) if k), np.zeros(len(words), int)).tolist()
    assert sorted(got, key=str) == sorted([(i, L.tokens((t or "").encode())) for i, t in rows], key=str)
    counts = {bytes(r.word): r.n for r in L.count_words(chunks).collect()}
    assert counts == {bytes(r.word): r.n for r in L.count_words(docs).collect()} and sum(counts.values()) == brute(rows)[0][4]
    v = L.vocabulary(L.count_words(chunks), 1000, 64)
    assert L.train(chunks, v, 1, 1 << 20) == pytest.approx(L.train(docs, v, 1, 1 << 20), abs=1e-5)


def test_large_weights():
    """Beyond the bound within which exp neither overflows nor vanishes, the greatest is taken off first."""
    v = small_vocabulary()
    p, rng = random_weights(v), np.random.default_rng(5)
    p["bc"][:3] += 200
    p["wc"][:, 5] *= 300
    p["bw"][0, 4] += 300
    wc, ww = L.output_layers(p)
    assert not L.bounded(wc) and not L.bounded(ww)[0]
    h = rng.uniform(-1, 1, (1, L.HIDDEN)).astype(np.float32)
    assert np.exp(L.output(p, np.repeat(h, v.units, 0), np.arange(v.units), v)).sum() == pytest.approx(1, abs=1e-4)
    units = rng.integers(0, v.units, (6, 4))
    g, last = L.gradients(p, units, units, np.ones((6, 4), bool), np.zeros((4, L.HIDDEN), np.float32), np.zeros((6, 4), bool), v)
    assert all(np.isfinite(x).all() for x in (*g.values(), last))


def test_gain_on_held_out_documents(spark):
    got = L.score_documents(table(spark, SF, "documents")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.1


def test_nothing_to_learn_from(spark, make_docs):
    assert L.score_documents(make_docs([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = L.score_documents(make_docs([(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_every_training_token_is_learned_from(spark, make_docs, rng):
    """Also of one long document, of many copies of a row and of a table in a single partition; the weights do
    not depend on the partitions."""
    rows = rows_of(rng)
    weights = []
    for parts in (1, 5):
        docs = make_docs(rows).select("doc_id", "text").repartition(parts)
        v = L.vocabulary(L.count_words(docs), 1000, 64)
        got = L.training_units(docs, v, 7).collect()
        assert sum(len(r.units) // 2 - 1 for r in got) == v.total == brute(rows)[0][4]
        assert max(len(r.units) // 2 - 1 for r in got) <= L.SEGMENT and len({r.grp for r in got}) == 7
        weights.append(L.train(docs, v, 1, 10_000))
    assert weights[0] == pytest.approx(weights[1], abs=1e-5)
    assert np.abs(weights[0] - L.flat(L.start_weights(v))).max() > 1e-3
    copies = make_docs([(None, "the same text in all rows")] * 400).select("doc_id", "text").coalesce(1)
    sizes = [r["count"] for r in L.training_units(copies, v, 10).groupBy("grp").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200
