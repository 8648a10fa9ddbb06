"""Personal data: base spans against plain patterns, message passing against enumeration, consistent labels."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest

from pulseboard.llm import pii as P
from llm_fixtures import make_docs, rng  # noqa: F401


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    """The contract, pattern by pattern, failing matches dropped after matching."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def number(rng, start="4", n=16):
    d = start + "".join(rng.choice("0123456789") for _ in range(n - len(start) - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def fake(rng):
    k = rng.randrange(4)
    if k == 0:
        return f"{rng.choice(['anna', 'li.wei', 'ott'])}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
    if k == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return number(rng) if k == 2 else f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"


def prose(rng, n):
    return " ".join(rng.choice("the report of call and from write to was house river 2024 item 12 v3.1 7 pages".split()) for _ in range(n))


def test_base_spans(rng):
    texts = ["", "a@b", "a@b.c", "x a@b.c_d@e.f", "@a.b", "a@@b.c", "a@b..c", "a@b.c.@d.e", "é1.2.3.4.5.6.7.8", "1.2.3.256", "0001.2.03.255", "1.2.3", "+1 (017) 555-7713 x", "+1555", "++1 234 567 890",
             "+1234567890123456", "+12 345 (678) 90.", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+49 30 123456 10.0.0.1"]
    texts += ["".join(rng.choice("0123456789+@.-() ab%_") for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += [number(rng, n=n) for n in range(10, 22)]
    for t in texts:
        assert [(P.KINDS[k], a, b) for k, a, b in P.base_spans(t)] == brute_base(t), t


def test_long_runs_take_linear_time():
    t0 = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+" * 500_000, "+1(" * 200_000, "@" * 500_000, "a@b." * 200_000, "1-" * 500_000):
        P.base_spans(text)
        list(P.WORD.finditer(text))
    assert time.perf_counter() - t0 < 60


def enumerated(node, edges):
    n, k = node.shape
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum(node[i, y[i]] for i in range(n)) + sum(pot[y[a], y[b]] for e, pot in edges for a, b in e)
        for i in range(n):
            out[i, y[i]] += np.exp(s)
    return out / out.sum(1, keepdims=True)


def test_message_passing():
    r = np.random.default_rng(3)
    node, chain, skip = r.normal(size=(6, 3)), r.normal(size=(3, 3)), r.normal(size=(3, 3))
    skip = skip + skip.T
    tree = [(np.array([[0, 1], [1, 2], [3, 4]]), chain), (np.array([[2, 3], [0, 5]]), skip)]
    assert np.allclose(P.beliefs(node, tree, damping=0.0), enumerated(node, tree), atol=1e-9)
    loop = [(np.array([[0, 1], [1, 2], [2, 3], [3, 4], [4, 5]]), 0.5 * chain), (np.array([[0, 3], [1, 4]]), 0.3 * skip)]
    assert np.abs(P.beliefs(node, loop) - enumerated(node, loop)).max() < 0.06
    assert np.allclose(P.beliefs(node, []), np.exp(node) / np.exp(node).sum(1, keepdims=True))


@pytest.fixture(scope="module")
def field(spark):
    import random
    rng = random.Random(8)
    rows = [(k, " ".join(prose(rng, rng.randrange(3, 30)) + " " + (fake(rng) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 5)))) for k in range(600)]
    return P.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))


def added(text, field):
    base = P.base_spans(text)
    g = P.graph_of(text, base)
    return [(P.KINDS[k], text[a:b]) for k, a, b in P.added_spans(text, base, g, P.labelled([g], field)[0])] if g else []


def test_mentions_that_resemble_a_found_one_are_added(field, rng):
    for _ in range(30):
        tail = f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        assert added(f"{prose(rng, 30)} call +1 {tail} then {prose(rng, 200)} call {tail} then {prose(rng, 20)}", field) == [("phone", tail)]
        name = f"li.wei.{rng.randrange(100, 999)}"
        assert added(f"write to {name}@mail3.example.com {prose(rng, 100)} from {name}, then {prose(rng, 9)}", field) == [("email", name)]
        # the last digits make it alike, though no pattern takes it
        d = f"{rng.randrange(10**9, 10**10)}"
        assert ("phone", d) in added(f"+1 {d} and {prose(rng, 60)} call {d} then {prose(rng, 9)}", field)


def test_others_stay(field, rng):
    for _ in range(100):
        assert added(prose(rng, 300), field) == []
    for text in ("page 12 of 2024", "1999-06-30 10:15 v3.1.4", "costs 1,234.50 at 7%", "id 20240131 rev 3", "4952935900253051 in 2024"):
        assert added(text, field) == []


def test_rows(spark, make_docs, rng, field):
    texts = [None, "", "none", " ".join(fake(rng) for _ in range(30)), "🎉 anna.1@mail1.example.com é " * 3, ("1 " * 50_000) + "a.b@c.de", "x" * 300_000 + "@b.c", prose(rng, 50) + fake(rng)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]
    got = P.find_personal(make_docs(rows, extra=["spans", "n_card", "label"]), field).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        base = brute_base(t or "")
        want[i] = (*[sum(x[0] == k for x in base) for k in P.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
        for r in got:
            if r.doc_id == i:
                assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",") if r.spans else [])
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id]
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - (r.n_email + r.n_ip + r.n_card + r.n_phone)
    assert P.find_personal(make_docs([])).count() == 0


def test_learning_does_not_depend_on_partitions(spark, rng):
    rows = [(k, prose(rng, 10) + " " + fake(rng)) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = P.learn(df.coalesce(1)), P.learn(df.repartition(7))
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.skip, b.skip) and np.array_equal(a.chain, b.chain)


def test_sample_stays_bounded(spark, rng):
    rows = [(k, f"{k} {rng.random()} {prose(rng, 4)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert P.learn(df, limit=100).unary.shape == (P.FEATURES, P.LABELS)
