"""Periodic runs against a plain search of every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from pulseboard.llm import runs as R
from llm_fixtures import make_docs, rng  # noqa: F401


def brute_runs(words, least=24, times=3):
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + size for a, size, q in runs)]
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{a},{s},{q}\n" for a, s, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def found(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([ids[w] for w in words], np.int64)
    return sorted((a + s, size, q) for a, b in R.segments(x, np.zeros(len(x), np.int64), 24, 3) for s, size, q in R.lag_scan(x[a:b], 24, 3))


def test_runs_equal_the_plain_search(rng):
    for trial in range(400):
        words = [rng.choice("abcdefghijkl"[:rng.choice([1, 2, 3, 6, 12])]) for _ in range(rng.randrange(0, 160))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 20))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 12)[:rng.randrange(1, 120)]
        assert found(words) == sorted(brute_runs(words)), words


def test_splitting_is_recursive():
    # "x" is rare as a whole; without it "b" is rare on each side, and only then nothing is left
    words = ["b", "b"] + ["a"] * 20 + ["x"] + ["a"] * 20 + ["b"] + ["c"] * 30
    x = np.array([ord(w) for w in words], np.int64)
    assert R.segments(x, np.zeros(len(x), np.int64), 24, 3) == [(44, 74)]
    assert R.segments(np.array([], np.int64), np.array([], np.int64), 24, 3) == []


def test_words_that_fool_sums_of_powers():
    # Thue-Morse sequences have equal polynomial hashes modulo a power of two
    t = "".join(str(bin(i).count("1") % 2) for i in range(2048))
    inverse = t.translate(str.maketrans("01", "10"))
    words = list((t + inverse + t) * 2 + t)
    assert found(words) == sorted(brute_runs(words))


def test_a_long_text_in_little_time():
    n = 300_000
    assert found(["a"] * n) == [(0, n, 1)]
    words = [str(i % 997) for i in range(n)]
    assert found(words) == [(0, n, 997)]
    rng = random.Random(3)
    assert found([str(rng.randrange(50)) for _ in range(n)]) == []


def test_rows(spark, make_docs, rng):
    loops = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    text = " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(300))
    texts = [None, "", " \t\n", "a", "a " * 24, "a " * 23, "\x0bx\x1cy z\x85 " * 20, "die　 die " * 30, "one two " * 20 + "one", text, "long " * 40_000]
    rows = [(i, t) for i, t in enumerate(texts, 1000)] + [(i, t) for i in loops for t in (text, "", "w")] + [(1009, text), (None, text), (None, None)]
    got = R.run_digest(make_docs(rows, extra=["runs", "period", "collapsed"])).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute_row(i, t) if (t or "") != "long " * 40_000 else None)
    for r in got:
        mine = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        if r.n_words == 40_000:
            assert mine[:5] == (1, 0, 40_000, 1, 40_000_000)
        else:
            assert mine in want[r.doc_id]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert R.run_digest(make_docs([])).count() == 0


def test_collapsed_text_and_runs(spark, make_docs):
    r = R.find_runs(make_docs([(1, "start " + "ha ho " * 20 + "end")])).first()
    assert [tuple(x) for x in r.runs] == [(1, 40, 2)] and r.collapsed == "start ha ho end" and r.n_words == 42
