"""Alignment of two tokenizers against a plain walk over all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulseboard.llm import alignment as A
from pulseboard.llm.vocab import byte_bpe
from llm_fixtures import make_docs, rng  # noqa: F401

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def plain():
    """(A ids, B ids, A byte lengths, B byte lengths) of a text by the two libraries, or None."""
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    level = {}
    k = 0
    for b in range(256):  # byte-level: bytes that don't print are moved up from U+0100 on
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        level[chr(b if shown else 256 + k)] = b
        k += not shown

    def a_bytes(i):
        return bytes(level[c] for c in t.id_to_token(i))

    def b_bytes(i):
        p = m.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        want = (" " + text).encode()
        if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
            return None
        return a, b, [len(a_bytes(i)) for i in a], [len(b_bytes(i)) for i in b]
    return run


def brute(rows, plain):
    docs, total = [], Counter()
    for i, text in rows:
        got = plain(text)
        if got is None:
            docs.append((i, None))
            continue
        a, b, la, lb = got
        ea, eb = np.cumsum(la).tolist(), np.cumsum(lb).tolist()
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if max(ea[x] - la[x], eb[y] - lb[y]) < min(ea[x], eb[y])]
        groups, x, y = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x2, y2 = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, a[x:x2])) + "|" + ",".join(map(str, b[y:y2])))
            x, y = x2, y2
        docs.append((i, (len(a), len(b), groups, links)))
        total.update(links)
    most = {}
    for (_, y), n in total.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, g, links = d
            out.append((i, na, nb, len(g), len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest()))
    return out, total


TEXTS = [None, "", " ", "a", "Hello world", "Hello  world", "x\n\ny\tz", "naïve café – 東京 🎉", "a ▁ b", "<s> </s> <unk> <|endoftext|>", " nbsp", "antidisestablishmentarianism " * 30,
         "the the the the " * 50, "<0x0A> x", "ﬁ ligature Ⅷ", "tail  "]


def test_rows(spark, make_docs, rng, plain):
    words = "the of and tokenisation misaligned, 1234567 über straße 東京都 foo_bar() don't".split()
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(40)]
    rows += [(4, "Hello world")] * 5 + [(None, "Hello world"), (None, None)]
    want, total = brute(rows, plain)
    docs = make_docs(rows, extra=["pair", "n_best", "chunk"]).repartition(5)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in A.align(docs, *PATHS).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    pairs = {(r.a, r.b): r.links for r in A.pair_table(docs, *PATHS).collect()}
    assert pairs == dict(total)
    assert A.align(make_docs([]), *PATHS).count() == 0


def test_many_chunks_give_the_same(spark, make_docs, rng, plain):
    rows = [(k, " ".join(rng.choice("of the and is it".split()) for _ in range(9))) for k in range(60)]
    want, _ = brute(rows, plain)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        docs = make_docs(rows).coalesce(2)
        assert A.aligned(docs, *PATHS, postings=1).select("chunk").distinct().count() > 8
        got = A.align(docs, *PATHS, postings=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in got) == sorted((w[0], w[5], w[6]) for w in want)


def test_bitmaps_give_back_their_postings(rng):
    places = {7: range(0, 65536, 2), 9: [0, 65535], 11: range(4095), 12: range(4096), 13: [5]}
    postings = np.array(sorted(p << 16 | x for p, xs in places.items() for x in xs), np.int64)
    counts = np.array([1 + (i * 7 % 23) * (i % 5 == 0) for i in range(len(postings))], np.int64)
    back = Counter()
    for plane, (pairs, n, bits) in A.planes(postings, counts):
        for p, k, x in zip(pairs.tolist(), n.tolist(), bits.to_pylist(), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if len(x) == 8192 else np.frombuffer(x, np.uint16)
            assert len(at) == k and len(x) <= 8192
            for y in at.tolist():
                back[p << 16 | y] += 1 << max(plane - 1, 0)
    assert back == dict(zip(postings.tolist(), counts.tolist(), strict=True))


def test_long_white_space():
    v = byte_bpe(PATHS[0], PATHS[1], True)
    t = Tokenizer.from_file(PATHS[0])
    for text in ("a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" + " \n\t" * 700_000):
        assert v.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
