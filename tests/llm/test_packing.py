"""Packing: round trip of every id, no padding, the deficits against a replayed round-robin."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseboard.llm import packing as P
from llm_fixtures import make_docs, rng  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def replay(totals, quanta, packet):
    """Deficit round-robin, packet by packet: (queue, tokens) in the order sent."""
    sent, deficit, out = [0] * len(totals), [0] * len(totals), []
    while any(s < t for s, t in zip(sent, totals, strict=True)):
        for q, t in enumerate(totals):
            if sent[q] < t:
                deficit[q] += int(quanta[q])
                n = deficit[q] // P.UNIT
                deficit[q] -= n * P.UNIT
                n = min(n * packet, t - sent[q])
                sent[q] += n
                if n:
                    out.append((q, n))
    return out


@pytest.mark.parametrize("totals,shares,window,packet", [
    ([5000, 3000, 70, 1], [5000, 3000, 70, 1], 256, 8), ([900], [1], 64, 8), ([4000, 4000], [9, 1], 128, 16), ([3000, 500, 40], [1, 1, 0], 64, 4), ([64, 64], [1, 1], 128, 64)])
def test_closed_form_is_the_replayed_round_robin(rng, totals, shares, window, packet):
    r = P.Rounds(totals, shares, window, packet)
    stream = np.concatenate([np.full(n, q) for q, n in replay(totals, r.quanta, packet)])
    got = np.full(sum(totals), -1)
    for q, t in enumerate(totals):
        cuts = sorted({0, t, *[rng.randrange(t) for _ in range(9)]})
        n = np.diff(cuts)
        d, start, length, pos, seq, off = r.pieces(np.full(len(n), q), np.array(cuts[:-1]), n)
        assert sorted(zip(d, start)) == list(zip(d, start))
        for k in range(len(n)):
            mine = d == k
            assert length[mine].sum() == n[k] and (np.cumsum(length[mine])[:-1] == start[mine][1:]).all()
        for p, m in zip(pos, length, strict=True):
            assert (got[p:p + m] == -1).all()
            got[p:p + m] = q
        assert (off >= 0).all() and (off + length <= window).all()
    assert (got == stream).all()


def check_pack(rows, got, window):
    want = {}
    for (i, t), x in zip(rows, ids_of([t for _, t in rows]), strict=True):
        want.setdefault(i, []).append(x)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length > 0
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    for i, x in want.items():
        mine = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(n for _, n in mine) == sum(map(len, x))
    lengths = []
    for k in sorted(seqs):
        at = 0
        for off, n in sorted(seqs[k]):
            assert off == at
            at += n
        lengths.append(at)
    assert sorted(seqs) == list(range(len(seqs)))
    rest = [n for n in lengths if n != window]
    assert all(n & (n - 1) == 0 for n in rest) and len(set(rest)) == len(rest)


def test_documents(spark, make_docs, rng):
    words = ["the", "Éa", "thnt!!", "1234", "<|endoftext|>", "  ", "\n"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 900])))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 50_000), (103, " " * 20_000), (5, rows[5][1]), (None, "no id here")]
    docs = make_docs(rows, extra=["queue", "chunk", "offset"]).repartition(5)
    for mixture in (None, {"s0": 0.7, "s1": 0.3}):
        check_pack(rows, P.pack(docs, RANKS, 128, 8, mixture).collect(), 128)


def test_windows_hold_the_mixture(spark, make_docs):
    docs = make_docs([(k, "word " * (300 if k % 3 else 900)) for k in range(60)])
    total = {}
    per = {}
    for r in P.pack(docs, RANKS, 256, 8).collect():
        total[r.queue] = total.get(r.queue, 0) + r.length
        per.setdefault(r.sequence_id, {}).setdefault(r.queue, 0)
        per[r.sequence_id][r.queue] += r.length
    n = sum(total.values())
    for s in list(per)[1:-12]:
        if sum(per[s].values()) == 256:
            assert all(abs(per[s].get(q, 0) / 256 - total[q] / n) <= 24 / 256 for q in total)


def test_empty_and_too_many(spark, make_docs):
    assert P.pack(make_docs([]), RANKS).count() == 0
    docs = make_docs([(k, "x") for k in range(9)]).withColumn("source", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="queues"):
        P.pack(docs, RANKS, max_queues=8)


def test_ids_equal_the_tokenizers_library(rng):
    enc = P.encoder(RANKS)
    texts = ["".join(chr(rng.choice([32, 10, 33, 65, 97, 233, 0x4E2D, 0x1F600, 48])) for _ in range(300)) for _ in range(200)]
    assert [enc.encode_ordinary(t) + [0] for t in texts] == ids_of(texts)


def test_added_tokens_as_the_tokenizers_library_has_them(spark, make_docs, tmp_path, rng):
    """Default settings of the reference, on texts that hold the marker; also as the query packs them."""
    from pulseboard.llm import registry

    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "Éa", " the", "12", "  "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(30))) for k in range(80)] + [(100, "a <|endoftext|> b"), (101, "<|endoftext|>"), (102, None)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    assert want[100] == [64, 220, 50256, 275, 0]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op2_packing(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())


def test_any_number_of_queues(spark, make_docs):
    """More sources than queues: every id once, the large ones' proportions in the windows, the mixture's names."""
    rows = [(k, "word " * (400 if k < 40 else 1 + k % 7)) for k in range(1300)]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") < 40, F.concat(F.lit("big"), F.col("doc_id") % 2)).otherwise(F.concat(F.lit("site"), F.col("doc_id")))).repartition(4)
    source = {r.doc_id: r.source for r in docs.collect()}
    assert len(set(source.values())) == 1262
    for options in ({}, {"own": 2, "folded": 8}, {"own": 1, "folded": 3, "mixture": {"big0": 0.5, "big1": 0.4, "site77": 0.1}}):
        got = P.pack(docs, RANKS, 128, 8, **options).collect()
        check_pack(rows, got, 128)
        assert all(r.queue == source[r.doc_id] for r in got)
        if "mixture" in options:
            first = [r for r in got if r.sequence_id < 20]
            assert 0.4 <= sum(r.length for r in first if r.queue == "big0") / sum(r.length for r in first) <= 0.65


def test_very_long_white_space(spark, make_docs):
    rows = [(0, "a" + " " * 2_000_000 + "b"), (1, "\n" * 2_000_000), (2, "x" + " \n" * 1_000_000 + "<|endoftext|>"), (3, "z")]
    check_pack(rows, P.pack(make_docs(rows), RANKS).collect(), 1024)
    for k, t in rows:
        want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids
        assert P.token_ids(RANKS, public_tokenizers.path("byte_bpe_50k.json"), t).tolist() == want
