"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A round visits the queues in order; a queue's deficit
grows by its quantum (its share of a window) and it sends whole packets while the deficit covers them;
the rest of the deficit is carried to the next round. The stream of rounds is cut into windows, so every
window holds the target proportions to within a packet a queue. A queue that has run dry leaves its
share to the others.

What a queue has sent after k rounds has a closed form, so the state that rounds hand on (deficits, and
with them the place of every packet in the stream) can be computed anywhere: each task places its own
documents from the queues' totals and its documents' places in their queues, which a two-step running
sum gives. Nothing is gathered or replayed in one place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import column, out_batch, pieces, stored
from .vocab import LONG_SPACE, byte_bpe

END_ID = 0  # closes every document
UNIT = 1 << 20  # quanta are counted in this part of a packet


@cache
def encoder(path: str, added: str | None = None):
    """The tokenizer of a rank file (token bytes in base64, rank) with the added tokens of a tokenizer's JSON."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(added) if added else {})


def added_tokens(path: str) -> dict[str, int]:
    """Token to id of the added tokens, which are matched as they stand in a text."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(x[k] for x in found for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take in what stands beside them")
    return {x["content"]: x["id"] for x in found}


def token_ids(ranks: str, added: str | None, text: str) -> np.ndarray:
    """Ids of one text. The rank file's library can't take a very long run of white space: such a text goes to
    the tokenizers library with the same vocabulary."""
    if len(text) >= 50_000 and LONG_SPACE.search(text):
        import public_tokenizers

        return byte_bpe(added or public_tokenizers.path("byte_bpe_50k.json"), ranks, added is None).ids(text)
    return encoder(ranks, added).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32)


def tokenized(docs: DataFrame, ranks: str, queue: str, added: str | None = None) -> DataFrame:
    """(doc_id, queue, chunk, chunk_start, n_tokens, ids): ids as little-endian unsigned 32-bit, the end id
    last; chunk is the task that wrote the row, chunk_start the tokens of its queue before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sent = TaskContext.get().partitionId(), {}
        end = np.array([END_ID], np.uint32)
        for b in pieces(batches, 8 << 20):
            ids = [np.concatenate([token_ids(ranks, added, t or ""), end]) for t in column(b, "text")]
            queues, starts = column(b, "queue"), []
            for q, x in zip(queues, ids, strict=True):
                starts.append(sent.get(q, 0))
                sent[q] = starts[-1] + len(x)
            yield out_batch(doc_id=pa.array(column(b, "doc_id"), pa.int64()), queue=pa.array(queues, pa.string()), chunk=pa.array([chunk] * len(ids), pa.int64()),
                            chunk_start=pa.array(starts, pa.int64()), n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids=pa.array([x.tobytes() for x in ids], pa.binary()))

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(queue).cast("string"), F.lit("")).alias("queue"))
    return wanted.mapInArrow(run, "doc_id bigint, queue string, chunk bigint, chunk_start bigint, n_tokens bigint, ids binary")


class Rounds:
    """The closed form of the rounds. totals: tokens of each queue; shares: target proportions."""

    def __init__(self, totals: list[int], shares: list[float], window: int, packet: int):
        self.totals, self.window, self.packet = np.array(totals, np.int64), window, packet
        whole = sum(shares) or 1
        #: What a queue's deficit gains in a round, in UNIT-th packets; the least share still moves on.
        self.quanta = np.array([max(1, round(s / whole * window / packet * UNIT)) for s in shares], np.int64)
        #: Rounds after which a queue is dry; also keeps the products below from growing too large.
        self.dry = -(-(-(-self.totals // packet) * UNIT) // self.quanta)
        n = int(self.totals.sum())
        self.full, rest = divmod(n, window)
        #: Lengths of the last sequences: powers of two, so that nothing is padded.
        self.tail = np.cumsum([0] + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1])

    def sent(self, k: np.ndarray, q) -> np.ndarray:
        """Tokens that queue q has sent after k rounds."""
        return np.minimum(self.totals[q], self.packet * (np.minimum(k, self.dry[q]) * self.quanta[q] // UNIT))

    def place(self, k: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Where in the stream queue q begins its turn of round k."""
        out = np.zeros(len(k), np.int64)
        for r in range(len(self.totals)):
            out += self.sent(np.where(r < q, k, k - 1), r)
        return out

    def sequence(self, at: np.ndarray) -> np.ndarray:
        full = self.full * self.window
        return np.where(at < full, at // self.window, self.full + np.searchsorted(self.tail, at - full, side="right") - 1)

    def begin(self, seq: np.ndarray) -> np.ndarray:
        return np.minimum(seq, self.full) * self.window + self.tail[np.clip(seq - self.full, 0, len(self.tail) - 1)]

    def pieces(self, q: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents (queue, place in it, tokens): (document, first token, tokens, place in the stream) of
        every piece, by document and token, cut at packets of one round and at sequences."""
        first, last = start // self.packet, (start + n - 1) // self.packet
        doc = np.repeat(np.arange(len(n)), last - first + 1)
        i = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
        k = -((-(i + 1) * UNIT) // self.quanta[q[doc]])  # the round in which the deficit covers packet i
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(doc)) - 1
        d, k = doc[at], k[at]
        a = np.maximum(start[d], i[at] * self.packet)
        b = np.minimum(start[d] + n[d], (i[ends] + 1) * self.packet)
        pos = self.place(k, q[d]) + a - self.sent(k - 1, q[d])
        # neighbours that touch in the stream are one piece
        touch = np.zeros(len(d), bool)
        touch[1:] = (d[1:] == d[:-1]) & (pos[1:] == pos[:-1] + (b - a)[:-1])
        at = np.flatnonzero(~touch)
        d, a, b, pos = d[at], a[at], b[np.append(at[1:], len(touch)) - 1] if len(at) else b[:0], pos[at]
        # cut at sequences
        s0, s1 = self.sequence(pos), self.sequence(pos + (b - a) - 1)
        m = s1 - s0 + 1
        j = np.repeat(np.arange(len(m)), m)
        seq = np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m) + s0[j]
        lo = np.maximum(pos[j], self.begin(seq))
        hi = np.minimum((pos + b - a)[j], self.begin(seq + 1))
        return d[j], (a - start[d])[j] + lo - pos[j], hi - lo, lo, seq, lo - self.begin(seq)


def pack(docs: DataFrame, ranks: str, window: int = 1024, packet: int = 32, mixture: dict[str, float] | None = None,
         queue: str = "source", max_queues: int | None = None, added: str | None = None, own: int = 744, folded: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    A document is its token ids, then id 0; null text counts as empty and still has that id. Every id lies
    in exactly one piece. Sequences hold ``window`` ids; the rest at the end goes to sequences of falling
    powers of two, so nothing is padded. ``mixture``: target shares by queue (null queue: ''); queues that it
    doesn't name come last, a crumb at a time; None: the queues' shares of all tokens. A null doc_id is
    carried along, repeated rows are packed as often as they stand there, an empty table gives no pieces.
    ``added``: JSON of the tokenizer whose added tokens (such as <|endoftext|>) are found in the texts and
    stand as their ids; None: they are read as ordinary text.
    Any number of queues: beyond ``own`` + ``folded`` of them, those that the mixture names and the ``own``
    largest stay queues by themselves, the others stand one after another in ``folded`` queues by hash, whose
    shares are the sums of theirs. More than ``max_queues`` raise, if given."""
    rows = stored(tokenized(docs, ranks, queue, added), "tokens")
    chunks = rows.groupBy("queue", "chunk").agg(F.sum("n_tokens").alias("n"))
    before = chunks.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = stored(before, "queue_starts")  # small, and known to be: the ids needn't be shuffled to meet it
    sums = stored(rows.groupBy("queue").agg(F.sum("n_tokens").alias("n")), "queue_totals")
    distinct = sums.count()
    if max_queues is not None and distinct > max_queues:
        raise ValueError(f"more than {max_queues} queues in {queue}")
    named = {} if mixture is None else mixture
    if distinct <= own + folded:
        totals, folds = {r["queue"]: r["n"] for r in sums.collect()}, {}
    else:
        spark = docs.sparkSession
        totals = {r["queue"]: r["n"] for r in sums.orderBy(F.desc("n"), "queue").limit(own).collect()}
        names = spark.createDataFrame([(q,) for q in {*totals, *named}], "queue string")
        totals |= {r["queue"]: r["n"] for r in sums.join(names, "queue").collect()}  # those that the mixture names
        small = sums.join(spark.createDataFrame([(q,) for q in totals], "queue string"), "queue", "left_anti").withColumn("fold", F.pmod(F.xxhash64("queue"), F.lit(folded)).cast("int"))
        # where each of the small ones begins in its queue
        small = stored(small.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("fold").orderBy("queue").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "folded_queues")
        folds = {r["fold"]: r["n"] for r in small.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
        before = before.join(small.drop("n"), "queue", "left").select("queue", "chunk", (F.col("before") + F.coalesce("base", F.lit(0))).alias("before"), "fold")
    if "fold" not in before.columns:
        before = before.withColumn("fold", F.lit(None).cast("int"))
    names, parts = sorted(totals), sorted(folds)
    sizes = [totals[q] for q in names] + [folds[k] for k in parts]
    shares = [float(n) for n in sizes] if mixture is None else [float(mixture.get(q, 0.0)) for q in names] + [0.0] * len(parts)
    rounds, number = Rounds(sizes, shares, window, packet), {q: k for k, q in enumerate([*names, *parts])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8 << 20):
            ints = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            n, queues = ints("n_tokens"), column(b, "queue")
            q = np.array([number[x if k is None else k] for x, k in zip(queues, column(b, "fold"), strict=True)], np.int64)
            d, start, length, _, seq, offset = rounds.pieces(q, ints("before") + ints("chunk_start"), n)
            data = memoryview(b"".join(column(b, "ids")))
            lo = 4 * ((np.cumsum(n) - n)[d] + start)
            crc = [zlib.crc32(data[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
            yield out_batch(doc_id=b.column(b.schema.get_field_index("doc_id")).take(pa.array(d)), start=start, length=length, ids_crc32=pa.array(crc, pa.int64()),
                            doc_tokens=n[d], sequence_id=seq, offset=offset, queue=b.column(b.schema.get_field_index("queue")).take(pa.array(d)))

    return rows.join(before, ["queue", "chunk"]).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string")
