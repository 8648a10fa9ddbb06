"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to features; their document frequencies over all documents and benchmark items give
   the inverse document frequencies.
2. The benchmark's items are cut into passages. A randomised SVD of their TF-IDF matrix, its products
   summed by Spark over the passages, gives the latent space: the directions that hold the benchmark.
3. Documents are cut into overlapping windows of two lengths. A window whose features outside the benchmark
   weigh too much cannot reach the cosine asked for (its part inside bounds the cosine) and is passed over;
   the others are projected and compared with all passages at once. High cosines give candidates.
4. Each candidate stretch of a document is confirmed by the longest common subsequence of words with the
   item. A high share is enough; a middling one (a paraphrase) needs the item's answer there as well: its
   ``answer`` column, or else the words of its last sentence.
5. Cosines say little about short items and about paraphrases in rarer words, so a second search leaves out
   nothing that the check accepts within twice an item's length. Of an item's n words t must be there in
   order, so one of its n - t + 1 rarest must be: around these anchors the item's words are counted, and
   each place from which t of them follow is checked.

The benchmark is the stated query set. It is taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, in_one, out_batch, pieces, stored

BITS = 18  # of the hashed words
#: Words of a block, and (length, step) of the windows of a document in blocks.
BLOCK = 8
WINDOWS = ((2, 1), (6, 2))
SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> np.ndarray:
    """Hashed words of a text: lower case, split at everything ASCII but letters and digits."""
    found = (text or "").lower().encode().translate(SEPARATE).split()
    return (np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Item:
    """A benchmark item: id, its words, the words of its answer."""

    item: int | None
    words: list[int]
    answer: list[int]


def answer_of(text: str, answer: str | None) -> list[int]:
    """Words of the answer: as given, or of the last sentence of three words or more, else of the text."""
    if answer:
        return words(answer).tolist()
    parts = [words(x) for x in re.split(r"[.!?\n]+", text)]
    return next((x.tolist() for x in reversed(parts) if len(x) >= 3), words(text).tolist())


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def least(n: int, share: float) -> int:
    """The smallest number of ``n`` words whose share is at least ``share``; above ``n`` if none is."""
    k = max(0, int(share * n) - 1)
    while k <= n and k / max(1, n) < share:
        k += 1
    return k


def hashed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, words): hashed words of whole texts as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield out_batch(doc_id=pa.array(column(b, "doc_id"), pa.int64()), words=pa.array([words(t).tobytes() for t in column(b, "text")], pa.binary()))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, words binary")


def inverse_frequencies(*hashed: DataFrame) -> np.ndarray:
    """log((1 + n) / (1 + df)) + 1 of every hashed word over the rows of all frames. At most 2^18 pairs of
    numbers come to the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            each = [np.unique(np.frombuffer(x, np.int32)) for x in column(b, "words")]
            n += len(each)
            df += np.bincount(np.concatenate([np.zeros(0, np.int32), *each]), minlength=1 << BITS)
        if n:
            at = np.flatnonzero(df)
            yield out_batch(feature=pa.array(np.append(at, -1), pa.int64()), df=pa.array(np.append(df[at], n), pa.int64()))

    counts = None
    for h in hashed:
        part = h.select("words").mapInArrow(run, "feature bigint, df bigint")
        counts = part if counts is None else counts.unionByName(part)
    got = counts.groupBy("feature").agg(F.sum("df").alias("df")).toArrow().to_pandas()
    df, n = np.zeros(1 << BITS), int(got["df"][got["feature"] < 0].sum())
    got = got[got["feature"] >= 0]
    df[got["feature"].to_numpy()] = got["df"].to_numpy()
    return np.log((1 + n) / (1 + df)) + 1


def passages_of(item: Item, size: int, step: int) -> list[list[int]]:
    """An item's passages: itself when it is short enough, else overlapping ones that cover it."""
    w = item.words
    return [w] if len(w) <= size else [w[a:a + size] for a in range(0, len(w) - size + step, step)]


def passage_rows(items: DataFrame, idf: np.ndarray, size: int, step: int) -> DataFrame:
    """(place, features, weights) of each passage of the items (item_id, words, place): TF-IDF of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, feats, weights = [], [], []
            for k, w in zip(column(b, "place"), column(b, "words"), strict=True):
                for p in passages_of(Item(None, np.frombuffer(w, np.int32).tolist(), []), size, step):
                    f, tf = np.unique(np.array(p, np.int32), return_counts=True)
                    x = tf * idf[f]
                    place.append(k)
                    feats.append(f.tolist())
                    weights.append((x / max(1e-12, np.sqrt((x * x).sum()))).tolist())
            yield out_batch(place=pa.array(place, pa.int32()), features=pa.array(feats, pa.list_(pa.int32())), weights=pa.array(weights, pa.list_(pa.float64())))

    return items.select("place", "words").mapInArrow(run, "place int, features array<int>, weights array<double>")


def randomised_svd(passages: DataFrame, rank: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(features, basis): orthonormal directions (features x rank) of the strongest part of the passages'
    rows. Starting from random directions, each round multiplies by the matrix and its transpose (tasks
    multiply their own passages, Spark sums the products by feature) and orthonormalises on the driver."""
    features = np.array(sorted(r[0] for r in passages.select(F.explode("features")).distinct().collect()), np.int64)  # of one block of items
    rank = min(rank, len(features))
    basis = np.random.default_rng(11).normal(size=(len(features), rank))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for f, w in zip(column(b, "features"), column(b, "weights"), strict=True):
                    at, x = np.searchsorted(features, f), np.array(w)
                    y = x @ basis[at]
                    for k, v in zip(at.tolist(), x, strict=True):
                        total[k] = total.get(k, 0) + v * y
            if total:
                yield out_batch(row=pa.array(list(total), pa.int32()), y=pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64())))

        parts = passages.select("features", "weights").mapInArrow(run, "row int, y array<double>")
        # one row per feature and task, summed number by number
        sums = parts.select("row", F.posexplode("y").alias("k", "v")).groupBy("row", "k").agg(F.sum("v").alias("v"))
        got = sums.toArrow().to_pandas()  # features of one block x rank numbers
        y = np.zeros_like(basis)
        y[got["row"].to_numpy(), got["k"].to_numpy()] = got["v"].to_numpy()
        basis = np.linalg.qr(y)[0]
    return features, basis


class Searcher:
    """Cosine candidates of one block of items, and their checks."""

    def __init__(self, items: list[Item], idf: np.ndarray, features: np.ndarray, basis: np.ndarray, passages: list[tuple[int, list[int]]], cosine: float):
        self.items, self.cosine = items, cosine
        self.squares = np.append(idf**2, 0).astype(np.float32)  # the last entry stands for no word
        self.row = np.full((1 << BITS) + 1, len(features), np.int32)
        self.row[features] = np.arange(len(features))
        self.inside = np.where(self.row < len(features), self.squares, 0).astype(np.float32)
        self.table = np.vstack([basis * idf[features][:, None], np.zeros(basis.shape[1])]).astype(np.float32)
        vectors = []
        for _, p in passages:
            f, tf = np.unique(np.array(p, np.int64), return_counts=True)
            x = tf * idf[f]
            full = np.sqrt((x * x).sum())
            y = (x[:, None] * basis[self.row[f]]).sum(0)
            # in proportion to what the latent space keeps of the passage, so that a copy scores its full cosine
            vectors.append(y * full / max(1e-12, (y * y).sum()))
        #: Of each item: the rows of its words.
        self.rows_of = [np.unique(self.row[np.array(x.words, np.int64)]) for x in items]
        self.idf = idf
        self.owner = np.array([k for k, _ in passages], np.int32)
        self.vectors = np.array(vectors, np.float32).reshape(len(passages), basis.shape[1])

    def blocks(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of every block, padded with none; first block of every document and the end)."""
        sizes = np.diff(bounds)
        n = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(n)])
        out = np.full(int(first[-1]) * BLOCK, 1 << BITS, np.int32)
        out[np.arange(len(ids)) + np.repeat(first[:-1] * BLOCK - bounds[:-1], sizes)] = ids
        return out.reshape(-1, BLOCK), first

    def candidates(self, ids: np.ndarray, bounds: np.ndarray, chunk: int = 1 << 14) -> list[tuple[int, int, int, float]]:
        """(item place, first word, end, cosine) of the windows that come near an item. Documents' words stand
        end to end in ``ids``."""
        words_, first = self.blocks(ids, bounds)
        if not len(words_):
            return []
        total = lambda weights: np.concatenate([[0], np.cumsum(weights[words_].sum(1, dtype=np.float64))])
        everything, inside = total(self.squares), total(self.inside)
        counts, out = np.diff(first), []
        for size, step in WINDOWS:
            n = np.where(counts > 0, np.maximum(0, -(-(counts - size) // step)) + 1, 0)
            doc = np.repeat(np.arange(len(counts)), n)
            a = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
            b = np.minimum(a + size, first[doc + 1])
            # the weight inside bounds the cosine; words are counted one by one here, so a little less is asked for
            keep = (inside[b] - inside[a]) >= 0.8 * self.cosine**2 * (everything[b] - everything[a])
            a, b, doc = a[keep], b[keep], doc[keep]
            for s in range(0, len(a), chunk):
                out += self.near(words_, a[s:s + chunk], b[s:s + chunk], doc[s:s + chunk], first, bounds, size)
        return out

    def near(self, words_: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, first: np.ndarray, bounds: np.ndarray, size: int) -> list[tuple[int, int, int, float]]:
        """The candidates among some windows (blocks a to b)."""
        used, place = np.unique(np.minimum(a[:, None] + np.arange(size), b[:, None] - 1), return_inverse=True)
        place = place.reshape(len(a), size)
        rows = self.row[words_[used]]
        sums = self.table[rows[:, 0]]
        for j in range(1, BLOCK):
            sums += self.table[rows[:, j]]
        y = sums[place[:, 0]]
        for j in range(1, size):
            there = a + j < b
            y[there] += sums[place[there, j]]
        score = y @ self.vectors.T
        # the window's own length, frequencies counted: equal words stand together once sorted
        w = np.where((a[:, None] + np.arange(size) < b[:, None])[:, :, None], words_[used][place], 1 << BITS).reshape(len(a), -1)
        hit = np.flatnonzero(score.max(1) >= self.cosine * np.sqrt(self.squares[w].sum(1)))  # without frequencies: no longer than it is
        score, w = score[hit], np.sort(w[hit], axis=1)
        run = np.zeros_like(w)
        for j in range(1, w.shape[1]):
            run[:, j] = np.where(w[:, j] == w[:, j - 1], run[:, j - 1] + 1, 0)
        score /= np.maximum(np.sqrt((self.squares[w] * (2 * run + 1)).sum(1)), 1e-6)[:, None]
        i, j = np.nonzero(score >= self.cosine)
        lo = bounds[doc[hit]] + (a[hit] - first[doc[hit]]) * BLOCK
        hi = np.minimum(bounds[doc[hit]] + (b[hit] - first[doc[hit]]) * BLOCK, bounds[doc[hit] + 1])
        return list(zip(self.owner[j].tolist(), lo[i].tolist(), hi[i].tolist(), score[i, j].tolist(), strict=True))

    def anchored(self, ids: np.ndarray, bounds: np.ndarray, checks: tuple[float, float, float]) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item place, cosine, shares of the item and its answer) of every stretch of twice an item's
        length that ``confirm`` accepts. The cosine is that of the item and as many words from there on."""
        copy, paraphrase, answered = checks
        row = self.row[ids]
        needed = [max(1, least(len(x.words), min(copy, paraphrase))) for x in self.items]
        anchors = []
        for x, t in zip(self.items, needed, strict=True):
            w = np.array(x.words, np.int64)
            anchors.append(np.unique(self.row[w[np.argsort(-self.idf[w], kind="stable")[:max(0, len(w) - t + 1)]]]))
        wanted = np.zeros(int(self.row.max()) + 1, bool)
        wanted[np.concatenate([np.zeros(0, np.int64), *anchors]).astype(np.int64)] = True
        at = np.flatnonzero(wanted[row])
        at = at[np.argsort(row[at], kind="stable")]
        cuts = np.searchsorted(row[at], np.arange(len(wanted) + 1))
        for place, (item, t) in enumerate(zip(self.items, needed, strict=True)):
            hits = np.sort(np.concatenate([at[:0], *[at[cuts[k]:cuts[k + 1]] for k in anchors[place]]]))
            if not len(hits):
                continue
            size = 2 * len(item.words)
            doc = np.searchsorted(bounds, hits, side="right") - 1
            lo, hi = np.maximum(bounds[doc], hits - size + 1), np.minimum(bounds[doc + 1], hits + size)
            new = np.flatnonzero(np.append(True, lo[1:] >= hi[:-1]))
            lo, hi = lo[new], hi[np.append(new[1:], len(hi)) - 1]
            # the places of the item's words, and how many of them follow each within the size
            n = hi - lo
            x = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            mine = np.zeros(len(wanted), bool)
            mine[self.rows_of[place]] = True
            there = mine[row[x]]
            x, end = x[there], np.repeat(hi, n)[there]
            end = np.minimum(x + size, end)
            enough = np.searchsorted(x, end) - np.arange(len(x)) >= t
            yield from self.stretches(place, t, ids, bounds, x[enough].tolist(), end[enough].tolist(), checks)

    def stretches(self, place: int, t: int, ids: np.ndarray, bounds: np.ndarray, starts: list[int], ends: list[int], checks: tuple[float, float, float]) -> Iterator[tuple[int, int, float, float, float]]:
        """Those of the stretches (start, end) of an item that ``confirm`` accepts, for ``anchored``."""
        copy, paraphrase, answered = checks
        item, after = self.items[place], -1
        n, m = len(item.words), len(item.answer)
        for a, e in zip(starts, ends, strict=True):
            if a < after:
                continue
            doc = int(np.searchsorted(bounds, a, side="right")) - 1
            common = common_subsequence(item.words, ids[a:e].tolist())
            if common < t:
                after = a + t - common  # a word further on is one word more in common at most
                continue
            wide = ids[max(int(bounds[doc]), a - n - m):min(int(bounds[doc + 1]), e + n + m)].tolist()  # the answer may stand beside
            share, known = common / n, common_subsequence(item.answer, wide)
            answer = known / max(1, m)
            if share >= copy or (share >= paraphrase and answer >= answered):
                after = e
                yield doc, place, self.plain_cosine(item.words, ids[a:a + n] if a + n <= e else ids[a:e]), common_subsequence(item.words, wide) / n, answer
            else:
                after = a + max(1, min(least(n, copy) - common, least(m, answered) - known if share >= paraphrase else n))

    def plain_cosine(self, a: list[int], b: np.ndarray) -> float:
        """TF-IDF cosine of two lists of words."""
        words_, place = np.unique(np.concatenate([np.array(a, np.int64), b]), return_inverse=True)
        x, y = (np.bincount(p, minlength=len(words_)) * self.idf[words_] for p in (place[:len(a)], place[len(a):]))
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    def confirm(self, item: Item, region: list[int], copy: float, paraphrase: float, answered: float) -> tuple[float, float, bool]:
        """(share of the item in common, share of its answer, is it contaminated)."""
        share = common_subsequence(item.words, region) / max(1, len(item.words))
        answer = common_subsequence(item.answer, region) / max(1, len(item.answer))
        return share, answer, share >= copy or (share >= paraphrase and answer >= answered)


def find_contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.5, copy: float = 0.8, paraphrase: float = 0.6, answered: float = 0.8,
                       rank: int = 192, passage: int = 64, step: int = 32, block: int = 512) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, cosine, lcs_share, answer_share
    (shares of the item's and its answer's words in common order), the best of each over the stretches. A
    stretch of up to twice an item's words that passes the shares is always found; ``cosine`` bounds the
    search for longer ones.

    ``copy``: share that is enough; ``paraphrase``: share that needs ``answered`` of the answer too. Null or
    empty texts and items match nothing. Rows that repeat a doc_id give one row per item together; a null
    doc_id is carried along. Equal items are all reported. Empty tables give an empty result. ``block``:
    items (``item_id``, ``text``, ``answer`` if there) compared at once; every block meets all documents."""
    extra = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), extra.alias("answer")).where("text is not null").distinct()
    asked = stored(asked, "benchmark")
    hashed = stored(hashed_documents(docs), "hashed_words")
    idf = inverse_frequencies(hashed, hashed_documents(asked.select(F.col("item_id").alias("doc_id"), "text")))
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double"
    blocks = max(1, -(-asked.count() // block))
    out = None
    for k in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [Item(r["item_id"], words(r["text"]).tolist(), answer_of(r["text"], r["answer"])) for r in mine.orderBy("item_id", "text").collect()]  # about `block` rows
        items = [x for x in items if x.words]
        if not items:
            continue
        spark = docs.sparkSession
        frame = spark.createDataFrame([(i, bytearray(np.array(x.words, np.int32).tobytes())) for i, x in enumerate(items)], "place int, words binary")
        rows = stored(passage_rows(frame.repartition(8), idf, passage, step), "passages")
        features, basis = randomised_svd(rows, min(rank, rows.count()))
        cut = [(i, p) for i, x in enumerate(items) for p in passages_of(x, passage, step)]
        found = search(hashed, items, idf, features, basis, cut, cosine, (copy, paraphrase, answered), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def search(hashed: DataFrame, items: list[Item], idf: np.ndarray, features: np.ndarray, basis: np.ndarray, passages: list[tuple[int, list[int]]], cosine: float,
           checks: tuple[float, float, float], schema: str) -> DataFrame:
    """The contaminated (document, item) pairs of one block of items, one row per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Searcher(items, idf, features, basis, passages, cosine)
        for b in pieces(batches, 4 << 20):
            ids_, docs_ = column(b, "doc_id"), [np.frombuffer(x, np.int32) for x in column(b, "words")]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in docs_])]).astype(np.int64)
            ids = np.concatenate([np.zeros(0, np.int32), *docs_])
            stretches: dict[tuple[int, int], list[list]] = {}
            for place, a, e, score in sorted(s.candidates(ids, bounds)) if len(ids) else ():
                doc, reach = int(np.searchsorted(bounds, a, side="right")) - 1, len(items[place].words)
                lo, hi = max(int(bounds[doc]), a - reach), min(int(bounds[doc + 1]), e + reach)
                mine = stretches.setdefault((doc, place), [])
                if mine and lo <= mine[-1][1]:  # windows that overlap are one stretch
                    mine[-1][1], mine[-1][2] = max(hi, mine[-1][1]), max(score, mine[-1][2])
                else:
                    mine.append([lo, hi, score])
            rows = []
            for (doc, place), spans in stretches.items():
                for lo, hi, score in spans:
                    item = items[place]
                    share, answer, bad = s.confirm(item, ids[lo:hi].tolist(), *checks)
                    if bad and hi - lo > 4 * len(item.words) + 128:  # a long stretch: no chance subsequence of scattered words
                        near = [s.confirm(item, ids[x:x + 2 * len(item.words)].tolist(), *checks) for x in range(lo, hi, max(1, len(item.words) // 2))]
                        share, answer, bad = max(near, key=lambda x: (x[2], x[0]))
                    if bad:
                        rows.append((ids_[doc], item.item, score, share, answer))
            rows += [(ids_[doc], items[place].item, *found) for doc, place, *found in (s.anchored(ids, bounds, checks) if len(ids) else ())]
            if rows:
                d, i, c, x, y = zip(*rows, strict=True)
                yield out_batch(doc_id=pa.array(d, pa.int64()), item_id=pa.array(i, pa.int64()), cosine=pa.array(c, pa.float64()), lcs_share=pa.array(x, pa.float64()), answer_share=pa.array(y, pa.float64()))

    return hashed.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark item was found (rows without doc_id stay unless
    such a row was found)."""
    bad = stored(find_contamination(docs, benchmark, **options).select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"), in_one(docs))
    return ids.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
