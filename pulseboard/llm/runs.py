"""Periodic runs of words, found by recursive frequency splitting.

A run of period q and at least three periods holds each of its words three times or more. So a word that
occurs less often within the current segment can't stand in a qualifying run: it splits the segment. The
parts are counted again, and split again, until nothing changes; parts too short for a run go. Each segment
that is left is scanned by lags: for a lag p, a qualifying run is a stretch of 2p or more places that equal the
place p further on, and such a stretch holds a whole aligned block of half that length, so one hash comparison
a block finds it (n/p of them at lag p, n log n in all). Hits are grown by bisection over the same hashes and
then compared word by word, so hashes never decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, out_batch, pieces, text_bytes

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PROBES = 1 << 20  # block comparisons made at a time


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places that the words of a document come from once its tail is looped; None: as they are.

    With h the crc32 of the decimal id and g = h // 10: where h % 10 = 0, word i >= a becomes word
    a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id has no h."""
    if doc_id is None or n == 0:
        return None
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def segments(words: np.ndarray, docs: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of ``words`` within one document in which every word occurs at least ``times``
    times and which hold ``least`` words or more. ``docs``: non-decreasing document number of each word."""
    done = []
    at, seg = np.arange(len(words)), docs
    span = int(words.max()) + 1 if len(words) else 1
    while len(at):
        # segments are stretches of neighbouring places: where one is too short it goes
        new = np.ones(len(at), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        keep = np.repeat(size >= least, size)
        at, seg = at[keep], np.repeat(np.arange(len(size)), size)[keep]
        if not len(at):
            break
        _, inverse, count = np.unique(seg * span + words[at], return_inverse=True, return_counts=True)
        often = count[inverse] >= times
        # a segment without a rare word is stable; only the others are counted again
        torn = np.zeros(len(size), bool)
        torn[seg[~often]] = True
        stable = ~torn[seg]
        places = at[stable]
        if len(places):
            edge = np.flatnonzero(np.diff(seg[stable])) + 1
            done += list(zip(places[np.append(0, edge)].tolist(), (places[np.append(edge, len(places)) - 1] + 1).tolist(), strict=True))
        more = often & ~stable
        at, seg = at[more], seg[more]
    return sorted(done)


class Hashes:
    """Hashes of stretches of a word sequence, comparable at two places of it."""

    def __init__(self, words: np.ndarray):
        x = words.astype(np.uint64) + np.uint64(1)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        x ^= x >> np.uint64(31)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(len(words), BASE)))
        self.sums = np.append(np.uint64(0), np.cumsum(x * self.power[:-1]))

    def equal(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether words[at:at+size] and words[at+lag:at+lag+size] have one hash."""
        s = self.sums
        return (s[at + size] - s[at]) * self.power[lag] == s[at + lag + size] - s[at + lag]


def longest(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """For each element the size up to which ``holds``, by bisection between ``low`` (holds) and ``high``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        ok = holds(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        high = np.maximum(high, low)
    return low


def exact_stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of places around ``at`` that equal the place ``lag`` further on, word by word."""
    same = words[:-lag] == words[lag:]
    if not same[at]:
        return at, at
    left, right = np.flatnonzero(~same[:at]), np.flatnonzero(~same[at:])
    return (int(left[-1]) + 1 if len(left) else 0), (at + int(right[0]) if len(right) else len(same))


def lag_scan(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of smallest period q and at least max(least, times*q) words."""
    n = len(words)
    hashes, found = Hashes(words), {}
    lag = np.arange(1, n // times + 1)
    need = np.maximum((times - 1) * lag, least - lag)  # places that equal the one a lag further on
    block = (need + 1) // 2
    count = np.maximum((n - lag) // block, 0)
    upto = np.cumsum(count)
    i = 0
    while i < len(lag):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PROBES, side="right")))
        each = count[i:j]
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        p, h = np.repeat(lag[i:j], each), np.repeat(block[i:j], each)
        hit = np.flatnonzero(hashes.equal(k * h, p, h))
        i = j
        if not len(hit):
            continue
        p, h, k = p[hit], h[hit], k[hit]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1] + 1)  # neighbouring blocks lie in one stretch
        p, h, at = p[first], h[first], (k * h)[first]
        right = longest(h, n - p - at, lambda m: hashes.equal(at, p, m))  # noqa: B023
        left = longest(np.zeros_like(at), at, lambda m: hashes.equal(at - m, p, m))  # noqa: B023
        start, size = at - left, left + right
        # hashes that agree by chance only make a stretch look longer: nothing is missed
        for x in np.flatnonzero(size >= np.maximum((times - 1) * p, least - p)).tolist():
            a, q, m = int(start[x]), int(p[x]), int(size[x])
            if (a, m + q) in found:  # lags rise, so the smallest period of this stretch came first
                continue
            if not np.array_equal(words[a:a + m], words[a + q:a + q + m]):
                a, b = exact_stretch(words, int(at[x]), q)
                m = b - a
                if m < max((times - 1) * q, least - q) or (a, m + q) in found:
                    continue
            found[a, m + q] = q
    return sorted((a, size, q) for (a, size), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that some run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for a, size, q in runs:
        change[a + q] += 1
        change[a + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def scan_texts(texts: list[bytes], ids: list[int | None], least: int, times: int, loop: bool) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    parts = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D
    if loop:
        for i, d in enumerate(ids):
            if (at := looped(len(parts[i]), d)) is not None:
                parts[i] = [parts[i][j] for j in at.tolist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    words = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = [[] for _ in parts]
    owner = np.repeat(np.arange(len(parts)), sizes)
    for a, b in segments(words, owner, least, times):
        d = int(owner[a])
        runs[d] += [(int(a - begin[d]) + s, size, q) for s, size, q in lag_scan(words[a:b], least, times)]
    return [(p, sorted(r, key=lambda x: (x[0], x[2]))) for p, r in zip(parts, runs, strict=True)]


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, loop: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period in words, by start, then
    period) and collapsed (the words outside runs and the first period of each, joined by one space).

    A run is a stretch of words with smallest period q and at least max(``least``, ``times`` * q) words that
    neither neighbour extends at that period. Null or empty text, or white space only: no words, no runs, an
    empty text. ``loop``: tails are looped first as ``looped`` says. Each row stands by itself: repeated rows
    give repeated results, a null doc_id is carried along, an empty table gives an empty result."""
    if times < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in pieces(batches, 4 << 20):
            ids = column(b, "doc_id")
            rows = scan_texts(text_bytes(b), ids, least, times, loop)
            yield out_batch(doc_id=pa.array(ids, pa.int64()), n_words=pa.array([len(w) for w, _ in rows], pa.int64()),
                            runs=pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for _, r in rows], kind),
                            collapsed=pa.array([collapsed(w, r) for w, r in rows], pa.binary()).cast(pa.string()))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length/period; the first in order of start and period where equal."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0),
                    lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def run_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``, its tail looped as ``looped`` says: doc_id, n_runs, the strongest run (start, length,
    period, exponent_milli; nulls without a run), runs_sha256 (lines start,length,period) and collapsed_sha256."""
    found = find_runs(docs, loop=True).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
