"""Alignment of two tokenizers' tokens by inverted pair bitmaps.

Each text is cut by both tokenizers; two tokens are linked where their byte ranges overlap. Documents are
dealt to chunks of at most 65,536 places. A chunk keeps, for every pair of ids linked in it, bitmaps over its
documents: plane 0 marks the documents that hold the pair, planes 1, 2, 4, ... the bits of how many links more
than one each of them holds. A bitmap is a sorted array of 16-bit places, or 65,536 bits where that is shorter.

Bitmaps of batches are OR-merged within their chunk (a chunk belongs to one task) and written once. Popcounts
of plane 0 over all chunks give a pair's documents, popcounts of all planes, each at its weight, its links. The
bitmaps then serve as postings: joined with the pairs' counts they hand each document's score back to its
place, chunk by chunk. Counts of pairs are salted by chunk, so a pair that every chunk holds is spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, out_batch, pieces, stored
from .vocab import byte_bpe, sentence_pieces

PLACES = 1 << 16  # documents of a chunk
DENSE = PLACES // 16  # places from which on a bitmap is kept as bits
B_BITS = 20  # of a pair number; ids of the second vocabulary lie below 2^20
POSTINGS = 3_000_000  # (pair, document) entries a chunk holds before it is closed: bounds a worker's memory
SALTS = 64

DIGEST = (("pos", "int"), ("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("groups_sha256", "string"))
BITMAP = (("pair", "bigint"), ("plane", "tinyint"), ("n", "int"), ("bits", "binary"))


def _type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "tinyint": pa.int8(), "binary": pa.binary(), "boolean": pa.bool_()}[name]


def _rows(chunk: int, schema, **cols) -> pa.RecordBatch:
    """A batch of ``schema`` [(name, type)]; columns not given are null. ``chunk``: one number for all rows."""
    n = len(next(iter(cols.values())))
    arrays = [pa.array(np.full(n, chunk, np.int64))]
    for name, t in schema:
        c = cols.get(name)
        arrays.append(pa.nulls(n, _type(t)) if c is None else c if isinstance(c, pa.Array) else pa.array(c, _type(t)))
    return pa.RecordBatch.from_arrays(arrays, ["chunk", *[name for name, _ in schema]])


class Aligner:
    """Links and groups of texts under the two vocabularies."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        self.a, self.b = byte_bpe(a_path, a_ranks, True), sentence_pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        # texts of a token by number: A "id," and "id|", then B "id," and "id;"
        self.words = [f"{i}{end}" for ids, ends in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for i in range(ids) for end in ends]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by both; None where there are no tokens: no text, or one that either doesn't give back."""
        out = []
        for t, b in zip(texts, self.b.ids(texts), strict=True):
            if not t:
                out.append(None)
                continue
            a, want = self.a.ids(" " + t), b" " + t.encode()
            same = b"".join(map(self.b.bytes.__getitem__, b)) == want and b"".join(map(self.a.bytes.__getitem__, a.tolist())) == want
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
        return out

    def align(self, found: list[tuple[np.ndarray, np.ndarray]]):
        """Of texts that have tokens: tokens, groups and links by text, the groups as texts, and the links as
        (text, A id, B id)."""
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
        # both cut the same bytes: marks at the bytes where tokens and texts end, and how many end before
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        text_end = a_end[np.cumsum(n_a) - 1]
        marks = np.zeros((3, int(a_end[-1]) + 1), np.int32)
        for row, at in zip(marks, (a_end, b_end, text_end), strict=True):
            row[at] = 1
        ends, both = np.flatnonzero(marks[0] | marks[1]), np.flatnonzero(marks[0] & marks[1])
        upto = np.cumsum(marks, axis=1, dtype=np.int32)
        # a stretch between two neighbouring ends lies in one token of each; two tokens share one such stretch
        link_a, link_b, link_text = (u[ends] - m[ends] for u, m in zip(upto, marks, strict=True))
        count = lambda at: np.bincount(upto[2][at] - marks[2][at], minlength=len(found))
        groups = self.groups(a, b, a_end, b_end, both, upto, n_a + n_b)
        return n_a, n_b, count(both), np.bincount(link_text, minlength=len(found)), groups, (link_text, a[link_a], b[link_b])

    def groups(self, a, b, a_end, b_end, both, upto, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        at = np.append(0, both)  # where groups begin and end
        g_a, g_b = (np.searchsorted(both, e) for e in (a_end, b_end))
        # a group's A tokens stand after all B tokens of earlier groups, its B tokens after its A tokens
        word = np.empty(len(a) + len(b), np.int64)
        word[np.arange(len(a)) + upto[1][at[g_a]]] = 2 * a + (a_end == both[g_a])
        word[np.arange(len(b)) + upto[0][at[g_b + 1]]] = 2 * (len(self.a.bytes) + b) + (b_end == both[g_b])
        out, k, word = [], 0, word.tolist()
        for n in sizes.tolist():
            out.append("".join(map(self.words.__getitem__, word[k:k + n]))[:-1])
            k += n
        return out


def bitmap(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pairs, popcounts, bitmaps) of sorted postings pair * 65,536 + place."""
    pair, place = postings >> 16, (postings & (PLACES - 1)).astype(np.uint16)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    n = np.diff(np.append(first, len(pair)))
    dense = n >= DENSE
    width = np.where(dense, DENSE, n)  # in 16-bit words
    begin = np.cumsum(width) - width
    words = np.empty(int(width.sum()), np.uint16)
    sparse = np.repeat(~dense, n)
    words[(np.repeat(begin - first, n) + np.arange(len(pair)))[sparse]] = place[sparse]
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(PLACES, np.uint8)
        bits[place[first[k]:first[k] + n[k]]] = 1
        words[begin[k]:begin[k] + DENSE] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = np.append(begin, len(words)).astype(np.int32) * 2
    return pair[first], n, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def planes(postings: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, pa.Array]]]:
    """(plane, its bitmaps) of sorted postings and the links each of them stands for."""
    yield 0, bitmap(postings)
    plane, rest = 1, counts - 1
    while (more := rest > 0).any():
        postings, rest = postings[more], rest[more]
        odd = (rest & 1).astype(bool)
        if odd.any():
            yield plane, bitmap(postings[odd])
        plane, rest = plane + 1, rest >> 1


def aligned(docs: DataFrame, a_path: str, a_ranks: str, b_path: str, postings: int = POSTINGS) -> DataFrame:
    """Rows of two sorts, by chunk: documents (plane null: place, doc_id, tokens, groups, links) and bitmaps
    (pair, plane, popcount n, bits). A chunk is closed once it holds ``postings`` (pair, document) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, task = (*BITMAP, *DIGEST), TaskContext.get().partitionId()
        aligner, seq, used, held = Aligner(a_path, a_ranks, b_path), 0, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            """The chunk's bitmaps: those of its batches OR-merged, which is a sorted union as no two share a place."""
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            chunk, counts = task << 32 | seq, np.concatenate([c for _, c in held])[order]
            for plane, (pairs, n, bits) in planes(keys[order], counts):
                whole = _rows(chunk, schema, pair=pairs, plane=np.full(len(pairs), plane, np.int8), n=n.astype(np.int32), bits=bits)
                yield from (whole.slice(i, 50_000) for i in range(0, len(pairs), 50_000))

        for b in pieces(batches, 2 << 20):
            for part in (b.slice(i, 8192) for i in range(0, b.num_rows, 8192)):
                if used + part.num_rows > PLACES or sum(len(k) for k, _ in held) > postings:
                    if held:
                        yield from close()
                    seq, used, held = seq + 1, 0, []
                texts = [t or "" for t in column(part, "text")]
                ids = aligner.ids(texts)
                at = [i for i, x in enumerate(ids) if x is not None]
                digest = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
                sha = [""] * len(texts)
                if at:
                    *numbers, groups, (text, a, tokens_b) = aligner.align([ids[i] for i in at])
                    for c, x in zip(digest, numbers, strict=True):
                        digest[c][at] = x
                    for i, g in zip(at, groups, strict=True):
                        sha[i] = hashlib.sha256(g.encode()).hexdigest()
                    held.append(np.unique((a << B_BITS | tokens_b) << 16 | (np.array(at, np.int64)[text] + used), return_counts=True))
                yield _rows(task << 32 | seq, schema, pos=np.arange(used, used + len(texts), dtype=np.int32), doc_id=pa.array(column(part, "doc_id"), pa.int64()), groups_sha256=sha, **digest)
                used += len(texts)
        if held:
            yield from close()

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, "chunk bigint, " + ", ".join(f"{n} {t}" for n, t in (*BITMAP, *DIGEST)))


def _salt() -> Column:
    return F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int").alias("salt")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, salt, docs, links, best) of the bitmaps of ``aligned``, a row for each salt that holds the pair:
    documents and links corpus-wide, and whether no pair of the same B id has more links."""
    weight = F.expr("shiftleft(1L, greatest(cast(plane as int) - 1, 0))")
    bits = rows.where(F.col("plane").isNotNull())
    salted = bits.groupBy("pair", _salt()).agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight).alias("links"))
    salted = stored(salted, "pair_counts_salted")
    totals = salted.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    most = totals.groupBy("b").agg(F.max("links").alias("most"))
    known = totals.join(most, "b").select("pair", "docs", "links", (F.col("links") == F.col("most")).alias("best"))
    return salted.select("pair", "salt").join(known, "pair")


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``aligned`` with n_best and count_sum, handed back through their pairs' bitmaps."""
    extra = (("plane", "tinyint"), ("bits", "binary"), ("links", "bigint"), ("best", "boolean"))
    schema = (*extra, *DIGEST)
    hits = rows.where(F.col("plane").isNotNull()).select("chunk", "pair", "plane", "bits", _salt()).join(counts, ["pair", "salt"])
    documents = rows.where(F.col("plane").isNull())
    null = lambda n, t: F.lit(None).cast(t).alias(n)
    both = hits.select("chunk", *[n for n, _ in extra], *[null(*c) for c in DIGEST]).unionByName(documents.select("chunk", *[null(*c) for c in extra], *[n for n, _ in DIGEST]))
    # the bitmaps of a chunk come before its documents
    sorted_ = both.repartition("chunk").sortWithinPartitions("chunk", F.col("pos").asc_nulls_first())
    dense = np.arange(PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, total = None, np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            chunks = get("chunk").to_numpy()
            edges = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])).tolist() if len(chunks) else []
            for lo, hi in zip(edges, [*edges[1:], len(chunks)], strict=True):
                if current != chunks[lo]:
                    current = chunks[lo]
                    best[:], total[:] = 0, 0
                part = b.slice(lo, hi - lo)
                col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                plane = col("plane")
                at = np.flatnonzero(plane.is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    k = plane.to_numpy(zero_copy_only=False)[at].astype(np.int64)
                    weight = np.where(k == 0, 1, np.left_shift(1, np.maximum(k - 1, 0)))
                    links, is_best = (col(c).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in ("links", "best"))
                    maps = col("bits").take(pa.array(at)).to_pylist()
                    full = [i for i, x in enumerate(maps) if len(x) == 2 * DENSE]
                    for i in full:
                        where = dense[np.unpackbits(np.frombuffer(maps[i], np.uint8), bitorder="little").astype(bool)]
                        total[where] += weight[i] * links[i]
                        best[where] += weight[i] * bool(is_best[i])
                        maps[i] = b""
                    size = np.array([len(x) // 2 for x in maps], np.int64)
                    where = np.frombuffer(b"".join(maps), np.uint16)
                    np.add.at(total, where, np.repeat(weight * links.astype(np.int64), size))
                    np.add.at(best, where, np.repeat(weight * is_best.astype(np.int64), size))
                at = np.flatnonzero(col("pos").is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    place = col("pos").take(pa.array(at)).to_numpy()
                    kept = part.take(pa.array(at))
                    out = {n: kept.column(kept.schema.get_field_index(n)) for n, _ in DIGEST if n != "pos"}
                    yield out_batch(**out, n_best=best[place], count_sum=total[place])

    names = ", ".join(f"{n} {t}" for n, t in DIGEST if n != "pos")
    return sorted_.select("chunk", *[n for n, _ in schema]).mapInArrow(run, f"{names}, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a_path: str, a_ranks: str, b_path: str, postings: int = POSTINGS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b (tokens of a space and the text by the byte-level
    vocabulary A and by the pieces B), n_groups (stretches between places where both end a token), n_links
    (pairs of tokens whose bytes overlap), groups_sha256 (of ``a1,a2|b1;...``), n_best (links whose pair is
    linked most often corpus-wide among its B id's, ties too) and count_sum (of the links' pair counts).

    Null and empty texts, and texts that one vocabulary doesn't give back byte by byte (such as some with
    line breaks doubled by a normaliser), have no tokens: zeros and ''. Repeated rows count each time; a null
    doc_id is carried along; an empty table gives an empty result. Added tokens' strings are plain text."""
    rows = stored(aligned(docs, a_path, a_ranks, b_path, postings), "alignment")
    return scored(rows, pair_counts(rows))


def pair_table(docs: DataFrame, a_path: str, a_ranks: str, b_path: str) -> DataFrame:
    """(a, b, docs, links, best) of every pair of ids linked somewhere in ``docs``."""
    c = pair_counts(stored(aligned(docs, a_path, a_ranks, b_path), "alignment")).drop("salt").distinct()
    return c.select(F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "docs", "links", "best")
