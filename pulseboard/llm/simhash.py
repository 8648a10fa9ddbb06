"""SimHash near-duplicate detection through a Gray-order hierarchical index.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints collapse to one row.
2. Two fingerprints that differ in at most ``max_bits`` bits agree on at least one of ``max_bits + 1``
   bit blocks. For each block the fingerprints are rotated so that the block comes first; fingerprints
   that agree on it share an upper node of the index (accumulated difference 0 there).
3. Inside a node, fingerprints are sorted by Gray rank. Runs of neighbours form leaf nodes, runs of
   leaves form upper nodes; a node keeps the bits all its members share (mask and pattern). Pairs of
   nodes are compared from the top down, and a pair whose shared bits already differ in more than
   ``max_bits`` places is pruned with everything below it.
4. Each node's links are folded to stars (member -> smallest member of its group), so a group of m
   copies gives m - 1 rows, and the stars are joined to components by alternating large-star and
   small-star steps over written tables.

Nothing is capped: a node with very many fingerprints is split on further bits, and its parts are
compared part by part, each pair of parts on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_one, out_batch, pieces, stored, text_bytes

SEED = 42
FAN = 16  # members of a leaf node, and children of an upper node
HASHES = 1 << 15  # shingle hashes whose bits are counted at once


# -- fingerprints -----------------------------------------------------------

def shingle_hashes(data: bytes, size: int) -> list[int]:
    """XXH64 of each shingle of ``size`` words; fewer words: of the whole sequence; none: nothing."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= size:
        return [h(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - size].tolist()]
    return [h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """One fingerprint per text: bits set in over half of its hashes. ``counts``: hashes of each text."""
    owner_end = np.cumsum(counts)
    sums = np.zeros((len(counts), 64), dtype=np.int64)
    for a in range(0, len(hashes), HASHES):
        part = hashes[a:a + HASHES]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        first = np.searchsorted(owner_end, a, side="right")
        last = np.searchsorted(owner_end, a + len(part) - 1, side="right")
        owners = [k for k in range(first, last + 1) if counts[k]]
        begins = [max(0, int(owner_end[k]) - counts[k] - a) for k in owners]
        sums[owners] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    out = 2 * sums > np.asarray(counts, dtype=np.int64)[:, None]
    return np.packbits(out, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, th, fp): the fingerprint of each whole text as a signed long, and a hash that tells apart the
    texts of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 << 20):
            hashes = [np.array(shingle_hashes(t, size), dtype=np.uint64) for t in text_bytes(b)]
            fps = majority(np.concatenate([np.zeros(0, np.uint64), *hashes]), [len(h) for h in hashes])
            yield out_batch(doc_id=b.column(b.schema.get_field_index("doc_id")), th=b.column(b.schema.get_field_index("th")), fp=fps.view(np.int64))

    return docs.select(*keys(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def keys() -> list:
    """A row of documents by its id and a hash of its text."""
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")]


# -- the hierarchical index -------------------------------------------------

def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in Gray-code order (inverse Gray code)."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def group_nodes(ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that are 1 (0) in all members of each run of FAN children."""
    at = np.arange(0, len(ones), FAN)
    return np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)


def close_pairs(left: np.ndarray, right: np.ndarray, same: bool, max_bits: int, label: np.ndarray,
                chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in left, j in right) at ``max_bits`` or fewer differing bits, both sides in Gray
    order. ``same``: left is right, pairs i < j. Pairs of leaves whose members all have one and the same
    ``label`` already (places of left, then right) are skipped: they can't join anything."""
    levels = []
    for side in (left, right):
        ups = [(side, ~side)]
        while len(ups[-1][0]) > 1:
            ups.append(group_nodes(*ups[-1]))
        levels.append(ups)
    while len(levels[0]) != len(levels[1]):
        short = min(levels, key=len)
        short.append(short[-1])
    one = len(left) if not same else 0

    def uniform(k: int, off: int, n: int) -> np.ndarray:
        """The one label below each node of the lowest level, or -1 - its place."""
        at = np.arange(0, n, FAN)
        lo, hi = np.minimum.reduceat(label[off:off + n], at), np.maximum.reduceat(label[off:off + n], at)
        return np.where(lo == hi, lo, -1 - k - at)

    todo = [(len(levels[0]) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, a, b = todo.pop()
        for s in range(0, len(a), chunk):
            x, y = a[s:s + chunk], b[s:s + chunk]
            (o1, z1), (o2, z2) = levels[0][k], levels[1][k]
            apart = np.bitwise_count((o1[x] & z2[y]) | (z1[x] & o2[y]))  # shared bits that differ, accumulated
            keep = apart <= max_bits
            x, y = x[keep], y[keep]
            if k == 1 and len(x):
                u, v = uniform(0, 0, len(left))[x], uniform(1 << 40, one, len(right))[y]
                x, y = x[u != v], y[u != v]
            if not len(x):
                continue
            if k == 0:
                yield (x, y)
                continue
            n1, n2 = len(levels[0][k - 1][0]), len(levels[1][k - 1][0])
            flat = [len(levels[i][k][0]) == (n1, n2)[i] and levels[i][k] is levels[i][k - 1] for i in (0, 1)]
            f1, f2 = (1 if flat[0] else FAN), (1 if flat[1] else FAN)
            for p in range(0, len(x), max(1, chunk // (f1 * f2))):
                xx, yy = x[p:p + max(1, chunk // (f1 * f2))], y[p:p + max(1, chunk // (f1 * f2))]
                cx = (xx[:, None] * f1 + np.arange(f1))[:, :, None].repeat(f2, 2).reshape(-1)
                cy = (yy[:, None] * f2 + np.arange(f2))[:, None, :].repeat(f1, 1).reshape(-1)
                ok = (cx < n1) & (cy < n2) & ((cx < cy) if same and k == 1 else (cx <= cy) if same else True)
                todo.append((k - 1, cx[ok], cy[ok]))


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of each component after adding the links i - j."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def node_stars(rot: np.ndarray, part: np.ndarray, lo: int, hi: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest linked member) places for one unit of the index: all pairs of one part
    (lo == hi), or the pairs between two parts of a large node."""
    order = np.argsort(gray_rank(rot), kind="stable")
    if lo != hi:
        order = np.concatenate([order[part[order] == lo], order[part[order] == hi]])
        cut = int((part == lo).sum())
    vals = rot[order]
    label = np.arange(len(vals))
    if lo == hi:
        for i, j in close_pairs(vals, vals, True, max_bits, label):
            label[:] = merge_labels(label, i, j)
    elif 0 < cut < len(vals):
        for i, j in close_pairs(vals[:cut], vals[cut:], False, max_bits, label):
            label[:] = merge_labels(label, i, j + cut)
    at = np.flatnonzero(label != np.arange(len(vals)))
    return order[at], order[label[at]]


def small_node_pairs(unit: np.ndarray, rot: np.ndarray, sizes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small nodes at once (rows of a unit stand together): each row against the next,
    the one after that, and so on within its unit."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = np.arange(len(unit))
    for k in range(1, int(sizes.max(initial=1))):
        at = at[at + k < len(unit)]
        at = at[unit[at] == unit[at + k]]
        hit = at[np.bitwise_count(rot[at] ^ rot[at + k]) <= max_bits]
        out.append((hit, hit + k))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def blocks_of(max_bits: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of the max_bits + 1 bit blocks."""
    n = max_bits + 1
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(edges[k], edges[k + 1] - edges[k]) for k in range(n)]


def links(fps: DataFrame, max_bits: int = 3, node_limit: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints that join exactly those of every connected group
    (stars within each node of the index, not all pairs). ``fps``: distinct longs in column fp."""
    spark = fps.sparkSession
    blocks = blocks_of(max_bits)
    rot = [F.shiftleft("fp", o).bitwiseOR(F.shiftrightunsigned("fp", 64 - o)) if o else F.col("fp") for o, _ in blocks]
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(rot[t], 64 - w).alias("top"), rot[t].alias("rot")) for t, (_, w) in enumerate(blocks)])).alias("x")).select("fp", "x.*")
    # nodes above the limit: at most (rows / limit) of them, found by one partial aggregate
    big = keyed.groupBy("t", "top").agg(F.count("*").alias("n")).where(F.col("n") > node_limit) \
        .select("t", "top", F.least(F.ceil(F.log2(F.col("n") / node_limit)), F.lit(8)).cast("int").alias("q"))
    width = F.element_at(F.array(*[F.lit(w) for _, w in blocks]), F.col("t") + 1)
    keyed = keyed.join(big, ["t", "top"], "left").withColumn("q", F.coalesce("q", F.lit(0)))
    keyed = keyed.withColumn("w", width)
    keyed = keyed.withColumn("part", F.expr("if(q = 0, 0L, shiftrightunsigned(shiftleft(rot, w), 64 - q))"))
    # a part meets itself and every other part whose prefix is not further than max_bits away
    other = F.expr(f"if(q = 0, array(0L), filter(sequence(0L, shiftleft(1L, q) - 1), s -> bit_count(s ^ part) <= {max_bits}))")
    units = keyed.withColumn("s", F.explode(other)).select(
        "fp", "rot", "part", "t", "top", F.least("part", "s").alias("lo"), F.greatest("part", "s").alias("hi"))
    schema = "a bigint, b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "top", "lo", "hi", "fp", "rot", "part")]
            if held:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from solve([c[:cut] for c in cols])
        if held and len(held[0]):
            yield from solve(held)

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, top, lo, hi, fp, rot_, part = cols
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (top[1:] != top[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        unit = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(t)))
        r = rot_.view(np.uint64)
        small = (sizes <= 4 * FAN)[unit] & (lo == hi)
        at = np.flatnonzero(small)
        found = []
        if len(at):
            i, j = small_node_pairs(unit[at], r[at], sizes[sizes <= 4 * FAN], max_bits)
            found.append((at[i], at[j]))
        for k in np.flatnonzero((sizes > 4 * FAN) | (lo != hi)[starts]):
            s, e = starts[k], starts[k] + sizes[k]
            i, j = node_stars(r[s:e], part[s:e], int(lo[s]), int(hi[s]), max_bits)
            found.append((i + s, j + s))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        if len(i):
            yield out_batch(a=fp[i], b=fp[j])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "t", "top", "lo", "hi").sortWithinPartitions("t", "top", "lo", "hi")
    return dealt.select("t", "top", "lo", "hi", "fp", "rot", "part").mapInArrow(run, schema)


# -- components -------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of ``edges`` (a, b).

    Alternating large-star and small-star steps: each reads a written table of edges and gives one row
    per edge, so no vertex's neighbours are gathered in one place; the driver sees a count and a checksum."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = e.join(low, "a")
        to = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else \
            met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return to.where("a != b").distinct()

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = now
        edges = stored(star(star(edges, True), False), "links")


def component_rows(docs: DataFrame, size: int, max_bits: int) -> DataFrame:
    """(doc_id, th, fp, component_id, root) for every row of ``docs``; root names the component also where it
    has no doc_id."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    roots = stored(components(links(firsts.select("fp"), max_bits)), "roots")
    rooted = firsts.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex digits), component_id (the
    smallest doc_id of the texts reachable over links of at most ``max_bits`` differing bits).

    Null text counts as empty; a text without words has fingerprint zero, linked like any other. Repeated
    rows give repeated results. A null doc_id never names a component unless the component has no other.
    An empty table gives an empty result. Columns besides doc_id and text are not read."""
    return component_rows(docs, size, max_bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, size: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of several texts under that
    doc_id, the one with the smallest hash; of repeated rows, one). A component without any doc_id keeps one
    row too. The columns are those of ``docs``."""
    found = stored(component_rows(docs, size, max_bits).select("doc_id", "th", "root"), "components")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b")).select("b.doc_id", "b.th")
    times = found.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    # what goes, and what stays but stands there more than once: far fewer rows than the documents
    kept = times.join(best, same(times, best), "left_semi")
    gone = stored(times.join(best, same(times, best), "left_anti").select("doc_id", "th"), "dropped_documents")
    again = stored(kept.where("n > 1").select("doc_id", "th"), "repeated_documents")
    rows = docs.select(*keys(), in_one(docs))
    rows = rows.join(gone, same(rows, gone), "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, same(rows, again), "left_anti").select("row.*")
    return once.unionByName(rows.join(again, same(rows, again), "left_semi").dropDuplicates(["doc_id", "th"]).select("row.*"))
