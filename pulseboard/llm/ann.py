"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's graph is one row: the
vectors and, for every layer, the neighbour lists as one flat array. Queries go to every shard in blocks,
walk its layers greedily and end in a beam search on the lowest; the shards' results are merged by
exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import out_batch, stored

EXPAND = 4  # beam nodes whose neighbours are visited in one step
INDEX = "dim int, shard bigint, vectors binary, offsets binary, members binary, layers binary, nodes binary, links binary"


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a vector that is not empty, not zero and finite throughout; repeated rows once."""
    v = F.col(vector).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(fit).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")) \
        .withColumn("dim", F.size("v"))


def diverse(cand: np.ndarray, dist: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (ascending distance, -1 for none) at most ``m``, -1 padded: those nearer to
    the row than to any chosen before, then the nearest of the rest."""
    rows, c = cand.shape
    if not c:
        return np.full((rows, m), -1, np.int32)
    x = vectors[np.maximum(cand, 0)]
    sq = (x * x).sum(-1)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((rows, c), bool)
    for p in range(c):
        ok = (cand[:, p] >= 0) & (chosen.sum(1) < m)
        chosen[:, p] = ok & np.all(~chosen | (between[:, p, :] > dist[:, p, None]), axis=1)
    order = np.argsort(np.where(cand < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, order, 1).astype(np.int32)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def nearest_earlier(x: np.ndarray, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows a..b of x: (places, squared distances) of the k nearest rows before each."""
    d = np.maximum((x[a:b] ** 2).sum(1)[:, None] + (x[:b] ** 2).sum(1)[None, :] - 2 * x[a:b] @ x[:b].T, 0)
    d[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = np.inf
    k = min(k, b)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < b else np.tile(np.arange(b), (b - a, 1))
    dist = np.take_along_axis(d, at, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isinf(dist), -1, at), dist


def layer_links(x: np.ndarray, m: int, most: int, width: int) -> np.ndarray:
    """Neighbours (rows x most, -1 padded) of one layer: each node in turn links to diverse ones among its
    nearest before it, links run both ways, and lists longer than ``most`` are pruned to diverse ones."""
    n = len(x)
    ends: list[np.ndarray] = []
    for a in range(0, n, 256):
        cand, dist = nearest_earlier(x, a, min(n, a + 256), width)
        pick = diverse(cand, dist, x, m)
        i, j = np.nonzero(pick >= 0)
        ends.append(np.stack([i + a, pick[i, j]]))
    i, j = np.concatenate(ends, axis=1)
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    dist = ((x[src] - x[dst]) ** 2).sum(1)
    order = np.lexsort((dst, dist, src))
    src, dst, dist = src[order], dst[order], dist[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, most), -1, np.int32)
    few = rank < most
    out[src[few], rank[few]] = dst[few]
    large = np.flatnonzero(np.bincount(src, minlength=n) > most)
    for a in range(0, len(large), 256):
        some = large[a:a + 256]
        cand, far = np.full((len(some), 4 * most), -1), np.full((len(some), 4 * most), np.inf)
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        hit = (place[src] >= 0) & (rank < 4 * most)
        cand[place[src[hit]], rank[hit]], far[place[src[hit]], rank[hit]] = dst[hit], dist[hit]
        out[some] = diverse(cand, far, x, most)
    return out


class Graph:
    """A shard: distinct vectors, the ids of each (ascending), nodes and neighbour lists by layer."""

    def __init__(self, vectors, offsets, members, nodes, links):
        self.vectors, self.offsets, self.members, self.nodes, self.links = vectors, offsets, members, nodes, links
        self.small = vectors.astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, seed: int, m: int, width: int) -> Graph:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        offsets = np.append(np.flatnonzero(new), len(ids))
        shuffle = np.random.default_rng(seed).permutation(len(offsets) - 1)  # the order of insertion
        members = np.concatenate([ids[offsets[k]:offsets[k + 1]] for k in shuffle])
        sizes = np.diff(offsets)[shuffle]
        distinct = vectors[offsets[:-1]][shuffle]
        height = np.floor(-np.log(1 - np.random.default_rng(seed + 1).random(len(distinct))) / np.log(m)).astype(int)
        nodes, links = [], []
        for layer in range(height.max(initial=0) + 1):
            at = np.flatnonzero(height >= layer)
            near = layer_links(distinct[at].astype(np.float32), m, 2 * m if layer == 0 else m, width)
            nodes.append(at.astype(np.int32))
            links.append(np.where(near >= 0, at[np.maximum(near, 0)], -1).astype(np.int32))
        return cls(distinct, np.concatenate([[0], np.cumsum(sizes)]), members, nodes, links)

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances in single precision, for the walk; -1 is infinitely far."""
        d = self.small[np.maximum(at, 0)] - q[:, None, :]
        return np.where(at >= 0, np.einsum("abc,abc->ab", d, d), np.inf)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Places (rows x width, -1 padded) of the vectors that the beam ends with."""
        q, n = queries.astype(np.float32), len(queries)
        here = np.full(n, self.nodes[-1][0])
        for nodes, links in zip(self.nodes[:0:-1], self.links[:0:-1], strict=True):
            row = np.full(len(self.vectors), -1)
            row[nodes] = np.arange(len(nodes))
            best, moving = self.distances(q, here[:, None])[:, 0], np.arange(n)
            while len(moving):
                near = links[row[here[moving]]]
                d = self.distances(q[moving], near)
                k = d.argmin(1)
                d = d[np.arange(len(k)), k]
                go = d < best[moving]
                moving = moving[go]
                here[moving], best[moving] = near[np.flatnonzero(go), k[go]], d[go]
        beam = np.full((n, width), -1)
        far = np.full((n, width), np.inf)
        done = np.ones((n, width), bool)
        beam[:, 0], far[:, 0], done[:, 0] = here, self.distances(q, here[:, None])[:, 0], False
        seen = np.zeros((n, len(self.vectors)), bool)
        seen[np.arange(n), here] = True
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, far[live])
            pick = np.argsort(open_, axis=1, kind="stable")[:, :EXPAND]
            ok = np.take_along_axis(open_, pick, 1) < np.inf
            live, pick, ok = live[ok.any(1)], pick[ok.any(1)], ok[ok.any(1)]
            if not len(live):
                break
            done[live[:, None], pick] = True
            near = np.where(ok[:, :, None], self.links[0][np.maximum(beam[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            d = self.distances(q[live], near)
            everyone, dist = np.concatenate([beam[live], near], 1), np.concatenate([far[live], d], 1)
            flags = np.concatenate([done[live], ~(near >= 0)], 1)
            keep = np.argsort(dist, axis=1, kind="stable")[:, :width]
            beam[live], far[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (everyone, dist, flags))
        return np.where(np.isinf(far), -1, beam)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> list[tuple[int, int, float]]:
        """(query, id, distance in double precision) of the k nearest ids of this shard, the query's own left out."""
        found, out = self.search(queries, width), []
        for qid, q, at in zip(query_ids.tolist(), queries, found, strict=True):
            at = at[at >= 0]
            if len(at) < min(k + 1, len(self.vectors)):  # the walk met too few: a shard's vectors are few enough to scan
                at = np.arange(len(self.vectors))
            d = np.sqrt(((self.vectors[at] - q) ** 2).sum(1))
            order = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])  # one more than k, for the query itself, and ties
            ids = [self.members[self.offsets[p]:self.offsets[p + 1]][:k + 1] for p in at[order]]
            every = np.concatenate(ids)
            dist = np.repeat(d[order], [len(x) for x in ids])
            dist, every = dist[every != qid], every[every != qid]
            best = np.lexsort((every, dist))[:k]
            out += [(qid, i, s) for i, s in zip(every[best].tolist(), dist[best].tolist(), strict=True)]
        return out


def build_index(vectors: DataFrame, shard_rows: int = 4096, m: int = 16, width: int = 64) -> DataFrame:
    """One row per shard of about ``shard_rows`` vectors: the graph as flat arrays. Written to the shared folder."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = Graph.build(group["id"].to_numpy(np.int64), np.stack(group["v"].to_list()).astype(np.float64), int(key[1]), m, width)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "vectors": g.vectors.tobytes(), "offsets": g.offsets.astype(np.int64).tobytes(), "members": g.members.tobytes(),
                              "layers": np.array([len(x) for x in g.nodes], np.int64).tobytes(), "nodes": b"".join(x.tobytes() for x in g.nodes), "links": b"".join(x.tobytes() for x in g.links)}])

    dealt = vectors.distinct().withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("bigint"))
    return stored(dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX), "ann_index")


def read_graph(row: dict, m: int) -> Graph:
    layers = np.frombuffer(row["layers"], np.int64)
    nodes = np.split(np.frombuffer(row["nodes"], np.int32), np.cumsum(layers)[:-1])
    links, flat, at = [], np.frombuffer(row["links"], np.int32), 0
    for k, n in enumerate(layers):
        most = 2 * m if k == 0 else m
        links.append(flat[at:at + n * most].reshape(n, most))
        at += n * most
    return Graph(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["members"], np.int64), nodes, links)


def search(index: DataFrame, queries: DataFrame, k: int = 10, m: int = 16, width: int = 160, block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``index`` for each row (id, v, dim) of ``queries``.
    Queries go in blocks to every shard of their dimension."""
    blocks = max(1, -(-queries.count() // block))
    packed = queries.distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: v[0] for c, v in b.slice(i, 1).to_pydict().items()}
                ids = np.array([q["id"] for q in row["queries"]], np.int64)
                found = read_graph(row, m).nearest(ids, np.array([q["v"] for q in row["queries"]], np.float64), k, width)
                q, v, s = zip(*found, strict=True) if found else ((), (), ())
                yield out_batch(query_id=pa.array(q, pa.int64()), vec_id=pa.array(v, pa.int64()), score=pa.array(s, pa.float64()))

    met = index.join(sent, ["dim", "shard"]).repartition(2 * blocks + 6, "shard", "block").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): of each vector whose vec_id is divisible by ``every``, the ``k``
    nearest others found, by Euclidean distance in double precision, ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without vec_id. Vectors are compared with those of their own dimension. Rows that repeat a vec_id with
    the same vector count once; a query meets no row of its own vec_id. With fewer than ``k`` candidates all
    are returned; an empty table gives an empty result."""
    vectors = stored(usable(embeddings, "vec_id", "embedding"), "vectors")
    return search(build_index(vectors), vectors.where(F.pmod("id", F.lit(every)) == 0), k)
