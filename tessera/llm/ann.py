"""Approximate nearest neighbours: a navigable small-world graph for each shard, in flat arrays, and merged results."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a shard on average; links of a node (twice as many on the ground level); candidates kept when building and searching.
SHARD_ROWS, LINKS, BUILD_EF, SEARCH_EF = 4096, 12, 48, 160
#: Queries that one task takes through one shard, on average; a graph is sent once to each block of queries.
QUERY_BLOCK = 16_384
GRAPH = "dim int, shard int, n int, vectors binary, first binary, members binary, levels binary, links binary, entry int"


@dataclass
class Graph:
    """vectors (n x d); links: for each level an n x width array of neighbours, -1 where there are fewer; top: each node's level."""

    vectors: np.ndarray
    links: list[np.ndarray]
    top: np.ndarray
    entry: int

    def __post_init__(self):
        self.x = self.vectors.astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)

    def away(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances, less the query's own square."""
        return self.norm[ids] - 2 * (self.x[ids] @ q)

    def descend(self, q: np.ndarray, at: int, level: int) -> int:
        """Greedy steps on one level."""
        best = float(self.away(q, np.array([at]))[0])
        while True:
            ids = self.links[level][at]
            ids = ids[ids >= 0]
            if not len(ids):
                return at
            d = self.away(q, ids)
            k = int(d.argmin())
            if d[k] >= best:
                return at
            best, at = float(d[k]), int(ids[k])

    def near(self, q: np.ndarray, at: int, level: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest nodes met on a level, nearest first."""
        seen = np.zeros(len(self.x), bool)
        seen[at] = True
        d = float(self.away(q, np.array([at]))[0])
        todo, best = [(d, at)], [(-d, at)]
        links = self.links[level]
        while todo:
            d, c = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            ids = links[c]
            ids = ids[ids >= 0]
            ids = ids[~seen[ids]]
            if not len(ids):
                continue
            seen[ids] = True
            for e, i in zip(self.away(q, ids).tolist(), ids.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, i))
                    heapq.heappush(todo, (e, i))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, i))
                    heapq.heappush(todo, (e, i))
        return sorted((-d, i) for d, i in best)

    def apart(self, ids: np.ndarray, d: np.ndarray, most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to one taken before; filled up with the nearest."""
        x = self.x[ids]
        between = self.norm[ids][:, None] + self.norm[ids][None, :] - 2 * (x @ x.T)
        taken: list[int] = []
        closest = np.full(len(ids), np.inf, np.float32)
        for k in range(len(ids)):
            if d[k] < closest[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.minimum(closest, between[k], out=closest)
        rest = [k for k in range(len(ids)) if k not in set(taken)]
        return [int(ids[k]) for k in (taken + rest)[:most]]

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        q = q.astype(np.float32)
        at = self.entry
        for level in range(len(self.links) - 1, 0, -1):
            at = self.descend(q, at, level)
        return [i for _, i in self.near(q, at, 0, ef)]


def build(vectors: np.ndarray, links: int = LINKS, ef: int = BUILD_EF, seed: int = 1) -> Graph:
    """The graph of distinct vectors, inserted in the order given; levels come from a seeded generator."""
    n = len(vectors)
    top = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(np.int64), 8)
    g = Graph(vectors, [np.full((n, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(top.max()) + 1)], top, 0)
    degree = [np.zeros(n, np.int64) for _ in g.links]
    for i in range(1, n):
        q, at, high = g.x[i], g.entry, int(top[g.entry])
        for level in range(high, int(top[i]), -1):
            at = g.descend(q, at, level)
        for level in range(min(high, int(top[i])), -1, -1):
            found = g.near(q, at, level, ef)
            at, table, deg = found[0][1], g.links[level], degree[level]
            ids = np.array([j for _, j in found])
            d = np.array([e for e, _ in found], np.float32) + g.norm[i]
            for k, j in enumerate(g.apart(ids, d, links)):
                table[i, k] = j
                deg[i] = k + 1
                if deg[j] < table.shape[1]:
                    table[j, deg[j]] = i
                    deg[j] += 1
                else:  # full: keep a spread of the old neighbours and the new one
                    c = np.append(table[j], i)
                    e = g.away(g.x[j], c) + g.norm[j]
                    order = np.argsort(e, kind="stable")
                    table[j] = g.apart(c[order], e[order], table.shape[1])
        if top[i] > top[g.entry]:
            g.entry = i
    return g


def usable(v: Column) -> Column:
    """Vectors that take part: not null or empty, without null or non-finite components, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(the graphs, one row a shard, from (vec_id, embedding array<double>); the number of shards). Shards hold rows by a hash of vec_id and are
    bounded on average by shard_rows, whatever values are common: equal vectors of a shard are one node with several members."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))

    def graph(pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        node = node.reshape(-1)
        order = np.argsort(node, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(distinct)))]).astype(np.int64)
        mixed = np.random.default_rng(0).permutation(len(distinct))  # inserted in no particular order
        distinct, members = distinct[mixed], pdf["vec_id"].to_numpy(np.int64)[order]
        members = np.concatenate([members[first[k] : first[k + 1]] for k in mixed])
        first = np.concatenate([[0], np.cumsum(np.diff(first)[mixed])]).astype(np.int64)
        g = build(distinct)
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(distinct), g.vectors.tobytes(), first.tobytes(), members.tobytes(), g.top.tobytes(), b"".join(t.tobytes() for t in g.links), g.entry)], columns=[c.split()[0] for c in GRAPH.split(", ")])

    return stored(rows.repartition(4 * shards, "shard", "dim").groupBy("dim", "shard").applyInPandas(graph, GRAPH)), shards


def _restored(r) -> tuple[Graph, np.ndarray, np.ndarray]:
    top = np.frombuffer(r.levels, np.int64)
    flat, links, at = np.frombuffer(r.links, np.int32), [], 0
    for k in range(int(top.max()) + 1):
        width = LINKS * (2 if k == 0 else 1)
        links.append(flat[at : at + r.n * width].reshape(r.n, width))
        at += r.n * width
    return Graph(np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim), links, top, r.entry), np.frombuffer(r.first, np.int64), np.frombuffer(r.members, np.int64)


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int = 10, ef: int = SEARCH_EF) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found, from (vec_id, embedding) queries.

    Queries, far fewer than rows, fan out to all shards and meet each shard's graph there, in blocks; a graph is read once a block. Each shard
    gives its k nearest for a query, and those are merged."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    fan = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), fan(shards, "shard"))
    graphs = graphs.select("*", fan(blocks, "block"))

    def run(of_shard, of_queries):
        import pandas as pd

        out = []
        for r in of_shard.itertuples():  # one, or none where a shard holds no vector of this dimension
            g, first, members = _restored(r)
            for q, v in zip(of_queries["vec_id"].tolist(), of_queries["embedding"], strict=True):
                v = np.asarray(v, np.float64)
                nodes = np.array(g.search(v, max(ef, k + 1)))
                exact = np.sqrt(((g.vectors[nodes] - v) ** 2).sum(1))
                rows = [(d, int(m)) for d, i in zip(exact.tolist(), nodes.tolist(), strict=True) for m in members[first[i] : first[i + 1]][: k + 1] if m != q]
                out += [(q, m, d) for d, m in heapq.nsmallest(k, rows)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys, parts = ("shard", "block", "dim"), 4 * shards * blocks
    found = graphs.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row that is_query picks, the k nearest others by Euclidean distance (all, if fewer), as found by the graphs.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without vec_id; vectors
    are candidates for queries of their own dimension alone. Repeated rows (equal vec_id and vector) count
    once; a vec_id with several vectors has several candidates, none of which is found for its own queries. Ties go to the
    smaller vec_id. An empty table gives an empty result."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = stored(v.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"]))
    return search(*index(v, shard_rows), v.filter(is_query), k)
