"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Build: rows with a usable vector are dealt to shards of about ``shard_rows`` rows by a hash of the
vector, so equal vectors share a shard and become one graph node with their ids in order.  One task
builds the graph of one shard and keeps it as flat arrays: vectors, and per layer the neighbours of each
node in a row of fixed width, -1 where unused.  The index is a table of one row per shard.

Search: queries are packed in blocks of ``block_rows``, which go to every shard.  Rows are dealt by shard and sorted, so a task
loads a shard's graph once and streams the blocks through it, one in memory at a time; each query has the ``k`` best
of the shard.  A window per query merges the shards' results.  Scores are Euclidean distances in double
precision on the original vectors; ties go to the smaller id.

Only the query's own row is left out of its candidates.  Nodes with equal vectors are expanded by id,
so a query in a large group of equal vectors finds the smallest ids of the group.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
do ids that are null; of rows that repeat a query's id the smallest vector is searched for; vectors of another length than the most frequent one take no part either; with fewer
candidates than ``k`` all are returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage_table


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0)))


class Graph:
    """One shard's graph over distinct vectors."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int, norms: np.ndarray | None = None):
        self.v, self.links, self.entry = vectors, links, entry
        self.norms = (vectors * vectors).sum(1) if norms is None else norms

    def near(self, q: np.ndarray, qq: float, ids: np.ndarray) -> np.ndarray:
        return self.norms[ids] - 2 * (self.v[ids] @ q) + qq

    def layer(self, q: np.ndarray, qq: float, start: list[tuple[float, int]], ef: int, level: int, seen: np.ndarray, mark: int):
        """The ef nearest found on a layer, as a list of (distance, node) in order."""
        links = self.links[level]
        todo, best = list(start), [(-d, i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, i in start:
            seen[i] = mark
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            around = links[i]
            around = around[around >= 0]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            distance = self.near(q, qq, around)
            if len(best) >= ef:
                closer = distance < -best[0][0]
                around, distance = around[closer], distance[closer]
            for d, i in zip(distance.tolist(), around.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-d, i))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, i))
                else:
                    continue
                heapq.heappush(todo, (d, i))
        return sorted((-d, i) for d, i in best)

    def spread(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m neighbours, each nearer to the node than to the ones taken before; then the nearest rest."""
        taken: list[int] = []
        for d, i in found:
            if len(taken) == m:
                break
            if not taken or (self.near(self.v[i], self.norms[i], np.array(taken)) > d).all():
                taken.append(i)
        for _, i in found:
            if len(taken) == m:
                break
            if i not in taken:
                taken.append(i)
        return taken

    def find(self, q: np.ndarray, k: int, ef: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        qq = float(q @ q)
        at = [(float(self.near(q, qq, np.array([self.entry]))[0]), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            at = self.layer(q, qq, at, 1, level, seen, mark)
            mark += 1
        return self.layer(q, qq, at, max(ef, k), 0, seen, mark)[:k]


def build(vectors: np.ndarray, m: int, ef: int, seed: int) -> Graph:
    """Insert the vectors one by one."""
    n = len(vectors)
    draw = np.random.default_rng(seed)
    levels = np.minimum((-np.log(draw.random(n) + 1e-12) / np.log(m)).astype(int), 12)
    top = int(levels.max())
    graph = Graph(vectors, [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)], 0)
    seen, mark, height = np.zeros(n, np.int64), 0, int(levels[0])
    for i in range(1, n):
        q, qq = vectors[i], float(graph.norms[i])
        at = [(float(graph.near(q, qq, np.array([graph.entry]))[0]), graph.entry)]
        for level in range(height, -1, -1):
            mark += 1
            if level > levels[i]:
                at = graph.layer(q, qq, at, 1, level, seen, mark)[:1]
                continue
            at = graph.layer(q, qq, at, ef, level, seen, mark)
            links = graph.links[level]
            width = links.shape[1]
            chosen = graph.spread(at, m)
            links[i, : len(chosen)] = chosen
            for j in chosen:
                free = np.flatnonzero(links[j] < 0)
                if len(free):
                    links[j, free[0]] = i
                else:  # keep the best spread of the old ones and the new one
                    others = np.append(links[j], i)
                    distance = graph.near(vectors[j], float(graph.norms[j]), others)
                    kept = graph.spread(sorted(zip(distance.tolist(), others.tolist())), width)
                    links[j] = -1
                    links[j, : len(kept)] = kept
        if levels[i] > height:
            height, graph.entry = int(levels[i]), i
    return graph


INDEX = "shard int, dim int, vectors binary, first binary, ids binary, entry int, widths array<int>, links array<binary>"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 2000,
                m: int = 16, ef: int = 80, copies: int = 11) -> DataFrame:
    """One row per shard.  Of equal vectors, the ``copies`` smallest ids are kept in the node's list:
    no search returns more of them (k and the query itself)."""
    rows = usable(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (dims[0], dims[1]) if dims else (1, 0)
    shards = max(1, ceil(n / shard_rows))
    # Window with a rank limit: Spark keeps the first rows per task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = (rows.where(F.size("v") == dim).withColumn("rank", rank).where(F.col("rank") <= copies)
             .withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")))

    def make(rows):
        import pandas as pd

        v = np.array(rows["v"].tolist(), np.float64)
        ids = rows["id"].to_numpy()
        order = np.lexsort((ids, *v.T[::-1]))
        v, ids = v[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]).any(1))))
        shard = int(rows["shard"].iloc[0])
        start = np.random.default_rng(shard).permutation(len(first))  # equal neighbours in order would chain
        cut = np.append(first, len(ids))
        ids = np.concatenate([ids[cut[s]: cut[s + 1]] for s in start])
        sizes = (cut[1:] - cut[:-1])[start]
        graph = build(v[first[start]], m, ef, shard)
        return pd.DataFrame([{
            "shard": shard, "dim": dim, "vectors": graph.v.tobytes(), "first": np.append(0, np.cumsum(sizes)).astype(np.int64).tobytes(),
            "ids": ids.astype(np.int64).tobytes(), "entry": graph.entry, "widths": [x.shape[1] for x in graph.links],
            "links": [x.tobytes() for x in graph.links]}])

    return nodes.groupBy("shard").applyInPandas(make, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = 120, block_rows: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's nearest found."""
    wanted = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    n = wanted.count()
    last = index.agg(F.max("shard")).first()[0]  # shards are numbered from 0; one that isn't there finds nothing
    blocks = (wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, ceil(n / block_rows)))))
              .groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))
              .select("queries", F.explode(F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")).alias("shard")))
    columns = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches):
        import pyarrow as pa

        graph = shard = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in (*columns, "queries")}
                if not row["queries"].is_valid:  # a shard's graph comes ahead of the blocks of queries
                    graph, shard = loaded({c: row[c].as_py() for c in columns}), row["shard"].as_py()
                elif row["shard"].as_py() == shard:
                    out = list(answers(*graph, row["queries"].as_py(), k, ef))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    both = index.select(*columns, F.lit(None).cast(blocks.schema["queries"].dataType).alias("queries")).unionByName(blocks, allowMissingColumns=True)
    found = both.repartition("shard").sortWithinPartitions("shard", F.col("queries").isNotNull()).mapInArrow(
        run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "id", "score")


def loaded(row: dict) -> tuple:
    """A shard's graph, the first id of each node, the ids, and marks for its searches."""
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    links = [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(row["links"], row["widths"])]
    first, ids = np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int64)
    return Graph(v, links, row["entry"]), first, ids, np.zeros(len(v), np.int64), [0]


def answers(graph, first, ids, seen, mark, queries: list[dict], k: int, ef: int):
    """(query id, id, distance) of a shard's nearest nodes to each query of a block."""
    for item in queries:
        q = np.array(item["v"], np.float64)
        if len(q) != graph.v.shape[1]:
            continue
        mark[0] += len(graph.links) + 1
        nodes = np.array([i for _, i in graph.find(q, k + 1, ef, seen, mark[0])], np.int64)
        exact = np.sqrt(((graph.v[nodes] - q) ** 2).sum(1))
        found = [(d, int(j)) for d, i in zip(exact.tolist(), nodes) for j in ids[first[i]: first[i + 1]][: k + 1] if j != item["id"]]
        for d, j in heapq.nsmallest(k, found):
            yield item["id"], j, d


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = 2000) -> DataFrame:
    index = stage_table(build_index(vectors, id_col, vector_col, shard_rows, copies=k + 1), "hnsw")
    return search(index, queries, k, id_col=id_col, vector_col=vector_col)
