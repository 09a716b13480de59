"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard of the vectors.

Equal vectors collapse to one node that carries the smallest of their ids, as many as one answer can hold. Nodes are dealt to
shards of about ``SHARD`` by a digest, so shards stay of one size and their number grows with the table. A graph is built in batches:
a greedy search from fixed entry nodes proposes neighbours, robust pruning keeps an edge only where no kept neighbour is closer by
the factor ``alpha``, reverse edges are added and pruned alike; a first round uses ``alpha`` 1, a second ``ALPHA``. Blocks of queries
meet every shard's graph and walk it with a beam; the shards' answers are merged and scored in double precision. Tasks read graphs and
blocks from the written tables: copies of the queries for all shards would grow with queries times shards, in a shuffle or, where Spark
takes them for a small table, in the driver that broadcasts them.

Null vectors, empty ones, zero ones and those with null or non-finite components take no part, nor do rows without an
id. Rows with equal id and vector count once; a query never finds its own id. Vectors of different lengths are searched apart. With
fewer candidates than asked for, all that are found are returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.llm.common import map_batches, written

SHARD = 4_096
QUERIES = 512
# Graphs and blocks of queries in one file, which one task reads: the graphs are dealt to many tasks, and blocks of equal vectors, which
# take little room in a file, do not all meet in one.
FILE_GRAPHS = 4
FILE_BLOCKS = 8
DEGREE = 32
ALPHA = 1.2
BEAM = 64
SEARCH_BEAM = 96
ENTRIES = 24
WIDTH = 4
BATCH = 256
CANDIDATES = 96


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def beam_search(
    points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes that a greedy walk finds and their squared distances (-1, inf where none).

    All queries walk in step; a step opens the ``WIDTH`` nearest unopened nodes of each beam.
    """
    n, b = len(points), len(queries)
    own = _squares(queries)

    def distances(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.einsum("bkd,bd->bk", points[nodes], queries[rows])
        return norms[nodes] - 2 * dots + own[rows, None]

    every = np.arange(b)
    start = np.broadcast_to(entries, (b, len(entries)))
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    first = distances(every, start)
    k = min(beam, len(entries))
    order = np.argsort(first, axis=1)[:, :k]
    ids[:, :k] = np.take_along_axis(start, order, 1)
    dist[:, :k] = np.take_along_axis(first, order, 1)
    opened = ids < 0
    seen = np.zeros((b, n + 1), bool)
    seen[:, entries] = True
    seen[:, n] = True  # stands for "no neighbour"
    live = every
    while len(live):
        # Beams are sorted, so the first unopened places are the nearest.
        rank = np.argsort(opened[live], axis=1, kind="stable")[:, :WIDTH]
        fresh = ~np.take_along_axis(opened[live], rank, 1)
        go = fresh.any(axis=1)
        live, rank, fresh = live[go], rank[go], fresh[go]
        if not len(live):
            break
        chosen = np.where(fresh, ids[live[:, None], rank], n)
        opened[live[:, None], rank] = True
        near = graph[chosen].reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        known = seen[live[:, None], near]
        near = np.where(known, n, near)
        seen[live[:, None], near] = True
        far = np.where(near < n, distances(live, np.minimum(near, n - 1)), np.inf).astype(np.float32)
        both = np.concatenate([dist[live], far], axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(near < n, near, -1)], axis=1), order, 1)
        dist[live] = np.take_along_axis(both, order, 1)
        flags = np.concatenate([opened[live], near >= n], axis=1)
        opened[live] = np.take_along_axis(flags, order, 1)
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
    """Up to ``DEGREE`` neighbours of each node: the nearest candidate again and again, dropping those it covers."""
    candidates = np.sort(candidates, axis=1)
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    x = points[np.maximum(candidates, 0)]
    norms = np.einsum("bcd,bcd->bc", x, x)
    own = points[nodes]
    to_node = norms - 2 * np.einsum("bcd,bd->bc", x, own) + _squares(own)[:, None]
    if candidates.shape[1] > CANDIDATES:
        near = np.argsort(np.where(valid, to_node, np.inf), axis=1)[:, :CANDIDATES]
        candidates, valid, to_node, norms = (np.take_along_axis(a, near, 1) for a in (candidates, valid, to_node, norms))
        x = np.take_along_axis(x, near[:, :, None], 1)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    kept = np.full((len(nodes), DEGREE), -1)
    rows = np.arange(len(nodes))
    for k in range(DEGREE):
        pick = np.where(valid, to_node, np.inf).argmin(axis=1)
        some = valid[rows, pick]
        if not some.any():
            break
        kept[some, k] = candidates[some, pick[some]]
        valid &= ~((alpha * alpha * between[rows, pick] <= to_node) & some[:, None])
        valid[rows, pick] = False
    return kept


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``graph, entries`` of the points; a last row of the graph without neighbours stands for "no node"."""
    n = len(points)
    rng = np.random.default_rng(seed)
    norms = _squares(points)
    centre = points.mean(axis=0)
    medoid = int((norms - 2 * points @ centre).argmin())
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), medoid))
    graph = np.full((n + 1, DEGREE), -1)
    if n <= DEGREE + 1:
        for i in range(n):
            others = np.delete(np.arange(n), i)
            graph[i, : n - 1] = others
        return graph, entries
    graph[:n, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            found, _ = beam_search(points, norms, graph, entries, points[nodes], BEAM)
            graph[nodes] = robust_prune(points, nodes, np.concatenate([found, graph[nodes]], axis=1), alpha)
            _add_reverse(points, graph, nodes, alpha)
    return graph, entries


def _add_reverse(points: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Adds the edges back to ``nodes``; where a node has no room, it is pruned anew."""
    target = graph[nodes].ravel()
    source = np.repeat(nodes, DEGREE)[target >= 0]
    target = target[target >= 0]
    there = (graph[target] == source[:, None]).any(axis=1)
    order = np.argsort(target[~there], kind="stable")
    target, source = target[~there][order], source[~there][order]
    if not len(target):
        return
    unique, start, count = np.unique(target, return_index=True, return_counts=True)
    at = np.arange(len(target)) - np.repeat(start, count)
    more = np.full((len(unique), count.max()), -1)
    more[np.repeat(np.arange(len(unique)), count), at] = source
    for k in range(0, len(unique), BATCH):
        part = slice(k, k + BATCH)
        both = np.concatenate([graph[unique[part]], more[part]], axis=1)
        graph[unique[part]] = robust_prune(points, unique[part], both, alpha)


def usable(vector: str) -> str:
    """Condition for vectors that take part."""
    return (
        f"`{vector}` is not null and size(`{vector}`) > 0 "
        f"and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        f"and exists(`{vector}`, x -> x <> 0)"
    )


def shard_graphs(nodes: DataFrame, shards: int) -> DataFrame:
    """``dim, shard, ids, points, graph, entries``: one row per shard; ``ids`` holds the ids of each node's vectors."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        points = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
        graph, entries = build_graph(points)
        ids = [list(map(int, x)) for x in pdf["ids"]]
        return pd.DataFrame({
            "dim": [int(pdf["dim"].iloc[0])],
            "shard": [int(pdf["shard"].iloc[0])],
            "ids": [ids],
            "points": [np.stack(pdf["vector"].to_numpy()).astype(np.float64).tobytes()],
            "graph": [graph.astype(np.int32).tobytes()],
            "entries": [entries.astype(np.int32).tobytes()],
        })

    schema = "dim int, shard int, ids array<array<bigint>>, points binary, graph binary, entries binary"
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, schema)


def search_shard(
    points: np.ndarray, graph: np.ndarray, entries: np.ndarray, ids: list[list[int]], queries: np.ndarray,
    query_ids: list[int], k: int,
) -> Iterator[tuple[int, int, float]]:
    """``query id, id, distance``: the ``k`` nearest of a shard for each query, own id left out."""
    small = points.astype(np.float32)
    found, _ = beam_search(small, _squares(small), graph, entries, queries.astype(np.float32), SEARCH_BEAM)
    for row, query_id in enumerate(query_ids):
        near = found[row][found[row] >= 0][: 3 * k + 3]
        scores = np.sqrt(((points[near] - queries[row]) ** 2).sum(axis=1))
        hits = sorted((float(s), i) for s, node in zip(scores, near, strict=True) for i in ids[node] if i != query_id)
        for score, i in hits[:k]:
            yield query_id, i, score


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``queries`` among the rows of ``df``."""

    def clean(frame: DataFrame) -> DataFrame:
        return (
            frame.where(usable(vector)).where(F.col(f"`{key}`").isNotNull())
            .select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
            .distinct()
        )

    # Of equal vectors only the k + 1 smallest ids can be in an answer; the limit is applied before the shuffle.
    order = W.partitionBy("vector").orderBy("id")
    nodes = written(
        clean(df).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("node", F.element_at("ids", 1)).withColumn("dim", F.size("vector")),
        "nodes",
    )
    asked = written(clean(queries).withColumn("dim", F.size("vector")), "queries")
    shards = max(1, -(-nodes.count() // SHARD))
    blocks = max(1, -(-asked.count() // QUERIES))
    graphs = written(shard_graphs(nodes, shards), "graphs", FILE_GRAPHS)
    block = written(
        asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        .groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("asked")),
        "blocks", FILE_BLOCKS,
    )
    # Every task pairs some graphs with some blocks and reads both itself: nothing is copied, shuffled or sent by the driver.
    tasks = graphs.join(block.hint("shuffle_replicate_nl"), "dim")

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for dims, *columns in batches:
            out = []
            for dim, questions, ids, points, graph, entries in zip(dims, *columns, strict=True):
                out += search_shard(
                    np.frombuffer(points).reshape(-1, dim), np.frombuffer(graph, np.int32).reshape(-1, DEGREE),
                    np.frombuffer(entries, np.int32), ids, np.array([q["vector"] for q in questions]),
                    [q["id"] for q in questions], k,
                )
            yield list(map(list, zip(*out, strict=True))) if out else [[], [], []]

    wanted = ["dim", "asked", "ids", "points", "graph", "entries"]
    hits = map_batches(tasks, wanted, run, "query_id bigint, vec_id bigint, score double", rows=2)
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
