"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Vectors are dealt into shards of bounded size. A shard's graph grows in batches: a greedy beam search in the
graph so far proposes neighbours for each new vector, relaxed distance pruning (a candidate goes if it is
`alpha` times nearer to a neighbour already chosen than to the vector itself) keeps diverse edges, and the
vectors reached get edges back, pruned alike. Inner product becomes distance by one more coordinate that
gives all vectors of a shard the same length. Queries come in blocks; each block searches every shard by beam
search, and the best of all shards are returned with their inner product in double precision.

Equal vectors are one node that knows its least k + 1 ids, which is all that a list of k can hold of them; the
limit applies before the shuffle, so a vector that a third of all rows share costs each task a few rows.
Equal query vectors are searched for once.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; vectors of different length are never compared; rows equal in id and vector count once; a query never finds its own id; if
fewer than k candidates exist, all are returned; a shard no larger than the beam is searched whole; other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, small_batches

#: Vectors of a shard, queries of a block.
SHARD, BLOCK = 8192, 1024
DEGREE, BEAM, ALPHA, WIDTH = 36, 160, 1.2, 4
K = 20
#: Vectors added to a graph at once, at most.
BATCH = 512
#: Tasks that shards are dealt out to for the search, at most; a task takes its shards one by one.
SEARCH_TASKS = 10_000


def _prune(own: np.ndarray, candidates: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(n, degree) neighbours for each of own (point numbers) out of candidates (n, c), where -1 is none; repeats allowed."""
    out = np.full((len(own), degree), -1, np.int32)
    for at in range(0, len(own), 64):
        mine, cand = own[at : at + 64], candidates[at : at + 64]
        there = points[np.maximum(cand, 0)]
        centre = points[mine]
        squares = np.einsum("ncd,ncd->nc", there, there)
        near = squares - 2 * np.einsum("ncd,nd->nc", there, centre) + np.einsum("nd,nd->n", centre, centre)[:, None]
        alive = (cand >= 0) & (cand != mine[:, None])
        near = np.where(alive, near, np.inf)
        rows = np.arange(len(mine))
        for r in range(degree):
            best = near.argmin(axis=1)
            open_ = np.isfinite(near[rows, best])
            if not open_.any():
                break
            out[at + rows[open_], r] = cand[rows[open_], best[open_]]
            chosen = there[rows, best]
            apart = squares - 2 * np.einsum("ncd,nd->nc", there, chosen) + squares[rows, best][:, None]
            gone = alpha * alpha * apart <= near
            gone[rows, best] = True
            near[gone & open_[:, None]] = np.inf
    return out


def beam_search(points: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, width: int = WIDTH) -> np.ndarray:
    """(n, beam) point numbers near each query, nearest first by distance, -1 where fewer were reached."""
    n, half = len(queries), np.einsum("nd,nd->n", points, points) / 2
    seen = np.zeros((n, len(points) + 1), bool)
    rows = np.arange(n)[:, None]
    ids = np.broadcast_to(entry, (n, len(entry))).astype(np.int32)
    seen[rows, ids] = True
    far = half[ids] - np.einsum("ncd,nd->nc", points[ids], queries)
    done = np.zeros(ids.shape, bool)
    while True:
        if ids.shape[1] > beam:
            keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            ids, far, done = (np.take_along_axis(x, keep, axis=1) for x in (ids, far, done))
        waiting = np.where(done, np.inf, far)
        some = min(width, ids.shape[1])
        turn = np.argpartition(waiting, some - 1, axis=1)[:, :some] if some < ids.shape[1] else np.broadcast_to(np.arange(some), (n, some))
        live = np.isfinite(np.take_along_axis(waiting, turn, axis=1))
        if not live.any():
            break
        np.put_along_axis(done, turn, True, axis=1)
        next_ = graph[np.take_along_axis(ids, turn, axis=1)]
        next_[~live] = -1
        next_ = next_.reshape(n, -1)
        # among equal new ones only the first counts
        next_ = np.sort(next_, axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        next_[seen[rows, next_]] = -1  # -1 is the last, unused column
        seen[rows, next_] = True
        seen[:, -1] = False
        most = int((next_ >= 0).sum(axis=1).max())
        if not most:
            continue
        next_ = -np.sort(-next_, axis=1)[:, :most]
        away = half[next_] - np.einsum("ncd,nd->nc", points[next_], queries)
        away[next_ < 0] = np.inf
        ids, far = np.concatenate([ids, next_], axis=1), np.concatenate([far, away], axis=1)
        done = np.concatenate([done, next_ < 0], axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, axis=1)
    ids[~np.isfinite(np.take_along_axis(far, order, axis=1))] = -1
    return ids


def level(vectors: np.ndarray) -> np.ndarray:
    """vectors with one more coordinate that gives all of them the greatest one's length."""
    squares = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
    rest = np.sqrt(np.maximum(0.0, squares.max() - squares))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The graph (n, degree), -1 padded, and its entry points."""
    points, n = level(vectors), len(vectors)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    graph = np.full((n, degree), -1, np.int32)
    centre = points.mean(axis=0)
    entry = np.array([order[: min(n, 2 * BATCH)][np.argmin(((points[order[: min(n, 2 * BATCH)]] - centre) ** 2).sum(axis=1))]], np.int32)
    order = np.concatenate([entry, order[order != entry[0]]])
    at = 0
    while at < n:
        batch = order[at : at + max(1, min(BATCH, max(64, at)))]
        among = min(24, len(batch))
        gram = points[batch] @ points[batch].T
        np.fill_diagonal(gram, -np.inf)
        beside = batch[np.argpartition(-gram, among - 1, axis=1)[:, :among]]
        reached = beam_search(points, graph, entry, points[batch], beam) if at else np.full((len(batch), 1), -1, np.int32)
        graph[batch] = _prune(batch, np.concatenate([reached, beside], axis=1), points, degree, alpha)
        # edges back
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        at += len(batch)
        if not len(target):  # a single vector has no neighbour
            continue
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(hit), degree + int(count.max())), -1, np.int32)
        back[:, :degree] = graph[hit]
        row = np.repeat(np.arange(len(hit)), count)
        back[row, degree + np.arange(len(source)) - np.repeat(first, count)] = source
        full = (back >= 0).sum(axis=1) > degree
        if (~full).any():
            graph[hit[~full]] = -np.sort(-_once(back[~full]), axis=1)[:, :degree]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 512)):
            if len(part):
                graph[hit[part]] = _prune(hit[part], _once(back[part]), points, degree, alpha)
    return graph, entry


def _once(ids: np.ndarray) -> np.ndarray:
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    whole = F.col(f"`{embedding}`")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(f"`{vec_id}`").isNotNull() & whole.isNotNull() & (F.size(whole) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(whole, lambda x: x != 0)
    return vectors.where(usable).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("embedding"))


INDEX = "dim int, shard int, n int, vectors binary, graph binary, entry int, ids binary, counts binary"


def _indexed(distinct: DataFrame, shards: int, **options) -> DataFrame:
    """A row for each shard: its vectors, graph and ids."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first", kind="stable")
        vectors = np.array(group["embedding"].tolist(), np.float64)
        graph, entry = build(vectors, **options)
        ids = [np.asarray(x, np.int64) for x in group["ids"]]
        return pd.DataFrame(
            {
                "dim": [int(group["dim"].iloc[0])], "shard": [int(group["shard"].iloc[0])], "n": [len(group)], "vectors": [vectors.tobytes()], "graph": [graph.tobytes()],
                "entry": [int(entry[0])], "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(x) for x in ids], np.int32).tobytes()],
            }
        )

    dealt = distinct.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(one, INDEX)


def _lists(index, blocks, k: int, beam: int) -> pd.DataFrame:
    """The k + 1 nearest ids in a shard for each query of a block."""
    n = int(index.n)  # a float beside rows of blocks, which have none
    vectors = np.frombuffer(index.vectors, np.float64).reshape(n, index.dim)
    queries = np.array([np.asarray(q, np.float64) for q in blocks.queries])
    counts = np.frombuffer(index.counts, np.int32)
    ids, ends = np.frombuffer(index.ids, np.int64), np.cumsum(counts)
    if n <= beam:
        near = np.broadcast_to(np.arange(n), (len(queries), n))
    else:
        points = level(vectors)
        graph = np.frombuffer(index.graph, np.int32).reshape(n, -1)
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        near = np.concatenate([beam_search(points, graph, np.array([int(index.entry)], np.int32), flat[at : at + 256], beam) for at in range(0, len(flat), 256)])
    score = np.einsum("ncd,nd->nc", vectors[np.maximum(near, 0)], queries)
    score[near < 0] = -np.inf
    most = min(k + 1, near.shape[1])
    top = np.argsort(-score, axis=1, kind="stable")[:, : most + 8]
    keys, seconds, out, scores = [], [], [], []
    for i, key in enumerate(blocks.keys):
        listed = [(-score[i, j], v) for j in top[i].tolist() if near[i, j] >= 0 for v in ids[ends[near[i, j]] - counts[near[i, j]] : ends[near[i, j]]].tolist()]
        listed.sort()
        for s, v in listed[: k + 1]:
            keys.append(key)
            seconds.append(blocks.seconds[i])
            out.append(v)
            scores.append(-s)
    return pd.DataFrame({"key": keys, "second": seconds, "vec_id": out, "score": scores}).astype({"key": "int64", "second": "int64", "vec_id": "int64", "score": "float64"})


def _search(index: DataFrame, blocks: DataFrame, shards: int, copies: int, k: int, beam: int) -> DataFrame:
    """(key, vec_id, score): the k + 1 nearest ids of each query of a block in a shard.

    A shard's row crosses the network `copies` times, however many blocks there are; the blocks come sorted behind
    it, and the task holds one shard and one block at a time.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block < 0:
                    held = row
                elif held is not None and (held.dim, held.shard, held.copy) == (row.dim, row.shard, row.copy):
                    yield _lists(held, row, k, beam)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = index.withColumn("copy", each(copies)).withColumn("block", F.lit(-1))
    asked = blocks.withColumn("shard", each(shards)).withColumn("copy", F.pmod("block", F.lit(copies)))
    rows = placed.unionByName(asked, allowMissingColumns=True)
    # more partitions than shards, so that few of them hold two while others wait
    dealt = rows.repartition(min(4 * shards * copies, SEARCH_TASKS), "dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "block")
    return dealt.mapInPandas(found, "key long, second long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, block: int = BLOCK, beam: int = BEAM, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors found for each of queries, of the same columns."""
    small_batches(vectors.sparkSession)
    usable = _usable(vectors, vec_id, embedding).distinct()
    least = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= k + 1)
    distinct = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first")), "vectors")
    shards = max(1, math.ceil(distinct.count() / shard))
    index = materialize(_indexed(distinct, shards, degree=degree, beam=beam, alpha=alpha), "index")
    keyed = _usable(queries, vec_id, embedding).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.xxhash64("embedding").alias("key"), F.hash("embedding").cast("long").alias("second"))
    wanted = keyed.groupBy("embedding").agg(F.first("key").alias("key"), F.first("second").alias("second"))
    wanted = materialize(wanted, "wanted")
    blocks = max(1, math.ceil(wanted.count() / block))
    dealt = wanted.groupBy(F.size("embedding").alias("dim"), F.pmod("second", F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("key", "second", "embedding")).alias("q"))
    dealt = dealt.select("dim", "block", F.col("q.key").alias("keys"), F.col("q.second").alias("seconds"), F.col("q.embedding").alias("queries"))
    # as many copies of a shard as give every core a task while there are few shards, one beyond that
    copies = min(blocks, math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / shards))
    found = _search(index, dealt, shards, copies, k, beam)
    by_key = Window.partitionBy("key", "second").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("_nth", F.row_number().over(by_key)).where(F.col("_nth") <= k + 1).drop("_nth")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    joined = keyed.select("query_id", "key", "second").join(best, ["key", "second"]).where("vec_id <> query_id")
    return joined.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op5_nearest": op5_nearest}
