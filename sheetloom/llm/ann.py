"""Approximate nearest neighbours over balanced posting lists.

Index: a bounded sample (SAMPLE_ROWS vectors, taken in hash order) is halved again and again, each time at the point that
gives both halves their share, into one leaf a list; the leaves' means are the centroids. Weights fitted on the sample
then make lists that are too long dearer until all hold about the same, and stand in the centroids as one coordinate
more, so nothing else knows of them. Every vector is indexed: posted to its nearest list and, as a boundary vector, to
further lists within REPLICA_RATIO of that distance, at most REPLICAS, unless a list already taken lies within SPREAD of
that distance from it and so holds the same neighbourhood. Lists are cut into blocks of at most BLOCK_ROWS, so no task holds a whole hot list.
Search: lists near a query come from a best-first walk over an in-memory neighbour graph of centroids, and those farther
than a ratio of the nearest's distance are pruned. The ratio is fitted on the sample: the least that keeps the share
FIT_RECALL of the true neighbours of FIT_QUERIES sampled vectors among the sample, whose density is at most that of
the table. Each (list, block) is scored against its queries in double precision, and per-block tops merge by rank.

Equal vectors are indexed once and carry their K + 1 smallest ids, which no top-K can exceed; equal queries are searched
once. A table of up to LIST_ROWS distinct vectors is one list.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length differs from that of most vectors (ties: the longer). Rows that repeat a vec_id and its vector count once; all
rows of the query's own id are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

K = 10
SAMPLE_ROWS = 40_000
LIST_ROWS, MAX_LISTS = 256, 2048
REPLICAS, REPLICA_RATIO, SPREAD = 3, 1.03, 0.25
FIT_RECALL, FIT_QUERIES = 0.93, 256
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
NEIGHBOURS, BEAM = 24, 48


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _leaves(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Means of `lists` groups of x of equal size: two-means, cut where both sides get their share of the groups."""
    out, todo = [], [(np.arange(len(x)), lists)]
    while todo:
        at, parts = todo.pop()
        if parts == 1:
            out.append(x[at].mean(0))
            continue
        mine, left = x[at], parts // 2
        cut_at = max(1, min(len(at) - 1, len(at) * left // parts))
        a, b = mine[rng.choice(len(mine), 2, replace=False)]
        for _ in range(8):
            order = np.argsort(mine @ (b - a), kind="stable")
            a, b = mine[order[:cut_at]].mean(0), mine[order[cut_at:]].mean(0)
        todo += [(at[order[:cut_at]], left), (at[order[cut_at:]], parts - left)]
    return np.array(out)


class CentroidGraph:
    """Weighted centroids, a graph of each one's nearest others, a spread of entry points, and the pruning ratio."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        c = _leaves(sample, lists, rng)
        weight = np.zeros(lists)
        if lists > 1:
            d = _square(sample, c)
            scale = np.partition(d, 1, axis=1)
            scale = (scale[:, 1] - scale[:, 0]).mean()
            for k in range(60):
                sizes = np.bincount((d + weight).argmin(1), minlength=lists)
                weight += scale * (1 - k / 60) * np.clip(sizes * lists / len(sample) - 1, -1, 1)
        self.centroids = np.column_stack([c, np.sqrt(weight - weight.min())])
        d = _square(self.centroids, self.centroids)
        self.between = np.sqrt(d)
        np.fill_diagonal(d, np.inf)
        self.links = d.argsort(1)[:, : min(NEIGHBOURS, lists - 1)] if lists > 1 else np.zeros((1, 0), np.int64)
        self.entries = rng.choice(lists, min(lists, 32), replace=False)
        self.ratio, self.reach = self._fitted(sample, rng)

    def _fitted(self, sample: np.ndarray, rng: np.random.Generator) -> tuple[float, int]:
        """The pruning ratio, and how many lists it lets through at most (with a margin)."""
        if len(self.centroids) == 1:
            return 1.0, 1
        asked = rng.choice(len(sample), min(FIT_QUERIES, len(sample)), replace=False)
        d = _square(sample[asked], sample)
        d[np.arange(len(asked)), asked] = np.inf
        near = np.argsort(d, axis=1)[:, : min(K, len(sample) - 1)]
        to = np.sqrt(_square(_lifted(sample[asked]), self.centroids))
        row, ids = self.posted(sample[near.ravel()])
        ratio = np.full(near.size, np.inf)
        np.minimum.at(ratio, row, to[row // near.shape[1], ids] / np.maximum(to.min(1), 1e-12)[row // near.shape[1]])
        ratio = float(np.quantile(ratio, FIT_RECALL)) + 1e-9
        most = int((to <= to.min(1, keepdims=True) * ratio).sum(1).max())
        return ratio, min(len(self.centroids), most + most // 4 + 8)

    def posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the postings of the vectors x."""
        ids, d = self.nearest(_lifted(x))
        ids, d = ids[:, : 4 * REPLICAS], d[:, : 4 * REPLICAS]
        take = np.zeros(ids.shape, bool)
        take[:, 0] = True
        for j in range(1, ids.shape[1]):
            near = (ids[:, j] >= 0) & (d[:, j] <= d[:, 0] * REPLICA_RATIO + 1e-12) & (take.sum(1) < REPLICAS)
            for i in range(j):
                near &= ~take[:, i] | (self.between[ids[:, i], ids[:, j]] >= SPREAD * d[:, j])
            take[:, j] = near
        row, col = np.nonzero(take)
        return row, ids[row, col]

    def nearest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all rows of x side by side: list numbers and distances, nearest first (-1, inf: none)."""
        n, lists = len(x), len(self.centroids)
        beam = min(beam, lists)
        ids = np.tile(self.entries, (n, 1))
        dist = _square(x, self.centroids[self.entries])
        seen = np.zeros((n, lists), bool)
        seen[:, self.entries] = True
        opened = np.zeros((n, lists), bool)
        rows = np.arange(n)
        live = rows
        while len(live) and self.links.shape[1]:
            open_at = np.where(opened[live[:, None], ids[live]] | ~np.isfinite(dist[live]), np.inf, dist[live])
            pick = open_at.argmin(1)
            ok = np.isfinite(open_at[np.arange(len(live)), pick])
            live, pick = live[ok], pick[ok]
            if not len(live):
                break
            node = ids[live, pick]
            opened[live, node] = True
            near = self.links[node]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = np.where(fresh, ((x[live, None, :] - self.centroids[near]) ** 2).sum(2), np.inf)
            if ids.shape[1] < beam:
                pad = beam - ids.shape[1]
                ids, dist = np.pad(ids, ((0, 0), (0, pad))), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
            all_ids, all_d = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1)
            keep = np.argpartition(all_d, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[live], dist[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_d, keep, 1)
        order = dist.argsort(1, kind="stable")
        dist = np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), np.sqrt(dist)


def _lifted(x: np.ndarray) -> np.ndarray:
    """Vectors in the space of the weighted centroids."""
    return np.column_stack([x, np.zeros(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) <= 1.7976931348623157E308D) and exists(v, x -> x <> 0)")
    modal = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return v.where(F.size("v") == (modal[0].n if modal else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of `vectors` for each row of `queries` (both vec_id, v)."""
    spark = vectors.sparkSession
    first = Window.partitionBy("v").orderBy("vec_id")
    # dense_rank counts a repeated id once; the limit on it is applied before the shuffle as well as after.
    kept = vectors.withColumn("nth", F.dense_rank().over(first)).where(F.col("nth") <= k + 1)
    points = cut(kept.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asked = cut(queries.select("vec_id", "v").distinct().join(points.select("v", "rep"), "v", "left"))
    wanted = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    n = points.count()
    lists = min(MAX_LISTS, -(-n // LIST_ROWS))
    sample = points.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS if lists > 1 else 1).toArrow().column("v").combine_chunks()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = spark.sparkContext.broadcast(CentroidGraph(_matrix(sample), min(lists, len(sample))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, ids = graph.value.posted(_matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("rep", "v"))], ["list", "rep", "v"])

    posted = cut(points.select("rep", "v").mapInArrow(post, "list int, rep long, v array<double>"))
    sizes = {r.list: r.n for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    size_of = np.zeros(len(graph.value.centroids), np.int64)
    for j, m in sizes.items():
        size_of[j] = m

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, d = graph.value.nearest(_lifted(_matrix(part.column("v"))), max(BEAM, graph.value.reach))
                reach = np.cumsum(np.where(ids >= 0, size_of[ids], 0), axis=1)
                before = np.pad(reach, ((0, 0), (1, 0)))[:, :-1]
                row, col = np.nonzero((ids >= 0) & ((d <= d[:, :1] * graph.value.ratio) | (before < REPLICAS * (k + 2))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("q", "v"))], ["list", "q", "v"])

    probes = cut(wanted.mapInArrow(probe, "list int, q long, v array<double>"))
    asks = {r.list: r.n for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    # Blocks of lists by blocks of queries: one row a list, at most MAX_LISTS rows.
    plan = lambda: spark.createDataFrame([(j, -(-sizes[j] // BLOCK_ROWS), -(-asks[j] // BLOCK_QUERIES)) for j in sorted(set(sizes) & set(asks))], "list int, nb int, nq int")
    left = posted.join(plan(), "list").withColumn("b", F.pmod(F.xxhash64("rep"), "nb")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nq") - 1).cast("array<long>")))
    right = probes.join(plan(), "list").withColumn("c", F.pmod(F.xxhash64("q"), "nq")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1).cast("array<long>")))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_r, out_d = [], [], []
        if a.num_rows and b.num_rows:
            reps, x = a.column("rep").to_numpy(), _matrix(a.column("v").combine_chunks())
            qs, y = b.column("q").to_numpy(), _matrix(b.column("v").combine_chunks())
            order = np.argsort(reps, kind="stable")
            reps, x = reps[order], x[order]
            for at in range(0, len(qs), 256):
                rough = _square(y[at : at + 256], x)
                m = min(len(reps), 4 * (k + 2))
                pick = np.argpartition(rough, m - 1, axis=1)[:, :m] if m < len(reps) else np.tile(np.arange(len(reps)), (len(rough), 1))
                for i, cols in enumerate(pick):
                    # Everything no farther than the (k + 2)-th is looked at again, exactly, so that ties are whole.
                    near = np.sort(rough[i, cols])[min(len(cols), k + 2) - 1]
                    cols = np.flatnonzero(rough[i] <= near + 1e-9 * (1 + near))
                    exact = np.sqrt(((x[cols] - y[at + i]) ** 2).sum(1))
                    top = np.lexsort((reps[cols], exact))[: k + 2]
                    out_q.append(np.full(len(top), qs[at + i]))
                    out_r.append(reps[cols][top])
                    out_d.append(exact[top])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.table({"q": cat(out_q, np.int64), "rep": cat(out_r, np.int64), "score": cat(out_d, np.float64)})

    near = left.groupBy("list", "b", "c").cogroup(right.groupBy("list", "b", "c")).applyInArrow(score, "q long, rep long, score double").distinct()
    by_q = Window.partitionBy("q").orderBy("score", "rep")
    tops = near.withColumn("nth", F.row_number().over(by_q)).where(F.col("nth") <= k + 2).join(points.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    tops = tops.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("nth") <= k + 1)
    each = asked.join(wanted, "v").select(F.col("vec_id").alias("query_id"), "q").join(tops, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def brute(vectors: pd.DataFrame, queries: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The exact answer in one process, for measuring recall on small tables."""
    x, ids, out = np.stack(vectors["v"]), vectors["vec_id"].to_numpy(), []
    for q, v in zip(queries["vec_id"], queries["v"], strict=True):
        d = np.sqrt(((x - np.asarray(v)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out += [(q, r + 1, ids[i], d[i]) for r, i in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def op3(embeddings: DataFrame) -> DataFrame:
    v = usable(embeddings)
    return search(v, v.where("vec_id % 100 = 0"))
