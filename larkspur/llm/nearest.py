"""Approximate nearest neighbours: inverted file with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.tables import materialise

RESULT = "query_id long, vec_id long, score double"
#: Training rows a list, and rows or queries that a matrix of distances is made of at once.
PER_LIST, PART = 40, 2_048


@dataclass
class Index:
    """Coarse centroids, and per part of a vector the centroids of what is left."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    candidates: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """All lists of each row of ``x``, nearest first."""
        return np.argsort((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, axis=1, kind="stable")

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts = (x - self.centroids[lists]).reshape(len(x), len(self.books), -1)
        d = (self.books**2).sum(axis=2)[None] - 2 * np.einsum("npd,pkd->npk", parts, self.books)
        return d.argmin(axis=2).astype(np.uint8)

    def rough(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(query, row): squared distance of each query to the coded rows of list ``at``, by tables of its residual's distance to each code."""
        parts = (queries - self.centroids[at]).reshape(len(queries), len(self.books), -1)
        table = (parts**2).sum(axis=2)[:, :, None] + (self.books**2).sum(axis=2)[None] - 2 * np.einsum("npd,pkd->npk", parts, self.books)
        out = np.zeros((len(queries), len(codes)))
        for p in range(codes.shape[1]):
            out += table[:, p, codes[:, p]]
        return out


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (centres**2).sum(axis=1)
    return np.concatenate([(squares - 2 * x[k : k + PART] @ centres.T).argmin(axis=1) for k in range(0, len(x), PART)])


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        if len(empty := np.flatnonzero(count == 0)):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0.0), F.lit(False))


def wanted_lists(total: int, most_lists: int) -> int:
    return int(max(1, min(most_lists, 4 * total**0.5, total / PER_LIST)))


def fit(sample: np.ndarray, lists: int, *, k: int = 10, parts: int = 16, recall: float = 0.95, tried: int = 200, seed: int = 5) -> Index:
    """Train on a sample, then choose how many lists to probe and how many candidates to rerank.

    Both numbers are the least with which ``tried`` rows of the sample find the share ``recall`` of
    their exact neighbours within it, probing, and all but a fiftieth of the rest, reranking. In a
    larger table neighbours are nearer than in its sample, so both are enough there. Where vectors
    have no cluster structure many lists are probed.
    """
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))]
    n, dim = sample.shape
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    lists = max(1, min(lists, n))
    centroids = kmeans(sample, lists, 8, seed)
    own = nearest_centre(sample, centroids)
    left = (sample - centroids[own]).reshape(n, parts, -1)[:12_000]
    books = np.stack([kmeans(left[:, p], min(256, len(left)), 5, seed + p) for p in range(parts)])
    index = Index(centroids, books, lists, k)
    code = index.encode(sample[:PART], own[:PART]) if n <= PART else np.concatenate([index.encode(sample[b : b + PART], own[b : b + PART]) for b in range(0, n, PART)])
    members = [np.flatnonzero(own == at) for at in range(lists)]
    needed, places = [], []
    for begin in range(0, min(n, tried), 50):
        which = np.arange(begin, min(n, tried, begin + 50))
        queries = sample[which]
        d = (sample**2).sum(axis=1)[None] - 2 * queries @ sample.T
        d[np.arange(len(which)), which] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, n - 1)]
        needed.append(np.take_along_axis(np.argsort(index.order(queries), axis=1), own[near], axis=1))
        rough = np.empty_like(d)
        for at, rows in enumerate(members):
            if len(rows):
                rough[:, rows] = index.rough(queries, at, code[rows])
        rough[np.arange(len(which)), which] = np.inf
        places.append(np.take_along_axis(np.argsort(np.argsort(rough, axis=1), axis=1), near, axis=1))

    def reached(values: list[np.ndarray], share: float) -> int:
        found = np.sort(np.concatenate([v.ravel() for v in values]))
        return int(found[min(len(found) - 1, int(np.ceil(share * len(found))))]) + 1 if len(found) else 1

    index.probes = min(lists, reached(needed, recall))
    index.candidates = 2 * max(k, reached(places, 0.98 + 0.02 * recall))
    return index


def build(vectors: DataFrame, *, most_lists: int = 4_096, k: int = 10, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Index | None]:
    """Index every usable row: the written table (vec_id, vector, list, code), and the trained index.

    There are four times the square root of the rows in lists, at most ``most_lists``, and training
    takes 40 rows a list, drawn by hash of id and vector; every row is indexed. Rows take no part
    whose id is null, whose vector is null, zero or holds null or non-finite components, or whose
    vector has another length than most have (of equally many the shorter). An empty table
    gives no index.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return rows.select("*", F.lit(0).alias("list"), F.lit(b"").alias("code")), None
    dim, total = sizes
    rows = rows.where(F.size("vector") == dim)
    lists = wanted_lists(total, most_lists)
    # By id and vector together, so one vector on many rows stays a share of the sample.
    share = min(1.0, max(PER_LIST * lists, 2_000) / total)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec_id", "vector").distinct().select("vector").toArrow()
    if not drawn.num_rows:
        drawn = rows.select("vector").limit(1).toArrow()
    sample = np.asarray(drawn.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(drawn.num_rows, -1)
    index = fit(np.unique(sample, axis=0), lists, k=k, recall=recall)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, PART):
                part = batch.slice(begin, PART)
                x = np.asarray(part.column("vector").flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                at = nearest_centre(x, index.centroids)
                codes = index.encode(x, at)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("vector"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "list", "code"])

    return materialise(rows.mapInArrow(run, "vec_id long, vector array<double>, list int, code binary")), index


def shards_of(sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """(first shard, number of shards) of each list: short lists share a shard of about ``rows`` rows, longer ones are cut into several."""
    out, shard, filled = {}, 0, 0
    for at, n in sorted(sizes.items()):
        if n > rows:
            shard += filled > 0
            out[at] = (shard, -(-n // rows))
            shard, filled = shard + out[at][1], 0
            continue
        if filled + n > rows:
            shard, filled = shard + 1, 0
        out[at], filled = (shard, 1), filled + n
    return out


def search(indexed: DataFrame, index: Index | None, queries: Column, *, k: int = 10, shard_rows: int = 4_000, shard_queries: int = 4_000) -> DataFrame:
    """The k nearest found for each row that ``queries`` selects: query_id, rank, vec_id, score.

    A query probes the index's number of lists, and further ones until they hold k rows besides itself.
    Lists are dealt to shards of about ``shard_rows`` rows, a longer one to several by hash of the
    id, and a query goes to each shard that holds some of its lists; so a list with a third
    of all rows is many tasks' work. A task takes one shard and about ``shard_queries`` of its
    queries, ranks the rows of their lists by distance tables over codes, keeps the candidates (ties
    to the smaller id) and computes their exact distances; the best k over all shards remain. Rows
    of one id are one item of several vectors, the nearest of which counts; it is not its own candidate.
    """
    spark = indexed.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most most_lists rows
    shards = shards_of(sizes, shard_rows)
    shared, told = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast((sizes, shards))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (sizes, shards) = shared.value, told.value
        held = np.array([sizes.get(at, 0) for at in range(len(index.centroids))])
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                x = np.asarray(part.column("vector").flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                order = index.order(x)
                enough = np.maximum(index.probes, (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1)
                rows, shard, lists = [], [], []
                for r in range(part.num_rows):
                    goes: dict[int, list[int]] = {}
                    for at in order[r, : enough[r]].tolist():
                        first, count = shards.get(at, (0, 0))
                        for s in range(first, first + count):
                            goes.setdefault(s, []).append(at)
                    rows += [r] * len(goes)
                    shard += goes
                    lists += goes.values()
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("vector"), pa.array(shard, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "vector", "shard", "lists"])

    asked = materialise(indexed.where(queries).select("vec_id", "vector").mapInArrow(probe, "query_id long, vector array<double>, shard int, lists array<int>"))
    # A row a list, at most most_lists of them; the rows a shard are not bounded so and are joined as the planner likes.
    homes = spark.createDataFrame([(at, first, count) for at, (first, count) in shards.items()], "list int, first int, count int")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_queries).cast("int").alias("blocks"))
    # xxhash64 of the id alone: rows of one vector are dealt over the shards too.
    stored = indexed.join(F.broadcast(homes), "list").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("count"))).cast("int"))
    stored = stored.join(blocks, "shard").select("vec_id", "vector", "list", "code", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    asked = asked.join(blocks, "shard").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")

    def scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index, out = shared.value, []
        if len(left) and len(right):
            right = right.sort_values(["list", "vec_id"], kind="stable")
            ids, x, at = right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy()), right["list"].to_numpy()
            code = np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(ids), -1)
            begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            ends = np.append(begins[1:], len(at))
            by_id = np.argsort(ids, kind="stable")
            for begin in range(0, len(left), 64):
                part = left.iloc[begin : begin + 64]
                own, q, probed = part["query_id"].to_numpy(), np.stack(part["vector"].to_numpy()), [set(v) for v in part["lists"]]
                rough = np.full((len(own), len(ids)), np.inf)
                for b, e in zip(begins, ends, strict=True):
                    asking = np.array([r for r in range(len(own)) if at[b] in probed[r]], dtype=np.int64)
                    if len(asking):
                        rough[asking, b:e] = index.rough(q[asking], at[b], code[b:e])
                rough[own[:, None] == ids[None]] = np.inf
                keep = by_id[np.argsort(rough[:, by_id], axis=1, kind="stable")[:, : max(index.candidates, 2 * k)]]
                for r in range(len(own)):
                    found = keep[r][np.isfinite(rough[r, keep[r]])]
                    exact = np.sqrt(((x[found] - q[r]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[found], exact))
                    best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])[:k]]
                    out.append((np.full(len(best), own[r]), ids[found][best], exact[best]))
        cat = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    found = asked.groupBy("shard", "part").cogroup(stored.groupBy("shard", "part")).applyInPandas(scan, RESULT)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
