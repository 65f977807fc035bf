"""Centroid clustering by kd-tree filtering: exact Lloyd rounds over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.integer_vectors import exact_type, floored, kept, narrow, squared_distances
from larkspur.sources.tables import discard, materialise

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_TREES = "vec_ids array<long>, kind string, points binary, nodes binary, lows binary, highs binary, sums binary"
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


@dataclass
class Tree:
    """A kd-tree over ``points``, which stand in its order.

    Row by row, ``nodes`` holds a node's first row, the row behind its last, and its two children (-1 for a leaf);
    ``lows`` and ``highs`` are its box, ``sums`` the component sums of its rows.
    """

    points: np.ndarray
    nodes: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
        """The tree, and the row of ``x`` at each of its places. Nodes are cut at the median of their widest side; equal vectors stay one leaf."""
        order, nodes, lows, highs, sums = np.arange(len(x)), [[0, len(x), -1, -1]], [], [], []
        for node in nodes:  # grows while it is read
            begin, end = node[:2]
            own = x[order[begin:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            sums.append(own.sum(axis=0))
            side = int((high - low).argmax())
            if end - begin > leaf and low[side] < high[side]:
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, side], half)]
                node[2:] = len(nodes), len(nodes) + 1
                nodes += [[begin, begin + half, -1, -1], [begin + half, end, -1, -1]]
        return cls(x[order], np.array(nodes), np.array(lows), np.array(highs), np.array(sums)), order

    def filtered(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whole nodes, their centroids, rows left): every row is in a whole node or among those left.

        Level by level, a centroid goes from a node's candidates where the one nearest to the box's middle is
        strictly nearer to every place in the box. A node with one candidate, or whose rows are
        all equal, is assigned whole; the rows of leaves with more are left to be resolved one by one.
        """
        kind = exact_type(self.lows, self.highs, centres)
        z = centres.astype(kind)
        squares = (z * z).sum(axis=1)
        at, alive = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        whole, owner, left = [], [], []
        while len(at):
            low, high = self.lows[at].astype(kind), self.highs[at].astype(kind)
            middle = (low + high) / 2.0
            far = squares[None] - 2.0 * (middle @ centres.T.astype(np.float64))
            best = np.where(alive, far, np.inf).argmin(axis=1)
            for s in np.unique(best):
                rows = np.flatnonzero(best == s)
                step = z - z[s]
                # The place of the box that is best for each centroid against centroid s.
                reach = high[rows] @ np.maximum(step, 0).T + low[rows] @ np.minimum(step, 0).T
                alive[rows] &= (squares - squares[s])[None] <= 2 * reach
            single = alive.sum(axis=1) == 1
            same = (low == high).all(axis=1) & ~single
            if same.any():
                best[same] = squared_distances(self.lows[at[same]].astype(np.int64), centres).argmin(axis=1)
            best[single] = alive[single].argmax(axis=1)
            done = single | same
            whole.append(at[done])
            owner.append(best[done])
            leaves = ~done & (self.nodes[at, 2] < 0)
            left += [np.arange(b, e) for b, e in self.nodes[at[leaves], :2]]
            on = ~done & ~leaves
            at, alive = self.nodes[at[on], 2:].ravel(), np.repeat(alive[on], 2, axis=0)
        return np.concatenate(whole), np.concatenate(owner), np.concatenate([np.zeros(0, np.int64), *left])

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, component sums) of the rows nearest to each centroid, ties to the smaller number."""
        whole, owner, left = self.filtered(centres)
        count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        np.add.at(count, owner, self.nodes[whole, 1] - self.nodes[whole, 0])
        np.add.at(total, owner, self.sums[whole])
        x = self.points[left].astype(np.int64)
        own = squared_distances(x, centres).argmin(axis=1)
        np.add.at(count, own, 1)
        np.add.at(total, own, x)
        return count, total

    def nearest(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every row."""
        whole, owner, left = self.filtered(centres)
        out = np.zeros(len(self.points), np.int64)
        for (begin, end), c in zip(self.nodes[whole, :2], owner, strict=True):
            out[begin:end] = c
        out[left] = squared_distances(self.points[left].astype(np.int64), centres).argmin(axis=1)
        step = self.points.astype(np.int64) - centres[out]
        return out, (step * step).sum(axis=1)


def _written(tree: Tree) -> list:
    points = narrow(tree.points)
    parts = (points, tree.nodes.astype(np.int32), tree.lows.astype(points.dtype), tree.highs.astype(points.dtype), tree.sums.astype(np.int64))
    return [points.dtype.str, *(p.tobytes() for p in parts)]


def _read(batch: pa.RecordBatch, row: int, dim: int) -> Tree:
    def array(name: str, kind: str, width: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind).reshape(-1, width)

    kind = batch.column("kind")[row].as_py()
    return Tree(array("points", kind, dim), array("nodes", "<i4", 4).astype(np.int64), array("lows", kind, dim), array("highs", kind, dim), array("sums", "<i8", dim))


def trees_of(rows: DataFrame, scale: int, dim: int, tree_rows: int, leaf: int) -> DataFrame:
    """The written table of trees, each over up to ``tree_rows`` rows of one partition; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, tree_rows):
                part = batch.slice(begin, tree_rows)
                tree, order = Tree.build(floored(part.column("vector"), scale), leaf)
                ids = part.column("vec_id").take(pa.array(order))
                columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([v]) for v in _written(tree))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TREES.split(", ")])

    return materialise(rows.mapInArrow(run, _TREES))


def first_centres(rows: DataFrame, scale: int, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` least hexadecimal sha256 of ``seed:vec_id``; null ids last, one id's rows by vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.select(name.alias("name"), "vector").orderBy(F.asc_nulls_last("name"), "vector").limit(k).select("vector").toArrow()
    return floored(drawn.column("vector").combine_chunks(), scale) if drawn.num_rows else np.zeros((0, 0), np.int64)


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, tree_rows: int = 8_192, leaf: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Lloyd's rounds over floor(scale * x): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Every partition writes kd-trees over its rows once (counts, integer sums, boxes; see
    :class:`Tree`). A round sends the centroids to all trees and sums k rows a partition; a centroid is the
    componentwise floor(sum / count) of its rows, and stays where it has none. All sums are of integers, so
    neither partitions nor the order of rows matter. A lost task is done again from the written trees.

    Vectors take part that have exactly ``dim`` components, none null or non-finite; components whose integer
    is beyond 2**24 either way count as that. Equal vectors are one leaf of any size. Null and repeated
    ids stay row by row (null ids begin no centroid while there are others); with fewer than ``k`` rows there
    are as many centroids as rows; other columns are ignored; an empty table gives no rows. An
    inertia beyond a long is given as the greatest long.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, id_col, vector_col).where(F.size("vector") == dim)
    centres = first_centres(rows, scale, k, seed)
    if not len(centres):
        return spark.createDataFrame([], RESULT)
    trees = trees_of(rows, scale, dim, tree_rows, leaf)

    def totals(centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    n, sums = _read(batch, row, dim).totals(centres)
                    count += n
                    total += sums
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], schema=_SUMS)

        return trees.drop("vec_ids").mapInArrow(run, "cluster int, n long, sums array<long>")

    for _ in range(rounds):
        told = totals(centres).where("n > 0").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        # k x dim rows come back, whatever the table's size.
        told = told.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        moved = centres.copy()
        for r in told:
            moved[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
        if (moved == centres).all():
            break  # further rounds change nothing
        centres = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, distance = _read(batch, row, dim).nearest(centres)
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, pa.array(own.astype(np.int32)), pa.array(distance)], schema=_ASSIGNED)

    assigned = materialise(trees.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    discard(trees)
    total = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    most, whole = (1 << 63) - 1, sum(total.values())
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    told = [(c, min(most, t), min(most, whole), names[c]) for c, t in total.items()]
    of_clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3) -> str:
    """The same in DuckDB SQL, for distinct ids, as in the test tables; a pair of CTEs a round."""
    ctes = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"points AS MATERIALIZED (SELECT vec_id, unnest(range(1, {dim + 1})) AS j, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dim + 1})) AS j, unnest(v) AS z FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (SELECT vec_id, c, CAST(sum((x - z) * (x - z)) AS BIGINT) AS d FROM points JOIN c{r} USING (j) GROUP BY ALL) GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c, j, coalesce(m, z) AS z FROM c{r} LEFT JOIN (SELECT c, j, CAST(sum(x) - (((sum(x) % count(*)) + count(*)) % count(*)) AS BIGINT) // count(*) AS m FROM a{r} JOIN points USING (vec_id) GROUP BY ALL) USING (c, j))")
    return f"""WITH {', '.join(ctes)},
names AS (SELECT c, sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY j)) AS name FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256 FROM a{rounds} JOIN names USING (c)"""
