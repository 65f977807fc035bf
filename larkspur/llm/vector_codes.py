"""Vector code compression: product codes whose codebooks come from Lloyd's rounds with heaps of bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.integer_vectors import floored, kept, narrow, squared_distances
from larkspur.sources.tables import discard, materialise

_MOVED = "array<struct<part:int,entry:int,n:bigint,sums:array<bigint>>>"


@dataclass
class Books:
    """The codebooks (part, entry, component), and how far they may have moved a part's bounds since the first round."""

    entries: np.ndarray
    drift: np.ndarray

    def step(self, count: np.ndarray, total: np.ndarray) -> Books:
        """Entries as floors of the means of their parts, unused ones as they are.

        An entry's own move raises the upper bound of its parts, the greatest move of any other entry of the
        codebook lowers their lower bound; ``drift`` is the sum of both over all rounds.
        """
        used = count > 0
        entries = self.entries.copy()
        entries[used] = total[used] // count[used][:, None]
        moved = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        ranked = np.sort(moved, axis=1)
        second = ranked[:, -2] if moved.shape[1] > 1 else np.zeros(len(moved))
        others = np.where(np.arange(moved.shape[1]) == moved.argmax(axis=1)[:, None], second[:, None], ranked[:, -1:])
        return Books(entries, self.drift + moved + others)


class Block:
    """Some vectors of a partition: their parts, codes, and for each part a heap an entry of the parts it holds.

    A heap's key is the lower bound of the distance to any other entry minus the upper bound of that to its own,
    at the entry's drift when the part was last scanned; the assignment can have changed only once the drift has reached the key. A
    heap is kept as an ascending array, the root first: ``rows[p]`` holds the heaps of part ``p`` one after another by
    entry, ``keys[p]`` their keys. Popping what is violated takes each heap's beginning and looks at nothing else.
    """

    def __init__(self, points: np.ndarray, codes: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        self.points, self.codes, self.rows, self.keys = points, codes, rows, keys

    @classmethod
    def fresh(cls, points: np.ndarray) -> Block:
        """All of an (n, parts, components) array, nothing assigned yet: every part is due."""
        n, parts = points.shape[:2]
        return cls(points, np.zeros((parts, n), np.uint8), np.tile(np.arange(n, dtype=np.int32), (parts, 1)), np.full((parts, n), -np.inf, np.float32))

    def due(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Pop the rows of ``part`` whose keys the drift of their entry has reached: their places in the heaps."""
        ends = np.cumsum(np.bincount(self.codes[part], minlength=len(drift)))
        # Keys were rounded down, these are rounded up: an equal distance is due too.
        limits = np.nextafter((drift * (1 + 1e-9) + 1e-6).astype(np.float32), np.float32(np.inf))
        popped, begin = [], 0
        for end, limit in zip(ends.tolist(), limits, strict=True):
            if begin < end:
                popped.append(np.arange(begin, begin + np.searchsorted(self.keys[part, begin:end], limit, side="right")))
            begin = end
        return np.concatenate(popped)

    def assign(self, books: Books, first: bool = False) -> list[tuple]:
        """Scan what is due exactly and push it to the heaps of its entries: (part, entry, count, sums) of what came and went."""
        parts, entries = books.entries.shape[:2]
        moved = []
        for p in range(parts):
            at = self.due(p, books.drift[p])
            rows = self.rows[p, at]
            if not len(rows):
                continue
            x = self.points[rows, p].astype(np.int64)
            far = squared_distances(x, books.entries[p])
            own = far.argmin(axis=1)  # ties to the lower index
            upper = np.sqrt(far[np.arange(len(rows)), own].astype(np.float64))
            far[np.arange(len(rows)), own] = np.iinfo(np.int64).max
            lower = np.sqrt(far.min(axis=1).astype(np.float64))
            key = np.nextafter((lower - upper + books.drift[p, own]).astype(np.float32), np.float32(-np.inf))
            was, changed = self.codes[p, rows], np.ones(len(rows), bool)
            if not first:
                changed = was != own
            count, total = np.zeros(entries, np.int64), np.zeros((entries, x.shape[1]), np.int64)
            np.add.at(count, own[changed], 1)
            np.add.at(total, own[changed], x[changed])
            if not first:
                np.subtract.at(count, was[changed], 1)
                np.subtract.at(total, was[changed], x[changed])
            for e in np.flatnonzero((count != 0) | (total != 0).any(axis=1)).tolist():
                moved.append((p, e, int(count[e]), total[e].tolist()))
            self.codes[p, rows] = own
            self.keys[p, at] = key
            order = np.lexsort((self.keys[p], self.codes[p, self.rows[p]]))
            self.rows[p], self.keys[p] = self.rows[p, order], self.keys[p, order]
        return moved

    def errors(self, books: Books) -> np.ndarray:
        """Each vector's squared distances to its entries, summed over its parts."""
        own = books.entries[np.arange(len(self.codes))[:, None], self.codes].transpose(1, 0, 2)
        step = self.points.astype(np.int64) - own
        return (step * step).sum(axis=(1, 2))

    def record(self, moved: list[tuple]) -> dict[str, list]:
        points = narrow(self.points)
        return {
            "kind": [points.dtype.str], "points": [points.tobytes()], "codes": [self.codes.tobytes()],
            "rows": [self.rows.astype("<i4").tobytes()], "keys": [self.keys.astype("<f4").tobytes()],
            "moved": [[{"part": p, "entry": e, "n": n, "sums": s} for p, e, n, s in moved]],
        }

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int, parts: int, width: int) -> Block:
        def array(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind).reshape(*shape).copy()

        return cls(array("points", batch.column("kind")[row].as_py(), -1, parts, width), array("codes", "u1", parts, -1), array("rows", "<i4", parts, -1), array("keys", "<f4", parts, -1))


_COLUMNS = pa.schema([("kind", pa.string()), ("points", pa.binary()), ("codes", pa.binary()), ("rows", pa.binary()), ("keys", pa.binary()), ("moved", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))])


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block_rows: int = 4_096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Product codes of floor(scale * x): vec_id, code, error, label_error, codebooks_sha256.

    A vector is cut into ``parts`` equal parts, each of which has a codebook of at most ``entries`` (256 at most)
    entries, first those parts of the least ids. Each partition keeps its vectors in written blocks with their heaps (see
    :class:`Block`): a round sends the codebooks to all blocks, rescans only the parts whose bounds the
    codebooks' moves have reached, and sums what changed its entry, at most parts x entries rows a partition. The sums are
    of integers, so neither partitions nor the order of rows matter; a lost task is done again from the written blocks.

    Vectors take no part that are null or hold null or non-finite components, that have another length than
    most have (of equally many the shorter), or whose length ``parts`` does not divide. Components whose
    integer is beyond 2**24 either way count as that. Null ids come last; null and repeated ids stay row by row, and of one
    id's rows the lesser vector is first; errors of null labels are summed together; other columns are ignored; an
    empty table gives no rows. A sum of errors beyond a long is given as the greatest long.
    """
    spark, result = vectors.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows = kept(vectors, id_col, vector_col, F.col(label_col).alias("label"))
    sizes = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    width = dim // parts
    rows = rows.where(F.size("vector") == dim)
    drawn = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    start = floored(drawn.column("vector").combine_chunks(), scale).reshape(-1, parts, width).transpose(1, 0, 2)
    books = Books(start, np.zeros(start.shape[:2]))
    told_schema = f"vec_ids array<long>, labels array<{rows.schema['label'].dataType.simpleString()}>, kind string, points binary, codes binary, rows binary, keys binary, moved {_MOVED}"

    def written(ids: pa.Array, labels: pa.Array, block: Block, moved: list[tuple]) -> pa.RecordBatch:
        def whole(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        record = block.record(moved)
        return pa.RecordBatch.from_arrays([whole(ids), whole(labels), *(pa.array(record[f.name], f.type) for f in _COLUMNS)], names=["vec_ids", "labels", *_COLUMNS.names])

    def begin(books: Books) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block_rows):
                    part = batch.slice(at, block_rows)
                    block = Block.fresh(floored(part.column("vector"), scale).reshape(-1, parts, width))
                    yield written(part.column("vec_id"), part.column("label"), block, block.assign(books, first=True))

        return materialise(rows.select("vec_id", "vector", "label").mapInArrow(run, told_schema))

    def onward(blocks: DataFrame, books: Books) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block.read(batch, row, parts, width)
                    moved = block.assign(books)
                    yield written(batch.column("vec_ids")[row].values, batch.column("labels")[row].values, block, moved)

        return materialise(blocks.mapInArrow(run, told_schema))

    def settled(blocks: DataFrame, books: Books) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block.read(batch, row, parts, width)
                    block.assign(books)
                    digits = np.ascontiguousarray(block.codes.T).tobytes().hex()
                    codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values, pa.array(codes, pa.string()), pa.array(block.errors(books))], names=["vec_id", "label", "code", "error"])

        kind = rows.schema["label"].dataType.simpleString()
        return materialise(blocks.drop("moved").mapInArrow(run, f"vec_id long, label {kind}, code string, error long"))

    count, total = np.zeros(start.shape[:2], np.int64), np.zeros(start.shape, np.int64)
    blocks = begin(books)
    for r in range(rounds):
        told = blocks.select(F.explode("moved").alias("m")).select("m.part", "m.entry", "m.n", F.posexplode("m.sums").alias("at", "s"))
        for m in told.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # entries x components
            total[m["part"], m["entry"], m["at"]] += m["s"]
            if m["at"] == 0:
                count[m["part"], m["entry"]] += m["n"]
        books = books.step(count, total)
        if r + 1 < rounds:
            before, blocks = blocks, onward(blocks, books)
            discard(before)
    coded = settled(blocks, books)
    discard(blocks)
    name = sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = materialise(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dim: int = 64) -> str:
    """The same in DuckDB SQL, for distinct ids and vectors of ``dim`` components, as in the test tables."""
    width = dim // parts
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM (SELECT vec_id, v, unnest(range({parts})) AS p FROM kept))",
        f"b0 AS MATERIALIZED (SELECT p, e, x AS z FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id))",
    ]
    gap = " + ".join(f"(x[{j}] - z[{j}]) * (x[{j}] - z[{j}])" for j in range(1, width + 1))
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (SELECT vec_id, p, e, {gap} AS d FROM cut JOIN b{r} USING (p)) GROUP BY ALL)")
        if r < rounds:
            mean = ", ".join(f"CAST(sum(x[{j}]) - (((sum(x[{j}]) % count(*)) + count(*)) % count(*)) AS BIGINT) // count(*)" for j in range(1, width + 1))
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, z) AS z FROM b{r} LEFT JOIN (SELECT p, e, [{mean}] AS m FROM a{r} JOIN cut USING (vec_id, p) GROUP BY ALL) USING (p, e))")
    return f"""WITH {', '.join(ctes)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
name AS (SELECT sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range({width})) AS j, unnest(z) AS s FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), name"""
