"""Prefix doubling over every position of every text: rank pairs are dealt out by Spark, sorted and ranked anew, and what is unique drops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import slices
from larkspur.sources.tables import discard, materialise

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
BLOCK = "a binary, b binary, copies binary, ends binary"


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _K1
    x += right
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def prefix_hashes(data: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of the prefixes of the given lengths at each position, by doubling; the last few positions are not whole."""
    out, size, now = {}, 1, _BYTES[data]
    while True:
        for n in lengths:
            if size <= n < 2 * size:
                out[n] = now if n == size else np.append(joined(now[: len(now) - n + size], now[n - size :]), now[len(now) - n + size :])
        if 2 * size > max(lengths):
            return out
        now = np.append(joined(now[:-size], now[size:]), now[-size:]) if len(now) > size else now
        size *= 2


def blocks(texts: DataFrame, chars: int) -> DataFrame:
    """(block, a, b, copies, ends, text): texts behind each other, about ``chars`` bytes a row; of each its columns and where it ends, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=chars):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            own = [np.asarray(batch.column(c)).astype(np.int64).tobytes() for c in ("a", "b", "copies")]
            ends = np.cumsum([len(t) for t in raw], dtype=np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*own, ends, b"".join(raw))], names=["a", "b", "copies", "ends", "text"])

    return texts.select("a", "b", "copies", "text").mapInArrow(run, f"{BLOCK}, text binary").withColumn("block", F.monotonically_increasing_id())


def _first(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, name, name): every position of a block with ``size`` bytes before it in its text, and those bytes' 64-bit name."""
    text, ends, step = np.frombuffer(row["text"] + bytes(2 * size), np.uint8), np.frombuffer(row["ends"], np.int64), 1 << 16
    parts = [prefix_hashes(text[k : k + step + 2 * size], {size})[size][:step] for k in range(0, len(row["text"]), step)]
    names = np.concatenate([np.zeros(0, np.uint64), *parts])[: len(row["text"])]
    at = np.flatnonzero(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(names)) >= size)
    return at, names[at], np.zeros(0, np.uint64)


def _pairs(row: dict, size: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, rank, rank ``offset`` behind) of the positions of a block that have both and so many bytes before them."""
    at, rank, ends = np.cumsum(np.frombuffer(row["at"], np.uint32), dtype=np.int64), np.frombuffer(row["rank"], np.uint64), np.frombuffer(row["ends"], np.int64)
    number = np.full(int(ends[-1]) + offset, -1, np.int32)
    number[at] = np.arange(len(at))
    behind = number[at + offset]
    here = np.flatnonzero((behind >= 0) & (np.repeat(ends, np.diff(ends, prepend=0))[at] - at >= size + offset))
    return at[here], rank[here], rank[behind[here]]


def _sorted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each distinct pair begins in it, and the length)."""
    order = np.lexsort((second, first)) if len(second) else np.argsort(first)
    a, b = first[order], second[order] if len(second) else None
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) if b is not None else a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
    return order, np.append(np.flatnonzero(new), len(a))


def repeated_ranges(texts: DataFrame, length: int = 200, *, waves: int = 8, names_a_wave: int = 1 << 24, names_a_bucket: int = 1 << 21, chars: int = 2_000_000) -> DataFrame:
    """(a, b, whole, spans): of each text that is there more than once (``whole``) or that holds a repeated string of ``length`` bytes.

    ``texts`` has (a, b, copies, text), one row for each distinct text. ``spans``: ranges (begin, end) of bytes that strings
    which begin in several places of these rows cover, in order and apart.

    A rank names the string of a size at a position. The first ranks are 64-bit names of an eighth of ``length``, of every
    position. In each round the pair of ranks at a position and ``offset`` behind it names the string of size + offset:
    pairs are dealt by Spark into ranges of the first rank, sorted there and numbered as the next ranks, pairs that are
    there once drop, and the offset doubles until ``length`` is reached. A position whose string is
    unique has no repeated longer one, so nothing that drops is needed again.

    The first ranks are not written, as they would be eight bytes a position: they are met in ``waves`` (fewer of a small
    table), each a range of ranks and told anew from the texts, and a bit for each distinct one comes back. What lies on disk at once is so about
    8 / ``waves`` bytes for each byte of text, beside the texts and the ranks of repeated positions. Equal pairs of one
    block are met as one, so a run of one character is no range's alone. None of the four numbers changes the result.
    """
    size = max(1, length // 8)
    told = materialise(blocks(texts, chars))
    total = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    waves = max(1, min(waves, -(-total // names_a_wave)))
    bits = max(64, waves, -(-total // names_a_bucket)).bit_length()
    shift = np.uint64(64 - bits)

    def dealt(pairs: Callable[[dict], tuple], low: int, high: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                _, first, second = pairs(row)
                bucket = first >> shift
                mine = (bucket >= np.uint64(low)) & (bucket < np.uint64(high))
                first, second = first[mine], second[mine] if len(second) else second
                order, begin = _sorted(first, second)
                one = order[begin[:-1]]
                first, second, many = first[one], second[one] if len(second) else second, np.diff(begin) > 1
                edges = np.searchsorted(first >> shift, np.arange(low, high + 1, dtype=np.uint64))
                out = [(low + k, row["block"], first[i:j].tobytes(), second[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "first", "second", "many"])

        return run

    def ranked(table: pa.Table) -> pa.Table:
        """Of a range of ranks, for each block which of its pairs are there more than once, and their next ranks (none for the first, whose names stay)."""
        rows = table.to_pylist()
        firsts, seconds = ([np.frombuffer(r[c], np.uint64) for r in rows] for c in ("first", "second"))
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        order, begin = _sorted(first, second)
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(f)) for r, f in zip(rows, firsts, strict=True)])
        again = (np.diff(begin) > 1) | (np.add.reduceat(many[order].astype(np.int64), begin[:-1]) > 0)
        number = (first[order[begin[:-1]]] >> shift << shift) | np.cumsum(again).astype(np.uint64)
        alive, rank = np.empty(len(first), bool), np.empty(len(first), np.uint64)
        alive[order], rank[order] = np.repeat(again, np.diff(begin)), np.repeat(number, np.diff(begin))
        out, done = [], 0
        for r, f in zip(rows, firsts, strict=True):
            kept = alive[done : done + len(f)]
            out.append((r["block"], r["bucket"], len(f), np.packbits(kept).tobytes(), rank[done : done + len(f)][kept].tobytes() if len(second) else b""))
            done += len(f)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "n", "alive", "rank"])

    def kept(pairs: Callable[[dict], tuple]) -> Callable:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """The positions of a block that stay, with their ranks."""
            row, replies = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["bucket"])
            at, first, second = pairs(row)
            order, begin = _sorted(first, second)
            alive = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["alive"], np.uint8), count=r["n"]).astype(bool) for r in replies)])
            stays = np.zeros(len(at), bool)
            stays[order] = np.repeat(alive, np.diff(begin))
            if len(second):
                rank = np.zeros(len(alive), np.uint64)
                rank[alive] = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["rank"], np.uint64) for r in replies)])
                first = np.empty(len(at), np.uint64)
                first[order] = np.repeat(rank, np.diff(begin))
            columns = [row["block"], row["a"], row["b"], row["copies"], row["ends"], np.diff(at[stays], prepend=0).astype(np.uint32).tobytes(), first[stays].tobytes()]
            return pa.table([pa.array([c]) for c in columns], names=["block", "a", "b", "copies", "ends", "at", "rank"])

        return run

    reply = "block long, bucket long, n long, alive binary, rank binary"
    columns, pairs, times = ["block", "ends", "text"], partial(_first, size=size), waves
    while True:
        parts, step = [], -(-(1 << bits) // times)
        for low in range(0, 1 << bits, step):
            out = told.select(*columns).mapInArrow(dealt(pairs, low, min(low + step, 1 << bits)), "bucket long, block long, first binary, second binary, many binary")
            parts.append(materialise(out.groupBy("bucket").applyInArrow(ranked, reply)))
        replies = reduce(DataFrame.unionByName, parts)
        # Blocks get their replies in parts, so that not all ranks lie in shuffles at once.
        before, after = told, []
        for part in range(times):
            mine, its = (rows.where(F.pmod(F.xxhash64("block"), F.lit(times)) == part).groupBy("block") for rows in (before, replies))
            after.append(materialise(mine.cogroup(its).applyInArrow(kept(pairs), f"block long, {BLOCK}, at binary, rank binary")))
        told = reduce(DataFrame.unionByName, after)
        for used in (before, *parts):
            discard(used)
        if size >= length:
            return told.select("a", "b", "copies", "ends", "at").mapInArrow(_ranges(length), "a long, b long, whole boolean, spans array<struct<begin:long,end:long>>")
        offset = min(size, length - size)
        columns, pairs, times = ["block", "ends", "at", "rank"], partial(_pairs, size=size, offset=offset), -(-waves // 3)
        size += offset


def _ranges(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            a, b, copies, ends = (np.frombuffer(row[c], np.int64) for c in ("a", "b", "copies", "ends"))
            at = np.cumsum(np.frombuffer(row["at"], np.uint32), dtype=np.int64)
            text = np.searchsorted(ends, at, "right")
            at -= (ends - np.diff(ends, prepend=0))[text]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] - at[:-1] > length))) if len(at) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(at)) - 1 if len(at) else new
            spans = pa.StructArray.from_arrays([pa.array(at[new]), pa.array(at[last] + length)], ["begin", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(len(ends) + 1)).astype(np.int32)), spans)
            out = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(copies > 1), lists], names=["a", "b", "whole", "spans"])
            yield out.filter(pa.array((copies > 1) | (np.diff(np.asarray(lists.offsets)) > 0)))

    return run
