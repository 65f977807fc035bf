"""Packing token sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from larkspur.llm.common import pieces_of, slices
from larkspur.sources.tables import materialise

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
_WITH_IDS = pa.schema([*_ARROW, ("ids", pa.binary())])
#: White space beside the blank and the line feed, and the mark that texts are cut at.
_UNUSUAL = "[\\x01\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]"


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """An encoder of whole texts for a byte-level BPE vocabulary in ``tokenizers``' JSON format.

    Gives the ids of all texts in a row and the bounds of each text's; special-token strings
    in a text are ordinary text. A text is cut before every blank and around every line feed,
    places that the pre-tokenizer never joins across while white space stands alone, and each
    distinct piece of the batch is encoded once, one a line. Other texts are encoded whole.
    """
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    to_byte = {chr(b) if b in printable else chr(next(shifted)): b for b in range(256)}
    if set(ByteLevel.alphabet()) != set(to_byte):
        raise ValueError("unknown byte alphabet")
    ranks = {}
    for token, number in model["vocab"].items():
        if all(c in to_byte for c in token) and not (token.startswith("<|") and token.endswith("|>")):
            ranks[bytes(to_byte[c] for c in token)] = number
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    line_feed = ranks[b"\n"]

    def ids(text: str) -> np.ndarray:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4")

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _UNUSUAL)))
        apart = {int(k): ids(texts[int(k)].as_py()) for k in whole}
        plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), "", texts)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\x01 "), "\n", "\x01\n\x01"), "\x01")
        number, bounds, pieces = pieces_of(cut)
        # Between pieces that begin at a blank or a letter and end in neither white space,
        # a line feed is always a token of its own; pieces of white space alone stand apart.
        blank = {p: np.flatnonzero(np.asarray(pc.equal(pieces, p))) for p in ("", " ", "\n")}
        solid = np.setdiff1d(np.arange(len(pieces)), np.concatenate(list(blank.values())))
        together = ids("\n".join(pieces.take(pa.array(solid)).to_pylist()))
        begins, ends = np.zeros((2, len(pieces)), dtype=np.int64)
        ends[solid] = np.append(np.flatnonzero(together == line_feed), len(together))[: len(solid)]
        begins[solid] = np.concatenate([[0], ends[solid] + 1])[: len(solid)]
        for piece, at in blank.items():
            begins[at] = len(together)
            together = np.append(together, ids(piece))
            ends[at] = len(together)
        sizes = (ends - begins)[number]
        after = np.cumsum(sizes)
        out = together[np.repeat(begins[number] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]
        limits = np.concatenate([[0], after])[bounds]
        if apart:
            parts = [apart.get(k, out[limits[k] : limits[k + 1]]) for k in range(len(texts))]
            out, limits = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, limits

    return encode


def _slim(ids: bytes) -> bytes:
    """Ids of four bytes as two each, where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def _wide(ids: bytes, size: int) -> bytes:
    return ids if len(ids) == 4 * size else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


class LevelPacker:
    """Places remainders, each shorter than a window of ``width`` tokens, one after the other by the sum-of-squares rule.

    ``counts[h]`` is the number of open windows filled up to ``h``. A remainder of ``s``
    tokens goes to the level for which the sum of squared counts grows least, ties to the
    fullest window, 0 standing for a new one. :meth:`finish` settles what is still open, so that nothing is padded: the pieces of open
    windows fill windows again, the largest that fits first, and where none fits the smallest that does not is cut; what is left
    in the end goes into windows of a power of two. Of the ``tokens`` placed, ``by_rule`` are in windows that the rule
    closed, and ``cut`` are those of remainders that :meth:`finish` had to cut.
    """

    def __init__(self, width: int, first_id: int = 0) -> None:
        self.width, self.next_id = width, first_id
        self.tokens = self.by_rule = self.cut = 0
        self.counts = np.zeros(width + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(width + 1)]
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, start: int, size: int, crc: int, total: int, ids: bytes) -> None:
        """One remainder: ``ids`` are looked at only if it is cut."""
        self.tokens += size
        level = self.best_level(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append((doc_id, start, size, crc, total, ids))
        if level + size == self.width:
            self.by_rule += self.width
            self._close(window)
        else:
            self.open[level + size].append(window)
            self.counts[level + size] += 1

    def best_level(self, size: int) -> int:
        """The level of the open windows to use, 0 for a new one."""
        counts, width = self.counts, self.width
        below = counts[1 : width - size + 1]
        change = 1 - 2 * below
        change[: len(below) - 1] += 2 * counts[size + 1 : width] + 1
        change[below == 0] = np.iinfo(np.int64).max
        level = len(change) - int(np.argmin(change[::-1])) if len(change) else 0
        return level if level and change[level - 1] <= 2 * counts[size] + 1 else 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, size, crc, total, _ in pieces:
            self.rows.append((doc_id, start, size, crc, total, self.next_id, offset))
            offset += size
        self.next_id += 1

    def finish(self) -> None:
        pieces = [p for level in self.open for window in level for p in window]
        self.open, self.counts[:] = [[] for _ in range(self.width + 1)], 0
        by_size: dict[int, list[tuple]] = {}
        for p in pieces:
            by_size.setdefault(p[2], []).append(p)
        sizes, left = sorted(by_size), sum(p[2] for p in pieces)

        def take(size: int) -> tuple:
            piece = by_size[size].pop()
            if not by_size[size]:
                sizes.remove(size)
            return piece

        def cut(piece: tuple, room: int) -> tuple[tuple, tuple]:
            doc_id, start, size, _, total, ids = piece
            if start % self.width == 0:  # a whole remainder begins where a window would
                self.cut += size
            ids = _wide(ids, size)
            own, rest = ids[: 4 * room], ids[4 * room :]
            return (doc_id, start, room, zlib.crc32(own), total, own), (doc_id, start + room, size - room, zlib.crc32(rest), total, rest)

        while left:
            room = self.width if left >= self.width else 1 << (left.bit_length() - 1)
            left, window = left - room, []
            while room:
                at = bisect_right(sizes, room)
                # Two that fill the room, or one, before the largest that leaves some.
                pair = next((s for s in sizes[:at] if s < room and room - s in by_size and by_size[room - s] and (2 * s != room or len(by_size[s]) > 1)), None)
                if at:
                    window.append(take(pair if pair and sizes[at - 1] != room else sizes[at - 1]))
                    room -= window[-1][2]
                    continue
                own, rest = cut(take(sizes[0]), room)
                window.append(own)
                by_size.setdefault(rest[2], []).append(rest)
                if len(by_size[rest[2]]) == 1:
                    insort(sizes, rest[2])
                room = 0
            self._close(window)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer: str, *, width: int = 1024, end_id: int = 0, pack_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids, then ``end_id``, into sequences of at most ``width`` tokens.

    Each partition tokenises its documents once, gives their whole windows, and what is left of each document as a row of its
    numbers and ids, which is written. These remainders are dealt evenly to packs of about ``pack_rows`` of them, however
    the documents were dealt, since the rule needs as many open windows as there are levels before most fill exactly.
    Each pack is one pass over its rows in order (see :class:`LevelPacker`), so a lost task is done again from the written rows with
    the same result. Nothing is padded. A null text is empty: its only id is ``end_id``. Null and repeated ids are kept row by row;
    other columns are ignored; an empty table gives no rows. A text of any length is cut into whole windows.
    Memory is bounded by the largest text while tokenising, and by the open windows while packing, ``width`` remainders or so.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, next_id = byte_bpe(tokenizer), np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids, bounds = encode(batch.column("text"))
            bounds, rows = bounds.tolist(), []
            for doc_id, begin, stop in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                total = stop - begin + 1
                whole = np.concatenate([ids[begin:stop], end]).tobytes()
                last = total - total % width
                for start in range(0, last, width):
                    rows.append((doc_id, start, width, zlib.crc32(whole[4 * start : 4 * (start + width)]), total, next_id, 0, None))
                    next_id += 1
                if last < total:
                    rest = whole[4 * last :]
                    rows.append((doc_id, last, total - last, zlib.crc32(rest), total, None, None, _slim(rest)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WITH_IDS)] if rows else [pa.array([], f.type) for f in _WITH_IDS], schema=_WITH_IDS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(width, 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
            for doc_id, start, size, crc, total, ids in zip(*columns):
                packer.add(doc_id, start, size, crc, total, ids)
            yield packer.take()
        packer.finish()
        yield packer.take()

    rows = materialise(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(tokenise, f"{SCHEMA}, ids binary"))
    rest = rows.where("ids is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
    packs = max(1, -(-rest.count() // pack_rows))
    # Dealt row by row, so neither an id nor a text on most rows makes a pack larger.
    dealt = rest.repartition(packs).sortWithinPartitions("ids_crc32", "doc_id", "doc_tokens")
    return rows.where("ids is null").drop("ids").unionByName(dealt.mapInArrow(pack, SCHEMA))
