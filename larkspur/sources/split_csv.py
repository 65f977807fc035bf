"""CSV with line breaks inside quotes, read by many tasks a file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from larkspur.sources.tables import materialise

#: What a piece of a block is: whole records, the end of a record begun before, the beginning of one that goes on behind, or neither.
WHOLE, END, BEGINNING, MIDDLE = range(4)
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])


def _cutter() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Made here, so that the function goes to the workers whole and they need not import this module."""

    def text(line: bytes) -> str:
        return line.decode("utf-8", "replace")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines in order, (file, start, inside, quotes, line), as pieces: records joined up where they end in their block.

        ``inside`` tells whether a block begins inside quotes; from there on the number of quotes so far does. The first
        record of a file, its header, is left out.
        """
        now, inside, header, begun = None, False, False, False
        parts: list[bytes] = []
        rows: list[tuple] = []

        def left() -> None:
            """What a block ends with that its records do not."""
            if now is not None and (inside or parts):
                rows.append((*now, BEGINNING if begun else MIDDLE, text(b"\n".join(parts))))

        def ended(record: bytes) -> None:
            nonlocal header
            record = record.removesuffix(b"\r")
            if not record and begun:
                return  # an empty line
            if header and begun:
                header = False
                return
            rows.append((*now, WHOLE if begun else END, text(record)))

        for batch in batches:
            files, starts, carried = (batch.column(c).to_pylist() for c in ("file", "start", "inside"))
            odd = np.asarray(batch.column("quotes")) % 2 == 1
            for k, line in enumerate(batch.column("line").to_pylist()):
                if (files[k], starts[k]) != now:
                    left()
                    now, inside, parts = (files[k], starts[k]), bool(carried[k]), []
                    begun, header = not inside, starts[k] == 0
                if not inside and not odd[k]:
                    ended(line)
                    continue
                parts.append(line)
                if odd[k]:
                    inside = not inside
                    if not inside:
                        ended(b"\n".join(parts))
                        parts, begun = [], True
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PIECES)], schema=_PIECES)
            rows.clear()
        left()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _PIECES)], schema=_PIECES)

    return cut


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of CSV files without their headers, as text; line breaks inside quotes are part of a record.

    Files are read in blocks as Spark splits text files, so a large one is many tasks' work. A first scan counts the quotes of each block; a block
    begins inside quotes where the blocks before it hold an odd number. With that each block is cut into
    records on its own, and only what its ends leave over, two pieces a block at most, is joined up with its neighbours.
    Bytes that are no UTF-8 are replaced, empty lines left out, and of lines that end in ``\\r\\n`` the ``\\r`` goes. A quote that is never
    closed makes the rest of the file one record. A file that Spark cannot split, as compressed ones, is one block.
    """
    text = spark.read.text(path, lineSep="\n")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), quotes.alias("quotes"), F.col("value").cast("binary").alias("line"))
    odd = materialise(lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("odd")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A row a block: the window over a file's blocks runs over few numbers.
    blocks = odd.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # Sorted again, as the join may deal blocks to other tasks.
    ordered = lines.join(materialise(blocks), ["file", "start"]).sortWithinPartitions("file", "start", "at")
    pieces = ordered.select("file", "start", "inside", "quotes", "line").mapInArrow(_cutter(), "file string, start long, kind int, record string")
    rest = materialise(pieces.where(F.col("kind") != WHOLE))
    # In a block an end comes before a beginning; a beginning opens a record, to which all belongs up to the next one.
    order = [F.col("start"), F.col("kind") == BEGINNING]
    number = F.count_if(F.col("kind") == BEGINNING).over(Window.partitionBy("file").orderBy(*order))
    of_record = rest.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == BEGINNING).alias("opens"), "record"))).alias("parts"))
    joined = of_record.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return pieces.where(F.col("kind") == WHOLE).select("record").unionByName(joined)


def read_csv(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """The rows of :func:`csv_records`, parsed by ``schema`` in the order of the files' columns. A quote inside quotes is doubled."""
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return csv_records(spark, path).select(F.from_csv("record", schema.toDDL(), options).alias("r")).select("r.*")
