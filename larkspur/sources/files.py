"""CSV, JSONL and report files."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from larkspur.operators.conversations import REQUIRED, require_columns
from larkspur.operators.ranks import ranked
from larkspur.sources.split_csv import read_csv

MESSAGE_SCHEMA = S.StructType([S.StructField(c, S.StringType()) for c in REQUIRED])


#: How CSV is written, so that quotes, line breaks, empty cells and white space come back as they were.
CSV = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_messages_csv(spark: SparkSession, path: str, schema: S.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Raw messages; every cell a string, quoted line breaks kept, bad bytes replaced. A missing column is an error.

    A large file is read by many tasks (see :func:`split_csv.csv_records`).
    """
    header = spark.read.option("header", True).csv(path).columns
    require_columns(spark.createDataFrame([], S.StructType([S.StructField(c, S.StringType()) for c in header])), tuple(schema.fieldNames()))
    ordered = S.StructType([S.StructField(c, S.StringType()) for c in header])
    return read_csv(spark, path, ordered).select(*schema.fieldNames())


def read_jsonl(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl_with_errors(spark: SparkSession, path: str, schema: S.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, lines that do not parse)."""
    marked = S.StructType([*schema.fields, S.StructField("_corrupt", S.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r._corrupt is not null").select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, *, sorted_keys: bool = False) -> None:
    """One JSON object a line, nulls written, non-ASCII kept."""
    df.select(*(sorted(df.columns) if sorted_keys else df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_document(spark: SparkSession, path: str, schema: S.StructType | str) -> DataFrame:
    """A JSON document that spans lines: an object is one row, an array a row for each element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """One text, such as a summary or a report, as a file of its own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def json_array(df: DataFrame, limit: int = 10_000) -> str:
    """At most ``limit`` rows as an indented JSON array in the frame's order, nulls written, non-ASCII kept; more are an error."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them as JSONL")
    return json.dumps([json.loads(r[0]) for r in rows], indent=2, ensure_ascii=False)


def write_sheet(df: DataFrame, path: str, blank: tuple[str, ...]) -> None:
    """CSV with empty columns to be filled in by hand."""
    df.select("*", *(F.lit("").alias(c) for c in blank)).write.mode("overwrite").options(**CSV, header=True).csv(path)


def read_labels(spark: SparkSession, path: str, schema: S.StructType | str, filled: tuple[str, ...]) -> DataFrame:
    """A sheet that was filled in by hand; an empty cell in a ``filled`` column is an error."""
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)
    blank = reduce(or_, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in filled), F.lit(False))
    if rows.where(blank).limit(1).count():
        raise ValueError(f"labels are incomplete: {', '.join(filled)}")
    return rows


def digest(df: DataFrame) -> str:
    """A content hash that does not depend on row order."""
    row = F.xxhash64(*(F.col(c) for c in df.columns))
    found = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return ":".join(str(x) for x in found)


def file_sizes(df: DataFrame, *others: str) -> DataFrame:
    """(others, file, bytes) of the files that a table is read from; ``others`` are columns that tell files of one name apart."""
    return df.select(*others, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()


def write_arrays(df: DataFrame, path: str, order: list[Column], rows: int = 1_000) -> None:
    """All rows as JSON arrays of up to ``rows`` rows, a file each, in order; nulls written, non-ASCII kept.

    Rows are numbered without a window over all of them, so any number of rows is many tasks' work.
    """
    placed = ranked(df, [], order, "_at").withColumn("_file", F.floor((F.col("_at") - 1) / rows))
    one = F.struct("_at", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
    arrays = placed.groupBy("_file").agg(F.array_sort(F.collect_list(one)).alias("whole"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("whole", lambda x: x["row"]), ",\n"), F.lit("\n]"))
    arrays.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def summary_json(one_row: DataFrame) -> str:
    """A one-row frame of aggregates as an indented JSON document."""
    return json.dumps(one_row.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str)


def markdown_table(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report section from at most ``limit`` aggregated rows."""
    rows = df.limit(limit).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def report(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    """A Markdown document: each section a text or the table of a frame of aggregates."""
    parts = [f"# {title}\n"]
    for head, body in sections:
        parts.append(markdown_table(body, head) if isinstance(body, DataFrame) else f"## {head}\n\n{body}\n")
    return "\n".join(parts)
