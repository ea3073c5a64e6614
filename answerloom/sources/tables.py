"""Readers and writers: tables of the engine, JSON lines with their row numbers, delimited files of unknown encoding."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

CHUNK = (
    "chunk_id string, doc_type string, section_id string, letter_no int, path array<string>, sub_heading string, pdf_pages array<int>, printed_pages array<string>, source string, text string, embed_text string, n_chars int, footnotes array<struct<pdf_page int, num int, text string>>"
)
BLOCK = (
    "doc_id string, block_id string, `order` int, unit string, title string, path array<string>, level int, parent_id string, pdf_pages array<int>, printed_pages array<string>, source string, searchable boolean, summary string, items array<struct<type string, depth int, text string, pdf_page int, top double>>, footnotes array<struct<pdf_page int, num int, text string>>"
)
ANSWER = "run_id string, model string, version string, format string, run int, qid string, answer string, prompt_hash string, seconds double, prompt_tokens int, answer_tokens int, finish_reason string, truncated boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; what cannot be parsed is kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def with_row_no(df: DataFrame) -> DataFrame:
    """Adds row_no from 0 in file order, without gaps: by path, then by place in the file; df has to come straight from files.

    Rows of each block of a file are counted first, so no task sees all rows. A table that is not read from files is numbered
    in the order of its partitions.
    """
    by = ["aw_file", "aw_block"]
    try:
        tagged = df.select("*", F.col("_metadata.file_path").alias("aw_file"), F.col("_metadata.file_block_start").alias("aw_block"), F.monotonically_increasing_id().alias("aw_at"))
    except AnalysisException:
        tagged = df.select("*", F.lit("").alias("aw_file"), F.spark_partition_id().alias("aw_block"), F.monotonically_increasing_id().alias("aw_at"))
    blocks = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("aw_at").alias("least"))
    shift = blocks.select(*by, (F.sum("n").over(Window.orderBy(*by)) - F.col("n") - F.col("least")).alias("shift"))  # one row for each block
    return tagged.join(shift, by).withColumn("row_no", F.col("aw_at") + F.col("shift")).drop(*by, "aw_at", "shift")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, key: list[str], schema: str) -> None:
    """Appends rows whose key the table does not hold yet, one for each key; a missing table counts as empty."""
    spark, df = df.sparkSession, df.dropDuplicates(key)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    new = df.join(spark.read.schema(schema).parquet(path), key, "left_anti") if there else df
    new.write.mode("append").parquet(path)


# What the bytes 80 to 9F mean in windows-1252; five of them mean nothing.
HIGH = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A delimited file with a header, all columns as text unless a schema is given, names trimmed; broken lines are dropped.

    The encoding is found from the data: UTF-8 (with or without a mark) if every cell is, else windows-1252 unless a byte has
    no meaning there, else Latin-1. The file is read byte for byte and decoded by expressions, so it stays splittable.
    """
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", "ISO-8859-1").csv(path)
    named = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    cells = [F.coalesce(F.col(c), F.lit("")) for c in named.columns]
    utf8 = reduce(lambda a, b: a & b, (F.is_valid_utf8(F.encode(c, "ISO-8859-1").cast("string")) for c in cells), F.lit(True))
    odd = reduce(lambda a, b: a | b, (c.rlike("[\x81\x8d\x8f\x90\x9d]") for c in cells), F.lit(False))
    seen = named.agg(F.coalesce(F.bool_and(utf8), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd")).first()
    heads = [c.encode("latin-1", "ignore") for c in raw.columns]
    try:
        names = [h.decode("utf-8-sig") for h in heads]
    except UnicodeDecodeError:
        seen, names = None if seen.utf8 and not seen.odd else seen, [h.decode("cp1252", "replace") for h in heads]
    if seen and seen.utf8:
        fixed = [F.encode(F.col(c), "ISO-8859-1").cast("string") for c in named.columns]
    elif seen and seen.odd:
        fixed = [F.col(c) for c in named.columns]
    else:
        fixed = [F.translate(F.col(c), HIGH.decode("latin-1"), HIGH.decode("cp1252")) for c in named.columns]
    out = named.select(*(f.alias(n.strip()) for f, n in zip(fixed, names, strict=True)))
    if schema is None:
        return out
    wanted = StructType.fromDDL(schema)
    return out.select(*(F.col(f"`{o}`").try_cast(f.dataType).alias(f.name) for o, f in zip(out.columns, wanted.fields, strict=True)))


def write_sheets(tables: dict[str, DataFrame], folder: str) -> None:
    """A report of several tables, each as a delimited file with a header in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_manifest(manifest: dict, spark: SparkSession, path: str) -> None:
    """A run's manifest as one JSON document; the one before is replaced."""
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def reuse(spark: SparkSession, path: str, fingerprint: str, build) -> DataFrame:
    """build()'s table, kept at path with its fingerprint (of the input and of all settings): made anew when that has changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/fingerprint")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there or read_manifest(spark, f"{path}/fingerprint") != {"fingerprint": fingerprint}:
        build().write.mode("overwrite").parquet(f"{path}/table")
        write_manifest({"fingerprint": fingerprint}, spark, f"{path}/fingerprint")
    return spark.read.parquet(f"{path}/table")


def padded_rows(rows: str, header: str) -> Column:
    """Rows of cells, each filled up with empty cells to the header's width."""
    width = F.size(header)
    return F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, F.greatest(width, F.lit(1))))
