"""Lines as a page reader would give them, made of the documents: what the cleaning and section operators are tried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.sources.tables import table

#: One expression for both engines: a line's level by its number and its document.
_LEVEL = "CASE WHEN n = 0 THEN 'L1' WHEN (doc_id + n) % 7 = 3 THEN 'L2' WHEN (doc_id + n) % 7 = 4 AND doc_id % 2 = 0 THEN 'L2' WHEN (doc_id + n) % 11 = 5 THEN 'caption' WHEN (doc_id + n) % 13 = 6 THEN 'table' WHEN (doc_id + n) % 13 IN (8, 9) THEN 'diagram' ELSE 'body' END"
_COLUMNS = ("doc_id", "n", "text", "CAST(floor(n / 4.0) AS INT) + 1 AS page", "CAST(n % 4 * 40 + (doc_id + n) % 3 * 5 AS DOUBLE) AS top", "CAST(11 + (doc_id + n) % 3 AS DOUBLE) AS size", f"{_LEVEL} AS level")
LINES_SQL = f"raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS n FROM documents), lines AS (SELECT {', '.join(_COLUMNS)} FROM raw)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n (from 0), text, page, top, size, level of every line of every document."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return raw.selectExpr(*_COLUMNS)
