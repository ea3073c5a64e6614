"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from answerloom.sources.shared import new_path, save

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def save_bucketed(df: DataFrame, name: str, buckets: int, by: str, partition_by: str) -> DataFrame:
    """save, with the rows of a value of `by` in one bucket, so that a join on it does not shuffle this side.

    Every task writes its own rows into their buckets: writing shuffles nothing either. Buckets need a name in the catalog,
    which a catalog that outlives the session keeps as aw_<name>_<number>.
    """
    spark, table = df.sparkSession, f"aw_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_path(spark, name)).partitionBy(partition_by).bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table)


#: A key is hot from 1 / HOT_KEYS of all rows on, and from HOT_ROWS rows on, so there are never more than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def join_unique(rows: DataFrame, of: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with a saved table `of` that is unique by key; its column n says how many of the rows a key has.

    Rows of hot keys stay where they are and get theirs by a broadcast of at most HOT_KEYS rows, so no task gathers a hot
    key; the others are joined by a shuffle.
    """
    total = of.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(of.filter(F.col(n) >= least))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(of.filter(F.col(n) < least).hint("merge"), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Rows of an Arrow batch where the session leaves the default, which is meant for short rows; texts are long.
ARROW_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch, so that neither side of it holds tens of MB; another setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


#: Parts that a group is cut into before its first rows are taken.
SALTS = 64


def first_of_each(rows: DataFrame, by: str, n: int, h: str = "h", tie: str = "doc_id") -> DataFrame:
    """The n rows of each group with the least (h, tie). Parts of a group are cut to n rows first, so no task sees a whole group."""
    salted = rows.withColumn("aw_salt", F.pmod(F.xxhash64(h, tie), F.lit(SALTS)))
    for keys in ((by, "aw_salt"), (by,)):
        salted = salted.withColumn("aw_n", F.row_number().over(Window.partitionBy(*keys).orderBy(h, tie))).filter(F.col("aw_n") <= n).drop("aw_n")
    return salted.drop("aw_salt")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's vocabulary lies; TOKENIZER_DIR overrides the installed folder."""
    if base := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: The most bits of the filter of ids that is broadcast: at most ID_BITS / 64 rows of two numbers, whatever the input's size.
ID_BITS = 1 << 27


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap of the hashes of ids (column doc_id), as rows (aw_word, aw_bits); its size is bounded by ID_BITS."""
    at = id_hash()
    return ids.select(at.alias("h")).groupBy(F.shiftright("h", 6).alias("aw_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("aw_bits"))


def id_hash(col: str = "doc_id") -> Column:
    return F.shiftrightunsigned(F.xxhash64(col, F.lit(9)), 64 - (ID_BITS.bit_length() - 1))


def with_maybe(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with aw_maybe: false where doc_id is surely not among ids. Texts are not shuffled; the broadcast is bounded."""
    words = F.broadcast(id_filter(ids))
    marked = docs.withColumn("aw_hash", id_hash()).join(words, F.shiftright("aw_hash", 6) == F.col("aw_word"), "left")
    return marked.withColumn("aw_maybe", F.coalesce(F.expr("getbit(aw_bits, cast(aw_hash % 64 as int)) = 1"), F.lit(False))).drop("aw_hash", "aw_word", "aw_bits")


def one_per_group(docs: DataFrame, decided: DataFrame, with_key) -> DataFrame:
    """docs with one row of each group, the one with the smallest doc_id; of several rows under that id, one.

    decided: doc_id, aw_key (what tells rows of one id apart), aw_group, aw_first (the group's smallest id), for the rows of
    groups of two and more. with_key adds aw_key to docs; it is computed for rows whose id may go only.
    """
    decided = save(decided, "decided")
    stays = F.col("doc_id").eqNullSafe(F.col("aw_first"))
    twice = decided.filter(stays).groupBy("aw_group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("aw_group")
    again = save(decided.filter(stays).join(twice, "aw_group", "left_semi").select("doc_id", "aw_key", "aw_group").distinct(), "again")
    gone = save(decided.filter(~stays).select("doc_id", "aw_key").unionByName(again.select("doc_id", "aw_key")).distinct(), "gone")
    marked = with_maybe(docs, gone)
    sure = marked.filter(~F.col("aw_maybe"))
    maybe = with_key(marked.filter("aw_maybe"))
    keys = gone.select(F.col("doc_id").alias("aw_id"), F.col("aw_key").alias("aw_of"))
    left = maybe.join(keys.hint("merge"), F.col("doc_id").eqNullSafe(F.col("aw_id")) & (F.col("aw_key") == F.col("aw_of")), "left_anti")
    out = sure.select(*docs.columns).unionByName(left.select(*docs.columns))
    if again.isEmpty():
        return out
    some = again.select(F.col("doc_id").alias("aw_id"), F.col("aw_key").alias("aw_of"), "aw_group")
    rows = with_key(with_maybe(docs, again).filter("aw_maybe")).join(some, F.col("doc_id").eqNullSafe(F.col("aw_id")) & (F.col("aw_key") == F.col("aw_of")))
    first = rows.withColumn("aw_n", F.row_number().over(Window.partitionBy("aw_group").orderBy("text", F.xxhash64(*docs.columns)))).filter("aw_n = 1")
    return out.unionByName(first.select(*docs.columns))
