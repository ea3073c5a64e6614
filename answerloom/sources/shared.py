"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor costs a read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_kept: dict[tuple, tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster is told to set it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="answerloom-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and return the written table."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """What tells whether files changed: names, sizes and times of all files under the paths."""
    hadoop, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        for s in at.getFileSystem(hadoop).globStatus(at) or []:
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return repr(sorted(found))


def open_or_build(spark: SparkSession, name: str, paths: list[str], build) -> DataFrame:
    """The table that build() makes from the files under paths: built once a session, and anew when a file has changed."""
    key, state = (spark.sparkContext.applicationId, name, *paths), state_of(spark, paths)
    if key not in _kept or _kept[key][0] != state:
        _kept[key] = (state, save(build(), name))
    return _kept[key][1]
