"""Streams of chat turns and events: keyed session state, windows with watermarks, de-duplication, micro-batch sinks.

Every function takes a streaming DataFrame, and works on a static one where its operators do. `run_once` drives a folder of
files through a stream to its end, with the checkpoint in the folder the session names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from answerloom.catalog import query
from answerloom.functions import text as T
from answerloom.sources.shared import new_path
from answerloom.sources.tables import table

#: Turns that a session remembers, and milliseconds that it lives without a new one.
TURNS, IDLE_MS = 3, 30 * 60 * 1000
STATE = "turns array<string>, n bigint"
OUT = "conv_id bigint, turn bigint, n_turns bigint, follow_up boolean, history string"


def read_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 16) -> DataFrame:
    """A table's files as a stream; the schema is that of the table, never inferred from new files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Like read_table where the table may be one file or a folder of files: streams read folders, so the path is a pattern that only it matches."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/{name}.parque[t]")


def turn_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """start, event_type, n, total: counts in windows of event time; rows later than the watermark are dropped."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once_each(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: saved answers that come again are not saved twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's turns in order: each with the number of turns before it, whether it follows up, and the last three."""
    if state.hasTimedOut:
        state.remove()
        return
    turns, n = state.get if state.exists else ([], 0)
    turns = list(turns)
    rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
    out = []
    for r in rows.itertuples():
        out.append((key[0], r.turn, n, bool(n and (r.short or r.refers)), " / ".join(turns) if turns else None))
        turns, n = [*turns, r.text][-TURNS:], n + 1
    state.update((turns, n))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "n_turns", "follow_up", "history"])


def remember_a_while(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """remember, with sessions that are forgotten after IDLE_MS without a turn."""
    yield from remember(key, batches, state)
    if state.exists:
        state.setTimeoutDuration(IDLE_MS)


def session_turns(turns: DataFrame, forget: bool = True) -> DataFrame:
    """Turns with what their session knows at that time; needs conv_id, turn, text.

    forget: idle sessions time out. A stream that is to end when all is read needs False, as timeouts ask for ever more batches.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"short": F.size(F.split(F.trim("text"), r"\s+")) <= 6, "refers": F.col("text").rlike(T.FOLLOW_UP)})
    how = (remember_a_while, GroupStateTimeout.ProcessingTimeTimeout) if forget else (remember, GroupStateTimeout.NoTimeout)
    return rows.groupBy("conv_id").applyInPandasWithState(how[0], OUT, STATE, "append", how[1])


def log_rows(turns: DataFrame) -> DataFrame:
    """Rows of the question log: texts masked, never with an address or a phone number."""
    return turns.select("conv_id", "turn", "role", T.masked("text").alias("question"), F.length("text").alias("n_chars"))


def upsert(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that a repeated batch cannot fill twice: every batch has a folder of its own, which is replaced."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_once(stream: DataFrame, name: str, key: list[str], mode: str = "append") -> DataFrame:
    """Drives a stream over all that is there into a table in the shared folder, and returns that table."""
    spark = stream.sparkSession
    at = new_path(spark, name)
    # a stream without a row has no batch and so writes no folder
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/table/batch=none")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(upsert(f"{at}/table", key)).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{at}/table")


def save_sessions(states: DataFrame, path: str) -> None:
    """Each session's turns and pending question, one row a session; the last state replaces those before it."""
    states.select("session_id", "turns", "pending").write.mode("overwrite").parquet(path)


def load_session(spark: SparkSession, path: str, session_id: str) -> dict | None:
    """The state of one session as it was saved, or None; a filter that reaches the scan."""
    row = spark.read.parquet(path).filter(F.col("session_id") == session_id).first()
    return row.asDict(recursive=True) if row else None


def sliding_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, n: counts in windows of one hour every half hour of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n: a user's events with gaps of less than two hours, once the watermark has closed them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""WITH w AS (SELECT make_timestamp(1000000 * CAST(floor(epoch(ts) / 1800) * 1800 - k * 1800 AS BIGINT)) AS start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY start""")
def stream_sliding(spark, sf_dir):
    """Overlapping windows that the watermark has closed."""
    events = read_files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(sliding_counts(events), "sliding", ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_event_sessions(spark, sf_dir):
    """Sessions of users that the watermark has closed."""
    events = read_files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(session_counts(events), "event_sessions", ["user_id", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{}') THEN 'long' ELSE 'short' END AS mode, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INT) AS n_words FROM conversations""".format(T.LONG_REQUEST).replace("\\\\", "\\"))
def stream_scores(spark, sf_dir):
    """Turns scored as they come, each micro-batch saved at once, a few files at a time."""
    rows = read_files(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_mode("text").alias("mode"), F.size(F.split(F.trim("text"), r"\s+")).alias("n_words"))
    return run_once(rows, "scores", ["conv_id", "turn"])


@query("""SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '\\S+@\\S+', '[hidden]', 'g'), '\\+?\\d[\\d\\s-]{6,}\\d', '[hidden]', 'g') AS question, CAST(length(text) AS INT) AS n_chars FROM conversations""".replace("\\\\", "\\"))
def stream_question_log(spark, sf_dir):
    return run_once(log_rows(read_files(spark, sf_dir, "conversations")), "log", ["conv_id", "turn"])


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER w - 1 AS n, string_agg(text, ' / ') OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, n AS n_turns, n > 0 AND (len(regexp_split_to_array(trim(text), '\\s+')) <= 6 OR regexp_matches(text, '(?i)\\b(it|its|this|that|these|those|they|them|their|same|above|also)\\b|^(and|or|what about|how about)\\b')) AS follow_up, history FROM t""".replace("\\\\", "\\"))
def stream_sessions(spark, sf_dir):
    """Turns as a stream with keyed state; equal to the same question asked of the whole table."""
    return run_once(session_turns(read_files(spark, sf_dir, "conversations"), forget=False), "sessions", ["conv_id", "turn"])


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts < (SELECT date_trunc('hour', max(ts) - INTERVAL 10 MINUTE) FROM events) GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Windows that the watermark has closed once all events were read."""
    events = read_files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(turn_counts(events), "windows", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_once_each(spark, sf_dir):
    """Events of each user and kind saved once; the watermark is long enough to hold the whole table."""
    events = read_files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(once_each(events, ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "once", ["user_id", "event_type"])


@query("""SELECT event_id, n_name, value FROM events JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'click'""")
def stream_static_join(spark, sf_dir):
    """A stream beside a small fixed table."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    events = read_files(spark, sf_dir, "events").filter("event_type = 'click'")
    return run_once(events.join(nation, F.col("user_id") % 25 == F.col("n_nationkey")).select("event_id", "n_name", "value"), "joined", ["event_id"])
