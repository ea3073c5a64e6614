"""Best-fit packing of pieces of tokens into sequences by minimum bin slack.

Which lengths go together is planned on the table of lengths and their counts, which has at most `room` rows whatever the
input's size: per bin, the largest length left is fixed and a bitset subset-sum finds the fullest combination of available
lengths that fits beside it; the combination is taken as often as the counts allow and removed. The plan says which ranks of
each length go where, so pieces find their sequence by their rank among those of the same length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokens

ROOM = 2048
#: Pieces of one writing task have a row number of the same high bits; ranks are counted within these first.
TASK_BITS = 33


def fullest(counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a fullest combination of available lengths of at most room; counts[n]: how many of length n.

    Longer lengths come first, so that short ones stay for later bins.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left, some = min(counts[n], room // n), 1
        while left > 0:
            m = min(some, left)
            after = (reach | reach << (n * m)) & mask
            if after != reach:
                steps.append((n, m, reach))
                reach = after
            left -= m
            some *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + m
            at -= n * m
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, in each sequence, first sequence, offset) for every length of every combination."""
    counts = [0] * (room + 1)
    for n, c in histogram.items():
        counts[n] = c
    next_rank, out, sequence = [0] * (room + 1), [], 0
    longest = room
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        used = dict(fullest(counts, room - longest)) if longest < room else {}
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // u for n, u in used.items())
        offset = 0
        for n, u in sorted(used.items(), reverse=True):
            out.append((n, next_rank[n], next_rank[n] + u * times, u, sequence, offset))
            next_rank[n] += u * times
            counts[n] -= u * times
            offset += n * u
        sequence += times


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """pieces with the columns sequence_id and offset. Needs length (1 to room) and row (a number that no other row has).

    Pieces that fill a sequence alone get it without any shuffle. The others are ranked within their length, first within the
    rows of one writing task and then over the tasks, so no task sees a whole length. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    short = pieces.filter(F.col("length") < room)
    parts = short.groupBy("length", F.shiftright("row", TASK_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = common.save(parts, "lengths")
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most room - 1 rows
    steps = spark.createDataFrame(plan(histogram, room), "length long, lo long, hi long, each long, sequence long, at long")
    before = parts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # only rows and lengths are ranked; whatever else a piece has is shuffled once, at the end
    ranked = short.select("row", "length", F.shiftright("row", TASK_BITS).alias("part")).withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)
    ranked = ranked.join(before.hint("merge"), ["length", "part"]).select("row", "length", (F.col("rank") + F.col("before")).alias("rank"))
    steps = F.broadcast(steps)  # a few rows for each of at most room lengths
    placed = ranked.join(steps, (ranked["length"] == steps["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "row",
        F.expr("sequence + (rank - lo) div each").alias("sequence_id"),
        (F.col("at") + (F.col("rank") - F.col("lo")) % F.col("each") * ranked["length"]).alias("offset"),
    )
    full = pieces.filter(F.col("length") == room).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    return short.join(placed.hint("merge"), "row").select(*pieces.columns, "sequence_id", "offset").unionByName(full)


def pack_documents(docs: DataFrame, room: int = ROOM, end_id: int = 0) -> DataFrame:
    """Texts tokenised, cut and packed: doc_id, piece, start, length, ids, sequence_id, offset.

    A null or empty text is a piece of one id, the end; null ids and repeated rows are packed like any other, ties of length
    go in the order of the rows. ids are little-endian unsigned 32-bit numbers, as tokens.token_pieces gives them.
    """
    pieces = tokens.token_pieces(docs, room, end_id)
    pieces = common.save(pieces.select(F.monotonically_increasing_id().alias("row"), "doc_id", "piece", "start", "length", "ids"), "pieces")
    return pack(pieces, room).drop("row")
