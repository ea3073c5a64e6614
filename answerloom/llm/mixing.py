"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share `ratio` times all words by weight, none above `cap` times its own words; what a capped source leaves
is shared among the others by weight. Schedule: the van der Corput points of a power of two of slots are mapped through the
cumulative numbers of slots of the sources (over a whole period each source gets exactly its number), slots are ranked
within their source, and rank r takes the r-th block of the source. Blocks hold equally many words of the source's
documents in a hashed order, and come around again when a source is used up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common

WEIGHTS, RATIO, CAP = (3, 1, 2), 1.5, 2.0
#: Words of a block, and documents of a source that are put in order at once.
BLOCK, BUCKET = 1024, 2000
#: Slots that one task makes at once.
RUN = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """Row number, id, source and words of each document, written once so that the numbers stay."""
    return common.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long").alias("size")), "sizes")


def targets(sized: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """One row per source: src, source, source_size, n_docs, target. Windows run over this small table only."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    per = per.withColumn("at", F.col("most") / F.col("weight"))
    order = Window.orderBy("at", "src")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(ratio) * F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("level", (total - before) / after)
    # the water level: where the first source, in the order of its cap per weight, is not filled
    level = F.min(F.when(F.col("at") > F.col("level"), F.struct("at", "src", "level"))).over(Window.partitionBy(F.lit(1)))["level"]
    return per.withColumn("water", level).select(
        "src", "source", "source_size", "n_docs", F.when(F.col("water").isNull() | (F.col("at") <= F.col("water")), F.col("most")).otherwise(F.col("water") * F.col("weight")).alias("target")
    )


def quotas(per: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds: words to take, blocks, whole rounds over them, words of the last round, slots, first slot."""
    return (
        per.withColumn("words", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("rounds") * F.col("source_size"))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .withColumn("first", F.sum("slots").over(Window.orderBy("src")) - F.col("slots"))
    )


def schedule(quota: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot: slot (its time), src, rank, block, round, take (words of the block that the slot takes).

    Of the 2^k points i, the one whose reversed bits are v belongs to the source with first <= v < first + slots. Its rank is
    the number of earlier points of the source, which is counted without looking at them: for each set bit p of v, the
    numbers in the source's range that equal v's lower bits modulo 2^(p+1).
    """
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    k = max(1, int(total - 1).bit_length())
    runs = quota.filter("slots > 0").select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run"))
    slots = runs.repartition("src", "run").select("src", "first", "slots", "blocks", "rounds", "rest", F.explode(F.expr(f"sequence(first + run * {RUN}, least(first + (run + 1) * {RUN}, first + slots) - 1)")).alias("v"))
    upto = "({0} - 1 - (v & (shiftleft(1L, p) - 1)) + shiftleft(1L, p + 1)) div shiftleft(1L, p + 1)"
    rank = f"aggregate(sequence(0, {k - 1}), 0L, (n, p) -> n + if(getbit(v, p) = 1, {upto.format('(first + slots)')} - {upto.format('first')}, 0L))"
    slot = f"aggregate(sequence(0, {k - 1}), 0L, (n, p) -> n + shiftleft(cast(getbit(v, p) as long), {k - 1} - p))"
    return (
        slots.select("*", F.expr(slot).alias("slot"), F.expr(rank).alias("rank"))
        .select("slot", "src", "rank", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("round"), "rounds", "rest")
        .withColumn("take", F.when(F.col("round") < F.col("rounds"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("block") * block)).cast("long"))
        .drop("rounds", "rest")
    )


def segments(sized: DataFrame, per: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """One row per document and block: row, src, block, at (first word in the block), start (first word in the document), words.

    A source's documents stand in the order of a hash. It is cut into ranges of about BUCKET documents, so that no task
    sorts a whole source; the words before a range come from the small table of ranges.
    """
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET)).cast("long")
    of = F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("long")
    docs = sized.join(per.select("src", "source", "n_docs"), sized["source"].eqNullSafe(per["source"])).select("row", "src", "doc_id", "size", "n_docs", h.alias("h")).select("row", "src", "doc_id", "size", "h", of.alias("range"))
    small = docs.groupBy("src", "range").agg(F.sum("size").alias("n"))
    small = small.select("src", "range", (F.sum("n").over(Window.partitionBy("src").orderBy("range")) - F.col("n")).alias("before"))
    order = Window.partitionBy("src", "range").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("upto", F.sum("size").over(order)).join(small, ["src", "range"]).filter("size > 0").select("row", "src", (F.col("before") + F.col("upto") - F.col("size")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))
    return placed.select("row", "src", "lo", "hi", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")).alias("block")).select(
        "row", "src", "block", F.greatest(F.col("lo") - F.col("block") * block, F.lit(0)).alias("at"), F.greatest(F.col("block") * block - F.col("lo"), F.lit(0)).alias("start"), (F.least("hi", (F.col("block") + 1) * block) - F.greatest("lo", F.col("block") * block)).alias("words")
    )


def scheduled(sized: DataFrame, per: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix, written once: row, slot, block, at, start, words. In the order of slot and at it holds the taken words.

    One row per slot and document with words in it: words from the document's word `start` on, at the block's word `at`.
    """
    plan = schedule(quotas(per, block), block).select("slot", "src", "block", "take")
    taken = segments(sized, per, block).join(plan.hint("merge"), ["src", "block"]).withColumn("words", F.least(F.col("words"), F.col("take") - F.col("at")))
    return common.save(taken.filter("words > 0").select("row", "slot", "block", "at", "start", "words"), "blocks")


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken (words, repeats counted), first_slot.

    first_slot is the time of the schedule at which the mix first takes a word of the row, null where it takes none.

    A null source is a source of its own, the last; null or empty texts have no words and none is taken; repeated rows share
    no words, each counts alone. Every source's taken words are its target rounded to a whole word, and no document is taken
    more than `cap` times (rounded up to whole rounds). Reruns agree, as the order is a hash of the ids.
    """
    sized = sizes(docs)
    per = common.save(targets(sized, weights, ratio, cap), "targets")
    taken = scheduled(sized, per, block).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = sized.join(taken.hint("merge"), "row", "left")
    return out.join(per, out["source"].eqNullSafe(per["source"])).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    import re

    word = re.compile(common.WORD)
    for texts, blocks in batches:
        out = []
        for t, some in zip(texts.tolist(), blocks.tolist(), strict=True):
            if t is None:
                out.append(None)
                continue
            ends = [0, *(m.end() for m in word.finditer(t))]
            last = len(ends) - 1
            out.append([t[ends[b["start"]] : len(t) if b["start"] + b["words"] == last else ends[b["start"] + b["words"]]] for b in some])
        yield pd.Series(out)


def pieces(text, blocks):
    """For each block the text from the end of the word before its first to the end of its last; the last word's goes to the text's end."""
    return F.pandas_udf(_pieces, "array<string>")(text, blocks)


def mixed(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, block: int = BLOCK, order: bool = False) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each block of a slot and document in it, sorted by slot and place.

    A document that lies in several blocks is cut at their edges, at ends of words, and comes back in every round. One of
    which no word is taken gives no row, nor does one without words. n_chars, if there is one, follows the text. order adds
    slot, block, at (first word in the block), start (first word in the document) and words, which docs must not have then.
    """
    common.short_batches(docs.sparkSession)
    sized = sizes(docs)
    per = common.save(targets(sized, weights, ratio, cap), "targets")
    places = ("slot", "block", "at", "start", "words")
    taken = scheduled(sized, per, block).groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*places))).alias("aw_blocks"))
    taken = sized.join(taken.hint("merge"), "row").join(per.select("source", "source_size"), sized["source"].eqNullSafe(per["source"]))
    taken = common.save(taken.select(F.col("doc_id").alias("aw_id"), F.col("size").alias("aw_size"), F.col("source_size").alias("aw_source"), "aw_blocks"), "taken")
    if sized.filter("size > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # a row without words under the id of another takes none
        rows = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("aw_id")) & common.text_or_empty().rlike(common.WORD))
    else:
        # rows under one id with as many words of equal sources can stand for each other
        sized = docs.withColumn("aw_words", F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long"))
        totals = docs.select("source", F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long").alias("n")).groupBy(F.col("source").alias("aw_src")).agg(F.sum("n").alias("aw_total"))
        sized = sized.join(totals, F.col("source").eqNullSafe(F.col("aw_src"))).withColumn("aw_n", F.row_number().over(Window.partitionBy("doc_id", "aw_words", "aw_total").orderBy("source", "text")))
        taken = taken.withColumn("aw_m", F.row_number().over(Window.partitionBy("aw_id", "aw_size", "aw_source").orderBy("aw_blocks")))
        rows = sized.join(taken, F.col("doc_id").eqNullSafe(F.col("aw_id")) & (F.col("aw_words") == F.col("aw_size")) & (F.col("aw_total") == F.col("aw_source")) & (F.col("aw_n") == F.col("aw_m")))
    cut = F.exists("aw_blocks", lambda b: b["words"] < F.col("aw_size"))
    rows = rows.withColumn("aw_pieces", pieces(F.when(cut, F.col("text")), F.when(cut, F.col("aw_blocks"))))
    each = F.transform("aw_blocks", lambda b, i: F.struct(b.alias("place"), F.get("aw_pieces", i).alias("piece")))
    rows = rows.withColumn("aw_each", F.explode(each)).withColumn("text", F.coalesce("aw_each.piece", "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # written before it is sorted, as the sort first draws a sample of its rows
    rows = common.save(rows.select(*docs.columns, F.col("aw_each.place").alias("aw_place")), "mixed")
    rows = rows.orderBy("aw_place.slot", "aw_place.at")
    return rows.select(*docs.columns, *(F.col(f"aw_place.{c}").alias(c) for c in places if order))


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST(src % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS most FROM p),
o AS (SELECT *, most / weight AS ratio,
  (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY most / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level AS water FROM o WHERE ratio > level ORDER BY ratio, src LIMIT 1),
t AS (SELECT o.source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN most ELSE water * weight END AS target FROM o LEFT JOIN l ON true),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS rounds FROM t),
s AS (SELECT *, CAST(round(target) AS BIGINT) - rounds * source_size AS rest FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d),
b AS (SELECT *, CAST(ceil(source_size / 1024) AS BIGINT) AS blocks FROM s),
n AS (SELECT *, CAST(rounds * blocks + ceil(rest / 1024) AS BIGINT) AS slots, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM b),
f AS (SELECT *, sum(slots) OVER (ORDER BY nr) - slots AS first, greatest(1, ceil(log2(sum(slots) OVER ()))) AS k FROM n),
v AS (SELECT source, blocks, rounds, rest, CAST(k AS INT) AS k, unnest(range(CAST(first AS BIGINT), CAST(first + slots AS BIGINT))) AS v FROM f),
p2 AS (SELECT *, CAST(list_sum(list_transform(range(k), lambda p: ((v >> p) & 1) << (k - 1 - p))) AS BIGINT) AS slot FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM p2),
a AS (SELECT source, slot, rank % blocks AS block, CASE WHEN rank // blocks < rounds THEN 1024 ELSE least(1024, rest - rank % blocks * 1024) END AS take FROM r),
e AS (SELECT doc_id, source, upto - size AS lo, upto AS hi, unnest(range(CAST((upto - size) // 1024 AS BIGINT), CAST((upto - 1) // 1024 + 1 AS BIGINT))) AS block FROM c WHERE size > 0),
g AS (SELECT e.doc_id, e.source, e.hi, min(slot) AS first_slot FROM e JOIN a ON e.source IS NOT DISTINCT FROM a.source AND e.block = a.block AND greatest(e.lo - e.block * 1024, 0) < take GROUP BY ALL)
SELECT c.doc_id, c.size, s.source_size, CAST(s.target AS DOUBLE) AS target,
  CAST(s.rounds * c.size + greatest(0, least(c.upto, s.rest) - (c.upto - c.size)) AS BIGINT) AS taken, g.first_slot
FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source LEFT JOIN g ON c.size > 0 AND g.doc_id IS NOT DISTINCT FROM c.doc_id AND g.source IS NOT DISTINCT FROM c.source AND g.hi = c.upto
"""
