"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes puts a boundary wherever its top bits are zero, so an insertion moves the
boundaries near it only and equal passages are cut at equal places; where no boundary lies near, one bit less is asked for.
From every boundary a chunk reaches to the first boundary that is at least PASSAGE bytes on, so a chunk is long enough to be
no accident at any size of corpus, and chunks overlap; a shorter text is one chunk. Chunks are compared by digest; where
chunks that other documents hold too touch, they form a repeated passage, which is then extended at both ends as far as
another holder of its last chunk has the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Bytes that the rolling hash looks back; one boundary in about 2^TOP_BITS bytes.
WINDOW, TOP_BITS = 16, 5
#: A boundary this near to another candidate before it is dropped; with none so far on either side, weaker ones count; two
#: boundaries are never farther apart than the largest gap.
NEAR, LONELY, LARGEST = 8, 32, 1024
#: Bytes beyond a passage's chunks that are compared, at these lengths.
REACH = (*range(4, 64, 4), *range(64, 257, 16))
#: The least bytes of a chunk, and so of a repeated passage.
PASSAGE = 72
BATCH_BYTES = 2_000_000

#: Per byte; zero for NUL, which fills the gaps between texts.
GEAR = np.random.default_rng(16).integers(1, 1 << 16, 256, dtype=np.uint16)
GEAR[0] = 0


def boundaries(buffer: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end."""
    h = GEAR[buffer]
    for back in (1, 2, 4, 8):  # hashes of windows of 2, 4, 8, 16 bytes
        longer = h.copy()
        longer[back:] += h[:-back] << np.uint16(back)
        h = longer
    weak = np.flatnonzero(h >> np.uint16(17 - TOP_BITS) == 0)
    strong = h[weak] >> np.uint16(16 - TOP_BITS) == 0
    edges = np.concatenate([[-LONELY], weak[strong], [len(buffer) + LONELY]])
    after = np.searchsorted(edges, weak, side="left")
    lonely = (edges[np.minimum(after, len(edges) - 1)] - weak >= LONELY) & (weak - edges[after - 1] >= LONELY)
    at = weak[strong | lonely] + 1
    return at[np.diff(at, prepend=-NEAR - 1) > NEAR] if len(at) else at


def cut(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text its boundaries, the end included."""
    buffer = np.frombuffer((b"\0" * (WINDOW - 1)).join(texts), np.uint8)
    at, lo = boundaries(buffer), 0
    for t in texts:
        a, b = np.searchsorted(at, [lo + 1, lo + len(t)])
        ends = at[a:b] - lo
        if len(t):
            ends = np.append(ends, len(t))
            gaps = np.diff(ends, prepend=0)
            if gaps.max() > LARGEST:
                starts = ends - gaps
                ends = np.concatenate([np.append(np.arange(s + LARGEST, e, LARGEST), e) for s, e in zip(starts, ends, strict=True)])
        yield ends
        lo += len(t) + WINDOW - 1


def spans(ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks between boundaries start and end: each from `least` bytes on, the last one up to the text's end.

    A text under `least` bytes is one chunk.
    """
    if ends[-1] < least:
        return np.zeros(1, np.int64), ends[-1:]
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    upto = np.searchsorted(ends, begin + least)
    whole = upto < len(ends)
    begin, end = begin[whole], ends[upto[whole]]
    if len(end) and end[-1] < ends[-1]:
        begin, end = np.append(begin, begin[-1]), np.append(end, ends[-1])
    return begin, end


def _chunks(least: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= BATCH_BYTES:
                    size += len(texts[hi])
                    hi += 1
                n, starts, sizes, last, blobs = [], [], [], [], []
                for t, ends in zip(texts[lo:hi], cut(texts[lo:hi]), strict=True):
                    a, b = spans(ends, least) if len(ends) else (np.zeros(0, np.int64),) * 2
                    n.append(len(a))
                    starts.append(a)
                    sizes.append(b - a)
                    last.append(b == len(t))
                    blobs += [digest(t[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                owner = pa.array(np.repeat(np.arange(lo, hi), n))
                raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 16)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(owner), keys.take(owner), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(last).astype(bool)), pa.array(raw[:, :8].copy().view("<i8").ravel()), pa.array(raw[:, 8:12].copy().view("<i4").ravel())],
                    ["doc_id", "text_key", "at", "size", "last", "digest", "check"],
                )
                lo = hi

    return chunks


def text_key() -> Column:
    """Tells rows of one id apart; rows alike in both are one document."""
    return F.xxhash64(common.text_or_empty())


def chunks(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """One row per chunk: doc_id, text_key, at and size in bytes of UTF-8, last (it ends the text), and 96 bits of its digest."""
    common.short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(_chunks(least), f"doc_id {kind}, text_key long, at int, size int, last boolean, digest long, check int")


#: A digest that tells chunks before a passage's end from those behind its start.
LEFT, RIGHT = 1, 2


def _contexts(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each text and its edges (side, at): the bytes beyond each edge, those on the left turned round."""
    for texts, edges in columns:
        out = []
        for t, some in zip(texts.tolist(), edges.tolist(), strict=True):
            raw = (t or "").encode()
            out.append([raw[max(0, e["at"] - REACH[-1]) : e["at"]][::-1] if e["side"] == LEFT else raw[e["at"] : e["at"] + REACH[-1]] for e in some])
        yield pd.Series(out)


def merged(spans_: DataFrame) -> DataFrame:
    """Spans (doc_id, text_key, later, start, end and others) of a text that touch, as one."""
    order = Window.partitionBy("doc_id", "text_key", "later").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    runs = spans_.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_key", "later", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("n_chunks").alias("n_chunks"),
        F.max("n_copies").alias("n_copies"),
        F.min("origin").alias("origin"),
        F.min(F.struct("start", "end", "first_edge"))["first_edge"].alias("first_edge"),
        F.max(F.struct("end", "start", "last_edge"))["last_edge"].alias("last_edge"),
        F.max("last").alias("last"),
    ).drop("run")


def extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Passages with start and end moved outwards, by the lengths of REACH, over bytes that another text has there too.

    What lies beyond an edge is compared with what lies beyond it wherever the chunk at that edge occurs at an edge, by the
    hashes of its first bytes: counts of equal hashes are pre-aggregated, so a passage of any number of holders is no burden.
    Passages that are their whole text have no edges, and their texts are not read again.
    """
    edges = F.array(
        F.when(F.col("start") > 0, F.struct(F.lit(LEFT).alias("side"), F.col("start").alias("at"), F.col("first_edge").alias("edge"), "later")),
        F.when(~F.col("last"), F.struct(F.lit(RIGHT).alias("side"), F.col("end").alias("at"), F.col("last_edge").alias("edge"), "later")),
    )
    per = found.filter("start > 0 or not last").select("doc_id", "text_key", F.filter(edges, lambda e: e.isNotNull()).alias("edges"))
    per = common.save(per.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("edges")).alias("edges")), "edges")
    texts = common.with_maybe(docs.select("doc_id", "text"), per).filter("aw_maybe").select("doc_id", "text", text_key().alias("text_key"))
    texts = per.withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key").join(texts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))).select("doc_id", "text_key", "edges", F.pandas_udf(_contexts, "array<binary>")("text", "edges").alias("beyond"))
    beyond = common.save(texts.select("doc_id", "text_key", F.explode(F.arrays_zip("edges", "beyond")).alias("e")).select("doc_id", "text_key", "e.edges.*", "e.beyond").distinct(), "beyond")
    steps = F.filter(F.array(*(F.struct(F.lit(n).alias("reach"), F.xxhash64("side", "edge", F.lit(n), F.substring("beyond", 1, n)).alias("h")) for n in REACH)), lambda x: x["reach"] <= F.length("beyond"))
    steps = beyond.select("doc_id", "text_key", "side", "at", "later", F.explode(steps).alias("s")).select("doc_id", "text_key", "side", "at", "later", "s.*")
    who = F.xxhash64("doc_id", "text_key")
    shared = steps.groupBy("h").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b").select("h", "n")
    reach = common.join_unique(steps, common.save(shared, "reaches"), "h", "n").groupBy("doc_id", "text_key", "later", "side", "at").agg(F.max("reach").alias("reach"))
    far = [reach.filter(F.col("side") == side).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("later").alias("l"), F.col("at").alias(name), F.col("reach").alias(f"by_{name}")) for side, name in ((LEFT, "s"), (RIGHT, "e"))]
    out = found
    for side, name, at in ((far[0], "s", "start"), (far[1], "e", "end")):
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")) & (F.col("later") == F.col("l")) & (F.col(at) == F.col(name)), "left").drop("id", "key", "l", name)
    return out.withColumns({"start": F.col("start") - F.coalesce("by_s", F.lit(0)), "end": F.col("end") + F.coalesce("by_e", F.lit(0))}).drop("by_s", "by_e")


def repeated_passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """One row per repeated passage of a text: doc_id, start, end (bytes), n_chunks, n_copies, first_doc_id, later, text_key.

    A passage is the union of touching chunks of one text that each occur under at least two ids, extended by equal bytes; it
    has at least `least` bytes or is a whole text. later tells passages that a smaller id holds too, which a dedup cuts out,
    from the first occurrences. n_copies is the most occurrences of any of its chunks, first_doc_id the smallest id that holds
    one of them. Texts without repeats give no row, nor do null and empty texts; rows with a null id are compared under one id
    below all others. Rows alike in id and text are one document and give its passages once; rows under one id with different
    texts (text_key tells them apart) give those of each.
    """
    kind = docs.schema["doc_id"].dataType
    ours = common.save(chunks(docs, least), "chunks")
    key = ["digest", "check"]
    shared = ours.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last_id"), F.count("doc_id").alias("named"), F.count(F.lit(1)).alias("copies"))
    shared = shared.filter("first <> last_id or (named > 0 and named < copies)").select(*key, F.when(F.col("named") == F.col("copies"), F.col("first")).otherwise(F.lit(None).cast(kind)).alias("first"), "copies")
    marked = ours.join(shared, key).select(
        "doc_id", "text_key", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("size")).cast("long").alias("end"), "last", F.col("digest").alias("first_edge"), F.col("digest").alias("last_edge"),
        F.col("copies").alias("n_copies"), F.lit(1).cast("long").alias("n_chunks"), F.struct(F.col("first").isNotNull().alias("named"), "first").alias("origin"), (~F.col("first").eqNullSafe(F.col("doc_id"))).alias("later"),
    )
    found = common.save(merged(marked), "passages")
    return merged(extended(docs, found)).select("doc_id", "start", "end", "n_chunks", "n_copies", F.col("origin.first").alias("first_doc_id"), "later", "text_key")


def _without(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in columns:
        out = []
        for t, some in zip(texts.tolist(), spans.tolist(), strict=True):
            raw, kept, at = (t or "").encode(), [], 0
            for s in sorted((x["start"], x["end"]) for x in (some if some is not None else [])):
                kept.append(raw[at : s[0]])
                at = max(at, s[1])
            out.append(b"".join([*kept, raw[at:]]).decode(errors="ignore"))
        yield pd.Series(out)


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the later passages of each text cut out; a character that a passage's edge halves goes with it.

    Rows with a null id are left as they are, and so are null and empty texts; repeated rows are cut alike.
    """
    found = passages.filter("later and doc_id is not null").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("aw_spans"))
    found = found.withColumnsRenamed({"doc_id": "aw_id", "text_key": "aw_key"})
    both = docs.withColumn("aw_text_key", text_key()).join(found, (F.col("doc_id") == F.col("aw_id")) & (F.col("aw_text_key") == F.col("aw_key")), "left")
    return both.withColumn("text", F.when(F.col("aw_spans").isNull(), F.col("text")).otherwise(F.pandas_udf(_without, "string")("text", "aw_spans"))).select(*docs.columns)
