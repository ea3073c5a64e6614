"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Texts are hashed where they are read. Each partition of the digests sends, to every owner of a range of the hash space,
   its distinct fingerprints in sorted order, as Golomb-Rice codes of their gaps (a few bits each instead of 64).
2. An owner decodes what it was sent and answers every sender with a bitmap: which of its fingerprints came more than once.
   A sender's digests lie in one bucket of a table, so the bitmaps travel to them and no digest is shuffled.
3. Only rows with a marked fingerprint (suspects) are looked at again: their texts are shuffled and compared byte by byte.

Neither a text nor a digest leaves its partition unless its fingerprint is shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

#: Fingerprints of an owner, about, and rows that a sender gathers before it sends. Digests are read in partitions of millions
#: of rows, so senders and owners both grow with rows / million, and a block holds about OWNED * SENT / rows fingerprints.
OWNED, SENT = 2_000_000, 1_000_000
#: Rows of a bucket of digests, about, and the most buckets that Spark allows.
BUCKET, BUCKETS = 100_000, 100_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned numbers as Golomb-Rice codes of their gaps: the parameter, and the bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean())))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    # unary quotients: a one after so many zeros; then k low bits each
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, low])).tobytes()


def rice_decode(k: int, n: int, blob: bytes) -> np.ndarray:
    """The n numbers of rice_encode."""
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ones = np.flatnonzero(bits[: max(0, len(bits) - n * k)])[:n]
    quotient = np.diff(ones, prepend=-1) - 1
    low = bits[int(ones[-1]) + 1 :][: n * k].reshape(n, k) if n else np.zeros((0, k), np.uint8)
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= low[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _send(n_owners: int, id_type: pa.DataType):
    """Rows (doc_id, sha, fp) -> the same rows with their sender and place, and one coded block for each owner.

    A place is a bit of the bitmap that the sender will get: those of its owners one after another, in whole words of 64.
    """
    width = (1 << 64) // n_owners + 1
    schema = pa.schema([("kind", pa.int32()), ("doc_id", id_type), ("sha", pa.binary()), ("sender", pa.int64()), ("row", pa.int64()), ("owner", pa.int32()), ("place", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("own", pa.binary()), ("block", pa.binary())])

    def blocks(table: pa.Table, sender: int) -> Iterator[pa.RecordBatch]:
        fp = table.column("fp").to_numpy().view(np.uint64)
        values, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
        owner = (values // np.uint64(width)).astype(np.int64)
        start = np.searchsorted(owner, np.arange(n_owners + 1))
        words = -(-np.diff(start) // 64) * 64
        place = np.arange(len(values)) - start[owner] + (np.cumsum(words) - words)[owner]
        n = len(fp)
        yield from pa.Table.from_arrays(
            [pa.array(np.zeros(n, np.int32)), table.column("doc_id"), table.column("sha"), pa.array(np.full(n, sender)), pa.array(np.arange(n)), pa.nulls(n, pa.int32()), pa.array(place[inverse]), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
            schema=schema,
        ).to_batches(max_chunksize=20_000)
        out = []
        for o in np.unique(owner).tolist():
            some = slice(start[o], start[o + 1])
            k, blob = rice_encode(values[some] - np.uint64(o * width))
            out.append((1, None, None, sender, None, o, None, k, int(start[o + 1] - start[o]), np.packbits(count[some] > 1).tobytes(), blob))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SENT:
                yield from blocks(pa.Table.from_batches(held), (TaskContext.get().partitionId() << 20) + part)
                held, size, part = [], 0, part + 1
        if size:
            yield from blocks(pa.Table.from_batches(held), (TaskContext.get().partitionId() << 20) + part)

    return send


def _answer(key, table):
    """One owner's blocks -> for each sender, the bitmap (64 places to a word) of fingerprints that came more than once."""
    rows = table.to_pylist()
    sent = [rice_decode(r["k"], r["n"], r["block"]) for r in rows]
    values, count = np.unique(np.concatenate(sent), return_counts=True)
    more = values[count > 1]
    words = []
    for r, v in zip(rows, sent, strict=True):
        twice = np.unpackbits(np.frombuffer(r["own"], np.uint8), count=r["n"]).astype(bool)
        if len(more):
            at = np.minimum(np.searchsorted(more, v), len(more) - 1)
            twice |= more[at] == v
        bits = np.zeros(-(-r["n"] // 64) * 64, np.uint8)
        bits[: r["n"]] = twice
        words.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
    return pa.table({"sender": pa.array([r["sender"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "bitmap": pa.array(words, pa.list_(pa.int64()))})


def normalised(col: str = "text"):
    return F.regexp_replace(common.text_or_empty(col), common.SPACES, " ")


def _collisions(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspects' texts, compared by bytes: digests under which different texts lie."""
    texts = common.with_maybe(docs.select("doc_id", "text"), suspects).filter("aw_maybe").select(normalised().alias("text"))
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("n")).groupBy(F.unhex(F.sha2("text", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("sha")


def marked(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, sha, sender, row, suspect (its fingerprint came more than once)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    digests = common.save(docs.select("doc_id", normalised().alias("t")).select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("fp")), "digests")
    n = digests.count()
    ddl = f"kind int, doc_id {kind.simpleString()}, sha binary, sender long, row long, owner int, place long, k int, n int, own binary, block binary"
    sent = digests.mapInArrow(_send(max(2, -(-n // OWNED)), to_arrow_type(kind)), ddl)
    sent = common.save_bucketed(sent, "exchange", min(BUCKETS, max(8, -(-n // BUCKET))), "sender", "kind")
    answers = sent.filter("kind = 1").select("sender", "owner", "k", "n", "own", "block").groupBy("owner").applyInArrow(_answer, "sender long, owner int, bitmap array<long>")
    # a sender's bitmap has at most SENT bits and a word more for each owner
    bitmaps = answers.groupBy("sender").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("owner", "bitmap"))), lambda x: x["bitmap"])).alias("bitmap"))
    bitmaps = common.save(bitmaps, "bitmaps")
    rows = sent.filter("kind = 0").select("doc_id", "sha", "sender", "row", "place").join(bitmaps.hint("merge"), "sender")
    return rows.select("doc_id", "sha", "sender", "row", F.expr("getbit(bitmap[cast(place div 64 as int)], cast(place % 64 as int)) = 1").alias("suspect"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of the six ASCII white space characters has become one space; null counts
    as empty. Of equal texts the row with the smallest doc_id stays (null ids last; of repeated rows with the same id and
    text exactly one). An empty table gives no rows. A digest under which different texts lie stops the job instead of
    merging them.
    """
    rows = marked(docs)
    suspects = common.save(rows.filter("suspect").drop("suspect"), "suspects")
    if not (bad := _collisions(docs, suspects)).isEmpty():
        raise ValueError(f"different texts under the same SHA-256: {[r.sha.hex() for r in bad.limit(3).collect()]}")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "sender", "row")
    groups = common.save(suspects.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    grouped = common.join_unique(suspects, groups, "sha", "size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), ((F.col("first.sender") == F.col("sender")) & (F.col("first.row") == F.col("row"))).alias("kept"), "sha"
    )
    alone = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates does not keep.

    Nulls and empty texts are equal texts like any other; of repeated rows and of ties between rows under the smallest id one
    stays; an empty table stays empty; other columns, whatever their names, are left as they are.
    """
    decided = exact_duplicates(docs).filter("group_size > 1").select("doc_id", F.col("text_sha256").alias("aw_key"), F.col("text_sha256").alias("aw_group"), F.col("keep_id").alias("aw_first"))
    return common.one_per_group(docs, decided, lambda d: d.withColumn("aw_key", F.sha2(normalised(), 256)))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
