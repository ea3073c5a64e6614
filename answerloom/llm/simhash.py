"""Near-duplicates by SimHash: 64-bit fingerprints of 4-word shingles, linked at few differing bits.

Candidates come from the pigeonhole principle: of the bands that the 64 bits are cut into, two fingerprints with at most
`radius` differing bits agree on at least m of m + radius. Each choice of m bands is a bucket key, so every pair that has to
be found shares a bucket. Fingerprints of large buckets get longer keys, of more bands, and are dealt anew by those. (Distances
to pivots alone pick no candidates: those of 64 random bits crowd around 32.) In a bucket, pairs are discarded by pivot distance tables: the Hamming distances of every
fingerprint to many reference fingerprints are computed once, and a pair whose distances to any reference differ by more
than `radius` cannot be linked (triangle inequality). Survivors are verified on all bits. Only a spanning forest of the
links of a bucket leaves it, never all pairs, and equal fingerprints enter once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components

SHINGLE, RADIUS, PIVOTS = 4, 4, 16
#: Bands in a bucket's key, and in the key of the fingerprints of buckets that hold more than CROWDED.
BANDS, MORE_BANDS, CROWDED = 2, 4, 1024
#: A bucket of longer keys with more fingerprints is cut into parts of about this many, and each pair of parts is worked on alone.
PART = 2048
#: Fingerprints that one task holds at once, and links that it holds before it joins them.
SLAB, HELD = 65_536, 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, block: int = 1 << 16) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_digest
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for lo in range(0, n, block):
        some = words[lo : lo + block + SHINGLE - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(some) - SHINGLE + 1].tolist()
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        for i in range(0, len(bits), 255):
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(np.array([fingerprint(t or "") for t in batch.tolist()], np.uint64).astype(np.int64))


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs with a column of the fingerprint's bits as a signed long."""
    common.short_batches(docs.sparkSession)
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(common.text_or_empty()))


def bands(n_bands: int) -> list[tuple[int, int]]:
    """(shift, width) of n_bands bands that cover 64 bits."""
    edges = [64 * i // n_bands for i in range(n_bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links between 0..n-1: the least member of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def linked(fps: np.ndarray, group_end: np.ndarray, side: np.ndarray | None, radius: int) -> np.ndarray:
    """Labels of fingerprints joined by links within their groups, which lie one after another.

    group_end: for each position, where its group ends. side: where given, only pairs of different sides count.
    """
    n = len(fps)
    tables = np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in pivots()])
    held_a, held_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    at = np.arange(n)
    for gap in itertools.count(1):
        at = at[at + gap < group_end[at]]
        if not len(at):
            break
        a = at
        b = at + gap
        if side is not None:
            other = (side[a] < 0) | (side[a] != side[b])
            a, b = a[other], b[other]
        for t in tables:
            near = np.abs(t[a] - t[b]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        held_a.append(a[near])
        held_b.append(b[near])
        held += int(near.sum())
        if held > HELD:
            label = joined(n, np.concatenate(held_a), np.concatenate(held_b))
            rest = np.flatnonzero(label != np.arange(n))
            held_a, held_b, held = [rest], [label[rest]], len(rest)
    return joined(n, np.concatenate(held_a), np.concatenate(held_b))


def _links(radius: int):
    """From rows (key, part_a, part_b, side, fp) sorted by the first three: links (a, b) that connect what is linked."""

    def work(key, pa_, pb_, side, fps):
        new = np.ones(len(fps), bool)
        new[1:] = (key[1:] != key[:-1]) | (pa_[1:] != pa_[:-1]) | (pb_[1:] != pb_[:-1])
        edges = np.append(np.flatnonzero(new), len(fps))
        end = np.repeat(edges[1:], np.diff(edges))
        label = linked(fps, end, side, radius)
        rest = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[rest].view(np.int64)), pa.array(fps[label[rest]].view(np.int64))], ["a", "b"])

    def links(batches):
        kept: list = []

        def all_of(parts):
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        size = 0
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(cols[0]):
                continue
            kept.append([*cols[:4], cols[4].view(np.uint64)])
            size += len(cols[0])
            if size < SLAB:
                continue
            c = all_of(kept)
            # the last group may go on in the next batch
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield work(*(x[:cut] for x in c))
            kept = [[x[cut:] for x in c]]
            size = len(c[0]) - cut
        if kept:
            yield work(*all_of(kept))

    return links


def keyed(fps: DataFrame, m: int, radius: int) -> DataFrame:
    """key, fp: a row for each choice of m of m + radius bands."""
    keys = [
        F.xxhash64(F.lit(m), F.lit(i), *(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in choice))
        for i, choice in enumerate(itertools.combinations(bands(m + radius), m))
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For distinct fingerprints (column fp): links (a, b) whose components are those of all pairs within radius.

    Every bucket's work is bounded: fingerprints of buckets over CROWDED are dealt anew by longer keys, which find all their
    pairs on their own, and what is over PART even then is cut into parts by a hash, a pair of parts to a group.
    """
    rows = keyed(fps, BANDS, radius)
    sizes = common.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = common.save(common.join_unique(rows, sizes, "key", "n"), "shared")
    finer = keyed(common.save(shared.filter(F.col("n") > CROWDED).select("fp").distinct(), "crowded"), MORE_BANDS, radius)
    finer_sizes = common.save(finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "finer")
    rows = shared.filter(F.col("n") <= CROWDED).unionByName(common.join_unique(finer, finer_sizes, "key", "n"))
    parts = F.ceil(F.col("n") / PART)
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    pairs = (
        rows.select("key", "fp", mine.cast("long").alias("mine"), parts.cast("long").alias("parts"))
        .select("key", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select(
            "key",
            F.least("mine", "other").alias("part_a"),
            F.greatest("mine", "other").alias("part_b"),
            # within one part all pairs count (side -1), between two only those across
            F.when(F.col("mine") == F.col("other"), F.lit(-1)).when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("side"),
            "fp",
        )
    )
    sorted_ = pairs.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b")
    return sorted_.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, group_fingerprint (the component's least), group_size (its rows).

    component_id is the smallest doc_id that is reached over links of at most radius differing bits, itself included. Null
    and empty texts have the fingerprint zero and are linked like any other; a null id counts in no minimum (a component of
    null ids alone has a null component_id); repeated rows give a row each. An empty table gives no rows.
    """
    rows = common.save(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    classes = common.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    roots = common.save(components(near_links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root"), "roots")
    of = classes.join(roots.hint("merge"), "fp", "left")
    alone = of.filter("root is null").select("fp", "n", F.col("first").alias("component_id"), F.col("fp").alias("group"), F.col("n").alias("group_size"))
    linked = common.save(of.filter("root is not null"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("members"))
    linked = common.join_unique(linked, common.save(least, "least"), "root", "members").select("fp", "n", "component_id", F.col("root").alias("group"), "group_size")
    ids = common.save(alone.unionByName(linked), "components")
    return common.join_unique(rows, ids, "fp", "n").select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("group").alias("group_fingerprint"), "group_size")


def hexed(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id (null ids last, one of several rows under it).

    All null and empty texts are one group; an empty table stays empty; other columns, whatever their names, stay as they are.
    """
    decided = near_duplicates(docs, radius).filter("group_size > 1").select("doc_id", F.col("fingerprint").alias("aw_key"), F.col("group_fingerprint").alias("aw_group"), F.col("component_id").alias("aw_first"))
    return common.one_per_group(docs, decided, lambda d: with_fingerprint(d, "aw_fp").withColumn("aw_key", hexed("aw_fp")).drop("aw_fp"))
