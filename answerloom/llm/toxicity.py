"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram (3 to 6 characters of the lower-cased text, runs of other characters than letters
read as one space), hashed into a fixed table. Its value is the log ratio of its smoothed shares in toxic and in clean
labelled texts; a logistic regression with an L2 penalty is fitted on the features of the largest ratios and scores a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common

ORDERS = (3, 4, 5, 6)
BITS = 22
#: The bounds of the labelled sample that is learnt from: texts of either class, and their characters.
ROWS_OF_CLASS, CHARS_OF_CLASS = 1500, 6_000_000
#: An n-gram counts as a feature from so many texts of a class on; so many of the largest ratios are kept.
LEAST_TEXTS, FEATURES = 3, 4096
SMOOTHING, PENALTY = 1.0, 1e-3
#: Characters that are worked on at once.
BATCH_CHARS = 400_000

#: Symbols of characters: 0 for all but letters, else a number of 16 bits, the same for both cases.
_symbols: list[np.ndarray] = []


def symbols() -> np.ndarray:
    if not _symbols:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                low = ord(ch.lower()[0])
                table[c] = 1 + (low if low < 0xFFFF else low * 40503 % 65521)
        _symbols.append(table)
    return _symbols[0]


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each after a 0, with one 0 for each run of other characters; and each symbol's text."""
    n = np.array([len(t) + 1 for t in texts], np.int64)
    s = symbols()[np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    starts = np.zeros(len(s), bool)
    starts[np.cumsum(n) - n] = True
    # the line feed before a text stays even where the text before it ends in one
    keep |= starts
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    return s[keep].astype(np.uint64), owner[keep]


def buckets(s: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the table places of all n-grams, and their texts."""
    code = s.copy()
    for k in range(2, max(ORDERS) + 1):
        if len(s) < k:
            return
        code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[k - 1 :]
        if k in ORDERS:
            within = owner[: len(code)] == owner[k - 1 :]
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int32), np.where(within, owner[: len(code)], -1)


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting beats numpy's hash table on large arrays of integers."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def present(s: np.ndarray, owner: np.ndarray, useful: np.ndarray | None = None) -> np.ndarray:
    """Distinct pairs (text << BITS | place) of the n-grams of symbols; useful: only places that it marks."""
    found = []
    for place, of in buckets(s, owner):
        keep = of >= 0
        if useful is not None:
            keep &= useful[place]
        found.append(distinct((of[keep].astype(np.int64) << BITS) | place[keep]))
    return distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)


def long_present(text: str, useful: np.ndarray | None = None) -> np.ndarray:
    """present for one text of any length: its symbols as a whole, then blocks of them that overlap by an n-gram."""
    # the 0 before a run is none of the text's, unless the run starts with one itself
    runs = [flat([text[i : i + BATCH_CHARS]])[0].astype(np.uint16)[int(i > 0 and symbols()[ord(text[i])] > 0) :] for i in range(0, len(text), BATCH_CHARS)]
    s = np.concatenate(runs)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(s), BATCH_CHARS):
        block = s[i : i + BATCH_CHARS + max(ORDERS) - 1].astype(np.uint64)
        found.append(present(block, np.zeros(len(block), np.int32), useful))
    return distinct(np.concatenate(found))


def features(texts: list[str], useful: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """For ranges of texts: from, to, pairs of present."""
    lo = size = 0
    for i in range(len(texts) + 1):
        if i > lo and (i == len(texts) or size + len(texts[i]) > BATCH_CHARS):
            yield lo, i, long_present(texts[lo], useful) if size > BATCH_CHARS else present(*flat(texts[lo:i]), useful)
            lo, size = i, 0
        size += len(texts[i]) if i < len(texts) else 0


def fit(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, their weights and the intercept, from labelled texts; without both classes, no place and a neutral score."""
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    low = (1 << BITS) - 1
    counts = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
    for lo, _, p in features(texts):
        of = toxic[lo + (p >> BITS)]
        for c, which in zip(counts, (of, ~of), strict=True):
            c += np.bincount(p[which] & low, minlength=1 << BITS).astype(np.int32)
    a, b = ((n + SMOOTHING) / (m + 2 * SMOOTHING) for n, m in zip(counts, (toxic.sum(), (~toxic).sum()), strict=True))
    ratio = np.log(a / b)
    often = np.maximum(*counts) >= LEAST_TEXTS
    strength = np.where(often, np.abs(ratio) * np.sqrt(np.maximum(*counts)), 0)
    places = np.sort(np.argsort(-strength, kind="stable")[: min(FEATURES, int(often.sum()))])
    column = np.full(1 << BITS, -1, np.int32)
    column[places] = np.arange(len(places))
    rows, cols = [], []
    for lo, _, p in features(texts, column >= 0):  # the texts once more: holding all their n-grams would take far more memory
        rows.append(lo + (p >> BITS))
        cols.append(column[p & low])
    rows, cols, r = np.concatenate(rows), np.concatenate(cols), ratio[places]
    # classes count alike; values are scaled so that a text's features have about unit length
    scale = 1 / max(1.0, np.sqrt(np.bincount(rows, r[cols] ** 2, len(texts)).mean()))
    x = r * scale
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    w, bias, vel, velb = np.zeros(len(places)), 0.0, np.zeros(len(places)), 0.0
    # the squared norm of the rows bounds the curvature, and with it the step
    step = 1 / (0.25 * (np.bincount(rows, x[cols] ** 2, len(texts)).max() + 1) + PENALTY)
    for k in range(300):  # accelerated gradient steps
        m = k / (k + 3)
        wl, bl = w + m * vel, bias + m * velb
        z = np.bincount(rows, (wl * x)[cols], len(texts)) + bl
        d = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        gw = np.bincount(cols, d[rows], len(places)) * x + PENALTY * wl * 1e-2
        nw, nb = wl - step * 8 * gw, bl - step * 8 * d.sum()
        vel, velb, w, bias = nw - w, nb - bias, nw, nb
    # the half lies in the middle of the gap between the classes, where they have one
    z = np.bincount(rows, (w * x)[cols], len(texts)) + bias
    above, below = np.quantile(z[~toxic], 0.999), np.quantile(z[toxic], 0.005)
    return places, w * x, float(bias - (above + below) / 2 if above < below else bias)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on labelled texts of either class in the order of their ids' hashes, outside the held-out fold.

    At most ROWS_OF_CLASS texts and CHARS_OF_CLASS characters of a class are learnt from, whole texts of any length. Rows with
    a null id, text or label are not; an id with labels of both kinds counts as toxic, and of several texts under one id the
    least is taken.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(common.crc_of_id() % folds != held_out).withColumn("h", F.xxhash64("doc_id", F.lit(4)))
    # the sample is drawn among ids first (a few more than needed), so that only its texts are read into memory, in one scan
    sample = common.first_of_each(known, "toxic", 2 * ROWS_OF_CLASS)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").groupBy("toxic", "h", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy("toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumns({"n": F.count(F.lit(1)).over(order), "upto": F.sum(F.length("text")).over(order)})
    rows = texts.filter((F.col("n") <= ROWS_OF_CLASS) & (F.col("upto") <= CHARS_OF_CLASS)).orderBy("toxic", "n").select("toxic", "text").collect()
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], bool))


def _scores(model):
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, weights, bias = model.value
        table = np.zeros(1 << BITS, np.float32)
        table[places] = weights
        useful = table != 0
        for batch in batches:
            texts = [t or "" for t in batch.tolist()]
            z = np.full(len(texts), bias)
            for lo, hi, p in features(texts, useful):
                z[lo:hi] += np.bincount(p >> BITS, table[p & ((1 << BITS) - 1)], hi - lo)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scores


def score_column(spark, model):
    common.short_batches(spark)
    return F.pandas_udf(_scores(spark.sparkContext.broadcast(model)), "double")(common.text_or_empty())


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts score by the intercept alone; null ids count as not labelled, and repeated rows get the same
    score each. An empty table gives no rows; without labels of both classes every score is 0.5. No shuffle of texts.
    """
    model = learn(docs, labels, folds, held_out)
    return docs.select(
        "doc_id", (common.crc_of_id() % folds == held_out).alias("held_out"), score_column(docs.sparkSession, model).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
