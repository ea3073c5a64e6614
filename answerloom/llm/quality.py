"""Quality rules: base counts of a text, and compression bands over the whole text and over fixed chunks.

A zstandard ratio (bytes / compressed bytes) far above that of prose of the same length marks repetitive text, one far
below it marks text without structure. Ratios grow with length, so each length has limits of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: From so many bytes: the least and the largest ratio of a text that is kept. Shorter texts than the first have no verdict.
#: The least lies above random base64 in words of 4 or 8 letters (1.21, 1.27, 1.35, 1.40, 1.42, 1.43 at a step's end) and below
#: prose (the least of sf0.1's: 1.35, 1.44, 1.69, 1.92, 2.09, 2.33), the largest between prose and filled-in templates.
BANDS = ((256, 1.22, 2.2), (384, 1.27, 2.3), (512, 1.355, 2.5), (1024, 1.42, 2.9), (2048, 1.5, 3.1), (4096, 1.72, 3.3), (16384, 1.8, 3.6), (65536, 1.85, 3.8), (1 << 20, 1.85, 4.2))
#: Chunks of so many bytes; a text goes if more than this share of them lies outside the band of a chunk.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 4096, (1.72, 3.3), 0.5
LEVEL = 3

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_odd_chunks long"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window which the text holds at least twice."""
    if len(words) < 4:
        return 0
    if len(set(zip(words, words[1:], words[2:], strict=False))) == len(words) - 2:
        return 0
    ids = {w: i for i, w in enumerate(words)}
    words = [ids[w] for w in words]
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    total, end = 0, 0  # end: words before it are counted
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if n[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measures(text: str, compress) -> tuple:
    """The FIELDS of one text."""
    raw = text.encode()
    words = raw.split()  # of bytes: splits at the six ASCII white space characters only
    if not words:
        return 0, 0, 0, 0, 0, None, 0, 0
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    bare = len(raw.translate(None, WHITE))
    chunks = [len(c) / len(compress(c)) for c in (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)) if len(c) == CHUNK]
    odd = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
    return (
        len(words),
        len(text) - (len(raw) - bare),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) / len(compress(raw)),
        len(chunks),
        odd,
    )


def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for batch in batches:
        out = pd.DataFrame([measures(t or "", compress) for t in batch.tolist()], columns=names)
        yield out.astype({n: "float64" if n == "ratio" else "int64" for n in names})


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base counts, base_failed, ratio, chunks, kept.

    Needs doc_id and text. A null or empty text has no words, fails the base rules and has a null ratio; null ids and
    repeated rows give a row each; a text of any length is measured whole. No shuffle.
    """
    common.short_batches(docs.sparkSession)
    measured = docs.select("doc_id", F.pandas_udf(_measures, FIELDS)(common.text_or_empty()).alias("m"), F.octet_length(common.text_or_empty()).alias("bytes"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for at, least, most in BANDS:
        within = F.when(F.col("bytes") >= at, F.col("ratio").between(least, most)).otherwise(within)
    within = within & (F.col("n_odd_chunks") <= CHUNK_SHARE * F.col("n_chunks"))
    return (
        measured.select("doc_id", "bytes", "m.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
        .drop("bytes")
    )
