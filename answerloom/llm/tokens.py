"""Token counts and ids of whole texts, in Arrow batches that are balanced by bytes.

A text is cut at safe boundaries: single spaces between two characters that are not white space. There the byte-level
pre-tokenizer ends one unit and starts the next (the space goes with what follows), so the parts can be encoded alone and
their ids put together again. Each batch encodes its distinct parts once, all in one call, and the ids are dealt back to
the texts by array operations. Very long texts are worked on in runs of whole parts, so a text of any length needs the
memory of one batch.

The tokenizers file defines the ids. Where the same vocabulary is also given as ranks, parts of plain characters (ASCII
and Latin letters, on which the two libraries' patterns agree) go through the ranks, which is faster; all other parts, and
those with a special token's string, go through the tokenizers file.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Bytes of text that are worked on at once.
BATCH_BYTES = 1_500_000

#: Characters on which both libraries surely agree.
PLAIN = np.zeros(0x110000, bool)
PLAIN[[10, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]] = True
WHITE_BUT_PLAIN = re.compile(r"[\t\x0b-\r\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
WHITE = re.compile(r"[\s\x1c-\x1f\u0085\u180e\u200b\u2060\ufeff]")
#: A space that stands at an end or beside white space.
CARE = re.compile(r"^[\s\u180e\u200b\ufeff]|[\s\u180e\u200b\ufeff]$| [\s\u180e\u200b\u2060\ufeff]|[\s\u180e\u200b\u2060\ufeff] ".replace("\\s", r"\s\x1c-\x1f\x85"))

_loaded: dict = {}


def plain(text: str) -> bool:
    """Whether a text has plain characters only, and no string of a special token."""
    return "<|" not in text and "|>" not in text and bool(PLAIN[np.frombuffer(text.encode("utf-32-le"), np.uint32)].all())


def careful(texts: list[str]) -> list[int]:
    """Which texts are empty or have a space at an end or beside white space."""
    odd = WHITE_BUT_PLAIN.search("".join(texts))
    near = CARE.search if odd else lambda t: "  " in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n"
    return [i for i, t in enumerate(texts) if not t or near(t)]


class Coder:
    """Encodes parts of texts with a tokenizers file and, for plain parts, the same vocabulary's ranks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ranks = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.basename(ranks) == "byte_bpe_50k.tiktoken" and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("plain parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})
            self.width = np.zeros(max(of.values()) + 1, np.int64)
            for token, i in of.items():
                self.width[i] = len(token)

    def slowly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, parts: list[str], sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after another, and where each part's ids start (with the end at last).

        Each part but a first one starts with its space. sizes: their bytes, if known.
        """
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = "".join(parts)
        if self.ranks and plain(whole):
            ids = self.ranks.encode_to_numpy(whole, disallowed_special=())
            sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)) if sizes is None else sizes
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
            return ids, np.concatenate([[0], ends])
        easy = [i for i, p in enumerate(parts) if self.ranks and plain(p)]
        out: list = [None] * len(parts)
        if easy:
            ids, starts = self.parts([parts[i] for i in easy])
            for i, a, b in zip(easy, starts, starts[1:], strict=False):
                out[i] = ids[a:b]
        hard = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(hard, self.slowly([parts[i] for i in hard]), strict=True):
            out[i] = x
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if not any(texts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if alone := careful(texts):
            out: list = [np.zeros(0, np.uint32)] * len(texts)
            skip = set(alone)
            easy = [i for i in range(len(texts)) if i not in skip]
            if easy:
                ids, n = self.encode([texts[i] for i in easy])
                for i, x in zip(easy, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    out[i] = x
            for i in alone:
                if texts[i]:
                    out[i] = self.parts(split_safely(texts[i]))[0]
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        coded = pc.dictionary_encode(cut.values)
        which = coded.indices.to_numpy().astype(np.int64)
        # a text's first part has no space before it and follows no other part, so the firsts are encoded alone
        words = coded.dictionary.to_pylist()
        firsts = offsets[:-1]
        heads = [words[i] for i in which[firsts].tolist()]
        which[firsts] = len(words) + np.arange(len(firsts))
        ids, starts = self.parts([" " + w for w in words], pc.binary_length(coded.dictionary).to_numpy().astype(np.int64) + 1)
        alone = [self.ranks.encode_to_numpy(h, disallowed_special=()) for h in heads] if self.ranks and plain("".join(heads)) else [self.parts([h])[0] for h in heads]
        sizes = np.array([len(x) for x in alone], np.int64)
        n_of = np.concatenate([np.diff(starts), sizes])
        at_of = np.concatenate([starts[:-1], len(ids) + np.cumsum(sizes) - sizes])
        ids = np.concatenate([ids, *alone])
        n = n_of[which]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(at_of[which] - total[:-1], n) + np.arange(total[-1])
        return ids[flat], np.diff(total[offsets])

    def long(self, text: str) -> np.ndarray:
        """The ids of one text of any length."""
        return np.concatenate([self.encode([run])[0] if i == 0 else self.parts(split_safely(run))[0] for i, run in enumerate(long_runs(text))])


def split_safely(text: str) -> list[str]:
    """Parts that the pre-tokenizer treats independently; joined, they are the text."""
    parts: list[str] = []
    for i, p in enumerate(text.split(" ")):
        p = " " + p if i else p
        # safe if neither the character before the space nor the one after it is white space
        if i and not (parts and parts[-1] and not WHITE.match(parts[-1][-1]) and len(p) > 1 and not WHITE.match(p[1])):
            if parts:
                parts[-1] += p
            else:
                parts.append(p)
        else:
            parts.append(p)
    return [p for p in parts if p]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def long_runs(text: str, size: int | None = None) -> Iterator[str]:
    """A very long text in runs of whole parts of about as many bytes; all but the first start with their space. One without safe boundaries stays whole."""
    lo, chars = 0, max(1, (size or BATCH_BYTES) * len(text) // max(1, n_bytes(text)))
    safe = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
    while len(text) - lo > chars and (m := safe.search(text, lo + chars)):
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def coder(path: str) -> Coder:
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def balanced(sizes: list[int], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about as many bytes each; a longer text is alone."""
    lo, size, most = 0, 0, most or BATCH_BYTES
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encoded(path: str, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: from, to, all their ids, how many each has."""
    c, sizes = coder(path), [n_bytes(t) for t in texts]
    for lo, hi in balanced(sizes):
        if hi - lo == 1 and sizes[lo] > BATCH_BYTES:
            ids = c.long(texts[lo])
            yield lo, hi, ids, np.array([len(ids)])
        else:
            yield lo, hi, *c.encode(texts[lo:hi])


def _lengths(path: str):
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch.tolist()]
            yield pd.Series([int(x) for _, _, _, n in encoded(path, texts) for x in n], dtype="int64")

    return lengths


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text (null: 0) without special tokens added, as the tokenizers library counts them."""
    return F.pandas_udf(_lengths(path or common.tokenizer_path()), "long")(text)


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Needs doc_id and text; other columns are not read. A null text counts as empty (0 bytes, 0 tokens); null ids and
    repeated rows give a row each; an empty table gives no rows. No shuffle: texts go to Arrow batches where they are read.
    """
    common.short_batches(docs.sparkSession)
    text = common.text_or_empty()
    return (
        docs.select("doc_id", text.alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens(F.col("text"), path).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def _cut(path: str, room: int, end_id: int):
    def cut(batches):
        for batch in batches:
            ids_of, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for lo, _, ids, n in encoded(path, texts):
                row, piece, start, blobs, at = [], [], [], [], 0
                for i, k in enumerate(n.tolist()):
                    blob = np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4").tobytes()
                    at, total = at + k, k + 1
                    first = total % room or room
                    edges = [0, *range(first, total + 1, room)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(lo + i)
                        piece.append(p)
                        start.append(a)
                        blobs.append(blob[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return cut


def token_pieces(docs: DataFrame, room: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Each text's ids followed by end_id, cut into pieces of room ids where longer (the first piece may be shorter).

    Returns doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit numbers in a binary column;
    numpy.frombuffer(ids, "<u4") reads them). A null or empty text is one piece that holds end_id alone.
    """
    common.short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_cut(path or common.tokenizer_path(), room, end_id), f"doc_id {kind}, piece int, start long, length long, ids binary")
