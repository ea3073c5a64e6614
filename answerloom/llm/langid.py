"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of labelled text. A text is parsed from left
to right into the longest phrases that the automaton knows; the language whose sample explains it in the fewest phrases,
normalised by the sample's size (phrases * log2(sample length) / text length), wins. The parse is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: The bounds of the labelled sample: characters of a language, rows of a language that are drawn among.
SAMPLE_CHARS, SAMPLE_ROWS = 40_000, 400
#: A text is parsed in pieces of so many symbols side by side, so many times over until they fit together.
PIECE, ROUNDS = 256, 6
#: Characters that are worked on at once; a longer text is alone.
BATCH_CHARS = 1_000_000

_letters: list[np.ndarray] = []
_models: dict = {}


def letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
                table[c] = ord(ch.lower()[0])
        _letters.append(table)
    return _letters[0]


def suffix_automaton(s: list[int]) -> list[dict[int, int]]:
    """The transitions of the automaton that accepts exactly the substrings of s; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """All languages' automata as tables over one alphabet: symbol 0 separates words, 1 is any letter that no sample has."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        folded = {n: separated(letters()[points(samples[n])]) for n in self.names}
        alphabet = np.unique(np.concatenate([np.zeros(1, np.uint32), *folded.values()]))[1:]
        self.width = len(alphabet) + 2
        to = np.ones(0x110000, np.uint8 if self.width < 256 else np.uint16)
        to[0] = 0
        to[alphabet] = np.arange(2, self.width)
        self.symbol = to[letters()]
        self.tables, self.bits = [], []
        for n in self.names:
            nxt = suffix_automaton(to[folded[n]].tolist())
            # an entry holds twice the next state, plus one where a phrase ends before the symbol
            start = np.ones(self.width, np.int32)
            for c, q in nxt[0].items():
                start[c] = 2 * q + 1
            table = np.tile(start, (len(nxt), 1))
            for i, row in enumerate(nxt):
                for c, q in row.items():
                    table[i, c] = 2 * q
            self.tables.append(table.ravel())
            self.bits.append(np.log2(max(2, len(folded[n]))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, one after another with one 0 for each run of them, and how many each text has."""
        if len(texts) == 1:
            # made in runs, so that a long text needs little more memory than its symbols
            t = texts[0]
            s = separated(np.concatenate([self.symbol[points(t[i : i + BATCH_CHARS])] for i in range(0, max(1, len(t)), BATCH_CHARS)]))
            return s, np.array([len(s)], np.int64)
        n = np.array([len(t) for t in texts], np.int64)
        s = self.symbol[points("".join(texts))]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (owner[1:] != owner[:-1])
        return s[keep], np.bincount(owner[keep], minlength=len(texts))

    def walk(self, table: np.ndarray, s: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces side by side, each from its own state: phrases that end within it, and the state at its end."""
        order = np.argsort(-length, kind="stable")
        at, state, count = at[order], state[order], np.zeros(len(at), np.int32)
        active = np.searchsorted(-length[order], -np.arange(PIECE), side="left")  # pieces longer than each step
        for step in range(PIECE):
            m = active[step]
            if not m:
                break
            v = table[state[:m] * self.width + s[at[:m] + step]]
            count[:m] += v & 1
            state[:m] = v >> 1
        ends, counts = np.empty_like(state), np.empty_like(count)
        ends[order], counts[order] = state, count
        return counts, ends

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its symbols, and the phrases of its parse in each language (a row a text).

        Pieces of a text are parsed side by side, first as if each began a phrase. A piece whose predecessor ends in another
        state than it began with is parsed again from there, until every piece begins where the one before it ended. Parses
        fall into step within a few symbols, so two or three rounds do; what is left then is parsed in order, piece by piece.
        """
        s, size = self.symbols(texts)
        begin = np.cumsum(size) - size
        pieces = -(-size // PIECE)
        of = np.repeat(np.arange(len(texts)), pieces)
        at = begin[of] + PIECE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(PIECE, begin[of] + size[of] - at)
        later = np.flatnonzero(at != begin[of])  # pieces with one before them
        out = np.zeros((len(texts), len(self.names)))
        for k, table in enumerate(self.tables):
            start = np.zeros(len(of), np.int32)
            count, end = self.walk(table, s, at, length, start)
            for _ in range(ROUNDS):
                todo = later[start[later] != end[later - 1]]
                if not len(todo):
                    break
                start[todo] = end[todo - 1]
                count[todo], end[todo] = self.walk(table, s, at[todo], length[todo], start[todo])
            else:
                plain, symbols, width = memoryview(table), memoryview(s), self.width
                for i in later[start[later] != end[later - 1]].tolist():
                    while i < len(of) and at[i] != begin[of[i]] and start[i] != end[i - 1]:
                        state, n = int(end[i - 1]), 0
                        start[i] = state
                        for c in symbols[int(at[i]) : int(at[i] + length[i])]:
                            v = plain[state * width + c]
                            n += v & 1
                            state = v >> 1
                        count[i], end[i] = n, state
                        i += 1
            out[:, k] = np.bincount(of, count, len(texts)) + 1  # and the phrase that a text ends with
        return size, out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def separated(s: np.ndarray) -> np.ndarray:
    """One 0 for each run of them."""
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def learn(docs: DataFrame, folds: int = 4, held_out: int = 2) -> dict[str, str]:
    """A sample of labelled text per language, outside the held-out fold: whole texts in the order of a hash of id and text.

    Bounded by SAMPLE_CHARS and SAMPLE_ROWS for each language; texts over half of SAMPLE_CHARS are not drawn, repeated rows
    count once. A language whose texts have no letter is not learnt.
    """
    ours = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (common.crc_of_id() % folds != held_out) & F.length("text").between(1, SAMPLE_CHARS // 2) & F.col("text").rlike(r"\p{L}"))
    # hashes first, so that sorting moves no text; of repeated rows one is drawn among
    ours = ours.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit(3)))
    drawn = common.first_of_each(ours.select("lang", "h").distinct(), "lang", SAMPLE_ROWS, tie="h")
    texts = ours.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    running = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    rows = texts.withColumn("upto", F.sum(F.length("text")).over(running)).filter(F.col("upto") <= SAMPLE_CHARS).orderBy("lang", "upto").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


def _predict(samples):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = tuple(sorted(samples.items()))
        if hash(key) not in _models:
            _models.clear()
            _models[hash(key)] = Parser(samples) if samples else None
        parser = _models[hash(key)]
        for batch in batches:
            texts = [t or "" for t in batch.tolist()]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            lo = 0
            while parser and lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= BATCH_CHARS:
                    size += len(texts[hi])
                    hi += 1
                sizes, found = parser.phrases(texts[lo:hi])
                cost = found * np.array(parser.bits) / np.maximum(sizes, 1)[:, None]
                best = cost.argmin(1)  # ties: the first by name
                first = cost[np.arange(len(best)), best]
                cost[np.arange(len(best)), best] = np.inf
                second = cost.min(1)
                for i in range(lo, hi):
                    if letters()[points(texts[i])].any():
                        k = i - lo
                        pred[i] = parser.names[best[k]]
                        score[i] = 1.0 if np.isinf(second[k]) else float(second[k] / (first[k] + second[k]))
                lo = hi
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    score is the runner-up's share of the two least costs: 0.5 for a tie (which the first by name wins), near 1 for a clear case, 0 for `und`. A null text
    or one without a letter is `und`, as are all where no language could be learnt; rows with a null lang are predicted but
    not learnt from; null ids and repeated rows give a row each. Texts are parsed whole, and no text is shuffled.
    """
    common.short_batches(docs.sparkSession)
    return docs.select(
        "doc_id", (common.crc_of_id() % folds == held_out).alias("held_out"), F.pandas_udf(_predict(learn(docs, folds, held_out)), "lang_pred string, score double")(common.text_or_empty()).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
