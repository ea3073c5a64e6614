"""Vectorised functions for what built-in expressions cannot say: similarity of words, longest common subsequence, stems."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F


def _rouge_l(answer: pd.Series, expected: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of words."""

    def score(a, b):
        a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (a, b))
        if not a or not b:
            return 0.0
        # bit-parallel: one big integer holds a whole row of the table
        at: dict[str, int] = {}
        for i, w in enumerate(a):
            at[w] = at.get(w, 0) | 1 << i
        row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
        for w in b:
            hit = row & at.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        n = len(a) - row.bit_count()
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([score(a, b) for a, b in zip(answer, expected, strict=True)])


def _bleu(answer: pd.Series, expected: pd.Series) -> pd.Series:
    """Sentence BLEU up to four words with exponential smoothing and brevity penalty, 0 to 1."""

    def score(a, b):
        a, b = (re.findall(r"\w+|[^\w\s]", x or "") for x in (a, b))
        if not a or not b:
            return 0.0
        logs, smooth = [], 1.0
        for n in range(1, 5):
            mine = Counter(zip(*(a[i:] for i in range(n)), strict=False))
            theirs = Counter(zip(*(b[i:] for i in range(n)), strict=False))
            total, hit = sum(mine.values()), sum((mine & theirs).values())
            if not total:
                break
            if not hit:
                smooth *= 2
            logs.append(math.log(hit / total if hit else 1 / (smooth * total)))
        return min(1.0, math.exp(min(0.0, 1 - len(b) / len(a)) + sum(logs) / len(logs)))

    return pd.Series([score(a, b) for a, b in zip(answer, expected, strict=True)])


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two words, 0 to 1; apply it to distinct words only."""
    match = difflib.SequenceMatcher(autojunk=False)
    out = []
    for x, y in zip(a, b, strict=True):
        match.set_seqs(x or "", y or "")
        out.append(match.ratio())
    return pd.Series(out)


def _word_fixes(typed: pd.Series, meant: pd.Series) -> pd.Series:
    """Words that were replaced one for one between two texts."""

    def fixes(a, b):
        a, b = (a or "").split(), (b or "").split()
        return [{"old": x, "new": y} for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag == "replace" and j - i == m - k for x, y in zip(a[i:j], b[k:m], strict=True)]

    return pd.Series([fixes(a, b) for a, b in zip(typed, meant, strict=True)])


# The published English stemmer's lists.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", fulli="ful", lessli="less")
_STEP3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
_WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl", sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes")
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_REGION = re.compile(r".*?[aeiouy][^aeiouy]")


def stem(word: str) -> str:
    """The published English (Porter 2) stem of a lower-case word."""
    if word in _WHOLE or len(word) < 3:
        return _WHOLE.get(word, word)
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        first = m.end() if (m := _REGION.match(w)) else len(w)
    second = m.end() if (m := _REGION.match(w, first)) else len(w)
    vowel = lambda x: re.search("[aeiouy]", x) is not None

    def short(x: str) -> bool:
        return first >= len(x) and (re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", x) is not None)

    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if ending in ("eed", "eedly"):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= first else w
    elif ending and vowel(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    def replaced(x: str, table: dict, more) -> str:
        for size in range(7, 1, -1):
            end = x[-size:] if len(x) >= size else ""
            if end in table or end in more:
                if len(x) - size < first:
                    return x
                return more[end](x) if end in more else x[:-size] + table[end]
        return x

    w = replaced(w, _STEP2, {"ogi": lambda x: x[:-1] if x[-4:-3] == "l" else x, "li": lambda x: x[:-2] if x[-3:-2] in tuple("cdeghkmnrt") else x})
    w = replaced(w, _STEP3, {"ative": lambda x: x[:-5] if len(x) - 5 >= second else x})
    for end in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= second and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda x: stem(x) if x is not None else None)


# made when called: a worker that imports this module has no session to read a type with
def rouge_l(answer, expected):
    """F-measure of the longest common subsequence of words."""
    return F.pandas_udf(_rouge_l, "double")(answer, expected)


def bleu(answer, expected):
    """Sentence BLEU up to four words, 0 to 1."""
    return F.pandas_udf(_bleu, "double")(answer, expected)


def similarity(a, b):
    """Ratio of matching blocks of two words, 0 to 1."""
    return F.pandas_udf(_similarity, "double")(a, b)


def word_fixes(typed, meant):
    """Words replaced one for one between two texts."""
    return F.pandas_udf(_word_fixes, "array<struct<old:string,new:string>>")(typed, meant)


def stems(word):
    """The English stem of a lower-case word; apply it to distinct words only."""
    return F.pandas_udf(_stems, "string")(word)
