"""Text functions of the question-answering pipeline as Spark columns: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The stop words of retrieval.
STOP = """a an the of to in on for and or is are was were be been by with as at from that this these those it its
what which who whom how why when where does do did should shall can could will would may might must about into than
there their they them his her he she we our you your i my me not no any all""".split()
# The stop words of facts.
FACT_STOP = """the a an and or of to in on for by with from as at is are be this that these those it its which what who
will can may should must also each every other than then into per not no any all their there here such has have had
was were been being if when where how does do done only more most some your you them they given give gives""".split()
# Phrases that tell a refusal, and the whole reply of one.
NOT_FOUND = "Not found in the guideline."
REFUSALS = ["not found in the guideline", "does not cover", "do not cover", "does not mention", "do not mention", "not covered", "no information", "not in the guideline", "not given", "not mentioned", "no mention", "do not contain", "does not contain", "not found in the fact sheets"]
# Patterns.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
LONG_REQUEST = r"(?i)\b(list|all|steps?|process|procedure|forms?|format|letters?|message|explain|describe|components?|responsibilit\w*|duties|contents?|roadmap|phases?)\b"
BULLET = r"(?m)^\s*(?:[-*•]|\d+[.)]|\|)"
CITATION = r"[\[【]\s*(\d+(?:\s*[,;–-]\s*\d+)*)\s*(?:†[^\]】]*)?[\]】]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])"
ABBREVIATION = r"(?i)(\b(?:No|Nos|e\.g|i\.e|Rs|Dr|Mr|Ms|Mrs|Smt|Shri|Sh|etc|viz|vs|Govt|Dept|Fig|approx|Sl|para)\.|\b[A-Za-z]\.)$"
FOLLOW_UP = r"(?i)\b(it|its|this|that|these|those|they|them|their|same|above|also)\b|^(and|or|what about|how about)\b"
PRIVATE = r"\S+@\S+|\+?\d[\d\s-]{6,}\d"
YEAR = r"^(19|20)\d\d(-\d\d)?$"
ALIASES = {"MP": "Madhya Pradesh", "UP": "Uttar Pradesh", "HP": "Himachal Pradesh", "AP": "Andhra Pradesh", "TN": "Tamil Nadu", "WB": "West Bengal", "ICU": "intensive care unit"}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def normalise(x) -> Column:
    """Lower case, one kind of dash and quote, single spaces, no space at the ends."""
    plain = F.translate(F.lower(_col(x)), "’‘“”‐‑‒–—―−", "''\"\"-------")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def typography(x) -> Column:
    """Typographic characters replaced by plain ones, bullets by dashes, runs of spaces by one."""
    c = F.regexp_replace(_col(x), r"^\s*•\s*", "- ")
    c = F.replace(F.translate(c, "•’‘“”–— ​", "-''\"\"-- "), F.lit("√"), F.lit("Yes"))
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


def terms(x) -> Column:
    """Lower-cased letter-and-digit runs without stop words, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(_col(x)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOP))


def sentences(x) -> Column:
    """Sentences; a cut after an abbreviation or an initial is taken back."""
    parts = F.split(F.trim(_col(x)), SENTENCE_END)
    glued = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((F.size(out) > 0) & F.element_at(out, -1).rlike(ABBREVIATION), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), p)))).otherwise(F.array_append(out, p)),
    )
    return F.filter(glued, lambda s: s != "")


def packed_words(x, size: int) -> Column:
    """Words joined greedily into pieces of at most size characters; a longer word is a piece of its own."""
    words = F.filter(F.split(_col(x), r"\s+"), lambda w: w != "")
    fits = lambda out, w: (F.size(out) > 0) & (F.length(F.element_at(out, -1)) + 1 + F.length(w) <= size)
    return F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda out, w: F.when(fits(out, w), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), w)))).otherwise(F.array_append(out, w)),
    )


def char_pieces(x, size: int, overlap: int = 0) -> Column:
    """Pieces of size characters, each starting size - overlap after the one before."""
    c = _col(x)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size - overlap)), lambda s: F.substring(c, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def word_pieces(x, size: int, overlap: int = 0) -> Column:
    """Pieces of size words, each with the last overlap words of the piece before in front."""
    words = F.filter(F.split(_col(x), r"\s+"), lambda w: w != "")
    start = lambda s: F.greatest(s - overlap, F.lit(1))
    pieces = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(size)), lambda s: F.array_join(F.slice(words, start(s), s + size - start(s)), " "))
    return F.when(F.size(words) > 0, pieces).otherwise(F.array().cast("array<string>"))


def numbers(x) -> Column:
    """Distinct numbers of at least two characters, without thousands separators."""
    joined = F.regexp_replace(_col(x), "(?<=\\d)[\\s   ](?=\\d{3}\\b)", "")
    found = F.transform(F.regexp_extract_all(joined, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(found, lambda n: F.length(n) >= 2))


def key_words(x) -> Column:
    """Distinct words of at least four letters that are no stop words, cut to six letters."""
    words = F.regexp_extract_all(F.lower(_col(x)), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(FACT_STOP)), lambda w: F.left(w, F.lit(6))))


def facts(x) -> Column:
    """Pieces of an expected answer that hold a key word or a number."""
    parts = F.transform(F.split(_col(x), r";|:|\.\s|\s-\s|\(\d\)"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.size(key_words(p)) > 0) | (F.size(numbers(p)) > 0))


def fact_found(fact, words: Column, nums: Column) -> Column:
    """At least half of the fact's key words (one at least) and all of its numbers are among words and nums."""
    wanted = key_words(fact)
    some = F.size(F.array_intersect(wanted, words)) >= F.greatest(F.lit(1.0), F.size(wanted) / 2)
    return ((F.size(wanted) == 0) | some) & (F.size(F.array_except(numbers(fact), nums)) == 0)


def refused(answer, action=None) -> Column:
    """A gate's reply, the not-found text at an end, or a short reply around a refusal phrase."""
    text = F.lower(F.trim(_col(answer)))
    whole = NOT_FOUND.lower()
    short = (F.size(F.split(text, r"\s+")) <= 25) & F.exists(strings(REFUSALS), lambda p: F.contains(text, p))
    gate = F.coalesce(_col(action).isin("reject", "scoped"), F.lit(False)) if action is not None else F.lit(False)
    return gate | F.startswith(text, F.lit(whole)) | F.endswith(text, F.lit(whole)) | short


def answer_mode(question) -> Column:
    return F.when(_col(question).rlike(LONG_REQUEST), "long").otherwise("short")


def bullet_count(x) -> Column:
    return F.regexp_count(_col(x), F.lit(BULLET))


def citations(x) -> Column:
    """Cited source numbers in order; ranges are expanded."""
    groups = F.regexp_extract_all(_col(x), F.lit(CITATION), F.lit(1))
    pieces = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*")))
    ends = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    # an inverted range has no numbers
    some = F.filter(pieces, lambda p: F.element_at(ends(p), 1) <= F.element_at(ends(p), -1))
    return F.flatten(F.transform(some, lambda p: F.sequence(F.element_at(ends(p), 1), F.element_at(ends(p), -1))))


def without_citations(x) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(_col(x), CITATION, ""), r"\s+", " ")), r"\s+([.,;:!?])", "$1")


def first_sentence(x) -> Column:
    return F.element_at(F.split(_col(x), r"(?<=[.!?;])\s", 2), 1)


def masked(x, marker: str = "[hidden]") -> Column:
    """Mail addresses and phone-like numbers replaced."""
    return F.regexp_replace(_col(x), PRIVATE, marker)


def is_follow_up(message, has_turns) -> Column:
    return _col(has_turns) & ((F.size(F.split(F.trim(_col(message)), r"\s+")) <= 6) | _col(message).rlike(FOLLOW_UP))


def one_edit(a, b) -> Column:
    """One letter added, dropped or changed, or two neighbours swapped."""
    a, b = _col(a), _col(b)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.get(differ, 0)
    swapped = (F.length(a) == F.length(b)) & (F.size(differ) == 2) & (F.get(differ, 1) == first + 1) & (F.substring(a, first, F.lit(2)) == F.reverse(F.substring(b, first, F.lit(2))))
    return (F.levenshtein(a, b, 1) == 1) | F.coalesce(swapped, F.lit(False))


def replaced_words(x, mapping: dict[str, str]) -> Column:
    """Whole words replaced by a map: the text is cut into words and the rest, looked up and put together again."""
    pieces = F.regexp_extract_all(_col(x), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    table = F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def expanded_aliases(x) -> Column:
    return replaced_words(x, ALIASES)


def page_label(printed) -> Column:
    """Known printed pages joined, or a question mark."""
    return F.coalesce(F.nullif(F.array_join(F.filter(_col(printed), lambda p: p.isNotNull()), ", "), F.lit("")), F.lit("?"))


def longest_header(cell, headers) -> Column:
    """The longest header h for which the cell starts with "h:"."""
    found = F.filter(_col(headers), lambda h: F.startswith(_col(cell), F.concat(h, F.lit(":"))))
    return F.try_element_at(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(1))


def rendered_row(headers, cells) -> Column:
    """"header: value" joined by bars; columns without a name give the value alone, empty cells nothing."""
    pairs = F.zip_with(_col(headers), _col(cells), lambda h, c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(h.rlike(r"^col\d+$"), c).otherwise(F.concat(h, F.lit(": "), c)))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")
