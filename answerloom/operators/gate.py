"""Front end and gate: vocabulary, typing slips, strong parts of a question, evidence signals, grade and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import text as T
from answerloom.operators import retrieval as R
from answerloom.sources.tables import table

# The two limits of the best score.
LOWER, UPPER = -5.0, 0.0


def vocabulary(docs: DataFrame, pattern: str = "[a-z]+") -> DataFrame:
    """word, n: how often each lower-cased word occurs."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def deletions(word: Column) -> Column:
    """The word and all that one letter less makes of it: two words one edit apart share one of these."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), less))


def typo_matches(unknown: DataFrame, vocab: DataFrame, least: int = 5) -> DataFrame:
    """word, match: the most frequent vocabulary word one slip away (ties: the first by name); shorter words have none.

    Both sides are joined on the strings that one deletion makes of them, so no word is compared with the whole vocabulary.
    """
    asked = unknown.select("word").distinct().filter(F.length("word") >= least).select("word", F.explode(deletions(F.lower("word"))).alias("key"))
    known = vocab.select(F.col("word").alias("other"), "n", F.explode(deletions(F.col("word"))).alias("key"))
    pairs = asked.join(known, "key").filter(T.one_edit(F.lower("word"), "other")).select("word", "other", "n").distinct()
    return pairs.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("rare"), F.col("other").alias("match")))["match"].alias("match"))


def acronym_matches(unknown: DataFrame, acronyms: DataFrame) -> DataFrame:
    """word, match: the most frequent other acronym of the same letters."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    a = unknown.select("word").distinct().withColumn("key", letters(F.col("word")))
    b = acronyms.select(F.col("word").alias("other"), "n").withColumn("key", letters(F.col("other")))
    return a.join(b, "key").filter("word <> other").groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("rare"), F.col("other").alias("match")))["match"].alias("match"))


def strong_parts(questions: DataFrame, known: DataFrame, qid: str = "item_id", text: str = "text") -> DataFrame:
    """qid, part, kind: acronyms and capitalised unknown words are hard, other capitalised words within a sentence soft; numbers.

    known (word): words that count as English.
    """
    sentence = questions.select(qid, F.posexplode(F.split(F.trim(F.col(text)), r"(?<=[.?!])\s+")).alias("s", "sentence"))
    word = sentence.select(qid, F.posexplode(F.regexp_extract_all("sentence", F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))).alias("i", "part"))
    acronym = (F.col("part") == F.upper("part")) & (F.length("part") > 1)
    strong = word.withColumn("acronym", acronym).filter(F.col("acronym") | ((F.col("i") > 0) & F.col("part").rlike("^[A-Z]")))
    listed = known.select(F.col("word").alias("k")).distinct()
    kind = F.when(F.col("acronym") | F.col("k").isNull(), "hard").otherwise("soft")
    words = strong.join(listed, F.lower("part") == F.col("k"), "left").select(qid, "part", kind.alias("kind"))
    number = r"(?<![a-z0-9])\d+(?:-\d+)?(?![a-z0-9])"
    nums = questions.select(qid, F.explode(F.regexp_extract_all(T.normalise(text), F.lit(number), F.lit(0))).alias("part"), F.lit("number").alias("kind"))
    return words.unionByName(nums).distinct()


def signals(parts: DataFrame, hits: DataFrame, corpus: DataFrame, qid: str = "item_id") -> DataFrame:
    """qid, hard_out, soft_out, missing, best. hits: qid, text, score; corpus (term): all terms of the corpus.

    A part is out if the corpus lacks its term, missing if only the evidence does; of unknown numbers, those like a year are out.
    """
    evidence = hits.select(qid, F.explode(T.terms("text")).alias("term")).distinct().withColumn("in_evidence", F.lit(True))
    asked = parts.withColumn("term", F.explode(F.when(F.size(T.terms("part")) > 0, T.terms("part")).otherwise(F.array(F.lit("")))))
    seen = asked.join(evidence, [qid, "term"], "left").join(corpus.select("term").distinct().withColumn("in_corpus", F.lit(True)), "term", "left")
    per = seen.groupBy(qid, "part", "kind").agg(F.bool_and((F.col("term") == "") | F.coalesce("in_corpus", F.lit(False))).alias("corpus"), F.bool_and((F.col("term") == "") | F.coalesce("in_evidence", F.lit(False))).alias("evidence"))
    out = ~F.col("corpus") & ((F.col("kind") != "number") | F.col("part").rlike(T.YEAR))
    status = F.when(out, "out").when(F.col("corpus") & ~F.col("evidence"), "missing").otherwise("ok")
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("part"))))
    per = per.withColumn("status", status).groupBy(qid).agg(
        pick((F.col("status") == "out") & (F.col("kind") != "soft")).alias("hard_out"), pick((F.col("status") == "out") & (F.col("kind") == "soft")).alias("soft_out"), pick(F.col("status") == "missing").alias("missing")
    )
    best = hits.groupBy(qid).agg(F.bround(F.max("score"), 2).alias("best"))
    empty = F.array().cast("array<string>")
    return best.join(per, qid, "full").select(qid, F.coalesce("best", F.lit(-99.0)).alias("best"), *(F.coalesce(c, empty).alias(c) for c in ("hard_out", "soft_out", "missing")))


def grade() -> Column:
    """I: no evidence, M: something outside the corpus, P: partial, S: sound; compares the rounded best score."""
    return (
        F.when(F.col("best") < LOWER, "I").when(F.size("hard_out") > 0, "M").when((F.size("soft_out") > 0) | (F.size("missing") > 0) | (F.col("best") < UPPER), "P").otherwise("S")
    )


def action(m_action: str = "scoped") -> Column:
    g = F.col("grade")
    return F.when(g == "I", "reject").when((g == "M") & F.lit(m_action == "scoped"), "scoped").when(g == "P", "answer_with_note").otherwise("answer")


def notes(not_found: str = T.NOT_FOUND) -> Column:
    """Hints for partial evidence, one string each."""
    some = F.array(
        F.when(F.size("soft_out") > 0, F.concat(F.lit("Outside the sources: "), F.array_join("soft_out", ", "))),
        F.when(F.size("missing") > 0, F.concat(F.lit("Perhaps not in the sources: "), F.array_join("missing", ", "))),
        F.when(F.col("best") < UPPER, F.lit(f"Weak evidence; without a clear answer reply: {not_found}")),
    )
    return F.filter(some, lambda n: n.isNotNull())


def unknown_words(questions: DataFrame, known: DataFrame, qid: str, text: str) -> DataFrame:
    """qid, word: words neither known nor written as a name or an acronym; words of other scripts always count."""
    word = F.regexp_extract("m", "[A-Za-z]+(?:'[A-Za-z]+)?$", 0)
    starts = F.col("m").rlike(r"^[.?!]") | F.col("first")
    tokens = questions.select(qid, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[.?!]?\s*[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))).alias("i", "m")).withColumn("first", F.col("i") == 0).withColumn("word", word)
    kept = (F.col("word") == F.upper("word")) | (F.col("word").rlike("^[A-Z]") & ~starts)
    latin = tokens.filter((F.length("word") > 1) & ~F.contains("word", F.lit("'")) & ~kept).select(qid, "word")
    latin = latin.join(known.select(F.col("word").alias("k")), F.lower("word") == F.col("k"), "left_anti")
    other = questions.select(qid, F.explode(F.split(F.col(text), r"\s+")).alias("w")).filter(F.col("w").rlike(r"[^\x00-\x7F]") & F.col("w").rlike(r"[\p{L}\p{M}]"))
    return latin.unionByName(other.select(qid, F.regexp_replace("w", r"^[?.,!;:()\"']+|[?.,!;:()\"']+$", "").alias("word"))).distinct()


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word")
def vocab(spark, sf_dir):
    return vocabulary(table(spark, sf_dir, "documents"))


_SLIP = "CASE WHEN length(word) > 6 THEN left(word, 3) || substr(word, 5, 1) || substr(word, 4, 1) || substr(word, 6) ELSE left(word, 2) || substr(word, 4) END"


@query(f"""WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
u AS (SELECT DISTINCT {_SLIP} AS word FROM b WHERE length(word) >= 6),
p AS (SELECT u.word, v.word AS other, n FROM u JOIN v ON abs(length(u.word) - length(v.word)) <= 1 AND u.word <> v.word AND damerau_levenshtein(u.word, v.word) = 1 WHERE length(u.word) >= 5)
SELECT word, arg_min(other, (-n, other)) AS match FROM p GROUP BY word""")
def typo_fixes(spark, sf_dir):
    """Slips made of every longer benchmark word (two letters swapped or one dropped), and the word each one is a slip of."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct().filter("length(word) >= 6")
    slips = words.select(F.expr(_SLIP).alias("word"))
    return typo_matches(slips, vocabulary(table(spark, sf_dir, "documents")))


@query("""WITH a AS (SELECT upper(n_name) AS word, count(*) AS n FROM nation GROUP BY 1), u AS (SELECT DISTINCT reverse(upper(n_name)) AS word FROM nation)
SELECT u.word, arg_min(a.word, (-n, a.word)) AS match FROM u JOIN a ON list_sort(string_split(u.word, '')) = list_sort(string_split(a.word, '')) AND u.word <> a.word GROUP BY u.word""")
def anagram_typos(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    return acronym_matches(names.select(F.reverse(F.upper("n_name")).alias("word")), names.groupBy(F.upper("n_name").alias("word")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\b(UP)\\b', 'Uttar Pradesh', 'g'), '\\b(ICU)\\b', 'intensive care unit', 'g')) AS digest FROM (SELECT doc_id, 'In UP an ICU, not UPS: ' || lang || text AS text FROM documents)".replace("\\\\b", "\\b"))
def alias_expand(spark, sf_dir):
    """Short forms of states and wards written out; whole upper-case words only."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.expanded_aliases(F.concat(F.lit("In UP an ICU, not UPS: "), "lang", "text"))).alias("digest"))


@query(f"""WITH {R.BM25_SQL}, h AS (SELECT item_id, max(round(20 * len(list_intersect(list_distinct({R._TERMS.format('b.text')}), {R._TERMS.format('d.text')})) / len(list_distinct({R._TERMS.format('b.text')})) - 10, 4)) AS best FROM bm JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 5 GROUP BY item_id),
ev AS (SELECT DISTINCT item_id, unnest({R._TERMS.format('d.text')}) AS term FROM bm JOIN documents d USING (doc_id) WHERE rank <= 5),
corpus AS (SELECT DISTINCT unnest(terms) AS term FROM per),
w AS (SELECT DISTINCT item_id, lower(p) AS term FROM (SELECT item_id, unnest(list_slice(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*'), 2, NULL)) AS p FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(trim(text), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark)) WHERE regexp_matches(p, '^[A-Z]') AND upper(p) <> p),
st AS (SELECT item_id, count(*) FILTER (c.term IS NULL AND w.term NOT IN ({R.STOPS})) AS n_out, count(*) FILTER (c.term IS NOT NULL AND e.term IS NULL) AS n_missing FROM w LEFT JOIN corpus c USING (term) LEFT JOIN ev e USING (item_id, term) GROUP BY item_id)
SELECT item_id, best, CASE WHEN best < -5 THEN 'I' WHEN coalesce(n_out, 0) > 0 THEN 'P' WHEN coalesce(n_missing, 0) > 0 OR best < 0 THEN 'P' ELSE 'S' END AS grade,
CASE WHEN best < -5 THEN 'reject' WHEN coalesce(n_out, 0) > 0 OR coalesce(n_missing, 0) > 0 OR best < 0 THEN 'answer_with_note' ELSE 'answer' END AS action FROM (SELECT item_id, round_even(best, 2) AS best FROM h) LEFT JOIN st USING (item_id)""")
def gate_grade(spark, sf_dir):
    """Every benchmark item graded on its five best documents; all its capitalised words count as English here."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = R.bm25(R.index_of(spark, sf_dir), asked).join(docs.select("doc_id", "text"), "doc_id").join(asked.select("item_id", F.col("text").alias("question")), "item_id")
    hits = hits.select("item_id", "text", R.coverage(F.col("question"), F.col("text")).alias("score"))
    english = asked.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9]*"), F.lit(0))).alias("word")).distinct()
    corpus = R.index_of(spark, sf_dir).terms.select("term")
    parts = strong_parts(asked, english).filter("kind = 'soft'")
    graded = signals(parts, hits, corpus).withColumn("grade", grade())
    return graded.select("item_id", "best", "grade", action().alias("action"))


@query()
def gate_signals(spark, sf_dir):
    """Signals with the words of the corpus as the known ones (held against a plain version in the tests)."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = R.bm25(R.index_of(spark, sf_dir), asked).join(docs.select("doc_id", "text"), "doc_id").select("item_id", "text", "score")
    corpus = R.index_of(spark, sf_dir).terms.select("term")
    graded = signals(strong_parts(asked, corpus.withColumnRenamed("term", "word")), hits, corpus).withColumn("grade", grade())
    return graded.withColumn("action", action()).withColumn("notes", notes())


@query()
def unknown(spark, sf_dir):
    """Unknown words of every user turn, against the vocabulary of the English documents."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return unknown_words(turns, vocabulary(table(spark, sf_dir, "documents")), "turn_id", "text")


@query("""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '\\S+@\\S+', '[hidden]', 'g'), '\\+?\\d[\\d\\s-]{6,}\\d', '[hidden]', 'g')) AS digest FROM conversations""".replace("\\\\", "\\"))
def privacy_mask(spark, sf_dir):
    once = T.masked("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(once).alias("digest"))


@query("""SELECT conv_id, turn, turn > min(turn) OVER (PARTITION BY conv_id) AND (len(regexp_split_to_array(trim(text), '\\s+')) <= 6 OR regexp_matches(text, '(?i)\\b(it|its|this|that|these|those|they|them|their|same|above|also)\\b|^(and|or|what about|how about)\\b')) AS follow_up FROM conversations WHERE role = 'user'""".replace("\\\\", "\\"))
def follow_up(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    later = F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id"))
    return turns.withColumn("later", later).select("conv_id", "turn", T.is_follow_up("text", "later").alias("follow_up"))


@query("""SELECT conv_id, turn, string_agg(text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations""")
def chat_history(spark, sf_dir):
    """The three turns before each one."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    some = F.collect_list("text").over(order)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(some) > 0, F.array_join(some, " / ")).alias("history"))
