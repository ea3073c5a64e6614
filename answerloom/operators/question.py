"""The way of a question: spelling, names, first evidence, grade, second search, action, context, prompt; and older gates.

Everything up to the prompt is one plan over a table of questions (item_id, text); no model is called. Rewriting and clarifying
by a model are columns that a provider fills in, with the rules that decide on them here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import arrow, text as T
from answerloom.operators import gate as G, prompts as P, retrieval as R
from answerloom.sources.shared import open_or_build, save
from answerloom.sources.tables import table

# The shortest word that is corrected, and the least likeness of its correction.
LEAST_LETTERS, LIKENESS = 4, 0.8
# How far below the best a hit still counts as close, from how many units a question is vague, words of a short one.
SPREAD, UNITS, SHORT = 3.0, 3, 6
# Fixed value: hits that each form of a question gets in the second search.
POOL = 10
_PIECES = "[A-Za-z]+|[^A-Za-z]+"


#: Words of the vocabulary, and words asked for, whose shared bigrams are one matrix product.
KNOWN, ASKED = 4096, 1024


def _near_words(asked):
    """Pairs of a word of asked.value and one of the vocabulary that may be alike, by their lengths and shared bigrams."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for start in range(0, len(asked.value), ASKED):
            words, number = asked.value[start : start + ASKED], {}
            places = [(number.setdefault(w[i : i + 2], len(number)), k) for k, w in enumerate(words) for i in range(len(w) - 1)]
            grams = np.zeros((len(number), len(words)), np.float32)
            np.add.at(grams, tuple(np.array(places).T), 1)
            blocks.append((words, pa.array(list(number), pa.string()), grams, np.array([len(w) for w in words])))
        for whole in batches:
            for start in range(0, whole.num_rows, KNOWN):
                known = whole.column(0).slice(start, KNOWN)
                for words, grams, wanted, sizes in blocks:
                    # a word more than one and a half times as long is never alike
                    known_here = known.filter(pc.less_equal(pc.utf8_length(known), int(1.5 * sizes.max())))
                    length = pc.utf8_length(known_here).to_numpy(zero_copy_only=False)
                    has = np.zeros((len(length), len(grams)), np.float32)
                    for i in range(max(length, default=1) - 1):
                        at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(known_here, i, i + 2), grams), -1).to_numpy(zero_copy_only=False)
                        rows = np.flatnonzero(at >= 0)
                        has[rows, at[rows]] += 1
                    shared, n = has @ wanted, length[:, None] + sizes[None, :]
                    other, word = np.nonzero((shared >= 1) & (shared >= 0.2 * n - 1) & (np.minimum(length[:, None], sizes[None, :]) >= 0.4 * n))
                    yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in word], pa.string()), known_here.take(pa.array(other, pa.int64()))], ["word", "other"])

    return near


def word_fixes(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, match: the word of the vocabulary most like each word (ratio of matching blocks of 0.8 at least; ties: the greatest).

    words and vocab are distinct and lower case. Of n + m letters, two words so alike share 0.4 * (n + m) in blocks with at most
    0.2 * (n + m) letters between them, and so 0.2 * (n + m) - 1 bigrams. The words, which come from questions, are sent to the
    tasks; the vocabulary is counted against them where it lies, and few pairs are compared.
    """
    asked = [r.word for r in words.filter(F.length("word") >= LEAST_LETTERS).select("word").collect()]
    sent = words.sparkSession.sparkContext.broadcast(asked)
    near = vocab.filter(F.length("word") >= 3).select("word").mapInArrow(_near_words(sent), "word string, other string")
    # letters outside the blocks, at most 0.2 * (n + m), are as many insertions and deletions
    near = near.filter(F.levenshtein("word", "other") <= 0.2 * (F.length("word") + F.length("other")))
    scored = near.withColumn("ratio", arrow.similarity(F.col("other"), F.col("word"))).filter(F.col("ratio") >= LIKENESS)
    return scored.groupBy("word").agg(F.max(F.struct("ratio", "other"))["other"].alias("match"))


def fixed_questions(questions: DataFrame, vocab: DataFrame, english: DataFrame, qid: str = "item_id") -> DataFrame:
    """questions with fixed and changes (old, new): words that neither the corpus nor English knows, made like one of the corpus.

    Short words, all capitals and capitalised words after the first stay. vocab and english have a column word, in lower case.
    """
    pieces = questions.select(qid, F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))).alias("i", "p"))
    first = F.min(F.when(F.col("p").rlike("^[A-Za-z]"), F.col("i"))).over(Window.partitionBy(qid))
    low = F.lower("p")
    asks = F.col("p").rlike("^[A-Za-z]") & (F.length("p") >= LEAST_LETTERS) & (F.col("p") != F.upper("p")) & (~F.col("p").rlike("^[A-Z]") | (F.col("i") == first))
    pieces = pieces.withColumns({"low": low, "asks": asks})
    known = vocab.select("word").unionByName(english.select("word")).distinct()
    unknown = pieces.filter("asks").select(F.col("low").alias("word")).distinct().join(known, "word", "left_anti")
    fixes = word_fixes(unknown, vocab.select("word").distinct())
    both = pieces.join(fixes, pieces["low"] == fixes["word"], "left")
    new = F.when(F.col("asks") & F.col("match").isNotNull(), F.when(F.col("p").rlike("^[A-Z]"), F.initcap("match")).otherwise(F.col("match"))).otherwise(F.col("p"))
    both = both.withColumn("new", new)
    out = both.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), "").alias("fixed"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("new") != F.col("p"), F.struct("i", F.col("p").alias("old"), "new")))), lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new"))).alias("changes"),
    )
    return questions.join(out, qid, "left").withColumns({"fixed": F.coalesce("fixed", "text"), "changes": F.coalesce("changes", F.array().cast("array<struct<old:string,new:string>>"))})


def corrected_names(questions: DataFrame, corpus: DataFrame, counts: DataFrame, acronyms: DataFrame, english: DataFrame, qid: str = "item_id", text: str = "fixed") -> DataFrame:
    """questions with `text` corrected: hard words that the corpus lacks and that are a slip of one of its words.

    corpus (term), counts (word, n), acronyms (word, n), english (word).
    """
    parts = G.strong_parts(questions, english, qid, text).filter("kind = 'hard'").select("part").distinct()
    terms = parts.select("part", F.explode_outer(T.terms("part")).alias("term"))
    lacking = terms.join(corpus.select("term").distinct().withColumn("in", F.lit(True)), "term", "left").groupBy("part").agg(F.count_if(F.col("term").isNotNull() & F.col("in").isNull()).alias("n")).filter("n > 0").select(F.col("part").alias("word"))
    capitals = F.col("word") == F.upper("word")
    fixes = G.acronym_matches(lacking.filter(capitals), acronyms).unionByName(G.typo_matches(lacking.filter(~capitals), counts))
    pieces = questions.select(qid, F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))).alias("i", "p"))
    both = pieces.join(fixes, F.col("p") == F.col("word"), "left").withColumn("new", F.coalesce("match", "p"))
    out = both.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), "").alias("aw_new"))
    return questions.join(out, qid, "left").withColumn(text, F.coalesce("aw_new", text)).drop("aw_new")


def rewrite_needed(front_end: str, unknown: Column) -> Column:
    """Whether a question goes to the model that rewrites: never, always, or where it has an unknown word."""
    if front_end not in ("spellfixer", "rewrite", "rewrite_if_unknown"):
        raise ValueError(f"unknown front end {front_end!r}")
    return F.lit(front_end == "rewrite") if front_end != "rewrite_if_unknown" else F.coalesce(F.size(unknown) > 0, F.lit(False))


def accepted_rewrite(message: Column, reply: Column) -> Column:
    """A standalone question from a reply's first line, if its length is in bounds, else the message as it is."""
    line = F.trim(F.regexp_replace(F.trim(F.get(F.split(F.trim(F.coalesce(reply, F.lit(""))), "\n"), 0)), '^"+|"+$', ""))
    return F.when(F.length(line).between(3, 4 * F.length(message) + 200), line).otherwise(message)


def clarifying_question(reply: Column) -> Column:
    return F.trim(F.regexp_extract(reply, r"ASK:\s*(.+)", 1))


def looks_vague(hits: Column, best: Column, grade: Column, question: Column) -> Column:
    """Whether close hits come from many units, where the evidence is partial or the question short; hits: (unit, score)."""
    units = F.array_distinct(F.transform(F.filter(hits, lambda h: h["score"] >= best - SPREAD), lambda h: h["unit"]))
    return ((grade == "P") | (F.size(F.filter(F.split(question, r"\s+"), lambda w: w != "")) <= SHORT)) & (F.size(units) >= UNITS)


def variants(questions: DataFrame, signals: DataFrame, qid: str = "item_id", text: str = "fixed") -> DataFrame:
    """qid, v, text: a question as it is, its words without stop words, and those after what the evidence lacks."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9-]*"), F.lit(0)), lambda w: ~F.lower(w).isin(T.STOP))
    key = F.array_join(words, " ")
    three = F.array(F.struct(F.lit(0).alias("v"), F.col(text).alias("text")), F.struct(F.lit(1).alias("v"), key.alias("text")), F.struct(F.lit(2).alias("v"), F.when(F.size("missing") > 0, F.concat(F.array_join("missing", " "), F.lit(" "), key)).alias("text")))
    return questions.select(qid, text).join(signals.select(qid, "missing"), qid).select(qid, F.inline(three)).filter("text is not null")


def re_retrieved(forms: DataFrame, search, scores, k: int = 5, qid: str = "item_id", key: str = "doc_id") -> DataFrame:
    """qid, key, score, rank: ten hits of every form of a question, each once, scored anew against the question itself.

    search(table of qid, text) gives ranked hits (qid, key, rank); scores(pairs) adds score.
    """
    asked = forms.withColumn(qid, F.struct(qid, "v"))
    hits = search(asked).filter(F.col("rank") <= POOL).select(F.col(f"{qid}.{qid}").alias(qid), key, F.struct(f"{qid}.v", "rank").alias("seen"))
    pairs = hits.groupBy(qid, key).agg(F.min("seen").alias("seen"))
    order = Window.partitionBy(qid).orderBy(F.desc("score"), "seen")
    return scores(pairs).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(qid, key, "score", "rank")


def answer_source(answer: Column, best: Column) -> Column:
    """The first gate: too low a score is not found by the gate, a reply that begins so by the model."""
    return F.when(best < G.LOWER, "not found by gate").when(F.startswith(answer, F.lit("Not found")), "not found by llm").otherwise("answered")


def zone_action(best: Column, outside: Column, missing: Column) -> Column:
    """The gate of zones: (zone, action) by the best score and the parts outside the corpus or the evidence."""
    zone = F.when(best < G.LOWER, "incorrect").when(best < G.UPPER, "ambiguous").otherwise("correct")
    action = F.when(best < G.LOWER, "not_found").when(F.size(outside) > 0, "out_of_scope").when(F.size(missing) > 0, "missing_in_evidence").otherwise("answer")
    return F.struct(zone.alias("zone"), action.alias("action"))


def idf_coverage(questions: DataFrame, hits: DataFrame, index: R.Index, qid: str = "item_id", text: str = "text") -> DataFrame:
    """qid, coverage (2 places): the share of a question's terms, weighed by their rarity, that its hits (qid, text) hold."""
    asked = questions.select(qid, F.explode(F.array_distinct(T.terms(text))).alias("term"))
    idf = index.with_idf(index.terms.join(asked.select("term").distinct(), "term", "left_semi")).select("term", "idf")
    held = hits.select(qid, F.explode(T.terms("text")).alias("term")).distinct().withColumn("held", F.lit(True))
    rows = asked.join(idf, "term").join(held, [qid, "term"], "left")
    share = rows.groupBy(qid).agg(F.round(F.try_divide(F.sum(F.when(F.col("held"), F.col("idf")).otherwise(0.0)), F.sum("idf")), 2).alias("coverage"))
    return questions.select(qid).join(share, qid, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def coverage_grade(least: float = 0.6) -> Column:
    """The gate of coverage, over best, out_of_corpus, missing and coverage."""
    return F.when(F.col("best") < G.LOWER, "I").when(F.size("out_of_corpus") > 0, "M").when((F.size("missing") > 0) | (F.col("coverage") < least) | (F.col("best") < G.UPPER), "P").otherwise("S")


def with_slips(questions: DataFrame, rate: float = 0.4, seed: int = 0, qid: str = "item_id") -> DataFrame:
    """questions with noisy: a share of the words of five letters and more misspelt, the same at every run.

    A hash of seed, question and place decides which word, where, and how: a letter dropped, two swapped, one doubled, or a
    vowel put in its place.
    """
    h = lambda k, w, i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "aw_q", w, i.cast("string"), F.lit(k))), 1, 7), 16, 10).cast("long")

    def slip(w: Column, i: Column) -> Column:
        at = (h("at", w, i) % (F.length(w) - 2) + 2).cast("int")  # from the second letter to the last but one
        head, letter, after, rest = F.left(w, at - 1), F.substring(w, at, F.lit(1)), F.substring(w, at + 1, F.lit(1)), F.substring(w, at + 1, F.length(w))
        how = h("how", w, i) % 4
        vowel = F.substring(F.lit("aeiou"), (h("vowel", w, i) % 5 + 1).cast("int"), F.lit(1))
        changed = F.when(how == 0, F.concat(head, rest)).when(how == 1, F.concat(head, after, letter, F.substring(w, at + 2, F.length(w)))).when(how == 2, F.concat(head, letter, letter, rest)).otherwise(F.concat(head, vowel, rest))
        return F.when(w.rlike("^[A-Za-z]{5,}$") & (h("which", w, i) % 1000 < rate * 1000), changed).otherwise(w)

    pieces = F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))
    return questions.withColumn("aw_q", F.md5("text")).withColumn("noisy", F.array_join(F.transform(pieces, slip), "")).drop("aw_q")


def prepared(questions: DataFrame, index: R.Index, docs: DataFrame, vocab: DataFrame, english: DataFrame, acronyms: DataFrame, scores, m_action: str = "scoped", re_retrieve: bool = True) -> DataFrame:
    """All before the model: item_id, fixed, changes, first, final, best, action, hits, notes, fixed_answer, error.

    questions: item_id, text and, where a model gave one, rewrite, which takes the place of the spelling step. Hits are ids in
    order. A question that cannot be prepared (a null text) keeps its row with an error.
    """
    sound = questions.filter("text is not null")
    if "rewrite" in questions.columns:
        fixed = fixed_questions(sound, vocab, english).withColumn("changes", F.when(F.col("rewrite").isNull(), F.col("changes"))).withColumn("fixed", F.coalesce("rewrite", "fixed"))
    else:
        fixed = fixed_questions(sound, vocab, english)
    corpus = index.terms.select("term")
    fixed = save(corrected_names(fixed.withColumn("fixed", T.expanded_aliases("fixed")), corpus, vocab, acronyms, english), "fixed")
    search = lambda asked: R.bm25(index, asked, POOL)
    asked = fixed.select("item_id", F.col("fixed").alias("text"))
    parts = save(G.strong_parts(asked, english), "parts")

    def graded(hits: DataFrame) -> DataFrame:
        evidence = hits.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "text", "score")
        return G.signals(parts, evidence, corpus).join(asked.select("item_id"), "item_id", "right").na.fill({"best": -99.0}).withColumn("grade", G.grade())

    pairs = search(asked).filter("rank <= 5")
    first_hits = scores(pairs.select("item_id", "doc_id", F.col("rank").alias("seen"))).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "seen"))).select("item_id", "doc_id", "score", "rank")
    # each step is written, as later ones read it more than once
    first_hits = save(first_hits, "hits")
    first = save(graded(first_hits), "graded")
    out = first.withColumn("first", F.col("grade"))
    hits = first_hits
    if re_retrieve:
        partial = first.filter("grade = 'P'")
        again = save(re_retrieved(variants(fixed.join(partial.select("item_id"), "item_id", "left_semi"), partial), search, scores), "again")
        second = graded(again).join(partial.select("item_id"), "item_id", "left_semi")
        out = first.filter("grade <> 'P'").withColumn("first", F.col("grade")).unionByName(second.withColumn("first", F.lit("P")))
        hits = first_hits.join(partial.select("item_id"), "item_id", "left_anti").unionByName(again)
    ids = hits.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("hits"))
    out = out.withColumnRenamed("grade", "final").withColumn("grade", F.col("final")).withColumns({"action": G.action(m_action), "notes": F.when(F.col("final") == "P", G.notes()).otherwise(F.array().cast("array<string>"))})
    fixed_answer = F.when(F.col("action") == "reject", T.NOT_FOUND).when(F.col("action") == "scoped", F.concat(F.lit("The sources do not cover "), F.array_join("hard_out", ", "), F.lit("."))).otherwise("")
    rows = fixed.select("item_id", "fixed", "changes").join(out, "item_id").join(ids, "item_id", "left")
    rows = rows.select("item_id", "fixed", F.size("changes").alias("n_changes"), "first", "final", "best", "action", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"), "notes", fixed_answer.alias("fixed_answer"), F.lit(None).cast("string").alias("error"))
    broken = questions.filter("text is null").select("item_id", F.lit("no question").alias("error"))
    return rows.unionByName(broken, allowMissingColumns=True)


# ---- queries

_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def _vocab(spark, sf_dir) -> DataFrame:
    return open_or_build(spark, "vocabulary", [f"{sf_dir}/documents.parquet"], lambda: G.vocabulary(table(spark, sf_dir, "documents")))


@query()
def spelling_fixes(spark, sf_dir):
    """Misspelt words of every item and their fix: the most alike word of the corpus (held against a plain version in the tests)."""
    asked = with_slips(table(spark, sf_dir, "benchmark")).select("item_id", F.col("noisy").alias("text"))
    words = asked.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    vocab = _vocab(spark, sf_dir)
    return word_fixes(words.join(vocab, "word", "left_anti"), vocab.select("word"))


@query()
def question_fixes(spark, sf_dir):
    """Every misspelt item with its words fixed (held against a plain version in the tests)."""
    asked = with_slips(table(spark, sf_dir, "benchmark")).select("item_id", F.col("noisy").alias("text"))
    vocab = _vocab(spark, sf_dir)
    return fixed_questions(asked, vocab, vocab.limit(0)).select("item_id", "fixed", F.size("changes").alias("n_changes"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), f AS (SELECT w, length(w) AS n FROM w WHERE length(w) >= 6)
SELECT CAST(row_number() OVER (ORDER BY w) AS INT) AS item_id, 'we met ' || upper(left(w, 1)) || substr(w, 2) || ' today' AS was, 'we met ' || w || ' today' AS fixed FROM f""")
def name_corrections(spark, sf_dir):
    """A slip in a capitalised word, which the corpus of just that one word lacks, is put right; one deleted letter each."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct().filter("length(w) >= 6")
    words = words.withColumn("item_id", F.row_number().over(Window.orderBy("w")))
    # each word gets letters of its own in front, so that no two words are neighbours
    mark = F.concat(F.lit("q"), F.translate(F.lpad(F.conv(F.col("item_id").cast("string"), 10, 7), 5, "0"), "0123456", "ghjkvwx"))
    mark = F.concat(mark, mark)
    word = F.concat(mark, "w")
    slip = F.concat(F.lit("Q"), F.expr("substring(word, 2, length(word) - 2)"))
    rows = words.withColumn("word", word).withColumn("fixed", F.concat(F.lit("we met "), slip, F.lit(" today")))
    corpus = rows.select(F.col("word").alias("term"))
    out = corrected_names(rows, corpus, rows.select("word", F.lit(1).cast("long").alias("n")), rows.select("word", F.lit(1).cast("long").alias("n")).limit(0), rows.select("word"))
    back = F.concat(F.lit("we met "), F.regexp_extract("fixed", r"we met .{12}([a-z]+) today", 1), F.lit(" today"))
    return out.select("item_id", F.concat(F.lit("we met "), F.initcap("w"), F.lit(" today")).alias("was"), back.alias("fixed"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]+')) > 12 AS needed, CASE WHEN length('short: ' || trim(split_part(trim(text), chr(10), 1))) BETWEEN 3 AND 4 * length(text) + 200 AND turn % 3 > 0 THEN 'short: ' || trim(split_part(trim(text), chr(10), 1)) ELSE text END AS standalone, CASE WHEN turn % 2 = 0 THEN 'which ' || turn || '?' ELSE '' END AS ask FROM conversations""")
def chat_rewrites(spark, sf_dir):
    """Which turns go to the rewriting model, which replies are taken as standalone questions, and what they ask back."""
    t = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    reply = F.when(F.col("turn") % 3 > 0, F.concat(F.lit('"short: '), F.trim(F.get(F.split(F.trim("text"), "\n"), 0)), F.lit('"\nmore'))).otherwise("no")
    ask = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Well. ASK: which "), "turn", F.lit("? \nbye"))).otherwise("clear")
    return t.select("conv_id", "turn", rewrite_needed("rewrite_if_unknown", F.slice(words, 13, 1)).alias("needed"), accepted_rewrite(F.col("text"), reply).alias("standalone"), clarifying_question(ask).alias("ask"))


@query(f"""WITH {R.BM25_SQL}, h AS (SELECT item_id, bm.rank, source, {R._COV_B} AS score FROM bm JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE bm.rank <= 5),
g AS (SELECT item_id, max(score) AS best FROM h GROUP BY item_id), u AS (SELECT item_id, count(DISTINCT source) AS n FROM h JOIN g USING (item_id) WHERE score >= best - 3 GROUP BY item_id)
SELECT item_id, (best < 0 OR len(regexp_split_to_array(trim(text), '\\s+')) <= 6) AND n >= 3 AS vague FROM g JOIN u USING (item_id) JOIN benchmark USING (item_id)""".replace("\\\\", "\\"))
def vague_questions(spark, sf_dir):
    """Items whose close hits come from three sources or more, where the best is weak or the item short."""
    asked = table(spark, sf_dir, "benchmark")
    hits = R.coverage_scores(spark, sf_dir)(R.bm25(R.index_of(spark, sf_dir), asked).select("item_id", "doc_id")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per = hits.groupBy("item_id").agg(F.collect_list(F.struct(F.col("source").alias("unit"), "score")).alias("hits"), F.max("score").alias("best"))
    grade = F.when(F.col("best") < 0, "P").otherwise("S")
    return per.join(asked, "item_id").select("item_id", looks_vague(F.col("hits"), F.col("best"), grade, F.trim("text")).alias("vague"))


_KEY = f"array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9-]*'), lambda w: lower(w) NOT IN ({R.STOPS})), ' ')"


@query(f"""WITH {R.BM25_SQL}, q AS (SELECT item_id, 0 AS v, text AS t FROM benchmark UNION ALL SELECT item_id, 1, {_KEY} FROM benchmark UNION ALL SELECT item_id, 2, 'the more ' || {_KEY} FROM benchmark WHERE item_id % 2 = 0),
a2 AS (SELECT item_id, v, term, count(*) AS qn FROM (SELECT item_id, v, unnest({R._TERMS.format('t')}) AS term FROM q) GROUP BY ALL),
more AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM per) WHERE term IN (SELECT term FROM a2) GROUP BY term, doc_id),
i2 AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM more, stats GROUP BY term, n),
s2 AS (SELECT item_id, v, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM a2 JOIN more USING (term) JOIN i2 USING (term) GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY item_id, v ORDER BY score DESC, doc_id) AS rank FROM s2),
u AS (SELECT item_id, doc_id, min(v * 1000 + rank) AS seen FROM r2 WHERE rank <= 10 GROUP BY ALL),
c AS (SELECT u.item_id, u.doc_id, seen, {R._COV_B} AS score FROM u JOIN benchmark b ON b.item_id = u.item_id JOIN documents d ON d.doc_id = u.doc_id)
SELECT item_id, doc_id, score, rank FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS INT) AS rank FROM c) WHERE rank <= 5""")
def second_search(spark, sf_dir):
    """Every item searched again in two or three forms, all pools in one order."""
    index, asked = R.index_of(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "fixed")
    missing = asked.select("item_id", F.when(F.col("item_id") % 2 == 0, T.strings(["the", "more"])).otherwise(F.array().cast("array<string>")).alias("missing"))
    return re_retrieved(variants(asked, missing), lambda a: R.bm25(index, a, POOL), R.coverage_scores(spark, sf_dir))


@query(f"""WITH {R.BM25_SQL}, h AS (SELECT DISTINCT item_id, unnest({R._TERMS.format('text')}) AS term FROM bm JOIN documents USING (doc_id) WHERE rank <= 5), b AS (SELECT item_id, max(score) AS best FROM bm GROUP BY item_id),
c AS (SELECT a.item_id, round(sum(CASE WHEN h.term IS NULL THEN 0 ELSE idf END) / sum(idf), 2) AS coverage FROM (SELECT DISTINCT item_id, term FROM asked) a JOIN idf USING (term) LEFT JOIN h ON h.item_id = a.item_id AND h.term = a.term GROUP BY a.item_id)
SELECT q.item_id, coalesce(coverage, 0.0) AS coverage, CASE WHEN best < -5 THEN 'I' WHEN q.item_id % 9 = 0 THEN 'M' WHEN q.item_id % 4 = 0 OR coalesce(coverage, 0) < 0.6 OR best < 0 THEN 'P' ELSE 'S' END AS grade,
CASE WHEN q.item_id % 9 = 0 THEN 'out_of_scope' WHEN q.item_id % 4 = 0 THEN 'missing_in_evidence' ELSE 'answer' END AS action, CASE WHEN q.item_id % 5 = 0 THEN 'not found by llm' ELSE 'answered' END AS source FROM benchmark q LEFT JOIN c USING (item_id) JOIN b ON b.item_id = q.item_id""")
def older_gates(spark, sf_dir):
    """The gates of coverage, of zones and of the first version over every item; some parts are said to be outside."""
    index, asked = R.index_of(spark, sf_dir), table(spark, sf_dir, "benchmark")
    hits = R.bm25(index, asked)
    cover = idf_coverage(asked, hits.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), index)
    some = lambda cond: F.when(cond, T.strings(["x"])).otherwise(F.array().cast("array<string>"))
    rows = cover.join(hits.groupBy("item_id").agg(F.max("score").alias("best")), "item_id").withColumns({"out_of_corpus": some(F.col("item_id") % 9 == 0), "missing": some(F.col("item_id") % 4 == 0)})
    answer = F.when(F.col("item_id") % 5 == 0, "Not found here").otherwise("Yes")
    return rows.select("item_id", "coverage", coverage_grade().alias("grade"), zone_action(F.col("best"), F.col("out_of_corpus"), F.col("missing"))["action"].alias("action"), answer_source(answer, F.col("best")).alias("source"))


_H = "CAST(('0x' || substr(md5('0|' || md5(text) || '|' || w || '|' || i || '|{0}'), 1, 7)) AS BIGINT)"


@query(f"""WITH p AS (SELECT item_id, text, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) - 1 AS i FROM benchmark),
h AS (SELECT *, {_H.format('at')} % greatest(length(w) - 2, 1) + 2 AS k, {_H.format('how')} % 4 AS how, {_H.format('vowel')} % 5 + 1 AS v, {_H.format('which')} % 1000 < 400 AND regexp_matches(w, '^[A-Za-z]{{5,}}$') AS yes FROM p),
s AS (SELECT item_id, i, CASE WHEN NOT yes THEN w WHEN how = 0 THEN left(w, k - 1) || substr(w, k + 1) WHEN how = 1 THEN left(w, k - 1) || substr(w, k + 1, 1) || substr(w, k, 1) || substr(w, k + 2) WHEN how = 2 THEN left(w, k - 1) || substr(w, k, 1) || substr(w, k) ELSE left(w, k - 1) || substr('aeiou', v, 1) || substr(w, k + 1) END AS w FROM h)
SELECT item_id, string_agg(w, '' ORDER BY i) AS noisy FROM s GROUP BY item_id""")
def typing_slips(spark, sf_dir):
    return with_slips(table(spark, sf_dir, "benchmark")).select("item_id", "noisy")


@query()
def prepared_questions(spark, sf_dir):
    """The whole way of every item, some of them misspelt, up to the prompt (held against its steps in the tests)."""
    return _prepared(spark, sf_dir)


def _prepared(spark, sf_dir) -> DataFrame:
    docs, vocab = table(spark, sf_dir, "documents"), _vocab(spark, sf_dir)
    acronyms = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Z0-9]+\b"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asked = with_slips(table(spark, sf_dir, "benchmark"), 0.1).select("item_id", F.when(F.col("item_id") % 20 != 19, F.when(F.col("item_id") % 2 == 0, F.col("noisy")).otherwise(F.col("text"))).alias("text"))
    scores = lambda pairs: pairs.join(docs.select("doc_id", F.col("text").alias("aw_text")), "doc_id").join(asked.select("item_id", F.col("text").alias("aw_q")), "item_id").withColumn("score", R.coverage(F.col("aw_q"), F.col("aw_text"))).drop("aw_text", "aw_q")
    return prepared(asked, R.index_of(spark, sf_dir), docs, vocab, vocab.select("word"), acronyms, scores)
