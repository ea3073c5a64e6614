"""Comparison of methods, models and versions: scoring input, reports per question, boards, rules, samples of evidence, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import arrow, text as T
from answerloom.operators import scoring as S
from answerloom.sources.tables import table

GRADES = ["S", "P", "I", "M"]


def selected_answers(answers: DataFrame, pairs: DataFrame, form: str, most_runs: int, questions: DataFrame | None = None) -> DataFrame:
    """Answers of the planned pairs (model, version) in one format and of the first runs, of the listed questions where given."""
    kept = answers.filter((F.col("format") == form) & (F.col("run") <= most_runs)).join(pairs.select("model", "version").distinct(), ["model", "version"], "left_semi")
    return kept if questions is None else kept.join(questions.select("qid"), "qid", "left_semi")


def scoring_rows(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Every saved answer beside its question's data; records: qid, source, label, question, action, expected, sources."""
    return answers.join(records.select("qid", "source", "label", "question", "action", F.coalesce("expected", F.lit("")).alias("expected"), "sources"), "qid", "left")


def token_use(answers: DataFrame, by: str = "model") -> DataFrame:
    """by, truncated, least, mid, most: answers that were cut off, and tokens of those that have a number of them."""
    n = F.col("answer_tokens").try_cast("double")
    return answers.groupBy(by).agg(F.count_if(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"), F.min(n).alias("least"), F.median(n).alias("mid"), F.max(n).alias("most"))


def scored_run(answers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored answers, their cards per model and version, and the trade-off between those. No model is called."""
    scored = S.rule_checks(S.score_answers(scoring_rows(answers, records)))
    return scored, S.scorecards(scored, ["model", "version"]), S.trade_off(scored, ["model", "version"])


def in_any(facts: Column, texts: Column) -> Column:
    """The facts that one of the texts holds on its own."""
    return F.filter(facts, lambda f: F.exists(texts, lambda t: T.fact_found(f, T.key_words(t), T.numbers(t))))


def labelled_text(path: Column, printed: Column, pages: Column, text: Column) -> Column:
    """A hit as the model sees it: path and pages, then the text."""
    known = F.array_join(F.filter(printed, lambda p: p.isNotNull()), ", ")
    return F.concat(F.array_join(path, " > "), F.lit(" | printed page "), known, F.lit(" | PDF page "), F.array_join(pages.cast("array<string>"), ", "), F.lit("\n"), text)


def question_rows(records: DataFrame, answers: DataFrame, index: DataFrame) -> DataFrame:
    """Per question: facts in all, in the index, in its hits, in its prompt and in each answer, flags of each run, lost_at.

    records: qid, label, action, expected, hit_texts, prompt_texts; answers: qid, run, answer, refused, correctness; index: text.
    Facts meet the index by a join on their rarest word, so no fact is compared with every text.
    """
    facts = F.when((F.col("label") == "answerable") & (F.coalesce("expected", F.lit("")) != ""), T.facts("expected")).otherwise(F.array().cast("array<string>"))
    rows = records.withColumn("facts", facts).withColumn("prompt_facts", in_any(F.col("facts"), F.col("prompt_texts")))
    asked = rows.select("qid", F.explode("facts").alias("fact")).select("qid", "fact", F.posexplode_outer(F.concat(T.key_words("fact"), T.numbers("fact"))).alias("i", "w"))
    held = index.select(F.xxhash64("text").alias("t"), "text", T.key_words("text").alias("k"), T.numbers("text").alias("n")).dropDuplicates(["t"])
    # a text that holds a fact has one of its words or numbers at least
    words = held.select("t", F.explode(F.concat("k", "n")).alias("w"))
    near = asked.select("qid", "fact", "w").join(words, "w").select("qid", "fact", "t").distinct().join(held, "t").filter(T.fact_found(F.col("fact"), F.col("k"), F.col("n"))).select("qid", "fact").distinct()
    in_index = near.groupBy("qid").agg(F.count(F.lit(1)).alias("facts_in_index"))
    runs = F.array_sort(F.collect_list(F.struct("run", "answer", "refused", (~F.col("refused") & (F.coalesce("correctness", F.lit(0.0)) >= S.TAU)).alias("right"))))
    per = answers.groupBy("qid").agg(runs.alias("runs"))
    out = rows.join(in_index, "qid", "left").join(per, "qid", "left").withColumn("runs", F.coalesce("runs", F.array().cast(per.schema["runs"].dataType)))
    out = out.select(
        "qid", "label", "action", F.size("facts").alias("facts_total"), F.coalesce("facts_in_index", F.lit(0)).cast("int").alias("facts_in_index"), F.size(in_any(F.col("facts"), F.col("hit_texts"))).alias("facts_in_hits"), F.size("prompt_facts").alias("facts_in_prompt"),
        F.transform("runs", lambda r: F.size(S.facts_found(F.col("prompt_facts"), F.coalesce(r["answer"], F.lit(""))))).alias("facts_in_answer"), F.transform("runs", lambda r: r["refused"]).alias("refused"), F.transform("runs", lambda r: r["right"]).alias("correct"),
    )
    return out.withColumn("lost_at", S.lost_at())


def report(rows: DataFrame, answers: DataFrame, model: str | None, runs: int) -> DataFrame:
    """question_rows with a column for each run (_r1, _r2, ...). Answers of several models need one to be named."""
    if model is None and len(names := [r.model for r in answers.select("model").distinct().limit(9).collect()]) > 1:
        raise ValueError(f"answers of several models, name one: {', '.join(sorted(names))}")
    wide = [F.get(c, r).alias(f"{c}_r{r + 1}") for c in ("facts_in_answer", "refused", "correct") for r in range(runs)]
    return rows.select("qid", "lost_at", "label", "action", "facts_total", "facts_in_index", "facts_in_hits", "facts_in_prompt", *wide)


def metric_summary(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, n, empty and the means (3 places) of measures; needs answer."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("answer", F.lit(""))) == "").alias("empty"), *(F.round(F.avg(m), 3).alias(m) for m in measures))


def method_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, with_gold, gold_5, gold_1 (percent), and how many questions of each label got each grade, in the order of ord."""
    able = F.col("label") == "answerable"
    gold = able & F.col("has_gold")
    count = [F.count_if(cond & (F.col("grade") == g)).alias(f"{name}_{g}") for name, cond in (("able", able), ("not", ~able)) for g in GRADES]
    share = lambda c: F.round(100 * F.avg(F.when(gold, F.coalesce(c, F.lit(False)).cast("int"))), 1)
    return rows.groupBy(*by).agg(F.count_if(gold).alias("with_gold"), share(F.col("gold_rank").isNotNull()).alias("gold_5"), share(F.col("gold_rank") == 1).alias("gold_1"), *count)


def differing(rows: DataFrame, key: list[str], method: str, methods: list[str], fields: list[str]) -> DataFrame:
    """key and field_method columns of the keys for which a field differs between methods; a missing value is a value."""
    wide = rows.groupBy(*key).pivot(method, methods).agg(*(F.first(f).alias(f) for f in fields)) if len(fields) > 1 else rows.groupBy(*key).pivot(method, methods).agg(F.first(fields[0]))
    name = lambda m, f: f"{m}_{f}" if len(fields) > 1 else m
    differ = F.lit(False)
    for f in fields:
        for m in methods[1:]:
            differ = differ | ~F.col(name(methods[0], f)).eqNullSafe(F.col(name(m, f)))
    return wide.filter(differ).select(*key, *(F.col(name(m, f)).alias(f"{f}_{m}") for f in fields for m in methods))


def top_changes(a: Column, b: Column) -> Column:
    """same order, same set, new and lost ids between two lists."""
    return F.struct((a == b).alias("same_top"), (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).alias("same_set"), F.array_except(b, a).alias("new"), F.array_except(a, b).alias("lost"))


def fired_rules() -> Column:
    """Every rule of the grade that fires, in order; the first decides."""
    some = F.filter(
        F.array(F.when(F.col("best") < -5, "I: best"), F.when(F.size("hard_out") > 0, "M: not in PDF"), F.when(F.size("soft_out") > 0, "P: soft word not in PDF"), F.when(F.size("missing") > 0, "P: not in hits"), F.when(F.col("best") < 0, "P: best")),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("S")))


def gate_rows(first: DataFrame, second: DataFrame, gold: DataFrame, key: str = "qid") -> DataFrame:
    """Grade and rank of the gold hit before and after the second search; first, second: qid, grade, best, hits; gold: qid, gold."""
    rank = lambda hits: F.nullif(F.array_position(F.transform(hits, lambda h: F.array_contains("gold", h)), F.lit(True)), F.lit(0)).cast("int")
    both = first.join(second.select(key, F.col("grade").alias("g2"), F.col("best").alias("b2"), F.col("hits").alias("h2")), key, "left").join(gold, key, "left")
    return both.select(key, F.col("grade").alias("first"), F.coalesce("g2", "grade").alias("final"), rank(F.col("hits")).alias("gold_rank_first"), rank(F.coalesce("h2", "hits")).alias("gold_rank_final"), F.col("b2").alias("best_final"))


def fixes_made(typed: Column, meant: Column, made: Column) -> Column:
    """How many of the words replaced between typed and meant a method's text has; (wanted, made)."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    fixes = arrow.word_fixes(F.array_join(words(typed), " "), F.array_join(words(meant), " "))
    return F.struct(F.size(fixes).alias("wanted"), F.size(F.filter(fixes, lambda f: F.array_contains(words(made), f["new"]))).alias("made"))


def helped(rows: DataFrame, better: str, worse: str) -> DataFrame:
    """qid of answerable questions that one method got through the gate, or found the gold for, and the other did not."""
    ok = F.col("grade").isin("S", "P") | F.col("gold_rank").isNotNull()
    per = rows.filter("label = 'answerable'").groupBy("qid").agg(F.bool_or(F.when(F.col("method") == better, ok)).alias("a"), F.bool_or(F.when(F.col("method") == worse, ok)).alias("b"))
    return per.filter("a and not b").select("qid")


def pass_rules(rows: DataFrame, every: list[str], clean: list[str], most: float = 5.0) -> DataFrame:
    """rule, n, of, passed: all of some groups and all helped questions go to the rewrite, and at most a share of clean ones."""
    go, g = F.col("to_rewrite"), F.col("grp")
    a = rows.agg(*(f for name, cond in (("every", g.isin(every)), ("helped", F.col("helped")), ("clean", g.isin(clean))) for f in (F.count_if(cond & go).alias(f"{name}_n"), F.count_if(cond).alias(f"{name}_of"))))
    rule = lambda i, name, passed: F.struct(F.lit(i).alias("rule"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_of").alias("of"), passed.alias("passed"))
    share = F.coalesce(F.try_divide(100 * F.col("clean_n"), F.col("clean_of")), F.lit(0.0))
    return a.select(F.inline(F.array(rule(1, "every", F.col("every_n") == F.col("every_of")), rule(2, "helped", F.col("helped_n") == F.col("helped_of")), rule(3, "clean", F.round(share, 1) <= most))))


def numbers_kept(question: Column, rewrite: Column) -> Column:
    found = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.size(F.array_except(found(question), found(rewrite))) == 0


def patterns_hold(text: Column, must: Column, must_not: Column) -> Column:
    """Whether a text has all patterns of one list and none of the other; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.forall(F.coalesce(must, none), lambda p: F.rlike(text, p)) & ~F.exists(F.coalesce(must_not, none), lambda p: F.rlike(text, p))


def outcome(answer: Column, action: Column) -> Column:
    scoped = (action == "scoped") | answer.rlike("(?i)does not (cover|mention)|not covered")
    return F.when(F.startswith(answer, F.lit(T.NOT_FOUND.rstrip("."))), "not_found").when(F.coalesce(scoped, F.lit(False)), "scoped").otherwise("answered")


def model_board(rows: DataFrame, by: str = "model") -> DataFrame:
    """Six measures of each model; needs expected (answer, refuse), outcome, correct, cited, needs_llm, seconds."""
    ask, refuse, said = F.col("expected") == "answer", F.col("expected") == "refuse", F.col("outcome") == "answered"
    share = lambda cond, what: F.round(100 * F.avg(F.when(cond, F.col(what).cast("int"))), 1)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("saved"), share(ask, "correct").alias("correct_pct"), share(refuse, "correct").alias("refused_pct"), F.count_if(refuse & said).alias("wrong_answers"), share(ask & said, "cited").alias("cited_pct"), F.round(F.median(F.when(F.col("needs_llm"), F.col("seconds"))), 1).alias("mid_seconds")
    )


def fact_coverage(expected: Column, text: Column) -> Column:
    """The share of facts that a text holds (2 places)."""
    facts = T.facts(expected)
    return F.round(F.size(S.facts_found(facts, text)) / F.greatest(F.size(facts), F.lit(1)), 2)


def verdict(coverage: Column, answer: Column, action: Column, to_refuse: Column) -> Column:
    gated = action.isin("reject", "scoped")
    return F.when(gated & to_refuse, "refused_ok").when(gated, "refused_wrong").when(F.contains(F.left(F.lower(answer), F.lit(60)), F.lit("not found")), "said_not_found").when(coverage >= 0.6, "correct").when(coverage >= 0.3, "partial").otherwise("incorrect")


def first_failed(checks: list[tuple[str, Column]], end: Column) -> Column:
    """The name of the first check that does not hold, else end."""
    out = end
    for name, cond in reversed(checks):
        out = F.when(~F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out


def version_decision(runs: DataFrame, old: str, new: str) -> DataFrame:
    """model, gain, noise, adopt: a version is adopted if its median gain beats the old one's noise, over-answers are no more, and its worst run is no worse."""
    f = lambda v, agg, c: agg(F.when(F.col("version") == v, F.col(c)))
    g = runs.groupBy("model").agg(
        (f(new, F.median, "trust") - f(old, F.median, "trust")).alias("gain"), (f(old, F.max, "trust") - f(old, F.min, "trust")).alias("noise"), f(old, F.avg, "over_answer").alias("o"), f(new, F.avg, "over_answer").alias("m"), f(old, F.min, "trust").alias("a"), f(new, F.min, "trust").alias("b")
    )
    return g.select("model", F.round("gain", 6).alias("gain"), F.round("noise", 6).alias("noise"), ((F.col("gain") > F.col("noise")) & (F.col("m") <= F.col("o")) & (F.col("b") >= F.col("a"))).alias("adopt"))


def run_board(runs: DataFrame) -> DataFrame:
    """model, trust, noise, runs, empty: means over runs, the range of trust, and empty answers."""
    return runs.groupBy("model").agg(F.round(F.avg("trust"), 3).alias("trust"), F.round(F.max("trust") - F.min("trust"), 3).alias("noise"), F.count(F.lit(1)).alias("runs"), F.sum("empty").alias("empty"))


# Styles of citations.
STYLES = {"n": r"\[\d+\]", "n_m": r"\[\d+(?:\s*[,;–-]\s*\d+)+\]", "cjk": "【[^】]*】", "source": r"\b[Ss]ource\s+\d+", "rows": r"(?m)^\s*\|"}


def citation_styles(answers: DataFrame, by: str = "model") -> DataFrame:
    return answers.groupBy(by).agg(*(F.round(F.avg(F.col("answer").rlike(p).cast("int")), 2).alias(n) for n, p in STYLES.items()))


def slip_effects(clean: DataFrame, noisy: DataFrame, k: int = 5) -> DataFrame:
    """kind, same_top1, overlap, gate_pass: what search (qid, hits) loses by slips (qid, kind, hits, best)."""
    both = noisy.join(clean.select("qid", F.col("hits").alias("clean")), "qid")
    same = F.coalesce(F.get("hits", 0) == F.get("clean", 0), F.lit(False))
    return both.groupBy("kind").agg(F.round(F.avg(same.cast("int")), 3).alias("same_top1"), F.round(F.avg(F.size(F.array_intersect("hits", "clean")) / k), 3).alias("overlap"), F.round(F.avg((F.col("best") >= -5).cast("int")), 3).alias("gate_pass"))


def resolved_keys(keys: DataFrame, sections: DataFrame) -> DataFrame:
    """qid, part, unit: what the parts of an expected key mean: "letter n", a number, or names down the ancestors ("A > B").

    sections: section_id, number, label, path (array of labels). A part that names nothing has a null unit. Names match whole
    words; earlier names have to be among the ancestors, in order.
    """
    parts = keys.select("qid", F.explode(F.transform(F.split("expected", ";"), lambda p: F.trim(p))).alias("part")).filter("part <> ''").distinct()
    letter = F.regexp_extract("part", r"(?i)^letter\s*(\d+)$", 1)
    parts = parts.withColumn("letter", letter).withColumn("number", F.when(F.col("part").rlike(r"^\d+(\.\d+)*$"), F.col("part")))
    by_letter = parts.filter("letter <> ''").select("qid", "part", F.format_string("L%02d", F.col("letter").cast("int")).alias("unit"))
    by_number = parts.filter("number is not null").join(sections.select(F.rtrim("number", F.lit(".")).alias("number"), "section_id"), "number").select("qid", "part", F.col("section_id").alias("unit"))
    named = parts.filter("letter = '' and number is null").withColumn("names", F.transform(F.split("part", ">"), lambda p: F.lower(F.trim(p))))
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    # the last name is part of the section's own label: an equi-join on its first word, then the whole name
    last = named.withColumn("last", flat(F.element_at("names", -1))).withColumn("w", F.get(F.split(F.trim("last"), " "), 0))
    own = sections.select("section_id", flat(F.col("label")).alias("own"), F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x: flat(x)).alias("above"))
    cand = last.join(own.withColumn("w", F.explode(F.array_distinct(F.split(F.trim("own"), " ")))), "w").filter(F.contains("own", "last"))
    pattern = F.concat(F.lit("(?s).*"), F.array_join(F.transform(F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))), lambda n: F.concat(F.lit("\\Q"), flat(n), F.lit("\\E"))), ".*"), F.lit(".*"))
    by_name = cand.filter(F.rlike(F.array_join("above", ">"), pattern)).select("qid", "part", F.col("section_id").alias("unit")).distinct()
    found = by_letter.unionByName(by_number).unionByName(by_name)
    return parts.select("qid", "part").join(found, ["qid", "part"], "left")


def page_relevance(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id: chunks on a page of a key's ranges ("43-44; 50") that hold the key's phrase, if it has one; an equi-join on pages."""
    ranges = F.transform(F.regexp_extract_all("pages", F.lit(r"\d+(?:-\d+)?"), F.lit(0)), lambda r: F.transform(F.split(r, "-"), lambda x: x.cast("int")))
    pages = F.flatten(F.transform(ranges, lambda r: F.sequence(F.get(r, 0), F.greatest(F.get(r, 0), F.element_at(r, -1)))))
    a = keys.select("qid", F.coalesce("phrase", F.lit("")).alias("phrase"), F.explode(F.array_distinct(pages)).alias("page"))
    b = chunks.select("chunk_id", "text", F.explode("pdf_pages").alias("page"))
    return a.join(b, "page").filter(F.contains(T.normalise("text"), T.normalise("phrase"))).select("qid", "chunk_id").distinct()


def part_of(page: Column, edges: list[int], names: list[str]) -> Column:
    """The named part (lower edge excluded, upper included) that a page lies in."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges, edges[1:], names, strict=False))):
        out = F.when((page > lo) & (page <= hi), name).otherwise(out)
    return out


# ---- queries

_E = "e AS (SELECT event_id, user_id, 'u' || (user_id % 3) AS model, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, CAST(event_id % 4 AS INT) AS run, value FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "concat('u', user_id % 3) AS model", "CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version", "CAST(event_id % 4 AS INT) AS run", "value", "event_type")


@query(f"WITH {_E} SELECT event_id, model, version, run FROM e WHERE run <= 2 AND ((model = 'u0' AND version = 'v1') OR model = 'u1') AND user_id <> 3")
def row_selection(spark, sf_dir):
    e = _events(spark, sf_dir).withColumns({"format": F.lit("f0"), "qid": F.col("user_id")})
    pairs = spark.createDataFrame([("u0", "v1"), ("u1", "v1"), ("u1", "v2")], "model string, version string")
    return selected_answers(e, pairs, "f0", 2, e.select("qid").distinct().filter("qid <> 3")).select("event_id", "model", "version", "run")


@query(f"""WITH {_E} SELECT model, count(*) FILTER (event_id % 10 = 0) AS truncated, min(t) AS least, median(t) AS mid, max(t) AS most FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 100 AS DOUBLE) END AS t FROM e) GROUP BY model""")
def token_usage(spark, sf_dir):
    e = _events(spark, sf_dir)
    return token_use(e.withColumns({"truncated": F.col("event_id") % 10 == 0, "answer_tokens": F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 100).cast("string")).otherwise("n/a")}))


@query()
def scored_join(spark, sf_dir):
    """Answers joined with their questions, scored and summed up in cards (held against the scoring of the joined rows in the tests)."""
    a = S.answers(spark, sf_dir).withColumns({"version": F.lit("v1")})
    records = a.select("qid", F.lit("chat").alias("source"), F.lit("answerable").alias("label"), "question", "action", "expected", "sources")
    return scored_run(a.select("qid", "model", "version", "answer", "prompt"), records)[1]


@query("""WITH f AS (SELECT event_id AS qid, event_id % 3 AS k FROM events)
SELECT qid, CAST(2 AS INT) AS facts_total, CAST(CASE WHEN k = 0 THEN 2 ELSE 1 END AS INT) AS facts_in_index, CAST(CASE WHEN k = 2 THEN 0 ELSE 1 END AS INT) AS facts_in_hits, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS INT) AS facts_in_prompt, CASE k WHEN 0 THEN 'context' WHEN 1 THEN 'llm_incomplete' ELSE 'retrieval' END AS lost_at, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS INT) AS facts_in_answer_r1, qid % 5 = 0 AND false AS refused_r1, false AS correct_r2 FROM f""")
def diagnosis_report(spark, sf_dir):
    """Questions with two facts each, of which the index, the hits, the prompt and the answers hold some."""
    k = F.col("event_id") % 3
    records = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("qid"), F.lit("answerable").alias("label"), F.lit("answer").alias("action"), F.when(k == 0, "posts filled 45; salary 2000").otherwise("posts filled 45; bonus 777").alias("expected"),
        F.when(k == 2, F.array(F.lit("nothing"))).otherwise(F.array(F.lit("posts were filled: 45"), F.lit("other"))).alias("hit_texts"), F.when(k == 1, F.array(F.lit("posts were filled: 45"))).otherwise(F.array(F.lit("none"))).alias("prompt_texts"),
    )
    index = spark.createDataFrame([("posts were filled: 45",), ("the salary is 2,000 a month",), ("bonus",)], "text string")
    answers = records.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), F.lit("m").alias("model"), F.lit("45 posts filled").alias("answer"), F.lit(False).alias("refused"), F.lit(0.0).alias("correctness"))
    return report(question_rows(records, answers, index), answers, None, 2).select("qid", "facts_total", "facts_in_index", "facts_in_hits", "facts_in_prompt", "lost_at", "facts_in_answer_r1", "refused_r1", "correct_r2")


@query("""SELECT doc_id, lang || ' > ' || source || ' | printed page ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END || ' | PDF page ' || doc_id || ', ' || (doc_id + 1) || chr(10) || left(source, 3) AS shown FROM documents""")
def labelled_texts(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", labelled_text(F.array("lang", "source"), F.array(F.when(i % 3 != 0, i.cast("string"))), F.array(i, i + 1), F.left("source", F.lit(3))).alias("shown"))


@query(f"WITH {_E} SELECT model, version, count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS empty, round(avg(value), 3) AS value FROM e GROUP BY ALL")
def metric_means(spark, sf_dir):
    return metric_summary(_events(spark, sf_dir).withColumn("answer", F.when(F.col("event_id") % 6 == 0, " ").otherwise("x")), ["model", "version"], ["value"])


_M = "m AS (SELECT event_id // 3 AS qid, CASE WHEN (event_id // 3) % 4 > 0 THEN 'answerable' ELSE 'unanswerable' END AS label, ['original', 'fixed', 'rewrite'][event_id % 3 + 1] AS method, ['S', 'P', 'I', 'M'][CAST(floor(value) AS BIGINT) % 4 + 1] AS grade, CASE WHEN user_id % 6 > 0 THEN CAST(user_id % 6 AS INT) END AS gold_rank, (event_id // 3) % 5 > 0 AS has_gold FROM events)"


def _methods(spark, sf_dir) -> DataFrame:
    q = "event_id div 3"
    return table(spark, sf_dir, "events").selectExpr(
        f"{q} AS qid", f"CASE WHEN ({q}) % 4 > 0 THEN 'answerable' ELSE 'unanswerable' END AS label", "element_at(array('original', 'fixed', 'rewrite'), cast(event_id % 3 + 1 as int)) AS method", "element_at(array('S', 'P', 'I', 'M'), cast(floor(value) % 4 + 1 as int)) AS grade",
        "CASE WHEN user_id % 6 > 0 THEN CAST(user_id % 6 AS INT) END AS gold_rank", f"({q}) % 5 > 0 AS has_gold",
    )


_G = ", ".join(f"count(*) FILTER (label {op} 'answerable' AND grade = '{g}') AS {name}_{g}" for name, op in (("able", "="), ("not", "<>")) for g in GRADES)


@query(f"""WITH {_M} SELECT method, count(*) FILTER (label = 'answerable' AND has_gold) AS with_gold, round(100 * avg(CASE WHEN label = 'answerable' AND has_gold THEN (gold_rank IS NOT NULL)::INT END), 1) AS gold_5, round(100 * avg(CASE WHEN label = 'answerable' AND has_gold THEN coalesce(gold_rank = 1, false)::INT END), 1) AS gold_1, {_G} FROM m GROUP BY method""")
def method_board(spark, sf_dir):
    return method_summary(_methods(spark, sf_dir), ["method"])


@query(f"""WITH {_M}, w AS (SELECT qid, label, any_value(grade) FILTER (method = 'original') AS grade_original, any_value(grade) FILTER (method = 'rewrite') AS grade_rewrite, any_value(gold_rank) FILTER (method = 'original') AS gold_rank_original, any_value(gold_rank) FILTER (method = 'rewrite') AS gold_rank_rewrite FROM m GROUP BY ALL)
SELECT * FROM w WHERE grade_original IS DISTINCT FROM grade_rewrite OR gold_rank_original IS DISTINCT FROM gold_rank_rewrite""")
def differing_questions(spark, sf_dir):
    return differing(_methods(spark, sf_dir), ["qid", "label"], "method", ["original", "rewrite"], ["grade", "gold_rank"])


@query(f"""WITH {_M}, p AS (SELECT qid, bool_or(grade IN ('S', 'P') OR gold_rank IS NOT NULL) FILTER (method = 'rewrite') AS a, bool_or(grade IN ('S', 'P') OR gold_rank IS NOT NULL) FILTER (method = 'original') AS b FROM m WHERE label = 'answerable' GROUP BY qid) SELECT qid FROM p WHERE a AND NOT b""")
def rewrite_helped(spark, sf_dir):
    return helped(_methods(spark, sf_dir), "rewrite", "original")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[:5] AS a, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[:5] AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, a = b AS same_top, list_sort(a) = list_sort(b) AS same_set, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS new, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS lost FROM o""")
def top5_changes(spark, sf_dir):
    """The five dearest orders of a customer beside the five earliest."""
    ids = lambda *c: F.slice(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["o_orderkey"]), 1, 5)
    o = table(spark, sf_dir, "orders").withColumn("cost", -F.col("o_totalprice")).groupBy("o_custkey").agg(ids("cost", "o_orderkey").alias("a"), ids("o_orderdate", "o_orderkey").alias("b"))
    return o.select("o_custkey", top_changes(F.col("a"), F.col("b")).alias("c")).select("o_custkey", "c.same_top", "c.same_set", F.array_sort("c.new").alias("new"), F.array_sort("c.lost").alias("lost"))


@query("""WITH s AS (SELECT doc_id, (doc_id % 17) - 8.0 AS best, doc_id % 5 = 0 AS h, doc_id % 4 = 0 AS w, doc_id % 3 = 0 AS m FROM documents),
f AS (SELECT doc_id, list_filter([CASE WHEN best < -5 THEN 'I: best' END, CASE WHEN h THEN 'M: not in PDF' END, CASE WHEN w THEN 'P: soft word not in PDF' END, CASE WHEN m THEN 'P: not in hits' END, CASE WHEN best < 0 THEN 'P: best' END], lambda x: x IS NOT NULL) AS r FROM s) SELECT doc_id, CASE WHEN len(r) > 0 THEN r ELSE ['S'] END AS rules FROM f""")
def rule_reasons(spark, sf_dir):
    some = lambda n: F.when(F.col("doc_id") % n == 0, T.strings(["x"])).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 17 - 8.0).alias("best"), some(5).alias("hard_out"), some(4).alias("soft_out"), some(3).alias("missing")).select("doc_id", fired_rules().alias("rules"))


@query("""WITH f AS (SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN 'P' ELSE 'S' END AS grade, [doc_id, doc_id + 1] AS hits FROM documents)
SELECT qid, grade AS first, CASE WHEN grade = 'P' THEN 'S' ELSE grade END AS final, CAST(2 AS INT) AS gold_rank_first, CAST(CASE WHEN grade = 'P' THEN 1 ELSE 2 END AS INT) AS gold_rank_final, CASE WHEN grade = 'P' THEN 1.5::DOUBLE END AS best_final FROM f""")
def gate_before_after(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    first = d.select(i.alias("qid"), F.when(i % 2 == 0, "P").otherwise("S").alias("grade"), F.lit(-1.0).alias("best"), F.array(i, i + 1).alias("hits"))
    second = first.filter("grade = 'P'").select("qid", F.lit("S").alias("grade"), F.lit(1.5).alias("best"), F.array(F.col("qid") + 1, F.col("qid")).alias("hits"))
    return gate_rows(first, second, d.select(i.alias("qid"), F.array(i + 1).alias("gold")))


@query("""SELECT c_custkey, CAST(2 AS INT) AS wanted, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS made, c_custkey % 3 = 0 AS kept FROM customer""")
def word_fix_counts(spark, sf_dir):
    """Two misspelt words, of which a method puts one or both right; and whether a rewrite keeps a number."""
    c = table(spark, sf_dir, "customer")
    made = F.when(F.col("c_custkey") % 2 == 0, "the salary of nurses").otherwise("the salary of nurss")
    n = F.col("c_custkey").cast("string")
    return c.select("c_custkey", fixes_made(F.lit("the salray of nurss"), F.lit("the salary of nurses"), made).alias("f"), numbers_kept(F.concat(F.lit("rule "), n), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("the rule "), n)).otherwise("the rule")).alias("kept")).select("c_custkey", "f.*", "kept")


@query("""WITH r AS (SELECT doc_id % 3 AS g, doc_id % 3 = 0 OR doc_id % 50 = 1 AS go, doc_id % 7 = 0 AS h FROM documents), a AS (SELECT count(*) FILTER (g = 0 AND go) a, count(*) FILTER (g = 0) b, count(*) FILTER (h AND go) c, count(*) FILTER (h) d, count(*) FILTER (g = 1 AND go) e, count(*) FILTER (g = 1) f FROM r)
SELECT CAST(1 AS INT) AS rule, a AS n, b AS "of", a = b AS passed FROM a UNION ALL SELECT 2, c, d, c = d FROM a UNION ALL SELECT 3, e, f, round(100 * e / f, 1) <= 5 FROM a""")
def rewrite_rules(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((i % 3).cast("string").alias("grp"), ((i % 3 == 0) | (i % 50 == 1)).alias("to_rewrite"), (i % 7 == 0).alias("helped"))
    return pass_rules(rows, ["0"], ["1"])


@query("""WITH a AS (SELECT conv_id, turn, 'm' || (conv_id % 3) AS model, CASE WHEN turn % 4 = 0 THEN 'Not found in the guideline.' WHEN turn % 5 = 0 THEN 'It does not cover this' ELSE text || ' [1]' END AS answer, conv_id % 2 = 0 AS ask, turn FROM conversations),
o AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'not_found' WHEN turn % 5 = 0 THEN 'scoped' ELSE 'answered' END AS outcome FROM a), c AS (SELECT *, CASE WHEN NOT ask THEN outcome <> 'answered' ELSE outcome = 'answered' AND regexp_matches(answer, '(?i)the') AND NOT regexp_matches(answer, '(?i)zz') END AS correct FROM o)
SELECT model, count(*) AS saved, round(100 * avg(CASE WHEN ask THEN correct::INT END), 1) AS correct_pct, round(100 * avg(CASE WHEN NOT ask THEN correct::INT END), 1) AS refused_pct, count(*) FILTER (NOT ask AND outcome = 'answered') AS wrong_answers, round(100 * avg(CASE WHEN ask AND outcome = 'answered' THEN 1 END), 1) AS cited_pct, round(median(turn::DOUBLE), 1) AS mid_seconds FROM c GROUP BY model""")
def board_of_models(spark, sf_dir):
    """Answers checked by patterns, their outcome, and six measures of each model."""
    t, n = table(spark, sf_dir, "conversations"), F.col("turn")
    answer = F.when(n % 4 == 0, T.NOT_FOUND).when(n % 5 == 0, "It does not cover this").otherwise(F.concat("text", F.lit(" [1]")))
    rows = t.select(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), answer.alias("answer"), F.when(F.col("conv_id") % 2 == 0, "answer").otherwise("refuse").alias("expected"), n.cast("double").alias("seconds"), F.lit(True).alias("needs_llm"))
    rows = rows.withColumn("outcome", outcome(F.col("answer"), F.lit(None).cast("string"))).withColumn("cited", F.col("answer").rlike(r"\[\d"))
    right = F.when(F.col("expected") == "refuse", F.col("outcome") != "answered").otherwise((F.col("outcome") == "answered") & patterns_hold(F.col("answer"), T.strings(["(?i)the"]), T.strings(["(?i)zz"])))
    return model_board(rows.withColumn("correct", right))


@query("""WITH c AS (SELECT doc_id, (doc_id % 3) / 2.0 AS coverage FROM documents) SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS coverage, CASE WHEN doc_id % 8 = 0 THEN 'refused_ok' WHEN doc_id % 4 = 0 THEN 'refused_wrong' WHEN doc_id % 3 = 0 THEN 'incorrect' WHEN doc_id % 3 = 1 THEN 'partial' ELSE 'correct' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN 'index' WHEN doc_id % 3 = 0 THEN 'chunk' WHEN doc_id % 4 = 0 THEN 'gate' ELSE 'ok' END AS lost_at FROM documents""")
def answer_verdicts(spark, sf_dir):
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, "none").when(i % 3 == 1, "posts were filled by 45").otherwise("posts filled 45, salary 2000")
    rows = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.when(i % 4 == 0, "reject").otherwise("answer").alias("action"), fact_coverage(F.lit("posts filled 45; salary 2000"), answer).alias("coverage"))
    checks = [("index", i % 5 != 0), ("chunk", F.col("coverage") >= 0.3), ("gate", F.col("action") == "answer")]
    return rows.select("doc_id", "coverage", verdict(F.col("coverage"), F.col("answer"), F.col("action"), i % 8 == 0).alias("verdict"), first_failed(checks, F.lit("ok")).alias("lost_at"))


_R = "r AS (SELECT 'm' || (user_id % 3) AS model, version, event_id % 20 AS run, avg(value) / 100 AS trust, count(*) FILTER (event_id % 3 = 0) AS over_answer, count(*) FILTER (event_id % 9 = 0) AS empty FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version FROM events) GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = [F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version"), (F.col("event_id") % 20).alias("run")]
    return e.groupBy(*by).agg((F.avg("value") / 100).alias("trust"), F.count_if(F.col("event_id") % 3 == 0).alias("over_answer"), F.count_if(F.col("event_id") % 9 == 0).alias("empty"))


@query(f"""WITH {_R}, g AS (SELECT model, median(trust) FILTER (version = 'v2') - median(trust) FILTER (version = 'v1') AS gain, max(trust) FILTER (version = 'v1') - min(trust) FILTER (version = 'v1') AS noise, avg(over_answer) FILTER (version = 'v1') AS o, avg(over_answer) FILTER (version = 'v2') AS m, min(trust) FILTER (version = 'v1') AS a, min(trust) FILTER (version = 'v2') AS b FROM r GROUP BY model)
SELECT model, round(gain, 6) AS gain, round(noise, 6) AS noise, gain > noise AND m <= o AND b >= a AS adopt FROM g""")
def version_choice(spark, sf_dir):
    return version_decision(_runs(spark, sf_dir), "v1", "v2")


@query(f"WITH {_R} SELECT model, round(avg(trust), 3) AS trust, round(max(trust) - min(trust), 3) AS noise, count(*) AS runs, CAST(sum(empty) AS BIGINT) AS empty FROM r GROUP BY model")
def board_with_noise(spark, sf_dir):
    return run_board(_runs(spark, sf_dir))


_STYLES = ", ".join(f"round(avg(regexp_matches(answer, '{p}')::INT), 2) AS {n}" for n, p in STYLES.items())


@query(f"""WITH a AS (SELECT 'm' || (conv_id % 3) AS model, text || CASE turn % 5 WHEN 0 THEN ' [3]' WHEN 1 THEN ' [1, 2]' WHEN 2 THEN ' 【2】' WHEN 3 THEN ' Source 4' ELSE chr(10) || '| a' END AS answer FROM conversations) SELECT model, {_STYLES} FROM a GROUP BY model""")
def citation_shares(spark, sf_dir):
    n = F.col("turn") % 5
    tail = F.when(n == 0, " [3]").when(n == 1, " [1, 2]").when(n == 2, " 【2】").when(n == 3, " Source 4").otherwise("\n| a")
    return citation_styles(table(spark, sf_dir, "conversations").select(F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.concat("text", tail).alias("answer")))


@query("""SELECT kind, round(avg(CASE WHEN kind = 'typo' THEN (doc_id % 3 > 0)::INT ELSE 1 END), 3) AS same_top1, round(avg(CASE WHEN kind = 'typo' AND doc_id % 3 = 0 THEN 0.4 ELSE 0.6 END), 3) AS overlap, round(avg((doc_id % 11 - 6 >= -5)::INT), 3) AS gate_pass FROM documents, (SELECT unnest(['typo', 'typo+fix']) AS kind) GROUP BY kind""")
def slip_robustness(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    clean = d.select(i.alias("qid"), F.array(i, i + 1, i + 2).alias("hits"))
    hits = F.when((F.col("kind") == "typo") & (i % 3 == 0), F.array(i + 9, i + 1, i + 2)).otherwise(F.array(i, i + 1, i + 2))
    noisy = d.select("doc_id", F.explode(T.strings(["typo", "typo+fix"])).alias("kind")).select(i.alias("qid"), "kind", hits.alias("hits"), (i % 11 - 6).alias("best"))
    return slip_effects(clean, noisy)


@query("""WITH s AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT k AS qid, 'letter ' || k AS part, format('L{:02d}', k) AS unit FROM s UNION ALL SELECT k, '4.' || k, 'S' || k FROM s UNION ALL SELECT k, r_name || ' > ' || n_name, 'S' || k FROM s UNION ALL SELECT k, 'nowhere > ' || n_name, NULL FROM s""")
def answer_keys(spark, sf_dir):
    """Keys by letter, number and names down the ancestors; one part of each names nothing."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    sections = n.select(F.concat(F.lit("S"), k).alias("section_id"), F.concat(F.lit("4."), k, F.lit(".")).alias("number"), F.concat(F.lit("Part "), "n_name").alias("label"), F.array(F.lit("World"), F.concat(F.lit("Region "), "r_name"), F.concat(F.lit("Part "), "n_name")).alias("path"))
    keys = n.select(k.alias("qid"), F.concat(F.lit("letter "), k, F.lit("; 4."), k, F.lit("; "), "r_name", F.lit(" > "), "n_name", F.lit("; nowhere > "), "n_name").alias("expected"))
    return resolved_keys(keys, sections)


@query("""WITH c AS (SELECT doc_id, unnest([doc_id, doc_id + 1]) AS page, text FROM documents), k AS (SELECT item_id, unnest(list_concat(range(item_id * 3, item_id * 3 + 3), [item_id * 3 + 50])) AS page FROM benchmark)
SELECT DISTINCT item_id AS qid, doc_id AS chunk_id FROM k JOIN c USING (page) WHERE item_id % 2 = 0 OR contains(lower(text), 'the')""")
def page_keys(spark, sf_dir):
    """Keys of a range of pages and a single one, half of them with a phrase."""
    i = F.col("item_id")
    keys = table(spark, sf_dir, "benchmark").select(i.alias("qid"), F.when(i % 2 == 1, "the").alias("phrase"), F.concat((i * 3).cast("string"), F.lit("-"), (i * 3 + 2).cast("string"), F.lit("; "), (i * 3 + 50).cast("string")).alias("pages"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.array(F.col("doc_id").cast("int"), (F.col("doc_id") + 1).cast("int")).alias("pdf_pages"))
    return page_relevance(keys, chunks)


@query("""SELECT CASE WHEN doc_id <= 0 THEN NULL WHEN doc_id <= 20 THEN 'front' WHEN doc_id <= 100 THEN 'body' WHEN doc_id <= 150 THEN 'letters' END AS part, count(*) AS n, round(avg(n_chars), 3) AS size FROM documents GROUP BY 1""")
def binned_by_part(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(part_of(F.col("doc_id"), [0, 20, 100, 150], ["front", "body", "letters"]).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 3).alias("size"))


@query("""SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'gate' ELSE 'manual' END AS src, CASE WHEN item_id % 3 > 0 THEN 'W' || item_id END AS word FROM benchmark""")
def union_keep_first(spark, sf_dir):
    """Questions of two sources, the first source's row kept; the second one's word is read from a rule's text."""
    b = table(spark, sf_dir, "benchmark")
    a = b.filter("item_id % 3 = 0").select(F.col("item_id").alias("qid"), F.lit("gate").alias("src"), F.lit(None).cast("string").alias("word"))
    m = b.select(F.col("item_id").alias("qid"), F.lit("manual").alias("src"), F.regexp_extract(F.concat(F.lit("M: not in PDF [W"), "item_id", F.lit("]")), r"\[(.*)\]", 1).alias("word"))
    return a.unionByName(m).groupBy("qid").agg(F.min(F.struct("src", "word")).alias("f")).select("qid", "f.src", "f.word")


@query("""SELECT questions, idx, count(*) AS n, count(*) FILTER (own AND gold_rank IS NOT NULL) AS gold_top5, count(*) FILTER (NOT own AND grade = 'I') AS refused, CAST(count(*) FILTER (grade = 'S') AS BIGINT) AS s, CAST(count(*) FILTER (grade = 'P') AS BIGINT) AS p FROM (SELECT 'q' || (user_id % 2) AS questions, 'i' || (event_id % 2) AS idx, user_id % 2 = event_id % 2 AS own, CASE WHEN user_id % 6 > 0 THEN 1 END AS gold_rank, ['S', 'P', 'I', 'M'][CAST(floor(value) AS BIGINT) % 4 + 1] AS grade FROM events) GROUP BY ALL""")
def two_index_summary(spark, sf_dir):
    """Question sets on two indexes: gold found on their own, refusals on the other, and a map of grades."""
    e = table(spark, sf_dir, "events").selectExpr("concat('q', user_id % 2) AS questions", "concat('i', event_id % 2) AS idx", "user_id % 2 = event_id % 2 AS own", "user_id % 6 > 0 AS found", "element_at(array('S', 'P', 'I', 'M'), cast(floor(value) % 4 + 1 as int)) AS grade")
    per = e.groupBy("questions", "idx", "grade").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") & F.col("found")).alias("gold"), F.count_if(~F.col("own") & (F.col("grade") == "I")).alias("refused"))
    g = per.groupBy("questions", "idx").agg(F.sum("n").alias("n"), F.sum("gold").alias("gold_top5"), F.sum("refused").alias("refused"), F.map_from_entries(F.collect_list(F.struct("grade", "n"))).alias("grades"))
    return g.select("questions", "idx", "n", "gold_top5", "refused", F.coalesce(F.try_element_at("grades", F.lit("S")), F.lit(0)).alias("s"), F.coalesce(F.try_element_at("grades", F.lit("P")), F.lit(0)).alias("p"))


@query("""SELECT n_nationkey AS qid, list_sort(list_transform([r * 5, r * 5 + 1], lambda a: format('N{}-{:03d}', a + 20, n_nationkey))) AS gold FROM (SELECT *, n_regionkey AS r FROM nation)""")
def indicator_gold(spark, sf_dir):
    """The gold chunk of every asked area and indicator, looked up in the table of pages."""
    n = table(spark, sf_dir, "nation")
    areas = spark.range(30).select(F.concat(F.lit("A"), "id").alias("area"), (F.col("id") + 20).alias("page"))
    asked = n.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("A"), F.col("n_regionkey") * 5, F.lit(";A"), F.col("n_regionkey") * 5 + 1).alias("area"))
    rows = asked.select("qid", F.explode(F.split("area", ";")).alias("area")).join(areas, "area")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.format_string("N%d-%03d", "page", "qid"))).alias("gold"))


@query(f"""WITH {_E} SELECT user_id AS qid, any_value(event_id) FILTER (model = 'u0' AND r = 1) AS u0, any_value(event_id) FILTER (model = 'u1' AND r = 1) AS u1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY event_id DESC) AS r FROM e) GROUP BY user_id""")
def rewrites_by_model(spark, sf_dir):
    """The last reply of each model to each question, one column a model."""
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("qid")).pivot("model", ["u0", "u1"]).agg(F.max("event_id"))


@query("""SELECT s_suppkey, form, 'q ' || form || ' ' || s_suppkey AS question FROM supplier, (SELECT unnest(['english', 'hinglish', 'hindi', 'typo']) AS form) WHERE NOT (form = 'typo' AND s_suppkey % 2 = 0)""")
def question_forms(spark, sf_dir):
    """A column for each form of a question unpivoted, empty ones left out."""
    forms = ["english", "hinglish", "hindi", "typo"]
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", *(F.when(~((F.lit(f) == "typo") & (F.col("s_suppkey") % 2 == 0)), F.concat(F.lit(f"q {f} "), "s_suppkey")).alias(f) for f in forms))
    return wide.unpivot(["s_suppkey"], forms, "form", "question").filter("question is not null")
