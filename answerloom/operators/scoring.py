"""Scoring of answers: facts, citations, statements, measures, cards, trade-off, diagnosis, text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import arrow, text as T
from answerloom.sources.tables import table

# Fixed value: the share of facts from which an answer is right.
TAU = 0.5
# Stages at which a question can be lost, in order.
STAGES = ["key", "index", "retrieval", "gate", "context", "llm_refused", "llm_incomplete", "over_answer", "ok"]


def facts_found(facts: Column, text: Column) -> Column:
    """The facts that a text holds."""
    return F.filter(facts, lambda f: T.fact_found(f, T.key_words(text), T.numbers(text)))


def statements(answer: Column) -> Column:
    """(text, cites) of every statement; without its own citation it takes the next one's on the same line."""
    cut = F.transform(F.split(answer, "\n"), lambda line: F.filter(
        F.transform(F.split(line, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.struct(F.regexp_replace(F.regexp_replace(s, T.CITATION, ""), r"^[ \-*•|#>]+|[ \-*•|#>]+$", "").alias("text"), T.citations(s).alias("cites"))),
        lambda x: (F.size(T.key_words(x["text"])) >= 2) | ((F.size(T.key_words(x["text"])) > 0) & (F.size(T.numbers(x["text"])) > 0)),
    ))
    none = F.array().cast("array<int>")
    def inherited(line: Column) -> Column:
        return F.transform(line, lambda x, i: F.struct(x["text"].alias("text"), F.coalesce(F.get(F.filter(F.slice(line, i + 1, F.size(line)), lambda y: F.size(y["cites"]) > 0), 0)["cites"], none).alias("cites")))

    return F.flatten(F.transform(cut, inherited))


def score_answers(rows: DataFrame) -> DataFrame:
    """Adds refused, llm_label, facts_in_prompt, correctness, statements, cite_recall, cite_precision, error.

    Needs answer, action, expected, prompt, sources (array of texts). Whether a question can be answered is judged on its
    prompt. Built-in expressions only; nothing is exploded or shuffled.
    """
    available = F.when(F.col("expected").isNotNull(), facts_found(T.facts("expected"), F.col("prompt"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"refused": T.refused("answer", "action"), "aw_available": available})
    rows = rows.withColumns(
        {
            "llm_label": F.when(F.size("aw_available") > 0, "answerable").otherwise("unanswerable"),
            "facts_in_prompt": F.size("aw_available"),
            "correctness": F.when(~F.col("refused") & (F.size("aw_available") > 0), F.bround(F.size(facts_found(F.col("aw_available"), F.col("answer"))) / F.size("aw_available"), 2)),
            "aw_parts": F.when(F.col("refused"), F.array().cast("array<struct<text:string,cites:array<int>>>")).otherwise(statements(F.col("answer"))),
        }
    )
    holds = lambda s, src: F.size(facts_found(F.array(s), src)) > 0
    cited = lambda x: F.transform(F.filter(x["cites"], lambda n: (n >= 1) & (n <= F.size("sources"))), lambda n: F.get("sources", n - 1))
    judged = F.transform(F.col("aw_parts"), lambda x: F.struct(F.size(cited(x)).alias("n"), ((F.size(cited(x)) > 0) & holds(x["text"], F.array_join(cited(x), " "))).alias("supported"), F.size(F.filter(cited(x), lambda src: holds(x["text"], src))).alias("precise"), ((F.size(cited(x)) > 0)).alias("valid")))
    rows = rows.withColumn("aw_judged", judged)
    total = lambda field: F.aggregate(F.col("aw_judged"), F.lit(0), lambda a, x: a + x[field].cast("int"))
    rows = rows.withColumns({"statements": F.size("aw_judged"), "cite_recall": F.try_divide(total("supported"), F.size("aw_judged")), "cite_precision": F.coalesce(F.try_divide(total("precise"), total("n")), F.when(F.size("aw_judged") > 0, 0.0)), "all_cited": (F.size("aw_judged") > 0) & F.forall("aw_judged", lambda x: x["valid"])})
    error = (
        F.when((F.col("llm_label") == "answerable") & F.col("refused"), "unwarranted refusal")
        .when((F.col("llm_label") == "unanswerable") & ~F.col("refused"), "over-responsiveness")
        .when(F.col("correctness") < TAU, "inaccurate answer")
        .when(F.col("cite_recall") < TAU, "improper citation")
        .otherwise("")
    )
    return rows.withColumn("error", error).drop("aw_available", "aw_parts", "aw_judged")


def rule_checks(scored: DataFrame) -> DataFrame:
    """Adds five nullable columns, one for each rule of a prompt; null where a rule does not apply. Needs question."""
    answered = ~F.col("refused")
    mode = T.answer_mode("question")
    known = F.array_union(T.numbers("prompt"), T.numbers("question"))
    return scored.withColumns(
        {
            "rule_refuse_only_when_nothing": F.col("refused") == (F.col("llm_label") == "unanswerable"),
            "rule_sources_only": F.when(answered, F.size(F.array_except(T.numbers("answer"), known)) == 0),
            "rule_cite_every_statement": F.when(answered, F.col("all_cited")),
            "rule_length_fits": F.when(answered, F.when(mode == "short", F.col("statements") <= 3).otherwise(T.bullet_count("answer") >= 2)),
            "rule_complete_list": F.when(answered & (mode == "long") & F.col("correctness").isNotNull(), F.col("correctness") >= TAU),
        }
    )


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def scorecards(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: percent right on what can be answered, percent answered on what cannot, mean citation recall, n."""
    right = F.avg(F.when(F.col("llm_label") == "answerable", F.when(F.col("correctness") >= TAU, 100.0).otherwise(0.0)))
    over = F.avg(F.when(F.col("llm_label") == "unanswerable", F.when(F.col("refused"), 0.0).otherwise(100.0)))
    return scored.groupBy(*by).agg(F.round(right, 1).alias("correct_pct"), F.round(over, 1).alias("over_answer_pct"), F.round(100 * F.avg(F.when(~F.col("refused"), F.col("cite_recall"))), 1).alias("cited_pct"), F.count(F.lit(1)).alias("n"))


def trust(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: trust score and its three parts, from one aggregation."""
    able, said = F.col("llm_label") == "answerable", ~F.col("refused")
    n = lambda c: F.count_if(c)
    agg = scored.groupBy(*by).agg(
        n(said & able).alias("sa"), n(said).alias("s"), n(able).alias("a"), n(~said & ~able).alias("ru"), n(~said).alias("r"), n(~able).alias("u"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(said & able, F.col("correctness"))).alias("cp"), F.sum(F.when(said & able, F.col("correctness"))).alias("cs"),
        F.avg(F.when(said & (F.col("statements") > 0), F.col("cite_precision"))).alias("gp"), F.avg(F.when(said & (F.col("statements") > 0), F.col("cite_recall"))).alias("gr"),
    )
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    refusal = (f1(over("sa", "s"), over("sa", "a")) + f1(over("ru", "r"), over("ru", "u"))) / 2
    correct = f1(F.coalesce("cp", F.lit(0.0)), F.coalesce("cs", F.lit(0.0)) / F.greatest("a", F.lit(1)))
    cites = F.coalesce(f1(F.col("gp"), F.col("gr")), F.lit(0.0))
    return agg.select(*by, F.round((refusal + correct + cites) / 3, 3).alias("trust"), F.round(refusal, 3).alias("f1_refusal"), F.round(correct, 3).alias("f1_correct"), F.round(cites, 3).alias("f1_citation"), (F.col("s") - F.col("sa")).alias("over_answer"), (F.col("a") - F.col("sa")).alias("over_refusal"), "n")


def trade_off(scored: DataFrame, by: list[str], p: float = 0.7, ks=(1, 2, 3), chosen: int = 3) -> DataFrame:
    """Cost per hundred questions of misses and over-answers at several weights, place by the chosen one, break-even weight."""
    over = F.avg(F.when(F.col("llm_label") == "unanswerable", F.when(F.col("refused"), 0.0).otherwise(1.0)))
    cards = scorecards(scored, by).join(scored.groupBy(*by).agg(over.alias("over")), by).filter("over is not null")
    cards = cards.withColumns({"miss_cost": 100 * F.lit(p) * (1 - F.col("correct_pct") / 100), "over_cost": 100 * (1 - F.lit(p)) * F.col("over")})
    cards = cards.withColumns({f"cost_{k}": F.round(F.col("miss_cost") + F.col("over_cost") * k, 1) for k in ks})
    best = cards.orderBy(f"cost_{chosen}", F.desc("cited_pct"), *by).limit(1).select(F.col("miss_cost").alias("best_miss"), F.col("over_cost").alias("best_over"))
    even = F.when(F.col("over_cost") > F.col("best_over"), F.round((F.col("best_miss") - F.col("miss_cost")) / (F.col("over_cost") - F.col("best_over")), 2))
    return cards.crossJoin(F.broadcast(best)).select(*by, *(f"cost_{k}" for k in ks), even.alias("beats_if_k_below"))


def lost_at() -> Column:
    """The first stage at which a question failed; needs label, action, refused and correct (arrays, one entry a run), facts_*."""
    to_model = F.col("action").isin("answer", "answer_with_note")
    return (
        F.when(F.col("label") != "answerable", F.when(~to_model | F.forall("refused", lambda x: x), "ok").otherwise("over_answer"))
        .when(F.col("facts_total") == 0, "key")
        .when(F.col("facts_in_index") == 0, "index")
        .when(F.col("facts_in_hits") == 0, "retrieval")
        .when(~to_model, "gate")
        .when(F.col("facts_in_prompt") == 0, "context")
        .when(F.forall("correct", lambda x: x), "ok")
        .when(F.exists("refused", lambda x: x), "llm_refused")
        .otherwise("llm_incomplete")
    )


def stage_counts(lost: DataFrame) -> DataFrame:
    """Questions per stage in the fixed order, zero where none was lost."""
    stages = lost.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STAGES)], "place int, lost_at string")
    return stages.join(lost.groupBy("lost_at").agg(F.count(F.lit(1)).alias("n")), "lost_at", "left").select("place", "lost_at", F.coalesce("n", F.lit(0)).alias("n"))


def token_f1(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, token_f1: overlap of the words of two texts, counted with their repeats; words are counted by groups, so texts may be long."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    side = lambda c, i: rows.select(key, F.explode(words(c)).alias("w"), F.lit(i).alias("side"))
    counts = side(a, 0).unionByName(side(b, 1)).groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    sums = counts.groupBy(key).agg(F.round(2 * F.sum(F.least("x", "y")) / F.sum(F.col("x") + F.col("y")), 6).alias("token_f1"))
    return rows.select(key).join(sums, key, "left").select(key, F.coalesce("token_f1", F.lit(0.0)).alias("token_f1"))


def common_answers(rows: DataFrame, model: str, key: list[str]) -> DataFrame:
    """The rows whose key every model has."""
    n = rows.agg(F.count_distinct(model).alias("n"))
    full = rows.groupBy(*key).agg(F.count_distinct(model).alias("m")).crossJoin(F.broadcast(n)).filter("m = n").select(*key)
    return rows.join(full, key, "left_semi")


def answers(spark, sf_dir) -> DataFrame:
    """Answers for scoring made of the conversations: every assistant turn answers the turn before it, under two models."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("question", before).filter("role = 'assistant' and question is not null")
    short = F.regexp_replace("text", r"[\n;]", " ")
    refuse = F.col("conv_id") % 4 == 0
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"),
        F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"),
        "question",
        F.when(refuse, T.NOT_FOUND).otherwise(F.concat("text", F.lit(" [1]"))).alias("answer"),
        F.lit("answer").alias("action"),
        F.when(F.col("turn") % 5 == 1, short).otherwise(F.col("question")).alias("expected"),
        F.col("text").alias("prompt"),
        F.array("text").alias("sources"),
    )


@query()
def scored_answers(spark, sf_dir):
    """All measures and rules of every answer (held against a plain version in the tests)."""
    return rule_checks(score_answers(answers(spark, sf_dir))).drop("prompt", "sources", "question", "expected", "answer")


def measured(spark, sf_dir) -> DataFrame:
    """Measures per document for the boards: models are sources, what can be answered and refused follows the labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        "doc_id", F.col("source").alias("model"), F.col("lang").alias("version"), F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable").alias("llm_label"), (F.col("toxic") == 1).alias("refused"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("doc_id") % 5 / 4).alias("correctness"), (F.col("doc_id") % 4).alias("statements"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 3 / 2).alias("cite_recall"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7 / 6).alias("cite_precision"),
    )


MEASURED = """m AS (SELECT doc_id, source AS model, lang AS version, CASE WHEN quality = 1 THEN 'answerable' ELSE 'unanswerable' END AS llm_label, toxic = 1 AS refused, CASE WHEN quality = 1 AND toxic = 0 THEN doc_id % 5 / 4 END AS correctness, doc_id % 4 AS statements,
CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 / 2 END AS cite_recall, CASE WHEN doc_id % 4 > 0 THEN doc_id % 7 / 6 END AS cite_precision FROM documents JOIN labels USING (doc_id))"""
CARDS = "c AS (SELECT model, round(avg(CASE WHEN llm_label = 'answerable' THEN CASE WHEN correctness >= 0.5 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END), 1) AS correct_pct, round(avg(CASE WHEN llm_label = 'unanswerable' THEN CASE WHEN refused THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END END), 1) AS over_answer_pct, round(100 * avg(CASE WHEN NOT refused THEN cite_recall END), 1) AS cited_pct, count(*) AS n, avg(CASE WHEN llm_label = 'unanswerable' THEN CASE WHEN refused THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END) AS over_rate FROM m GROUP BY model)"


@query(f"WITH {MEASURED}, {CARDS} SELECT model, correct_pct, over_answer_pct, cited_pct, n FROM c")
def scorecard(spark, sf_dir):
    return scorecards(measured(spark, sf_dir), ["model"])


_F1 = "CASE WHEN coalesce({0} + {1}, 0) = 0 THEN 0 ELSE 2 * {0} * {1} / ({0} + {1}) END"


@query(f"""WITH {MEASURED}, g AS (SELECT model, count(*) FILTER (NOT refused AND llm_label = 'answerable') AS sa, count(*) FILTER (NOT refused) AS s, count(*) FILTER (llm_label = 'answerable') AS a, count(*) FILTER (refused AND llm_label <> 'answerable') AS ru, count(*) FILTER (refused) AS r, count(*) FILTER (llm_label <> 'answerable') AS u, count(*) AS n,
coalesce(avg(correctness) FILTER (NOT refused AND llm_label = 'answerable'), 0) AS cp, coalesce(sum(correctness) FILTER (NOT refused AND llm_label = 'answerable'), 0) AS cs, avg(cite_precision) FILTER (NOT refused AND statements > 0) AS gp, avg(cite_recall) FILTER (NOT refused AND statements > 0) AS gr FROM m GROUP BY model),
f AS (SELECT *, ({_F1.format('(sa / greatest(s, 1))', '(sa / greatest(a, 1))')} + {_F1.format('(ru / greatest(r, 1))', '(ru / greatest(u, 1))')}) / 2 AS x, {_F1.format('cp', '(cs / greatest(a, 1))')} AS y, {_F1.format('gp', 'gr')} AS z FROM g)
SELECT model, round((x + y + z) / 3, 3) AS trust, round(x, 3) AS f1_refusal, round(y, 3) AS f1_correct, round(z, 3) AS f1_citation, s - sa AS over_answer, a - sa AS over_refusal, n FROM f""")
def trust_scores(spark, sf_dir):
    return trust(measured(spark, sf_dir), ["model"])


@query(f"""WITH {MEASURED}, {CARDS}, k AS (SELECT *, 100 * 0.7::DOUBLE * (1 - correct_pct / 100) AS mc, 100 * (1 - 0.7::DOUBLE) * over_rate AS oc FROM c WHERE over_rate IS NOT NULL),
e AS (SELECT *, round(mc + oc, 1) AS cost_1, round(mc + oc * 2, 1) AS cost_2, round(mc + oc * 3, 1) AS cost_3 FROM k), b AS (SELECT mc AS bm, oc AS bo FROM e ORDER BY cost_3 NULLS FIRST, cited_pct DESC NULLS LAST, model LIMIT 1)
SELECT model, cost_1, cost_2, cost_3, CASE WHEN oc > bo THEN round((bm - mc) / (oc - bo), 2) END AS beats_if_k_below FROM e, b""")
def trade_offs(spark, sf_dir):
    return trade_off(measured(spark, sf_dir), ["model"])


RULES = ("rule_refuse_only_when_nothing", "rule_sources_only", "rule_cite_every_statement", "rule_length_fits", "rule_complete_list")


def rates(checked: DataFrame, by: list[str]) -> DataFrame:
    """Per group the share (3 places) of answers that follow each rule, among those it applies to."""
    return checked.groupBy(*by).agg(*(F.round(F.avg(F.col(r).cast("int")), 3).alias(r) for r in RULES))


@query("""WITH c AS (SELECT source AS model, doc_id % 2 = 0 AS a, CASE WHEN doc_id % 3 > 0 THEN doc_id % 4 > 0 END AS b, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 > 2 END AS c, CASE WHEN doc_id % 2 = 1 THEN doc_id % 3 = 0 END AS d, CASE WHEN doc_id % 4 = 3 THEN doc_id % 9 > 1 END AS e FROM documents)
SELECT model, round(avg(a::INT), 3) AS rule_refuse_only_when_nothing, round(avg(b::INT), 3) AS rule_sources_only, round(avg(c::INT), 3) AS rule_cite_every_statement, round(avg(d::INT), 3) AS rule_length_fits, round(avg(e::INT), 3) AS rule_complete_list FROM c GROUP BY model""")
def rule_rates(spark, sf_dir):
    """Shares of the five rules for answers made of documents, some of them beyond a rule (scored_answers checks the rules themselves)."""
    i = F.col("doc_id")
    each = (i % 2 == 0, F.when(i % 3 > 0, i % 4 > 0), F.when(i % 5 > 0, i % 7 > 2), F.when(i % 2 == 1, i % 3 == 0), F.when(i % 4 == 3, i % 9 > 1))
    return rates(table(spark, sf_dir, "documents").select(F.col("source").alias("model"), *(c.alias(r) for r, c in zip(RULES, each, strict=True))), ["model"])


_LOST = """l AS (SELECT doc_id, CASE WHEN quality = 0 THEN CASE WHEN doc_id % 5 = 0 OR toxic = 1 THEN 'ok' ELSE 'over_answer' END WHEN doc_id % 11 = 0 THEN 'key' WHEN doc_id % 7 = 0 THEN 'index' WHEN doc_id % 3 = 0 THEN 'retrieval' WHEN doc_id % 5 = 0 THEN 'gate' WHEN doc_id % 13 = 0 THEN 'context' WHEN doc_id % 2 = 0 THEN 'ok' WHEN toxic = 1 THEN 'llm_refused' ELSE 'llm_incomplete' END AS lost_at FROM documents JOIN labels USING (doc_id))"""


def _diagnosed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.select(
        "doc_id", F.when(F.col("quality") == 1, "answerable").otherwise("unanswerable").alias("label"), F.when(F.col("doc_id") % 5 == 0, "reject").otherwise("answer").alias("action"), F.array(F.col("toxic") == 1, F.col("toxic") == 1).alias("refused"),
        F.array(F.col("doc_id") % 2 == 0, F.lit(True)).alias("correct"), (F.col("doc_id") % 11).alias("facts_total"), (F.col("doc_id") % 7).alias("facts_in_index"), (F.col("doc_id") % 3).alias("facts_in_hits"), (F.col("doc_id") % 13).alias("facts_in_prompt"),
    )
    return d.select("doc_id", lost_at().alias("lost_at"))


@query(f"WITH {_LOST} SELECT * FROM l")
def lost_stages(spark, sf_dir):
    return _diagnosed(spark, sf_dir)


@query(f"WITH {_LOST}, s(place, lost_at) AS (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)})' for i, s in enumerate(STAGES))}) SELECT place, lost_at, count(doc_id) AS n FROM s LEFT JOIN l USING (lost_at) GROUP BY ALL")
def stage_table(spark, sf_dir):
    return stage_counts(_diagnosed(spark, sf_dir))


@query(r"""WITH t AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 2)) AS n, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 4 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in T.FACT_STOP) + r""")), lambda w: left(w, 6))) AS k FROM t)
SELECT doc_id, CAST(len(n) AS INT) AS n_numbers, CAST(len(k) AS INT) AS n_words, md5(array_to_string(list_sort(k), ' ')) AS words_md5 FROM n WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '\d[\s\x{a0}\x{2009}\x{202f}]\d{3}\b'))""")
def fact_parts(spark, sf_dir):
    """Numbers and key words of all texts but those with a spaced thousand, which the other engine cannot join."""
    docs = table(spark, sf_dir, "documents").filter(~F.col("text").rlike("\\d[\\s   ]\\d{3}\\b"))
    return docs.select("doc_id", F.size(T.numbers("text")).alias("n_numbers"), F.size(T.key_words("text")).alias("n_words"), F.md5(F.array_join(F.array_sort(T.key_words("text")), " ")).alias("words_md5"))


@query(r"""WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, ';|:|\.\s|\s-\s|\(\d\)', chr(1), 'g'), chr(1)) AS p FROM documents)
SELECT doc_id, CAST(len(list_filter(p, lambda x: len(list_filter(regexp_extract_all(lower(x), '[a-z]+'), lambda w: length(w) >= 4 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in T.FACT_STOP) + r"""))) > 0 OR len(list_filter(regexp_extract_all(x, '\d[\d,]*(?:\.\d+)?'), lambda y: length(replace(y, ',', '')) >= 2)) > 0)) AS INT) AS facts, CAST(len(regexp_extract_all(text, '(?m)^\s*(?:[-*•]|\d+[.)]|\|)')) AS INT) AS bullets FROM p""")
def bullets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.facts("text")).alias("facts"), T.bullet_count("text").alias("bullets"))


@query(r"""WITH t AS (SELECT conv_id, turn, 'x ' || regexp_replace(text, '[.]', ' [' || turn || ', ' || (turn + 2) || '-' || (turn + conv_id % 4) || '].', 'g') AS t FROM conversations),
g AS (SELECT conv_id, turn, len(regexp_extract_all(t, '\[[^\]]*\]')) AS n FROM t)
SELECT conv_id, turn, CAST(n AS INT) AS n_marks, flatten(list_transform(range(n), lambda i: list_concat([turn], range(turn + 2, turn + conv_id % 4 + 1)))) AS cites FROM g""")
def citation_parse(spark, sf_dir):
    """Every full stop of every turn becomes a citation of one source and of a range, which may be the wrong way round."""
    mark = F.concat(F.lit(" ["), "turn", F.lit(", "), F.col("turn") + 2, F.lit("-"), F.col("turn") + F.col("conv_id") % 4, F.lit("]."))
    t = F.concat(F.lit("x "), F.replace("text", F.lit("."), mark))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count(t, F.lit(T.CITATION)).alias("n_marks"), F.transform(T.citations(t), lambda c: c.cast("long")).alias("cites"))


@query(f"""SELECT conv_id, turn, starts_with(lower(trim(text)), '{T.NOT_FOUND.lower()}') OR ends_with(lower(trim(text)), '{T.NOT_FOUND.lower()}') OR (len(regexp_split_to_array(lower(trim(text)), '\\s+')) <= 25 AND ({' OR '.join(f"contains(lower(text), '{p}')" for p in T.REFUSALS)})) AS refused, CASE WHEN regexp_matches(text, '{T.LONG_REQUEST}') THEN 'long' ELSE 'short' END AS mode
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id || ' is not mentioned, list nothing' ELSE text END AS text FROM conversations)""")
def refusals(spark, sf_dir):
    t = F.when(F.col("turn") % 3 == 0, F.concat("conv_id", F.lit(" is not mentioned, list nothing"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").withColumn("text", t).select("conv_id", "turn", T.refused("text").alias("refused"), T.answer_mode("text").alias("mode"))


def _pairs(spark, sf_dir):
    """Benchmark items beside the documents with the same number, as expected and given answers."""
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.col("text").alias("expected")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, 0 AS side FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents) UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(d.text), '[a-z0-9]+')), 1 FROM documents d JOIN benchmark b ON d.doc_id = b.item_id),
c AS (SELECT item_id, w, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM w GROUP BY ALL)
SELECT item_id, round(2 * sum(least(x, y)) / sum(x + y), 6) AS token_f1 FROM c GROUP BY item_id""")
def token_overlap(spark, sf_dir):
    return token_f1(_pairs(spark, sf_dir), "item_id", "answer", "expected")


@query()
def text_metrics(spark, sf_dir):
    """ROUGE-L and BLEU of the same pairs (held against plain versions in the tests)."""
    plain = T.without_citations("answer")
    return _pairs(spark, sf_dir).select("item_id", F.round(arrow.rouge_l(plain, F.col("expected")), 6).alias("rouge_l"), F.round(arrow.bleu(plain, F.col("expected")), 6).alias("bleu"), (plain == "").alias("empty"))


@query("""WITH u AS (SELECT DISTINCT event_type AS model, user_id FROM events), n AS (SELECT count(DISTINCT model) AS n FROM u), f AS (SELECT user_id FROM u GROUP BY user_id HAVING count(DISTINCT model) = (SELECT n FROM n))
SELECT model, user_id FROM u SEMI JOIN f USING (user_id)""")
def common_keys(spark, sf_dir):
    """Users that every event type has (relational division)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "user_id").distinct()
    return common_answers(rows, "model", ["user_id"])


@query("""SELECT c AS cut_off, count(*) FILTER (label = 1 AND score >= c) AS passed, count(*) FILTER (label = 0 AND score < c) AS blocked, count(*) AS n FROM (SELECT (user_id % 40) / 2 - 12 AS score, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS label FROM events), (SELECT unnest(range(41)) * 0.5::DOUBLE - 12 AS c) GROUP BY c""")
def threshold_sweep(spark, sf_dir):
    """41 cut-offs from -12 to 8: each score gives one row per half step to a histogram first, and only that meets the cut-offs."""
    scores = table(spark, sf_dir, "events").select((F.col("user_id") % 40 / 2 - 12).alias("score"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("label"))
    histogram = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no"))
    cuts = histogram.withColumn("cut_off", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i * 0.5 - 12)))
    return cuts.groupBy("cut_off").agg(F.sum(F.when(F.col("score") >= F.col("cut_off"), F.col("yes")).otherwise(0)).alias("passed"), F.sum(F.when(F.col("score") < F.col("cut_off"), F.col("no")).otherwise(0)).alias("blocked"), F.sum(F.col("yes") + F.col("no")).alias("n"))


@query("""SELECT lang, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def crosstab(spark, sf_dir):
    """Languages against labels with margins."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("lang").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT doc_id, correct FROM (SELECT doc_id, (doc_id % 5) / 4 AS correct FROM documents)), n AS (SELECT doc_id, correct + CASE WHEN doc_id % 9 = 0 THEN 0.1::DOUBLE ELSE 1e-12::DOUBLE END AS correct FROM o UNION ALL SELECT -1 - item_id, 0.5 FROM benchmark)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM o FULL JOIN n USING (doc_id) WHERE o.correct IS NULL OR n.correct IS NULL OR abs(o.correct - n.correct) > 1e-9""")
def regression_diff(spark, sf_dir):
    """Answers whose measure differs between two runs beyond rounding, or which one run lacks."""
    old = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5 / 4).alias("a"))
    more = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(0.5).alias("b"))
    new = old.select("doc_id", (F.col("a") + F.when(F.col("doc_id") % 9 == 0, 0.1).otherwise(1e-12)).alias("b")).unionByName(more)
    state = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").otherwise("changed")
    return old.join(new, "doc_id", "full").filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > 1e-9)).select("doc_id", state.alias("state"))


@query("""WITH k AS (SELECT o_custkey, string_agg(o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '*' ELSE '' END, '; ' ORDER BY o_orderkey) AS gold FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
g AS (SELECT o_custkey, unnest(regexp_extract_all(gold, '[0-9]+\\*?')) AS g FROM k), h AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, min(rank) AS gold_rank FROM h JOIN g USING (o_custkey) WHERE hit = g OR (ends_with(g, '*') AND starts_with(hit, left(g, length(g) - 1))) GROUP BY o_custkey""".replace("\\\\", "\\"))
def gold_rank(spark, sf_dir):
    """Rank of the first hit that equals a gold id or starts with a gold prefix."""
    orders = table(spark, sf_dir, "orders")
    gold = orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "*").otherwise("")).alias("g"))
    hits = orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("hit"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    match = (F.col("hit") == F.col("g")) | (F.endswith("g", F.lit("*")) & F.startswith("hit", F.expr("left(g, length(g) - 1)")))
    return hits.join(gold, "o_custkey").filter(match).groupBy("o_custkey").agg(F.min("rank").cast("long").alias("gold_rank"))
