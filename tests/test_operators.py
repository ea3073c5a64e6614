"""Operators held against plain versions on small fixtures."""

import difflib
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from answerloom import catalog
from answerloom.functions import arrow, text as T
from answerloom.operators import chunking as C, cleaning as K, comparison as M, extraction as E, gate as G, prompts as P, question as Q, retrieval as R, scoring as S, sections as X
from answerloom.plans import runs, settings
from answerloom.sources import tables
from answerloom.streaming import turns
from tests.conftest import SF, same


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "One. Two? three! Four", "See Dr. Who. It is No. 5 today. (Yes) it is.", "A.B. Smith came. He left", "x" * 50])
def test_sentences(spark, text):
    assert one(spark, T.sentences("t"), t=text) == C.cut_sentences(text)


def test_numbers_and_facts(spark):
    assert one(spark, T.numbers("t"), t="1 200 people, 3,400.5 and 7, 12") == ["1200", "3400.5", "12"]
    assert one(spark, T.numbers("t"), t="") == []
    assert one(spark, T.facts("t"), t="posts filled: 45; a b; salary 2,000") == ["posts filled", "45", "salary 2,000"]
    found = S.facts_found(T.facts("e"), F.col("a"))
    assert one(spark, found, e="posts filled: 45; salary 2,000", a="All posts were filled with 45") == ["posts filled", "45"]


def test_citations_and_statements(spark):
    assert one(spark, T.citations("t"), t="a [4], b [1, 3] c [1-3] d 【2†L1-L5】 e [9-8]") == [4, 1, 3, 1, 2, 3, 2]
    rows = one(spark, S.statements(F.col("t")), t="The posts were filled early. Salary rose by 20 percent [2].\nNothing cited here either.")
    assert [(r.text, r.cites) for r in rows] == [("The posts were filled early.", [2]), ("Salary rose by 20 percent .", [2]), ("Nothing cited here either.", [])]


def test_refused(spark):
    for text, want in (("Not found in the guideline.", True), ("The guideline does not cover it.", True), ("It says 5.", False), ("word " * 30 + "is not mentioned", False)):
        assert one(spark, T.refused("t"), t=text) is want


def slip(a, b):
    """One letter added, dropped or changed, or two neighbours swapped."""
    if a == b:
        return False
    letters = sorted(set(b))
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in near


def test_one_edit(spark):
    words = ["", "a", "ab", "ba", "abc", "acb", "bac", "abcd", "abdc", "axcd", "aabb", "abab"]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.one_edit("a", "b").alias("x")).collect()
    assert [(r.a, r.b) for r in got if r.x != slip(r.a, r.b)] == []


def test_typo_matches(spark):
    vocab = spark.createDataFrame([("recruitment", 5), ("recruitments", 9), ("salary", 2)], "word string, n long")
    asked = spark.createDataFrame([("Recruiment",), ("salray",), ("xyz",), ("salary",)], "word string")
    assert {(r.word, r.match) for r in G.typo_matches(asked, vocab).collect()} == {("Recruiment", "recruitment"), ("salray", "salary")}


def test_grades(spark):
    rows = [(-6.0, ["X"], [], []), (1.0, ["X"], [], []), (1.0, [], ["y"], []), (1.0, [], [], ["z"]), (-0.5, [], [], []), (0.0, [], [], [])]
    df = spark.createDataFrame(rows, "best double, hard_out array<string>, soft_out array<string>, missing array<string>").withColumn("grade", G.grade()).withColumn("action", G.action())
    assert [(r.grade, r.action) for r in df.collect()] == [("I", "reject"), ("M", "scoped"), ("P", "answer_with_note"), ("P", "answer_with_note"), ("P", "answer_with_note"), ("S", "answer")]


def test_unknown_words(spark):
    q = spark.createDataFrame([("1", "Probaton kitne saal. The ICU Infosys don't महाराष्ट्र? Wrld x")], "id string, t string")
    known = spark.createDataFrame([("the",), ("saal",)], "word string")
    assert {r.word for r in G.unknown_words(q, known, "id", "t").collect()} == {"Probaton", "kitne", "महाराष्ट्र", "Wrld"}


def test_packing_limits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = C.chunk_blocks(C.document_blocks(docs)).collect()
    words = {str(d.doc_id): d.text.split() for d in docs.collect()}
    held: dict[str, set] = {}
    for c in chunks:
        held.setdefault(c.block_id, set()).update(c.text.split())
        assert c.n_chars <= C.HARD_MAX or "\n\n" not in c.text
    assert all(set(w) <= held[i] for i, w in words.items() if w)


def pieces(chunks):
    return [c["text"].split("\n\n") for c in chunks]


def test_packing_by_its_rules():
    a, b, c = "A" * 900 + ".", "B" * 900 + ".", "C" * 100 + "."
    # a small last chunk joins the one before it; pages follow
    joined = C.pack_items([("para", a, 1), ("para", b, 2), ("para", "Tail.", 3)])
    assert pieces(joined) == [[a], [b, "Tail."]] and joined[1]["pages"] == [2, 3]
    # no chunk without a body, and a short block is whole
    assert C.pack_items([("heading", "Only", 1)]) == [] and C.pack_items([("heading", "Only", 1), ("table", "t", 1)]) == []
    assert pieces(C.pack_items([("heading", "Title", 1), ("para", "Short.", 1)])) == [["Title", "Short."]]
    # a heading opens a chunk once the one before it has enough, the first is the block's own title
    some = C.pack_items([("heading", "Title", 1), ("para", a, 1), ("heading", "Second", 2), ("para", b, 2)])
    assert pieces(some) == [["Title", a], ["Second", b]] and [x["sub_heading"] for x in some] == [None, "Second"]
    some = C.pack_items([("para", c, 1), ("heading", "Early", 1), ("para", a, 1), ("para", b, 1)])
    assert pieces(some)[0] == [c, "Early"] or pieces(some)[0][0] == c
    # the last sentence is said again where it is short
    first = "One long sentence " + "x" * 700 + ". A short end."
    some = C.pack_items([("para", first, 1), ("para", "B" * 800 + ".", 2)])
    assert some[1]["overlap"] == "A short end." and pieces(some)[1][0] == "A short end." and some[1]["pages"] == [2]
    # headings at the end stay with the last chunk; a small first chunk joins the next
    assert pieces(C.pack_items([("para", a, 1), ("para", b, 1), ("heading", "End", 1)]))[-1] == [b, "End"]
    long = C.pack_items([("list", "- " + "y" * 1500, 1), ("para", "w " * 1200, 2)])
    assert all(len(x["text"]) <= C.HARD_MAX for x in long) and pieces(long)[0] == ["- " + "y" * 1500]
    assert C.runs_of_words("w" * 1200 + " ab " + "v" * 999) == ["w" * 1200, "ab", "v" * 999]
    assert C.runs_of_words("") == [] and C.runs_of_words("a b") == ["a b"]


def test_paths_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, 99)]
    got = {r.id: r for r in E.ancestor_paths(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert len(got) == 41 and all(got[i].root == 0 and got[i].path == list(range(i + 1)) for i in range(40)) and got[100].root == 100
    with pytest.raises(ValueError, match="cycle"):
        E.ancestor_paths(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), 6)


def test_strata_with_quotas(spark):
    rows = [(i, "rare") for i in range(3)] + [(100 + i, "common") for i in range(997)] + [(2000 + i, None) for i in range(20)]
    got = runs.stratified_sample(spark.createDataFrame(rows, "id long, s string"), ["s"], "id", 0.1, 7).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"common": 100, None: 2}


def closest(word, vocab):
    found = [(difflib.SequenceMatcher(None, v, word, autojunk=False).ratio(), v) for v in vocab]
    return max((x for x in found if x[0] >= 0.8), default=(0, None))[1]


def test_word_fixes(spark):
    vocab = ["recruitment", "salary", "nurse", "nurses", "doctor", "district", "then", "than", "probation", "letters", "letter"]
    asked = ["recruiment", "salray", "nures", "docter", "distrct", "thne", "probaton", "lettres", "zzzz", "abc"]
    df = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
    got = {r.word: r.match for r in Q.word_fixes(df(asked), df(vocab)).collect()}
    assert got == {w: m for w in asked if len(w) >= 4 and (m := closest(w, vocab))}
    q = spark.createDataFrame([(1, "Probaton of the Salray in SALRAY, salray?"), (2, "")], "item_id long, text string")
    rows = {r.item_id: r for r in Q.fixed_questions(q, df(vocab), df(["the", "of", "in"])).collect()}
    assert rows[1].fixed == "Probation of the Salray in SALRAY, salary?" and [tuple(c) for c in rows[1].changes] == [("Probaton", "Probation"), ("salray", "salary")] and rows[2].fixed == ""


def test_spelling_query_against_brute_force(spark):
    got = {r.word: r.match for r in Q.spelling_fixes(spark, SF).collect()}
    vocab = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in re.findall("[a-z]+", r.text.lower())}
    noisy = Q.with_slips(spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    asked = sorted({w for r in noisy for w in re.findall("[a-z]+", r.noisy.lower())} - vocab)
    for w in asked[::12]:
        assert got.get(w) == (closest(w, vocab) if len(w) >= 4 else None), w


def test_prepared_questions(spark):
    rows = {r.item_id: r for r in Q.prepared_questions(spark, SF).collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert set(rows) == set(asked)
    for i, r in rows.items():
        if i % 20 == 19:
            assert r.error == "no question" and r.action is None
            continue
        assert r.action == {"I": "reject", "M": "scoped", "P": "answer_with_note", "S": "answer"}[r.final] and (r.final == r.first or r.first == "P")
        assert len(r.hits) == len(set(r.hits)) <= 5 and bool(r.fixed_answer) == (r.action in ("reject", "scoped")) and (r.final == "P") >= bool(r.notes)
    assert any(r.n_changes for r in rows.values() if r.n_changes is not None)


def test_letter_lines(spark):
    sentence = "it is hoped that you will be able to send the lists in time"
    text = ["D.O. No. 5", "Government of India", "Dear Sir", sentence, "Page 1 of 2", "Yours sincerely", "a stamp", sentence, "Yours faithfully", "end"]
    rows = [("L", i, 1 if i < 7 else 2, t) for i, t in enumerate(text)]
    got = [r.label for r in K.letter_labels(spark.createDataFrame(rows, "l string, n int, page int, text string"), "l", "n", "page").orderBy("n").collect()]
    assert got == ["letterhead: D.O. no", "letterhead: before body", "letterhead: greeting", "", "letterhead: page no", "sign-off: yours", "after sign-off", "", "", ""]
    assert one(spark, K.fixed_ocr(F.col("t")), t='On 21* April, 11" May, 3° June and 22"4 July\n\n| hope 5* x\n\ne All of it\n\n» so') == "On 21st April, 11th May, 3rd June and 22nd July\n\nI hope 5* x\n\n- All of it\n\nso"


def test_pairs_by_place(spark):
    wanted = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 6.0), (1, 12, 3, 50.0), (2, 13, 1, 0.0)], "page long, id long, place long, at double")
    found = spark.createDataFrame([(1, 20, 7.0), (1, 21, 40.0)], "page long, id long, at double")
    assert {(r.id, r.paired) for r in K.paired_by_place(wanted, found).collect()} == {(10, 20), (11, 21), (12, None), (13, None)}


def test_section_starts(spark):
    got = {(r.doc_id, r.entry): r.start for r in X.section_start_lines(spark, SF).collect()}
    want, by = {}, {}
    for r in X._scored(spark, SF).collect():
        by.setdefault(r.doc_id, {}).setdefault(r.entry, []).append((r.n, r.score))
    for d, entries in by.items():
        after = -1
        for e in sorted(entries):
            some = [(-s, n) for n, s in entries[e] if s > 0 and n > after]
            if some:
                after = want[d, e] = min(some)[1]
    assert got == want


def test_balanced_chunks(spark):
    rows = {}
    for r in X.balanced_sentences(spark, SF).orderBy("doc_id", "k").collect():
        rows.setdefault(r.doc_id, []).append(r["size"])
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        sentences = [s for line in d.text.split("\n") for s in C.cut_sentences(line)]
        goal = -(-len(d.text) // max(1, round(len(d.text) / 1000)))
        assert sum(rows.get(d.doc_id, [])) + max(0, len(rows.get(d.doc_id, [])) - 1) == len(" ".join(sentences))
        assert all(n <= max(goal, max(map(len, sentences))) for n in rows.get(d.doc_id, []))


def test_signals(spark):
    known = spark.createDataFrame([("rules",), ("salary",)], "word string")
    q = spark.createDataFrame([(1, "What are Rules of DRDO and Salary for 1999 and 57? In Infosys?")], "item_id int, text string")
    parts = G.strong_parts(q, known)
    assert {(r.part, r.kind) for r in parts.collect()} == {("Rules", "soft"), ("DRDO", "hard"), ("Salary", "soft"), ("1999", "number"), ("57", "number"), ("Infosys", "hard")}
    hits = spark.createDataFrame([(1, "the rules", 1.234), (1, "x", -2.0)], "item_id int, text string, score double")
    corpus = spark.createDataFrame([("rules",), ("infosys",)], "term string")
    got = G.signals(parts, hits, corpus).first()
    assert (got.best, got.hard_out, got.soft_out, got.missing) == (1.23, ["1999", "DRDO"], ["Salary"], ["Infosys"])


def test_scores_of_answers(spark):
    rows = [
        ("a", "What is the salary?", "The salary is 2000 rupees [1]. Posts were filled quickly [2].", "answer", "salary 2,000 rupees", "the salary is 2000 rupees. posts were filled quickly", ["the salary is 2000 rupees", "posts were filled"]),
        ("b", "What is the salary?", "Not found in the guideline.", "answer", "salary 2,000 rupees", "the salary is 2000 rupees", ["x"]),
        ("c", "What is the salary?", "The salary is 900 rupees.", "answer", "salary 2,000 rupees", "nothing at all", ["nothing at all"]),
        ("d", "List all steps", "- salary paid [1]\n- posts filled [1]", "answer", "salary 2,000 rupees; posts filled", "salary 2000 rupees; posts filled", ["salary 2000 rupees; posts filled"]),
    ]
    df = spark.createDataFrame(rows, "qid string, question string, answer string, action string, expected string, prompt string, sources array<string>")
    got = {r.qid: r for r in S.rule_checks(S.score_answers(df)).collect()}
    assert [(got[q].refused, got[q].llm_label, got[q].correctness, got[q].error) for q in "abcd"] == [(False, "answerable", 1.0, ""), (True, "answerable", None, "unwarranted refusal"), (False, "unanswerable", None, "over-responsiveness"), (False, "answerable", 0.5, "")]
    assert (got["a"].statements, got["a"].cite_recall, got["a"].cite_precision) == (2, 1.0, 1.0)
    assert [got[q].rule_refuse_only_when_nothing for q in "abcd"] == [True, False, False, True]
    assert (got["c"].rule_sources_only, got["a"].rule_cite_every_statement, got["c"].rule_cite_every_statement, got["d"].rule_length_fits, got["a"].rule_length_fits) == (False, True, False, True, True)
    assert got["b"].rule_sources_only is None and got["d"].rule_complete_list is True and got["a"].rule_complete_list is None


def test_diagnosis_names_a_model(spark):
    answers = spark.createDataFrame([("a",), ("b",)], "model string")
    with pytest.raises(ValueError, match="a, b"):
        M.report(answers, answers, None, 1)


def test_stems():
    pairs = "consigned consign,knackeries knackeri,communities communiti,hopping hop,hoping hope,relational relat,conditional condit,dying die,sensibility sensibl,controlling control,happy happi,kiwis kiwi,caresses caress,fluently fluentli,gas gas,ties tie,agreed agre,sky sky"
    assert [(a, arrow.stem(a)) for a, _ in (p.split() for p in pairs.split(","))] == [tuple(p.split()) for p in pairs.split(",")]


def test_calls_only_with_leave(spark):
    jobs = spark.createDataFrame([("m", "v", "1", "s", "u"), ("m", "v", "2", "s", "u")], "model string, version string, qid string, system string, user string")
    assert {r.error for r in runs.answered(jobs, lambda m: lambda s, u: {"status": 200, "text": "x"}).collect()} == {"dry run"}
    assert {r.answer for r in runs.answered(jobs, lambda m: lambda s, u: {"status": 200, "text": "42"}, True).collect()} == {"42"}
    bad = runs.answered(jobs, lambda m: lambda s, u: {"status": 400}, True).orderBy("qid").collect()
    assert bad[0].error == "status 400" and bad[1].error.startswith("stopped") and runs.waits(5, 50) == [50, 100, 120, 120]
    tries, slept = iter([{"status": 429}, {"status": 503}, {"status": 200, "text": "ok"}]), []
    assert runs.asked_with_retries(lambda: next(tries), 3, slept.append) == {"text": "ok", "error": None} and slept == [2.0, 4.0]


def digests(rows):
    return sorted((r.doc_id, r.k, r["size"], r.digest) for r in rows)


def test_listed_chunks_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()

    def runs_of(text):
        out = []
        for w in text.split():
            if out and len(out[-1]) + 1 + len(w) <= C.TARGET:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    for name, cut in ((C.sentence_chunks, C.cut_sentences), (C.hard_split, runs_of)):
        assert digests(name(spark, SF).collect()) == sorted((i, k, len(x), md5(x)) for i, t in texts.items() for k, x in enumerate(cut(t)))


def test_table_chunks_against_a_plain_version(spark):
    want, by = [], {}
    for o in spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_custkey", "o_orderkey").collect():
        by.setdefault(o.o_custkey, []).append(f"order: {o.o_orderkey} | date: {o.o_orderdate:%Y-%m-%d} | total: {o.o_totalprice} | {o.o_orderpriority}")
    for c, rows in by.items():
        head, held, k = f"Orders of customer {c}", [], 0
        for r in rows:
            if held and len("\n".join([head, *held, r])) > C.TABLE_BUDGET:
                want.append((c, k, "\n".join([head, *held])))
                held, k = [], k + 1
            held.append(r)
        want.append((c, k, "\n".join([head, *held])))
    assert sorted((r.o_custkey, r.k, r.text) for r in C.table_chunks(spark, SF).collect()) == sorted(want)


def test_parsed_replies_are_the_turns(spark):
    turns_ = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'assistant'").collect()}
    for r in P.parse_replies(spark, SF).collect():
        t = turns_.pop((r.conv_id, r.turn))
        assert (r.text, r.error) == (("", "no JSON reply") if r.conv_id % 5 == 0 else (t.strip(" "), None)) and (r.conv_id % 5 == 0 or (r.prompt_tokens, r.answer_tokens, r.finish_reason) == (10, len(t), "stop"))
    assert not turns_


def test_rank_floor(spark):
    rows = [("q", r, f) for r, f in zip(range(1, 9), (3, 4, 5, 6, 7, 8, 1, 2), strict=True)]
    got = R.with_floor(spark.createDataFrame(rows, "qid string, rank int, fused_rank int"), "qid", 5).orderBy("rank").collect()
    assert [r.fused_rank for r in got] == [3, 4, 5, 6, 1]


def test_refine(spark):
    text = "Alpha one. Beta two. Gamma salary three. Delta four. Epsilon five. Zeta six. Eta seven."
    df = spark.createDataFrame([(text, "salary", "text"), (text, "salary", "table_row")], "text string, question string, doc_type string")
    got = [r.text for r in R.refine(df).collect()]
    assert got[0].startswith("Alpha one. Beta two. Gamma salary three. Delta four.") and got[1] == text


def test_prompt_marks_tables_and_pages(spark):
    hit = (1, "table", "A > B", [None], [7], "text")
    df = spark.createDataFrame([("q?", [hit])], f"question string, hits {P.HIT}")
    user = df.select(P.user_prompt("question", "hits", "f0p").alias("u")).first().u
    assert "[1] (table) A > B (printed page ?; PDF page 7)\ntext" in user


def test_text_metrics(spark):
    assert one(spark, arrow.rouge_l(F.col("a"), F.col("b")), a="the cat sat", b="the cat sat") == 1.0
    assert one(spark, arrow.rouge_l(F.col("a"), F.col("b")), a="a x b y c", b="a b c") == pytest.approx(6 / 8)
    assert one(spark, arrow.bleu(F.col("a"), F.col("b")), a="the cat sat on the mat", b="the cat sat on the mat") == pytest.approx(1.0)
    assert one(spark, arrow.bleu(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert one(spark, arrow.similarity(F.col("a"), F.col("b")), a="salary", b="salray") == pytest.approx(difflib.SequenceMatcher(None, "salary", "salray").ratio())


def test_lost_at(spark):
    base = dict(label="answerable", action="answer", refused=[False], correct=[True], facts_total=1, facts_in_index=1, facts_in_hits=1, facts_in_prompt=1)
    cases = [({}, "ok"), ({"facts_total": 0}, "key"), ({"facts_in_index": 0}, "index"), ({"facts_in_hits": 0}, "retrieval"), ({"action": "reject"}, "gate"), ({"facts_in_prompt": 0}, "context"), ({"correct": [False], "refused": [True]}, "llm_refused"), ({"correct": [False]}, "llm_incomplete"), ({"label": "none"}, "over_answer"), ({"label": "none", "action": "scoped"}, "ok")]
    rows = [tuple((base | c).values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "label string, action string, refused array<boolean>, correct array<boolean>, facts_total int, facts_in_index int, facts_in_hits int, facts_in_prompt int")
    assert [r.x for r in df.select(S.lost_at().alias("x")).collect()] == [w for _, w in cases]


def test_toc(spark):
    rows = [("d", 1, "Part A ..... 1"), ("d", 2, "1.1 Posts"), ("d", 3, "and pay ... 4"), ("d", 4, "Part B 9")]
    got = E.toc_entries(spark.createDataFrame(rows, "d string, n int, t string"), "d", "n", "t").orderBy("first").collect()
    assert [(r.title, r.page, r.level, r.parent) for r in got] == [("Part A", 1, 0, None), ("Posts and pay", 4, 2, "Part A"), ("Part B", 9, 0, "Part A")]


def test_reply_parsing(spark):
    good = '{"choices":[{"message":{"content":"<think>a</think> yes"},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":1}}'
    df = spark.createDataFrame([(good,), ("oops",), ('{"choices":[],"usage":{"prompt_tokens":1}}',), (None,)], "reply string")
    got = [r.r for r in df.select(P.parsed_reply().alias("r")).collect()]
    assert got[0].text == "yes" and got[0].error is None and [g.error is not None for g in got[1:]] == [True, True, True]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, t string").repartition(3)
    tables.write_jsonl(df, f"{tmp_path}/a")
    back = tables.read_jsonl(spark, f"{tmp_path}/a", "id long, t string")
    assert not [r for r in back.collect() if r._corrupt_record]
    assert sorted(r.row_no for r in tables.with_row_no(back.drop("_corrupt_record")).collect()) == list(range(10))
    tables.append_new(df, f"{tmp_path}/b", ["id"], "id long, t string")
    tables.append_new(df.unionByName(spark.createDataFrame([(99, "x")], "id long, t string")), f"{tmp_path}/b", ["id"], "id long, t string")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 11
    tables.append_new(spark.createDataFrame([(7, "y"), (77, "y"), (77, "z")], "id long, t string"), f"{tmp_path}/b", ["id"], "id long, t string")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 12
    for name, data in (("utf8", " name ,x\ncafé – “1”,1\n".encode()), ("mark", "﻿ name ,x\ncafé – “1”,1\n".encode()), ("cp1252", " name ,x\ncafé – “1”,1\n".encode("cp1252"))):
        (tmp_path / f"{name}.csv").write_bytes(data)
        assert tables.read_csv(spark, f"{tmp_path}/{name}.csv").first().asDict() == {"name": "café – “1”", "x": "1"}
    (tmp_path / "latin.csv").write_bytes("é,x\nn\x81é,1\n".encode("latin-1"))
    assert tables.read_csv(spark, f"{tmp_path}/latin.csv", "a string, b int").first() == ("n\x81é", 1)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("b", 5), ("a", 900), ("c", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"t": "{name}{i}"}}\n' for i in range(n)))
    got = tables.with_row_no(spark.read.schema("t string").json(str(tmp_path))).orderBy("row_no").collect()
    assert [r.t for r in got] == [f"{f}{i}" for f, n in (("a", 900), ("b", 5), ("c", 3)) for i in range(n)] and [r.row_no for r in got] == list(range(908))


def test_reports_manifests_and_kept_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    tables.write_sheets({"one": df, "two": df}, f"{tmp_path}/r")
    assert tables.read_csv(spark, f"{tmp_path}/r/two").first().b == "x"
    m = runs.manifest("r1", {"b": 1}, {"f": "h"}, {"questions": 2}, "now")
    tables.write_manifest(m, spark, f"{tmp_path}/m")
    assert tables.read_manifest(spark, f"{tmp_path}/m") == m
    made = []
    build = lambda: (made.append(1), df)[1]
    for print_ in ("p", "p", "q"):
        assert tables.reuse(spark, f"{tmp_path}/k", print_, build).count() == 1
    assert len(made) == 2
    turns.save_sessions(spark.createDataFrame([("s", ["a"], None)], "session_id string, turns array<string>, pending string"), f"{tmp_path}/s")
    assert turns.load_session(spark, f"{tmp_path}/s", "s")["turns"] == ["a"] and turns.load_session(spark, f"{tmp_path}/s", "t") is None


def test_settings():
    assert settings.overlay({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert settings.settings_hash({"a": 1, "b": 2}) == settings.settings_hash({"b": 2, "a": 1})
    with pytest.raises(ValueError, match="x"):
        settings.ensure_unchanged({"x": "1"}, {"x": "2"})


def test_repeated_answers(spark):
    rows = [("m", i, "OK") for i in range(10)] + [("m", 10 + i, "no") for i in range(12)]
    got = runs.repeated_answers(spark.createDataFrame(rows, "model string, n int, a string"), "model", "n", "a", ["no"]).collect()
    assert [(r.text, r.n, r.first) for r in got] == [("OK", 10, 0)]


def test_stream_equals_batch(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    got = turns.run_once(turns.log_rows(turns.read_files(spark, SF, "conversations")), "t", ["conv_id", "turn"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, turns.log_rows(conv).collect()))


def test_streams_of_tables_in_folders(spark, tmp_path):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    conv.repartition(3, "conv_id").write.parquet(f"{tmp_path}/many/conversations.parquet")
    conv.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    for query in (turns.stream_question_log, turns.stream_scores, turns.stream_sessions):
        assert sorted(map(repr, query(spark, f"{tmp_path}/many").collect())) == sorted(map(repr, query(spark, SF).collect()))
        assert query(spark, f"{tmp_path}/none").count() == 0


def test_page_ranges_past_the_last_page(spark):
    got = K.page_ranges(spark.createDataFrame([(1, 3), (2, 7), (3, 12)], "k long, at long"), "at", 10).collect()
    assert {r.k: (r.pages, r.end) for r in got} == {1: ([3, 4, 5, 6], 6), 2: ([7, 8, 9, 10, 11], 11), 3: ([], 10)}


def test_letter_pages_past_the_last_page(spark, tmp_path):
    spark.createDataFrame([(9999,), (10005,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = K.letter_page_ranges(spark, str(tmp_path))
    assert same(got.collect(), got.columns, con.execute(catalog.oracle_sql()["letter_page_ranges"]))


def test_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    rng = random.Random(4)
    values = [None, float("nan"), float("inf"), -0.0, 0.0, 7.0, 7.0, *([3.5] * 30), *(rng.choice([rng.uniform(-30, 30), float(rng.randint(-30, 30))]) for _ in range(200))]
    points = [(i, v, "a" if i % 3 else None) for i, v in enumerate(values)]
    ranges = [(-1, None, 5.0), (-2, 5.0, None), (-3, 9.0, 2.0), (-4, 3.5, 3.5), (-5, 0.0, 0.0), (-6, -40.0, 40.0), *((k, a, a + rng.choice([0.0, 7.0, rng.uniform(0, 20)])) for k, a in enumerate(float(rng.randint(-40, 40)) for _ in range(40)))]
    p = spark.createDataFrame(points + points[:9], "id long, at double, more string")
    got = E.in_ranges(p, spark.createDataFrame(ranges, "k long, lo double, hi double"), "at", "lo", "hi", 7.0)
    assert got.columns == ["id", "at", "more", "k", "lo", "hi"]
    want = [(i, v, m, *r) for i, v, m in points + points[:9] for r in ranges if v is not None and None not in r and r[1] <= v <= r[2]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_in_ranges_written(spark, tmp_path):
    # few bands with many pairs: several tasks give them out, and files keep them in a fraction of a byte a row
    points = spark.range(0, 4000, 1, 1).select("id", (F.pmod(F.xxhash64("id"), F.lit(300_000)) / 100_000).alias("at"))
    ranges = spark.range(0, 1000, 1, 1).select(F.xxhash64("id").alias("k"), (F.col("id") / 500).alias("lo"), (F.col("id") / 500 + 1).alias("hi"))
    E.in_ranges(points, ranges, "at", "lo", "hi", 1.0).select("id", "k").write.parquet(f"{tmp_path}/pairs")
    rows, held = spark.read.parquet(f"{tmp_path}/pairs").distinct().count(), [(r.lo, r.hi) for r in ranges.collect()]
    assert rows == sum(a <= v <= b for v in [p["at"] for p in points.collect()] for a, b in held)
    files = [f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")]
    assert sum(files) < 0.4 * rows and max(files) < 0.6 * sum(files)


def test_in_no_range(spark):
    rnd = random.Random(1)
    ranges = [(x := rnd.uniform(-50, 400), x + rnd.choice([0, 1, 7, 30])) for _ in range(60)] + [(100.0, 107.0)] * 30
    points = [(i, float(i) / 2) for i in range(-150, 1000)] + [(2000 + i, v) for i, (a, b) in enumerate(ranges) for v in (a, b)] + [(9999, None)]
    p, r = spark.createDataFrame(points, "id long, at double"), spark.createDataFrame(ranges, "lo double, hi double")
    assert {x.id for x in E.in_no_range(p, r, "at", "lo", "hi", 7.0).collect()} == {i for i, v in points if v is None or not any(a <= v <= b for a, b in ranges)}
    # a band keeps two pieces at most where no range is shorter than it
    many = spark.range(5000).select((F.col("id") % 997 / 3).alias("lo"), (F.col("id") % 997 / 3 + 7).alias("hi"))
    assert E.merged_ranges(many, "lo", "hi", 7.0).groupBy("aw_band").count().agg(F.max("count")).first()[0] <= 2


def test_ordered_blocks_are_dealt_out(spark):
    sides = [spark.range(n).select(F.format_string(f, F.col("id") * 37 % n).alias("block_id")) for n, f in ((500, "%d"), (40, "L%02d"))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = X.ordered_blocks(*sides)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [f"{i}" for i in range(500)], [f"L{i:02d}" for i in range(40)]
    assert [r.block_id for r in got.orderBy("order").collect()] == sorted(want[0]) + sorted(want[1])
    assert [r.order for r in got.orderBy("order").collect()] == list(range(1, 541))
    assert got.rdd.getNumPartitions() > 1


def test_section_starts_without_python(spark):
    rows = [(1, 0, 3, 2), (1, 0, 1, 2), (1, 0, 0, 1), (1, 1, 0, 5), (1, 1, 2, 1), (1, 1, 4, 1), (1, 2, 1, 9), (1, 3, 9, 0), (1, 3, 8, 1), (2, 1, 0, 1)]
    got = X.section_starts(spark.createDataFrame(rows, "doc_id long, entry long, n int, score int"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (1, 1, 2), (1, 3, 8), (2, 1, 0)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_bm25_without_pairs_in_a_shuffle(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, range(40, 0, -1), k=rnd.randrange(1, 30)))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(60)] + [(900, None), (901, "the of"), (902, "İ KELVIN K x")]
    asked = [(i, " ".join(rnd.choices(words, k=4))) for i in range(20)] + [(50, "the"), (51, None), (52, "w1 w1 kelvin"), (53, "k")]
    monkeypatch.setattr(R, "DOCS", 16)
    monkeypatch.setattr(R, "QUESTIONS", 6)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    index = R.index_of(spark, str(tmp_path))
    got = R.bm25(index, q, 7)
    q.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert same(got.collect(), got.columns, con.execute(f"WITH {R.BM25_SQL} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 7"))
    # the index holds one row a document, and no more than k rows a question and task are exchanged
    assert index.documents.count() == len(docs)
    assert R.bm25(index, q.filter("item_id = 50")).count() == 0


def test_word_fixes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "KNOWN", 7)
    monkeypatch.setattr(Q, "ASKED", 3)
    rnd = random.Random(3)
    vocab = sorted({"".join(rnd.choices("abcé", k=rnd.randrange(1, 9))) for _ in range(150)} | {"banana" * 3, "x" * 400})
    asked = sorted({"".join(rnd.choices("abcé", k=rnd.randrange(3, 9))) for _ in range(30)} | {"bananabananabanan", "zzzz"})
    df = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
    got = Q.word_fixes(df(asked), df(vocab))
    assert {r.word: r.match for r in got.collect()} == {w: m for w in asked if len(w) >= 4 and (m := closest(w, [v for v in vocab if len(v) >= 3]))}
    # the vocabulary is not exchanged: only the final maximum of each word is
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2 and Q.word_fixes(df([]), df(vocab)).count() == 0
