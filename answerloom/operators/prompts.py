"""Prompts: source blocks in several formats, versions with their notes, hashes, parsing of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import text as T
from answerloom.operators import retrieval as R
from answerloom.sources.tables import table

#: Instructions in our own words; {document} and {not_found} are filled in.
SYSTEM = {
    "v1": "Answer questions about {document} from the numbered sources only. If they hold no answer, reply exactly: {not_found}",
    "v3b_med": "You answer questions about {document}. Use the numbered sources only, cite each statement as [n], answer what they cover and say what they do not. With nothing at all in them, reply exactly: {not_found}",
    "v3b_strict": "You answer questions about {document}. Every statement needs a source [n]; leave out what no source states. If the sources do not answer the very question, reply exactly: {not_found}",
}
#: Columns of a hit within the array of hits.
HIT = "array<struct<rank:int,doc_type:string,path:string,printed_pages:array<string>,pdf_pages:array<int>,text:string>>"


def source_blocks(hits: str, form: str) -> Column:
    """The numbered sources of a prompt in one of the formats f0, f1, f2, f0p."""

    def block(h: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        is_table = h["doc_type"] == "table"
        printed = T.page_label(h["printed_pages"])
        if form == "f1":
            return F.concat(F.lit("Source ["), n, F.lit("]"), F.when(is_table, " (table)").otherwise(""), F.lit(" - "), h["path"], F.lit(" - page "), printed, F.lit(":\n"), h["text"])
        if form == "f2":
            return F.concat(F.lit("### ["), n, F.lit("] "), h["path"], F.lit(" (page "), printed, F.lit(")"), F.when(is_table, " - table").otherwise(""), F.lit("\n"), h["text"])
        pages = F.concat(F.lit("page "), printed) if form == "f0" else F.concat(F.lit("printed page "), printed, F.lit("; PDF page "), F.array_join(h["pdf_pages"].cast("array<string>"), ", "))
        return F.concat(F.lit("["), n, F.lit("]"), F.when(is_table, " (table)").otherwise(""), F.lit(" "), h["path"], F.lit(" ("), pages, F.lit(")\n"), h["text"])

    return F.array_join(F.transform(F.col(hits), block), "\n\n")


def user_prompt(question: str, hits: str, form: str) -> Column:
    q, blocks = F.col(question), source_blocks(hits, form)
    if form == "f1":
        return F.concat(F.lit("Sources:\n\n"), blocks, F.lit("\n\nQuestion: "), q, F.lit("\nAnswer:"))
    if form == "f2":
        return F.concat(F.lit("## Question\n"), q, F.lit("\n\n## Sources\n"), blocks, F.lit("\n\n## Task\nAnswer the question: "), q)
    return F.concat(F.lit("Question: "), q, F.lit("\n\nSources:\n\n"), blocks, F.lit("\n\nAnswer this question using the sources above: "), q, F.lit("\nAnswer:"))


def system_prompt(version: str, document: str, not_found: str = T.NOT_FOUND, notes: str | None = None) -> Column:
    """The version's instructions; notes, a column of an array of strings, follow where there are some."""
    base = F.lit(SYSTEM[version].format(document=document, not_found=not_found))
    return base if notes is None else F.concat(base, F.when(F.size(notes) > 0, F.concat(F.lit("\nNotes: "), F.array_join(notes, " "))).otherwise(""))


def prompt_hash(system: Column, user: Column) -> Column:
    return F.left(F.sha2(F.concat(system, F.lit("\n\n"), user), 256), F.lit(12))


def build(questions: DataFrame, document: str, versions: list[str], forms: list[str]) -> DataFrame:
    """item_id, version, format, system, user, prompt_hash for every question (question, hits) and planned pair."""
    rows = None
    for v in versions:
        for f in forms:
            one = questions.select("item_id", F.lit(v).alias("version"), F.lit(f).alias("format"), system_prompt(v, document).alias("system"), user_prompt("question", "hits", f).alias("user"))
            rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("prompt_hash", prompt_hash(F.col("system"), F.col("user")))


def parsed_reply(raw: str = "reply") -> Column:
    """Text, tokens and finish reason of a chat reply; error where it is no JSON or has no choice. A thinking block goes."""
    schema = "struct<choices:array<struct<message:struct<content:string>,finish_reason:string>>,usage:struct<prompt_tokens:int,completion_tokens:int>>"
    r = F.from_json(raw, schema)
    first = F.get(r["choices"], 0)
    text = F.trim(F.regexp_replace(F.coalesce(first["message"]["content"], F.lit("")), "(?s)<think>.*?</think>", ""))
    error = F.when(r.isNull() | (r["choices"].isNull() & r["usage"].isNull()), "no JSON reply").when(F.coalesce(F.size(r["choices"]), F.lit(0)) <= 0, "no choices")
    return F.struct(text.alias("text"), first["finish_reason"].alias("finish_reason"), r["usage"]["prompt_tokens"].alias("prompt_tokens"), r["usage"]["completion_tokens"].alias("answer_tokens"), error.alias("error"))


def hits_of(spark, sf_dir) -> DataFrame:
    """item_id, question, hits: the five best documents of every benchmark item with their path and pages."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = R.bm25(R.index_of(spark, sf_dir), asked).join(docs, "doc_id")
    hit = F.struct(
        F.col("rank"),
        F.when(F.col("doc_id") % 4 == 0, "table").otherwise("section").alias("doc_type"),
        F.concat_ws(" > ", "lang", "source").alias("path"),
        F.array(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string"))).alias("printed_pages"),
        F.array((F.col("doc_id") + 20).cast("int")).alias("pdf_pages"),
        "text",
    )
    per = rows.groupBy("item_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return asked.select("item_id", F.col("text").alias("question")).join(per, "item_id")


def _prompt_sql(head: str, sep: str, tail: str, block: str) -> str:
    return f"""WITH {R.BM25_SQL}, h AS (SELECT item_id, rank, doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE false END AS tab, concat_ws(' > ', lang, source) AS path, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '?' END AS printed, doc_id + 20 AS pdf, text AS t FROM bm JOIN documents USING (doc_id) WHERE rank <= 5),
u AS (SELECT item_id, b.text AS q, string_agg({block}, chr(10) || chr(10) ORDER BY rank) AS blocks FROM h JOIN benchmark b USING (item_id) GROUP BY ALL),
p AS (SELECT item_id, {head} || blocks || {tail} AS "user" FROM u)"""


_NL = "chr(10)"
_F0P = _prompt_sql("'Question: ' || q || chr(10) || chr(10) || 'Sources:' || chr(10) || chr(10)", "", "chr(10) || chr(10) || 'Answer this question using the sources above: ' || q || chr(10) || 'Answer:'", "'[' || rank || ']' || CASE WHEN tab THEN ' (table)' ELSE '' END || ' ' || path || ' (printed page ' || printed || '; PDF page ' || pdf || ')' || chr(10) || t")
_F1 = _prompt_sql("'Sources:' || chr(10) || chr(10)", "", "chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:'", "'Source [' || rank || ']' || CASE WHEN tab THEN ' (table)' ELSE '' END || ' - ' || path || ' - page ' || printed || ':' || chr(10) || t")
_F2 = _prompt_sql("'## Question' || chr(10) || q || chr(10) || chr(10) || '## Sources' || chr(10)", "", "chr(10) || chr(10) || '## Task' || chr(10) || 'Answer the question: ' || q", "'### [' || rank || '] ' || path || ' (page ' || printed || ')' || CASE WHEN tab THEN ' - table' ELSE '' END || chr(10) || t")


def _hash_sql(cte: str, version: str) -> str:
    system = SYSTEM[version].format(document="the corpus", not_found=T.NOT_FOUND).replace("'", "''")
    return f"""{cte} SELECT item_id, '{version}' AS version, left(sha256('{system}' || chr(10) || chr(10) || "user"), 12) AS prompt_hash, CAST(length("user") AS INT) AS size FROM p"""


def _prompts(spark, sf_dir, version, form):
    return build(hits_of(spark, sf_dir), "the corpus", [version], [form]).select("item_id", "version", "prompt_hash", F.length("user").alias("size"))


@query(_hash_sql(_F0P, "v3b_med"))
def prompt_f0p(spark, sf_dir):
    return _prompts(spark, sf_dir, "v3b_med", "f0p")


@query(_hash_sql(_F0P.replace("(printed page ' || printed || '; PDF page ' || pdf ||", "(page ' || printed ||"), "v1"))
def prompt_f0(spark, sf_dir):
    return _prompts(spark, sf_dir, "v1", "f0")


@query(_hash_sql(_F1, "v3b_strict"))
def prompt_f1(spark, sf_dir):
    return _prompts(spark, sf_dir, "v3b_strict", "f1")


@query(_hash_sql(_F2, "v1"))
def prompt_f2(spark, sf_dir):
    return _prompts(spark, sf_dir, "v1", "f2")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, json_valid(props) AS valid FROM events""")
def parse_props(spark, sf_dir):
    """Nested JSON read under a schema; what is no JSON gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS int)").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("valid"))


@query()
def parse_replies(spark, sf_dir):
    """Replies of a chat model made of the assistant turns, parsed again (held against the turns in the tests)."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    message = F.struct(F.struct(F.concat(F.lit("<think>hm\n</think> "), "text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    reply = F.when(F.col("conv_id") % 5 == 0, "overloaded").otherwise(F.to_json(F.struct(F.array(message).alias("choices"), F.struct(F.lit(10).alias("prompt_tokens"), F.length("text").alias("completion_tokens")).alias("usage"))))
    return turns.withColumn("reply", reply).select("conv_id", "turn", parsed_reply().alias("r")).select("conv_id", "turn", "r.*")
