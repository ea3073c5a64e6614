"""Sections and blocks: contents checks, section starts, roll-up, blocks for the chunker; and lines as pieces of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import text as T
from answerloom.operators.chunking import cut_sentences, glued
from answerloom.operators.cleaning import joined_lines
from answerloom.operators.extraction import as_of
from answerloom.operators.inputs import LINES_SQL, lines
from answerloom.sources.shared import save
from answerloom.sources.tables import table

# Marks of list items, bare labels of titles, and kinds of lines.
LIST_START = r"^(-\s|\(?[ivx]{1,4}\)\s|\(?[a-h]\)\s|[a-h]\.\s|\d{1,2}[.)]\s)"
LABEL_BODY = r"(?i)^((chapter|annexure)(\s*[-:]?\s*[0-9ivx]+)?|[ivx]+)\s*$"
KINDS = {"L0": "heading", "L1": "heading", "L2": "heading", "L3": "heading", "body": "text", "table": "table", "caption": "caption", "diagram": "diagram"}


def contents_problems(toc: DataFrame, offset: int = 20) -> DataFrame:
    """row_no, problem: entries of a table of contents (row_no, key, parent, level, start, end, pdf_start) that cannot be right."""
    order = Window.orderBy("row_no")  # a table of contents is small
    rows = toc.withColumn("before", F.lag("pdf_start").over(order))
    top = toc.filter("level = 0").select(F.col("key").alias("parent"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    rows = rows.join(top, "parent", "left")
    sub = F.col("level") > 0
    inside = (F.col("p_start") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("p_end"))
    checks = {"offset": F.col("pdf_start") != F.col("start") + offset, "ends before it starts": F.col("end") < F.col("start"), "before the row above": F.col("pdf_start") < F.col("before"), "no parent": sub & F.col("p_start").isNull(), "outside parent": sub & F.col("p_start").isNotNull() & ~inside}
    return rows.select("row_no", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())).alias("problem"))


def section_starts(scored: DataFrame) -> DataFrame:
    """doc_id, entry, start: for each entry in order, the best scored line (doc_id, entry, n, score) after the start before it, the earliest of equals."""
    # of an entry's lines in this order, the first one after the start before it is its start
    best = F.array_sort(F.collect_list(F.struct("entry", (-F.col("score")).alias("cost"), "n")))
    state = F.struct(F.lit(None).cast("long").alias("entry"), F.lit(-1).cast("long").alias("after"), F.array().cast("array<struct<entry:bigint,start:bigint>>").alias("out"))

    def step(s, x):
        entry, n = x["entry"].cast("long"), x["n"].cast("long")
        takes = (s["entry"].isNull() | (s["entry"] != entry)) & (n > s["after"])
        return F.when(takes, F.struct(entry.alias("entry"), n.alias("after"), F.array_append(s["out"], F.struct(entry.alias("entry"), n.alias("start"))).alias("out"))).otherwise(s)

    return scored.filter("score > 0").groupBy("doc_id").agg(best.alias("lines")).select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.aggregate("lines", state, step, lambda s: s["out"])))


def sections(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, entry, pages, n_lines, n_tables, n_chars: lines of each section, which reaches from its start to the next one's."""
    marked = as_of(rows.select("doc_id", "n", "page", "text", "level"), starts.select("doc_id", F.col("start").alias("n"), "entry"), "doc_id", "n", "entry").filter("entry is not null")
    return marked.groupBy("doc_id", "entry").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("level") == "table").alias("n_tables"), F.sum(F.length("text")).alias("n_chars"))


def section_blocks(rows: DataFrame, method: DataFrame, by: list[str]) -> DataFrame:
    """block_id, unit, source, searchable, pages, items of sections (by, kind, at, level, text, page); method (page, method)."""
    kinds = F.create_map(*(F.lit(v) for kv in KINDS.items() for v in kv))
    kind = F.coalesce(F.try_element_at(kinds, F.col("level")), F.lit("text"))
    depth = F.when(kind == "heading", F.substring("level", 2, 1).cast("int"))
    read = rows.join(method, "page", "left")
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", F.struct(kind.alias("type"), depth.alias("depth"), F.col("text"), F.col("page")).alias("item")))), lambda x: x["item"])
    g = read.groupBy(*by).agg(F.first("kind").alias("kind"), F.array_sort(F.collect_set("page")).alias("pages"), F.bool_or(F.coalesce(F.col("method") == "ocr", F.lit(False))).alias("ocr"), items.alias("items"))
    return g.select(F.concat_ws("-", *by).alias("block_id"), F.when(F.col("kind") == "glossary", "glossary").otherwise("section").alias("unit"), F.when(F.col("ocr"), "ocr").otherwise("text").alias("source"), F.lit(True).alias("searchable"), F.lit(None).cast("string").alias("summary"), "pages", "items")


def letter_blocks(letters: DataFrame) -> DataFrame:
    """The same for letters (letter_no, subject, date_text, status, notice, body, pages): one that cannot be read is its summary."""
    ok = F.col("status") == "ok"
    parts = F.filter(F.transform(F.split("body", "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    items = F.transform(parts, lambda p: F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("depth"), p.alias("text"), F.lit(None).cast("int").alias("page")))
    summary = F.when(~ok, F.concat(F.lit("Letter "), "letter_no", F.lit(" dated "), "date_text", F.lit(": "), "subject", F.lit(". "), "notice"))
    return letters.select(F.format_string("L%02d", "letter_no").alias("block_id"), F.lit("letter").alias("unit"), F.lit("ocr").alias("source"), ok.alias("searchable"), summary.alias("summary"), "pages", items.alias("items"))


def ordered_blocks(sections_: DataFrame, letters: DataFrame) -> DataFrame:
    """Sections, then letters, numbered from 1 in the order of their ids.

    Blocks are dealt into ranges of ids and written in their order; a range is numbered from the count of those before it.
    """
    both = sections_.withColumn("aw_side", F.lit(0)).unionByName(letters.withColumn("aw_side", F.lit(1)))
    rows = both.repartitionByRange("aw_side", "block_id").sortWithinPartitions("aw_side", "block_id")
    rows = save(rows.withColumns({"aw_part": F.spark_partition_id(), "aw_at": F.monotonically_increasing_id()}), "blocks")
    per = rows.groupBy("aw_part").agg(F.count(F.lit(1)).alias("aw_n"), F.min("aw_at").alias("aw_least"))
    shift = per.select("aw_part", (F.sum("aw_n").over(Window.orderBy("aw_part")) - F.col("aw_n") - F.col("aw_least") + 1).alias("aw_shift"))  # one row a range
    return rows.join(F.broadcast(shift), "aw_part").withColumn("order", (F.col("aw_at") + F.col("aw_shift")).cast("int")).drop("aw_side", "aw_part", "aw_at", "aw_shift")


# ---- lines as pieces

def paragraph_gap(rows: DataFrame, by: str = "doc_id", at: str = "n") -> DataFrame:
    """gap: 1.3 times the most common step (rounded; ties: the least) down from one line of text to the next on its page."""
    order = Window.partitionBy(by).orderBy(at)
    step = F.bround(F.col("top") - F.lag("top").over(order)).cast("int")
    usable = (F.col("type") == "text") & (F.lag("type").over(order) == "text") & (F.col("page") == F.lag("page").over(order)) & (F.col("top") > F.lag("top").over(order))
    counts = rows.select(F.when(usable, step).alias("step")).filter("step is not null").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max(F.struct("n", (-F.col("step")).alias("s")))["s"].alias("s")).select((-F.col("s") * 1.3).alias("gap"))


def line_pieces(rows: DataFrame, gap: DataFrame, by: str = "doc_id", at: str = "n") -> DataFrame:
    """by, first_line, kind, text, pages: headings, paragraphs, lists and tables made of lines (type, text, page, top).

    A paragraph ends at a list mark, a gap, or a new page after the end of a sentence; lines of a diagram are one list; a
    caption goes in front of the paragraph or list after it, and is a paragraph where there is none.
    """
    order = Window.partitionBy(by).orderBy(at)
    t = F.trim("text")
    kind = F.when((F.col("type") == "heading") | t.rlike(LABEL_BODY), "heading").when(F.col("type").isin("table", "caption", "diagram"), F.col("type")).otherwise("para")
    marked = rows.withColumn("kind", kind).crossJoin(F.broadcast(gap))  # one row
    lag = lambda c: F.lag(c).over(order)
    turned = (F.col("page") != lag("page")) & lag("text").rlike("[.:;?!]$")
    step = F.col("top") - lag("top")
    apart = (F.col("page") == lag("page")) & F.coalesce(~((step > 0) & (step <= F.col("gap"))), F.lit(False))
    new = F.when(F.col("kind") == "para", (lag("kind") != "para") | t.rlike(LIST_START) | turned | apart).when(F.col("kind") == "diagram", lag("kind") != "diagram").otherwise(F.lit(True))
    runs = marked.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(at, "text"))), lambda x: x["text"])
    per = runs.groupBy(by, "run").agg(F.min(at).alias("first_line"), F.first("kind").alias("kind"), F.collect_set("page").alias("pages"), texts.alias("texts"))
    per = per.withColumn("text", F.when(F.col("kind") == "para", joined_lines(F.col("texts"))).otherwise(F.array_join(F.transform("texts", lambda x: F.trim(x)), "\n")))
    piece = Window.partitionBy(by).orderBy("first_line")
    heads = F.coalesce((F.col("kind") == "caption") & F.lead("kind").over(piece).isin("para", "diagram"), F.lit(False))
    led = F.coalesce((F.lag("kind").over(piece) == "caption") & F.col("kind").isin("para", "diagram"), F.lit(False))
    out = per.withColumns({"heads": heads, "led": led, "cap": F.lag("text").over(piece), "cap_pages": F.lag("pages").over(piece), "cap_line": F.lag("first_line").over(piece)}).filter("not heads")
    kind = F.when(F.col("kind") == "diagram", "list").when(F.col("kind") == "caption", "para").otherwise(F.col("kind"))
    return out.select(
        by, F.when(F.col("led"), F.col("cap_line")).otherwise(F.col("first_line")).alias("first_line"), kind.alias("kind"), F.when(F.col("led"), F.concat("cap", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"),
        F.array_sort(F.when(F.col("led"), F.array_union("cap_pages", "pages")).otherwise(F.col("pages"))).alias("pages"),
    )


def block_pieces(blocks: DataFrame) -> DataFrame:
    """block_id, k, text, pages: items that are paragraphs already, on the pages of their block; one broken within a sentence is joined."""
    items = blocks.select("block_id", "pages", F.posexplode("items").alias("k", "i")).filter("i.type = 'paragraph'").select("block_id", "k", F.col("i.text").alias("text"))
    return glued(items, "block_id", "k", "text").select("block_id", F.col("first_line").alias("k"), "n_lines", "text").join(blocks.select("block_id", "pages"), "block_id")


def table_groups(tables: DataFrame) -> DataFrame:
    """tables (doc_id, table_id, title, header, page) with group_id: one with the title and header of the one before it, on the next page, goes on with it."""
    order = Window.partitionBy("doc_id").orderBy("page", "table_id")
    same = (F.lag("title").over(order).eqNullSafe(F.col("title"))) & (F.lag("header").over(order) == F.col("header")) & (F.lag("page").over(order) == F.col("page") - 1)
    first = F.when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.col("table_id"))
    return tables.withColumn("group_id", F.last(first, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def key_values(row: Column, header: Column) -> Column:
    """A rendered row as (name, value): a cell belongs to the longest column name that it starts with; name is null without one."""
    name = lambda cell: T.longest_header(cell, header)
    return F.transform(F.split(row, r" \| "), lambda c: F.struct(name(c).alias("name"), F.trim(F.when(name(c).isNotNull(), F.substring(c, F.length(name(c)) + 2, F.length(c))).otherwise(c)).alias("value")))


def _row_pieces(rows: pd.Series, budget: pd.Series) -> pd.Series:
    def cut(cells, most):
        cells = list(cells) if cells is not None else []
        if not cells:
            return []
        label, out, held = cells[0], [], [cells[0]]
        whole = sum(len(c) + 3 for c in cells) - 3
        if whole <= most:
            return [" | ".join(cells)]
        for c in cells[1:]:
            if len(held) > 1 and sum(len(h) + 3 for h in held) + len(c) > most:
                out.append(" | ".join(held))
                held = [label]
            held.append(c)
        return [*out, " | ".join(held)]

    return pd.Series([cut(r, b) for r, b in zip(rows, budget, strict=True)])


def row_pieces(cells, budget: int = 1000) -> Column:
    """A row's rendered cells as one text, or as several within the budget, cut between cells and each with the first cell in front."""
    return F.pandas_udf(_row_pieces, "array<string>")(cells, F.lit(budget))


def _balanced(texts: pd.Series, target: pd.Series) -> pd.Series:
    def cut(t, size):
        t = t or ""
        parts = [s for line in t.split("\n") for s in cut_sentences(line)]
        goal = -(-len(t) // max(1, round(len(t) / size)))
        out: list[str] = []
        for s in parts:
            if out and len(out[-1]) + 1 + len(s) <= goal:
                out[-1] += " " + s
            else:
                out.append(s)
        return out

    return pd.Series([cut(t, int(n)) for t, n in zip(texts, target, strict=True)])


def balanced_chunks(text, target: int) -> Column:
    """Sentences in chunks of about equal size: as many chunks as the text has targets, each up to its share of the text."""
    return F.pandas_udf(_balanced, "array<string>")(text, F.lit(target))


def section_chunks(rows: DataFrame, limit: int, size: int, overlap: int) -> DataFrame:
    """doc_id, entry, k, text: each section's text whole, or in pieces of words that never leave it where it has more than limit words."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    made = F.when(F.size(words) <= limit, F.array(F.trim("text"))).otherwise(T.word_pieces("text", size, overlap))
    return rows.filter(F.trim("text") != "").select("doc_id", "entry", F.posexplode(made).alias("k", "text"))


def carried_chunks(parts: Column, least: int = 25) -> Column:
    """Parts joined on until they have at least `least` words (cut at single spaces); what is left at the end is one."""
    n = lambda s: F.size(F.split(s, " "))
    step = lambda a, p: F.when(n(F.concat(a["held"], p)) < least, F.struct(a["out"].alias("out"), F.concat(a["held"], p).alias("held"))).otherwise(F.struct(F.array_append(a["out"], F.concat(a["held"], p)).alias("out"), F.lit("").alias("held")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.aggregate(parts, start, step, lambda a: F.when(a["held"] != "", F.array_append(a["out"], a["held"])).otherwise(a["out"]))


def with_labels_and_notes(chunks: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """chunks (chunk_id, pages) with printed_pages and footnotes of their pages; pages (page, printed), notes (page, num, text)."""
    each = chunks.select("chunk_id", F.posexplode("pages").alias("i", "page"))
    printed = each.join(pages, "page", "left").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "printed"))), lambda x: x["printed"]).alias("printed_pages"))
    some = each.join(notes, "page").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("page", "num", F.col("text")))).alias("footnotes"))
    return chunks.join(printed, "chunk_id", "left").join(some, "chunk_id", "left").withColumn("footnotes", F.coalesce("footnotes", F.array().cast("array<struct<page:int,num:int,text:string>>")))


# ---- queries

@query("""WITH t AS (SELECT n_nationkey AS row_no, n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'P' || (n_nationkey - n_nationkey % 5) END AS parent, n_nationkey * 10 AS s, n_nationkey * 10 + CASE WHEN n_nationkey % 5 = 0 THEN 45 WHEN n_nationkey % 7 = 3 THEN -2 ELSE 9 END AS e, n_nationkey * 10 + CASE WHEN n_nationkey % 9 = 4 THEN 0 ELSE 20 END AS pdf FROM nation)
SELECT row_no, 'offset' AS problem FROM t WHERE pdf <> s + 20 UNION ALL SELECT row_no, 'ends before it starts' FROM t WHERE e < s UNION ALL SELECT row_no, 'before the row above' FROM (SELECT *, lag(pdf) OVER (ORDER BY row_no) AS b FROM t) WHERE pdf < b
UNION ALL SELECT row_no, 'no parent' FROM t WHERE parent = 'P20' UNION ALL SELECT row_no, 'outside parent' FROM t WHERE parent IS NOT NULL AND parent <> 'P20' AND (e < s OR e > (row_no - row_no % 5) * 10 + 45)""")
def contents_checks(spark, sf_dir):
    """A table of contents with ends, offsets and parents that are wrong here and there."""
    n = F.col("n_nationkey")
    top = n % 5 == 0
    toc = table(spark, sf_dir, "nation").select(
        n.alias("row_no"), F.when(top & (n != 20), F.concat(F.lit("P"), n)).otherwise(F.concat(F.lit("x"), n)).alias("key"), F.when(~top, F.concat(F.lit("P"), n - n % 5)).alias("parent"), F.when(top, 0).otherwise(1).alias("level"),
        (n * 10).alias("start"), (n * 10 + F.when(top, 45).when(n % 7 == 3, -2).otherwise(9)).alias("end"), (n * 10 + F.when(n % 9 == 4, 0).otherwise(20)).alias("pdf_start"),
    )
    return contents_problems(toc)


@query()
def section_start_lines(spark, sf_dir):
    """Three entries a document, each on its best scored line after the one before (held against a plain version in the tests)."""
    return section_starts(_scored(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "n", F.explode(F.array(*(F.lit(e).cast("long") for e in range(3)))).alias("entry"))
    return rows.withColumn("score", ((F.col("doc_id") + F.col("n") * 7 + F.col("entry") * 5) % 6 - 2).cast("int"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, n AS start, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS entry FROM lines WHERE level IN ('L1', 'L2')), m AS (SELECT l.*, (SELECT max(entry) FROM s WHERE s.doc_id = l.doc_id AND s.start <= l.n) AS entry FROM lines l)
SELECT doc_id, entry, list_sort(list(DISTINCT page)) AS pages, count(*) AS n_lines, count(*) FILTER (level = 'table') AS n_tables, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM m WHERE entry IS NOT NULL GROUP BY doc_id, entry""")
def section_rollup(spark, sf_dir):
    """Every heading starts a section; what it holds."""
    rows = lines(spark, sf_dir)
    starts = rows.filter("level in ('L1', 'L2')").select("doc_id", F.col("n").alias("start"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).cast("long").alias("entry"))
    return sections(rows, starts)


@query(f"""WITH {LINES_SQL}, b AS (SELECT CAST(doc_id AS VARCHAR) AS block_id, CASE WHEN doc_id % 6 = 0 THEN 'glossary' ELSE 'section' END AS unit, bool_or(page = 2 AND true) AS two, count(*) AS n_items, count(*) FILTER (level IN ('L1', 'L2')) AS n_headings FROM lines GROUP BY doc_id),
u AS (SELECT 0 AS side, block_id, unit, CASE WHEN two THEN 'ocr' ELSE 'text' END AS source, true AS searchable, NULL AS summary, n_items, n_headings FROM b UNION ALL SELECT 1, format('L{{:02d}}', n_nationkey), 'letter', 'ocr', n_nationkey % 3 > 0, CASE WHEN n_nationkey % 3 = 0 THEN 'Letter ' || n_nationkey || ' dated May: ' || n_name || '. too unclear' END, 2, 0 FROM nation)
SELECT block_id, unit, source, searchable, summary, n_items, n_headings, CAST(row_number() OVER (ORDER BY side, block_id) AS INT) AS "order" FROM u""")
def built_blocks(spark, sf_dir):
    """Documents as sections and nations as letters, in one order."""
    rows = lines(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 6 == 0, "glossary").otherwise("section").alias("kind"), F.col("n").alias("at"), "level", "text", "page")
    method = rows.select("page").distinct().withColumn("method", F.when(F.col("page") == 2, "ocr").otherwise("text"))
    n = table(spark, sf_dir, "nation")
    some = n.select(F.col("n_nationkey").alias("letter_no"), F.col("n_name").alias("subject"), F.lit("May").alias("date_text"), F.when(F.col("n_nationkey") % 3 > 0, "ok").otherwise("unreadable").alias("status"), F.lit("too unclear").alias("notice"), F.lit("one\n\n two \n\n").alias("body"), F.array(F.lit(1)).alias("pages"))
    both = ordered_blocks(section_blocks(rows, method, ["doc_id"]), letter_blocks(some))
    return both.select("block_id", "unit", "source", "searchable", "summary", F.size("items").cast("long").alias("n_items"), F.size(F.filter("items", lambda i: i["type"] == "heading")).cast("long").alias("n_headings"), "order")


_TYPE = "CASE level WHEN 'L1' THEN 'heading' WHEN 'L2' THEN 'heading' WHEN 'body' THEN 'text' ELSE level END"


@query(f"""WITH {LINES_SQL}, t AS (SELECT *, {_TYPE} AS type FROM lines), s AS (SELECT CASE WHEN type = 'text' AND lag(type) OVER w = 'text' AND page = lag(page) OVER w AND top > lag(top) OVER w THEN CAST(round_even(top - lag(top) OVER w, 0) AS INT) END AS step FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT CAST(step * 1.3::DOUBLE AS DOUBLE) AS gap FROM s WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1""")
def paragraph_gaps(spark, sf_dir):
    return paragraph_gap(lines(spark, sf_dir).withColumn("type", F.expr(_TYPE)))


_JOIN = "list_reduce(list_concat([''], {0}), lambda a, t: CASE WHEN trim(t) = '' THEN a WHEN regexp_matches(a, '[A-Za-z]-$') THEN a || trim(t) ELSE trim(a || ' ' || trim(t)) END)"


@query(rf"""WITH {LINES_SQL}, k AS (SELECT doc_id, n, text, page, top, CASE WHEN level IN ('L1', 'L2') OR regexp_matches(trim(text), '{LABEL_BODY}') THEN 'heading' WHEN level = 'body' THEN 'para' ELSE level END AS kind FROM lines),
f AS (SELECT *, CASE WHEN kind = 'para' THEN CASE WHEN lag(kind) OVER w = 'para' AND NOT regexp_matches(trim(text), '{LIST_START}') AND NOT (page <> lag(page) OVER w AND regexp_matches(lag(text) OVER w, '[.:;?!]$')) AND NOT (page = lag(page) OVER w AND NOT (top - lag(top) OVER w > 0 AND top - lag(top) OVER w <= 42)) THEN 0 ELSE 1 END WHEN kind = 'diagram' AND lag(kind) OVER w = 'diagram' THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM f),
p AS (SELECT doc_id, min(n) AS f, any_value(kind) AS kind, CASE WHEN any_value(kind) = 'para' THEN {_JOIN.format('list(text ORDER BY n)')} ELSE string_agg(trim(text), chr(10) ORDER BY n) END AS text FROM r GROUP BY doc_id, run),
c AS (SELECT *, lead(kind) OVER v AS after, lag(kind) OVER v AS before, lag(text) OVER v AS cap, lag(f) OVER v AS cf FROM p WINDOW v AS (PARTITION BY doc_id ORDER BY f))
SELECT doc_id, CASE WHEN before = 'caption' AND kind IN ('para', 'diagram') THEN cf ELSE f END AS first_line, CASE kind WHEN 'diagram' THEN 'list' WHEN 'caption' THEN 'para' ELSE kind END AS kind, md5(CASE WHEN before = 'caption' AND kind IN ('para', 'diagram') THEN cap || chr(10) || text ELSE text END) AS digest FROM c WHERE NOT (kind = 'caption' AND coalesce(after IN ('para', 'diagram'), false))""")
def lines_to_pieces(spark, sf_dir):
    """Lines joined to paragraphs at a gap of 42 points, lists, headings and tables."""
    rows = lines(spark, sf_dir).withColumn("type", F.expr(_TYPE))
    return line_pieces(rows, spark.createDataFrame([(42.0,)], "gap double")).select("doc_id", "first_line", "kind", F.md5("text").alias("digest"))


@query("""SELECT n_nationkey, CAST(2 AS INT) AS n_pieces, 'One sentence of ' || n_name || ' that goes on here' AS first FROM nation""")
def paragraph_items(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    item = lambda c: F.struct(F.lit("paragraph").alias("type"), c.alias("text"))
    blocks = n.select(F.col("n_nationkey").alias("block_id"), F.array(F.lit(1)).alias("pages"), F.array(item(F.concat(F.lit("One sentence of "), "n_name")), item(F.lit("that goes on here")), item(F.lit("Another one."))).alias("items"))
    p = block_pieces(blocks)
    return p.groupBy(F.col("block_id").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("int").alias("n_pieces"), F.min(F.struct("k", "text"))["text"].alias("first"))


@query("""WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, o_orderpriority AS title, CAST(o_orderkey // 3 AS INT) AS page FROM orders), f AS (SELECT *, CASE WHEN lag(title) OVER w = title AND lag(page) OVER w = page - 1 THEN NULL ELSE table_id END AS g FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page, table_id))
SELECT table_id, last_value(g IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, table_id ROWS UNBOUNDED PRECEDING) AS group_id FROM f""")
def table_continuations(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), F.col("o_orderpriority").alias("title"), T.strings(["a"]).alias("header"), F.expr("cast(o_orderkey div 3 as int)").alias("page"))
    return table_groups(t).select("table_id", "group_id")


@query("""SELECT o_orderkey, ['order', 'order total', NULL] AS names, [CAST(o_orderkey AS VARCHAR), o_orderpriority, 'note ' || o_custkey] AS vals, CAST(2 AS INT) AS n_pieces, 'order: ' || o_orderkey || ' | note ' || o_custkey AS last FROM orders""")
def row_keys(spark, sf_dir):
    """Rendered rows parsed again under names of which one begins another, and cut over a small budget."""
    o = table(spark, sf_dir, "orders")
    cells = F.array(F.concat(F.lit("order: "), "o_orderkey"), F.concat(F.lit("order total: "), "o_orderpriority"), F.concat(F.lit("note "), "o_custkey"))
    rows = o.select("o_orderkey", key_values(F.array_join(cells, " | "), T.strings(["order", "order total"])).alias("kv"), row_pieces(cells, 35).alias("p"))
    return rows.select("o_orderkey", F.transform("kv", lambda x: x["name"]).alias("names"), F.transform("kv", lambda x: x["value"]).alias("vals"), F.size("p").alias("n_pieces"), F.element_at("p", -1).alias("last"))


@query(rf"""WITH {LINES_SQL}, s AS (SELECT *, sum((level IN ('L1', 'L2'))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS entry FROM lines), t AS (SELECT doc_id, entry, list_filter(regexp_split_to_array(string_agg(text, chr(10) ORDER BY n), '\s+'), lambda x: x <> '') AS w, trim(string_agg(text, chr(10) ORDER BY n)) AS text FROM s GROUP BY doc_id, entry)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, CAST(0 AS INT) AS k, md5(text) AS digest FROM t WHERE len(w) BETWEEN 1 AND 60 UNION ALL SELECT doc_id, CAST(entry AS BIGINT), CAST((i - 1) // 40 AS INT), md5(array_to_string(w[greatest(i - 8, 1):i + 39], ' ')) FROM (SELECT *, unnest(range(1, len(w) + 1, 40)) AS i FROM t WHERE len(w) > 60)""")
def section_bounded_chunks(spark, sf_dir):
    """Sections of up to 60 words whole, others in pieces of 40 words that overlap by 8."""
    rows = lines(spark, sf_dir).withColumn("entry", F.sum(F.col("level").isin("L1", "L2").cast("int")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    texts = rows.groupBy("doc_id", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return section_chunks(texts, 60, 40, 8).select("doc_id", "entry", "k", F.md5("text").alias("digest"))


@query()
def balanced_sentences(spark, sf_dir):
    """Documents in chunks of equal size of about 1,000 characters, cut between sentences (held against a plain version in the tests)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(balanced_chunks("text", 1000)).alias("k", "text")).select("doc_id", "k", F.length("text").alias("size"), F.md5("text").alias("digest"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
f AS (SELECT doc_id, list_reduce(list_concat([{'o': ['']::VARCHAR[], 'h': ''}], list_transform(p, lambda x: {'o': ['']::VARCHAR[], 'h': x})), lambda a, x: CASE WHEN len(string_split(a.h || x.h, ' ')) < 25 THEN {'o': a.o, 'h': a.h || x.h} ELSE {'o': list_append(a.o, a.h || x.h), 'h': ''} END) AS r FROM p)
SELECT doc_id, list_transform(list_concat(r.o[2:], CASE WHEN r.h <> '' THEN [r.h] ELSE [] END), lambda x: md5(x)) AS digests FROM f""")
def carry_over_chunks(spark, sf_dir):
    """Lines joined on until they have 25 words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(carried_chunks(F.split("text", "\n")), lambda x: F.md5(x)).alias("digests"))


@query("""SELECT doc_id AS chunk_id, [CASE WHEN doc_id % 3 > 0 THEN 'p' || doc_id END, CASE WHEN (doc_id + 1) % 3 > 0 AND doc_id + 1 < (SELECT count(*) FROM documents) THEN 'p' || (doc_id + 1) END] AS printed_pages, CASE WHEN doc_id % 2 = 0 THEN ['n' || doc_id] WHEN doc_id + 1 < (SELECT count(*) FROM documents) THEN ['n' || (doc_id + 1)] ELSE [] END AS notes FROM documents""")
def chunk_labels_and_notes(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("i")), F.col("i")
    chunks = d.select(i.alias("chunk_id"), F.array(i, i + 1).alias("pages"))
    out = with_labels_and_notes(chunks, d.select(i.alias("page"), F.when(i % 3 > 0, F.concat(F.lit("p"), i)).alias("printed")), d.filter("i % 2 = 0").select(i.alias("page"), F.lit(1).alias("num"), F.concat(F.lit("n"), i).alias("text")))
    return out.select(F.col("chunk_id").cast("long").alias("chunk_id"), "printed_pages", F.transform("footnotes", lambda f: f["text"]).alias("notes"))
