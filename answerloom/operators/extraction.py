"""Extraction and cleaning: pages to text, clutter and repeated lines, headings, sections, tables, names, positions.

The raw input here are HTML pages; operators on lines and boxes take plain tables, so that any page reader can feed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.functions import text as T
from answerloom.sources.shared import save
from answerloom.sources.tables import table

_UNBOUNDED = Window.unboundedPreceding


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, navigation, advertisements and comments go, blocks become lines."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|nav|footer|head)\b.*?</\1>", "")
    c = F.regexp_replace(c, r"(?is)<div class=\"ad\">.*?</div>", "")
    c = F.regexp_replace(c, r"(?i)<(/?(p|div|h[1-6]|li|tr|article|section)\b[^>]*|br\s*/?)>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return F.array_join(lines, "\n")


def page_class(n_words: Column, title: Column, known_titles: list[str]) -> Column:
    """The first rule that holds: cover, blank, turned side label, part label, notes, scanned, text."""
    turned = F.reverse(title).isin(known_titles)
    return (
        F.when(n_words == 0, F.when(title == "", "blank").otherwise("scanned")).when(turned | title.isin(known_titles), "part label").when(F.lower(title).rlike("^notes?$"), "notes").when(n_words < 5, "cover").otherwise("text")
    )


def label_map(pages: DataFrame) -> DataFrame:
    """Adds printed and status: a footer number against the file's label; the footer wins."""
    status = F.when(F.col("footer").isNull(), "no footer").when(F.col("footer") == F.col("label"), "matched").otherwise("mismatch")
    return pages.withColumns({"printed": F.coalesce("footer", "label"), "status": status})


def repeated(rows: DataFrame, key: str, group: str, least: int) -> DataFrame:
    """key, n_groups, n, first_group: values that occur in at least `least` groups; pre-aggregated per value and group."""
    per = rows.groupBy(key, group).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n"), F.min(group).alias("first_group")).filter(F.col("n_groups") >= least)


#: Kinds of clutter and their patterns.
CLUTTER = {"url": r"https?://\S+", "mail": r"\S+@\S+\.\S+", "page_number": r"(?m)^\s*\d{1,4}\s*$", "dots": r"\.{4,}", "bullet": r"•", "double_space": r"  +", "symbols": r"[#*$%&|<>]{2,}", "digits": r"\d{6,}"}


def clutter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """kind, n, n_docs, example: each kind of clutter with the first example of the smallest key; one pass over the texts."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found")) for k, p in CLUTTER.items()))
    rows = docs.select(key, F.inline(found)).filter(F.size("found") > 0)
    return rows.groupBy("kind").agg(F.sum(F.size("found")).alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(F.col(key), F.element_at("found", 1).alias("example")))["example"].alias("example"))


def as_of(rows: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """rows with the value of the latest mark at or before each row of the same `by`: one union and one window, no range join.

    Marks at the same place come first; several at one place: the greatest value.
    """
    both = rows.withColumn("aw_side", F.lit(1)).unionByName(marks.groupBy(by, at).agg(F.max(value).alias("aw_value")).withColumn("aw_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "aw_side").rowsBetween(_UNBOUNDED, 0)
    return both.withColumn(value, F.last("aw_value", ignorenulls=True).over(order)).filter("aw_side = 1").drop("aw_side", "aw_value")


#: Points of a block, parts that the points of a band are dealt into, and partitions for each of the session's shuffle partitions.
BLOCK, DEALT, PARTS = 128, 8, 2


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points beside every range lo..hi that holds them. Both are cut into bands of `width`, so it is an equi-join on bands.

    Every pair is given out, so rows grow with the product of both tables. Points of a band meet its ranges by blocks of neighbours: one
    range after another gives out the same points in the same order, which files keep in a fraction of a byte a row. Partitions are
    many, so that the dictionaries of their files suffice.
    """
    spark = points.sparkSession
    n = PARTS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys, value, point = ["aw_band", "aw_part"], F.col("aw_point")[at], F.struct(*points.columns).alias("aw_point")
    part = F.pmod(F.xxhash64(*points.columns), F.lit(DEALT)).cast("int")
    dealt = points.filter(F.col(at).isNotNull()).select(F.floor(F.col(at) / width).alias("aw_band"), part.alias("aw_part"), point).repartition(n, *keys)
    block = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1) / BLOCK)
    blocks = dealt.withColumn("aw_block", block).groupBy(*keys, "aw_block").agg(F.min(value).alias("aw_least"), F.max(value).alias("aw_most"), F.collect_list("aw_point").alias("aw_points"))
    banded = ranges.withColumn("aw_band", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    banded = banded.withColumn("aw_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    met = blocks.join(banded.hint("merge"), keys).filter((F.col(lo) <= F.col("aw_most")) & (F.col(hi) >= F.col("aw_least")))
    whole = (F.col(lo) <= F.col("aw_least")) & (F.col(hi) >= F.col("aw_most"))
    held = F.when(whole, F.col("aw_points")).otherwise(F.filter("aw_points", lambda p: p[at].between(F.col(lo), F.col(hi))))
    return met.select(F.explode(held).alias("aw_point"), *ranges.columns).select(*(F.col("aw_point")[c].alias(c) for c in points.columns), *ranges.columns)


def merged_ranges(ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """aw_band, lo, hi: what the ranges cover within each band of `width`, as ranges of which no two touch.

    Equal pieces are dropped first. Where no range is shorter than a band, a band keeps at most two pieces, however many ranges there are.
    """
    band = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    # only a piece's order and reach within its band matter, so what begins before the band begins at its edge; no bound is rounded within the band
    pieces = ranges.filter(F.col(lo) <= F.col(hi)).select(lo, hi, band.alias("aw_band"))
    start = F.when(F.floor(F.col(lo) / width) < F.col("aw_band"), F.lit(float("-inf"))).otherwise(F.col(lo).cast("double"))
    stop = F.when(F.floor(F.col(hi) / width) > F.col("aw_band"), F.lit(float("inf"))).otherwise(F.col(hi).cast("double"))
    pieces = pieces.select("aw_band", start.alias(lo), stop.alias(hi)).groupBy("aw_band", lo).agg(F.max(hi).alias(hi))
    order = Window.partitionBy("aw_band").orderBy(lo)
    reach = F.max(hi).over(order.rowsBetween(_UNBOUNDED, -1))
    new = F.coalesce(F.col(lo) > reach, F.lit(True))
    run = F.sum(F.when(F.col("aw_new"), 1).otherwise(0)).over(order.rowsBetween(_UNBOUNDED, 0))
    return pieces.withColumn("aw_new", new).withColumn("aw_run", run).groupBy("aw_band", "aw_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("aw_run")


def in_no_range(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points that no range lo..hi holds: each point meets the merged ranges of its band, of which one at most holds it."""
    merged = merged_ranges(ranges, lo, hi, width)
    held = (F.floor(F.col(at) / width) == F.col("aw_band")) & F.col(at).between(F.col(lo), F.col(hi))
    return points.join(merged, held, "left_anti")


def islands(rows: DataFrame, by: str, at: str, new: Column) -> DataFrame:
    """Adds island: a running number within `by` that grows where `new` holds."""
    return rows.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(at).rowsBetween(_UNBOUNDED, 0)))


def toc_entries(lines: DataFrame, by: str, at: str, text: str) -> DataFrame:
    """Lines joined until one ends in a page number: by, first, entry, title, page, level, number, parent (last title of level 0)."""
    order = Window.partitionBy(by).orderBy(at)
    ends = F.col(text).rlike(r"\d+\s*$")
    run = F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(_UNBOUNDED, -1)), F.lit(0))
    entries = lines.withColumn("run", run).groupBy(by, "run").agg(F.min(at).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), " ").alias("entry"))
    entries = entries.withColumns({"page": F.expr(r"try_cast(nullif(regexp_extract(entry, '(\\d+)\\s*$', 1), '') as int)"), "number": F.regexp_extract("entry", r"^(\d+(?:\.\d+)*)", 1)})
    entries = entries.withColumn("level", F.when(F.col("number") == "", 0).otherwise(F.size(F.split("number", r"\."))))
    entries = entries.withColumn("title", F.trim(F.regexp_replace("entry", r"^[\d.]+\s+|[\s.]*\d+\s*$", "")))
    parent = F.last(F.when(F.col("level") == 0, F.col("title")), ignorenulls=True).over(Window.partitionBy(by).orderBy("first").rowsBetween(_UNBOUNDED, -1))
    return entries.withColumn("parent", parent).drop("run")


def heading_score(a: Column, b: Column) -> Column:
    """3: equal, 2: same leading number, 1: one holds the other, 0: none; case, spaces and marks aside."""
    squash = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    number = lambda c: F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(squash(a) == squash(b), 3).when((number(a) != "") & (number(a) == number(b)), 2).when((squash(a) != "") & (F.contains(squash(b), squash(a)) | F.contains(squash(a), squash(b))), 1).otherwise(0)


def ancestor_paths(sections: DataFrame, rounds: int = 40) -> DataFrame:
    """id, root, depth, path over parent links, by joins of doubling reach: as many as the logarithm of the depth.

    A parent that is no row ends a path, and its child is a root. Rounds go on until no path grows; a cycle is refused. Each
    round is written, so its plan stays as short as the first.
    """
    known = sections.select(F.col("id").alias("p"))
    held = F.col("p").isNotNull()
    now = sections.join(known, F.col("parent") == F.col("p"), "left").select("id", F.when(held, F.col("parent")).alias("up"), F.when(held, F.array("parent", "id")).otherwise(F.array("id")).alias("path"))
    for _ in range(rounds):
        now = save(now, "paths")
        if now.filter("up is not null").isEmpty():
            return now.select("id", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path")
        above = now.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        now = now.join(above, now["up"] == above["a_id"], "left").select("id", F.col("a_up").alias("up"), F.when(F.col("a_id").isNull(), F.col("path")).otherwise(F.concat("a_path", F.slice("path", 2, F.size("path")))).alias("path"))
    raise ValueError("the parent links form a cycle")


def name_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """name, n, n_docs, example: runs of one to five capitalised words with a word that is never written in lower case."""
    lower = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[a-z]+(?![A-Za-z0-9_])"), F.lit(0))).alias("w")).distinct()
    if known is not None:
        lower = lower.unionByName(known.select(F.col("word").alias("w"))).distinct()
    runs = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?: [A-Z][a-z]+){0,4}(?![A-Za-z0-9_])"), F.lit(0))).alias("name"))
    counted = runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_docs"), F.min(key).alias("example"))
    word = counted.select("name", F.explode(F.split(F.lower("name"), " ")).alias("w"))
    odd = word.join(lower, "w", "left_anti").select("name").distinct()
    return counted.join(odd, "name", "left_semi")


def block_violations(blocks: DataFrame) -> DataFrame:
    """block_id, problem: what breaks the contract of blocks; a sound table gives no row."""
    checks = {"no id": "block_id is null or block_id = ''", "unknown unit": "unit not in ('section', 'letter', 'glossary')", "no page": "size(pdf_pages) = 0", "pages out of order": "array_sort(pdf_pages) <> pdf_pages", "no summary": "not searchable and coalesce(summary, '') = ''", "no path": "size(path) = 0"}
    rows = blocks.select("block_id", F.explode(F.filter(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())).alias("problem"))
    twice = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block_id", F.lit("repeated id").alias("problem"))
    lone = blocks.filter("parent_id is not null").select("block_id", F.col("parent_id").alias("p")).join(blocks.select(F.col("block_id").alias("p")), "p", "left_anti").select("block_id", F.lit("unknown parent").alias("problem"))
    return rows.unionByName(twice).unionByName(lone)


def header_keys(header: Column) -> Column:
    """Column names without the level that all many-level names share and without notes in brackets."""
    levels = F.transform(header, lambda h: F.split(h, " - "))
    many = F.filter(levels, lambda p: F.size(p) > 1)
    shared = F.when(F.size(many) > 1, F.aggregate(many, F.get(many, 0), lambda a, p: F.array_intersect(a, p))).otherwise(F.array().cast("array<string>"))
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\([^)]*\)", ""), r"\s+", " "))
    return F.transform(levels, lambda p: F.coalesce(F.nullif(F.array_join(F.transform(F.array_except(p, shared), clean), " - "), F.lit("")), clean(F.element_at(p, -1))))


def filled_header(rows: Column) -> Column:
    """Levels of a header, filled to the right where a cell is empty, joined per column; columns without a name are colN."""
    fill = lambda r: F.transform(r, lambda c, i: F.coalesce(F.try_element_at(F.filter(F.slice(r, 1, i + 1), lambda x: x != ""), F.lit(-1)), F.lit("")))
    filled = F.transform(rows, fill)
    width = F.size(F.get(rows, 0))
    names = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.array_join(F.array_distinct(F.filter(F.transform(filled, lambda r: F.get(r, i)), lambda c: c != "")), " - "))
    return F.transform(names, lambda n, i: F.when(n == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(n))


# ---- queries

@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<head\b.*?</head>', '', 'g') AS c FROM pages),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(c, '(?is)<div class="ad">.*?</div>', '', 'g'), '(?i)<(/?(p|div|h[1-6]|li|tr|article|section)\b[^>]*|br\s*/?)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS c FROM c),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS c FROM d),
l AS (SELECT page_id, list_filter(list_transform(string_split(c, chr(10)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM e)
SELECT page_id, CAST(len(l) AS INT) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l""")
def page_text(spark, sf_dir):
    t = html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.size(F.filter(F.split("t", "\n"), lambda s: s != "")).alias("n_lines"), F.md5("t").alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT line, doc_id, count(*) AS n FROM l GROUP BY ALL)
SELECT line, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n, min(doc_id) AS first_group FROM p GROUP BY line HAVING count(*) >= 5""")
def repeated_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return repeated(lines, "line", "doc_id", 5)


_CL = " UNION ALL ".join(f"SELECT '{k}' AS kind, doc_id, regexp_extract_all(text, '{p}') AS f FROM documents" for k, p in CLUTTER.items())


@query(f"WITH f AS ({_CL}) SELECT kind, CAST(sum(len(f)) AS BIGINT) AS n, count(*) AS n_docs, arg_min(f[1], doc_id) AS example FROM f WHERE len(f) > 0 GROUP BY kind")
def clutter_inventory(spark, sf_dir):
    return clutter(table(spark, sf_dir, "documents"))


@query("SELECT text_md5, count(*) AS n, min(doc_id) AS first FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY text_md5 HAVING count(*) > 1")
def dup_documents(spark, sf_dir):
    """Texts that more than one document has."""
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id").groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS c, doc_id FROM documents) SELECT c, CAST(ascii(c) AS INT) AS code, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS example FROM c WHERE ascii(c) > 126 GROUP BY c""")
def special_characters(spark, sf_dir):
    """Characters outside printable ASCII; other characters are removed before the text is cut into characters."""
    odd = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7E]", ""), "")).alias("c")).filter("c <> ''")
    per = odd.groupBy("c", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("c").agg(F.ascii(F.first("c")).alias("code"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("example"))


@query("""SELECT source, lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS share, count(DISTINCT doc_id % 10) AS pages, arg_min(left(text, 20), doc_id) AS example FROM documents GROUP BY source, lang""")
def font_profile(spark, sf_dir):
    """Counts, shares of all and first examples by two properties."""
    per = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("doc_id") % 10).alias("pages"), F.min(F.struct("doc_id", F.left("text", F.lit(20)).alias("t")))["t"].alias("example"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("source", "lang", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("share"), "pages", "example")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS footer, CASE WHEN doc_id % 10 = 0 THEN 'no footer' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'matched' END AS status, CASE WHEN doc_id % 10 = 0 AND doc_id % 7 = 0 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS printed FROM documents""")
def page_labels(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id").cast("string")).alias("footer"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("label"))
    return label_map(pages).drop("label")


@query("""SELECT doc_id, CASE WHEN w = 0 THEN CASE WHEN title = '' THEN 'blank' ELSE 'scanned' END WHEN reverse(title) IN ('5crs', 'src7') OR title IN ('5crs', 'src7') THEN 'part label' WHEN w < 5 THEN 'cover' ELSE 'text' END AS class FROM (SELECT doc_id, source AS title, n_chars // 100 AS w FROM documents)""")
def page_classes(spark, sf_dir):
    n = F.expr("n_chars div 100")
    return table(spark, sf_dir, "documents").select("doc_id", page_class(n, F.col("source"), ["5crs", "src7"]).alias("class"))


@query("""SELECT e.event_id, e.user_id, arg_max(m.value, (m.event_id, m.value)) AS value FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') m ON m.user_id = e.user_id AND m.event_id <= e.event_id GROUP BY e.event_id, e.user_id""")
def section_asof(spark, sf_dir):
    """For every event the value of the user's latest click at or before it."""
    events = table(spark, sf_dir, "events")
    return as_of(events.select("event_id", "user_id"), events.filter("event_type = 'click'").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("event_id", "user_id", "value")


@query("""SELECT o.o_orderkey, s.s_suppkey FROM orders o JOIN supplier s ON o.o_totalprice BETWEEN s.s_acctbal * 30 AND s.s_acctbal * 30 + 2000""")
def range_join(spark, sf_dir):
    """Orders beside suppliers whose range of prices holds them."""
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 30).alias("lo"), (F.col("s_acctbal") * 30 + 2000).alias("hi"))
    return in_ranges(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ranges, "o_totalprice", "lo", "hi", 2000.0).select("o_orderkey", "s_suppkey")


@query("""WITH r AS (SELECT s_acctbal * 30 AS lo, s_acctbal * 30 + 2000 AS hi FROM supplier) SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE o_totalprice BETWEEN lo AND hi)""")
def range_anti_join(spark, sf_dir):
    """Orders in no supplier's range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ranges = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") * 30).alias("lo"), (F.col("s_acctbal") * 30 + 2000).alias("hi"))
    return in_no_range(orders, ranges, "o_totalprice", "lo", "hi", 2000.0).select("o_orderkey")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY ALL""")
def event_islands(spark, sf_dir):
    """Runs of a user's events with gaps of at most six hours."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("at"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("at"))
    marked = events.withColumn("new", before.isNull() | (F.col("ts") > before + F.expr("interval 6 hours")))
    return islands(marked, "user_id", "at", F.col("new")).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query()
def toc_parent(spark, sf_dir):
    """Table-of-contents lines made of nations and regions (held against a plain version in the tests)."""
    n = table(spark, sf_dir, "nation")
    lines = n.select("n_regionkey", (F.col("n_nationkey") * 2).alias("at"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.col("n_name"), F.lit(" ... "), F.col("n_nationkey"))).otherwise(F.concat(F.col("n_nationkey"), F.lit(".1 "), F.col("n_name"), F.lit(" of the"))).alias("t"))
    more = n.filter("n_nationkey % 3 <> 0").select("n_regionkey", (F.col("n_nationkey") * 2 + 1).alias("at"), F.concat(F.lit("world ...... "), F.col("n_nationkey")).alias("t"))
    return toc_entries(lines.unionByName(more), "n_regionkey", "at", "t")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN x = y THEN 3 WHEN contains(x, y) OR contains(y, x) THEN 1 ELSE 0 END AS score FROM (SELECT *, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS x FROM nation) a, (SELECT *, regexp_replace(lower(left(n_name, 5 + n_nationkey % 4)), '[^a-z0-9]', '', 'g') AS y FROM nation) b WHERE a.n_regionkey = b.n_regionkey""")
def heading_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"))
    b = n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.expr("left(n_name, 5 + n_nationkey % 4)").alias("y"))
    return a.join(b, "n_regionkey").select("a", "b", heading_score(F.col("x"), F.col("y")).alias("score"))


_TREE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 100 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN c_custkey - c_custkey % 100 ELSE c_custkey - c_custkey % 10 END AS parent FROM customer"


@query(f"""WITH RECURSIVE t AS ({_TREE}), v AS (SELECT id, parent FROM t UNION SELECT 0, NULL), r AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM v WHERE parent IS NULL UNION ALL SELECT v.id, r.root, r.depth + 1, list_append(r.path, v.id) FROM v JOIN r ON v.parent = r.id)
SELECT id, root, CAST(depth AS INT) AS depth, path FROM r WHERE id > 0""")
def descendants(spark, sf_dir):
    """Customers as a tree of numbers: root, depth and path of each."""
    c = F.col("id")
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    ids = ids.unionByName(spark.range(1)).distinct()
    tree = ids.select("id", F.when(c % 100 == 0, F.lit(None)).when(c % 10 == 0, c - c % 100).otherwise(c - c % 10).cast("long").alias("parent"))
    return ancestor_paths(tree).filter("id > 0")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[a-z]+\b')) AS w FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,4}\b')) AS name FROM documents),
c AS (SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS example FROM r GROUP BY name)
SELECT * FROM c WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(lower(name), ' ')) AS x) WHERE x NOT IN (SELECT w FROM w))""")
def names_candidates(spark, sf_dir):
    return name_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS block_id, 'no summary' AS problem FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unknown unit' FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unknown parent' FROM documents WHERE doc_id % 17 = 0""")
def block_problems(spark, sf_dir):
    """Blocks made of documents, some of them broken on purpose."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    blocks = d.select(
        i.cast("string").alias("block_id"), F.when(i % 13 == 0, "page").otherwise("section").alias("unit"), F.array(F.lit(1), F.lit(2)).alias("pdf_pages"), (i % 9 != 0).alias("searchable"), F.lit("").alias("summary"), F.array("lang").alias("path"), F.when(i % 17 == 0, "none").alias("parent_id")
    )
    return block_violations(blocks)


@query("""WITH r AS (SELECT n_nationkey, n_name, 'Share ' || r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, [n_name, s || ' - Urban', s || ' - ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'col4' ELSE 'Rate - (%)' END] AS header, [n_name, 'Urban', n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'col4' ELSE 'Rate - ' END] AS keys FROM r""")
def table_headers(spark, sf_dir):
    """Two header rows of each nation's table filled to the right and joined, and names made short."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    share, odd = F.concat(F.lit("Share "), "r_name"), F.col("n_nationkey") % 2 == 1
    # in even ones an empty column comes first, so that nothing fills it
    rows = F.when(odd, F.array(F.array(F.col("n_name"), share, F.lit(""), F.lit("Rate")), F.array(F.lit(""), F.lit("Urban"), F.col("n_name"), F.lit("(%)")))).otherwise(F.array(F.array(F.lit(""), F.col("n_name"), share, F.lit("")), F.array(F.lit(""), F.lit(""), F.lit("Urban"), F.col("n_name"))))
    header = filled_header(rows)
    header = F.when(odd, header).otherwise(F.concat(F.slice(header, 2, 3), F.array(F.lit("col4"))))
    some = n.select("n_nationkey", header.alias("header"))
    keys = F.concat(header_keys(F.slice("header", 1, 3)), header_keys(F.slice("header", 4, 1)))
    return some.select("n_nationkey", "header", keys.alias("keys"))


@query("""SELECT conv_id, count(*) AS n_words, round(avg(length(w)), 6) AS conf, count(*) FILTER (length(w) >= 4) AS kept, string_agg(w, ' ' ORDER BY turn, k) FILTER (length(w) >= 4) AS line FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM conversations) GROUP BY conv_id""")
def ocr_lines(spark, sf_dir):
    """Words grouped to lines in order, with a mean confidence and only the surer ones kept (lengths stand for confidence)."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "w"))
    kept = F.array_sort(F.collect_list(F.when(F.length("w") >= 4, F.struct("turn", "k", "w"))))
    g = w.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.avg(F.length("w")), 6).alias("conf"), F.count_if(F.length("w") >= 4).alias("kept"), kept.alias("some"))
    return g.select("conv_id", "n_words", "conf", "kept", F.when(F.size("some") > 0, F.array_join(F.transform("some", lambda x: x["w"]), " ")).alias("line"))


@query("""SELECT doc_id, md5(regexp_replace(translate(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '’‘“”', '''''""'), '[‐‑‒–—―−]', '-', 'g')) AS digest FROM documents""".replace("\\\\", "\\"))
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise("text")).alias("digest"))
