"""The relational catalogue: joins, aggregations, windows, sets and reshaping over plain tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from answerloom.catalog import query
from answerloom.sources.tables import table

# Money is a double in the tables, whose sums depend on their order: results are rounded.


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    """Inner joins; the planner picks broadcast or sort-merge by measured sizes."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey""")
def left_join(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_suppkey % 60 + 10 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 50).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 60 + 10).alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("""SELECT r_name, coalesce(n, 0) AS n FROM (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 5 GROUP BY 1) RIGHT JOIN region ON n_regionkey = r_regionkey""")
def right_join(spark, sf_dir):
    """Counts over a fixed domain, zero where there are none."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 5").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").select("r_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1""")
def semi_join(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(large, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(placed, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT r_name, m, count(c_custkey) AS n FROM region CROSS JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY']) AS m) LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey AND c_mktsegment = m GROUP BY ALL""")
def plan_product(spark, sf_dir):
    """The product of two stated small sets, filled with counts."""
    grid = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "MACHINERY")))).alias("m"))
    per = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(per, ["r_regionkey", "m"], "left").select("r_name", "m", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT a.o_orderkey, b.o_orderkey AS before FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 AND a.o_orderpriority = b.o_orderpriority""")
def adjacency(spark, sf_dir):
    """Rows beside the row just before them, by an equi-join on the number less one instead of a window over everything."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_orderkey").alias("before"), "o_orderpriority"), ["o_orderkey", "o_orderpriority"]).select("o_orderkey", "before")


@query("""SELECT l_linestatus, l_returnflag, CAST(grouping_id(l_linestatus, l_returnflag) AS BIGINT) AS gid, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)""")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_linestatus", "l_returnflag").agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((y, q), (y, p), ())""".replace("(y, q), (y, p)", "(year(o_orderdate), quarter(o_orderdate)), (year(o_orderdate), o_orderpriority)"))
def grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q"), F.col("o_orderpriority").alias("p"))
    return o.groupingSets([[F.col("y"), F.col("q")], [F.col("y"), F.col("p")], []], "y", "q", "p").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, count(*) FILTER (year(o_orderdate) = 1995) AS y1995, count(*) FILTER (year(o_orderdate) = 1996) AS y1996 FROM orders GROUP BY 1""")
def pivot(spark, sf_dir):
    """Stated pivot values, so no pass over the table is needed to find them."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"))
    return o.groupBy("o_orderpriority").pivot("y", ["y1995", "y1996"]).count().na.fill(0)


@query("""SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def unpivot(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["balance", "nation"], "name", "value")


@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quarter, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranks(spark, sf_dir):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(v), 9).alias("pr"), F.round(F.cume_dist().over(v), 9).alias("cd"))


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS urgent, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def running_state(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after"), F.last(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")), ignorenulls=True).over(so_far).alias("urgent"), F.count(F.lit(1)).over(so_far).alias("so_far"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS mean_hour, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS last_three FROM events""")
def frames(spark, sf_dir):
    """A range frame of one hour and a frame of the three rows before."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    hour = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)
    three = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, -1)
    return e.select("event_id", F.round(F.avg("value").over(hour), 6).alias("mean_hour"), F.round(F.sum("value").over(three), 6).alias("last_three"))


@query("""SELECT p_partkey, p_type, p_retailprice, rank FROM (SELECT p_partkey, p_type, p_retailprice, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INT) AS rank FROM part) WHERE rank <= 3""")
def top_per_group(spark, sf_dir):
    """The three dearest parts of every type; partial limits cut the rows before the shuffle."""
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier""")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer only' FROM customer EXCEPT SELECT s_nationkey, 'customer only' FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer only")))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1""")
def keep_first(spark, sf_dir):
    """One row a key, the first by date: a minimum of structs, which is pre-aggregated."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("first_order"))


@query("""SELECT l_linestatus, count(DISTINCT l_suppkey) AS suppliers, median(l_quantity) AS mid, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev(l_quantity), 6) AS spread, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""")
def describe(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.median(q).alias("mid"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.stddev(q), 6).alias("spread"), F.round(F.percentile(q, 0.9), 6).alias("p90"))


@query("""SELECT l_partkey, arg_max(l_linestatus, (n, l_linestatus)) AS mode, max(n) AS n FROM (SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def most_common(spark, sf_dir):
    """The most common value of each key, ties by name."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_partkey").agg(F.max(F.struct("n", "l_linestatus")).alias("m")).select("l_partkey", F.col("m.l_linestatus").alias("mode"), F.col("m.n").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)""")
def scalar_subquery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.crossJoin(F.broadcast(o.agg((F.avg("o_totalprice") * 1.8).alias("limit")))).filter("o_totalprice > limit").select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)""")
def correlated_subquery(spark, sf_dir):
    """Lines far above their part's mean: the mean is aggregated once and joined."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return li.join(li.groupBy("l_partkey").agg((1.5 * F.avg("l_quantity")).alias("limit")), "l_partkey").filter("l_quantity > limit").select("l_orderkey", "l_linenumber")


@query("""SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, string_agg(n_name, ', ' ORDER BY n_name) AS text FROM nation GROUP BY 1""")
def nested_rows(spark, sf_dir):
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    names = F.transform("r", lambda x: x["n_name"])
    return g.select("n_regionkey", names.alias("names"), F.array_join(F.array_sort(names), ", ").alias("text"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH w AS (SELECT event_id, to_timestamp(floor(epoch(ts) / 1800) * 1800 - k * 1800)::TIMESTAMP AS start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n FROM w GROUP BY start""".replace("to_timestamp(", "make_timestamp(1000000 * CAST(").replace("k * 1800)::TIMESTAMP", "k * 1800 AS BIGINT))"))
def sliding_windows(spark, sf_dir):
    """Windows of one hour every half hour."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")
    return table(spark, sf_dir, "events").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def session_windows(spark, sf_dir):
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH f AS (SELECT n_nationkey AS area, unnest(['total_5', 'total_6']) AS round, unnest([n_nationkey * 2, n_nationkey * 3]) AS value, n_name FROM nation) SELECT area, string_agg(n_name || ' ' || round || ' ' || value, '; ' ORDER BY round) AS expected FROM f GROUP BY area""")
def indicator_answers(spark, sf_dir):
    """Expected answers of indicator questions: wide rounds unpivoted, facts joined by semicolons."""
    wide = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), "n_name", (F.col("n_nationkey") * 2).alias("total_5"), (F.col("n_nationkey") * 3).alias("total_6"))
    long = wide.unpivot(["area", "n_name"], ["total_5", "total_6"], "round", "value")
    g = long.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("round", F.concat_ws(" ", "n_name", "round", "value").alias("fact")))).alias("f"))
    return g.select("area", F.array_join(F.transform("f", lambda x: x["fact"]), "; ").alias("expected"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), n AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.o_totalprice - b.o_totalprice), b.o_orderkey) AS r FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)
SELECT a AS o_orderkey, b AS nearest FROM n WHERE r = 1""")
def nearest_join(spark, sf_dir):
    """The order of the same customer that is nearest in price: neighbours of a sort, not pairs; ties by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy("o_totalprice", F.desc("o_orderkey"))
    # below: of equal prices the least key; above: the row after
    below, above = F.lag(F.struct("o_totalprice", "o_orderkey")).over(v), F.lead(F.struct("o_totalprice", "o_orderkey")).over(w)
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey", "o_totalprice"))
    same = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_totalprice").orderBy("o_orderkey"))
    rows = o.withColumns({"below": below, "above": above, "first": first, "same": same})
    cost = lambda c: F.struct(F.abs(F.col("o_totalprice") - F.col(f"{c}.o_totalprice")).alias("d"), F.col(f"{c}.o_orderkey").alias("k"))
    equal = F.when(F.col("first") != F.col("o_orderkey"), F.struct(F.lit(0.0).alias("d"), F.col("first").alias("k"))).when(F.col("same").isNotNull(), F.struct(F.lit(0.0).alias("d"), F.col("same").alias("k")))
    best = F.array_min(F.filter(F.array(equal, F.when(F.col("below").isNotNull(), cost("below")), F.when(F.col("above").isNotNull(), cost("above"))), lambda x: x.isNotNull()))
    return rows.withColumn("best", best).filter("best is not null").select("o_orderkey", F.col("best.k").alias("nearest"))


@query("""SELECT DISTINCT a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT l_orderkey AS o_orderkey, l_partkey FROM lineitem WHERE l_quantity > 48) a JOIN (SELECT l_orderkey AS o_orderkey, l_partkey FROM lineitem WHERE l_quantity > 48) b ON a.l_partkey = b.l_partkey AND a.o_orderkey < b.o_orderkey""")
def set_overlap(spark, sf_dir):
    """Orders whose sets of large parts overlap: an equi-join on the exploded members instead of a test of every pair."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    each = rows.select("l_orderkey", F.explode("parts").alias("p"))
    return each.select(F.col("l_orderkey").alias("a"), "p").join(each.select(F.col("l_orderkey").alias("b"), "p"), "p").filter("a < b").select("a", "b").distinct()


@query("""SELECT p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type ORDER BY first""")
def ordered_groups(spark, sf_dir):
    """Groups in the order of their first row."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first")).orderBy("first")


@query("""SELECT o_orderkey, strptime(strftime(o_orderdate, '%-d %B, %Y'), '%d %B, %Y')::DATE AS parsed FROM orders""")
def text_dates(spark, sf_dir):
    """Dates written out with ordinals, read back; what is no date gives null."""
    d = F.col("o_orderdate")
    n = F.dayofmonth(d)
    tail = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    text = F.concat(n.cast("string"), tail, F.lit(" "), F.date_format(d, "MMMM, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_to_date(F.regexp_replace(text, r"(\d)(st|nd|rd|th)", "$1"), "d MMMM, yyyy").alias("parsed"))
