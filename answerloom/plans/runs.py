"""Plans and runs: question sets, planned pairs, work that is left, guards, samples, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.catalog import query
from answerloom.sources.tables import table

KEY = ["model", "version", "format", "run", "qid"]


def question_union(sets: list[DataFrame], corrected: DataFrame, removed: DataFrame) -> DataFrame:
    """Question sets one after another (ord, place): removed ones left out, corrected ones become answerable."""
    whole = None
    for i, s in enumerate(sets):
        one = s.withColumn("ord", F.lit(i))
        whole = one if whole is None else whole.unionByName(one, allowMissingColumns=True)
    kept = whole.join(removed.select("qid"), "qid", "left_anti").join(corrected.select("qid", F.col("expected").alias("right")), "qid", "left")
    return kept.withColumn("label", F.when(F.col("right").isNotNull(), "answerable").otherwise(F.col("label"))).withColumn("expected", F.coalesce("right", "expected")).drop("right")


def pending(pairs: DataFrame, n_runs: int, prepared: DataFrame, saved: DataFrame) -> DataFrame:
    """Planned answers that are not saved yet: pairs (model, version, format) x runs x questions that go to the model.

    pairs is a stated plan of a few rows; the product is as large as the work itself.
    """
    plan = pairs.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))
    asked = prepared.filter(F.col("action").isin("answer", "answer_with_note")).select("qid")
    return asked.join(F.broadcast(plan)).join(saved.select(*KEY), KEY, "left_anti").select(*KEY)


def repeated_answers(answers: DataFrame, by: str, order: str, text: str, allowed: list[str], limit: int = 10) -> DataFrame:
    """by, text, n, first: runs of at least limit equal answers one after another; allowed texts break a run."""
    w = Window.partitionBy(by).orderBy(order)
    t = F.trim(text)
    marked = answers.withColumn("t", t).withColumn("new", F.when(F.lag(F.trim(text)).over(w).eqNullSafe(F.col("t")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(~F.col("t").isin(allowed)).groupBy(by, "island").agg(F.first("t").alias("text"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter(F.col("n") >= limit).drop("island")


#: Parts of a stratum that are cut to its quota before it is put in order as a whole.
PARTS = 64


def stratified_sample(rows: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Of every stratum its share, rounded to whole rows, in the order of a seeded hash of the key; reruns agree.

    Several columns keep their mix: each of their combinations is a stratum, a null one too. Parts of a stratum are cut to the
    quota first, so no task puts a whole stratum in order.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    quota = rows.groupBy(*strata).agg(F.round(F.count(F.lit(1)) * F.lit(share)).cast("long").alias("aw_quota"))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in strata))
    some = rows.alias("r").join(quota.alias("q"), same).select("r.*", "aw_quota").withColumns({"aw_h": h, "aw_part": F.pmod(F.xxhash64(key), F.lit(PARTS))})
    for by in ([*strata, "aw_part"], strata):
        some = some.withColumn("aw_n", F.row_number().over(Window.partitionBy(*by).orderBy("aw_h", key))).filter("aw_n <= aw_quota")
    return some.drop("aw_quota", "aw_h", "aw_part", "aw_n")


def latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key, without a window: a maximum of structs is pre-aggregated."""
    rest = [c for c in rows.columns if c not in key and c != seq]
    return rows.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("last")).select(*key, "last.*")


def planned_pairs(plan: list[dict]) -> list[tuple[str, str]]:
    """(model, version) group by group, version by version, model by model."""
    return [(m, v) for group in plan for v in group["versions"] for m in group["models"]]


def planned_versions(plan: list[dict]) -> list[str]:
    """Each version once, in the order of the plan."""
    return list(dict.fromkeys(v for _, v in planned_pairs(plan)))


def listed_questions(questions: DataFrame, screen: DataFrame | None) -> DataFrame:
    """All questions, or those of a list (qid, place) in its order; a listed one that is missing is an error when it is read."""
    if screen is None:
        return questions
    known = questions.withColumn("aw_known", F.lit(True))
    rows = screen.select("qid", "place").join(known, "qid", "left").withColumn("qid", F.when(F.col("aw_known"), F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("no question "), "qid"))))
    return rows.orderBy("place").drop("place", "aw_known")


def call_counts(questions: DataFrame, needed: str, n_pairs: int, n_runs: int) -> DataFrame:
    """questions, rewrites, most_answers: what a run would call, without a call."""
    return questions.agg(F.count(F.lit(1)).alias("questions"), F.count_if(needed).alias("rewrites"), (F.count(F.lit(1)) * n_pairs * n_runs).alias("most_answers"))


# Providers by the prefix of a model's name.
PROVIDERS = ("groq", "openrouter", "nvidia", "gemini", "cerebras")


def provider_of(model, local: str = "local") -> Column:
    """provider and name of a model: "prefix:name" of a known prefix, else the local one."""
    model = F.col(model) if isinstance(model, str) else model
    known = F.contains(model, F.lit(":")) & F.substring_index(model, ":", 1).isin(*PROVIDERS)
    return F.struct(F.when(known, F.substring_index(model, ":", 1)).otherwise(local).alias("provider"), known.alias("hosted"), F.when(known, F.regexp_replace(model, "^[^:]*:", "")).otherwise(model).alias("name"))


def waits(tries: int, first: float = 2.0, most: float = 120.0) -> list[float]:
    """Seconds before each further try: doubled each time, never over `most`."""
    return [min(most, first * 2**i) for i in range(max(0, tries - 1))]


def asked_with_retries(call, tries: int, sleep) -> dict:
    """call() -> {status, text}; 429 and 5xx are tried again after waits, anything else is final. Returns text or error."""
    last: dict = {}
    for wait in (0.0, *waits(tries)):
        if wait:
            sleep(wait)
        last = call()
        status = last.get("status", 200)
        if status == 200:
            return {"text": last.get("text", ""), "error": None}
        if status != 429 and status < 500:
            break
    return {"text": "", "error": f"status {last.get('status')}"}


def is_real_answer(reply: Column) -> Column:
    """Whether a model answers at all: it is asked for 6 * 7."""
    return F.contains(reply, F.lit("42"))


def answered(jobs: DataFrame, provider=None, allow_calls: bool = False) -> DataFrame:
    """jobs (KEY, system, user) with answer and error. Without leave to call, or a provider, nothing is called and every error says so.

    provider(model) -> callable(system, user) -> {status, text}; made once a task. An error stops the rest of its pair in that task.
    """
    if provider is None or not allow_calls:
        return jobs.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit("dry run")})
    import time

    def work(batches):
        made, stopped = {}, {}
        for b in batches:
            answers, errors = [], []
            for r in b.itertuples():
                pair = (r.model, r.version)
                if pair in stopped:
                    answers.append(None)
                    errors.append(f"stopped: {stopped[pair]}")
                    continue
                ask = made.setdefault(r.model, provider(r.model))
                got = asked_with_retries(lambda ask=ask, r=r: ask(r.system, r.user), 3, time.sleep)
                if got["error"]:
                    stopped[pair] = got["error"]
                answers.append(None if got["error"] else got["text"])
                errors.append(got["error"])
            yield b.assign(answer=answers, error=errors)

    schema = ", ".join(f"`{n}` {t}" for n, t in jobs.dtypes) + ", answer string, error string"
    return jobs.repartition("model", "version").mapInPandas(work, schema)


def manifest(run_id: str, settings: dict, fingerprints: dict[str, str], counts: dict, now: str) -> dict:
    """What a run starts with: its settings and their hash, the inputs' fingerprints, the plan's counts, versions in use."""
    import platform

    import pyspark

    from answerloom.plans.settings import settings_hash

    return {"run_id": run_id, "status": "dry_run", "started_at": now, "finished_at": None, "config": {"merged": settings, "hash": settings_hash(settings)}, "inputs": fingerprints, "plan": counts, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}}


def traces(records: DataFrame) -> DataFrame:
    """qid and one JSON line of a question's stages: the question, its grade, its hits (id, rank, score), its prompt."""
    hits = F.transform("hits", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["rank"].alias("rank"), F.round(h["score"], 2).alias("score")))
    line = F.struct(F.struct(F.col("question").alias("text"), "fixed").alias("question"), F.struct("grade", "action").alias("gate"), hits.alias("hits"), F.struct("prompt_hash").alias("prompt"))
    return records.select("qid", F.to_json(line).alias("line"))


@query("""SELECT item_id AS qid, '{"question":{"text":"q' || item_id || '","fixed":"f"},"gate":{"grade":"S","action":"answer"},"hits":[{"chunk_id":"c' || item_id || '","rank":1,"score":1.23}],"prompt":{"prompt_hash":"h"}}' AS line FROM benchmark""")
def nested_traces(spark, sf_dir):
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(i.alias("qid"), F.concat(F.lit("q"), i).alias("question"), F.lit("f").alias("fixed"), F.lit("S").alias("grade"), F.lit("answer").alias("action"), F.array(F.struct(F.concat(F.lit("c"), i).alias("chunk_id"), F.lit(1).alias("rank"), F.lit(1.2345).alias("score"), F.lit("long").alias("text"))).alias("hits"), F.lit("h").alias("prompt_hash"))
    return traces(rows)


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'local' ELSE 'local' END AS provider, CASE c_custkey % 3 WHEN 0 THEN 'a:b' || c_custkey WHEN 1 THEN 'm:x' ELSE 'plain' END AS name, c_custkey % 42 = 0 OR contains(CAST(c_custkey AS VARCHAR), '42') AS real FROM customer""")
def provider_routes(spark, sf_dir):
    k = F.col("c_custkey")
    model = F.when(k % 3 == 0, F.concat(F.lit("groq:a:b"), k)).when(k % 3 == 1, "m:x").otherwise("plain")
    return table(spark, sf_dir, "customer").select("c_custkey", provider_of(model).alias("p"), is_real_answer(F.when(k % 42 == 0, "it is 42").otherwise(k.cast("string"))).alias("real")).select("c_custkey", "p.provider", "p.name", "real")


@query("""SELECT count(*) AS questions, count(*) FILTER (length(text) > 200) AS rewrites, count(*) * 6 AS most_answers FROM benchmark""")
def dry_run_counts(spark, sf_dir):
    return call_counts(table(spark, sf_dir, "benchmark").withColumn("needed", F.length("text") > 200), "needed", 3, 2)


@query("""SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark ORDER BY -item_id""")
def screen_questions(spark, sf_dir):
    """Questions in the order of a list, the last first."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text", "item_id")
    return listed_questions(b.select("qid", "text"), b.select("qid", (-F.col("item_id")).alias("place")))


@query("""SELECT 'a' AS model, 'v1' AS version, CAST(item_id AS VARCHAR) AS qid, NULL::VARCHAR AS answer, 'dry run' AS error FROM benchmark""")
def answer_loop(spark, sf_dir):
    """Work that is left, without leave to call a model."""
    jobs = table(spark, sf_dir, "benchmark").select(F.lit("a").alias("model"), F.lit("v1").alias("version"), F.col("item_id").cast("string").alias("qid"), F.lit("s").alias("system"), F.col("text").alias("user"))
    return answered(jobs).select("model", "version", "qid", "answer", "error")


@query("""WITH p(model, version) AS (VALUES ('a', 'v1'), ('a', 'v2'), ('b', 'v1')), r AS (SELECT unnest([1, 2]) AS run),
q AS (SELECT CAST(item_id AS VARCHAR) AS qid FROM benchmark WHERE item_id % 5 <> 0), s AS (SELECT 'a' AS model, 'v1' AS version, 1 AS run, CAST(item_id AS VARCHAR) AS qid FROM benchmark WHERE item_id % 3 = 0)
SELECT model, version, 'f0' AS format, CAST(run AS INT) AS run, qid FROM p, r, q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.model = p.model AND s.version = p.version AND s.run = r.run AND s.qid = q.qid)""")
def pending_work(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.when(F.col("item_id") % 5 == 0, "reject").otherwise("answer").alias("action"))
    pairs = spark.createDataFrame([("a", "v1", "f0"), ("a", "v2", "f0"), ("b", "v1", "f0")], "model string, version string, format string")
    saved = items.filter("cast(qid as int) % 3 = 0").select(F.lit("a").alias("model"), F.lit("v1").alias("version"), F.lit("f0").alias("format"), F.lit(1).alias("run"), "qid")
    return pending(pairs, 2, items, saved)


@query("""WITH a AS (SELECT CAST(item_id AS VARCHAR) AS qid, 'answerable' AS label, 'e' || item_id AS expected, 0 AS ord FROM benchmark WHERE item_id < 25 UNION ALL SELECT format('N{:02d}', item_id), 'unanswerable', NULL, 1 FROM benchmark WHERE item_id >= 25)
SELECT qid, CASE WHEN qid LIKE 'N3%' THEN 'answerable' ELSE label END AS label, CASE WHEN qid LIKE 'N3%' THEN 'fixed ' || qid ELSE expected END AS expected, CAST(ord AS INT) AS ord FROM a WHERE qid NOT LIKE '1%'""")
def question_set(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    first = items.filter("item_id < 25").select(F.col("item_id").cast("string").alias("qid"), F.lit("answerable").alias("label"), F.concat(F.lit("e"), "item_id").alias("expected"))
    second = items.filter("item_id >= 25").select(F.format_string("N%02d", "item_id").alias("qid"), F.lit("unanswerable").alias("label"), F.lit(None).cast("string").alias("expected"))
    return question_union([first, second], second.filter("qid like 'N3%'").select("qid", F.concat(F.lit("fixed "), "qid").alias("expected")), first.filter("qid like '1%'").select("qid"))


@query("""WITH m AS (SELECT user_id, event_id, event_type AS t, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(t) AS text, count(*) AS n, min(event_id) AS first FROM i WHERE t <> 'view' GROUP BY user_id, island HAVING count(*) >= 2""")
def repeated_answer_guard(spark, sf_dir):
    """Users with the same event twice or more in a row, views aside."""
    return repeated_answers(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["view"], 2)


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def latest_per_key(spark, sf_dir):
    return latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS n, round(count(*) OVER (PARTITION BY lang, source) * 0.1::DOUBLE) AS q FROM documents) SELECT doc_id, lang, source FROM d WHERE n <= q""")
def sample_by_stratum(spark, sf_dir):
    """A tenth of the documents of every language and source."""
    return stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1, 7)


@query("""SELECT event_id, 'run' || (user_id % 3) AS run_id, printf('%s user %d value %.2f', event_type, user_id, value) AS line FROM events""")
def trace_lines(spark, sf_dir):
    """One line of log for each event."""
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("run"), F.col("user_id") % 3).alias("run_id"), F.format_string("%s user %d value %.2f", "event_type", "user_id", "value").alias("line"))


@query("""WITH e AS (SELECT 'run' || (user_id % 3) AS run_id, event_type FROM events) SELECT run_id, count(*) AS answers, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM e GROUP BY run_id""")
def run_index(spark, sf_dir):
    """One row a run with the counts of two stages."""
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("user_id") % 3).alias("run_id"), "event_type")
    counts = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"))
    return counts
