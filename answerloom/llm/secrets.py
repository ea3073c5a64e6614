"""Secret scans with a random forest that removes false positives; DataFrame operations only.

Candidates are long unbroken runs of token characters with a digit, or of letters alone, values of any shape that a secret's
name is set to, passwords in URLs and the bodies of private keys; a name and its "=" are context. The forest sees the candidate's length, its character
transitions, how much of it a dictionary covers, its path and the words beside it, and is trained on labelled findings. The
dictionary is the corpus's own vocabulary, its most frequent words, with some words of code.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

_NAMES = r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|credentials?|auth)"
#: The body of a private key, up to its closing line.
_PEM = r"(?<=-)(?<=-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY-----)[^-]{16,}+(?:-(?!----)[^-]++)*+"
#: The password of a URL.
_LOGIN = r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s@/:\"'`]{3,256}(?=@)"
#: What a secret's name is set to: up to the closing quote, or to the next white space without one.
_NAMED = r"(?<=[=:>\"'`\s])(?<=[=:>]\s{0,3}[\"'`]?|(?i:bearer|basic)\s)(?<=" + _NAMES + r"[A-Za-z0-9_\-]{0,12}[\"'`]?\s{0,3}(?:=>|:=|==?|:)\s{0,3}(?:(?i:bearer|basic)\s)?[\"'`]?)(?!(?i:bearer|basic)\s)(?![=:>\s])(?:(?<=[\"'`])[^\"'`\n]{4,256}(?=[\"'`])|[^\s\"'`]{4,}[^\s\"'`,;)\]}])"
#: A run of token characters with a digit that no token character precedes, or of letters alone; neither is a name before "=".
_RUN = r"(?<![A-Za-z0-9_+/.\-])(?:(?=[A-Za-z_+/.\-]*[0-9])[A-Za-z0-9_+/.\-]{16,}+|[A-Za-z]{24,}+(?![A-Za-z0-9_+/.\-]))(?:={1,2}(?![A-Za-z0-9_+/.=\-\"'`$]))?+(?!=)"
CANDIDATE = "|".join((_PEM, _LOGIN, _NAMED, _RUN))
CONTEXT = 40
TREES, DEPTH, SEED, LEAST = 24, 7, 11, 0.5
#: The bound of the dictionary: so many of the corpus's most frequent words, with at least so many letters.
WORDS, LETTERS = 20_000, 4
#: Words of code and of samples, which prose may lack.
CODE = "example sample test dummy placeholder changeme your user name mail host local localhost http www com org net file path lib python site package version config data index page image static get set item value number table render handler buffer environ getenv process request headers settings self token secret password required optional string none null true false".split()
_PART = r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{2,}"
FEATURES = ("length", "transitions", "distinct", "digits", "hex", "covered", "path_code", "path_example", "named_secret", "named_other", "assigned", "quoted", "after_at", "prose", "login", "symbols", "upper")

_SECRET_WORD = r"(?i)(token|secret|api[_\- ]?key|access[_\- ]?key|passw(or)?d|pwd|passphrase|credential|bearer|auth|private[_\- ]?key)[^\n]{0,12}$"
_OTHER_WORD = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|uuid|etag|revision|build|card|account|order|phone|isbn|version|url|href|src)[^\n]{0,12}$"


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, path, start (characters before it), candidate, before, after."""
    found = docs.select("doc_id", F.col(path).cast("string").alias("path"), common.text_or_empty().alias("text"))
    found = found.filter(F.col("text").rlike(CANDIDATE))
    # what lies between the candidates gives both their places and their neighbours
    found = found.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("between"))
    starts = F.expr("aggregate(zip_with(found, slice(between, 1, size(found)), (f, b) -> named_struct('f', length(f), 'b', length(b))), named_struct('at', 0L, 'starts', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + x.b + x.f, 'starts', array_append(a.starts, a.at + x.b))).starts")
    rows = F.arrays_zip(F.col("found").alias("candidate"), F.slice("between", 1, F.size("found")).alias("before"), F.slice("between", 2, F.size("found")).alias("after"), starts.alias("start"))
    both = found.select("doc_id", "path", F.inline(rows))
    return both.withColumns({"before": F.right("before", F.lit(CONTEXT)), "after": F.left(F.coalesce("after", F.lit("")), F.lit(CONTEXT))})


def vocabulary(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """word: the most frequent words of all texts (ties by name), at most `words` of them, and the words of CODE."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(common.text_or_empty()), F.lit(r"\p{L}{%d,}" % LETTERS), F.lit(0))).alias("word"))
    most = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(words).select("word")
    return common.save(most.unionByName(docs.sparkSession.createDataFrame([(w,) for w in CODE], "word string")).distinct(), "vocabulary")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds covered: the share of a candidate's characters that lie in words. Needs row, which no other candidate has.

    A candidate is cut into words where its case changes and at other characters than letters. words has a bound, and is broadcast.
    """
    parts = found.select("row", F.explode(F.regexp_extract_all("candidate", F.lit(_PART), F.lit(0))).alias("part")).select("row", F.lower("part").alias("word"))
    sums = parts.join(F.broadcast(words), "word", "left_semi").groupBy("row").agg(F.sum(F.length("word")).alias("in_words"))
    return found.join(sums, "row", "left").withColumn("covered", F.coalesce(F.col("in_words"), F.lit(0)) / F.length("candidate")).drop("in_words")


def features(found: DataFrame) -> DataFrame:
    """Adds the other FEATURES; needs candidate, before, after and path."""
    c = F.col("candidate")
    size = F.length(c)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    share = lambda pattern: 1 - F.length(F.regexp_replace(c, pattern, "")) / size
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    path = F.lower(F.coalesce("path", F.lit("")))
    return found.withColumns(
        {
            "length": size.cast("double"),
            "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / size,
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
            "digits": share("[0-9]"),
            "hex": share("[0-9a-f]"),
            "path_code": yes(path.rlike(r"\.(py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|conf|toml)$|config|settings")),
            "path_example": yes(path.rlike("test|example|sample|fixture|mock|docs?/|readme")),
            "named_secret": yes(F.col("before").rlike(_SECRET_WORD)),
            "named_other": yes(F.col("before").rlike(_OTHER_WORD)),
            "assigned": yes(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
            "quoted": yes(F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")),
            "after_at": yes(F.col("before").rlike("[@/]$")),
            "login": yes(F.col("before").rlike(r"://[^\s:/@]*:$") & F.col("after").startswith("@")),
            "symbols": share(r"[^A-Za-z0-9_.\s]"),
            "upper": share("[A-Z]"),
            "prose": yes(F.col("before").rlike(r"\p{L}{2,} $") & F.col("after").rlike(r"^[ .,]")),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings of common kinds, made from hashes: candidate, before, after, path, label, kind. n bounds the training.

    They stand in for the findings of a review where a corpus has none, as no table here does; a table of real ones with
    these columns (kind aside) is the scan's input otherwise.
    """
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "x")
    digits = lambda k, m: F.substring(F.regexp_replace(F.concat(h(k), h(k + 50)), "[^0-9]", ""), 1, m)
    pick = lambda k, *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(words))) + 1).cast("int"))
    words = lambda k: F.concat_ws("_", *(pick(k + i, "get", "user", "name", "item", "value", "index", "table", "render", "config", "page", "handler", "buffer") for i in range(4)))
    name = pick(1, "token", "api_key", "secret", "password", "auth_token", "client_secret", "ACCESS_KEY", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "passwd", "S3_SECRET_KEY")
    opened = F.concat(name, pick(2, " = ", "=", ": "), pick(3, '"', "'", ""))
    prose = F.concat(pick(4, "about", "with", "und", "les", "para", "the", "from"), F.lit(" "))
    noted = F.concat(pick(5, "commit", "sha256", "checksum", "etag", "uuid", "revision", "build"), pick(6, " ", ": ", "="), pick(7, "", '"'))
    url = pick(8, "see http://", "user@", "12@", "https://", "src=/")
    login = F.concat(pick(43, "postgres", "mysql", "https", "redis", "amqp", "ftp"), F.lit("://"), pick(44, "admin", "root", "app", "svc", ""), F.lit(":"))
    letters = lambda k: F.regexp_replace(F.concat(b64(k), b64(k + 50)), "[0-9]", "")
    word = pick(45, "hunter", "dragon", "Winter", "Sup3rS3cret", "monkey", "S3cr3t", "Berlin", "qwerty")
    chosen = F.concat(word, digits(46, 2), F.substring(b64(47), 1, 3), pick(48, "!", "", "#", "$", "?x", "&7"))
    strange = F.concat(F.substring(b64(49), 1, 5), pick(50, "!", "#", "%", "&", "*"), F.substring(b64(51), 1, 4))
    camel = F.concat(*(F.initcap(pick(k, "get", "user", "name", "item", "value", "index", "table", "render", "config", "handler")) for k in range(52, 58)))
    code = pick(58, "os.environ", "settings.token", "getpass.getpass", "config.get", "self._token", "process.env.TOKEN", "request.headers", "string", "required", "None,", "please", "should", "optional", "user_input", "lookup_value", "<your-token>", "${TOKEN}")
    kinds = [
        (1, F.substring(h(10), 1, 40), opened),
        (1, F.concat(F.lit("ghp_"), F.substring(b64(11), 1, 36)), opened),
        (1, F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(h(12), "[01]", "Q")), 1, 16)), opened),
        (1, F.concat(F.substring(b64(13), 1, 40)), opened),
        (1, F.substring(h(14), 1, 32), opened),
        (1, F.concat(F.lit("sk_live_"), F.substring(b64(15), 1, 24)), F.lit("Authorization: Bearer ")),
        (1, F.substring(letters(60), 1, 32), opened),
        (1, F.lower(F.substring(letters(61), 1, 32)), opened),
        (1, chosen, opened),
        (1, strange, opened),
        (1, chosen, login),
        (1, F.concat(F.lit("\n"), b64(62), F.lit("\n"), b64(63), F.lit("\n")), F.concat(F.lit("-----BEGIN "), pick(64, "RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----"))),
        (0, F.concat(pick(16, "4", "5", "3", "9"), digits(17, 15)), prose),
        (0, F.concat(pick(18, "mail", "www", "host", "static"), digits(19, 1), F.lit("."), pick(20, "example", "sample-site", "localhost", "python"), pick(21, ".com", ".org", ".net/index")), url),
        (0, F.concat_ws("-", F.substring(h(22), 1, 8), F.substring(h(22), 9, 4), F.substring(h(22), 13, 4), F.substring(h(22), 17, 4), F.substring(h(22), 21, 12)), noted),
        (0, F.substring(h(23), 1, 40), noted),
        (0, F.concat(words(24), F.lit("_"), digits(28, 2)), F.concat(pick(29, "call ", "def ", "token: ", "key = "), pick(30, "", '"'))),
        (0, F.concat(pick(31, "EXAMPLE_TOKEN_", "your-api-key-here-", "xxxxxxxxxxxx", "changeme-placeholder-"), digits(32, 4)), opened),
        (0, code, opened),
        (0, camel, pick(65, "call ", "def ", "class ", "the ", "und ")),
    ]
    rows = None
    for i, (label, candidate, before) in enumerate(kinds):
        one = spark.range(n // len(kinds)).withColumn("id", F.col("id") * len(kinds) + i)
        closing = F.when(before.endswith("KEY-----"), F.lit("-----END")).when(before.rlike("://[a-z]*:$"), F.lit("@host/db")).otherwise(F.regexp_extract(before, "[\"'`]$", 0))
        path = pick(40, "src/app.py", "deploy/config.yaml", "src3", "web", "notes.txt") if label else pick(41, "src/app.py", "docs/readme.md", "tests/fixture.json", "src3", "web", "notes.txt")
        text = F.concat(prose, before, candidate, closing, pick(42, " and then", " the", "\n", ", ", " la"))
        one = one.select(F.struct(candidate.alias("planted"), F.lit(float(label)).alias("label"), "id", F.lit(i).alias("kind")).alias("doc_id"), text.alias("text"), path.alias("path"))
        rows = rows.unionByName(one) if rows else one
    # as the scan itself cuts them; a text without its planted value whole teaches nothing
    found = candidates(common.save(rows.coalesce(1), "planted"), "path").filter(F.col("candidate") == F.col("doc_id.planted"))
    return common.save(found.select("candidate", "before", "after", "path", "doc_id.label", "doc_id.kind"), "findings")


def fit(findings: DataFrame, words: DataFrame):
    """The forest, from findings with their label; findings without both labels teach nothing and are refused by it."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    rows = common.save(findings.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(features(covered(rows, words)).select("label", *FEATURES))


def judged(model, found: DataFrame, words: DataFrame) -> DataFrame:
    """found (candidate, before, after, path and others) with probability and secret, the forest's verdict."""
    rows = common.save(found.withColumn("row", F.monotonically_increasing_id()), "numbered")
    probability = F.round(vector_to_array("probability")[1], 6)
    return model.transform(features(covered(rows, words))).select(*found.columns, probability.alias("probability"), (probability >= LEAST).alias("secret"))


def held_out(findings: DataFrame, words: DataFrame, test) -> tuple[float, float]:
    """Precision and recall on the findings for which the condition test holds, of a forest that learns from the others."""
    got = judged(fit(findings.filter(~test), words), findings.filter(test), words)
    n = got.agg(F.count_if("secret").alias("said"), F.count_if(F.col("label") == 1).alias("true"), F.count_if(F.col("secret") & (F.col("label") == 1)).alias("both")).first()
    return (n.both / n.said if n.said else 1.0), (n.both / n.true if n.true else 1.0)


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start (characters before it), length, finding (masked), sha256, probability, secret.

    findings: labelled ones to learn from (labelled_findings where there are none). secret is the forest's verdict
    (probability of at least LEAST). Null and empty texts have no candidates; a null path is an unknown one; null ids and
    repeated rows are scanned like any other; an empty table gives no rows. A text of any length is scanned whole, and no text
    is shuffled.
    """
    words = vocabulary(docs)
    model = fit(labelled_findings(docs.sparkSession) if findings is None else findings, words)
    scored = judged(model, candidates(docs, path), words)
    return scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("finding"), F.sha2("candidate", 256).alias("sha256"), "probability", "secret")
