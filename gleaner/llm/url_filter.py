"""URL verdicts: fixed rules first, then logistic regression on hashed character n-grams.

The model learns from a small table of labelled URLs, by default ``labelled_urls``: hosts and paths that
no rule covers, whose topic says whether they are wanted. Host and path give n-grams of their own,
hashed into ``FEATURES`` slots; fitting and scoring are Spark ML jobs. Both labels weigh the same
in the fit, however many URLs they have. ``held_out_accuracy`` fits without a fold of hosts and judges that fold.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch

FEATURES = 1 << 16
SIZES = (3, 4, 5)
REGULARISATION = 1e-3
#: Largest number of labelled URLs that a model is fitted to.
LABELLED = 20_000
#: (host, path, verdict); a rule fits its host and all hosts below it.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Topics of the labelled table: words that hosts are made of.
BLOCK_TOPICS = (
    "casino", "poker", "slots", "bets", "betting", "jackpot", "lottery", "roulette", "bingo", "win", "pills", "pharma", "viagra", "steroids",
    "adult", "xxx", "porn", "escort", "webcam", "ads", "adserver", "banner", "track", "tracker", "clicks", "popup", "spam", "linkfarm", "farm-links",
    "warez", "crack", "keygen", "torrent", "malware", "phish", "payday", "loans", "cheap", "replica", "free-money",
)
ALLOW_TOPICS = (
    "library", "museum", "garden", "river", "weather", "school", "science", "history", "physics", "cooking", "recipes", "travel", "mountain",
    "theatre", "orchestra", "painting", "novels", "poems", "letters", "language", "grammar", "teacher", "students", "research", "journal",
    "hospital", "health", "nature", "forest", "birds", "oceans", "planets", "astronomy", "chemistry", "mathematics", "software", "docs",
    "manual", "forum", "city", "county", "parliament", "election", "railway", "bridges", "houses", "kitchen", "workshop", "tools", "cycling",
    "hiking", "running", "football", "chess", "cinema", "radio", "news", "times", "tribune", "other", "there", "another", "together", "nation",
    "station", "thinking", "nothing",
)
#: Most hosts have names without a topic: pairs of these syllables stand for them, as wanted ones.
SYLLABLES = ("an", "ber", "cor", "del", "ed", "for", "gra", "hat", "ing", "jo", "ken", "lan", "mer", "nor", "on", "re", "sen", "th", "tion", "ly")
HOST_PREFIXES, HOST_ENDINGS, LANGUAGES = ("", "www.", "m.", "blog."), (".org", ".net", ".info", ".example.org", ".example.net"), ("en", "de")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both are empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones a block."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, kind in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column, mark: str) -> Column:
    """All n-grams of the text between two bars, each with ``mark`` before it; all digits are alike."""
    text = F.concat(F.lit("|"), F.translate(text, "123456789", "0" * 9), F.lit("|"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        # A second parameter of the function would be the place in the array.
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[of_size(n) for n in SIZES])


def features(urls: DataFrame) -> DataFrame:
    """``urls(host, path, ..)`` with a vector of hashed n-grams."""
    grams = urls.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def labelled_urls() -> list[tuple[str, str]]:
    """The default table of (url, verdict), some 2500 rows: each topic alone, after a common word, and with others of its list.

    Prefixes, endings and paths take turns alike under both labels, so that the topic alone tells them apart.
    """
    out = []
    plain = tuple(a + b for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) if (i + j) % 4 == 0)
    for topics, verdict in ((BLOCK_TOPICS, "block"), (ALLOW_TOPICS, "allow"), (plain, "allow")):
        for i, topic in enumerate(topics):
            others = [topics[(i + step) % len(topics)] for step in (3, 7, 11, 17)]
            names = [topic, *[f"{word}-{topic}" for word in ("the", "my", "best")], *[f"{topic}-{x}" for x in others], *[topic + x for x in others]]
            for j, name in enumerate(names):
                n = len(names) * i + j
                host = HOST_PREFIXES[(i + j) % 4] + name + HOST_ENDINGS[n % 5]
                out.append((f"https://{host}/{LANGUAGES[i % 2]}/{(n * 7919) % 9000 + 1000}", verdict))
    return out


def _balanced(sample: DataFrame, counts: dict[float, int]) -> DataFrame:
    """A weight that gives both labels half of the total."""
    total = sum(counts.values())
    return sample.withColumn("weight", F.when(F.col("label") == 1.0, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0])))


def fit(labelled: DataFrame, scratch: Scratch) -> LogisticRegressionModel | float:
    """A model of ``labelled(url, verdict)``, or the constant chance of a block if all labels agree.

    At most ``LABELLED`` different URLs are used, the first by hash; a URL with both labels counts as blocked. Null
    URLs and verdicts are left out.
    """
    unique = labelled.filter("url IS NOT NULL AND verdict IS NOT NULL").groupBy("url").agg(F.max((F.col("verdict") == "block").cast("double")).alias("label"))
    host, path = split_url(F.col("url"))
    sample = unique.orderBy(F.xxhash64("url"), "url").limit(LABELLED)
    sample = scratch.save(sample.select(host.alias("host"), path.alias("path"), "label"), f"labelled-{uuid.uuid4().hex}")
    counts = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return 1.0 if 1.0 in counts else 0.0
    return LogisticRegression(maxIter=40, regParam=REGULARISATION, standardization=False, weightCol="weight").fit(features(_balanced(sample, counts)))


def _scored(urls: DataFrame, model: LogisticRegressionModel | float) -> DataFrame:
    """``urls(host, path, ..)`` with the chance of a block in ``score``."""
    if isinstance(model, float):
        return urls.withColumn("score", F.lit(model))
    return model.transform(features(urls)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def held_out_accuracy(spark: SparkSession, labelled: DataFrame | None = None, folds: int = 5, held: int = 2, threshold: float = 0.5) -> DataFrame:
    """``verdict, n, right``: how many URLs of hosts in fold ``held``, which the model has not seen, it judges rightly."""
    labelled = spark.createDataFrame(labelled_urls(), "url string, verdict string") if labelled is None else labelled
    host, path = split_url(F.col("url"))
    rows = labelled.filter("url IS NOT NULL AND verdict IS NOT NULL").select("url", "verdict", host.alias("host"), path.alias("path"))
    fold = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(folds))
    model = fit(rows.filter(fold != held).select("url", "verdict"), Scratch(spark))
    judged = _scored(rows.filter(fold == held), model).withColumn("right", (F.col("score") >= threshold) == (F.col("verdict") == "block"))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("right").cast("long")).alias("right"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages(page_id, url)``.

    ``labelled(url, verdict)`` teaches the model, without it the table of ``labelled_urls``. A null URL or one without ``://`` has empty host and path and is judged by the
    model. Other columns are ignored; an empty table gives an empty one, and without labels all
    undecided URLs are allowed.
    """
    scratch = Scratch(pages.sparkSession)
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_urls(), "url string, verdict string")
    scored = _scored(ruled, fit(labelled.select("url", "verdict"), scratch))
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
