"""URL filters, with DataFrame functions only: host and path rules, then a logistic regression.

The regression reads hashed character 4-grams of host and path. It is trained from a small labelled table in
its dual form: the kernel of the labelled URLs is a small matrix, gradient descent on their coefficients is
one fold, and the weights of the hash buckets follow from the coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 4096
GRAM = 4
ROUNDS, RATE, RIDGE = 100, 2.0, 0.002
#: The labelled table is fitted in one row's arrays: it may hold this many URLs.
MAX_LABELLED = 500

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# The words and forms that the labelled table is made of.
BLOCKED = (
    "casino pills poker loans viagra replica torrent betting xxx lottery adult meds slots bets jackpot bingo escort porn cialis steroids payday crypto-win forex hack crack keygen warez "
    "free-spins cheap-watches fake-id miracle-diet hot-singles win-prize free-money quick-cash"
).split()
ALLOWED = (
    "library university research journal museum archive science school health weather docs recipes news city travel music history garden books sports council hospital theatre radio "
    "gallery college parliament forum wiki maps rail airport bakery chess botany physics poetry cinema market photo village river mountain church orchestra union institute academy"
).split()
SYLLABLES = "ba den hor lin mar no pel ris sto tha ver wen".split()
FORMS = (
    "http://www.{}.example.com/en/{}.html", "https://{}.example.org/{}/", "http://m.{}.example.net/de/{}?page=2", "https://{}-online.example.com/fr/{}", "http://blog.{}.example.net/{}",
    "https://best-{}.example/{}/offer", "https://shop.example.com/{}/{}", "http://{}.example.com/{}/", "https://www.{}.example.net/{}.html",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to ?, # or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: str, path: str, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    table_ = F.array(*[F.struct(F.length(F.lit(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in rules])
    fits = F.filter(table_, lambda r: ((F.col(host) == r["host"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col(path), r["path"]))
    return F.array_max(fits)


def grams(host: str, path: str) -> Column:
    """Hash buckets of the overlapping 4-grams of host and path, which are told apart."""
    cut = lambda mark, c: F.transform(F.regexp_extract_all(F.concat(F.lit("^"), F.col(c), F.lit("$")), F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)), lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))
    return F.concat(cut("h", host), cut("p", path))


def labelled_rows(forms: tuple[str, ...] = FORMS) -> list[tuple[str, int]]:
    """URLs and labels (1: block): words of either kind and neutral names of two or three syllables.

    Words of both kinds pass through all forms in turn, so that a form by itself says nothing.
    """
    n = len(SYLLABLES)
    names = ["".join(SYLLABLES[(k * step + k // n) % n] for step in ((1, 5, 7) if k % 3 else (1, 7))) for k in range(70)]
    tails = ("{}", "4711", "about", "89", "{}-2021", "123456", "7")
    return [
        (forms[(k + 4 * i) % len(forms)].format(word, tails[(k + i) % len(tails)].format(word)), label)
        for label, words in ((1, BLOCKED), (0, (*ALLOWED, *names)))
        for k, word in enumerate(words)
        for i in range(3 if label else 1)
    ]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url and label."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def train(labelled: DataFrame) -> tuple[float, list[float]]:
    """Intercept and one weight per bucket; zeros for an empty table. Null URLs and labels are skipped."""
    urls = labelled.where("url is not null and label is not null").select(F.xxhash64("url").alias("id"), "label", host_of("url").alias("host"), path_of("url").alias("path")).dropDuplicates(["id"])
    if urls.count() > MAX_LABELLED:
        raise ValueError(f"the labelled URL table holds more than {MAX_LABELLED} URLs")
    features = urls.select("id", "label", grams("host", "path").alias("g")).select("id", "label", F.explode("g").alias("bucket"), (1 / F.sqrt(F.size("g"))).alias("x"))
    features = features.groupBy("id", "label", "bucket").agg(F.sum("x").alias("x"))
    other = features.select(F.col("id").alias("id2"), "bucket", F.col("x").alias("x2"))
    kernel = features.join(other, "bucket").groupBy("id", "label", "id2").agg(F.sum(F.col("x") * F.col("x2")).alias("k"))
    rows = kernel.groupBy("id", "label").agg(F.collect_list(F.struct("id2", "k")).alias("k"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("id", "label", "k"))).alias("rows"))
    ids = F.transform("rows", lambda r: r["id"])
    dense = F.transform("rows", lambda r: F.struct(r["label"].cast("double").alias("y"), F.transform(F.col("ids"), lambda i: F.coalesce(F.element_at(F.map_from_entries(r["k"]), i), F.lit(0.0))).alias("k")))
    ready = one.where(F.size("rows") > 0).withColumn("ids", ids).withColumn("dense", dense)
    zero = F.transform("ids", lambda i: F.lit(0.0))

    def descend(state, _):
        error = F.transform("dense", lambda r: 1 / (1 + F.exp(-(state["b"] + F.aggregate(F.zip_with(r["k"], state["a"], lambda k, a: k * a), F.lit(0.0), lambda s, x: s + x)))) - r["y"])
        mean = F.aggregate(error, F.lit(0.0), lambda s, x: s + x) / F.size("ids")
        return F.struct((state["b"] - RATE * mean).alias("b"), F.zip_with(state["a"], error, lambda a, e: a - RATE * (e / 4 + RIDGE * a)).alias("a"))

    fitted = ready.select("ids", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("b"), zero.alias("a")), descend).alias("m"))
    pairs = fitted.select("m.b", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("m.a").alias("a"))).alias("p")).select("b", "p.id", "p.a")
    summed = features.join(pairs, "id").groupBy("bucket").agg(F.sum(F.col("x") * F.col("a")).alias("w"), F.max("b").alias("b")).collect()  # BUCKETS rows at most
    weights = [0.0] * BUCKETS
    for r in summed:
        weights[r["bucket"]] = r["w"]
    return (summed[0]["b"] if summed else 0.0), weights


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns in `keep` with host, path, rule, verdict and score of every row.

    A fitting rule decides; without one the regression blocks from score 0.5. A null URL or one without ://
    has an empty host and path and is judged like any other; repeated rows get equal verdicts; an empty table
    gives an empty result.
    """
    intercept, weights = train(labelled)
    model = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")  # folds into one literal
    parts = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    g = grams("host", "path")
    z = F.lit(intercept) + F.aggregate(g, F.lit(0.0), lambda s, b: s + F.element_at(model, b + 1)) / F.sqrt(F.greatest(F.size(g), F.lit(1)))
    scored = parts.withColumn("_rule", matching_rule("host", "path", rules)).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op2(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    return judge(table(spark, sf_dir, "pages"), labelled_urls(spark))


QUERIES = {"op2_url_filter": op2}
SQL: dict[str, str] = {}
