"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key -ln(u) / w from a hash of its row and its quality weight w. Within a
source, documents in the order of their keys are a weighted sample without replacement. A source whose target is
e times its size and a rest takes e complete epochs first and then the documents whose prefix sum of words
stays next to the rest. The keys are cut into buckets of about ROWS_PER_BUCKET rows by quantiles of their
distribution, so no task sorts a whole source: bucket sums give each bucket's offset, and the prefix sums run
within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

MAX_EPOCHS = 3
ROWS_PER_BUCKET = 5000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    """Number of words in the text column; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: str | Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the columns."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality(text: str, size: Column) -> Column:
    """Default quality weight: 1 for words of six characters on average, less for shorter or longer ones."""
    mean = F.length(text) / size
    return F.when(size > 0, F.least(mean / 6.0, 6.0 / mean)).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: Column | None = None, budget: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sizes` (source, size) with `target`: weighted shares of the budget, none above max_epochs times its size.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... unless `weights` says otherwise. The budget is
    the sum of all sizes unless given. The level at which the excess is shared out is found in closed form:
    sources in the order of cap per weight, where the capped ones are a prefix. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = sizes.withColumn("weight", weights if weights is not None else (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("size") * max_epochs).withColumn("total", budget if budget is not None else F.sum("size").over(every))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = weighed.withColumn("level", left / open_weight)
    # The first source, in that order, that its cap does not bind sets the level for all that follow.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(every)
    return levelled.withColumn("level", level["level"]).select(
        "source", F.col("size").alias("source_size"),
        F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, and the columns in `keep`.

    `taken` is the number of words that the mix takes from the document, repeats counted: complete epochs of its
    source times its size, and its size once more if the fractional epoch selects it; the document at the edge is
    selected if that brings its source nearer to the target. Null, empty and blank texts have size 0 and take 0.
    A null source is a source of its own. Rows that agree in id and text draw the same key and stand next to
    each other; ties go by id and by a hash of the text. Reruns agree. An empty table gives an empty result.
    """
    size = words_in(text)
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        (weight if weight is not None else quality(text, size)).cast("double").alias("w"),
        unit_hash(doc_id, F.md5(text)).alias("u"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    base = base.withColumn("key", -F.log("u") / F.when(F.col("w") > 0, F.col("w")).otherwise(1e-9))
    base = materialize(base, "mix")
    # Keys of weight w are exponential with rate w: the mixture's distribution function over the powers of two
    # of the weights (81 at most) makes the buckets even, whatever the weights are.
    power = F.least(F.greatest(F.floor(F.log2(F.greatest("w", F.lit(1e-9)))), F.lit(-40)), F.lit(40))
    rates = base.groupBy(power.alias("power")).agg(F.count("*").alias("n"), F.avg(F.greatest("w", F.lit(1e-9))).alias("w")).orderBy("power").collect()
    n = sum(r["n"] for r in rates)
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    share = sum((F.lit(r["n"] / n) * (1 - F.exp(-F.col("key") * r["w"])) for r in rates), F.lit(0.0))
    base = base.withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int"))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("size")))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))).select(named, "bucket", "offset")
    plan = offsets.join(targets.select(named, "source_size", "target"), "name")
    within = Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).join(plan, ["name", "bucket"])
    upto = F.sum("size").over(within) + F.col("offset")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("upto", upto)
    taken = F.col("epochs") * F.col("size") + F.when((F.col("rest") > 0) & (F.col("upto") - F.col("size") / 2 <= F.col("rest")), F.col("size")).otherwise(0)
    return placed.select("doc_id", F.col("size"), F.col("source_size"), "target", taken.cast("long").alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(table(spark, sf_dir, "documents"))


SQL_OP6 = r"""
WITH base AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), weighed AS (
  SELECT *, CASE WHEN size > 0 THEN least((length(text)::DOUBLE / size) / 6.0, 6.0 / (length(text)::DOUBLE / size)) ELSE 1.0 END AS w FROM base
), keyed AS (
  SELECT doc_id, source, size, -ln(u) / w AS key FROM weighed
), sources AS (
  SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM keyed GROUP BY source
), caps AS (
  SELECT *, 3 * size AS cap, sum(size) OVER () AS total FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level FROM caps
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT arg_min(level, cap::DOUBLE / weight) AS level FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT source, size AS source_size, coalesce(least((SELECT level FROM chosen) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM levels
), placed AS (
  SELECT k.*, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN target - epochs * source_size > 0 AND upto - size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM placed
"""

QUERIES = {"op6_mix_sources": op6}
SQL = {"op6_mix_sources": SQL_OP6}
