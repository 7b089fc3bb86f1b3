"""Virtual skies over the relational test tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WCS = ("width", "height", "crval1", "crval2", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2")


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below `spark.checkpoint.dir`, or below the warehouse where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _mod(x, m: float):
    return x - m * F.floor(x / m)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """A frame of 64 x 64 pixels of 36 arcseconds per order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("image_id"), F.lit(64).alias("width"), F.lit(64).alias("height"),
        _mod(F.col("o_custkey") * 0.7391 + 0.0137, 360.0).alias("crval1"), (_mod(F.col("o_orderkey") * 0.3719, 160.0) - 79.9863).alias("crval2"),
        F.lit(32.5).alias("crpix1"), F.lit(32.5).alias("crpix2"), F.lit(-0.01).alias("cd1_1"), F.lit(0.0).alias("cd1_2"), F.lit(0.0).alias("cd2_1"), F.lit(0.01).alias("cd2_2"),
        (F.col("o_totalprice") / 1000).alias("exptime"), F.col("o_orderdate").alias("date_obs"), F.substring("o_orderpriority", 1, 1).alias("station"),
    )


FRAMES = """frames AS (SELECT o_orderkey AS image_id, 64 AS width, 64 AS height,
  (o_custkey * 0.7391::DOUBLE + 0.0137::DOUBLE) - 360.0::DOUBLE * floor((o_custkey * 0.7391::DOUBLE + 0.0137::DOUBLE) / 360.0::DOUBLE) AS crval1,
  (o_orderkey * 0.3719::DOUBLE) - 160.0::DOUBLE * floor((o_orderkey * 0.3719::DOUBLE) / 160.0::DOUBLE) - 79.9863::DOUBLE AS crval2,
  32.5::DOUBLE AS crpix1, 32.5::DOUBLE AS crpix2, -0.01::DOUBLE AS cd1_1, 0.0::DOUBLE AS cd1_2, 0.0::DOUBLE AS cd2_1, 0.01::DOUBLE AS cd2_2,
  o_totalprice / 1000 AS exptime, o_orderdate AS date_obs, substr(o_orderpriority, 1, 1) AS station FROM orders)"""


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """A star per customer."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("star_id"), _mod(F.col("c_custkey") * 137.50776405 + 0.0137, 360.0).alias("ra"), (_mod(F.col("c_custkey") * 71.0137 + 0.0071, 178.0) - 89.0).alias("dec"),
        (_mod(F.col("c_acctbal"), 6.0) + 14.0).alias("mag"), F.col("c_nationkey").alias("field"),
    )


STARS = """stars AS (SELECT c_custkey AS star_id,
  (c_custkey * 137.50776405::DOUBLE + 0.0137::DOUBLE) - 360.0::DOUBLE * floor((c_custkey * 137.50776405::DOUBLE + 0.0137::DOUBLE) / 360.0::DOUBLE) AS ra,
  (c_custkey * 71.0137::DOUBLE + 0.0071::DOUBLE) - 178.0::DOUBLE * floor((c_custkey * 71.0137::DOUBLE + 0.0071::DOUBLE) / 178.0::DOUBLE) - 89.0::DOUBLE AS dec,
  c_acctbal - 6.0::DOUBLE * floor(c_acctbal / 6.0::DOUBLE) + 14.0::DOUBLE AS mag, c_nationkey AS field FROM customer)"""


def tiles8(spark: SparkSession, sf: str) -> DataFrame:
    """An 8 x 8 tile per vector; its label is the telescope."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("npix"), F.col("label").alias("telescope"), F.col("embedding").alias("pixels"))


PIXELS = """px AS (SELECT npix, telescope, (i % 8)::INT AS x, (i // 8)::INT AS y, CASE WHEN isnan(v) THEN NULL ELSE v END AS value FROM (
  SELECT vec_id AS npix, label AS telescope, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"""


def spread_sql(x: str, bits: int) -> str:
    return "(" + " | ".join(f"(({x} & {1 << k}) << {k})" for k in range(bits)) + ")"


def compress_sql(x: str, bits: int) -> str:
    return "(" + " | ".join(f"(({x} >> {k}) & {1 << k})" for k in range(bits)) + ")"


def ang2pix_sql(relation: str, order: int, out: str = "npix") -> str:
    """SQL that adds the cell of (ra, dec) to a relation."""
    n = 1 << order
    return f"""(SELECT * EXCLUDE (z_, tt_, jp_, jm_, fp_, fm_, q_, t_, r_, p_, m_, f_, x_, y_), f_ * {n * n} + {spread_sql('x_', order)} + 2 * {spread_sql('y_', order)} AS {out} FROM (
 SELECT *, CASE WHEN abs(z_) <= 2.0::DOUBLE / 3.0 THEN CASE WHEN fp_ = fm_ THEN (fp_ & 3) + 4 WHEN fp_ < fm_ THEN fp_ ELSE fm_ + 8 END WHEN z_ > 0 THEN q_ ELSE q_ + 8 END AS f_,
  CASE WHEN abs(z_) <= 2.0::DOUBLE / 3.0 THEN jm_ & {n - 1} WHEN z_ > 0 THEN {n - 1} - m_ ELSE p_ END AS x_,
  CASE WHEN abs(z_) <= 2.0::DOUBLE / 3.0 THEN {n - 1} - (jp_ & {n - 1}) WHEN z_ > 0 THEN {n - 1} - p_ ELSE m_ END AS y_ FROM (
 SELECT *, jp_ >> {order} AS fp_, jm_ >> {order} AS fm_, least(floor((tt_ - q_) * r_), {n - 1})::BIGINT AS p_, least(floor((1.0 - (tt_ - q_)) * r_), {n - 1})::BIGINT AS m_ FROM (
 SELECT *, floor({n} * (0.5::DOUBLE + tt_) - {n} * (z_ * 0.75::DOUBLE))::BIGINT AS jp_, floor({n} * (0.5::DOUBLE + tt_) + {n} * (z_ * 0.75::DOUBLE))::BIGINT AS jm_,
  least(floor(tt_), 3)::BIGINT AS q_, {n} * sqrt(greatest(3.0::DOUBLE * (1.0::DOUBLE - abs(z_)), 0)) AS r_ FROM (
 SELECT *, sin(radians(dec)) AS z_, ra / 90.0::DOUBLE - floor(ra / 90.0::DOUBLE / 4.0) * 4.0 AS tt_, 0 AS t_ FROM {relation})))))"""


def pix2ang_sql(relation: str, order: int) -> str:
    """SQL that adds ra and dec of the centre of `npix` to a relation."""
    n = 1 << order
    return f"""(SELECT * EXCLUDE (f_, x_, y_, jr_, nr_, sh_, jp0_, jp_), CASE WHEN jp_ > {4 * n} THEN jp_ - {4 * n} WHEN jp_ < 1 THEN jp_ + {4 * n} ELSE jp_ END AS j_,
  (j_ - (sh_ + 1) * 0.5::DOUBLE) * (90.0::DOUBLE / nr_) AS ra,
  degrees(asin(CASE WHEN jr_ < {n} THEN 1.0::DOUBLE - nr_ * nr_ / (3.0::DOUBLE * {n * n}) WHEN jr_ > {3 * n} THEN nr_ * nr_ / (3.0::DOUBLE * {n * n}) - 1.0 ELSE ({2 * n} - jr_) * 2.0::DOUBLE / (3.0::DOUBLE * {n}) END)) AS dec FROM (
 SELECT *, floor(jp0_ / 2.0)::BIGINT AS jp_ FROM (
 SELECT *, ([1,3,5,7,0,2,4,6,1,3,5,7])[f_ + 1] * nr_ + x_ - y_ + 1 + sh_ AS jp0_ FROM (
 SELECT *, CASE WHEN jr_ < {n} THEN jr_ WHEN jr_ > {3 * n} THEN {4 * n} - jr_ ELSE {n} END AS nr_, CASE WHEN jr_ < {n} OR jr_ > {3 * n} THEN 0 ELSE (jr_ - {n}) & 1 END AS sh_ FROM (
 SELECT *, ([2,2,2,2,3,3,3,3,4,4,4,4])[f_ + 1] * {n} - x_ - y_ - 1 AS jr_ FROM (
 SELECT *, npix >> {2 * order} AS f_, {compress_sql(f'(npix & {n * n - 1})', order)} AS x_, {compress_sql(f'((npix & {n * n - 1}) >> 1)', order)} AS y_ FROM {relation}))))))"""


def cover_sql(relation: str, keep: str, order: int, width: int, scale: float) -> str:
    """SQL of the cells of `order` that meet frames of `width` pixels a side of `scale` degrees: every cell against every frame.

    A cell's outline of 32 points is put into the frame's pixels and each of its sides clipped by the frame and its margin.
    """
    fine = max(order, 4)
    n, side, k = 1 << fine, math.degrees(math.sqrt(math.pi / 3)) / (1 << fine), 8
    radius = math.degrees(math.atan(math.radians((width + 1) * scale / math.sqrt(2))))
    reach, rim = radius + 1.05 * side, math.radians(min(radius + 2.1 * side, 85.9))
    slack = 0.5 + 0.003 * side * math.sqrt(2) / scale / math.cos(rim) ** 2
    steps = [j / k for j in range(k)]
    u, v = steps + [1.0] * k + [1 - j for j in steps] + [0.0] * k, [0.0] * k + steps + [1.0] * k + [1 - j for j in steps]
    unit = lambda ra, dec: f"cos(radians({dec})) * cos(radians({ra})) AS d1_, cos(radians({dec})) * sin(radians({ra})) AS d2_, sin(radians({dec})) AS d3_"
    cells = f"(SELECT npix, dec, {unit('ra', 'dec')} FROM {pix2ang_sql(f'(SELECT range AS npix FROM range({12 * n * n}))', fine)})"
    near = f"""(SELECT f.* EXCLUDE (d1_, d2_, d3_), npix, npix >> {2 * fine} AS f_, {compress_sql(f'(npix & {n * n - 1})', fine)} AS x_, {compress_sql(f'((npix & {n * n - 1}) >> 1)', fine)} AS y_
  FROM (SELECT *, {unit('crval1', 'crval2')} FROM {relation}) f JOIN {cells} c ON dec BETWEEN crval2 - {reach + 0.1} AND crval2 + {reach + 0.1} WHERE f.d1_ * c.d1_ + f.d2_ * c.d2_ + f.d3_ * c.d3_ >= {math.cos(math.radians(reach + 0.1))})"""
    points = f"""(SELECT *, degrees(pi() / 4 * (([1,3,5,7,0,2,4,6,1,3,5,7])[f_ + 1] + CASE WHEN s_ > 0 THEN (ga_ - gb_) / s_ ELSE 0 END)) AS ra, degrees(atan2(z_, CASE WHEN s_ < 1 THEN sqrt(s_ * s_ / 3 * (2 - s_ * s_ / 3)) ELSE sqrt(1 - z_ * z_) END)) AS dec FROM (
 SELECT *, CASE WHEN r_ < 1 THEN 1 - s_ * s_ / 3 WHEN r_ > 3 THEN s_ * s_ / 3 - 1 ELSE (2 - r_) * 2 / 3 END AS z_ FROM (
 SELECT *, CASE WHEN r_ < 1 THEN r_ WHEN r_ > 3 THEN 4 - r_ ELSE 1 END AS s_ FROM (
 SELECT *, ([2,2,2,2,3,3,3,3,4,4,4,4])[f_ + 1] - ga_ - gb_ AS r_ FROM (
 SELECT *, (x_ + ({u}::DOUBLE[])[k_]) / {n} AS ga_, (y_ + ({v}::DOUBLE[])[k_]) / {n} AS gb_ FROM {near}, (SELECT range AS k_ FROM range(1, {4 * k + 1})))))))"""
    low, high = -0.5 - slack, width - 0.5 + slack
    return f"""(SELECT DISTINCT {keep}, npix >> {2 * (fine - order)} AS npix FROM (
 SELECT *, unnest(range(1, {4 * k + 1})) AS i_ FROM (SELECT {keep}, npix, list(px ORDER BY k_) AS px_, list(py ORDER BY k_) AS py_ FROM {sky2pix_sql(points, keep + ', npix, k_')} GROUP BY ALL))
 WHERE greatest(least(({low} - px_[i_]) / (px_[i_ % {4 * k} + 1] - px_[i_]), ({high} - px_[i_]) / (px_[i_ % {4 * k} + 1] - px_[i_])), least(({low} - py_[i_]) / (py_[i_ % {4 * k} + 1] - py_[i_]), ({high} - py_[i_]) / (py_[i_ % {4 * k} + 1] - py_[i_])), 0)
  <= least(greatest(({low} - px_[i_]) / (px_[i_ % {4 * k} + 1] - px_[i_]), ({high} - px_[i_]) / (px_[i_ % {4 * k} + 1] - px_[i_])), greatest(({low} - py_[i_]) / (py_[i_ % {4 * k} + 1] - py_[i_]), ({high} - py_[i_]) / (py_[i_ % {4 * k} + 1] - py_[i_])), 1)
 UNION SELECT {keep}, npix FROM {ang2pix_sql(f'(SELECT *, crval1 AS ra, crval2 AS dec FROM {relation})', order)})"""


def pix2sky_sql(relation: str, keep: str) -> str:
    """SQL that adds ra and dec of pixel (x, y) of a frame relation; keeps the columns in `keep`."""
    return f"""(SELECT {keep}, a_ - floor(a_ / 360.0) * 360.0 AS ra, degrees(atan2(sin(d_) + e_ * cos(d_), sqrt(k_ * k_ + h_ * h_))) AS dec FROM (
 SELECT *, crval1 + degrees(atan2(k_, h_)) AS a_ FROM (SELECT *, cos(d_) - e_ * sin(d_) AS h_ FROM (
 SELECT *, radians(cd1_1 * (x + 1 - crpix1) + cd1_2 * (y + 1 - crpix2)) AS k_, radians(cd2_1 * (x + 1 - crpix1) + cd2_2 * (y + 1 - crpix2)) AS e_, radians(crval2) AS d_ FROM {relation}))))"""


def sky2pix_sql(relation: str, keep: str) -> str:
    """SQL that adds px and py of (ra, dec) in a frame relation, null behind the plane; keeps the columns in `keep`."""
    return f"""(SELECT {keep}, CASE WHEN den_ > 1e-10 THEN (cd2_2 * xi_ - cd1_2 * eta_) / det_ + crpix1 - 1 END AS px, CASE WHEN den_ > 1e-10 THEN (cd1_1 * eta_ - cd2_1 * xi_) / det_ + crpix2 - 1 END AS py FROM (
 SELECT *, degrees(cos(d_) * sin(a_) / den_) AS xi_, degrees((sin(d_) * cos(d0_) - cos(d_) * sin(d0_) * cos(a_)) / den_) AS eta_ FROM (
 SELECT *, sin(d_) * sin(d0_) + cos(d_) * cos(d0_) * cos(a_) AS den_ FROM (
 SELECT *, radians(ra - crval1) AS a_, radians(dec) AS d_, radians(crval2) AS d0_, cd1_1 * cd2_2 - cd1_2 * cd2_1 AS det_ FROM {relation}))))"""
