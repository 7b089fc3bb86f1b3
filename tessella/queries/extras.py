"""Queries over boxes, set operations, file round trips, blurring and mapping checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coverage as cov
from ..operators import images, simulate
from ..plans import build, transients
from ..sources import fits
from .grid import COVERAGE_SQL, r6
from .pixels import px
from .sky import FRAMES, PIXELS, frames, pix2ang_sql, query, sky2pix_sql, table, tiles8


@query(f"""WITH {FRAMES}, {COVERAGE_SQL}, p AS (SELECT image_id, tile, ra, dec FROM {pix2ang_sql('(SELECT image_id, npix AS tile, npix * 16 + k AS npix FROM cover, (SELECT range AS k FROM range(16)))', 8)}),
 q AS (SELECT image_id, tile, px, py FROM {sky2pix_sql('(SELECT p.tile, p.ra, p.dec, f.* FROM p JOIN frames f USING (image_id))', 'image_id, tile')}),
 b AS (SELECT image_id, tile, greatest(floor(min(px))::BIGINT - 8, 0) AS x0, greatest(floor(min(py))::BIGINT - 8, 0) AS y0, least(ceil(max(px))::BIGINT + 8, 63) AS x1, least(ceil(max(py))::BIGINT + 8, 63) AS y1 FROM q WHERE abs(px) <= 2048 AND abs(py) <= 2048 GROUP BY ALL)
 SELECT image_id, tile AS npix, x0, y0, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM b WHERE x0 <= x1 AND y0 <= y1""")
def tile_pixel_boxes(spark, sf):
    """The part of each frame that each of its tiles needs."""
    f = frames(spark, sf)
    return cov.tile_boxes(cov.coverage(f, 6), f, 6)


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS npix FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey AS npix FROM lineitem WHERE l_linenumber >= 3)
 SELECT 'both' AS side, npix FROM (SELECT npix FROM a INTERSECT SELECT npix FROM b) UNION ALL SELECT 'only_a', npix FROM (SELECT npix FROM a EXCEPT SELECT npix FROM b) UNION ALL SELECT 'only_b', npix FROM (SELECT npix FROM b EXCEPT SELECT npix FROM a)""")
def tileset_sides(spark, sf):
    """Tiles of two sets: in both, or in one only."""
    rows = table(spark, sf, "lineitem")
    a, b = (rows.where(c).select(F.col("l_orderkey").alias("npix")).distinct() for c in ("l_linenumber <= 3", "l_linenumber >= 3"))
    named = lambda side, d: d.select(F.lit(side).alias("side"), "npix")
    return named("both", a.intersect(b)).unionByName(named("only_a", a.subtract(b))).unionByName(named("only_b", b.subtract(a)))


@query("""WITH n AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 7), t AS (SELECT l_orderkey AS npix, bool_or(l_partkey IN (SELECT l_partkey FROM n)) AS fresh, count(*) AS n_sources FROM lineitem GROUP BY 1)
 SELECT npix, n_sources, fresh FROM t WHERE fresh""")
def new_batch_tiles(spark, sf):
    """Tiles that a source of the new batch reaches."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("npix"), "l_partkey", "l_linenumber")
    fresh = rows.where("l_linenumber = 7").select("l_partkey").distinct()
    hit = rows.join(fresh, "l_partkey", "left_semi").select("npix").distinct()
    return rows.join(hit, "npix", "left_semi").groupBy("npix").agg(F.count("*").alias("n_sources")).withColumn("fresh", F.lit(True))


def _policy_sql(value: str) -> str:
    return f"""WITH {PIXELS}, p AS (SELECT npix, x, y, CASE WHEN (npix + x * 3 + y) % 6 = 0 THEN NULL ELSE value END AS value FROM px)
 SELECT a.npix, a.x, a.y, round({value}, 5) AS value FROM p a JOIN p b ON b.npix = a.npix AND b.x = a.x + 1 AND b.y = a.y JOIN p c ON c.npix = a.npix AND c.x = a.x AND c.y = a.y + 1 JOIN p d ON d.npix = a.npix AND d.x = a.x + 1 AND d.y = a.y + 1"""


def _policy(spark, sf, policy):
    holed = F.transform("pixels", lambda v, i: F.when((F.col("npix") + (i % 8) * 3 + F.floor(i / 8)) % 6 != 0, v))
    t = tiles8(spark, sf).select("npix", holed.alias("pixels"), F.explode(F.sequence(F.lit(0), F.lit(48))).alias("k"))
    t = t.select("npix", "pixels", (F.col("k") % 7).alias("x"), F.floor(F.col("k") / 7).cast("int").alias("y"))
    t = images.with_bilinear(t.withColumns({"u": F.col("x") + 0.25, "v": F.col("y") + 0.5}), "pixels", "u", "v", F.lit(8), F.lit(8), policy=policy)
    return t.select("npix", "x", "y", F.round("value", 5).alias("value"))


@query(_policy_sql("((coalesce(a.value, b.value, c.value, d.value) * 0.75 + coalesce(b.value, a.value, c.value, d.value) * 0.25) + (coalesce(c.value, a.value, b.value, d.value) * 0.75 + coalesce(d.value, a.value, b.value, c.value) * 0.25)) / 2"))
def bilinear_replace(spark, sf):
    """Sampling where blank neighbours take the first value that is there."""
    return _policy(spark, sf, "replace")


@query(_policy_sql("((a.value * 0.75 + b.value * 0.25) + (c.value * 0.75 + d.value * 0.25)) / 2"))
def bilinear_strict(spark, sf):
    """Sampling where a blank neighbour makes the result blank."""
    return _policy(spark, sf, "strict")


@query(f"WITH {PIXELS} SELECT npix, x, y, round(value, 6) AS value FROM px")
def fits_roundtrip(spark, sf):
    """Every tile encoded as an image file and decoded again."""
    files = fits.with_content(tiles8(spark, sf).select("npix", "pixels"), 9, 8)

    def decoded(batches):
        for batch in batches:
            rows = [(p, fits.decode(c)["pixels"].tolist()) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(p.rsplit("Npix", 1)[1].removesuffix(".fits")) for p, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["npix", "pixels"])

    return images.unnest(files.mapInArrow(decoded, "npix long, pixels array<float>"), "pixels", 8, ("npix",)).withColumn("value", r6("value"))


@query(f"""WITH {PIXELS}, k AS (SELECT range - 2 AS d, exp(-(range - 2) * (range - 2) / 0.5::DOUBLE) AS g FROM range(5)), w AS (SELECT d, g / (SELECT sum(g) FROM k) AS g FROM k)
 SELECT a.npix, a.x, a.y, round(sum(b.value * i.g * j.g), 5) AS value FROM px a, w i, w j, px b WHERE b.npix = a.npix AND b.x = greatest(0, least(7, a.x + i.d)) AND b.y = greatest(0, least(7, a.y + j.d)) GROUP BY ALL""")
def blur_tiles(spark, sf):
    """Tiles convolved with a round Gaussian of half a pixel, edges extended."""
    t = tiles8(spark, sf).select("npix", simulate.blur("pixels", 8, 0.5).alias("pixels"))
    return images.unnest(t, "pixels", 8, ("npix",)).withColumn("value", F.round("value", 5))


@query(f"""WITH {PIXELS} SELECT h.name AS hypothesis, count(*) FILTER (a.value = b.value) AS matches, count(*) AS n FROM px a, (VALUES ('identity'), ('transpose'), ('flip_rows'), ('flip_columns')) h(name), px b
 WHERE b.npix = a.npix AND b.x = CASE h.name WHEN 'transpose' THEN a.y WHEN 'flip_columns' THEN 7 - a.x ELSE a.x END AND b.y = CASE h.name WHEN 'transpose' THEN a.x WHEN 'flip_rows' THEN 7 - a.y ELSE a.y END GROUP BY h.name""")
def mapping_hypotheses(spark, sf):
    """How many pixels agree under each guess at a tile's pixel order."""
    p = px(spark, sf).select("npix", "x", "y", "value")
    x, y = F.col("x"), F.col("y")
    guesses = F.array(*[F.struct(F.lit(n).alias("name"), a.cast("int").alias("x"), b.cast("int").alias("y")) for n, a, b in (("identity", x, y), ("transpose", y, x), ("flip_rows", x, 7 - y), ("flip_columns", 7 - x, y))])
    g = p.select("npix", F.col("value").alias("own"), F.explode(guesses).alias("g")).select("npix", "own", F.col("g.name").alias("hypothesis"), "g.x", "g.y")
    return g.join(p, ["npix", "x", "y"]).groupBy("hypothesis").agg(F.count(F.when(F.col("own") == F.col("value"), 1)).alias("matches"), F.count("*").alias("n"))


@query("SELECT part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, ntile(32) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) || o_orderstatus AS part FROM orders) GROUP BY part")
def work_chunks(spark, sf):
    """Orders of each status in 32 consecutive chunks."""
    part = F.concat(F.ntile(32).over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")).cast("string"), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", part.alias("part")).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT tree, append, highest, count(*) AS n, bool_and(tree AND NOT append AND highest > 0) AS runs_tree, min(CASE WHEN tree THEN 0 ELSE highest END)::INT AS first_order, bool_and(tree AND highest > 3) AS defers_preview
 FROM (SELECT o_orderstatus = 'F' AS tree, o_custkey % 2 = 0 AS append, (o_orderkey % 6)::INT AS highest FROM orders) GROUP BY ALL""")
def stage_policy(spark, sf):
    """Orders as runs with options: how many have each, and which stages those run."""
    tree, highest = F.col("tree"), F.col("highest")
    runs = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("tree"), (F.col("o_custkey") % 2 == 0).alias("append"), (F.col("o_orderkey") % 6).cast("int").alias("highest"))
    stages = {"runs_tree": tree & ~F.col("append") & (highest > 0), "first_order": F.when(tree, 0).otherwise(highest), "defers_preview": tree & (highest > 3)}
    return runs.groupBy("tree", "append", "highest").agg(F.count("*").alias("n")).withColumns(stages)


@query("SELECT l_returnflag AS station, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_extendedprice BETWEEN 5000 AND 60000 GROUP BY 1")
def valid_range_filter(spark, sf):
    """Means of the values inside a valid range, which the scan filters."""
    rows = table(spark, sf, "lineitem").where(F.col("l_extendedprice").between(5000, 60000))
    return rows.groupBy(F.col("l_returnflag").alias("station")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("""WITH m AS (SELECT floor(ra_cell)::BIGINT AS cell, value FROM (SELECT (c_custkey * 7 % 360) / 10.0::DOUBLE AS ra_cell, c_acctbal AS value FROM customer)), u AS (SELECT cell, up, value FROM m, (SELECT range AS up FROM range(3)))
 SELECT up, cell >> (2 * up) AS cell, count(*) AS n, round(sum(value), 2) AS total FROM u GROUP BY ALL""")
def cell_rollup(spark, sf):
    """Counts and sums over cells and two levels of ancestors."""
    m = table(spark, sf, "customer").select(F.floor((F.col("c_custkey") * 7 % 360) / 10.0).alias("cell"), F.col("c_acctbal").alias("value"))
    base = m.groupBy("cell").agg(F.count("*").alias("n"), F.sum("value").alias("s")).withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return base.groupBy("up", F.expr("shiftright(cell, 2 * up)").alias("cell")).agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query()
def injection_recovery_table(spark, sf):
    """Recovery of injected sources by level and station."""
    tiles = px(spark, sf).select(F.col("npix").alias("image_id"), "x", "y", "value")
    found = transients.injection_recovery(tiles, (3, 5, 7, 10, 20, 50), {"A": 1.0, "B": 1.5, "C": 2.5})
    return found.select("level", "station", "n", "hits", r6("share").alias("share"), r6("low").alias("low"), r6("high").alias("high"))


@query()
def separated_peaks(spark, sf):
    """The brightest pixels of every tile that keep three pixels apart."""
    p = px(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("npix").orderBy(F.desc("value"), "y", "x")))
    return simulate.keep_apart(p.select(F.col("npix").alias("image_id"), "rank", "x", "y"), "image_id", 3.0)


@query()
def noisy_tiles(spark, sf):
    """Tiles with reproducible normal noise."""
    return simulate.with_noise(px(spark, sf).select("npix", "x", "y", "value"), 0.5, key="npix", seed=42).withColumn("value", r6("value"))
