"""Queries over the grid, projections, coverage and the index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions import text, wcs
from ..operators import coverage as cov
from ..operators import catalogue, cutouts, images, incremental
from ..sources import index as ix
from .sky import FRAMES, STARS, ang2pix_sql, compress_sql, cover_sql, frames, pix2ang_sql, pix2sky_sql, query, sky2pix_sql, spread_sql, stars, table


def r6(c):
    return F.round(c, 6)


@query(f"WITH {STARS} SELECT npix, count(*) AS n, round(avg(mag), 6) AS mean_mag FROM {ang2pix_sql('stars', 3)} GROUP BY npix")
def catalog_density_o3(spark, sf):
    """Stars and mean magnitude per order-3 cell."""
    cells = hp.with_cell(stars(spark, sf), 3).select("npix", "mag")
    return cells.groupBy("npix").agg(F.count("*").alias("n"), r6(F.avg("mag")).alias("mean_mag"))


@query(f"WITH {STARS}, c AS (SELECT DISTINCT npix FROM {ang2pix_sql('stars', 4)}) SELECT npix, round(ra, 6) AS ra, round(dec, 6) AS dec, back FROM {ang2pix_sql(pix2ang_sql('c', 4), 4, 'back')}")
def hpx_roundtrip_o4(spark, sf):
    """Centres of all order-4 cells that hold stars, and the cells they lie in."""
    p = hp.with_centre(hp.with_cell(stars(spark, sf), 4).select("npix").distinct(), 4)
    return hp.with_cell(p, 4, out="back").select("npix", r6("ra").alias("ra"), r6("dec").alias("dec"), "back")


@query(f"WITH {STARS}, c AS (SELECT npix FROM {ang2pix_sql('stars', 5)}) SELECT (5 - up)::INT AS \"order\", npix >> (2 * up) AS npix, count(*) AS n FROM c, (SELECT range::INT AS up FROM range(6)) GROUP BY ALL")
def hpx_parent_rollup(spark, sf):
    """Star counts at orders 5 to 0; lower orders are sums over ancestors."""
    base = hp.with_cell(stars(spark, sf), 5).groupBy("npix").count()
    up = base.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return up.groupBy((5 - F.col("up")).cast("int").alias("order"), F.expr("shiftright(npix, 2 * up)").alias("npix")).agg(F.sum("count").alias("n"))


@query(f"WITH {STARS} SELECT star_id, npix, (npix // 10000) * 10000 AS dir, 'Norder8/Dir' || ((npix // 10000) * 10000)::VARCHAR || '/Npix' || npix::VARCHAR || '.fits' AS path FROM {ang2pix_sql('stars', 8)}")
def tile_paths(spark, sf):
    """Directory and file of the order-8 tile of every star."""
    p = hp.with_cell(stars(spark, sf), 8)
    return p.select("star_id", "npix", hp.tile_dir("npix").alias("dir"), hp.tile_path(F.lit(8), "npix").alias("path"))


@query(f"SELECT x, y, 2 * {spread_sql('x', 5)} + {spread_sql('(31 - y)', 5)} AS \"offset\", x AS back_x, y AS back_y FROM (SELECT DISTINCT l_partkey % 32 AS x, l_suppkey % 32 AS y FROM lineitem)")
def xy2hpx_table(spark, sf):
    """Offsets of the pixels of a 32-pixel tile that line items fall into, and back."""
    p = table(spark, sf, "lineitem").select((F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y")).distinct()
    p = p.withColumn("offset", hp.xy2hpx("x", "y", 32))
    x, y = hp.hpx2xy("offset", 32)
    return p.select("x", "y", "offset", x.alias("back_x"), y.alias("back_y"))


@query(f"""WITH {STARS}, c AS (SELECT DISTINCT npix FROM {ang2pix_sql('stars', 3)}) SELECT npix, round(4.5 - (-cx - cy) / (2 * s), 6) AS crpix1, round(4.5 - (cx - cy) / (2 * s), 6) AS crpix2, round(s, 9) AS cd2_1 FROM (
 SELECT npix, 45.0::DOUBLE / (8 * 8) AS s, (([1,3,5,7,0,2,4,6,1,3,5,7])[f + 1] + (x - y) / 8.0::DOUBLE) * 45.0 AS cx, (([1,1,1,1,0,0,0,0,-1,-1,-1,-1])[f + 1] + (x + y + 1 - 8) / 8.0::DOUBLE) * 45.0 AS cy FROM (
 SELECT npix, npix >> 6 AS f, {compress_sql('(npix & 63)', 3)} AS x, {compress_sql('((npix & 63) >> 1)', 3)} AS y FROM c))""")
def hpx_tile_wcs(spark, sf):
    """Reference pixels, in the plane of the grid, of all order-3 tiles that hold stars."""
    t = images.hpx_tile_wcs(hp.with_cell(stars(spark, sf), 3).select("npix").distinct(), 3, 8)
    return t.select("npix", r6("crpix1").alias("crpix1"), r6("crpix2").alias("crpix2"), F.round("cd2_1", 9).alias("cd2_1"))


@query(f"""WITH {FRAMES}, {STARS} SELECT image_id, star_id, round(px, 4) AS x, round(py, 4) AS y FROM {sky2pix_sql("(SELECT * FROM frames JOIN stars ON abs(dec - crval2) < 0.6)", "image_id, star_id, width, height")}
 WHERE px >= 0 AND py >= 0 AND px < width AND py < height""")
def tan_project_stars(spark, sf):
    """Pixel positions of all stars in the field of each frame."""
    found = cov.stars_in_frames(frames(spark, sf), stars(spark, sf), 6)
    return found.select("image_id", "star_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {FRAMES}, c AS (SELECT *, cx AS x, cy AS y FROM frames, (VALUES (-0.5::DOUBLE, -0.5::DOUBLE), (63.5, -0.5), (63.5, 63.5), (-0.5, 63.5)) t(cx, cy))
 SELECT image_id, x, y, round(ra, 6) AS ra, round(dec, 6) AS dec FROM {pix2sky_sql('c', 'image_id, x, y')}""")
def tan_unproject_corners(spark, sf):
    """Sky positions of every frame's corners."""
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.5, -0.5), (63.5, -0.5), (63.5, 63.5), (-0.5, 63.5))])
    f = frames(spark, sf).withColumn("c", F.explode(corners))
    ra, dec = wcs.pix2sky(F.col("c.x"), F.col("c.y"), wcs.wcs_of())
    return f.select("image_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"), r6(ra).alias("ra"), r6(dec).alias("dec"))


@query("""SELECT p_partkey, round(scale, 6) AS scale, greatest(least(ceil(log2(374400.0 / (scale * 512))), 15), 0)::INT AS best, CASE WHEN p_size * 200 < 2048 THEN 5 WHEN p_size * 200 < 4096 THEN 6 WHEN p_size * 200 < 8192 THEN 7 ELSE 8 END AS by_size
 FROM (SELECT p_partkey, p_size, (sqrt(pow(p_size * 1e-5, 2) + pow(p_size * 2e-6, 2)) + sqrt(pow(p_size * 3e-6, 2) + pow(p_size * 1e-5, 2))) / 2 * 3600 AS scale FROM part)""")
def pixel_scale_order(spark, sf):
    """Pixel scale from a skewed CD matrix and the tile orders that follow from scale and size."""
    size = F.col("p_size")
    p = table(spark, sf, "part").withColumns({"cd1_1": size * 1e-5, "cd2_1": size * 2e-6, "cd1_2": size * 3e-6, "cd2_2": size * 1e-5})
    w = {c: F.col(c) for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2")}
    p = p.withColumn("scale", wcs.pixel_scale(w))
    return p.select("p_partkey", r6("scale").alias("scale"), wcs.recommended_order("scale").alias("best"), wcs.order_by_size(size * 200).alias("by_size"))


@query("SELECT list_sort(list(scale))[len(list(scale)) // 2 + 1] AS median_scale FROM (SELECT p_size * 0.036::DOUBLE AS scale FROM part)")
def upper_median_scale(spark, sf):
    """The upper median of the parts' pixel scales."""
    scales = table(spark, sf, "part").select((F.col("p_size") * 0.036).alias("scale"))
    counts = scales.groupBy("scale").count()
    upto = Window.orderBy("scale").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    ranked = counts.withColumn("upto", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(every))
    return ranked.where("upto > floor(n / 2)").agg(F.min("scale").alias("median_scale"))


COVERAGE_SQL = f"cover AS MATERIALIZED (SELECT image_id, npix FROM {cover_sql('frames', 'image_id', 6, 64, 0.01)})"


@query(f"WITH {FRAMES}, {COVERAGE_SQL} SELECT image_id, npix FROM cover")
def coverage_sampled(spark, sf):
    """Order-6 cells that each frame covers."""
    return cov.coverage(frames(spark, sf), 6)


@query(f"WITH {FRAMES}, {COVERAGE_SQL} SELECT npix, count(*) AS n_sources, (sum(count(*)) OVER (ORDER BY npix) - count(*))::BIGINT AS row_offset FROM cover GROUP BY npix")
def tile_source_counts(spark, sf):
    """Sources per tile and where they start in the concatenated list."""
    return cov.source_offsets(cov.coverage(frames(spark, sf), 6))


@query(f"WITH {FRAMES}, {COVERAGE_SQL} SELECT DISTINCT (6 - up)::INT AS \"order\", npix >> (2 * up) AS npix, image_id FROM cover, (SELECT range::INT AS up FROM range(4))")
def index_all_orders(spark, sf):
    """The index of orders 6 to 3 from the coverage of order 6."""
    return cov.all_orders(cov.coverage(frames(spark, sf), 6), 6, lowest=3)


FILES_SQL = """keys AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '/data/' || source || '/' || (doc_id % 97) || '.fits' WHEN doc_id % 3 = 1 THEN source || '/' || (doc_id % 97) || '.fits' ELSE 'old/' || (doc_id % 211) || '.fits' END AS source_key FROM documents),
 files AS (SELECT DISTINCT '/data/' || source || '/' || (doc_id % 89) || '.fits' AS path FROM documents)"""


@query(f"""WITH {FILES_SQL} SELECT source_key, coalesce(e.path, b.path) AS path, CASE WHEN e.path IS NOT NULL THEN 'exact' WHEN b.path IS NOT NULL THEN 'basename' END AS how
 FROM keys LEFT JOIN files e ON e.path = CASE WHEN starts_with(source_key, '/') THEN source_key ELSE '/data/' || source_key END
 LEFT JOIN (SELECT regexp_extract(path, '[^/]*$') AS name, min(path) AS path FROM files GROUP BY 1) b ON b.name = regexp_extract(source_key, '[^/]*$')""")
def source_resolution(spark, sf):
    """Files that source keys name: exactly, or by their base name."""
    d = table(spark, sf, "documents")
    number = lambda n: (F.col("doc_id") % n).cast("string")
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/"), "source", F.lit("/"), number(97), F.lit(".fits"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/"), number(97), F.lit(".fits"))).otherwise(F.concat(F.lit("old/"), number(211), F.lit(".fits")))
    files = d.select(F.concat(F.lit("/data/"), "source", F.lit("/"), number(89), F.lit(".fits")).alias("path")).distinct()
    return cov.resolve_sources(d.select(key.alias("source_key")), files, "/data")


BOXES_SQL = "boxes AS (SELECT o_orderkey AS image_id, ((o_custkey * 7) % 130 - 10)::INT AS x0, ((o_orderkey * 11) % 120 - 5)::INT AS y0, (o_custkey % 60 + 4)::INT AS w, (o_orderkey % 40 + 4)::INT AS h, 128 AS width, 128 AS height FROM orders)"
CELLS_SQL = """clip AS (SELECT image_id, width, height, greatest(x0, 0) AS a, greatest(y0, 0) AS b, least(x0 + w, width) - 1 AS c, least(y0 + h, height) - 1 AS d FROM boxes WHERE greatest(x0, 0) < least(x0 + w, width) AND greatest(y0, 0) < least(y0 + h, height)),
 cells AS (SELECT DISTINCT image_id, width, height, i * 32 AS x0, j * 32 AS y0, least(32, width - i * 32) AS w, least(32, height - j * 32) AS h FROM clip JOIN (SELECT range::INT AS i FROM range(4)) ON i BETWEEN a // 32 AND c // 32 JOIN (SELECT range::INT AS j FROM range(4)) ON j BETWEEN b // 32 AND d // 32)"""


def boxes(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("image_id"), ((F.col("o_custkey") * 7) % 130 - 10).cast("int").alias("x0"), ((F.col("o_orderkey") * 11) % 120 - 5).cast("int").alias("y0"),
        (F.col("o_custkey") % 60 + 4).cast("int").alias("w"), (F.col("o_orderkey") % 40 + 4).cast("int").alias("h"), F.lit(128).alias("width"), F.lit(128).alias("height"),
    )


@query(f"WITH {BOXES_SQL}, {CELLS_SQL} SELECT image_id, x0, y0, w, h FROM cells")
def cutout_cells(spark, sf):
    """Cells of 32 pixels that each image's box touches."""
    return cutouts.cells(boxes(spark, sf), 32).select("image_id", "x0", "y0", "w", "h")


@query(f"WITH {BOXES_SQL}, {CELLS_SQL} SELECT image_id, count(*) AS n_cells, sum(w * h)::BIGINT AS planned, round(sum(w * h) / (128.0 * 128), 6) AS share, sum(w * h) / (128.0 * 128) >= 0.85 AS read_full FROM cells GROUP BY image_id")
def cutout_plan(spark, sf):
    """Planned pixels and the switch to a full read."""
    p = cutouts.plan(boxes(spark, sf), 32)
    return p.select("image_id", "n_cells", "planned", r6("share").alias("share"), "read_full")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red ') OR ends_with(p_name, 'bolt') ORDER BY p_name, p_partkey LIMIT 50")
def glob_filter_limit(spark, sf):
    """The first 50 names that a glob matches."""
    p = table(spark, sf, "part")
    kept = p.where(text.glob_match("p_name", "red *") | text.glob_match("p_name", "*bolt"))
    return kept.orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query(f"WITH {STARS}, d AS (SELECT * FROM {ang2pix_sql('stars', 8)}) SELECT DISTINCT 'Norder8/Dir' || ((npix // 10000) * 10000)::VARCHAR AS dir FROM d")
def parent_dirs(spark, sf):
    """Distinct directories of the stars' tiles."""
    p = hp.with_cell(stars(spark, sf), 8).select(hp.tile_path(F.lit(8), "npix").alias("path"))
    return p.select(F.substring_index("path", "/", 2).alias("dir")).distinct()


@query("SELECT l_orderkey AS npix, 'f' || (l_partkey % 50) || '.fits' AS filepath, max(l_suppkey) AS cellmem, 'f' || (l_partkey % 50) || '.fits' AS filename FROM lineitem GROUP BY 1, 2")
def index_json_roundtrip(spark, sf):
    """Provenance rows written as JSON lines and parsed back."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("npix"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".fits")).alias("filepath")).agg(F.max("l_suppkey").alias("cellmem"))
    lines = rows.select("npix", F.to_json(F.struct("filepath", "cellmem")).alias("line"))
    parsed = lines.select("npix", text.index_line("line").alias("r"))
    return parsed.select("npix", "r.filepath", "r.cellmem", text.basename("r.filepath").alias("filename"))


INDEX_SQL = """old AS (SELECT l_orderkey AS npix, 's' || (l_partkey % 400) AS filepath, max(l_suppkey) AS cellmem FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
 new AS (SELECT l_orderkey AS npix, 's' || (l_partkey % 400) AS filepath, max(l_suppkey) AS cellmem FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1, 2),
 merged AS (SELECT coalesce(o.npix, n.npix) AS npix, coalesce(o.filepath, n.filepath) AS filepath, coalesce(n.cellmem, o.cellmem) AS cellmem, n.npix IS NOT NULL AND (o.npix IS NULL OR o.cellmem <> n.cellmem) AS changed FROM old o FULL JOIN new n ON o.npix = n.npix AND o.filepath = n.filepath)"""


def provenance(spark, sf, condition: str):
    return table(spark, sf, "lineitem").where(condition).select(F.col("l_orderkey").alias("npix"), F.concat(F.lit("s"), (F.col("l_partkey") % 400).cast("string")).alias("filepath"), F.col("l_suppkey").alias("cellmem"))


def merged(spark, sf):
    return incremental.merge_index(provenance(spark, sf, "l_linenumber <= 4"), provenance(spark, sf, "l_linenumber >= 4"))


@query(f"WITH {INDEX_SQL} SELECT * FROM merged")
def append_merge(spark, sf):
    """The index after a batch, with what changed."""
    return merged(spark, sf)


@query(f"WITH {INDEX_SQL} SELECT DISTINCT npix FROM merged WHERE changed")
def append_dirty(spark, sf):
    """Tiles that a batch makes dirty."""
    return incremental.dirty_tiles(merged(spark, sf))


@query("""WITH s AS (SELECT l_orderkey AS npix, (l_partkey % 4)::INT AS x, (l_suppkey % 4)::INT AS y, l_extendedprice AS value, l_quantity AS weight FROM lineitem)
 SELECT npix, x, y, round(sum(value * weight) / sum(weight) + 0.0000001, 4) AS value FROM s GROUP BY ALL""")
def append_acc(spark, sf):
    """Tiles after state, a batch, and the batch again: equal to a build of everything."""
    samples = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("npix"), (F.col("l_partkey") % 4).cast("int").alias("x"), (F.col("l_suppkey") % 4).cast("int").alias("y"), (F.col("l_partkey") % 30).alias("source"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight"))
    state = incremental.accumulate(samples.where("source < 20"))
    batch = samples.where("source >= 20")
    state = incremental.apply_batch(incremental.apply_batch(state, batch), batch)
    tiles = incremental.tiles_of(state)
    return tiles.select("npix", "x", "y", F.round(F.col("value") + 1e-7, 4).alias("value"))  # off the ties of exact means


@query("SELECT l_suppkey AS supplier, count(*) AS tasks, greatest(1, least(64, (count(*) + 127) // 128))::BIGINT AS chunk FROM lineitem GROUP BY 1")
def chunk_plan(spark, sf):
    """Line items of each supplier, and in chunks of how many 32 workers would take them."""
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("tasks"))
    return counts.withColumn("chunk", F.greatest(F.least(F.ceil(F.col("tasks") / 128), F.lit(64)), F.lit(1)).cast("long"))


@query("SELECT o_orderkey AS order_id, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority <> '5-LOW' AND o_custkey % 7 <> 3 AND o_orderdate >= TIMESTAMP '1993-01-01'")
def observation_query(spark, sf):
    """A conjunction of filters, all pushed to the scan where it can take them."""
    o = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 200000) & (F.col("o_orderpriority") != "5-LOW") & (F.col("o_custkey") % 7 != 3) & (F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp")))
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


@query(f"WITH {STARS} SELECT star_id, round(mag, 6) AS mag, round(sep, 6) AS sep FROM (SELECT *, degrees(2 * asin(least(1.0, sqrt(pow(cos(radians(dec)) * cos(radians(ra)) - cos(radians(10.0)) * cos(radians(40.0)), 2) + pow(cos(radians(dec)) * sin(radians(ra)) - cos(radians(10.0)) * sin(radians(40.0)), 2) + pow(sin(radians(dec)) - sin(radians(10.0)), 2)) / 2))) AS sep FROM stars) WHERE sep <= 25 AND mag BETWEEN 14 AND 19.5")
def cone_search(spark, sf):
    """Stars of a magnitude window within 25 degrees of a position: ranges of cells, then the exact test."""
    found = catalogue.cone(hp.with_cell(stars(spark, sf), 6), 40.0, 10.0, 25.0, 6)
    return found.where(F.col("mag").between(14, 19.5)).select("star_id", r6("mag").alias("mag"), r6("separation").alias("sep"))


BAND_SQL = """bands AS (SELECT star_id, ra, dec, mag AS gmag, CASE WHEN star_id % 11 = 0 THEN 'nan'::DOUBLE ELSE mag - 0.4 END AS rmag, CASE WHEN star_id % 5 = 0 THEN NULL WHEN star_id % 7 = 0 THEN -1.0 ELSE 0.01 + (star_id % 9) / 100.0 END::DOUBLE AS e_rmag FROM stars),
 fields AS (SELECT s_suppkey AS target_id, CASE s_suppkey % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'g' WHEN 2 THEN 'R' ELSE 'H' END AS band, (s_suppkey % 5 + 1) * 2.0 AS radius, (s_suppkey * 29.7713::DOUBLE) - 360.0::DOUBLE * floor(s_suppkey * 29.7713::DOUBLE / 360.0::DOUBLE) AS ra, (s_suppkey * 17.3171::DOUBLE) - 180.0::DOUBLE * floor(s_suppkey * 17.3171::DOUBLE / 180.0::DOUBLE) - 90.0::DOUBLE AS dec FROM supplier)"""


def _sep_sql(a: str, b: str) -> str:
    return f"degrees(2 * asin(least(1.0, sqrt(pow(cos(radians({a}.dec)) * cos(radians({a}.ra)) - cos(radians({b}.dec)) * cos(radians({b}.ra)), 2) + pow(cos(radians({a}.dec)) * sin(radians({a}.ra)) - cos(radians({b}.dec)) * sin(radians({b}.ra)), 2) + pow(sin(radians({a}.dec)) - sin(radians({b}.dec)), 2)) / 2)))"


@query(f"""WITH {STARS}, {BAND_SQL}, pairs AS (SELECT f.target_id, f.band, b.star_id, f.radius, {_sep_sql('f', 'b')} AS sep, CASE WHEN f.band IN ('V', 'R') THEN rmag WHEN f.band = 'g' THEN gmag END AS mag,
 CASE WHEN f.band IN ('V', 'R') THEN CASE WHEN e_rmag > 0 THEN e_rmag ELSE 0.05 END ELSE 0.01 END AS mag_err FROM fields f JOIN bands b ON abs(f.dec - b.dec) <= f.radius + 0.01)
 SELECT target_id, star_id, round(sep, 6) AS sep, round(mag, 6) AS mag, round(mag_err, 6) AS mag_err FROM pairs WHERE sep <= radius AND NOT isnan(mag) AND mag BETWEEN 14 AND 20""")
def reference_cones(spark, sf):
    """Reference stars around every position, within its own radius and in its own band."""
    s, key = stars(spark, sf), F.col("star_id")
    rmag = F.when(key % 11 == 0, float("nan")).otherwise(F.col("mag") - 0.4)
    err = F.when(key % 5 == 0, None).when(key % 7 == 0, -1.0).otherwise(0.01 + (key % 9) / 100.0)
    bands = s.select("star_id", "ra", "dec", F.col("mag").alias("gmag"), rmag.alias("rmag"), err.alias("e_rmag"))
    k, turn = F.col("s_suppkey"), lambda x, m: x - m * F.floor(x / m)
    band = F.when(k % 4 == 0, "V").when(k % 4 == 1, "g").when(k % 4 == 2, "R").otherwise("H")
    fields = table(spark, sf, "supplier").select(k.alias("target_id"), band.alias("band"), ((k % 5 + 1) * 2.0).alias("radius"), turn(k * 29.7713, 360.0).alias("ra"), (turn(k * 17.3171, 180.0) - 90.0).alias("dec"))
    known = fields.withColumn("letter", catalogue.letter_of(F.col("band"))).where("letter is not null")
    marked = catalogue.by_band(bands).select("star_id", "ra", "dec", "letter", r6("mag").alias("mag"), r6("mag_err").alias("mag_err"))
    return catalogue.cones(known, marked, "radius", 4, by=("letter",)).select("target_id", "star_id", r6("separation").alias("sep"), "mag", "mag_err")


@query(f"""WITH {STARS}, c AS (SELECT DISTINCT npix FROM {ang2pix_sql('stars', 4)}),
 corners AS (SELECT npix, unnest([0.0, 1.0, 1.0, 0.0]) AS u, unnest([0.0, 0.0, 1.0, 1.0]) AS v, npix >> 8 AS f_, {compress_sql('(npix & 255)', 4)} AS x_, {compress_sql('((npix & 255) >> 1)', 4)} AS y_ FROM (SELECT range AS npix FROM range(3072))),
 rings AS (SELECT npix, f_, (x_ + u) / 16.0::DOUBLE AS a, (y_ + v) / 16.0::DOUBLE AS b, ([2,2,2,2,3,3,3,3,4,4,4,4])[f_ + 1] - (x_ + u) / 16.0::DOUBLE - (y_ + v) / 16.0::DOUBLE AS r FROM corners),
 places AS (SELECT npix, round(CASE WHEN r < 1 THEN 1 - s * s / 3 WHEN r > 3 THEN s * s / 3 - 1 ELSE (2 - r) * 2 / 3 END, 9) AS z, CASE WHEN s = 0 THEN 0 ELSE (round(([1,3,5,7,0,2,4,6,1,3,5,7])[f_ + 1] * 1e6 + (a - b) / s * 1e6)::BIGINT + 8000000) % 8000000 END AS t FROM (SELECT *, CASE WHEN r < 1 THEN r WHEN r > 3 THEN 4 - r ELSE 1 END AS s FROM rings))
 SELECT DISTINCT c.npix, q.npix AS neighbour FROM c JOIN places p ON p.npix = c.npix JOIN places q ON q.z = p.z AND q.t = p.t AND q.npix <> p.npix""")
def cell_neighbours(spark, sf):
    """The cells around every cell that holds a star: those that share a corner with it."""
    return hp.with_neighbours(hp.with_cell(stars(spark, sf), 4).select("npix").distinct(), 4)


@query(f"""WITH {STARS}, l AS (SELECT star_id AS left_id, ra, dec FROM stars WHERE star_id % 2 = 0), r AS (SELECT star_id AS right_id, ra AS ra2, dec AS dec2 FROM stars WHERE star_id % 2 = 1),
 p AS (SELECT left_id, right_id, degrees(2 * asin(least(1.0, sqrt(pow(cos(radians(dec)) * cos(radians(ra)) - cos(radians(dec2)) * cos(radians(ra2)), 2) + pow(cos(radians(dec)) * sin(radians(ra)) - cos(radians(dec2)) * sin(radians(ra2)), 2) + pow(sin(radians(dec)) - sin(radians(dec2)), 2)) / 2))) AS sep FROM l JOIN r ON abs(dec - dec2) <= 2)
 SELECT left_id, arg_min(right_id, sep) AS right_id, round(min(sep), 6) AS separation FROM p WHERE sep <= 2 GROUP BY left_id""")
def crossmatch_nearest(spark, sf):
    """The nearest odd star within two degrees of every even one."""
    s = stars(spark, sf).select(F.col("star_id").alias("id"), "ra", "dec")
    n = cov.nearest(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 3, 2.0)
    return n.select("left_id", "right_id", r6("separation").alias("separation"))


@query(f"""WITH {FRAMES}, {STARS}, {COVERAGE_SQL}, t AS (SELECT star_id AS target_id, ra, dec, npix FROM {ang2pix_sql('stars', 6)}),
 j AS (SELECT t.target_id, t.npix, t.ra, t.dec, c.image_id AS cov_id, f.* FROM t LEFT JOIN cover c USING (npix) LEFT JOIN frames f ON f.image_id = c.image_id),
 k AS (SELECT target_id, npix, cov_id, date_obs, CASE WHEN px >= 0 AND py >= 0 AND px < width AND py < height THEN image_id END AS held FROM {sky2pix_sql('j', 'target_id, npix, cov_id, date_obs, width, height, image_id')}),
 g AS (SELECT target_id, npix, count(cov_id) AS n_candidates, min(CASE WHEN held IS NOT NULL THEN {{'d': date_obs, 'i': held}} END).i AS image_id FROM k GROUP BY ALL)
 SELECT target_id, npix, n_candidates, image_id, CASE WHEN n_candidates = 0 THEN 'no_index_hit' WHEN image_id IS NULL THEN 'no_source_image' ELSE 'found' END AS reason FROM g""")
def candidate_lookup(spark, sf):
    """The first frame that holds each candidate, or why none does."""
    targets = stars(spark, sf).select(F.col("star_id").alias("target_id"), "ra", "dec")
    return cov.first_covering_frame(targets, frames(spark, sf), 6, "date_obs").select("target_id", "npix", "n_candidates", "image_id", "reason")


@query(f"WITH {STARS} SELECT star_id, round(l_, 4) AS glon, round(degrees(b_), 4) AS glat FROM (SELECT star_id, b_, 122.93192 - degrees(atan2(cos(d_) * sin(a_), sin(d_) * cos(p_) - cos(d_) * sin(p_) * cos(a_))) AS l0_, l0_ - floor(l0_ / 360.0) * 360.0 AS l_ FROM (SELECT *, radians(ra - 192.85948) AS a_, radians(dec) AS d_, radians(27.12825) AS p_, asin(sin(d_) * sin(p_) + cos(d_) * cos(p_) * cos(a_)) AS b_ FROM stars))")
def galactic_positions(spark, sf):
    """Galactic coordinates of the stars."""
    l, b = hp.to_galactic("ra", "dec")
    return stars(spark, sf).select("star_id", F.round(l, 4).alias("glon"), F.round(b, 4).alias("glat"))


@query("""SELECT p_partkey, p_brand AS object, p_size::DOUBLE AS exptime, CASE WHEN p_size % 3 = 0 THEN -0.001 * cos(radians(30.0)) ELSE 0.002 END::DOUBLE AS cd1_1 FROM part""")
def header_cards(spark, sf):
    """Values parsed from header cards; the CD matrix from CDELT and CROTA2 where it is missing."""
    card = lambda key, value: F.rpad(F.concat(F.lit(f"{key:<8}= "), value), 80, " ")
    cd = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(card("CD1_1", F.lit("0.002 / degrees")))
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("\n", card("OBJECT", F.concat(F.lit("'"), "p_brand", F.lit("'  / name"))), card("EXPTIME", F.concat(F.col("p_size").cast("string"), F.lit(".0 / seconds"))), cd, card("CDELT1", F.lit("-0.001")), card("CDELT2", F.lit("0.001")), card("CROTA2", F.lit("30.0"))).alias("header"))
    number = lambda key: text.card_value("header", key).try_cast("double")
    m = wcs.cd_matrix(number("CD1_1"), number("CD1_2"), number("CD2_1"), number("CD2_2"), number("CDELT1"), number("CDELT2"), number("CROTA2"))
    return p.select("p_partkey", text.card_value("header", "OBJECT").alias("object"), number("EXPTIME").alias("exptime"), m[0].alias("cd1_1"))


@query("""SELECT * FROM (VALUES ('dataproduct_type', 'image'), ('hips_frame', 'equatorial'), ('hips_nb_tiles', (SELECT count(DISTINCT vec_id)::VARCHAR FROM embeddings)), ('hips_order', '9'), ('hips_pixel_bitpix', '-32'), ('hips_pixel_cut', '-1.0000 1.0000'),
 ('hips_pixel_scale', '1.098633e-02'), ('hips_tile_format', 'fits'), ('hips_tile_width', '8'), ('moc_sky_fraction', (SELECT printf('%.6f', count(DISTINCT vec_id) / 3145728.0) FROM embeddings))) t(key, value)""")
def properties_kv(spark, sf):
    """Key and value rows of a survey's description."""
    return ix.properties(table(spark, sf, "embeddings").select(F.col("vec_id").alias("npix")), 9, 8, -1.0, 1.0)


@query(f"WITH {FRAMES} SELECT station, image_id, date_obs, round(exptime, 3) AS exptime, round(px, 4) AS target_x, round(py, 4) AS target_y, coalesce(px >= 0 AND py >= 0 AND px < 64 AND py < 64, false) AS in_fov FROM {sky2pix_sql('(SELECT *, 40.0::DOUBLE AS ra, 10.0::DOUBLE AS dec FROM frames)', 'station, image_id, date_obs, exptime')}")
def frame_inventory(spark, sf):
    """Every frame with the pixel position of a target and whether it is in the field."""
    x, y = wcs.sky2pix(F.lit(40.0), F.lit(10.0), wcs.wcs_of())
    f = frames(spark, sf).withColumn("x", x).withColumn("y", y)
    return f.select("station", "image_id", "date_obs", F.round("exptime", 3).alias("exptime"), F.round("x", 4).alias("target_x"), F.round("y", 4).alias("target_y"), F.coalesce(wcs.inside("x", "y", F.lit(64), F.lit(64)), F.lit(False)).alias("in_fov"))
