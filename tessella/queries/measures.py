"""Queries over measurements: photometry, combination, recovery, light curves, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import photometry as ph
from ..operators import measure
from ..streaming import ingest
from .grid import r6
from .sky import STARS, query, stars, table


@query("""WITH o AS (SELECT l_suppkey % 50 AS field, 25 + l_discount * 3 + (l_quantity % 7) * 0.02::DOUBLE AS off FROM lineitem), m AS (SELECT field, median(off) AS m FROM o GROUP BY field),
 d AS (SELECT field, off, abs(off - m) AS d FROM o JOIN m USING (field)), k AS (SELECT field, median(d) AS mad FROM d GROUP BY field),
 c AS (SELECT field, off FROM d JOIN k USING (field) WHERE d < 3 * greatest(mad, 0.05))
 SELECT field, round(CASE WHEN count(*) >= 3 THEN median(off) END, 6) AS zp, round(CASE WHEN count(*) >= 3 THEN stddev_pop(off) / sqrt(count(*)) END, 6) AS zp_err, count(*) AS n_used FROM c GROUP BY field""")
def zeropoint_clip(spark, sf):
    """Clipped zero point of every field."""
    m = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("field"), (25 + F.col("l_discount") * 3 + (F.col("l_quantity") % 7) * 0.02).alias("offset"))
    z = measure.zero_point(m, ("field",))
    return z.select("field", r6("zp").alias("zp"), r6("zp_err").alias("zp_err"), "n_used")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_extendedprice > 0 THEN -2.5 * log10(l_extendedprice) + 25 END, 6) AS mag, round(sqrt(pow(1.0857 * l_quantity / l_extendedprice, 2) + 0.0004), 6) AS mag_err,
 round(-2.5 * log10(5 * l_quantity) + 25, 6) AS limit5, round(pow(10.0, 0.4 * (25 - (24 + l_discount))), 6) AS scale FROM lineitem""")
def mag_limits(spark, sf):
    """Magnitudes, errors, limits and the factor to another zero point."""
    flux, err = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(ph.magnitude(flux, 25.0)).alias("mag"), r6(ph.magnitude_error(flux, err, 0.02)).alias("mag_err"),
        r6(ph.limiting_magnitude(err, 25.0)).alias("limit5"), r6(ph.flux_scale(F.lit(25.0), 24 + F.col("l_discount"))).alias("scale"),
    )


@query("SELECT l_partkey AS target, round(sum(l_extendedprice / (l_quantity * l_quantity)) / sum(1 / (l_quantity * l_quantity)), 4) AS flux, round(1 / sqrt(sum(1 / (l_quantity * l_quantity))), 6) AS flux_err, round(sum(l_extendedprice / (l_quantity * l_quantity)) / sqrt(sum(1 / (l_quantity * l_quantity))), 3) AS snr FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def ivar_combine(spark, sf):
    """Inverse-variance combination per target."""
    a = ph.inverse_variance("l_extendedprice", "l_quantity")
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(a["flux"].alias("flux"), a["flux_err"].alias("flux_err"), a["snr"].alias("snr"))
    return g.select("target", F.round("flux", 4).alias("flux"), r6("flux_err").alias("flux_err"), F.round("snr", 3).alias("snr"))


@query("""WITH p AS (SELECT l_suppkey, l_returnflag AS st, 1 / (l_quantity * l_quantity) AS w, l_extendedprice AS f FROM lineitem), s AS (SELECT * FROM (VALUES ('A', ['A']), ('A+N', ['A', 'N']), ('A+R', ['A', 'R']), ('A+N+R', ['A', 'N', 'R'])) t(subset, members)),
 c AS (SELECT l_suppkey, subset, sum(w * f) AS wf, sum(w) AS w FROM p JOIN s ON list_contains(members, st) GROUP BY ALL)
 SELECT subset, round(median(wf / sqrt(w)), 3) AS median_snr, round(median(1 / sqrt(w)), 6) AS median_err, count(*) AS n FROM c GROUP BY subset""")
def subset_snr(spark, sf):
    """Median combined signal to noise for sets of stations."""
    sets = {"A": ("A",), "A+N": ("A", "N"), "A+R": ("A", "R"), "A+N+R": ("A", "N", "R")}
    s = measure.subset_sums(table(spark, sf, "lineitem"), sets, "l_returnflag", ("l_suppkey",), "l_extendedprice", "l_quantity")
    return s.groupBy("subset").agg(F.round(F.median("snr"), 3).alias("median_snr"), r6(F.median("flux_err")).alias("median_err"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id % 6 AS level, event_type AS station, user_id AS truth, value > 40 AS hit FROM events), e AS (SELECT level, station, count(*) AS n, sum(hit::INT)::BIGINT AS hits FROM r GROUP BY ALL
 UNION ALL SELECT level, 'any', count(*), sum(h::INT)::BIGINT FROM (SELECT level, truth, bool_or(hit) AS h FROM r GROUP BY ALL) GROUP BY level),
 w AS (SELECT *, hits / n AS p, n::DOUBLE AS m FROM e)
 SELECT level, station, n, hits, round(p, 6) AS share, round(greatest((p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m), 0), 6) AS low, round(least((p + 3.8416 / (2 * m)) / (1 + 3.8416 / m) + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m), 1), 6) AS high FROM w""")
def recovery_table(spark, sf):
    """Recovered shares with their intervals, per station and for any station."""
    rows = table(spark, sf, "events").withColumn("level", F.col("event_id") % 6)
    r = measure.recovery(rows, "level", "event_type", "user_id", F.col("value") > 40)
    low, high = ph.wilson("hits", "n")
    return r.select("level", "station", "n", "hits", r6("share").alias("share"), r6(low).alias("low"), r6(high).alias("high"))


@query("""WITH t AS (SELECT event_type AS station, date_trunc('day', ts) AS trial, count(*) AS n, count(*) FILTER (value > 200) AS false_hits FROM events GROUP BY ALL)
 SELECT station, round(avg(false_hits / n), 6) AS mean_rate, round(median(false_hits / n), 6) AS median_rate, round(max(false_hits / n), 6) AS max_rate, count(*) AS trials FROM t GROUP BY station""")
def false_positive_rate(spark, sf):
    """Mean, median and largest false-detection rate per station."""
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("station"), F.date_trunc("day", "ts").alias("trial")).agg((F.sum((F.col("value") > 200).cast("long")) / F.count("*")).alias("rate"))
    return t.groupBy("station").agg(r6(F.avg("rate")).alias("mean_rate"), r6(F.median("rate")).alias("median_rate"), r6(F.max("rate")).alias("max_rate"), F.count("*").alias("trials"))


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type AS station, round(any_value(m), 6) AS median, round(1.4826 * median(abs(value - m)), 6) AS scatter, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY 1""")
def residual_scatter(spark, sf):
    """Median and robust scatter per station."""
    s = measure.robust_scatter(table(spark, sf, "events").select(F.col("event_type").alias("station"), "value"), ("station",), "value")
    return s.select("station", r6("median").alias("median"), r6("scatter").alias("scatter"), "n")


@query("SELECT station, bin, n, round(n / (sum(n) OVER (PARTITION BY station) * (2.0::DOUBLE / 39)), 6) AS density FROM (SELECT station, bin, count(*) AS n FROM (SELECT event_type AS station, floor(((value % 250) / 125 - 1 + 1) / (2.0::DOUBLE / 39))::INT AS bin FROM events) WHERE bin < 39 GROUP BY ALL)")
def residual_hist(spark, sf):
    """Residuals in 39 bins over -1 to 1 as densities."""
    b = table(spark, sf, "events").select(F.col("event_type").alias("station"), F.floor(((F.col("value") % 250) / 125 - 1 + 1) / (2.0 / 39)).cast("int").alias("bin")).where("bin < 39")
    c = b.groupBy("station", "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("station"))
    return c.select("station", "bin", "n", r6(F.col("n") / (total * (2.0 / 39))).alias("density"))


@query(f"""WITH {STARS}, d AS (SELECT field, star_id, ra * 3 AS x, dec * 3 AS y FROM stars), p AS (SELECT field, star_id, ra * 3 - 17.3::DOUBLE AS x, dec * 3 + 8.6::DOUBLE AS y FROM stars),
 q AS (SELECT d.field, d.x - p.x AS ox, d.y - p.y AS oy FROM d JOIN p ON d.field = p.field AND abs(d.x - p.x) < 200 AND abs(d.y - p.y) < 200), v AS (SELECT field, floor(ox / 4.0)::BIGINT AS bx, floor(oy / 4.0)::BIGINT AS by_, count(*) AS votes FROM q GROUP BY ALL),
 b AS (SELECT field, bx, by_, votes FROM v QUALIFY row_number() OVER (PARTITION BY field ORDER BY votes DESC, bx, by_) = 1)
 SELECT q.field, votes, round(median(ox), 4) AS dx, round(median(oy), 4) AS dy, count(*) AS n_near FROM q JOIN b ON q.field = b.field AND abs(ox - (bx + 0.5) * 4.0) <= 4.0 AND abs(oy - (by_ + 0.5) * 4.0) <= 4.0 GROUP BY ALL""")
def shift_vote(spark, sf):
    """The shift between two catalogues of each field by vote."""
    s = stars(spark, sf).select("field", "star_id", (F.col("ra") * 3).alias("x"), (F.col("dec") * 3).alias("y"))
    p = s.select("field", (F.col("x") - 17.3).alias("x"), (F.col("y") + 8.6).alias("y"))
    v = measure.shift_vote(s.select("field", "x", "y"), p, ("field",))
    return v.select("field", "votes", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"), "n_near")


@query("""SELECT user_id AS target, event_type AS band, event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 6) AS hours, round(epoch_us(ts) / 8.64e10 + 40587, 6) AS mjd,
 round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS change FROM events""")
def lightcurve_hours(spark, sf):
    """Hours since a trigger, modified Julian date and change since the point before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hours = ph.hours_since("ts", F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("band"), "event_id", r6(hours).alias("hours"), r6(ph.mjd("ts")).alias("mjd"), r6(F.col("value") - F.lag("value").over(w)).alias("change"))


@query("""SELECT user_id AS target, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS colour, round(sqrt(pow(stddev_pop(value) FILTER (event_type = 'click'), 2) + pow(stddev_pop(value) FILTER (event_type = 'view'), 2)), 6) AS colour_err FROM events GROUP BY 1""")
def colour_index(spark, sf):
    """Difference of two bands per target, errors in quadrature."""
    band = lambda b: F.when(F.col("event_type") == b, F.col("value"))
    a, b = F.stddev_pop(band("click")), F.stddev_pop(band("view"))
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("target")).agg(r6(F.avg(band("click")) - F.avg(band("view"))).alias("colour"), r6(F.sqrt(a * a + b * b)).alias("colour_err"))


@query("SELECT user_id % 10 AS case_id, round(median(value) FILTER (event_id % 2 = 0), 6) AS ours, round(median(value) FILTER (event_id % 2 = 1), 6) AS theirs, round(median(value) FILTER (event_id % 2 = 1) / median(value) FILTER (event_id % 2 = 0), 6) AS speed_up FROM events GROUP BY 1")
def bench_speedup(spark, sf):
    """Median times of two tools and their ratio."""
    t = table(spark, sf, "events").select((F.col("user_id") % 10).alias("case_id"), F.when(F.col("event_id") % 2 == 0, "ours").otherwise("theirs").alias("tool"), "value")
    p = t.groupBy("case_id").pivot("tool", ["ours", "theirs"]).agg(F.median("value"))
    return p.select("case_id", r6("ours").alias("ours"), r6("theirs").alias("theirs"), r6(F.col("theirs") / F.col("ours")).alias("speed_up"))


@query("SELECT event_type AS case_id, count(*) AS n, round(min(value), 6) AS best, round(max(value), 6) AS faintest, round(median(value), 6) AS median, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def lightcurve_summary(spark, sf):
    """Ranges and medians per case."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("case_id")).agg(F.count("*").alias("n"), r6(F.min("value")).alias("best"), r6(F.max("value")).alias("faintest"), r6(F.median("value")).alias("median"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT round(median(value), 6) AS lookup_ms, round(median(value * 2), 6) AS photometry_ms, round(median(value) + median(value * 2), 6) AS total_ms, count(*) AS runs FROM events")
def latency_medians(spark, sf):
    """Median latencies of two steps and their sum."""
    a, b = F.median("value"), F.median(F.col("value") * 2)
    return table(spark, sf, "events").agg(r6(a).alias("lookup_ms"), r6(b).alias("photometry_ms"), r6(a + b).alias("total_ms"), F.count("*").alias("runs"))


@query("SELECT count(*) AS total, count(*) FILTER (value > 10) AS generated, count(*) FILTER (value BETWEEN 1 AND 10) AS skipped, count(*) FILTER (value < 1) AS failed FROM events")
def run_counters(spark, sf):
    """Counters of a run."""
    v = F.col("value")
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count(F.when(v > 10, 1)).alias("generated"), F.count(F.when(v.between(1, 10), 1)).alias("skipped"), F.count(F.when(v < 1, 1)).alias("failed"))


@query("SELECT user_id, snr, round((snr * snr + sqrt(pow(snr, 4) + 4 * snr * snr * v)) / 2, 5) AS flux FROM (SELECT user_id, unnest([3, 5, 7, 10, 20, 50]) AS snr, var_pop(value) AS v FROM events GROUP BY user_id)")
def snr_flux(spark, sf):
    """Fluxes that reach given signal to noise over each target's background."""
    v = table(spark, sf, "events").groupBy("user_id").agg(F.var_pop("value").alias("v")).withColumn("snr", F.explode(F.array(*map(F.lit, (3, 5, 7, 10, 20, 50)))))
    return v.select("user_id", "snr", F.round(ph.flux_for_snr("snr", "v"), 5).alias("flux"))


@query("SELECT station, day, sum(n)::BIGINT AS n, sum(value_sum) AS value_sum FROM (SELECT o_orderpriority AS station, date_trunc('day', o_orderdate) AS day, count(*) AS n, NULL::DOUBLE AS value_sum FROM orders GROUP BY ALL UNION ALL SELECT event_type, date_trunc('day', ts), count(*), round(sum(value), 3) FROM events GROUP BY ALL) GROUP BY ALL")
def union_inventory(spark, sf):
    """Two inventories with different columns as one table."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("station"), F.date_trunc("day", "o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("station"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value_sum"))
    return o.unionByName(e, allowMissingColumns=True).groupBy("station", "day").agg(F.sum("n").alias("n"), F.sum("value_sum").alias("value_sum"))


@query("SELECT date_trunc('day', ts) AS night, event_type, count(*) AS n FROM events GROUP BY ALL")
def night_windows(spark, sf):
    """Rows per night and kind by a tumbling window."""
    return ingest.nights(table(spark, sf, "events"), "ts", ("event_type",))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_bursts(spark, sf):
    """Bursts of rows that follow each other within half an hour."""
    return ingest.bursts(table(spark, sf, "events"), "ts", ("user_id",)).select("user_id", "start", "stop", "n")
