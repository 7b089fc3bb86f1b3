"""Catalogues of stars laid out by cell: cones around positions, and reference stars of a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as hp
from ..functions.plan import fenced
from .polygons import disc_cells, disc_ranges

# The catalogue's band for a filter's name, the window of magnitudes, and the errors of stars without one.
BANDS = {"g": "g", "r": "r", "i": "i", "z": "z", "y": "y", "G": "g", "R": "r", "I": "i", "B": "g", "V": "r"}
BRIGHT, FAINT = 14.0, 20.0
UNKNOWN_ERROR, NO_ERRORS = 0.05, 0.01


def write_by_cell(stars: DataFrame, path: str, order: int, mode: str = "errorifexists") -> None:
    """Write `stars` (ra, dec, ...) as Parquet with the cell `npix` of each, sorted by it, in ranges of cells.

    Row groups then hold narrow ranges of cells, which filters on `npix` skip.
    """
    hp.with_cell(stars, order).repartitionByRange("npix").sortWithinPartitions("npix").write.mode(mode).parquet(path)


def read_by_cell(spark: SparkSession, path: str) -> DataFrame:
    """A table that `write_by_cell` wrote."""
    return spark.read.parquet(path)


def cone(stars: DataFrame, ra: float, dec: float, radius: float, order: int) -> DataFrame:
    """The rows of `stars` (ra, dec, npix of `order`) within `radius` degrees of a position, with `separation`.

    The disc's ranges of cells go to the scan as a filter; the exact test follows. Rows with a null position are in no cone.
    """
    ranges = disc_ranges(ra, dec, radius, order)
    near = F.lit(False)
    for first, last in ranges:
        near = near | F.col("npix").between(first, last)
    return stars.where(near).withColumn("separation", hp.separation("ra", "dec", F.lit(float(ra)), F.lit(float(dec)))).where(F.col("separation") <= radius)


def cones(positions: DataFrame, stars: DataFrame, radius: str | float, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a position and a star within `radius` degrees (a number or a column of `positions`), with `separation`.

    `positions` and `stars` have ra and dec; the star's are named star_ra and star_dec in the result. An equi-join on the
    cells that the discs meet, then the exact test: each pair comes once, as a star lies in one cell. Pairs must agree in the columns
    `by`. Directions are taken before the join, and angles only of pairs whose chord is short enough.
    """
    within = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    p, q = ([f"_{side}{k}" for k in range(3)] for side in "pq")
    far = 2 * F.sin(F.radians(F.least(F.col("_within"), F.lit(180.0))) / 2) * (1 + 1e-9) + 1e-12
    at = fenced(positions.withColumn("_within", within.cast("double")), dict(zip(p, hp.unit_vector("ra", "dec"), strict=True)) | {"_far": far})
    around = disc_cells(at, order, "_within")
    placed = fenced(hp.with_cell(stars, order, out="_cell"), dict(zip(q, hp.unit_vector("ra", "dec"), strict=True))).withColumnsRenamed({"ra": "star_ra", "dec": "star_dec", "_cell": "npix"})
    chord = F.sqrt(sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(p, q, strict=True)), F.lit(0.0)))
    near = around.join(placed, ["npix", *by]).withColumn("_chord", chord).where("_chord <= _far")
    pairs = near.withColumn("separation", F.degrees(2 * F.asin(F.least(F.col("_chord") / 2, F.lit(1.0)))))
    return pairs.where(F.col("separation") <= F.col("_within")).drop("_within", "_far", "_chord", "npix", *p, *q)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def reference_stars(stars: DataFrame, band: str | Column, window: tuple[float, float] = (BRIGHT, FAINT), suffix: str = "mag") -> DataFrame:
    """`stars` with `mag` and `mag_err` of a band, where the magnitude is finite and inside the window.

    Magnitudes are in the columns <band><suffix>, errors in e_<band><suffix>. `band` is a filter's name or a column of
    such names; B and V take the nearest band, unknown names give no rows. An error that is missing, not finite or not positive is
    UNKNOWN_ERROR; a catalogue without a column of errors for the band has NO_ERRORS.
    """
    name = F.lit(band) if isinstance(band, str) else band
    letter = F.element_at(F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair]), name) if not isinstance(band, str) else F.lit(BANDS.get(band))
    mag, err = F.lit(None).cast("double"), F.lit(None).cast("double")
    for b in sorted(set(BANDS.values())):
        if f"{b}{suffix}" in stars.columns:
            e = F.col(f"e_{b}{suffix}").cast("double") if f"e_{b}{suffix}" in stars.columns else None
            known = F.lit(NO_ERRORS) if e is None else F.when(_finite(e) & (e > 0), e).otherwise(F.lit(UNKNOWN_ERROR))
            mag, err = F.when(letter == b, F.col(f"{b}{suffix}").cast("double")).otherwise(mag), F.when(letter == b, known).otherwise(err)
    return stars.withColumns({"mag": mag, "mag_err": err}).where(_finite(F.col("mag")) & F.col("mag").between(*window))


def letter_of(band: Column) -> Column:
    """The catalogue's band for a filter's name; null for unknown names."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in BANDS.items() for x in pair]), band)


def by_band(stars: DataFrame, window: tuple[float, float] = (BRIGHT, FAINT), suffix: str = "mag") -> DataFrame:
    """`stars` once for every band of the catalogue in which `reference_stars` takes them, with `letter`, `mag` and `mag_err`."""
    letters = [b for b in sorted(set(BANDS.values())) if f"{b}{suffix}" in stars.columns]
    rows = stars.withColumn("letter", F.explode(F.array(*map(F.lit, letters)).cast("array<string>")))
    return reference_stars(rows, F.col("letter"), window, suffix)
