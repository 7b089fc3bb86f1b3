"""World coordinates of images (tangent projection) as Column expressions. Pixel coordinates start at 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .healpix import _col


def cd_matrix(cd1_1, cd1_2, cd2_1, cd2_2, cdelt1, cdelt2, crota2) -> tuple[Column, ...]:
    """The CD matrix: as given, or, where it is missing or zero, from CDELT and CROTA2."""
    given = [F.coalesce(_col(c), F.lit(0.0)) for c in (cd1_1, cd1_2, cd2_1, cd2_2)]
    d1, d2 = (F.coalesce(_col(c), F.lit(0.0)) for c in (cdelt1, cdelt2))
    turn = F.radians(F.coalesce(_col(crota2), F.lit(0.0)))
    made = (d1 * F.cos(turn), -d2 * F.sin(turn), d1 * F.sin(turn), d2 * F.cos(turn))
    missing = (given[0] == 0) & (given[1] == 0) & (given[2] == 0) & (given[3] == 0)
    return tuple(F.when(missing, m).otherwise(g) for g, m in zip(given, made, strict=True))


def has_wcs(width, height, cd1_1, cd1_2, cd2_1, cd2_2) -> Column:
    """Whether an image has a size and a CD matrix."""
    return (_col(width) > 0) & (_col(height) > 0) & ((_col(cd1_1) != 0) | (_col(cd1_2) != 0) | (_col(cd2_1) != 0) | (_col(cd2_2) != 0))


def sky2pix(ra, dec, w: dict[str, Column]) -> tuple[Column, Column]:
    """Pixel position of a sky position; null behind the tangent plane or for a singular CD matrix.

    `w` has the columns crval1, crval2, crpix1, crpix2, cd1_1, cd1_2, cd2_1, cd2_2.
    """
    a = F.radians(_col(ra) - w["crval1"])
    d, d0 = F.radians(_col(dec)), F.radians(w["crval2"])
    facing = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    ok = facing > 1e-10
    xi = F.degrees(F.try_divide(F.cos(d) * F.sin(a), facing))
    eta = F.degrees(F.try_divide(F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a), facing))
    det = w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"]
    x = F.try_divide(w["cd2_2"] * xi - w["cd1_2"] * eta, det) + w["crpix1"] - 1
    y = F.try_divide(w["cd1_1"] * eta - w["cd2_1"] * xi, det) + w["crpix2"] - 1
    return F.when(ok, x), F.when(ok, y)


def pix2sky(x, y, w: dict[str, Column]) -> tuple[Column, Column]:
    """Sky position, in degrees, of a pixel position."""
    u, v = _col(x) + 1 - w["crpix1"], _col(y) + 1 - w["crpix2"]
    xi = F.radians(w["cd1_1"] * u + w["cd1_2"] * v)
    eta = F.radians(w["cd2_1"] * u + w["cd2_2"] * v)
    d0 = F.radians(w["crval2"])
    ahead = F.cos(d0) - eta * F.sin(d0)
    ra = w["crval1"] + F.degrees(F.atan2(xi, ahead))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + ahead * ahead)))
    return ra - F.floor(ra / 360.0) * 360.0, dec


def wcs_of(prefix: str = "") -> dict[str, Column]:
    """The WCS columns of a frame table."""
    return {k: F.col(prefix + k) for k in ("crval1", "crval2", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2")}


def inside(x, y, width, height, margin: float = 0.0) -> Column:
    """Whether a pixel position lies in [margin, size - margin)."""
    x, y = _col(x), _col(y)
    return (x >= margin) & (y >= margin) & (x < _col(width) - margin) & (y < _col(height) - margin)


def pixel_scale(w: dict[str, Column]) -> Column:
    """Arcseconds per pixel: the mean length of the CD matrix's columns; null unless 0 < degrees < 1."""
    first = F.sqrt(w["cd1_1"] * w["cd1_1"] + w["cd2_1"] * w["cd2_1"])
    second = F.sqrt(w["cd1_2"] * w["cd1_2"] + w["cd2_2"] * w["cd2_2"])
    mean = (first + second) / 2
    return F.when((mean > 0) & (mean < 1), mean * 3600)


def recommended_order(scale, tile_width: int = 512) -> Column:
    """The tile order whose pixels are as fine as `scale` arcseconds, between 0 and 15."""
    # Fixed value: arcseconds that a base cell's side spans in the order formula.
    span = 374400.0
    return F.greatest(F.least(F.ceil(F.log2(span / (_col(scale) * tile_width))), F.lit(15)), F.lit(0)).cast("int")


def order_by_size(side) -> Column:
    """The tile order that an image of this many pixels a side is built at by default."""
    side = _col(side)
    return F.when(side < 2048, 5).when(side < 4096, 6).when(side < 8192, 7).otherwise(8)


def shifted(frames: DataFrame, shifts: DataFrame, key: str = "image_id") -> DataFrame:
    """Frames with crpix moved by their key's dx and dy; those without a shift stay as they are."""
    moves = shifts.select(key, F.col("dx").alias("_dx"), F.col("dy").alias("_dy"))
    moved = frames.join(moves, key, "left").withColumns({"crpix1": F.col("crpix1") + F.coalesce("_dx", F.lit(0.0)), "crpix2": F.col("crpix2") + F.coalesce("_dy", F.lit(0.0))})
    return moved.select(*frames.columns)
