"""The hierarchical equal-area grid (nested numbering) as Column expressions.

Everything here is built from Spark functions, so the optimiser folds, prunes and compiles it like any other
expression. Orders up to 24 are supported: bit interleaving uses 64-bit masks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plan import fenced

MAX_ORDER = 24
# Ring and longitude offsets of the twelve base cells.
JRLL = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
JPLL = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
# Byte tables, made by rule: bit k of the index goes to bit 2k, and even bits of the index close up.
SPREAD = [sum((i >> k & 1) << 2 * k for k in range(8)) for i in range(256)]
COMPRESS = [sum((i >> 2 * k & 1) << k for k in range(4)) for i in range(256)]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def nside(order: int) -> int:
    """Cells along a base cell's side."""
    return 1 << order


def npix(order: int) -> int:
    """Cells of the whole sky."""
    return 12 << 2 * order


def _byte_table(table: list[int], x: Column, byte: int) -> Column:
    """The table's entry for one byte of x. The table folds into one literal, so the expression stays small."""
    return F.element_at(F.array(*map(F.lit, table)).cast("array<long>"), (F.shiftright(x, 8 * byte).bitwiseAND(255) + 1).cast("int"))


def spread_bits(c, bits: int = MAX_ORDER) -> Column:
    """Bit k of the number moves to bit 2k."""
    x = _col(c).cast("long")
    return sum((F.shiftleft(_byte_table(SPREAD, x, k), 16 * k) for k in range(1, -(-bits // 8))), _byte_table(SPREAD, x, 0))


def compress_bits(c, bits: int = MAX_ORDER) -> Column:
    """Bit 2k of the number moves to bit k; odd bits are dropped."""
    x = _col(c).cast("long")
    return sum((F.shiftleft(_byte_table(COMPRESS, x, k), 4 * k) for k in range(1, -(-bits // 4))), _byte_table(COMPRESS, x, 0))


def with_cell(df: DataFrame, order: int, ra: str = "ra", dec: str = "dec", out: str = "npix") -> DataFrame:
    """`df` with the cell of each position in degrees; null for null positions and declinations outside -90..90.

    The steps are columns of their own, so each is computed once and the compiled code stays small.
    """
    n = nside(order)
    z, tt, jp, jm, q, p, m, fp, fm, face, x, y = (f"_hp_{k}" for k in ("z", "tt", "jp", "jm", "q", "p", "m", "fp", "fm", "face", "x", "y"))
    turn = F.col(ra) / 90.0
    steps = (
        {z: F.sin(F.radians(F.col(dec))), tt: turn - F.floor(turn / 4.0) * 4.0},
        {jp: F.floor(n * (0.5 + F.col(tt)) - n * (F.col(z) * 0.75)), jm: F.floor(n * (0.5 + F.col(tt)) + n * (F.col(z) * 0.75)), q: F.least(F.floor(tt), F.lit(3))},
        {p: F.sqrt(F.greatest(3.0 * (1.0 - F.abs(z)), F.lit(0.0))) * n},
        {
            m: F.least(F.floor((1.0 - (F.col(tt) - F.col(q))) * F.col(p)), F.lit(n - 1)), p: F.least(F.floor((F.col(tt) - F.col(q)) * F.col(p)), F.lit(n - 1)),
            fp: F.shiftright(jp, order), fm: F.shiftright(jm, order),
        },
        {
            face: _by_zone(z, F.when(F.col(fp) == F.col(fm), F.col(fp).bitwiseAND(3) + 4).when(F.col(fp) < F.col(fm), F.col(fp)).otherwise(F.col(fm) + 8), F.col(q), F.col(q) + 8),
            x: _by_zone(z, F.col(jm).bitwiseAND(n - 1), n - 1 - F.col(m), F.col(p)),
            y: _by_zone(z, n - 1 - F.col(jp).bitwiseAND(n - 1), n - 1 - F.col(p), F.col(m)),
        },
    )
    for step in steps:
        df = df.withColumns(step)
    cell = F.when(F.col(dec).between(-90, 90), (F.col(face) * (n * n) + spread_bits(x, order) + spread_bits(y, order) * 2).cast("long"))
    return fenced(df, {out: cell}, drop=(z, tt, jp, jm, q, p, m, fp, fm, face, x, y))


def _by_zone(z: str, equator: Column, north: Column, south: Column) -> Column:
    return F.when(F.abs(z) <= 2.0 / 3.0, equator).when(F.col(z) > 0, north).otherwise(south)


def face_xy(pix, order: int) -> tuple[Column, Column, Column]:
    """Base cell and position within it."""
    pix = _col(pix)
    inside = pix.bitwiseAND((1 << 2 * order) - 1)
    return F.shiftright(pix, 2 * order), compress_bits(inside, order), compress_bits(F.shiftright(inside, 1), order)


def with_centre(df: DataFrame, order: int, pix: str = "npix", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """`df` with the centre of each cell in degrees; null for numbers outside the grid."""
    n = nside(order)
    f, x, y, jr, nr, shift, jp = (f"_hp_{k}" for k in ("f", "x", "y", "jr", "nr", "shift", "jp"))
    cell = F.when(is_valid(pix, order), F.col(pix))
    face, fx, fy = face_xy(cell, order)
    polar = (F.col(jr) < n) | (F.col(jr) > 3 * n)
    z = F.when(F.col(jr) < n, 1.0 - F.col(nr) * F.col(nr) / (3.0 * n * n)).when(F.col(jr) > 3 * n, F.col(nr) * F.col(nr) / (3.0 * n * n) - 1.0).otherwise((2 * n - F.col(jr)) * 2.0 / (3.0 * n))
    at = F.when(F.col(jp) > 4 * n, F.col(jp) - 4 * n).when(F.col(jp) < 1, F.col(jp) + 4 * n).otherwise(F.col(jp))
    steps = (
        {f: face, x: fx, y: fy},
        {jr: F.element_at(F.array(*map(F.lit, JRLL)), (F.col(f) + 1).cast("int")) * n - F.col(x) - F.col(y) - 1},
        {nr: F.when(F.col(jr) < n, F.col(jr)).when(F.col(jr) > 3 * n, 4 * n - F.col(jr)).otherwise(n), shift: F.when(polar, 0).otherwise((F.col(jr) - n).bitwiseAND(1))},
        {jp: F.floor((F.element_at(F.array(*map(F.lit, JPLL)), (F.col(f) + 1).cast("int")) * F.col(nr) + F.col(x) - F.col(y) + 1 + F.col(shift)) / 2)},
    )
    for step in steps:
        df = df.withColumns(step)
    return fenced(df, {ra: (at - (F.col(shift) + 1) * 0.5) * (90.0 / F.col(nr)), dec: F.degrees(F.asin(z))}, drop=(f, x, y, jr, nr, shift, jp))


def is_valid(pix, order: int) -> Column:
    """Whether a cell number exists at an order."""
    return _col(pix).between(0, npix(order) - 1)


def parent(pix, levels: int = 1) -> Column:
    """The cell's ancestor some orders up."""
    return F.shiftright(_col(pix), 2 * levels)


def pixel_size(order: int) -> float:
    """Side of a cell in degrees."""
    return math.degrees(math.sqrt(4 * math.pi / npix(order)))


def tile_dir(pix) -> Column:
    """Directory number of a tile: its number down to ten thousands."""
    return F.floor(_col(pix) / 10000).cast("long") * 10000


def tile_path(order, pix) -> Column:
    """Relative path of a tile's file."""
    pix = _col(pix)
    return F.concat(F.lit("Norder"), _col(order).cast("string"), F.lit("/Dir"), tile_dir(pix).cast("string"), F.lit("/Npix"), pix.cast("string"), F.lit(".fits"))


def xy2hpx(x, y, width: int) -> Column:
    """Offset, in nested order, of a tile's pixel: quadrants from left to right, second half of the rows first."""
    bits = max(1, (width - 1).bit_length())
    return spread_bits(x, bits) * 2 + spread_bits(F.lit(width - 1) - _col(y), bits)


def hpx2xy(offset, width: int) -> tuple[Column, Column]:
    """The inverse of xy2hpx."""
    offset = _col(offset)
    bits = max(1, (width - 1).bit_length())
    return compress_bits(F.shiftright(offset, 1), bits), F.lit(width - 1) - compress_bits(offset, bits)


def unit_vector(ra, dec) -> tuple[Column, Column, Column]:
    """Cartesian direction of a position in degrees."""
    a, d = F.radians(_col(ra)), F.radians(_col(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def separation(ra, dec, other_ra, other_dec) -> Column:
    """Angle between two positions, in degrees, from the chord between their directions: exact for small angles."""
    chord = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(unit_vector(ra, dec), unit_vector(other_ra, other_dec), strict=True)), F.lit(0.0)))
    return F.degrees(2 * F.asin(F.least(chord / 2, F.lit(1.0))))


def with_neighbours(df: DataFrame, order: int, pix: str = "npix", out: str = "neighbour") -> DataFrame:
    """One row per row of `df` and cell that shares a side or a corner with `pix`: eight for most cells, seven or six for some.

    Each corner is circled closely, in steps of an eighth of a turn; the cells met there are the neighbours, so the seams between
    base cells need no rules. Orders up to 20.
    """
    inner = min(6, MAX_ORDER - order)  # a corner is the centre of the cell `inner` orders down that lies in it
    last = (1 << 2 * inner) - 1
    corners = (0, last // 3, last // 3 * 2, last)
    rows = df.where(is_valid(pix, order)).withColumn("_nb_at", F.explode(F.array(*[F.col(pix) * (1 << 2 * inner) + k for k in corners])))
    rows = with_centre(with_centre(rows, order, pix, "_nb_ra", "_nb_dec"), order + inner, "_nb_at", "_nb_ra2", "_nb_dec2")
    c, p = unit_vector("_nb_ra", "_nb_dec"), unit_vector("_nb_ra2", "_nb_dec2")
    rows = fenced(rows, {f"_nb_{k}{i}": v for i in range(3) for k, v in (("p", p[i]), ("r", p[i] - c[i]))}, drop=("_nb_at", "_nb_ra", "_nb_dec", "_nb_ra2", "_nb_dec2"))
    turns = F.array(*[F.struct(F.lit(0.1 * math.cos(k * math.pi / 4)).alias("c"), F.lit(0.1 * math.sin(k * math.pi / 4)).alias("s")) for k in range(-3, 4)])
    rows = rows.withColumn("_nb_t", F.explode(turns))
    at = lambda k, i: F.col(f"_nb_{k}{i}")
    across = [at("p", (i + 1) % 3) * at("r", (i + 2) % 3) - at("p", (i + 2) % 3) * at("r", (i + 1) % 3) for i in range(3)]
    v = [at("p", i) + F.col("_nb_t.c") * at("r", i) + F.col("_nb_t.s") * across[i] for i in range(3)]
    rows = fenced(rows.select(*df.columns, *[e.alias(f"_nb_v{i}") for i, e in enumerate(v)]), {
        "_nb_ra": F.degrees(F.atan2(F.col("_nb_v1"), F.col("_nb_v0"))), "_nb_dec": F.degrees(F.atan2(F.col("_nb_v2"), F.sqrt(F.col("_nb_v0") * F.col("_nb_v0") + F.col("_nb_v1") * F.col("_nb_v1")))),
    })
    found = with_cell(rows, order, "_nb_ra", "_nb_dec", out).select(*df.columns, out)
    return found.where(F.col(out) != F.col(pix)).distinct()


def to_galactic(ra, dec) -> tuple[Column, Column]:
    """Galactic longitude and latitude of an ICRS position, in degrees."""
    # Pole and node of the galactic frame.
    pole_ra, pole_dec, node = 192.85948, 27.12825, 122.93192
    a, d, p = F.radians(_col(ra) - pole_ra), F.radians(_col(dec)), math.radians(pole_dec)
    b = F.asin(F.sin(d) * math.sin(p) + F.cos(d) * math.cos(p) * F.cos(a))
    y, x = F.cos(d) * F.sin(a), F.sin(d) * math.cos(p) - F.cos(d) * math.sin(p) * F.cos(a)
    lon = F.lit(node) - F.degrees(F.atan2(y, x))
    return lon - F.floor(lon / 360.0) * 360.0, F.degrees(b)
