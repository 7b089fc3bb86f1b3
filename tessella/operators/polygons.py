"""Which cells a frame's footprint meets: a descent through the grid, from the base cells to the order asked for.

At every level a cell stays if its circle meets the frame's; at the last one its outline, drawn in the frame's own
pixel plane where the frame is a rectangle, is tested against that rectangle. The descent runs level by level over arrays
of (frame, cell) inside a map over Arrow batches, a bounded number of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import healpix as hp
from ..functions import wcs

WCS = ("width", "height", "crval1", "crval2", "crpix1", "crpix2", "cd1_1", "cd1_2", "cd2_1", "cd2_2")
CUT = ("x0", "y0", "w", "h")
POINTS_PER_SIDE = 8
#: Of a cell's side: how far its outline is from the chords between POINTS_PER_SIDE points, and its corners from its centre, at most.
SAGITTA, RADIUS = 0.003, 1.05
#: Pixels around the frame's outline that count as part of it, so that positions up to `width` and `height` are covered.
MARGIN = 0.5
#: Below this order cells are too wide for the pixel plane; they are ancestors of cells of this order.
FLAT_ORDER = 4
#: Pairs of a frame and a cell at a time: each holds some twenty arrays of 32 numbers for the outline's points.
PAIRS = 24_000
#: Up to this order a process keeps the centres, or the outlines, of all cells once they are computed (5 and 38 MB).
CENTRES_KEPT, OUTLINES_KEPT = 7, 6
#: Pixels beyond a cell's outline that its box holds, for interpolation; bytes of cut pixels in a batch.
BORDER = 2
BYTES_PER_BATCH = 8 << 20


def compress(v: np.ndarray, bits: int = hp.MAX_ORDER) -> np.ndarray:
    """Bit 2k of each number moves to bit k, for `bits` of them."""
    out = np.zeros_like(v)
    for k in range(bits):
        out |= (v >> 2 * k & 1) << k
    return out


def direction(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of places in base cells; x and y run from 0 to 1, borders included."""
    ring = np.array(hp.JRLL)[face] - x - y
    side = np.where(ring < 1, ring, np.where(ring > 3, 4 - ring, 1.0))
    cap = side * side / 3
    z = np.where(ring < 1, 1 - cap, np.where(ring > 3, cap - 1, (2 - ring) * 2 / 3))
    away = np.where((ring < 1) | (ring > 3), np.sqrt(cap * (2 - cap)), np.sqrt(np.maximum(1 - z * z, 0)))
    turn = np.pi / 4 * (np.array(hp.JPLL)[face] + (x - y) / np.maximum(side, 1e-300)) * (side > 0)
    return np.stack([away * np.cos(turn), away * np.sin(turn), z], -1)


def outline(pix: np.ndarray, order: int, per_side: int = POINTS_PER_SIDE) -> np.ndarray:
    """Unit vectors of 4 x per_side points along the outline of each cell."""
    n, g = 1 << order, np.arange(per_side) / per_side
    u, v = np.r_[g, np.ones(per_side), 1 - g, np.zeros(per_side)], np.r_[np.zeros(per_side), g, np.ones(per_side), 1 - g]
    inside = pix & (n * n - 1)
    return direction((pix >> 2 * order)[:, None], (compress(inside, order)[:, None] + u) / n, (compress(inside >> 1, order)[:, None] + v) / n)


def centre(pix: np.ndarray, order: int) -> np.ndarray:
    """Unit vectors of the cells' centres."""
    n, inside = 1 << order, pix & ((1 << 2 * order) - 1)
    return direction(pix >> 2 * order, (compress(inside, order) + 0.5) / n, (compress(inside >> 1, order) + 0.5) / n)


@lru_cache(maxsize=None)
def _all_centres(order: int) -> np.ndarray:
    return centre(np.arange(hp.npix(order)), order)


def centres(pix: np.ndarray, order: int) -> np.ndarray:
    """As `centre`; those of low orders are computed once."""
    return _all_centres(order)[pix] if order <= CENTRES_KEPT else centre(pix, order)


@lru_cache(maxsize=1)
def _all_outlines(order: int) -> tuple[np.ndarray, np.ndarray]:
    points, reach = zip(*(_outlines(np.arange(k, min(k + 4096, hp.npix(order))), order) for k in range(0, hp.npix(order), 4096)), strict=True)
    return np.concatenate(points, axis=1), np.concatenate(reach)


def _outlines(pix: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    p = outline(pix, order)
    far = np.sqrt(((p - centre(pix, order)[:, None, :]) ** 2).sum(-1)).max(axis=1)
    return np.ascontiguousarray(np.moveaxis(p, -1, 0)), 2 * np.arcsin(np.minimum(far / 2, 1))


def outlines(pix: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Outlines by component (3, cells, points) and how far, in radians, their points are from the cell's centre at most."""
    if order <= OUTLINES_KEPT:
        points, reach = _all_outlines(order)
        return points[:, pix], reach[pix]
    own, at = np.unique(pix, return_inverse=True)
    points, reach = _outlines(own, order)
    return points[:, at], reach[at]


def descend(middle: np.ndarray, radius: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cells of `order` whose circles meet the circles around `middle` (unit vectors) of `radius` (radians)."""
    at, pix = np.repeat(np.arange(len(middle)), 12), np.tile(np.arange(12), len(middle))
    for level in range(order + 1):
        if level:
            at, pix = np.repeat(at, 4), (np.repeat(pix, 4) << 2) + np.tile(np.arange(4), len(pix))
        reach = np.minimum(radius[at] + RADIUS * np.radians(hp.pixel_size(level)), np.pi)
        off = centres(pix, level) - middle[at]
        near = np.sqrt(np.einsum("ij,ij->i", off, off)) <= 2 * np.sin(reach / 2) + 1e-12
        at, pix = at[near], pix[near]
    return at, pix


def _tangent(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tangent point of each frame and the directions of growing right ascension and declination there."""
    a, d = np.radians(w["crval1"]), np.radians(w["crval2"])
    zero = np.zeros_like(a)
    return (
        np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1), np.stack([-np.sin(a), np.cos(a), zero], -1),
        np.stack([-np.sin(d) * np.cos(a), -np.sin(d) * np.sin(a), np.cos(d)], -1),
    )


def _circles(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Middle and radius of the circle around each frame with its margin."""
    t, e, n = _tangent(w)

    def place(x, y):
        u, v = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
        xi, eta = np.radians(w["cd1_1"] * u + w["cd1_2"] * v), np.radians(w["cd2_1"] * u + w["cd2_2"] * v)
        p = t + xi[:, None] * e + eta[:, None] * n
        return p / np.linalg.norm(p, axis=1, keepdims=True)

    low, right, top = -0.5 - MARGIN, w["width"] - 0.5 + MARGIN, w["height"] - 0.5 + MARGIN
    middle = place((w["width"] - 1) / 2, (w["height"] - 1) / 2)
    corners = [place(x, y) for x, y in ((low, low), (right, low), (right, top), (low, top))]
    chord = np.max([np.linalg.norm(c - middle, axis=1) for c in corners], axis=0)
    return middle, 2 * np.arcsin(np.minimum(chord / 2, 1))


def _slack(w: dict[str, np.ndarray], middle: np.ndarray, radius: np.ndarray, order: int) -> np.ndarray:
    """Pixels around each frame that count as part of it: the margin, and how far a cell's outline may be from its chords."""
    off = 2 * np.arcsin(np.minimum(np.linalg.norm(middle - _tangent(w)[0], axis=1) / 2, 1)) + radius + 2 * RADIUS * np.radians(hp.pixel_size(order))
    per_degree = np.sqrt(sum(w[c] ** 2 for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2"))) / np.abs(w["cd1_1"] * w["cd2_2"] - w["cd1_2"] * w["cd2_1"])
    # The farther from the tangent point, the more pixels to a degree.
    return MARGIN + SAGITTA * hp.pixel_size(order) * per_degree / np.cos(np.minimum(off, 1.5)) ** 2


def meets(x: np.ndarray, y: np.ndarray, low: np.ndarray, right: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Whether closed outlines, a row each, meet the rectangles from (low, low) to (right, top), insides included."""
    out = ((x >= low[:, None]) & (x <= right[:, None]) & (y >= low[:, None]) & (y <= top[:, None])).any(axis=1)
    # Neither a corner within the rectangle nor boxes apart: the sides decide.
    open_ = np.flatnonzero(~(out | (x.max(axis=1) < low) | (x.min(axis=1) > right) | (y.max(axis=1) < low) | (y.min(axis=1) > top)))
    x, y, low, right, top = x[open_], y[open_], low[open_], right[open_], top[open_]
    px, py = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        a, b, c, d = (low[:, None] - x) / (px - x), (right[:, None] - x) / (px - x), (low[:, None] - y) / (py - y), (top[:, None] - y) / (py - y)
        enter = np.fmax(np.fmax(np.fmin(a, b), np.fmin(c, d)), 0)
        leave = np.fmin(np.fmin(np.fmax(a, b), np.fmax(c, d)), 1)
        crossed = (enter <= leave).any(axis=1)
        # No side meets the rectangle: it lies within the outline, or outside.
        mx, my = ((low + right) / 2)[:, None], ((low + top) / 2)[:, None]
        within = (((y > my) != (py > my)) & (mx < x + (my - y) / (py - y) * (px - x))).sum(axis=1) % 2 == 1
    out[open_] = crossed | within
    return out


def covered(w: dict[str, np.ndarray], order: int, boxes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Index of the frame, cell and, if asked for, box for every cell that a footprint meets, each once; `w` has the arrays of WCS.

    A box (x0, y0, x1, y1, ends included) holds the frame's pixels within the cell and those next to them.
    """
    fine = max(order, FLAT_ORDER)
    middle, radius = _circles(w)
    at, pix = descend(middle, radius, fine)
    held, whole = np.zeros(len(at), bool), np.zeros((len(at) if boxes else 0, 4))
    tangent, slack = _tangent(w), _slack(w, middle, radius, fine)
    for k in range(0, len(at), PAIRS):
        part = slice(k, k + PAIRS)
        held[part] = _held({c: v[at[part]] for c, v in w.items()}, [v[at[part]] for v in (*tangent, middle, radius, slack)], pix[part], fine, whole[part] if boxes else None)
    at, pix = at[held], pix[held] >> 2 * (fine - order)
    if not boxes:
        if fine > order and len(at):
            at, pix = np.divmod(np.unique(at * hp.npix(order) + pix), hp.npix(order))
        return at, pix, None
    parts = whole[held].astype(np.int64)
    if fine > order and len(at):
        both, group = np.unique(np.stack([at, pix]), axis=1, return_inverse=True)
        merged = np.empty((both.shape[1], 4), np.int64)
        merged[:, :2], merged[:, 2:] = np.iinfo(np.int64).max, -1
        np.minimum.at(merged[:, :2], group.ravel(), parts[:, :2])
        np.maximum.at(merged[:, 2:], group.ravel(), parts[:, 2:])
        at, pix, parts = both[0], both[1], merged
    return at, pix, parts


def _held(f: dict[str, np.ndarray], about: list[np.ndarray], pix: np.ndarray, fine: int, boxes: np.ndarray | None) -> np.ndarray:
    """Whether each frame meets its cell, a pair in each row; fills `boxes`. `about`: tangent point, east, north, middle, radius, slack."""
    t, e, n, middle, radius, slack = about
    held, rest = np.zeros(len(pix), bool), np.arange(len(pix))
    p, reach = outlines(pix, fine)
    if boxes is None:
        # Circles apart, even with the slack around the frame: a pixel is nowhere a larger angle than at the tangent point.
        off, around = centres(pix, fine) - middle, slack * np.radians(np.sqrt(sum(f[c] ** 2 for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2"))))
        apart = np.sqrt(np.einsum("ij,ij->i", off, off)) > 2 * np.sin(np.minimum(radius + reach + around, np.pi) / 2) + 1e-12
        rest = np.flatnonzero(~apart)
        p, f, t, e, n, slack = p[:, rest], {c: v[rest] for c, v in f.items()}, t[rest], e[rest], n[rest], slack[rest]
    along = lambda v: p[0] * v[:, 0, None] + p[1] * v[:, 1, None] + p[2] * v[:, 2, None]
    facing = along(t)
    det = (f["cd1_1"] * f["cd2_2"] - f["cd1_2"] * f["cd2_1"])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        xi, eta = np.degrees(along(e) / facing), np.degrees(along(n) / facing)
        x = (f["cd2_2"][:, None] * xi - f["cd1_2"][:, None] * eta) / det + f["crpix1"][:, None] - 1
        y = (f["cd1_1"][:, None] * eta - f["cd2_1"][:, None] * xi) / det + f["crpix2"][:, None] - 1
    flat = facing.min(axis=1, initial=1) > 0.05
    held[rest] = ~flat  # a cell near the rim of the tangent plane stays, with the whole frame as its box
    if boxes is not None:
        boxes[:, 2], boxes[:, 3] = f["width"] - 1, f["height"] - 1
    if flat.any():
        x, y, s, width, height = x[flat], y[flat], slack[flat], f["width"][flat], f["height"][flat]
        held[rest[flat]] = meets(x, y, -0.5 - s, width - 0.5 + s, height - 0.5 + s)
        if boxes is not None:
            low, high = [np.floor(v.min(axis=1) - s - BORDER) for v in (x, y)], [np.ceil(v.max(axis=1) + s + BORDER) for v in (x, y)]
            boxes[flat] = np.stack([np.clip(low[0], 0, width - 1), np.clip(low[1], 0, height - 1), np.clip(high[0], 0, width - 1), np.clip(high[1], 0, height - 1)], -1)
    return held


def _slices(w: dict[str, np.ndarray], order: int) -> Iterator[slice]:
    """Runs of frames whose cells are about PAIRS together; a frame with more is a run of its own."""
    _, radius = _circles(w)
    cells = (1 + radius / np.radians(hp.pixel_size(max(order, FLAT_ORDER)))) ** 2 * 4
    upto = np.floor(np.cumsum(np.maximum(cells, 12)) / PAIRS)
    starts = np.flatnonzero(np.r_[True, upto[1:] != upto[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(radius)], strict=True):
        yield slice(a, b)


def usable(frames: DataFrame) -> DataFrame:
    """Frames with a size, a whole WCS and a CD matrix that can be inverted."""
    good = frames.where(wcs.has_wcs("width", "height", "cd1_1", "cd1_2", "cd2_1", "cd2_2"))
    return good.where("cd1_1 * cd2_2 <> cd1_2 * cd2_1").na.drop(subset=list(WCS))


def _spread(frames: DataFrame) -> DataFrame:
    """Narrow frame rows dealt evenly: a small file of headers would else be one task's work."""
    return frames.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def footprint_boxes(frames: DataFrame, order: int, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The columns in `keep`, npix, x0, y0, w and h: the part of a frame that each cell it meets needs, with a border to interpolate."""
    good = usable(frames)
    names = list(dict.fromkeys(keep))
    schema = StructType([good.schema[c] for c in names] + [StructField("npix", LongType())] + [StructField(c, IntegerType()) for c in CUT])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {c: batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in WCS}
            for part in _slices(w, order):
                at, pix, boxes = covered({c: v[part] for c, v in w.items()}, order)
                sides = [boxes[:, 0], boxes[:, 1], boxes[:, 2] - boxes[:, 0] + 1, boxes[:, 3] - boxes[:, 1] + 1]
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(at + part.start)).columns, pa.array(pix, pa.int64()), *[pa.array(v, pa.int32()) for v in sides]], schema.names)

    return _spread(good.select(*names, *[good[c].alias(f"_{c}") for c in WCS])).mapInArrow(run, schema)


def cut_tiles(frames: DataFrame, order: int, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The columns in `keep` and WCS, npix, x0, y0, w, h and pixels: what each cell needs of each frame, cut out of its pixels.

    Frames aren't joined or shuffled: a frame's task cuts it, and only the parts travel on. The WCS stays that of the whole
    frame. Blank pixels are NaN. A frame whose pixels don't fill its size fails the job.
    """
    good = usable(frames)
    names = list(dict.fromkeys((*keep, *WCS)))
    schema = StructType([good.schema[c] for c in names] + [StructField("npix", LongType())] + [StructField(c, IntegerType()) for c in CUT] + [StructField("pixels", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            w = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in WCS}
            rows, held, pixels = [], 0, batch.column("pixels")
            for k in range(batch.num_rows):
                _, pix, boxes = covered({c: v[k : k + 1] for c, v in w.items()}, order)
                image = pixels[k].values.to_numpy(zero_copy_only=False).reshape(int(w["height"][k]), int(w["width"][k]))
                for p, (x0, y0, x1, y1) in zip(pix, boxes, strict=True):
                    part = image[y0 : y1 + 1, x0 : x1 + 1].astype(np.float64).ravel()
                    rows.append((k, p, x0, y0, x1 - x0 + 1, y1 - y0 + 1, part))
                    held += part.nbytes
                    if held >= BYTES_PER_BATCH:
                        yield cut_batch(batch, names, rows)
                        rows, held = [], 0
            if rows:
                yield cut_batch(batch, names, rows)

    return good.select(*names, "pixels").mapInArrow(run, schema)


def cut_batch(batch: pa.RecordBatch, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """A batch of cut parts: (row of `batch`, npix, x0, y0, w, h, pixels) each, behind the columns `names` of that row."""
    at, *numbers, parts = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, parts)])
    pixels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
    kept = batch.select(names).take(pa.array(at)).columns
    return pa.RecordBatch.from_arrays([*kept, pa.array(numbers[0], pa.int64()), *[pa.array(v, pa.int32()) for v in numbers[1:]], pixels], [*names, "npix", *CUT, "pixels"])


def footprint_cells(frames: DataFrame, order: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in `keep` and npix: one row per frame and cell of `order` that meets its footprint.

    The footprint is the frame's rectangle of pixels and MARGIN pixels around it; cells whose outline passes within 0.3 % of a
    cell's side count too. Frames without a size, a whole WCS or a CD matrix that can be inverted cover nothing.
    """
    good = usable(frames)
    names = list(dict.fromkeys(keep))
    schema = StructType([good.schema[c] for c in names] + [StructField("npix", LongType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = {c: batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in WCS}
            for part in _slices(w, order):
                at, pix, _ = covered({c: v[part] for c, v in w.items()}, order, boxes=False)
                kept = batch.select(names).take(pa.array(at + part.start)).columns if names else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pix, pa.int64())], [*names, "npix"])

    return _spread(good.select(*names, *[good[c].alias(f"_{c}") for c in WCS])).mapInArrow(run, schema)


def disc_cells(positions: DataFrame, order: int, radius: str | float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """`positions` with npix: one row per position and cell of `order` that may meet the disc of `radius` degrees around it.

    No cell that holds a point of the disc is missing. `radius` is a number or the name of a column; a position or radius that
    is null, or a negative radius, has no cells.
    """
    held = positions.withColumns({"_ra": F.col(ra).cast("double"), "_dec": F.col(dec).cast("double"), "_radius": (F.col(radius) if isinstance(radius, str) else F.lit(radius)).cast("double")})
    held = held.where("_ra is not null and _dec between -90 and 90 and _radius >= 0")
    names = positions.columns
    schema = StructType([*positions.schema.fields, StructField("npix", LongType())])

    def run(batches):
        for batch in batches:
            a, d, r = (np.radians(batch.column(c).to_numpy()) for c in ("_ra", "_dec", "_radius"))
            middle = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)
            upto = np.floor(np.cumsum(np.maximum((1 + r / np.radians(hp.pixel_size(order))) ** 2 * 4, 12)) / PAIRS)
            starts = np.flatnonzero(np.r_[True, upto[1:] != upto[:-1]]) if len(r) else []
            for x, y in zip(starts, np.r_[starts[1:], len(r)].astype(int), strict=True) if len(r) else ():
                at, pix = descend(middle[x:y], r[x:y], order)
                yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(at + x)).columns, pa.array(pix, pa.int64())], [*names, "npix"])

    return held.mapInArrow(run, schema)


def disc_ranges(ra: float, dec: float, radius: float, order: int, most: int = 32) -> list[tuple[int, int]]:
    """Sorted ranges (first, last) of cells of `order` that hold the disc around one position, at most `most` of them.

    The descent goes no deeper than needed for `most` ranges; the narrowest gaps are closed first, so more cells may be in
    the ranges than in the disc.
    """
    a, d = np.radians(ra), np.radians(dec)
    middle = np.array([[np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)]])
    level = 0
    while level < order and 4 * (1 + radius / hp.pixel_size(level + 1)) ** 2 <= 64 * most:
        level += 1
    _, pix = descend(middle, np.array([np.radians(radius)]), level)
    pix = np.sort(pix)
    gaps = pix[1:] - pix[:-1] - 1
    open_ = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    open_ = open_[gaps[open_] > 0]
    shift = 2 * (order - level)
    return [(int(x) << shift, (int(y) + 1 << shift) - 1) for x, y in zip(pix[np.r_[0, open_ + 1]], pix[np.r_[open_, len(pix) - 1]], strict=True)]
