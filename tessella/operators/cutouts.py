"""Which parts of an image to read: boxes snapped to cells, and the switch to a full read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..sources import fits, fitssource
from .polygons import BYTES_PER_BATCH, CUT, WCS, cut_batch, footprint_boxes, usable

FULL_READ = 0.85


def cells(boxes: DataFrame, cell: int) -> DataFrame:
    """image_id, cell_x, cell_y, x0, y0, w, h: the distinct cells that an image's boxes touch, clipped to it.

    `boxes` has image_id, x0, y0, w, h, width, height. Boxes outside their image touch nothing.
    """
    clipped = boxes.select(
        "image_id", "width", "height", F.greatest("x0", F.lit(0)).alias("a"), F.greatest("y0", F.lit(0)).alias("b"),
        (F.least(F.col("x0") + F.col("w"), F.col("width")) - 1).alias("c"), (F.least(F.col("y0") + F.col("h"), F.col("height")) - 1).alias("d"),
    ).where("a <= c and b <= d")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int"))
    grid = clipped.withColumn("i", F.explode(span("a", "c"))).withColumn("j", F.explode(span("b", "d"))).select("image_id", "width", "height", "i", "j").distinct()
    return grid.select(
        "image_id", "width", "height", (F.col("i") * cell).alias("x0"), (F.col("j") * cell).alias("y0"),
        F.least(F.lit(cell), F.col("width") - F.col("i") * cell).alias("w"), F.least(F.lit(cell), F.col("height") - F.col("j") * cell).alias("h"),
    )


def plan(boxes: DataFrame, cell: int, full_read: float = FULL_READ) -> DataFrame:
    """image_id, n_cells, planned pixels, their share, and whether to read the image as a whole."""
    planned = cells(boxes, cell).groupBy("image_id", "width", "height").agg(F.count("*").alias("n_cells"), F.sum(F.col("w") * F.col("h")).alias("planned"))
    share = F.col("planned") / (F.col("width") * F.col("height"))
    return planned.select("image_id", "n_cells", "planned", share.alias("share"), (share >= full_read).alias("read_full"))


def jobs(boxes: DataFrame, cell: int, full_read: float = FULL_READ) -> DataFrame:
    """One row per read: a cell, or the whole image where the plan says so."""
    whole = plan(boxes, cell, full_read).select("image_id", "read_full")
    joined = cells(boxes, cell).join(whole, "image_id")
    box = F.when(F.col("read_full"), F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("w"), F.col("height").alias("h"))).otherwise(F.struct("x0", "y0", "w", "h"))
    return joined.select("image_id", "read_full", box.alias("b")).distinct().select("image_id", "b.x0", "b.y0", "b.w", "b.h", "read_full")


def file_boxes(spark: SparkSession, path: str, order: int, tiles: DataFrame | None = None, **files) -> DataFrame:
    """image_id (the path), WCS, npix, x0, y0, w, h: the parts of FITS files that tiles need, from their headers alone.

    With `tiles` (npix) only the parts for those. Broken files and those without a WCS have none.
    """
    frames = usable(fitssource.open_ranged(spark, path, ("path", *WCS, "is_valid"), **files).where("is_valid").withColumnRenamed("path", "image_id"))
    boxes = footprint_boxes(frames, order, ("image_id", *WCS))
    return boxes if tiles is None else boxes.join(tiles.select("npix").distinct(), "npix", "left_semi")


def cut_files(spark: SparkSession, path: str, order: int, tiles: DataFrame | None = None, cell: int = 128, full_read: float = FULL_READ, **files) -> DataFrame:
    """image_id, WCS, npix, x0, y0, w, h, pixels and fetched of every part of a FITS file that a tile needs, read by ranges.

    Headers come first; the plan over cells of `cell` pixels says which files are read as a whole; of the others a part's lines
    are fetched. `fetched` has the bytes of each file on its first part and 0 on the others. One task reads a file.
    """
    boxes = file_boxes(spark, path, order, tiles, **files)
    whole = plan(boxes, cell, full_read).select("image_id", "read_full")
    parts = boxes.groupBy("image_id", *WCS).agg(F.collect_list(F.struct("npix", *CUT)).alias("parts")).join(whole, "image_id")  # a file's cells
    names = ["image_id", *WCS]
    schema = StructType([boxes.schema[c] for c in names] + [StructField("npix", LongType())] + [boxes.schema[c] for c in CUT] + [StructField("pixels", ArrayType(DoubleType())), StructField("fetched", LongType())])
    hdu = int(files["hdu"]) if "hdu" in files else None

    def read(batches):
        for batch in batches:
            for k, (name, full, wanted) in enumerate(zip(batch.column("image_id").to_pylist(), batch.column("read_full").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                rows, held = [], 0
                store, inner = fitssource.open_store(name)
                with store.open_input_file(inner) as handle:
                    ranged = fitssource.Ranged(handle, handle.size())
                    image = None
                    if full:
                        row = fits.decode_from(ranged, handle.size(), name, hdu=hdu)
                        image = row["pixels"].reshape(row["height"], row["width"])
                    for p in wanted:
                        x0, y0, w, h = (p[c] for c in CUT)
                        part = image[y0 : y0 + h, x0 : x0 + w].ravel() if full else fits.decode_from(ranged, handle.size(), name, bounds=(x0, y0, w, h), hdu=hdu)["pixels"]
                        rows.append((k, p["npix"], x0, y0, w, h, part.astype(np.float64), ranged.fetched))
                        ranged.fetched = 0
                        held += part.nbytes * 2
                        if held >= BYTES_PER_BATCH:
                            yield _with_bytes(batch, names, rows)
                            rows, held = [], 0
                if rows:
                    yield _with_bytes(batch, names, rows)

    return parts.select(*names, "parts", "read_full").mapInArrow(read, schema)


def _with_bytes(batch, names: list[str], rows: list[tuple]):
    return cut_batch(batch, names, [r[:-1] for r in rows]).append_column("fetched", np.array([r[-1] for r in rows], np.int64))
