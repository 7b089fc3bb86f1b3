"""The provenance index as JSON lines, and tile tables as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.healpix import tile_dir
from ..functions.text import basename, tile_of

LINE = "filepath string, cellmem long"


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """order, npix, filepath, cellmem as JSON lines, partitioned by order and directory."""
    index.withColumn("dir", tile_dir("npix")).repartition("order", "dir").write.mode(mode).partitionBy("order", "dir").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with `filename`; malformed lines are skipped."""
    rows = spark.read.schema(f"npix long, {LINE}, order int, dir long, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and filepath is not null").select("order", "npix", "filepath", "cellmem", basename("filepath").alias("filename"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles by order and directory; only the partitions that `tiles` touches are replaced."""
    tiles.withColumn("dir", tile_dir("npix")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("order", "dir").parquet(path)


def tile_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """order, npix and path of the tile files among `paths`; other files are left out."""
    order, npix = tile_of(path)
    return paths.select(order.alias("order"), npix.alias("npix"), F.col(path).alias("path")).where("order is not null")


def highest_tiles(paths: DataFrame, path: str = "path") -> DataFrame:
    """The tile files of the highest order there is. The order is one row, broadcast."""
    files = tile_files(paths, path)
    return files.join(F.broadcast(files.agg(F.max("order").alias("order"))), "order").select("order", "npix", "path")


def list_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The tile files below a folder of any store that Spark reads; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return tile_files(found)


def write_rows(rows: DataFrame, path: str, form: str = "json", mode: str = "overwrite") -> None:
    """A table as JSON lines or as CSV with a header, one file per partition."""
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form {form}")
    writer = rows.write.mode(mode)
    writer.option("header", "true").csv(path) if form == "csv" else writer.option("ignoreNullFields", "false").json(path)


def union_of(tables: list[DataFrame]) -> DataFrame:
    """Tables below each other with the union of their columns; what a table lacks is null."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def properties(tiles: DataFrame, order: int, width: int, low: float, high: float, bitpix: int = -32) -> DataFrame:
    """key and value rows of a survey's description."""
    one = tiles.select("npix").distinct().agg(F.count("*").alias("n"))
    pairs = {
        "hips_order": F.lit(str(order)),
        "hips_tile_width": F.lit(str(width)),
        "hips_frame": F.lit("equatorial"),
        "hips_tile_format": F.lit("fits"),
        "dataproduct_type": F.lit("image"),
        "hips_pixel_bitpix": F.lit(str(bitpix)),
        "hips_pixel_scale": F.format_string("%.6e", F.lit(180.0 / (4 * (1 << order) * width))),
        "hips_pixel_cut": F.format_string("%.4f %.4f", F.lit(low), F.lit(high)),
        "moc_sky_fraction": F.format_string("%.6f", F.col("n") / F.lit(float(12 << 2 * order))),
        "hips_nb_tiles": F.col("n").cast("string"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return one.select(F.explode(rows).alias("r")).select("r.key", "r.value")
