"""FITS images as a source and a sink.

`read` takes whole files from Spark's binary file source, so any store that Spark reads will do. The data source
`fits` (`FitsDataSource`) opens files itself and fetches what a row needs: header blocks, and the lines or tiles of the
part asked for. Both use one small codec: 2880-byte blocks of 80-byte cards, then big-endian pixels or compressed
tiles. All BITPIX are supported; BSCALE and BZERO are applied once, BLANK becomes NaN.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compressed import Fetch, is_compressed, read_tiles

BLOCK, CARD = 2880, 80
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
EXTENSIONS = (".fits", ".fit", ".fts", ".img", ".fz")
NUMBERS = ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CDELT1", "CDELT2", "CROTA2", "BSCALE", "BZERO", "BLANK", "EXPTIME")
TEXTS = ("CTYPE1", "CTYPE2", "RADESYS", "DATE-OBS", "FILTER")

SCHEMA = (
    "path string, hdu int, width int, height int, bitpix int, "
    + ", ".join(f"{k.lower()} double" for k in NUMBERS)
    + ", "
    + ", ".join(f"{k.lower().replace('-', '_')} string" for k in TEXTS)
    + ", x0 int, y0 int, pixels array<float>, is_valid boolean, error string"
)


def parse_card(card: str) -> tuple[str, str | None]:
    """Key and value text of a card; a quoted value keeps its inner spaces and loses doubled quotes."""
    key = card[:8].strip()
    if card[8:10] != "= ":
        return key, None
    rest = card[10:].strip()
    if rest.startswith("'"):
        out, i = [], 1
        while i < len(rest):
            if rest[i] == "'":
                if rest[i + 1 : i + 2] != "'":
                    break
                i += 1
            out.append(rest[i])
            i += 1
        return key, "".join(out).rstrip()
    return key, rest.split("/")[0].strip() or None


def _data_size(cards: dict[str, str]) -> int:
    """Bytes of a unit's data, without the fill to whole blocks."""
    axes = [int(float(cards.get(f"NAXIS{k}", 0))) for k in range(1, int(cards.get("NAXIS", 0)) + 1)]
    return (int(np.prod(axes)) + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1)) * abs(int(cards.get("BITPIX", 8))) // 8 if axes else 0


def units_of(fetch: Fetch, size: int) -> Iterator[tuple[dict[str, str], int]]:
    """Header and data offset of one unit of a file after the other; data are skipped, not fetched. Raises ValueError for a broken file."""
    at, first = 0, True
    while at + BLOCK <= size:
        cards: dict[str, str] = {}
        done = False
        while not done:
            block = fetch(at, BLOCK).decode("ascii", "replace")
            if len(block) < BLOCK:
                raise ValueError("header without END")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                if block[i : i + 8].strip() == "END":
                    done = True
                    break
                key, value = parse_card(block[i : i + CARD])
                if value is not None:
                    cards.setdefault(key, value)
        if first and "SIMPLE" not in cards:
            raise ValueError("not a FITS file")
        first = False
        yield cards, at
        at += -(-_data_size(cards) // BLOCK) * BLOCK
    if first:
        raise ValueError("empty file")


def headers(data: bytes) -> list[tuple[dict[str, str], int]]:
    """Header and data offset of every unit of a file. Raises ValueError for a broken file."""
    return list(units_of(lambda at, n: data[at : at + n], len(data)))


def is_image(cards: dict[str, str]) -> bool:
    """Whether a unit holds an image with axes, as pixels or as compressed tiles."""
    if is_compressed(cards):
        return int(cards.get("ZNAXIS", 0)) >= 2
    return int(cards.get("NAXIS", 0)) >= 2 and cards.get("XTENSION", "IMAGE").strip() in ("IMAGE", "")


def find_unit(units: Iterator[tuple[dict[str, str], int]], preferred: int | None) -> tuple[int, dict[str, str], int]:
    """Number (from 1), header and data offset of the preferred unit if it is an image, else of the first one that is.

    No unit behind the chosen one is looked at.
    """
    held = None
    for k, (cards, at) in enumerate(units, 1):
        if is_image(cards):
            if not preferred or k == preferred:
                return k, cards, at
            held = held or (k, cards, at)
        if held and (not preferred or k >= preferred):
            return held
    if held:
        return held
    raise ValueError("no image in the file")


def decode_from(fetch: Fetch, size: int, path: str = "", header_only: bool = False, bounds: tuple[int, int, int, int] | None = None, hdu: int | None = None) -> dict:
    """One image of a file of `size` bytes as a row of SCHEMA; `fetch(at, n)` gives n bytes of it.

    `bounds` (x0, y0, w, h) reads a part and moves CRPIX along. Fetched are header blocks up to the image's, and the
    lines, or the compressed tiles, that the part needs.
    """
    k, cards, at = find_unit(units_of(fetch, size), hdu or (2 if path.lower().endswith(".fz") else None))
    z = "Z" if is_compressed(cards) else ""
    width, height, bitpix = int(cards[z + "NAXIS1"]), int(cards[z + "NAXIS2"]), int(cards[z + "BITPIX"])
    row: dict = {"path": path, "hdu": k, "bitpix": bitpix}
    for key in NUMBERS:
        try:
            row[key.lower()] = float(cards[key].replace("D", "E")) if key in cards else None
        except ValueError:
            row[key.lower()] = None
    for key in TEXTS:
        row[key.lower().replace("-", "_")] = cards.get(key)
    if all(not row[c] for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2")) and (row["cdelt1"] or row["cdelt2"]):
        turn = np.radians(row["crota2"] or 0.0)
        d1, d2 = row["cdelt1"] or 0.0, row["cdelt2"] or 0.0
        row |= {"cd1_1": d1 * np.cos(turn), "cd1_2": -d2 * np.sin(turn), "cd2_1": d1 * np.sin(turn), "cd2_2": d2 * np.cos(turn)}
    x0, y0, w, h = bounds or (0, 0, width, height)
    x1, y1 = min(x0 + w, width), min(y0 + h, height)
    x0, y0 = max(x0, 0), max(y0, 0)
    if x0 >= x1 or y0 >= y1:
        raise ValueError("the part lies outside the image")
    row |= {"x0": x0, "y0": y0, "width": x1 - x0, "height": y1 - y0}
    for c, shift in (("crpix1", x0), ("crpix2", y0)):
        row[c] = row[c] - shift if row[c] is not None else None
    row["pixels"] = None
    if not header_only:
        if z:
            stored, lost = read_tiles(fetch, cards, at, (x0, y0, x1, y1))
        else:
            line = width * abs(bitpix) // 8
            if size < at + height * line:
                raise ValueError("the pixels are cut off")
            raw = np.frombuffer(fetch(at + y0 * line, (y1 - y0) * line), DTYPES[bitpix]).reshape(y1 - y0, width)[:, x0:x1]
            stored, lost = raw.astype(np.float64), raw == row["blank"] if bitpix > 0 and row["blank"] is not None else np.zeros(raw.shape, bool)
        values = stored * (row["bscale"] if row["bscale"] is not None else 1.0) + (row["bzero"] or 0.0)
        values[lost] = np.nan
        row["pixels"] = values.astype(np.float32).ravel()
    has_cd = any(row[c] for c in ("cd1_1", "cd1_2", "cd2_1", "cd2_2"))
    return row | {"is_valid": bool(has_cd), "error": None}


def decode(data: bytes, path: str = "", header_only: bool = False, bounds: tuple[int, int, int, int] | None = None, hdu: int | None = None) -> dict:
    """One image of a file's bytes as a row of SCHEMA; see `decode_from`."""
    return decode_from(lambda at, n: data[at : at + n], len(data), path, header_only, bounds, hdu)


def encode(pixels, width: int, height: int, cards: dict | None = None, bitpix: int = -32, blank: int | None = None) -> bytes:
    """A FITS file of one image. NaN becomes BLANK for integer types, which needs a blank value."""
    values = np.asarray(pixels, dtype=np.float64).reshape(height, width)
    head = {"SIMPLE": True, "BITPIX": bitpix, "NAXIS": 2, "NAXIS1": width, "NAXIS2": height}
    if bitpix > 0:
        lost = np.isnan(values)
        if lost.any() and blank is None:
            raise ValueError("integer pixels need a blank value for NaN")
        if blank is not None:
            head["BLANK"] = blank
        values = np.where(lost, blank if blank is not None else 0, np.rint(values))
    head |= cards or {}
    lines = []
    for key, v in head.items():
        text = ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"'{str(v).replace(chr(39), chr(39) * 2):<8}'" if isinstance(v, str) else repr(v).rjust(20)
        lines.append(f"{key:<8}= {text}".ljust(CARD)[:CARD])
    lines.append("END".ljust(CARD))
    header = "".join(lines).encode("ascii")
    body = values.astype(DTYPES[bitpix]).tobytes()
    return header.ljust(-(-len(header) // BLOCK) * BLOCK, b" ") + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, limit: int = 0, exclude: str | None = None) -> DataFrame:
    """path, length and modification time of FITS files: by extension, whatever its case, and by name pattern.

    `limit` takes the first files by path; `exclude` leaves out everything below a folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path).drop("content")
    ending = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    files = files.where(ending.isin(*EXTENSIONS))
    if exclude:
        files = files.where(~F.contains("path", F.lit(exclude.rstrip("/") + "/")))
    return files.orderBy("path").limit(limit) if limit else files


def read(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, limit: int = 0, header_only: bool = False, bounds: tuple[int, int, int, int] | None = None, hdu: int | None = None, mode: str = "PERMISSIVE", exclude: str | None = None) -> DataFrame:
    """Images below `path` as rows of SCHEMA. Broken files give a row with `error`, or fail the job in mode FAILFAST.

    Whole files travel from the store; `open_ranged` fetches parts of them. `exclude` leaves out everything below a folder.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path).select("path", "content")
    if limit:  # the listing reads no contents
        files = content.join(list_files(spark, path, pattern, recursive, limit, exclude).select("path"), "path", "left_semi")
    else:
        files = content.where(F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin(*EXTENSIONS))
        files = files.where(~F.contains("path", F.lit(exclude.rstrip("/") + "/"))) if exclude else files
    schema = spark.createDataFrame([], SCHEMA).schema

    def decoded(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    row = decode(data.as_py(), p, header_only, bounds, hdu)
                except (ValueError, KeyError) as problem:
                    if mode == "FAILFAST":
                        raise
                    row = {"path": p, "is_valid": False, "error": str(problem)}
                yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in arrow}], schema=arrow)

    return files.mapInArrow(decoded, SCHEMA)


def with_content(tiles: DataFrame, order: int, width: int, bitpix: int = -32, blank: int | None = None) -> DataFrame:
    """path and content: one FITS file per row of npix and pixels (row-major, `width` a side)."""
    from ..functions.healpix import tile_path

    @F.udf("binary")
    def file(npix, pixels):
        return encode([float("nan") if v is None else v for v in pixels], width, width, {"ORDER": order, "NPIX": npix, "CTYPE1": "RA---HPX", "CTYPE2": "DEC--HPX"}, bitpix, blank)

    return tiles.select(tile_path(F.lit(order), "npix").alias("path"), file("npix", "pixels").alias("content"))


def export(files: DataFrame, folder: str) -> None:
    """Write path and content rows as files below a folder that all executors share."""

    def save(rows):
        for r in rows:
            target = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "wb") as out:
                out.write(r["content"])
            os.replace(f"{target}.part", target)  # a task that runs twice leaves one whole file

    files.foreachPartition(save)
