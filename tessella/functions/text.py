"""Paths, globs, header cards and JSON lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .healpix import _col


def basename(path) -> Column:
    """What follows the last slash; backslashes count as slashes."""
    return F.substring_index(F.translate(_col(path), "\\", "/"), "/", -1)


def relative_to(path, root: str) -> Column:
    """The path below `root`, or its base name if it lies elsewhere."""
    clean, top = F.translate(_col(path), "\\", "/"), root.rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(top)), F.substring(clean, len(top) + 1, 1 << 30)).otherwise(basename(path))


def glob_match(value, pattern: str) -> Column:
    """`*suffix`, `prefix*`, `prefix*suffix` (the first star only) or the exact name."""
    value = _col(value)
    head, star, tail = pattern.partition("*")
    if not star:
        return value == pattern
    return F.startswith(value, F.lit(head)) & F.endswith(value, F.lit(tail)) & (F.length(value) >= len(head) + len(tail))


def card_value(header, key: str) -> Column:
    """The value of an 80-character header card: a quoted string, or what stands before a space or slash."""
    card = F.regexp_extract(_col(header), rf"(?:^|\n){key:<8}= *('(?:[^']|'')*'|[^ /\n]*)", 1)
    quoted = F.startswith(card, F.lit("'"))
    text = F.replace(F.rtrim(F.regexp_replace(card, r"^'|'$", "")), F.lit("''"), F.lit("'"))
    return F.when(card == "", None).when(quoted, text).otherwise(card)


def index_line(line) -> Column:
    """filepath and cellmem of one JSON line; null for a malformed line."""
    return F.from_json(_col(line), "filepath string, cellmem long")


def tile_of(path) -> tuple[Column, Column]:
    """The order and the cell that a tile's path names, whatever folder and suffix; nulls for other files."""
    found = lambda k: F.regexp_extract(_col(path), r"(?:^|/)Norder(\d+)/Dir\d+/Npix(\d+)\.\w+$", k)
    return F.nullif(found(1), F.lit("")).cast("int"), F.nullif(found(2), F.lit("")).cast("long")


def pixel_defaults(header) -> dict[str, Column]:
    """What a reference image's header says about pixels; bitpix -32, bzero 0, bscale 1 and no blank where it is silent."""
    number = lambda key, kind: card_value(header, key).try_cast(kind)
    return {"bitpix": F.coalesce(number("BITPIX", "int"), F.lit(-32)), "bzero": F.coalesce(number("BZERO", "double"), F.lit(0.0)), "bscale": F.coalesce(number("BSCALE", "double"), F.lit(1.0)), "blank": number("BLANK", "double")}
