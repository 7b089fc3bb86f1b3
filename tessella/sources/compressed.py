"""Tile-compressed FITS images: Rice and gzip tiles in a binary table and its heap, quantisation undone.

Only the tiles that a part of the image needs are fetched and decoded. Rice tiles are decoded side by side: one step of the
loop takes the next pixel of every tile, so the work per step is an array operation over tiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np

Fetch = Callable[[int, int], bytes]
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMN_BYTES = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
# Fixed values of the format: Rice's bits of a block's code, its largest value, and bits of a raw difference, by bytes of a pixel.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
# Fixed values of the format: the dither's generator and table, and quantised values that stand for something else.
FACTOR, MODULUS, RANDOMS, STRIDE = 16807, 2147483647, 10000, 500
NULL_VALUE, ZERO_VALUE = -2147483647, -2147483646
BYTES_AT_ONCE = 1 << 20


def is_compressed(cards: dict[str, str]) -> bool:
    """Whether a unit is a table that holds a compressed image."""
    return cards.get("ZIMAGE") == "T"


def _columns(cards: dict[str, str]) -> dict[str, tuple[int, str, str]]:
    """Offset within a row, format letter, and letter of the heap's elements for each column, by name."""
    out, at = {}, 0
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{k}"].strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        count, letter = int(form[:digits] or 1), form[digits]
        out[cards.get(f"TTYPE{k}", "").strip().upper()] = at, letter, form[digits + 1 : digits + 2]
        at += -(-count // 8) if letter == "X" else count * COLUMN_BYTES[letter]
    return out


def _tiles(cards: dict[str, str], bounds: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Row number, x0, y0, width and height of every tile that meets bounds (x0, y0, x1, y1)."""
    width, height = int(cards["ZNAXIS1"]), int(cards["ZNAXIS2"])
    w, h = int(cards.get("ZTILE1", width)), int(cards.get("ZTILE2", 1))
    across = -(-width // w)
    for j in range(bounds[1] // h, -(-bounds[3] // h)):
        for i in range(bounds[0] // w, -(-bounds[2] // w)):
            yield j * across + i, i * w, j * h, min(w, width - i * w), min(h, height - j * h)


def randoms() -> np.ndarray:
    """The format's table of random numbers."""
    out, seed = np.empty(RANDOMS), 1
    for k in range(RANDOMS):
        seed = seed * FACTOR % MODULUS
        out[k] = seed / MODULUS
    return out


def dither(table: np.ndarray, row: int, seed: int, n: int) -> np.ndarray:
    """The `n` numbers that were added to a tile's values before they were rounded; `row` counts from 0."""
    start, out = (row + seed - 1) % RANDOMS, []
    while sum(map(len, out)) < n:
        out.append(table[int(table[start] * STRIDE) :])
        start = (start + 1) % RANDOMS
    return np.concatenate(out)[:n] if out else np.empty(0)


def rice(streams: list[bytes], counts: np.ndarray, pixel_bytes: int, block: int) -> list[np.ndarray]:
    """The integers of Rice streams, `counts` of them in each."""
    code_bits, raw, width = RICE[pixel_bytes]
    starts = np.cumsum([0] + [len(s) for s in streams[:-1]], dtype=np.int64)
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    ones = np.flatnonzero(np.unpackbits(data))
    after = np.zeros(len(data) * 8 + 1, np.int64)  # how many ones stand before a bit: the index of the next one
    after[ones + 1] = 1
    after = np.cumsum(after)
    wide = data.astype(np.uint64)

    def bits(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits, 32 at most, from each bit position."""
        byte = at >> 3
        window = wide[byte] << np.uint64(32) | wide[byte + 1] << np.uint64(24) | wide[byte + 2] << np.uint64(16) | wide[byte + 3] << np.uint64(8) | wide[byte + 4]
        return (window >> (40 - (at & 7) - n).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    at, total = starts * 8, int(counts.max(initial=0))
    out = np.zeros((len(streams), total), np.int64)
    last = bits(at, np.full(len(at), width))
    at = at + width
    code = np.zeros(len(at), np.int64)
    for j in range(total):
        live = np.flatnonzero(counts > j)
        if j % block == 0:
            code[live] = bits(at[live], np.full(len(live), code_bits)) - 1
            at[live] += code_bits
        c = code[live]
        step = np.zeros(len(live), np.int64)
        plain = c == raw
        if plain.any():
            k = live[plain]
            step[plain] = bits(at[k], np.full(len(k), width))
            at[k] += width
        split = (c >= 0) & ~plain
        if split.any():
            k, low = live[split], c[split]
            stop = ones[after[at[k]]]
            step[split] = (stop - at[k] << low) | bits(stop + 1, low)
            at[k] = stop + 1 + low
        last[live] += np.where(step & 1, ~(step >> 1), step >> 1)
        out[live, j] = last[live]
    if pixel_bytes == 1:
        values = out & 0xFF
    else:
        half = 1 << width - 1
        values = (out + half & (1 << width) - 1) - half
    return [v[:n] for v, n in zip(values, counts, strict=True)]


def _gunzip(data: bytes, kind: str, n: int, shuffled: bool) -> np.ndarray:
    """The values of a gzip tile; `shuffled` ones have all first bytes, then all second bytes, and so on."""
    raw = zlib.decompress(data, 47)
    size = np.dtype(kind).itemsize
    if shuffled and size > 1:
        raw = np.frombuffer(raw, np.uint8).reshape(size, -1).T.tobytes()
    return np.frombuffer(raw, kind, n)


def read_tiles(fetch: Fetch, cards: dict[str, str], at: int, bounds: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Stored values (before BSCALE and BZERO) of the part (x0, y0, x1, y1), and where they are missing.

    `at` is the offset of the table's data. Raises ValueError for methods that are not Rice or gzip.
    """
    method, bitpix = cards.get("ZCMPTYPE", "").strip(), int(cards["ZBITPIX"])
    if method not in ("RICE_1", "RICE_ONE", "GZIP_1", "GZIP_2", "NOCOMPRESS"):
        raise ValueError(f"the compression {method} is not supported")
    settings = {cards.get(f"ZNAME{k}", "").strip(): int(float(cards[f"ZVAL{k}"])) for k in range(1, 10) if f"ZVAL{k}" in cards}
    columns, row_bytes = _columns(cards), int(cards["NAXIS1"])
    heap = at + int(cards.get("THEAP", row_bytes * int(cards["NAXIS2"])))
    x0, y0, x1, y1 = bounds
    tiles = list(_tiles(cards, bounds))
    first, stop = tiles[0][0], tiles[-1][0] + 1
    table = fetch(at + first * row_bytes, (stop - first) * row_bytes)
    if len(table) < (stop - first) * row_bytes:
        raise ValueError("the pixels are cut off")
    values = np.full((y1 - y0, x1 - x0), np.nan)
    missing = np.zeros(values.shape, bool)
    numbers = randoms() if bitpix < 0 and cards.get("ZQUANTIZ", "").startswith("SUBTRACTIVE_DITHER") else None

    def cell(row: int, name: str):
        """A row's value of a column: (count, offset) of a heap array, or a number; None without the column."""
        if name not in columns:
            return None
        offset, letter, _ = columns[name]
        start = (row - first) * row_bytes + offset
        if letter in "PQ":
            return tuple(int(v) for v in np.frombuffer(table, ">i4" if letter == "P" else ">i8", 2, start))
        return float(np.frombuffer(table, {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}[letter], 1, start)[0])

    def put(tile: tuple[int, int, int, int, int], stored: np.ndarray, lost: np.ndarray) -> None:
        _, tx, ty, w, h = tile
        a, b, c, d = max(tx, x0), max(ty, y0), min(tx + w, x1), min(ty + h, y1)
        part = slice(b - ty, d - ty), slice(a - tx, c - tx)
        values[b - y0 : d - y0, a - x0 : c - x0] = stored.reshape(h, w)[part]
        missing[b - y0 : d - y0, a - x0 : c - x0] = lost.reshape(h, w)[part]

    def unquantised(tile, stored: np.ndarray) -> None:
        """Quantised integers of a float image back to floats; integers of an integer image stay."""
        row = tile[0]
        scale = cell(row, "ZSCALE") if "ZSCALE" in columns else float(cards["ZSCALE"]) if "ZSCALE" in cards else None
        null = cell(row, "ZBLANK") if "ZBLANK" in columns else float(cards["ZBLANK"]) if "ZBLANK" in cards else float(cards["BLANK"]) if "BLANK" in cards and bitpix > 0 else None
        if bitpix > 0:
            put(tile, stored.astype(float), stored == null if null is not None else np.zeros(len(stored), bool))
            return
        zero = cell(row, "ZZERO") if "ZZERO" in columns else float(cards.get("ZZERO", 0))
        noise = dither(numbers, row, int(float(cards.get("ZDITHER0", 1))), len(stored)) - 0.5 if numbers is not None else 0.0
        floats = (stored - noise) * (1.0 if scale is None else scale) + zero
        if cards.get("ZQUANTIZ", "").strip() == "SUBTRACTIVE_DITHER_2":
            floats = np.where(stored == ZERO_VALUE, 0.0, floats)
        put(tile, floats, stored == (NULL_VALUE if null is None else null))

    waiting: list[tuple[tuple, bytes]] = []

    def decode_waiting() -> None:
        counts = np.array([t[3] * t[4] for t, _ in waiting], np.int64)
        for (tile, _), stored in zip(waiting, rice([s for _, s in waiting], counts, settings.get("BYTEPIX", 4), settings.get("BLOCKSIZE", 32)), strict=True):
            unquantised(tile, stored)
        waiting.clear()

    for tile in tiles:
        row, _, _, w, h = tile
        n = w * h
        for name in ("COMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA"):
            found = cell(row, name)
            if found is not None and found[0]:
                break
        else:
            raise ValueError("a tile has no data")
        count, offset = found
        size = count * COLUMN_BYTES[columns[name][2] or "B"]
        data = fetch(heap + offset, size)
        if len(data) < size:
            raise ValueError("the pixels are cut off")
        quantised = bitpix > 0 or "ZSCALE" in columns or "ZSCALE" in cards
        if name == "COMPRESSED_DATA" and method.startswith("RICE"):
            waiting.append((tile, data))
            if sum(len(s) for _, s in waiting) >= BYTES_AT_ONCE:
                decode_waiting()
        elif name == "COMPRESSED_DATA" and method.startswith("GZIP") and quantised:
            unquantised(tile, _gunzip(data, KINDS[bitpix] if bitpix > 0 else ">i4", n, method == "GZIP_2").astype(np.int64))
        else:  # floats as they are
            kind = KINDS[bitpix]
            stored = np.frombuffer(data, kind, n) if name == "UNCOMPRESSED_DATA" or method == "NOCOMPRESS" else _gunzip(data, kind, n, method == "GZIP_2" and name == "COMPRESSED_DATA")
            if bitpix > 0:
                unquantised(tile, stored.astype(np.int64))
            else:
                put(tile, stored.astype(float), np.isnan(stored.astype(float)))
    if waiting:
        decode_waiting()
    return values, missing
