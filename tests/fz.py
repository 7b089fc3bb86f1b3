"""Compressed files for tests: a plain writer, bit by bit, that shares no code with the reader."""

import math
import struct
import zlib

import numpy as np


def card(key, value):
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F").rjust(20) if isinstance(value, bool) else str(value).rjust(20)
    return f"{key:<8}= {text}".ljust(80)


def unit(cards, data=b""):
    head = "".join([card(k, v) for k, v in cards] + ["END".ljust(80)]).encode()
    return head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def rice_bytes(values, size, block=32):
    """The Rice stream of a list of integers of `size` bytes."""
    code_bits, raw, width = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}[size]
    mask = (1 << width) - 1
    bits = [format(values[0] & mask, f"0{width}b")]
    last = values[0]
    for at in range(0, len(values), block):
        steps = []
        for v in values[at : at + block]:
            d = (v - last) & mask
            d = d - (1 << width) if d >> width - 1 else d
            steps.append(2 * d if d >= 0 else -2 * d - 1)
            last = v
        mean = sum(steps) / len(steps)
        split = min(max(0, int(math.log2(mean)) if mean >= 1 else 0), raw - 1)
        if not any(steps):
            bits.append("0" * code_bits)
        elif sum((s >> split) + 1 + split for s in steps) > width * len(steps):
            bits.append(format(raw + 1, f"0{code_bits}b"))
            bits.extend(format(s & mask, f"0{width}b") for s in steps)
        else:
            bits.append(format(split + 1, f"0{code_bits}b"))
            for s in steps:
                bits.append("0" * (s >> split) + "1" + (format(s & (1 << split) - 1, f"0{split}b") if split else ""))
    whole = "".join(bits)
    whole = whole.ljust(-(-len(whole) // 8) * 8, "0")
    return bytes(int(whole[k : k + 8], 2) for k in range(0, len(whole), 8))


def random_table():
    out, seed = [], 1.0
    for _ in range(10_000):
        seed = math.fmod(16807.0 * seed, 2147483647.0)
        out.append(seed / 2147483647.0)
    return out


def pack(pixels, bitpix, method="RICE_1", tile=None, scale=None, quantize="NO_DITHER", seed=1, blank=None, cards=(), loose=(), pixel_bytes=None):
    """A file with an empty first unit and a compressed image. `loose`: tile numbers that are stored as gzip floats."""
    pixels = np.asarray(pixels)
    height, width = pixels.shape
    tw, th = tile or (width, 1)
    kind = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[bitpix]
    size = pixel_bytes or (4 if bitpix < 0 else abs(bitpix) // 8)
    noise, rows, heap = random_table(), [], b""
    number = 0
    for y in range(0, height, th):
        for x in range(0, width, tw):
            part, scales, raw = pixels[y : y + th, x : x + tw].ravel(), (0.0, 0.0), None
            if bitpix < 0 and scale is not None and number not in loose:
                zero = float(np.nanmin(part)) if not np.isnan(part).all() else 0.0
                k = (number + seed - 1) % 10_000
                at, q = int(noise[k] * 500), []
                for v in part:
                    r = noise[at] if quantize != "NO_DITHER" else 0.5
                    if np.isnan(v):
                        q.append(-2147483647)
                    elif v == 0 and quantize == "SUBTRACTIVE_DITHER_2":
                        q.append(-2147483646)
                    else:
                        q.append(int(math.floor((float(v) - zero) / scale + r)))
                    at += 1
                    if at == 10_000:
                        k = (k + 1) % 10_000
                        at = int(noise[k] * 500)
                part, scales, values = np.array(q), (scale, zero), ">i4"
            else:
                values = kind
                raw = bitpix < 0
            stored = np.array(part, values).tobytes()
            if method == "GZIP_2" and not (raw and number in loose):
                n = np.dtype(values).itemsize
                stored = b"".join(stored[k::n] for k in range(n))
            first = zlib.compress(stored) if method != "RICE_1" else b"" if raw else rice_bytes([int(v) for v in part], size)
            second = zlib.compress(stored) if raw and (method == "RICE_1" or number in loose) else b""
            first = b"" if second else first
            a = len(heap)
            heap += first
            b = len(heap)
            heap += second
            rows.append(struct.pack(">iiiidd", len(first), a, len(second), b, *scales))
            number += 1
    table = b"".join(rows)
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 32), ("NAXIS2", len(rows)), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", 4)]
    head += [("TTYPE1", "COMPRESSED_DATA"), ("TFORM1", f"1PB({len(heap)})"), ("TTYPE2", "GZIP_COMPRESSED_DATA"), ("TFORM2", "1PB(9)")]
    head += [("TTYPE3", "ZSCALE" if scale is not None else "UNUSED1"), ("TFORM3", "1D"), ("TTYPE4", "ZZERO" if scale is not None else "UNUSED2"), ("TFORM4", "1D")]
    head += [("ZIMAGE", True), ("ZCMPTYPE", method), ("ZBITPIX", bitpix), ("ZNAXIS", 2), ("ZNAXIS1", width), ("ZNAXIS2", height), ("ZTILE1", tw), ("ZTILE2", th), ("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", size)]
    if scale is not None:
        head += [("ZQUANTIZ", quantize), ("ZDITHER0", seed), ("ZBLANK", -2147483647)]
    if blank is not None:
        head += [("BLANK", blank)]
    return unit([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + unit([*head, *cards], table + heap)
