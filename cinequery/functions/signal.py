"""Samples, transforms and colour as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinequery.functions.binary import column, le_uint

#: The output formats' bit depths.
FORMAT_DEPTHS = {f"yuv{c}p{d}": d for c in (420, 422, 444) for d in (8, 10, 12)}


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, top: Column | int | float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(top).cast("double") if not isinstance(top, Column) else top.cast("double"), x.cast("double")))


def pcm_layout(valid: Column | str, stored: Column | str) -> Column:
    """Valid and stored bits and bytes of a sample; null for what isn't 16, 24 or 32 bits stored with 1 to all of them valid."""
    v = column(valid)
    s = F.coalesce(column(stored), v)
    return F.when(s.isin(16, 24, 32) & v.between(1, s), F.struct(v.cast("int").alias("valid"), s.cast("int").alias("stored"), F.floor(s / 8).cast("int").alias("bytes")))


def pcm_sample(b: Column | str, offset: Column | int, stored: Column, valid: Column) -> Column:
    """A little-endian sample as a number in [-1, 1): sign-extended, padding bits dropped."""
    raw = F.when(stored == 16, le_uint(b, offset, 2)).when(stored == 24, le_uint(b, offset, 3)).otherwise(le_uint(b, offset, 4))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), stored.cast("int"))
    signed = F.when(raw * 2 >= full, raw - full).otherwise(raw)
    return F.call_function("shiftright", signed, (stored - valid).cast("int")).cast("double") / F.pow(F.lit(2.0), valid - 1)


def dc_delta(value: Column | str, length: Column | str) -> Column:
    v, n = column(value).cast("long"), column(length).cast("int")
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return F.when(n == 0, F.lit(0).cast("long")).when(v < power(n - 1), v - (power(n) - 1)).otherwise(v)


def dequantise(level: Column, scale: Column, bias: Column, shift: Column, negative: Column) -> Column:
    """level * scale + scale / 2 (+ bias), shifted down, with the sign."""
    size = F.call_function("shiftright", level * scale + F.shiftright(scale, 1) + bias, shift.cast("int"))
    return F.when(negative, -size).otherwise(size)


def basis() -> list[list[float]]:
    """basis[x][u]: the cosine of the inverse transform, the constant one scaled by the root of a half."""
    return [[(math.sqrt(0.5) if u == 0 else 1.0) * math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)]


def idct(block: Column | str, depth: Column) -> Column:
    """64 samples of 64 coefficients (rows of u, v): rows first, then columns; a quarter of the sum, rounded and clamped to the depth."""
    c = basis()
    places = F.sequence(F.lit(0), F.lit(63))
    top = F.call_function("shiftleft", F.lit(1), depth.cast("int")) - 1
    rows = F.transform(places, lambda i: _row(column(block), i, c))
    # The rows are bound to a variable, so they are computed once.
    return F.get(F.transform(F.array(rows), lambda r: F.transform(places, lambda i: clamp(js_round(_col(r, i, c) / 4), top).cast("int"))), 0)


def _basis_at(c: list[list[float]], x: Column, u: Column) -> Column:
    flat = F.array(*(F.lit(v) for line in c for v in line))
    return F.get(flat, x * 8 + u)


def _row(b: Column, i: Column, c: list[list[float]]) -> Column:
    v, x = F.floor(i / 8).cast("int"), (i % 8).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, u: s + F.get(b, v * 8 + u).cast("double") * _basis_at(c, x, u))


def _col(rows: Column, i: Column, c: list[list[float]]) -> Column:
    y, x = F.floor(i / 8).cast("int"), (i % 8).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, v: s + F.get(rows, v * 8 + x) * _basis_at(c, y, v))


def idct_dc(dc: Column, depth: Column) -> Column:
    """The one value of a block of which only the constant term is set."""
    top = F.call_function("shiftleft", F.lit(1), depth.cast("int")) - 1
    return clamp(js_round(dc.cast("double") / 8), top).cast("int")


def chroma_420(top: Column, bottom: Column) -> Column:
    return F.shiftright(top + bottom + 1, 1)


def gbr_to_yuv(g: Column, b: Column, r: Column, depth: int, bt2020: bool = False) -> dict[str, Column]:
    """Limited-range luma and colour differences of full-range primaries."""
    kr, kb = (0.2627, 0.0593) if bt2020 else (0.2126, 0.0722)
    kg, top, scale = 1 - kr - kb, (1 << depth) - 1, 1 << (depth - 8)
    g, b, r = (x / F.lit(float(top)) for x in (g, b, r))
    luma = F.lit(kr) * r + F.lit(kg) * g + F.lit(kb) * b
    blue, red = (b - luma) / F.lit(2 * (1 - kb)), (r - luma) / F.lit(2 * (1 - kr))
    out = {"y": 16 * scale + F.lit(219.0 * scale) * luma, "cb": 128 * scale + F.lit(224.0 * scale) * blue, "cr": 128 * scale + F.lit(224.0 * scale) * red}
    return {k: clamp(js_round(x), top).cast("int") for k, x in out.items()}


def yuv_to_rgb(first: Column, second: Column, third: Column, depth: int, bt2020: bool = False, gbr: bool = False, rounded: bool = True) -> dict[str, Column]:
    """Display bytes of samples; with ``rounded`` off the unrounded values in 0..255."""
    scale = F.lit(1 / (1 << (depth - 8)))
    a, b, c = first * scale, second * scale, third * scale
    if gbr:
        out = {"r": c, "g": a, "b": b}
    else:
        cr_r, cb_g, cr_g, cb_b = (1.678674, -0.187326, -0.650424, 2.141772) if bt2020 else (1.792741, -0.213249, -0.532909, 2.112402)
        luma, cb, cr = F.lit(1.164383) * (a - 16), b - 128, c - 128
        out = {"r": luma + F.lit(cr_r) * cr, "g": luma + F.lit(cb_g) * cb + F.lit(cr_g) * cr, "b": luma + F.lit(cb_b) * cb}
    return {k: clamp(js_round(v) if rounded else v, 255).cast("int" if rounded else "double") for k, v in out.items()}


def yuv_to_rgb_native(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """Integer BT.709 of 8-bit samples."""
    l, b, r = 298 * (y - 16), cb - 128, cr - 128
    out = {"r": l + 459 * r, "g": l - 55 * b - 136 * r, "b": l + 541 * b}
    return {k: clamp(F.shiftright(v + 128, 8), 255).cast("int") for k, v in out.items()}


def depth_reduce(sample: Column, depth: int) -> Column:
    return F.shiftright(sample, depth - 8)


def chroma_size(fmt: Column | str, width: Column, height: Column) -> dict[str, Column]:
    f = column(fmt)
    full = F.startswith(f, F.lit("yuv444")) | F.startswith(f, F.lit("gbrp"))
    low = F.startswith(f, F.lit("yuv420"))
    return {
        "chroma_width": F.when(full, width).otherwise(F.ceil(width / 2)).cast("long"),
        "chroma_height": F.when(low, F.ceil(height / 2)).otherwise(height).cast("long"),
    }


def format_depth(fmt: Column | str) -> Column:
    """Bits of a planar YUV format, null for others."""
    f = column(fmt)
    return F.when(f.rlike("^yuv4(20|22|44)p(8|10|12)$"), F.regexp_extract(f, "p([0-9]+)$", 1).cast("int"))


def select_format(source: Column | str, allowed: Column | str) -> Column:
    """The source's own format if allowed; else for GBR its 4:4:4 form; else for 4:2:2 the first allowed planar format of its depth."""
    s, a = column(source), column(allowed)
    gbr = F.concat(F.lit("yuv444p"), F.substring(s, 5, 2))
    same = F.get(F.filter(a, lambda f: format_depth(f) == format_depth(s)), 0)
    return F.when(F.array_contains(a, s), s).when(F.startswith(s, F.lit("gbrp")), F.when(F.array_contains(a, gbr), gbr)).when(F.startswith(s, F.lit("yuv422")), same)
