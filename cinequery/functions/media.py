"""Timecode, clocks, playback decisions, probing and error classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinequery.functions.binary import column


def timecode(edit_unit: Column | str, start: Column, origin: Column, base: Column, drop: Column) -> Column:
    """hours, minutes, seconds, frames and the text of an edit unit, wrapping at 24 hours also below zero; null for a base below 1 or a drop-frame base other than 30 or 60."""
    b = base.cast("long")
    skip = F.when(drop, F.when(b == 60, 4).otherwise(2)).otherwise(0).cast("long")
    ten = b * 600 - skip * 9
    day = F.when(drop, ten * 144).otherwise(b * 86400)
    shown = F.pmod(start + origin + column(edit_unit), day)
    div = lambda a, n: F.floor(a / n).cast("long")
    rest = shown % ten
    jumped = shown + skip * 9 * div(shown, ten) + F.when(rest >= skip, skip * div(rest - skip, b * 60 - skip)).otherwise(0)
    f = F.when(drop, jumped).otherwise(shown)
    h, m, s, k = div(f, b * 3600), div(f, b * 60) % 60, div(f, b) % 60, f % b
    text = F.format_string("%02d:%02d:%02d%s%02d", h, m, s, F.when(drop, ";").otherwise(":"), k)
    ok = (b >= 1) & (~drop | b.isin(30, 60))
    return F.when(ok, F.struct(h.alias("hours"), m.alias("minutes"), s.alias("seconds"), k.alias("frames"), text.alias("formatted")))


def decision(timestamp: Column, now: Column, tolerance: Column | float = 1 / 60) -> Column:
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    drift = timestamp - now
    return F.when(drift < -t, "drop").when(drift > t, "hold").otherwise("present")


def clock_time(running: Column, paused: Column, media_anchor: Column, clock_anchor: Column, now: Column, duration: Column) -> Column:
    """Media time of a clock: paused where it stands, else on from its anchor, within 0 and the duration."""
    moved = media_anchor + F.greatest(F.lit(0.0), now - clock_anchor)
    return F.when(running, F.greatest(F.lit(0.0), F.least(duration, moved))).otherwise(paused)


def confidence(extension: Column, atom: Column, entry: Column, header: Column) -> Column:
    return F.when(entry | header, 0.95).when(extension & atom, 0.65).when(extension, 0.35).otherwise(0.1)


def error_class(name: Column | str, message: Column | str) -> Column:
    """Out of memory before unexpected end before invalid data; a range error anywhere counts as the first."""
    n, m = column(name), F.lower(column(message))
    memory = n.isin("OutOfMemoryError", "RangeError") | m.rlike("out of memory|allocation failed")
    ended = (n == "UnexpectedEofError") | m.rlike("unexpected end|ended before|outside the packet|smaller than")
    return F.when(memory, "out-of-memory").when(ended, "unexpected-eof").otherwise("invalid-data")


def color_or(value: Column | str, allowed: list[str], fallback: Column) -> Column:
    return F.coalesce(F.when(column(value).isin(allowed), column(value)), fallback)


def fourcc(codec: Column | str) -> Column:
    """AVdn or AVdh in any case, else null."""
    c = F.lower(column(codec))
    return F.when(c == "avdn", "AVdn").when(c == "avdh", "AVdh")


def pcm_supported(rate_num: Column, rate_den: Column, channels: Column, layout: Column, label: Column) -> Column:
    return F.coalesce((rate_num > 0) & (rate_den > 0) & (channels > 0) & layout.isNotNull() & F.startswith(label, F.lit("060e2b34040101010d0103010206")), F.lit(False))


def frame_duration_us(override: Column, num: Column, den: Column) -> Column:
    """A given duration, that of the rate, or that of 30 frames a second, in rounded microseconds."""
    given = F.when(override > 0, F.floor(override + 0.5))
    rate = F.when((num > 0) & (den > 0), F.floor(den * 1_000_000 / num + 0.5))
    return F.coalesce(given, rate, F.lit(33333)).cast("long")


def timestamp_us(given: Column, index: Column) -> Column:
    """A packet's own time in seconds, or else its place at 30 frames a second, in rounded microseconds."""
    return F.coalesce(F.floor(given * 1_000_000 + 0.5), F.floor(index.cast("double") * 1_000_000 / 30 + 0.5))
