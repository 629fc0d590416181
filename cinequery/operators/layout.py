"""Planes in buffers: copy layouts, field order, block places and interleaved audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve(planes: DataFrame, key: str) -> DataFrame:
    """Packed places of planes (key, plane, row_bytes, height): each begins where the one before ends; ``overlaps`` marks planes that begin before another ends."""
    w = Window.partitionBy(key).orderBy("plane")
    size = F.col("row_bytes") * F.col("height")
    placed = planes.select(key, "plane", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("offset"), F.col("row_bytes").alias("stride"), size.alias("byte_length"))
    by_place = Window.partitionBy(key).orderBy("offset")
    return placed.withColumn("overlaps", F.coalesce(F.lag(F.col("offset") + F.col("byte_length")).over(by_place) > F.col("offset"), F.lit(False)))


def bob(rows: DataFrame, frame: str, row: str, value: str, height: int, parity: int) -> DataFrame:
    """Each row of a frame shown from one field only: row r takes line min(n - 1, r / 2) * 2 + parity."""
    n = height // 2
    source = rows.select(frame, row, (F.least(F.lit(n - 1).cast("long"), F.expr(f"{row} div 2")) * 2 + parity).alias("source"))
    lines = rows.select(frame, F.col(row).alias("source"), value)
    return source.join(lines, [frame, "source"]).select(frame, row, "source", value)


def weave(fields: DataFrame, frame: str, row: str, parity: str) -> DataFrame:
    """Lines of both fields of a frame in their places: line r of field p becomes row 2r + p."""
    return fields.withColumn(row, F.col(row) * 2 + F.col(parity)).drop(parity)


def place(block: str, macroblock: str, mb_row: str, i: str) -> dict[str, Column]:
    """Plane and coordinates of coefficient ``i`` of a 4:2:2 macroblock's blocks: two of luma side by side, then one of each chroma."""
    b, mb = F.col(block), F.col(macroblock)
    return {
        "plane": F.when(b < 2, "Y").when(b == 2, "Cb").otherwise("Cr"),
        "x": F.when(b < 2, mb * 16 + b * 8).otherwise(mb * 8) + F.col(i) % 8,
        "y": F.col(mb_row) * 16 + F.expr(f"{i} div 8"),
    }


def deinterleave(packets: DataFrame, key: str, channels: int, partial: str) -> DataFrame:
    """key, frame, channel, v of 16-bit little-endian packets (key, payload). A partial last frame either rejects the packet or is dropped ("floor")."""
    width = 2 * channels
    rows = packets.where(F.octet_length("payload") % width == 0) if partial == "reject" else packets
    # The payload is cut into words before it is exploded, so no row carries it along.
    words = F.slice(F.regexp_extract_all(F.hex("payload"), F.lit(".{4}"), 0), 1, F.expr(f"CAST(octet_length(payload) div {width} * {channels} AS INT)"))
    words = rows.select(key, F.posexplode(words).alias("i", "word"))
    raw = F.conv(F.concat(F.substring("word", 3, 2), F.substring("word", 1, 2)), 16, 10).cast("int")
    v = F.when(raw >= 32768, raw - 65536).otherwise(raw).cast("double") / 32768
    return words.select(key, F.expr(f"i div {channels}").alias("frame"), (F.col("i").cast("long") % channels).alias("channel"), v.alias("v"))
