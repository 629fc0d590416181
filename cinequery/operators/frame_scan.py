"""Frames in raw bytes: each frame's header tells its size, so a file is walked in order, and files go in parallel.

A large file is cut into chunks instead (``scan_chunks``): each chunk's places that can begin a frame
are found apart, each knows the next place after its frame, and the frames of the walk are those that
the first place leads to, which doubling the steps finds in as many rounds as their number has bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.functions.binary import cut
from cinequery.functions.header import HEADER_BYTES, PROFILES
from cinequery.operators.settle import settled
from cinequery.operators.stats import carried, running

_SIZES = {p[0]: p for p in PROFILES}
_DEPTHS = {1: 8, 2: 10, 3: 12}


#: The first bytes of a header, wherever they stand.
PREFIX = re.compile(rb"(?=\x00\x00(?:\x02\x80[\x01\x02\x03]|[\x02-\x21].\x03))", re.DOTALL)
#: Bytes of a chunk.
CHUNK = 4 << 20


def is_header(head: bytes) -> bool:
    """Whether a frame's header begins here, of a known profile or not."""
    if len(head) < HEADER_BYTES:
        return False
    offset = int.from_bytes(head[:4], "big")
    classic = offset == HEADER_BYTES and head[4] in (1, 2)
    high = head[4] == 3 and head[:2] == b"\0\0" and HEADER_BYTES <= offset <= 0x2170 and offset % 4 == 0
    return (classic or high) and head[0x21] >> 5 in _DEPTHS and any(head[0x18:0x1A]) and any(head[0x1A:0x1C])


def headers(data: bytes, limit: int | None = None) -> Iterator[int]:
    """The places of headers within the first ``limit`` bytes, also those that others reach over."""
    end = len(data) if limit is None else min(len(data), limit)
    for hit in PREFIX.finditer(data, 0, end):
        if hit.start() + HEADER_BYTES > end:
            return
        if is_header(data[hit.start() : hit.start() + HEADER_BYTES]):
            yield hit.start()


def expected_size(head: bytes) -> int | None:
    """The size of the frame whose header begins here; null if none does or its profile is unknown."""
    if not is_header(head):
        return None
    field_height, encoded_width = int.from_bytes(head[0x18:0x1A], "big"), int.from_bytes(head[0x1A:0x1C], "big")
    profile = _SIZES.get(int.from_bytes(head[0x28:0x2C], "big"))
    if profile is None:
        return None
    _, _, width, height, size, unit, _, _, num, den = profile
    if head[6] >> 5 & 1:
        return unit
    if size is not None:
        return size
    height = height if head[5] & 2 and height else field_height
    blocks = -(-(width or encoded_width) // 16) * -(-height // 16)
    return (blocks * num // den + 2048) // 4096 * 4096


def frames(data: bytes, max_frames: int | None = None) -> Iterator[tuple[int, int]]:
    """Offset and length of contiguous frames; after a miss the search goes on at the next byte that can begin one."""
    at, found = 0, 0
    while at <= len(data) - HEADER_BYTES and (max_frames is None or found < max_frames):
        size = expected_size(data[at : at + HEADER_BYTES])
        if size and at + size <= len(data):
            yield at, size
            at, found = at + size, found + 1
        elif (at := data.find(b"\0\0", at + 1)) < 0:
            return


def scan(files: DataFrame, max_frames: int | None = None) -> DataFrame:
    """file, ord, offset, byte_length of the frames of each (file, payload) row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [*frames(payload.as_py(), max_frames)] if payload.is_valid else []
                if found:
                    offset, length = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), batch.schema.field(0).type), pa.array(range(len(found)), pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["file", "ord", "offset", "byte_length"])

    return files.select("file", "payload").mapInArrow(walk, f"file {files.schema['file'].dataType.simpleString()}, ord long, offset long, byte_length long")


def chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """file, start, size (of the file), bytes: each file's payload in chunks that reach over the next one's begin by a header less a byte."""
    n = F.octet_length("payload").cast("long")
    parts = files.where(F.octet_length("payload") > 0).select("file", "payload", n.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("start"))
    return parts.select("file", "start", "size", cut("payload", F.col("start"), size + HEADER_BYTES - 1).alias("bytes"))


def candidates(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """file, offset, byte_length of all places of chunks at which a whole frame of a known profile can begin."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (file, start, whole) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                data = batch.column(3)[k].as_py()
                rows = [(start + at, n) for at in headers(data) if at < size and (n := expected_size(data[at : at + HEADER_BYTES])) and start + at + n <= whole]
                if rows:
                    offset, length = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), batch.schema.field(0).type), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["file", "offset", "byte_length"])

    return parts.select("file", "start", "size", "bytes").mapInArrow(found, f"file {parts.schema['file'].dataType.simpleString()}, offset long, byte_length long")


def chained(places: DataFrame, bucket: int = 64 << 20) -> DataFrame:
    """Of candidates (file, offset, byte_length) those that a walk from each file's first one meets: after a frame the next place at or past its end."""
    places = settled(places)
    # Backwards, the next place at or past an end is the last one met before it.
    begins = places.select("file", (-F.col("offset")).alias("back"), F.lit(0).alias("side"), F.col("offset").alias("place"), F.lit(None).cast("long").alias("of"))
    ends = places.select("file", (-(F.col("offset") + F.col("byte_length"))).alias("back"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("place"), F.col("offset").alias("of"))
    jumps = carried(begins.unionByName(ends), ["file"], ["back", "side"], "place", "next", bucket).where("side = 1 AND next IS NOT NULL")
    jumps = settled(jumps.select("file", F.col("of").alias("offset"), "next"))
    met = settled(places.groupBy("file").agg(F.min("offset").alias("offset")))
    while not (further := settled(met.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset")))).isEmpty():
        met = settled(met.unionByName(further))
        then = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        jumps = settled(jumps.join(then, ["file", "next"]).select("file", "offset", F.col("far").alias("next")))
    return places.join(met, ["file", "offset"])


def scan_chunks(parts: DataFrame, size: int = CHUNK, bucket: int = 64 << 20) -> DataFrame:
    """The rows of ``scan``, of files given in chunks (``chunks``): no task reads a whole file."""
    frames_ = chained(candidates(parts, size), bucket)
    numbered = running(frames_, ["file"], "offset", F.lit(1).cast("long"), "ord", bucket)
    return numbered.select("file", (F.col("ord") - 1).alias("ord"), "offset", "byte_length")
