"""Packets by position without a walk: from a file's end to its partitions, their index, and the place asked for.

Of a file are read its random index, the triplets of each partition before its essence, of these the
values of packs and index segments, and the keys from the entry of the first position asked for on.
What can't be had so (no random index, no index of the body, positions beyond it) has no rows; the
walk of ``demux`` finds it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from cinequery.operators import klv
from cinequery.operators.split_walk import starts

SCHEMA = "file {file}, body_sid long, position long, number long, value_offset long, value_length long, keyframe boolean"
#: Tags of an index segment's start, duration, unit size, body and entries.
START, DURATION, UNIT, BODY, ENTRIES = 0x3F0C, 0x3F0D, 0x3F05, 0x3F07, 0x3F0A


@dataclass
class Body:
    """What a file's partitions say of one body."""

    unit: int = 0
    units: int = 0  # positions that segments of a unit cover
    entries: dict[int, tuple[int, int]] = field(default_factory=dict)  # by position: place in the stream, flags
    parts: list[tuple[int, int, int]] = field(default_factory=list)  # place in the stream, of the first essence in the file, end in the file


def _entries(body: Body, items: dict[int, bytes]) -> None:
    n = lambda tag: int.from_bytes(items.get(tag, b""), "big")
    if n(UNIT):
        body.unit, body.units = n(UNIT), max(body.units, n(START) + n(DURATION))
        return
    array = items.get(ENTRIES, b"")
    count, size = int.from_bytes(array[:4], "big"), int.from_bytes(array[4:8], "big")
    if size >= 11 and 8 + count * size <= len(array):
        for k in range(count):
            e = array[8 + k * size : 19 + k * size]
            body.entries[n(START) + k] = int.from_bytes(e[3:11], "big"), e[2]


def bodies(source: klv.Reader) -> dict[int, Body]:
    """The bodies of a file by their number; none without a random index."""
    found: dict[int, Body] = {}
    begins = starts(source)
    if begins == [0]:
        return found
    for at, past in zip(begins, [*begins[1:], source.size], strict=True):
        body_sid = body_offset = 0
        while at < past and not isinstance(t := klv.triplet(source, at), str):
            key, _, value, length = t
            if key.startswith(klv.ESSENCE_PREFIXES):
                found.setdefault(body_sid, Body()).parts.append((body_offset, at, past))
                break
            if klv.is_partition(key) and length >= 80:
                pack = source.read(value, 80)
                body_offset, body_sid = int.from_bytes(pack[52:60], "big"), int.from_bytes(pack[60:64], "big")
            elif key == klv.INDEX_KEY and length <= klv.MAX_VALUE:
                items = {i["tag"]: i["value"] for i in reversed(klv.local_set(source.read(value, length)) or [])}
                _entries(found.setdefault(int.from_bytes(items.get(BODY, b""), "big"), Body()), items)
            at = value + length
    return found


def located(source: klv.Reader, first: int, past: int, shared: bool = False) -> Iterator[tuple]:
    """body_sid, position, track number, value offset and length, and keyframe, of the positions from ``first`` to below ``past``.

    A body's first element that is longer than a unit, or than its entries reach, holds all its
    packets; else the entries lead to the elements of each position. ``shared`` leaves out the latter:
    an element of one packet, also of a body of one position.
    """
    for body_sid, body in sorted(bodies(source).items()):
        if not body.parts:
            continue
        body.parts.sort()
        key, _, value, length = klv.triplet(source, body.parts[0][1])
        number = int(key[24:], 16)
        known = sorted(p for p in body.entries if p >= 0)
        if body.unit and length >= 2 * body.unit:
            for p in range(max(0, first), min(past, body.units or past, length // body.unit)):
                yield body_sid, p, number, value + p * body.unit, body.unit, None
        elif known and known[0] == 0 and length > (reach := body.entries[known[-1]][0] - body.entries[0][0]) > 0:
            for p in range(max(0, first), min(past, len(known))):
                place = body.entries[p][0] - body.entries[0][0]
                after = body.entries[p + 1][0] - body.entries[0][0] if p + 1 in body.entries else length
                yield body_sid, p, number, value + place, after - place, bool(body.entries[p][1] & 0x80)
        elif not shared:
            streams = [s for s, _, _ in body.parts]
            for p in known[bisect_right(known, first - 1) :]:
                if p >= past:
                    break
                stream, flags = body.entries[p]
                begin, at, end = body.parts[max(0, bisect_right(streams, stream) - 1)]
                ends = at + body.entries[p + 1][0] - begin if p + 1 in body.entries else end
                at += stream - begin
                while at < min(end, ends) and not isinstance(t := klv.triplet(source, at), str):
                    if t[0].startswith(klv.ESSENCE_PREFIXES):
                        yield body_sid, p, int(t[0][24:], 16), t[2], t[3], bool(flags & 0x80)
                    at = t[2] + t[3]


def packets(asked: DataFrame, shared: bool = False) -> DataFrame:
    """file, body_sid, position, number, value_offset, value_length, keyframe of the positions asked for: ``asked`` has file, first and past, and either payload or, as file, a path that all workers see. ``shared``: only packets whose element holds several."""
    held = "payload" in asked.columns
    columns = ["file", "first", "past", *(["payload"] if held else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cinequery.sources.media import File

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["file", "body_sid", "position", "number", "value_offset", "value_length", "keyframe"]
        for batch in batches:
            for k, (file, first, past) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if held and not batch.column(3)[k].is_valid:
                    continue
                source = klv.Bytes(batch.column(3)[k].as_py()) if held else File(file)
                try:
                    rows = [(file, *r) for r in located(source, first, past, shared)]
                finally:
                    if not held:
                        source.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, *types], strict=True)], names=names)

    return asked.select(*columns).mapInArrow(run, SCHEMA.format(file=asked.schema["file"].dataType.simpleString()))
