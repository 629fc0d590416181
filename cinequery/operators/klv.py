"""Walks over key-length-value bytes. Lengths chain the triplets, so a file is walked in order; files go in parallel."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: The first bytes of every key, and of essence and partition keys; the primer's and the random index's key.
KEY_PREFIX = bytes.fromhex("060e2b34")
ESSENCE_PREFIXES = ("060e2b34010201010d010301", "060e2b34010201010e040301", "060e2b340102010a0e0f0301")
PARTITION_PREFIX = "060e2b34020501010d01020101"
PRIMER_KEY = "060e2b34020501010d01020101050100"
RANDOM_INDEX_KEY = "060e2b34020501010d01020101110100"
INDEX_KEY = "060e2b34025301010d01020101100100"
#: The keys of metadata sets and their types.
SET_TYPES = {
    "060e2b34025301010d01010101012f00": "Preface",
    "060e2b34025301010d01010101013000": "Identification",
    "060e2b34025301010d01010101011800": "ContentStorage",
    "060e2b34025301010d01010101013700": "SourcePackage",
    "060e2b34025301010d01010101013600": "MaterialPackage",
    "060e2b34025301010d01010101010f00": "Sequence",
    "060e2b34025301010d01010101011100": "SourceClip",
    "060e2b34025301010d01010101014400": "MultipleDescriptor",
    "060e2b34025301010d01010101014200": "GenericSoundDescriptor",
    "060e2b34025301010d01010101012800": "CDCIDescriptor",
    "060e2b34025301010d01010101012900": "RGBADescriptor",
    "060e2b34025301010d01010101014800": "WaveAudioDescriptor",
    "060e2b34025301010d01010101014700": "AES3AudioDescriptor",
    "060e2b34025301010d01010101015100": "MpegVideoDescriptor",
    "060e2b34025301010d01010101013a00": "StaticTrack",
    "060e2b34025301010d01010101013b00": "Track",
    "060e2b34025301010d01010101011400": "TimecodeComponent",
    "060e2b34025301010d01010101012300": "EssenceContainerData",
    INDEX_KEY: "IndexTableSegment",
}
#: Bytes of a track's first element that are kept, as many as a frame header has, and of a metadata value that are read at most.
HEAD, MAX_VALUE = 0x280, 64 << 20
#: Bytes of values of a batch.
BATCH_BYTES = 16 << 20
SCHEMA = "file {file}, ord long, offset long, key_hex string, length_field_length int, value_offset long, value_length long, next_offset long, error string"


class Reader(Protocol):
    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class Bytes:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


def triplet(source: Reader, offset: int) -> tuple[str, int, int, int] | str:
    """Key, length-field length, value offset and length of the triplet at ``offset``; a string says what is wrong with it."""
    head = source.read(offset, min(25, source.size - offset))
    if len(head) < 17:
        return "truncated key"
    key, first = head[:16].hex(), head[16]
    if first < 0x80:
        field, length = 1, first
    else:
        n = first & 0x7F
        if n == 0:
            return "indefinite length"
        if n > 8:
            return "length field too long"
        if len(head) < 17 + n:
            return "truncated length"
        field, length = 1 + n, int.from_bytes(head[17 : 17 + n], "big")
        if length > (1 << 53) - 1:
            return "length beyond safe integers"
    if offset + 16 + field + length > source.size:
        return "value past the end"
    return key, field, offset + 16 + field, length


def resync(source: Reader, offset: int, limit: int, chunk: int = 1 << 16) -> int | None:
    """The next place of KEY_PREFIX at or after ``offset``, within ``limit`` bytes."""
    end = min(source.size, offset + limit)
    at = offset
    while at < end:
        part = source.read(at, min(chunk + 3, end - at))
        if (hit := part.find(KEY_PREFIX)) >= 0:
            return at + hit
        at += chunk
    return None


def walk(source: Reader, max_resync: int = 16 << 20, start: int = 0) -> Iterator[tuple]:
    """Rows (offset, key, field length, value offset, value length, next offset, error) in order, from ``start`` on. What is no triplet gives an error row and a search for the next key; values are never read."""
    offset = start
    while offset < source.size:
        if source.read(offset, 4) == KEY_PREFIX:
            found = triplet(source, offset)
            if not isinstance(found, str):
                key, field, value, length = found
                yield offset, key, field, value, length, value + length, None
                offset = value + length
                continue
            error = found
        else:
            error = "no key"
        after = resync(source, offset + 1, max_resync)
        yield offset, None, None, None, None, after, error
        if after is None:
            return
        offset = after


#: What ``contents`` gives besides: a pack's value or a track's first bytes, a set's items, the body_sid here, and the ordinal in the track.
CONTENT = "value binary, items array<struct<tag:int,value:binary>>, body_sid long, element long"


def is_partition(key: str) -> bool:
    return key.startswith(PARTITION_PREFIX) and key[26:28] in ("02", "03", "04")


def contents(source: Reader, max_resync: int = 16 << 20, max_value: int = MAX_VALUE, start: int = 0) -> Iterator[tuple]:
    """The rows of ``walk`` with what a container's metadata says: values of packs, items of sets, and of essence the body and the ordinal in its track; of a track's first element its first HEAD bytes.

    What cannot be read is an error on its row: a value over ``max_value`` or a set whose items don't
    fit. Keys that are neither packs nor in SET_TYPES are passed over unread.
    """
    body_sid, elements = 0, {}
    for offset, key, field, at, length, after, error in walk(source, max_resync, start):
        value = items = element = None
        if key is None:
            pass
        elif key.startswith(ESSENCE_PREFIXES):
            track = body_sid, key[24:]
            element = elements.get(track, 0)
            elements[track] = element + 1
            if not element:
                value = source.read(at, min(HEAD, length))
        elif (pack := is_partition(key) or key in (PRIMER_KEY, RANDOM_INDEX_KEY)) or key in SET_TYPES:
            if length > max_value:
                error = "metadata value over the limit"
            elif pack:
                value = source.read(at, length)
                if is_partition(key):
                    if length < 80:
                        error = "partition pack cut short"
                    else:
                        body_sid = int.from_bytes(value[60:64], "big")
            else:
                items = local_set(source.read(at, length))
                error = "set items don't fit" if items is None else None
        yield offset, key, field, at, length, after, error, value, items, body_sid, element


def local_set(value: bytes) -> list[dict] | None:
    """Items (tag, length, value) of a local set; null if one runs past the end or bytes trail."""
    items, at, size = [], 0, len(value)
    while at + 4 <= size:
        tag, n = struct.unpack_from(">HH", value, at)
        at += 4
        if at + n > size:
            return None
        items.append({"tag": tag, "value": value[at : at + n]})
        at += n
    return items if at == size else None


NAMES = ["file", "ord", "offset", "key_hex", "length_field_length", "value_offset", "value_length", "next_offset", "error"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
CONTENT_NAMES = ["value", "items", "body_sid", "element"]
CONTENT_TYPES = [pa.binary(), pa.list_(pa.struct([("tag", pa.int32()), ("value", pa.binary())])), pa.int64(), pa.int64()]


def item_lists(rows: list[list[dict] | None]) -> pa.Array:
    """Items of sets as an array, from their flat columns."""
    flat = [i for row in rows if row for i in row]
    ends = [0, *accumulate(len(row or ()) for row in rows)]
    items = pa.StructArray.from_arrays([pa.array([i["tag"] for i in flat], pa.int32()), pa.array([i["value"] for i in flat], pa.binary())], ["tag", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([row is None for row in rows]))


def batches_of(rows: Iterator[tuple], kind: pa.DataType, more: tuple[str, ...] = (), size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows and about BATCH_BYTES of values, of rows of any number of files: file, ordinal, what a walk gives, and the whole numbers ``more``."""
    part, held = [], 0

    def batch() -> pa.RecordBatch:
        width = len(part[0]) - len(more)
        types = [kind, *TYPES, *CONTENT_TYPES][:width] + [pa.int64()] * len(more)
        names = [*NAMES, *CONTENT_NAMES][:width] + list(more)
        return pa.RecordBatch.from_arrays([item_lists(list(c)) if n == "items" else pa.array(c, t) for n, c, t in zip(names, zip(*part, strict=True), types, strict=True)], names=names)

    for row in rows:
        part.append(row)
        if len(row) - len(more) > len(TYPES) + 1 and (row[9] or row[10]):
            held += row[6]
        if len(part) == size or held > BATCH_BYTES:
            yield batch()
            part, held = [], 0
    if part:
        yield batch()


def scan(files: DataFrame, max_resync: int = 16 << 20, with_contents: bool = False) -> DataFrame:
    """The triplets of each (file, payload) row, in order of offset; rows with an error mark where the walk had to search. Null payloads have none. ``with_contents`` adds what ``contents`` reads in the same pass."""
    over = contents if with_contents else walk

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            rows = ((file, ordinal, *row) for file, payload in given if payload.is_valid for ordinal, row in enumerate(over(Bytes(payload.as_py()), max_resync)))
            yield from batches_of(rows, batch.schema.field(0).type)

    schema = SCHEMA.format(file=files.schema["file"].dataType.simpleString()) + (f", {CONTENT}" if with_contents else "")
    return files.select("file", "payload").mapInArrow(walk_all, schema)


def payloads(files: DataFrame, max_resync: int = 16 << 20) -> DataFrame:
    """file, ord and the value of each triplet of (file, payload) rows, cut where the file is walked: no file's bytes are copied for its packets. A batch holds about BATCH_BYTES, or one value."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not payload.is_valid:
                    continue
                source, part, held = Bytes(payload.as_py()), [], 0
                for ordinal, row in enumerate(walk(source, max_resync)):
                    if row[1] is None:
                        continue
                    if part and held + row[4] > BATCH_BYTES:
                        yield made(batch, part)
                        part, held = [], 0
                    part.append((file, ordinal, source.read(row[3], row[4])))
                    held += row[4]
                if part:
                    yield made(batch, part)

    def made(batch: pa.RecordBatch, part: list[tuple]) -> pa.RecordBatch:
        types = [batch.schema.field(0).type, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=["file", "ord", "payload"])

    return files.select("file", "payload").mapInArrow(cut_all, f"file {files.schema['file'].dataType.simpleString()}, ord long, payload binary")


def local_sets(sets: DataFrame) -> DataFrame:
    """``sets`` (id, payload) with items: array of (tag, value), null where malformed."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [local_set(p) if p is not None else None for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, CONTENT_TYPES[1])], names=["id", "items"])

    return sets.select("id", "payload").mapInArrow(parse, f"id {sets.schema['id'].dataType.simpleString()}, items array<struct<tag:int,value:binary>>")
