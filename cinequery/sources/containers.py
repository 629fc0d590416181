"""Whole container files synthesised from customers and their orders: packs, primer, metadata sets, index and essence.

A file is a customer, k its key. Each order is a frame of video and mostly a packet of audio. What a
file holds follows from remainders of k, given here as SQL that Spark and the counterparts share, so
that these can tell sizes and places without a look at the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.operators.container import SET_TYPES
from cinequery.operators.klv import BATCH_BYTES, INDEX_KEY, PRIMER_KEY, RANDOM_INDEX_KEY
from cinequery.sources.tables import read

KEYS = {name: key for key, name in SET_TYPES.items()}
PARTITION = "060e2b34020501010d01020101{:02x}0400"
VIDEO, AUDIO, DATA = 0x15010501, 0x16010101, 0x17010101
ESSENCE = "060e2b34010201010d010301{:08x}"
#: What a file is, as SQL over k and n, its number of orders.
UNIT = "k % 6 = 0"  # one video element of equal units
CLIP = "k % 6 = 1"  # one video element cut by its index entries
HAS_AUDIO = "k % 5 <> 1 AND k % 3 <> 1"
HAS_DATA = "k % 5 <> 1 AND k % 8 = 5"
HAS_LINK = "k % 11 <> 0"
NESTED = "k % 3 = 0"
ONE_DESCRIPTOR = "k % 4 = 0"
NO_SOURCE = "k % 7 = 0"
NO_FRAME = "k % 9 = 4"
NTSC = "k % 2 = 1"
WRONG_THIS, WRONG_RIP = "k % 17 = 0", "k % 13 = 0"
FRAME_BYTES = f"CASE WHEN {UNIT} THEN 700 WHEN {NO_FRAME} THEN 64 + o % 50 ELSE 640 + o % 50 END"
AUDIO_BYTES = "4 * (o % 20 + 1)"
LABEL = {"op1a": "060e2b34040101010d01020101010900", "opatom": "060e2b34040101020d01020110010000", "other": "060e2b34040101010d01020301010900"}
VIDEO_KIND, AUDIO_KIND, TIMECODE_KIND = (f"060e2b3404010101{tail}" for tail in ("0103020201000000", "0103020202000000", "0103020101000000"))
#: Bytes of a partition pack's triplet with one essence container.
PACK_BYTES = 20 + 104
#: Bytes of the random index's triplet, which are also its last number.
RIP_BYTES = 20 + 3 * 12 + 4


def expr(sql: str) -> Column:
    return F.expr(sql.replace("//", "div"))


#: Parts of a value: bytes, or a number as SQL with its bytes; NAME stands for the customer's name.
Parts = tuple[bytes | str | tuple[str, int], ...]
NAME = "name"


def uid(kind: int | str, k: str = "k") -> Parts:
    """A set's or package's own 16 bytes."""
    return number(str(kind), 1) + number(k, 15)


def uid_sql(kind: int) -> str:
    """A set's or package's own bytes as hex, in either SQL."""
    return f"concat('{kind:02x}', lpad(lower(hex(k)), 30, '0'))"


def number(sql: str, size: int) -> Parts:
    return (int(sql).to_bytes(size, "big"),) if sql.isdigit() else ((sql, size),)


def references(*kinds: int) -> Parts:
    return sum((uid(kind) for kind in kinds), number(str(len(kinds)), 4) + number("16", 4))


def rational(num: str, den: str) -> Parts:
    return number(num, 4) + number(den, 4)


RATE = rational(f"CASE WHEN {NTSC} THEN 30000 ELSE 25 END", f"CASE WHEN {NTSC} THEN 1001 ELSE 1 END")
Item = tuple[int, Parts, str]


def sets() -> list[tuple[str, str, list[Item]]]:
    """Type, condition and items (tag, value, size as SQL) of the metadata sets in the order of the file. The first item is the set's own uid."""
    own = lambda kind: (0x3C0A, uid(kind), "16")
    ref = lambda tag, kind: (tag, uid(kind), "16")
    refs = lambda tag, *kinds: (tag, references(*kinds), str(8 + 16 * len(kinds)))
    u32 = lambda tag, sql: (tag, number(sql, 4), "4")
    i64 = lambda tag, sql: (tag, number(sql, 8), "8")
    label = lambda tag, hexes: (tag, (bytes.fromhex(hexes),), "16")
    name = lambda tag: (tag, (NAME,), "2 * length(c_name)")
    rate = (0x4B01, RATE, "8")
    audio_rate = (0x4B01, rational("48000", "1"), "8")
    return [
        ("Preface", "true", [own(0x01)]),
        ("MaterialPackage", "true", [own(0x02), ref(0x4401, 0x72), name(0x4402), refs(0x4403, 0x03, 0x04)]),
        ("Track", "true", [own(0x03), u32(0x4801, "1"), u32(0x4804, "0"), rate, i64(0x4B02, "0"), ref(0x4803, 0x05)]),
        ("Sequence", f"NOT ({NESTED})", [own(0x05), label(0x0201, VIDEO_KIND), i64(0x0202, "n"), refs(0x1001, 0x07)]),
        ("Sequence", NESTED, [own(0x05), label(0x0201, VIDEO_KIND), i64(0x0202, "n"), refs(0x1001, 0x06)]),
        ("Sequence", NESTED, [own(0x06), label(0x0201, VIDEO_KIND), i64(0x0202, "n"), refs(0x1001, 0x07, 0x08)]),
        ("SourceClip", "true", [own(0x07), label(0x0201, VIDEO_KIND), i64(0x0202, "n"), i64(0x1201, "k % 10"), (0x1101, uid(f"CASE WHEN {NO_SOURCE} THEN 0 ELSE {0x73} END", f"CASE WHEN {NO_SOURCE} THEN 0 ELSE k END"), "16"), u32(0x1102, "2")]),
        ("SourceClip", NESTED, [own(0x08), label(0x0201, AUDIO_KIND), i64(0x0202, "n"), ref(0x1101, 0x73), u32(0x1102, "3")]),
        ("Track", "true", [own(0x04), u32(0x4801, "9"), u32(0x4804, "0"), rate, ref(0x4803, 0x09)]),
        ("Sequence", "true", [own(0x09), label(0x0201, TIMECODE_KIND), i64(0x0202, "n"), refs(0x1001, 0x0F, 0x0A)]),
        ("TimecodeComponent", "true", [own(0x0A), i64(0x1501, "k * 25"), (0x1502, number(f"CASE WHEN {NTSC} THEN 30 ELSE 25 END", 2), "2"), (0x1503, number(f"CASE WHEN {NTSC} THEN 1 ELSE 0 END", 1), "1")]),
        ("SourcePackage", "true", [own(0x10), ref(0x4401, 0x73), refs(0x4403, 0x11, 0x12), (0x4701, uid(f"CASE WHEN {ONE_DESCRIPTOR} THEN {0x14} ELSE {0x13} END"), "16")]),
        ("Track", "true", [own(0x11), u32(0x4801, "2"), u32(0x4804, str(VIDEO)), rate, i64(0x4B02, "k % 4"), name(0x4802), ref(0x4803, 0x15)]),
        ("Track", "true", [own(0x12), u32(0x4801, "3"), u32(0x4804, str(AUDIO)), audio_rate, ref(0x4803, 0x15)]),
        ("Sequence", "true", [own(0x15), label(0x0201, VIDEO_KIND), i64(0x0202, "n")]),
        ("MultipleDescriptor", f"NOT ({ONE_DESCRIPTOR})", [own(0x13), refs(0x3F01, 0x14, 0x16)]),
        ("CDCIDescriptor", "true", [own(0x14), u32(0x3006, "2"), label(0x3004, VIDEO_KIND), label(0x3201, LABEL["op1a"]), u32(0x3203, "1920 - k % 3 * 640"), u32(0x3202, "1080"), (0x320E, rational("16", "9"), "8"), u32(0x3301, "8 + k % 2 * 2"), u32(0x3302, "2"), u32(0x3308, "1"), i64(0x3002, "n")]),
        ("WaveAudioDescriptor", "true", [own(0x16), u32(0x3006, "3"), (0x3D03, rational("48000", "1"), "8"), u32(0x3D07, "2"), u32(0x3D01, "16 + k % 2 * 4"), (0x3D0A, number("4 + k % 3", 2), "2")]),
        ("EssenceContainerData", HAS_LINK, [own(0x17), ref(0x2701, 0x73), u32(0x3F07, "1")]),
    ]


#: Tags that the primer names, and the bytes of its triplet.
TAGS = (0x3C0A, 0x4401, 0x4801, 0x4B01)
PRIMER_BYTES = 20 + 8 + 18 * len(TAGS)


def header_bytes() -> str:
    """SQL: bytes before the body partition."""
    return " + ".join([str(PACK_BYTES + PRIMER_BYTES), *(f"CASE WHEN {when} THEN 20 + {' + '.join(f'4 + {size}' for _, _, size in items)} ELSE 0 END" for _, when, items in sets())])


def index_bytes() -> str:
    """SQL: bytes of the index segments: one of units, or two with an entry for each frame."""
    fixed = "20 + 20 + 12 + 12 + 12 + 8 + 8 + 8"
    return f"CASE WHEN {UNIT} THEN {fixed} ELSE 2 * ({fixed} + 12) + 11 * n END"


def _item(tag: int, value: bytes) -> bytes:
    return tag.to_bytes(2, "big") + len(value).to_bytes(2, "big") + value


def _triplet(key: bytes, value: bytes) -> bytes:
    return key + b"\x83" + len(value).to_bytes(3, "big") + value


def _segment(kind: int, k: int, rate: bytes, start: int, duration: int, unit: int, entries: bytes | None) -> bytes:
    small, long = (lambda v: v.to_bytes(4, "big")), (lambda v: v.to_bytes(8, "big"))
    items = [(0x3C0A, bytes([kind]) + k.to_bytes(15, "big")), (0x3F0B, rate), (0x3F0C, long(start)), (0x3F0D, long(duration)), (0x3F05, small(unit)), (0x3F06, small(2)), (0x3F07, small(1))]
    if entries is not None:
        items.append((0x3F0A, small(len(entries) // 11) + small(11) + entries))
    return _triplet(bytes.fromhex(INDEX_KEY), b"".join(_item(*i) for i in items))


def frame_header() -> str:
    """Hex of a frame header that parses: progressive, 8 bits, 1920 by 1080."""
    head = bytearray(0x280)
    head[0:5] = (0x280).to_bytes(4, "big") + b"\x01"
    head[0x18:0x1C] = (1080).to_bytes(2, "big") + (1920).to_bytes(2, "big")
    head[0x21] = 0x20
    head[0x28:0x2C] = (1253).to_bytes(4, "big")
    head[0x16C:0x16E] = (68).to_bytes(2, "big")
    return head.hex()


def numbers() -> list[str]:
    """The numbers in the sets' values and the sets' conditions that are not constant, as SQL that Spark works out for each file."""
    values = [p[0] for _, _, items in sets() for _, parts, _ in items for p in parts if isinstance(p, tuple)]
    return sorted({*values, *(p[0] for p in RATE if isinstance(p, tuple)), *(when for _, when, _ in sets() if when != "true")})


class Metadata:
    """Writes a file's primer and sets from the values of ``numbers``."""

    def __init__(self):
        place = {sql: i for i, sql in enumerate(numbers())}
        located = lambda parts: [(place[p[0]], p[1]) if isinstance(p, tuple) else p for p in parts]
        entries = b"".join(t.to_bytes(2, "big") + t.to_bytes(16, "big") for t in TAGS)
        self.primer = _triplet(bytes.fromhex(PRIMER_KEY), len(TAGS).to_bytes(4, "big") + (18).to_bytes(4, "big") + entries)
        self.rate = located(RATE)
        self.sets = [(bytes.fromhex(KEYS[kind]), place.get(when), [(tag, located(parts)) for tag, parts, _ in items]) for kind, when, items in sets()]

    def head(self, values: list[int], name: bytes) -> tuple[bytes, bytes]:
        """Primer and sets, and the edit rate's bytes."""
        known: dict[tuple[int, int] | bytes | str, bytes] = {NAME: name}

        def put(parts: list) -> bytes:
            for p in parts:
                if p not in known:
                    known[p] = values[p[0]].to_bytes(p[1], "big") if isinstance(p, tuple) else p
            return b"".join([known[p] for p in parts])

        out = [self.primer]
        for key, when, items in self.sets:
            if when is None or values[when]:
                out.append(_triplet(key, b"".join([_item(tag, put(parts)) for tag, parts in items])))
        return b"".join(out), put(self.rate)


#: The conditions on k that Spark works out for each file.
FLAGS = {"unit": UNIT, "clip": CLIP, "no_frame": NO_FRAME, "audio": HAS_AUDIO, "data": HAS_DATA, "wrong_this": WRONG_THIS, "wrong_rip": WRONG_RIP}


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of their key, name, numbers and lists: metadata, index and essence, put between packs at their places."""
    metadata = Metadata()
    whole, blank = bytes.fromhex(frame_header()), b"\x5a" * 64
    video, audio, data = (bytes.fromhex(ESSENCE.format(x)) for x in (VIDEO, AUDIO, DATA))
    pack_keys = {kind: bytes.fromhex(PARTITION.format(kind)) for kind in (2, 3, 4)}
    labels = {name: bytes.fromhex(x) for name, x in LABEL.items()}

    def pack(k: int, kind: int, this: int, before: int, footer: int, body_sid: int, index_sid: int) -> bytes:
        label = labels["other" if k % 5 == 0 else "opatom" if k % 5 == 1 else "op1a"]
        places = b"".join(x.to_bytes(8, "big") for x in (this, before, footer, 0, 0))
        return _triplet(pack_keys[kind], bytes.fromhex("0001000200000001") + places + index_sid.to_bytes(4, "big") + bytes(8) + body_sid.to_bytes(4, "big") + label + (1).to_bytes(4, "big") + (16).to_bytes(4, "big") + label)

    def made(k: int, name: str | None, values: list[int], size: list[int], sound: list[int], has: dict[str, bool]) -> bytes | None:
        if name is None:
            return None
        n = len(size)
        head, rate = metadata.head(values, name.encode("utf-16-be"))
        frames = [(blank if has["no_frame"] else whole).ljust(x, b"\x5a")[:x] for x in size]
        if has["unit"]:
            index = _segment(0x30, k, rate, 0, n, 700, None)
        else:
            at, entries = 0, []
            for i, x in enumerate(size):
                entries.append((b"\0\0\0" if i % 5 else b"\0\0\x80") + at.to_bytes(8, "big"))
                at += x
            half = n // 2
            index = _segment(0x31, k, rate, 0, half, 0, b"".join(entries[:half])) + _segment(0x32, k, rate, half, n - half, 0, b"".join(entries[half:]))
        sounds = [_triplet(audio, b"\1\2\3\4" * (x // 4)) if has["audio"] else b"" for x in sound]
        if has["unit"] or has["clip"]:
            essence = [_triplet(video, b"".join(frames)) if n else b"", *sounds]
        else:
            essence = [part for f, a in zip(frames, sounds, strict=True) for part in (_triplet(video, f), a)]
        if has["data"] and n:
            essence.append(_triplet(data, b"\xff"))
        body = b"".join([index, *essence])
        at_body = PACK_BYTES + len(head)
        at_footer = at_body + PACK_BYTES + len(body)
        rip = b"".join(sid.to_bytes(4, "big") + at.to_bytes(8, "big") for sid, at in ((0, 0), (9 if has["wrong_rip"] else 1, at_body), (0, at_footer))) + RIP_BYTES.to_bytes(4, "big")
        last = pack(k, 4, at_footer, at_body, at_footer, 0, 0)
        return b"".join([pack(k, 2, 0, 0, at_footer, 0, 0), head, pack(k, 3, at_body + has["wrong_this"], 0, at_footer, 1, 2), body, last, _triplet(bytes.fromhex(RANDOM_INDEX_KEY), rip)])

    for batch in batches:
        files, payloads, held = [], [], 0
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        keys = columns["k"].to_pylist()
        flags = {name: columns[name].to_pylist() for name in FLAGS}
        lists = [columns[name].to_pylist() for name in ("c_name", "numbers", "size", "sound")]
        for i, k in enumerate(keys):
            files.append(k)
            payloads.append(made(k, *(x[i] for x in lists), {name: flags[name][i] for name in FLAGS}))
            held += len(payloads[-1] or b"")
            if held > BATCH_BYTES or i == len(keys) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(payloads, pa.binary())], names=["file", "payload"])
                files, payloads, held = [], [], 0


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, payload: a container for each customer; one without orders has no essence.

    The files are dealt over all of the session's shuffle partitions: their keys and orders are small,
    so that partitions merged by size would leave the writing of much larger files to a few tasks.
    """
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    listed = orders.groupBy("k").agg(F.sort_array(F.collect_list("o")).alias("os"))
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name").join(listed, "k", "left").withColumn("os", F.coalesce("os", F.array().cast("array<bigint>"))).withColumn("n", F.size("os").cast("long"))
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    each = lambda sql: expr(f"transform(os, o -> CAST({sql} AS BIGINT))")
    rows = files.select("k", "c_name", F.array(*(expr(f"CAST({sql} AS BIGINT)") for sql in numbers())).alias("numbers"), each(FRAME_BYTES).alias("size"), each(AUDIO_BYTES).alias("sound"), *(expr(sql).alias(name) for name, sql in FLAGS.items()))
    return rows.mapInArrow(_written, "file long, payload binary")
