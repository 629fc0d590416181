"""Positions found by the index equal those of a walk, and few bytes are read."""

import random

import pytest

from cinequery.operators import klv, seek
from cinequery.sources import media

VIDEO, AUDIO = (bytes.fromhex("060e2b34010201010d010301" + tail) for tail in ("15010501", "16010101"))


def triplet(key, value):
    return key + b"\x83" + len(value).to_bytes(3, "big") + value


def item(tag, value):
    return tag.to_bytes(2, "big") + len(value).to_bytes(2, "big") + value


def pack(kind, body_sid, body_offset=0):
    value = bytearray(88)
    value[52:60], value[60:64] = body_offset.to_bytes(8, "big"), body_sid.to_bytes(4, "big")
    return triplet(bytes.fromhex(klv.PARTITION_PREFIX + f"{kind:02x}0400"), bytes(value))


def segment(start, entries):
    array = len(entries).to_bytes(4, "big") + (11).to_bytes(4, "big") + b"".join(bytes([0, 0, flags]) + at.to_bytes(8, "big") for at, flags in entries)
    return triplet(bytes.fromhex(klv.INDEX_KEY), item(seek.START, start.to_bytes(8, "big")) + item(seek.DURATION, len(entries).to_bytes(8, "big")) + item(seek.BODY, (1).to_bytes(4, "big")) + item(seek.ENTRIES, array))


def wrapped(rng, frames, bodies=3, size=5000):
    """Frames of video and sound in several body partitions, their index in the footer; the file, and rows of position, number, place and length."""
    data, places, want, stream, entries = pack(2, 0), [(0, 0)], [], 0, []
    for b in range(bodies):
        places.append((1, len(data)))
        data += pack(3, 1, stream)
        for _ in range(frames):
            flags = rng.choice([0, 0x80])
            entries.append((stream, flags))
            for key in rng.choice([[VIDEO], [VIDEO, AUDIO], [AUDIO, VIDEO]]):
                element = triplet(key, rng.randbytes(rng.randint(size // 2, size)))
                want.append((1, len(entries) - 1, int(key.hex()[24:], 16), len(data) + 20, len(element) - 20, flags == 0x80))
                data, stream = data + element, stream + len(element)
    places.append((0, len(data)))
    half = len(entries) // 2
    data += pack(4, 0) + segment(0, entries[:half]) + segment(half, entries[half:])
    rip = b"".join(s.to_bytes(4, "big") + o.to_bytes(8, "big") for s, o in places)
    return data + triplet(bytes.fromhex(klv.RANDOM_INDEX_KEY), rip + (24 + len(rip)).to_bytes(4, "big")), want


@pytest.mark.parametrize(("first", "past"), [(0, 100), (4, 9), (5, 6), (14, 99), (50, 60), (3, 3)])
def test_positions_equal_those_written(first, past):
    data, want = wrapped(random.Random(first), 5)
    assert list(seek.located(klv.Bytes(data), first, past)) == [w for w in want if first <= w[1] < past]


def test_few_bytes_are_read_of_paths(spark, tmp_path):
    data, want = wrapped(random.Random(5), 40)
    for name in ("a.mxf", "b.mxf"):
        (tmp_path / name).write_bytes(data)
    source = media.File(str(tmp_path / "a.mxf"))
    assert len(list(seek.located(source, 70, 71))) == sum(w[1] == 70 for w in want) and source.bytes_read < len(data) / 20
    asked = spark.createDataFrame([(str(tmp_path / "a.mxf"), 70, 72), (str(tmp_path / "b.mxf"), 0, 1)], "file string, first long, past long")
    got = sorted((r.file[-5:], *tuple(r)[1:]) for r in seek.packets(asked).collect())
    assert got == sorted([("a.mxf", *w) for w in want if 70 <= w[1] < 72] + [("b.mxf", *w) for w in want if w[1] == 0])


def test_files_without_an_index_have_no_rows(spark):
    data, _ = wrapped(random.Random(1), 3)
    files = [(0, 0, 9, data[:-30]), (1, 0, 9, b""), (2, 0, 9, None), (3, 0, 9, b"\0" * 100)]
    rng = random.Random(3)
    for k in range(30):
        broken = bytearray(data)
        for _ in range(5):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        files.append((10 + k, 0, 9, bytes(broken)))
    rows = seek.packets(spark.createDataFrame(files, "file int, first long, past long, payload binary")).collect()
    assert {r.file for r in rows} <= set(range(10, 40))


def test_an_element_of_one_packet_is_not_shared(spark, tmp_path):
    """Customer 7 has one frame, which starts where it is sought; customer 49 has two."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(k, f"name {k}") for k in (7, 49)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 7), (2, 49), (3, 49)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(duck.execute(entry.oracle_sql()["seek_packets"]).fetchall())
    got = sorted(map(tuple, entry.queries()["seek_packets"](spark, str(tmp_path)).collect()))
    assert got == want and [r[:2] for r in got] == [(49, 0), (49, 1)]
