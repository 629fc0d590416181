"""Playback relations against plain folds over single events, and the container facade on files and faults."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from cinequery.operators import klv, playback, stats
from cinequery.operators.container import SET_TYPES
from cinequery.operators.demux import open_container, open_path
from cinequery.sources import containers, media


def plain_clock(events, duration):
    running, media_time, anchor, out = False, 0.0, 0.0, []
    for at, kind, value in events:
        now = min(duration, media_time + max(0.0, at - anchor)) if running else media_time
        if running and now >= duration:
            running = False
        media_time, anchor = now, at
        out.append(now)
        if kind == "start":
            media_time, running = min(max(value, 0.0), duration), True
        elif kind == "pause":
            running = False
        elif kind == "seek":
            media_time = min(max(value, 0.0), duration)
    return out


def test_clock_equals_a_plain_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for session in range(120):
        at, events = 0.0, []
        for _ in range(rng.randint(1, 30)):
            at += rng.choice([0, 0.25, 0.5, 1, 4, -0.5])
            events.append((at, rng.choice(["start", "pause", "seek", "tick", "tick"]), rng.choice([-1.0, 0.0, 0.5, 2.0, 5.0, 9.0])))
        rows += [(session, k, *e) for k, e in enumerate(events)]
        want |= {(session, k): v for k, v in enumerate(plain_clock(events, 6.0))}
    got = playback.clock_fold(spark.createDataFrame(rows, "session long, ord long, at double, kind string, value double"), 6.0).collect()
    assert {(r.session, r.ord): r.media_time for r in got} == want


def test_lru_equals_a_plain_cache(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for session in range(40):
        cache: OrderedDict = OrderedDict()
        for k in range(rng.randint(0, 60)):
            key = rng.randint(0, 7)
            rows.append((session, k, key))
            want[session, k] = key in cache
            cache[key] = True
            cache.move_to_end(key)
            if len(cache) > 3:
                cache.popitem(last=False)
    got = playback.lru(spark.createDataFrame(rows, "session long, ord long, key long"), 3).collect()
    assert {(r.session, r.ord): r.hit for r in got} == want


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_running_sums_by_bucket(spark, bucket):
    rng = random.Random(7)
    rows = [(rng.randint(0, 2), k, rng.randint(-5, 5)) for k in rng.sample(range(1000), 300)]
    got = stats.running(spark.createDataFrame(rows, "g long, k long, v long"), ["g"], "k", F.col("v"), "total", bucket).collect()
    assert len(got) == 300
    for r in got:
        assert r.total == sum(v for g, k, v in rows if g == r.g and k <= r.k)


def test_a_path_and_bytes_open_alike(spark, tmp_path):
    files = containers.containers(spark, "/root/testdata/sf0.001").where("file < 12")
    for r in files.collect():
        (tmp_path / f"{r.file}.mxf").write_bytes(r.payload)
    a, b = open_container(files), open_path(spark, str(tmp_path))
    name = F.regexp_extract("file", r"(\d+)\.mxf$", 1).cast("long")
    for relation in ("tracks", "packets", "descriptors", "source_clips", "faults"):
        columns = [c for c in getattr(a, relation).columns if c != "file"]
        rows = [sorted(map(str, df.collect())) for df in (getattr(a, relation).select("file", *columns), getattr(b, relation).select(name.alias("file"), *columns))]
        assert rows[0] == rows[1] and rows[0]
    packet = b.packets.where("number = 352388353 AND packet_index = 0").select("file", F.col("byte_offset").alias("value_offset"), "byte_length")
    heads = {bytes(r.payload[:2]) for r in media.packets(packet, "byte_length").collect()}
    assert heads <= {b"\0\0", b"ZZ"} and heads


def local_set(kind, *items):
    key = {v: k for k, v in SET_TYPES.items()}[kind]
    value = b"".join(t.to_bytes(2, "big") + len(v).to_bytes(2, "big") + v for t, v in items)
    return bytes.fromhex(key) + b"\x83" + len(value).to_bytes(3, "big") + value


def uid(n):
    return bytes([n]) * 16


def refs(*uids):
    return len(uids).to_bytes(4, "big") + (16).to_bytes(4, "big") + b"".join(uids)


def test_cycles_malformed_sets_and_junk_are_faults(spark):
    rate = (25).to_bytes(4, "big") + (1).to_bytes(4, "big")
    cycle = b"".join([
        local_set("MaterialPackage", (0x3C0A, uid(1)), (0x4401, uid(9)), (0x4403, refs(uid(2)))),
        local_set("Track", (0x3C0A, uid(2)), (0x4801, (1).to_bytes(4, "big")), (0x4B01, rate), (0x4803, uid(3))),
        local_set("Sequence", (0x3C0A, uid(3)), (0x1001, refs(uid(4)))), local_set("Sequence", (0x3C0A, uid(4)), (0x1001, refs(uid(3)))),
    ])
    broken = bytearray(local_set("Sequence", (0x3C0A, uid(3))))
    broken[22:24] = b"\xff\xff"  # an item longer than its set
    c = open_container(spark.createDataFrame([(1, cycle), (2, bytes(broken)), (3, b"junk" * 9), (4, b""), (5, None)], "file long, payload binary"))
    faults = {(r.file, r.rule) for r in c.faults.collect()}
    assert (1, "sequence cycle") in faults and (2, "set items don't fit") in faults and (3, "no key") in faults
    assert c.tracks.count() == c.packets.count() == 0 and {r.file for r in c.compositions.collect()} == {1}
    assert {r.outcome for r in c.selection.collect()} == {"unsupported pattern"}


def test_filters_meet_and_unknown_files_have_no_rows(spark, tmp_path):
    for name in ("a.mxf", "b.mxf"):
        (tmp_path / name).write_bytes(bytes.fromhex(klv.PRIMER_KEY) + b"\x00" + bytes.fromhex(klv.INDEX_KEY) + b"\x00")
    media.register(spark)
    rows = spark.read.format("klv").load(str(tmp_path))
    a, b = (f"file = '{tmp_path}/{x}.mxf'" for x in "ab")
    assert rows.count() == 4 and rows.where(a).count() == 2 and rows.where(f"{a} AND {b}").count() == 0
    assert rows.where("file = '/etc/hosts'").count() == 0
    assert rows.where("key_hex LIKE '060e2b340205%' AND key_hex LIKE '060e2b%'").count() == 2
    assert rows.where("key_hex LIKE '060e2b340205%' AND key_hex LIKE '060e2b340253%'").count() == 0
    big = spark.createDataFrame([(f"{tmp_path}/a.mxf", 0, 16, k) for k in range(5)], "file string, value_offset long, value_length long, k int").coalesce(1)
    assert sorted(r.k for r in media.packets(big, batch_bytes=20).collect()) == list(range(5))
