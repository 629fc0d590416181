"""Literal vectors with known results, and kernels against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinequery.functions import binary as B
from cinequery.functions import header as H
from cinequery.functions import media as M
from cinequery.functions import signal as S
from cinequery.operators import container, decode, klv, playback
from cinequery.operators import index as I


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("unit", "base", "drop", "text"), [(1799, 30, True, "00:00:59;29"), (1800, 30, True, "00:01:00;02"), (17982, 30, True, "00:10:00;00"), (-1, 30, True, "23:59:59;29"), (-1, 30, False, "23:59:59:29"), (89356, 24, False, "01:02:03:04")])
def test_timecode(spark, unit, base, drop, text):
    assert one(spark, t=M.timecode(F.lit(unit), F.lit(0), F.lit(0), F.lit(base), F.lit(drop))).t.formatted == text


def test_timecode_rejects_drop_frame_of_other_bases(spark):
    assert one(spark, t=M.timecode(F.lit(1), F.lit(0), F.lit(0), F.lit(25), F.lit(True))).t is None


@pytest.mark.parametrize(("hex_", "valid", "stored", "value"), [("0040", 16, 16, 0.5), ("0080", 16, 16, -1.0), ("0f0040", 20, 24, 0.5), ("0f0080", 20, 24, -1.0), ("ff000040", 24, 32, 0.5), ("ff000080", 24, 32, -1.0)])
def test_pcm_samples(spark, hex_, valid, stored, value):
    assert one(spark, v=S.pcm_sample(F.unhex(F.lit(hex_)), 0, F.lit(stored), F.lit(valid))).v == value


def test_pcm_layout(spark):
    row = one(spark, a=S.pcm_layout(F.lit(20), F.lit(24)), b=S.pcm_layout(F.lit(24), F.lit(20)), c=S.pcm_layout(F.lit(24), F.lit(64)))
    assert row.a.bytes == 3 and row.b is None and row.c is None


def test_gbr_to_yuv(spark):
    for depth, rgb, want in [(10, (0, 0, 0), (64, 512, 512)), (10, (1023, 1023, 1023), (940, 512, 512)), (10, (1023, 0, 0), (250, 409, 960)), (12, (0, 0, 0), (256, 2048, 2048)), (12, (4095, 4095, 4095), (3760, 2048, 2048)), (12, (4095, 0, 0), (1001, 1637, 3840))]:
        r, g, b = map(F.lit, rgb)
        row = one(spark, **S.gbr_to_yuv(g, b, r, depth))
        assert (row.y, row.cb, row.cr) == want


def test_rgba(spark):
    for yuv, depth, gbr, want in [((16, 128, 128), 8, False, (0, 0, 0)), ((235, 128, 128), 8, False, (255, 255, 255)), ((252, 408, 960), 10, False, (255, 1, 0)), ((80, 120, 160), 10, True, (40, 20, 30))]:
        row = one(spark, **S.yuv_to_rgb(*map(F.lit, yuv), depth, gbr=gbr))
        assert (row.r, row.g, row.b) == want


def test_chroma_rows(spark):
    row = one(spark, **{f"c{i}": S.chroma_420(F.lit(a), F.lit(b)) for i, (a, b) in enumerate([(10, 30), (20, 40), (50, 70), (60, 80)])})
    assert tuple(row) == (20, 30, 60, 70)


def test_format_choice(spark):
    for source, allowed, want in [("yuv422p8", ["yuv444p8", "yuv420p8"], "yuv444p8"), ("yuv422p10", ["yuv420p8", "yuv420p10"], "yuv420p10"), ("yuv422p10", ["yuv420p8"], None), ("gbrp10", ["yuv444p10"], "yuv444p10")]:
        assert one(spark, f=S.select_format(F.lit(source), F.array(*map(F.lit, allowed)))).f == want


def test_decisions(spark):
    row = one(spark, **{n: M.decision(F.lit(t), F.lit(2.0), 0.05) for n, t in (("a", 1.9), ("b", 2.02), ("c", 2.1))})
    assert tuple(row) == ("drop", "present", "hold")


def header(cid, width, height, depth, **flags):
    b = bytearray(0x280)
    b[:5] = bytes.fromhex("0000028003" if cid >= 1270 else "0000028001")
    b[5], b[6], b[7] = flags.get("b5", 0), flags.get("b6", 0), flags.get("b7", 0)
    b[0x18:0x1C] = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    b[0x21] = depth << 5
    b[0x28:0x2C] = cid.to_bytes(4, "big")
    b[0x2C] = flags.get("b2c", 0)
    b[0x16C:0x16E] = (-(-height // 16)).to_bytes(2, "big")
    return bytes(b)


def test_headers(spark):
    rows = [
        (1, header(1237, 1920, 1080, 1)), (2, header(1250, 1280, 720, 2)), (3, header(1270, 1920, 1080, 2, b2c=64)), (4, header(1271, 1920, 1080, 3)),
        (5, header(1237, 1920, 540, 1, b5=2)), (6, header(1241, 1920, 540, 2, b5=2)), (7, header(1260, 1920, 1080, 1, b6=32)), (8, header(1237, 1920, 1080, 1)[:500]), (9, bytes(640)),
    ]
    df = spark.createDataFrame(rows, "id int, packet binary").withColumn("declared", F.lit(1 << 24))
    got = {r.id: r for r in H.parse(df, declared_length="declared").collect()}
    assert [(got[i].supported, got[i].pixel_format) for i in (1, 2, 3, 4)] == [(True, "yuv422p8"), (True, "yuv422p10"), (True, "gbrp10"), (True, "yuv422p12")]
    assert not got[5].supported and got[5].reasons == ["interlaced not permitted"]
    assert got[6].height == 1080 and got[6].supported
    assert (got[7].width, got[7].par_num, got[7].par_den, got[7].expected_size) == (1440, 4, 3, 417792)
    assert not got[8].ok and not got[9].ok


def test_slices(spark):
    entries = spark.createDataFrame([(1, i, o, 60) for i, o in enumerate([100, 110, 125, 140])] + [(2, i, o, 60) for i, o in enumerate([10, 30, 20])], "id int, pos int, stream_offset long, value_length long")
    got = sorted(tuple(r) for r in I.variable_slices(entries).select("id", "slice_offset", "slice_length").collect())
    assert got == [(1, 0, 10), (1, 10, 15), (1, 25, 15), (1, 40, 20)]
    const = spark.createDataFrame([(1, 40, 10, 4), (2, 19, 10, 0), (3, 35, 10, 0)], "id int, value_length long, unit long, indexed long")
    got = sorted(tuple(r) for r in I.constant_slices(const).select("id", "slice_offset", "slice_length").collect())
    assert got == [(1, 0, 10), (1, 10, 10), (1, 20, 10), (1, 30, 10), (3, 0, 10), (3, 10, 10), (3, 20, 10)]


def test_range_join_reports_overlaps(spark):
    segs = spark.createDataFrame([(1, 1, 0, 100), (2, 1, 90, 500)], "segment long, body_sid long, start long, length long")
    asked = spark.createDataFrame([(1, 1, 5), (2, 1, 95), (3, 1, 400), (4, 1, 900), (5, 2, 5)], "id long, body_sid long, position long")
    assert {r.id: (r.covering, r.segment) for r in I.at_position(asked, segs).collect()} == {1: (1, 1), 2: (2, None), 3: (1, 2), 4: (0, None), 5: (0, None)}


def test_inverse_transform_expression_equals_kernel(spark):
    rng = random.Random(3)
    blocks = [[256 + 17 * b, *((1 if i % 3 else -1) * ((b + 3) * (37 * i + 11) % 61) for i in range(1, 64))] for b in range(16)] + [[rng.randint(-3000, 3000) for _ in range(64)] for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(blocks)), "id int, coefficients array<int>")
    for depth in (8, 10):
        kernel = {r.id: list(r.samples) for r in decode.idct(df, depth).collect()}
        assert {r.id: list(r.s) for r in df.select("id", S.idct("coefficients", F.lit(depth)).alias("s")).collect()} == kernel
    assert decode.inverse_blocks(np.array([[800] + [0] * 63]), 10)[0].tolist() == [one(spark, v=S.idct_dc(F.lit(800), F.lit(10))).v] * 64


def canonical(lengths):
    code, out, last = 0, [], 0
    for n in lengths:
        code <<= n - last
        out.append((code, n))
        code, last = code + 1, n
    return out


def test_entropy_round_trip(spark):
    rng = random.Random(5)
    dc = canonical([4] * 12)
    ac = canonical([8] * 180 + [9] * 76 * 2)[:256]
    zigzag = list(range(64))
    rows, want = [], []
    for row in range(20):
        bits, last, blocks = "", 0, []

        def put(value, n):
            return format(value, f"0{n}b") if n else ""

        def level(v):
            n = abs(v).bit_length()
            return n, put(v if v > 0 else v + (1 << n) - 1, n)

        for _ in range(5):
            block = [0] * 64
            block[0] = rng.randint(-500, 500)
            n, raw = level(block[0] - last)
            bits += put(*dc[n]) + raw
            last, at = block[0], 0
            for _ in range(rng.randint(0, 10)):
                zeros = rng.randint(0, 5)
                at += zeros + 1
                if at > 63:
                    break
                block[at] = rng.choice([-1, 1]) * rng.randint(1, 200)
                n, raw = level(block[at])
                bits += put(*ac[zeros << 4 | n]) + raw
            bits += put(*ac[0])
            blocks.append(block)
        bits += "0" * (-len(bits) % 8)
        rows.append((row, int(bits, 2).to_bytes(len(bits) // 8, "big"), 5))
        want.append(blocks)
    got = {r.id: r for r in decode.decode_rows(spark.createDataFrame(rows + [(99, b"\xff", 5), (98, None, 1)], "id int, payload binary, n_blocks int"), dc, ac, zigzag).collect()}
    assert [[list(b) for b in got[i].blocks] for i in range(20)] == want and all(got[i].error is None for i in range(20))
    assert got[99].error and got[98].error == "ends in the constant term"


def test_walk_reports_faults_and_goes_on():
    key = bytes.fromhex("060e2b34010201010d01030115010501")
    ok = key + b"\x03abc"
    data = ok + b"junk" + ok + key + b"\x80" + ok + key + b"\x89" + bytes(9)
    rows = list(klv.walk(klv.Bytes(data)))
    assert [r[6] for r in rows] == [None, "no key", None, "indefinite length", None, "length field too long"]
    assert rows[-1][5] is None and rows[2][0] == len(ok) + 4
    assert [r[6] for r in klv.walk(klv.Bytes(key + b"\x05ab"))] == ["value past the end"]
    assert klv.local_set(bytes.fromhex("3c0a0002abcd")) == [{"tag": 0x3C0A, "value": b"\xab\xcd"}] and klv.local_set(bytes.fromhex("3c0a0003abcd")) is None


def test_mutated_streams_never_stop_a_walk():
    rng = random.Random(1)
    base = bytes.fromhex("060e2b34010201010d01030115010501") + b"\x83\x00\x00\x10" + bytes(16)
    for _ in range(256):
        data = bytearray(base * 8)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows = list(klv.walk(klv.Bytes(bytes(data))))
        assert rows and all(r[5] is None or r[5] > r[0] for r in rows)


def test_clock_and_caches(spark):
    events = spark.createDataFrame([(1, 0, 0.0, "start", 1.0), (1, 1, 2.0, "tick", 0.0), (1, 2, 9.0, "tick", 0.0), (1, 3, 10.0, "seek", 2.0), (1, 4, 11.0, "tick", 0.0)], "session long, ord long, at double, kind string, value double")
    assert [r.media_time for r in playback.clock_fold(events, 5.0).orderBy("ord").collect()] == [0.0, 3.0, 5.0, 5.0, 2.0]
    reads = spark.createDataFrame([(1, i, k) for i, k in enumerate("abacb")], "session long, ord long, key string")
    assert [r.hit for r in playback.lru(reads, 2).orderBy("ord").collect()] == [False, False, True, False, False]


def test_flatten_goes_to_the_end_of_a_long_chain(spark):
    edges = [(f"s{i}", 0, f"s{i + 1}", False) for i in range(49)] + [("s49", 0, "end", True), ("s3", 1, "early", True), ("s5", 2, "s1", False)]
    graph = spark.createDataFrame(edges, "parent string, pos long, child string, is_leaf boolean")
    got = container.flatten(graph, spark.createDataFrame([("s0",)], "root string")).collect()
    want = [("s0", "early", [0, 0, 0, 1]), ("s0", "end", [0] * 50), ("s0", None, [0] * 5 + [2])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bits_and_numbers(spark):
    row = one(spark, u=B.be_u64(F.unhex(F.lit("ffffffffffffffff")), 0), i=B.be_i64(F.unhex(F.lit("fffffffffffffffe")), 0), short=B.be_uint(F.unhex(F.lit("ff")), 0, 2), bits=B.bits(F.lit(0b1011_0000), 8, 1, 3), past=B.bits(F.lit(1), 8, 6, 3))
    assert (row.u, row.i, row.short, row.bits, row.past) == (2**64 - 1, -2, None, 0b011, None)
    assert math.isclose(decode._BASIS[0][0], math.sqrt(0.5))
