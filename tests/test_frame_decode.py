"""Frames written by a plain bit writer and decoded again, against a decoder of one symbol at a time."""

import math
import random

import numpy as np
import pytest

from cinequery.operators import frame_decode as D
from cinequery.operators.decode import inverse_blocks

#: A made-up prefix code: three lengths of difference, an end, plain levels, one with a run, one with extra bits.
TABLES = D.RowTables(
    dc=[(0b0, 1), (0b10, 2), (0b110, 3), (0b1110, 4), (0b11110, 5), (0b111110, 6)],
    ac=[(0b0, 1), (0b10, 2), (0b110, 3), (0b1110, 4), (0b1111, 4)],
    levels=[(0, 0), (1, 0), (2, 2), (3, 1), (5, 3)],
    run=[(0b0, 1), (0b10, 2), (0b11, 2)],
    runs=[1, 3, 20],
    end=0,
    luma=[32 + i % 7 for i in range(64)],
    chroma=[32 + i % 5 for i in range(64)],
)


class Writer:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def code(self, pair):
        self.put(*pair)

    def bytes(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def write_row(rng, width, depth, is444, mbaff=False, tables=TABLES):
    """Bits of a random row, and its coefficients by the rules of the format, one symbol after the other."""
    t = tables.at_depth(depth, is444)
    w, last, out, crossed = Writer(), [1 << (depth + 2)] * 3, [], []
    for _ in range(width):
        q, cross = rng.randint(1, 60), rng.randint(0, 1) if mbaff else 0
        if mbaff:
            w.put(cross, 1)
        w.put(q, 10 if mbaff else 11)
        w.put(0, 1)
        crossed.append(bool(cross))
        for block in range(12 if is444 else 8):
            c = (block >> 1) % 3 if is444 else (1 + (block & 1) if block & 2 else 0)
            weight = t.chroma if c else t.luma
            n = rng.randint(0, 5)
            w.code(t.dc[n])
            raw = rng.getrandbits(n) if n else 0
            w.put(raw, n)
            if n:
                last[c] += (raw if raw >> (n - 1) else raw - (1 << n) + 1) * (4 if depth == 12 else 1)
            coefficients = [0] * 64
            coefficients[0] = last[c]
            at = 0
            while True:
                s = rng.choice([0, 0, 1, 2, 3, 4])
                run = rng.randrange(3)
                step = 1 + (t.runs[run] if t.levels[s][1] & 2 else 0)
                if s == 0 or at + step > 63:
                    w.code(t.ac[0])
                    break
                w.code(t.ac[s])
                sign = rng.randint(0, 1)
                w.put(sign, 1)
                level, flags = t.levels[s]
                if flags & 1:
                    extra = rng.getrandbits(t.index_bits) & 1
                    w.put(extra, t.index_bits)
                    level += extra << 7
                if flags & 2:
                    w.code(t.run[run])
                at += step
                scale = q * weight[at]
                v = level * scale + (scale >> 1)
                if t.bias < 32 or weight[at] != t.bias:
                    v += t.bias
                v >>= t.shift
                coefficients[int(D.ZIGZAG[at])] = -v if sign else v
            out.append(coefficients)
    return w.bytes(), out, crossed


def put(plane, x, y, block, step):
    for r in range(8):
        for c in range(8):
            plane[y + r * step][x + c] = int(block[r * 8 + c])


def planes_of(rows, width, depth, is444):
    """Planes of rows of (coefficients, crossed) by single samples."""
    chroma = width * (16 if is444 else 8)
    out = [[[0] * (width * 16 if p == 0 else chroma) for _ in range(16 * len(rows))] for p in range(3)]
    for r, (coefficients, crossed) in enumerate(rows):
        samples = inverse_blocks(np.array(coefficients), depth)
        for x in range(width):
            step, low = (2, r * 16 + 1) if crossed[x] else (1, r * 16 + 8)
            if is444:
                for p in range(3):
                    for k, (dx, y) in enumerate([(0, r * 16), (8, r * 16), (0, low), (8, low)]):
                        put(out[p], x * 16 + dx, y, samples[x * 12 + 2 * p + (k & 1) + 6 * (k >> 1)], step)
            else:
                for b, p, dx, y in [(0, 0, 0, r * 16), (1, 0, 8, r * 16), (4, 0, 0, low), (5, 0, 8, low), (2, 1, 0, r * 16), (3, 2, 0, r * 16), (6, 1, 0, low), (7, 2, 0, low)]:
                    put(out[p], x * (16 if p == 0 else 8) + dx, y, samples[x * 8 + b], step)
    kind = np.uint8 if depth == 8 else "<u2"
    return [np.array(p).astype(kind).tobytes() for p in out]


@pytest.mark.parametrize(("depth", "is444", "mbaff"), [(8, False, False), (10, False, True), (12, False, False), (10, True, False), (12, True, True)])
def test_rows_equal_single_symbols(depth, is444, mbaff):
    rng = random.Random(depth + is444)
    made = [write_row(rng, 3, depth, is444, mbaff) for _ in range(7)]
    out, crossed, done, code = D.decode_rows([m[0] for m in made], TABLES, 3, depth, is444, mbaff)
    assert code.tolist() == [0] * 7 and done.tolist() == [3] * 7
    for k, (_, coefficients, cross) in enumerate(made):
        assert out[k].tolist() == coefficients and crossed[k].tolist() == cross


def test_cut_and_mutated_rows_end_with_a_code():
    rng = random.Random(5)
    whole = [write_row(rng, 2, 8, False)[0] for _ in range(40)]
    cut = [r[: rng.randrange(len(r) - 1)] for r in whole]
    code = D.decode_rows(cut, TABLES, 2, 8, False, False)[3]
    assert all(c in D.RESULTS and c > 0 for c in code.tolist())
    mutated = [bytes(b ^ (rng.getrandbits(8) if rng.random() < 0.2 else 0) for b in r) for r in whole]
    assert all(c in D.RESULTS for c in D.decode_rows(mutated, TABLES, 2, 8, False, False)[3].tolist())
    act = bytes([0, 0b00110000])  # eleven bits of scale, then the bit of an adaptive colour transform
    assert D.decode_rows([act, b""], TABLES, 1, 8, False, False)[3].tolist() == [3, 2]


def packet(rows, cid, width, height, depth, b5=0, is444=False, size=None):
    head = bytearray(0x280)
    head[0:5] = (0x280).to_bytes(4, "big") + (b"\x03" if cid >= 1270 else b"\x01")
    head[5] = b5
    head[0x18:0x1C] = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    head[0x21] = {8: 1, 10: 2, 12: 3}[depth] << 5
    head[0x28:0x2C] = cid.to_bytes(4, "big")
    head[0x2C] = 64 * is444
    head[0x16C:0x16E] = len(rows).to_bytes(2, "big")
    at = 0
    for k, r in enumerate(rows):
        head[0x170 + 4 * k : 0x174 + 4 * k] = at.to_bytes(4, "big")
        at += len(r)
    data = bytes(head) + b"".join(rows)
    return data + bytes((size or len(data)) - len(data))


def test_frames_become_planes(spark):
    rng = random.Random(9)
    frames, want = [], {}
    for k, depth, is444 in [(1, 8, False), (2, 10, False), (3, 12, True)]:
        rows = [write_row(rng, 2, depth, is444) for _ in range(3)]
        cid = 1270 if is444 else 1274
        frames.append((k, packet([r[0] for r in rows], cid, 32, 48, depth, is444=is444)))
        want[k] = planes_of([r[1:] for r in rows], 2, depth, is444)
    frames += [(4, frames[0][1][:700]), (5, b"junk"), (6, None), (7, packet([b"\0"], 1273, 16, 16, 8))]
    got = {r.k: r for r in D.decode(spark.createDataFrame(frames, "k long, packet binary"), "k", {1274: TABLES, 1270: TABLES}).collect()}
    for k, planes in want.items():
        assert got[k].status == "ok" and [bytes(got[k][p]) for p in ("y", "cb", "cr")] == planes and got[k].macroblocks == 6
    assert got[4].status not in ("ok", "no frame") and got[4].y is None
    assert got[5].status == got[6].status == "no frame" and got[7].status == "invalid arguments"


def test_fields_are_woven(spark):
    rng = random.Random(2)
    unit, width = 303104, 120
    fields, units = {}, []
    for parity, b5 in ((0, 2), (1, 3)):
        rows = [write_row(rng, width, 8, False) for _ in range(2)]
        fields[parity] = planes_of([r[1:] for r in rows], width, 8, False)
        units.append(packet([r[0] for r in rows], 1242, 1920, 32, 8, b5=b5, size=unit))
    frame = spark.createDataFrame([(1, units[1] + units[0]), (2, units[0] + units[0]), (3, units[0])], "k long, packet binary")
    got = {r.k: r for r in D.decode(frame, "k", {1242: TABLES}).collect()}
    assert got[1].status == "ok" and got[1].rows == 4
    for p, (name, stride) in enumerate([("y", 1920), ("cb", 960), ("cr", 960)]):
        lines = [fields[r % 2][p][(r // 2) * stride : (r // 2 + 1) * stride] for r in range(64)]
        assert bytes(got[1][name]) == b"".join(lines)
    assert got[2].status == got[3].status == "fields don't pair"


def test_conversion_of_planes(spark):
    rng = np.random.default_rng(3)
    p8 = [rng.integers(0, 256, (4, w)).astype(np.uint8) for w in (8, 4, 4)]
    p10 = [rng.integers(0, 1024, (4, 8)).astype("<u2") for _ in range(3)]
    b8, b10 = ([p.tobytes() for p in ps] for ps in (p8, p10))
    rows = [(1, *b8, 8, "yuv422p8", "yuv420p8", None), (2, *b8, 8, "yuv422p8", "yuv444p8", None), (3, *b10, 8, "gbrp10", "yuv444p10", "bt709"), (4, *b8, 8, "yuv422p8", "yuv420p10", None), (5, *b10, 8, "gbrp10", "yuv444p10", "bt2020-cl"), (6, *b8, 8, "yuv422p8", "yuv422p8", None)]
    frame = spark.createDataFrame(rows, "k long, y binary, cb binary, cr binary, coded_width int, source string, target string, matrix string")
    got = {r.k: r for r in D.convert(frame, "k").collect()}
    down = [[(int(p[2 * r, c]) + int(p[2 * r + 1, c]) + 1) >> 1 for r in range(2) for c in range(4)] for p in p8[1:]]
    assert bytes(got[1].y) == b8[0] and [list(got[1].cb), list(got[1].cr)] == down
    assert list(got[2].cb) == [int(v) for r in p8[1] for v in r for _ in range(2)]
    assert got[4].y is None and got[5].y is None and [bytes(got[6][p]) for p in ("y", "cb", "cr")] == b8
    y = np.frombuffer(bytes(got[3].y), "<u2").reshape(4, 8)
    for r in range(4):
        for c in range(8):
            g, b, red = (int(p[r, c]) / 1023 for p in p10)
            luma = 0.2126 * red + (1 - 0.2126 - 0.0722) * g + 0.0722 * b
            assert y[r, c] == math.floor(64 + 876 * luma + 0.5)


def test_tables_from_a_file(tmp_path):
    import dataclasses
    import json

    (tmp_path / "t.json").write_text(json.dumps({"1274": dataclasses.asdict(TABLES)}))
    loaded = D.RowTables.load(str(tmp_path / "t.json"))[1274]
    data, coefficients, _ = write_row(random.Random(1), 2, 8, False)
    assert D.decode_rows([data], loaded, 2, 8, False, False)[0][0].tolist() == coefficients
