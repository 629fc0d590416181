"""Probing and the chunked frame scan against plain versions."""

import os
import random

import pytest

from cinequery.operators import frame_scan, probe

NAMES = ["a.MOV", "b.mxf", "c.txt", None, "noext", "x.dnxhd"]


def head(cid=1274, depth=1, kind=3, width=640, height=128, offset=0x280):
    h = bytearray(0x280)
    h[0:4], h[4] = offset.to_bytes(4, "big"), kind
    h[0x18:0x1C] = height.to_bytes(2, "big") + width.to_bytes(2, "big")
    h[0x21] = depth << 5
    h[0x28:0x2C] = cid.to_bytes(4, "big")
    return bytes(h)


def plain(name, data, head=3000, movie=6000):
    """Each needle and header looked for at each place."""
    at = lambda n, limit: [i for i in range(max(0, min(len(data), limit) - len(n) + 1)) if data[i : i + len(n)] == n]
    atoms = [i for n in probe.ATOMS for i in at(n, head)]
    entries = sorted((i, n.decode()) for n in probe.ENTRIES for i in at(n, movie))
    top = min(len(data), head) - 0x280
    header = next((i for i in range(top + 1) if frame_scan.is_header(data[i : i + 0x280])), None)
    named = name is not None and os.path.splitext(name.lower())[1] in probe.EXTENSIONS
    if not named and not entries and header is None:
        return None
    confidence = 0.95 if entries or header is not None else 0.65 if named and atoms else 0.35
    container = "QuickTime/ISO BMFF" if atoms else "raw frame" if header is not None else None
    return container, confidence, [(n, i) for i, n in entries[:8]], header


def test_probe_equals_looking_everywhere(spark):
    rng = random.Random(3)
    parts = [b"ftyp", b"moov", b"AVdn", b"AVdh", b"AVd", b"\0\0\x02", head(), head(cid=7), head(kind=9), head(depth=0), head(kind=1), head(offset=0x300), head(offset=0x302), b"." * 700, b"\0\0\x02\x80" * 3]
    files = [(k, rng.choice(NAMES), b"".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(120)]
    files += [(200, "a.mov", None), (201, None, None), (202, "a.txt", b"x" * 2990 + head()), (203, None, b"y" * (3000 - 0x280) + head()), (204, None, b"y" * (3001 - 0x280) + head()), (205, None, b"z" * 5996 + b"AVdn"), (206, None, b"z" * 5997 + b"AVdn")]
    got = {r.file: (r.container, r.confidence, [tuple(e) for e in r.entries], r.header_offset) for r in probe.probe(spark.createDataFrame(files, "file int, name string, payload binary"), 3000, 6000).collect()}
    want = {k: p for k, name, data in files if (p := plain(name, data or b""))}
    assert got == want


def test_probe_of_a_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.bin").write_bytes(b"abc" + head())
    (tmp_path / "sub" / "two.mov").write_bytes(b"x")
    (tmp_path / "three.txt").write_bytes(b"nothing")
    got = {os.path.basename(r.name): (r.container, r.stream, r.confidence, r.header_offset) for r in probe.probe_path(spark, str(tmp_path)).collect()}
    assert got == {"one.bin": ("raw frame", "AVdh", 0.95, 3), "two.mov": (None, None, 0.35, None)}


@pytest.mark.parametrize("size", [700, 5000, 1 << 20])
def test_chunked_scan_equals_the_walk(spark, size):
    rng = random.Random(size)
    n = frame_scan.expected_size(head())
    whole = head() + bytes(n - 0x280)
    hidden = head() + bytes(100) + head() + bytes(n - 0x280 * 2 - 100)  # a header within a frame, which the walk reaches over
    parts = [whole, whole, hidden, b"\0" * 5, b"junk", head(), head(cid=1), whole[: n - 7]]
    files = [(k, b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for k in range(12)] + [(90, whole * 9), (91, b""), (92, None)]
    frame = spark.createDataFrame(files, "file int, payload binary")
    walk = sorted(tuple(r) for r in frame_scan.scan(frame).collect())
    assert sorted(tuple(r) for r in frame_scan.scan_chunks(frame_scan.chunks(frame, size), size, 4096).collect()) == walk and len(walk) > 20
