"""What the sink writes is what was laid out; what fails leaves nothing."""

import os

import pytest
from pyspark.sql import functions as F

from cinequery.operators import frame_decode
from cinequery.operators.code_tables import TABLES
from cinequery.sources import coded, planes


def listed(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_planes_in_strides(spark, tmp_path):
    planes.register(spark)
    rows = [("a", [(b"abcdef", 3, None, 5), (b"xy", 1, None, 2), (b"", None, None, None)]), ("b", [(b"packet", None, 4, None)]), ("c", None), ("d", [(b"1234", 2, 6, 2), (b"56", 2, 0, None)])]
    frame = spark.createDataFrame(rows, planes.SCHEMA).repartition(3)
    frame.write.format("planes").mode("append").save(str(tmp_path / "out"))
    got = {n: (tmp_path / "out" / n).read_bytes() for n in listed(tmp_path / "out")}
    assert got == {"a": b"abc\0\0defx\0y", "b": b"\0\0\0\0packet", "c": b"", "d": b"56\0\0\0\0" + b"1234"}
    spark.createDataFrame([("e", None)], planes.SCHEMA).write.format("planes").mode("append").save(str(tmp_path / "out"))
    assert listed(tmp_path / "out") == ["a", "b", "c", "d", "e"]
    spark.createDataFrame([("f", None)], planes.SCHEMA).write.format("planes").mode("overwrite").save(str(tmp_path / "out"))
    assert listed(tmp_path / "out") == ["f"]


@pytest.mark.parametrize("bad", [("a", [(b"abc", 2, None, None)]), ("a", [(b"abcd", 2, None, 1)]), ("a", [(b"abcd", 2, 0, 2), (b"x", None, 3, None)]), ("../a", None), (None, None), ("x", None)])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    planes.register(spark)
    rows = [(f"good{i}", [(b"12", None, None, None)]) for i in range(20)] + [("x", None), bad]
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame(rows, planes.SCHEMA).repartition(4).write.format("planes").mode("append").save(str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []


def test_decoded_frames_and_packets_come_back(spark, sf_dir, tmp_path):
    planes.register(spark)
    packets = coded.packets(spark, sf_dir)
    frames = frame_decode.decode(packets, "frame", TABLES)
    planes.frames(frames, F.col("frame"), 7).write.format("planes").mode("append").save(str(tmp_path / "frames"))
    planes.packets(packets, F.concat(F.lit("p"), F.col("frame").cast("string")), "packet").write.format("planes").mode("append").save(str(tmp_path / "packets"))
    rows = frames.collect()
    assert rows and listed(tmp_path / "frames") == sorted(str(r.frame) for r in rows)
    for r in rows:
        row = -(-r.width // 16) * 16 * (1 if r.bit_depth == 8 else 2)
        want = b""
        for data, n in ((r.y, row), (r.cb, row if r.is444 else row // 2), (r.cr, row if r.is444 else row // 2)):
            lines = [bytes(data[k : k + n]) for k in range(0, len(data), n)]
            want += bytes(7).join(lines)
        assert (tmp_path / "frames" / str(r.frame)).read_bytes() == want
    for r in packets.collect():
        assert (tmp_path / "packets" / f"p{r.frame}").read_bytes() == bytes(r.packet)
