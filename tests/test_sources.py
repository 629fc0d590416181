import os

import pandas as pd

from cinequery.sources import media
from cinequery.streaming.clock import clock

KEY = bytes.fromhex("060e2b34010201010d01030115010501")


def test_container_source_reads_by_position(spark, tmp_path):
    values = [os.urandom(n) for n in (3, 200, 70_000)]
    data = b"".join(KEY + b"\x83" + len(v).to_bytes(3, "big") + v for v in values)
    for name in ("a.mxf", "b.MXF"):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "c.txt").write_bytes(b"no")
    media.register(spark)
    media.register(spark)
    rows = spark.read.format("klv").load(str(tmp_path))
    assert rows.count() == 6 and rows.where(f"file = '{tmp_path}/a.mxf'").count() == 3
    assert rows.where("key_hex LIKE '060e2b34%'").count() == 6 and rows.where("key_hex LIKE 'ff%'").count() == 0
    got = media.packets(rows.where(f"file = '{tmp_path}/a.mxf'").select("file", "ord", "value_offset", "value_length")).orderBy("ord").collect()
    assert [bytes(r.payload) for r in got] == values
    source = media.File(str(tmp_path / "a.mxf"))
    list(media.walk(source))
    assert source.bytes_read < len(data) / 20


def test_streamed_clock_equals_batch(spark, tmp_path):
    rows = [(1, 0, 0.0, "start", 1.0), (1, 1, 2.0, "tick", 0.0), (1, 2, 3.0, "seek", 2.0), (1, 3, 4.0, "pause", 0.0), (1, 4, 9.0, "tick", 0.0)]
    for i, part in enumerate((rows[:2], rows[2:])):
        pd.DataFrame([(*r, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=r[2])) for r in part], columns=["session", "ord", "at", "kind", "value", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("session long, ord long, at double, kind string, value double, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = clock(stream.withColumn("ts", stream["ts"].cast("timestamp")), 5.0).writeStream.format("memory").queryName("clock_out").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.ord: r.media_time for r in spark.table("clock_out").collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 3.0}


def test_streamed_clock_marks_late_events(spark, tmp_path):
    parts = [[(1, 0, 0.0, "start", 1.0), (1, 2, 2.0, "tick", 0.0)], [(1, 1, 1.0, "tick", 0.0), (1, 3, 3.0, "tick", 0.0)]]
    for i, part in enumerate(parts):
        pd.DataFrame([(*r, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=r[2])) for r in part], columns=["session", "ord", "at", "kind", "value", "ts"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("session long, ord long, at double, kind string, value double, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = clock(stream.withColumn("ts", stream["ts"].cast("timestamp")), 9.0, late="90 seconds").writeStream.format("memory").queryName("late_out").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.ord: r.media_time for r in spark.table("late_out").collect()} == {0: 0.0, 2: 3.0, 1: None, 3: 4.0}
