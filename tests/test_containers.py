"""Whole files are written in many tasks, and rows of many files share a batch."""

import pyarrow as pa
from pyspark.sql import functions as F

from cinequery.operators import klv
from cinequery.sources import containers as S
from cinequery.sources import frames


def test_files_are_written_in_many_tasks(spark, sf_dir):
    files = S.containers(spark, sf_dir).withColumn("task", F.spark_partition_id())
    assert files.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_many_files_share_batches():
    rows = [(k, 0, 0, "00", 1, 17, 5, 22, None, None, [{"tag": k, "value": b"v"}] if k % 2 else None, 0, None) for k in range(10)]
    batches = list(klv.batches_of(iter(rows), pa.int64(), size=4))
    assert [len(b) for b in batches] == [4, 4, 2]
    assert [r["items"] for b in batches for r in b.to_pylist()] == [r[10] for r in rows]


def test_headers_are_written_in_many_tasks(spark, sf_dir):
    packets = frames.headers(spark, sf_dir).withColumn("task", F.spark_partition_id())
    assert packets.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
