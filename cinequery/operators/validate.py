"""Structural rules over partitions, index segments and random-index rows. Each fault is a row; nothing throws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.operators.index import owners


def partition_faults(partitions: DataFrame) -> DataFrame:
    """file, rule, offset of partitions (file, offset, kind, this_partition, previous_partition, footer_partition, kag_size)."""
    w = Window.partitionBy("file").orderBy("offset")
    footers = partitions.where("kind = 'footer'").select("file", F.col("offset").alias("footer_partition")).distinct().withColumn("known", F.lit(True))
    rows = partitions.withColumn("before", F.lag("offset").over(w)).join(footers, ["file", "footer_partition"], "left")
    rules = {
        "this": F.col("this_partition") != F.col("offset"),
        "previous": F.col("before").isNotNull() & (F.col("previous_partition") != F.col("before")),
        "footer": (F.col("footer_partition") != 0) & F.col("known").isNull(),
        "kag": (F.col("kag_size") > 1) & (F.col("offset") % F.greatest("kag_size", F.lit(1)) != 0),
    }
    broken = F.filter(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())), lambda r: r.isNotNull())
    return rows.select("file", F.explode(broken).alias("rule"), "offset")


def random_index_faults(entries: DataFrame, partitions: DataFrame) -> DataFrame:
    """Entries (file, byte_offset, body_sid) against partitions: unknown offset, other body_sid, repeated, omitted."""
    counted = entries.groupBy("file", F.col("byte_offset").alias("offset")).agg(F.count("*").alias("n"), F.min("body_sid").alias("low"), F.max("body_sid").alias("high"))
    both = counted.join(partitions.select("file", "offset", F.col("body_sid").alias("own")), ["file", "offset"], "full_outer")
    rules = {
        "rip unknown": F.col("own").isNull(),
        "rip body": (F.col("low") != F.col("own")) | (F.col("high") != F.col("own")),
        "rip repeated": F.col("own").isNotNull() & (F.col("n") > 1),
        "rip omitted": F.col("n").isNull(),
    }
    broken = F.filter(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())), lambda r: r.isNotNull())
    return both.select("file", F.explode(broken).alias("rule"), "offset")


def index_faults(segments: DataFrame, partitions: DataFrame) -> DataFrame:
    """Segments (file, offset, index_sid, body_sid): no owner, other index_sid than the owner's, unknown body_sid."""
    sids = partitions.where("body_sid <> 0").select("file", "body_sid").distinct().withColumn("known", F.lit(True))
    own = owners(segments, partitions, ["file"]).join(partitions.select("file", F.col("offset").alias("owner"), F.col("index_sid").alias("own_sid")), ["file", "owner"], "left")
    rows = segments.join(own, ["file", "offset"]).join(sids, ["file", "body_sid"], "left")
    rules = {
        "index owner": F.col("owner").isNull(),
        "index sid": F.col("owner").isNotNull() & ((F.col("index_sid") == 0) | (F.col("index_sid") != F.col("own_sid"))),
        "index body": (F.col("body_sid") == 0) | F.col("known").isNull(),
    }
    broken = F.filter(F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())), lambda r: r.isNotNull())
    return rows.select("file", F.explode(broken).alias("rule"), "offset")


def faults(partitions: DataFrame, segments: DataFrame, entries: DataFrame) -> DataFrame:
    return partition_faults(partitions).unionByName(random_index_faults(entries, partitions)).unionByName(index_faults(segments, partitions))
