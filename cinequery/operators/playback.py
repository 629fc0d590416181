"""Playback as rows: clock states, seeks, audio schedules, prefetch windows, caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clock_fold(events: DataFrame, duration: float) -> DataFrame:
    """Media time before each event of a session: events (session, ord, at, kind, value) with kinds start, pause, seek and tick; start and seek set ``value``.

    From the last event that set it on, the clock moves with time while it runs: a start makes it
    run, a pause or the end of the media stops it, and a seek leaves that as it is. All of that is
    running sums and last values over a session's events in order, so none is gathered.
    """
    one = Window.partitionBy("session").orderBy("ord")
    upto, before = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("kind").isin("start", "seek")
    rows = events.select("session", "ord", "at", "kind", "value")
    rows = rows.withColumn("moved", F.greatest(F.lit(0.0), F.col("at") - F.lag("at").over(one)))
    rows = rows.withColumns({"time": F.sum("moved").over(upto), "run": F.sum((F.col("kind") == "start").cast("int")).over(upto)})
    rows = rows.withColumns({"time": F.coalesce("time", F.lit(0.0)), "target": F.least(F.greatest("value", F.lit(0.0)), F.lit(duration))})
    # A run is what one start begins. Its clock stands still after a pause, or once it has come to the end before a further seek.
    run = Window.partitionBy("session", "run")
    earlier = run.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    later = run.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next_set", F.last(F.when(sets, F.col("time")), True).over(later))
    ended = sets & (F.col("target") + F.col("next_set") - F.col("time") >= duration)
    rows = rows.withColumns({"paused": F.max((F.col("kind") == "pause").cast("int")).over(earlier), "over": F.max(ended.cast("int")).over(earlier)})
    runs = (F.col("run") > 0) & (F.coalesce("paused", F.lit(0)) == 0) & (F.coalesce("over", F.lit(0)) == 0)
    rows = rows.withColumn("set", F.last(F.when(sets, F.struct("target", "time", runs.alias("runs"), F.col("ord").alias("ord"))), True).over(before))
    # Of pauses after the last set the first counts: later ones find the clock standing.
    first_pause = F.min(F.when(F.col("kind") == "pause", F.struct("ord", "time"))).over(Window.partitionBy("session", "span").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("span", F.coalesce("set.ord", F.lit(-1))).withColumn("stop", F.coalesce(first_pause["time"], F.col("time")))
    went = F.when(F.col("set.runs"), F.col("stop") - F.col("set.time")).otherwise(0.0)
    media = F.when(F.col("set").isNull(), 0.0).otherwise(F.least(F.lit(duration), F.col("set.target") + went))
    return rows.select("session", "ord", media.alias("media_time"))


def recoveries(samples: DataFrame, duration: float) -> DataFrame:
    """Of samples (session, ord, running, media_time, sources: buffers still scheduled) those after which playback starts anew, and where: it runs, isn't over, and nothing is scheduled any more."""
    dry = F.col("running") & (F.col("media_time") < duration) & (F.col("sources") == 0)
    return samples.where(dry).select("session", "ord", F.lit("start").alias("kind"), F.least(F.greatest("media_time", F.lit(0.0)), F.lit(duration)).alias("value"))


def coalesce_seeks(seeks: DataFrame, gap: float) -> DataFrame:
    """Of each burst of a session's seeks (session, ord, at, target), no ``gap`` apart, the newest."""
    w = Window.partitionBy("session").orderBy("ord")
    bursts = seeks.withColumn("opens", F.coalesce((F.col("at") - F.lag("at").over(w) > gap).cast("int"), F.lit(1))).withColumn("burst", F.sum("opens").over(w))
    return bursts.groupBy("session", "burst").agg(F.max_by("target", "ord").alias("target"), F.max("ord").alias("ord"))


def prefetch(wanted: DataFrame, ahead: int) -> DataFrame:
    """frame rows (id, index, last): the ``ahead`` indices after each, up to the last."""
    end = F.least(F.col("index") + ahead, F.col("last"))
    return wanted.where("index < last").select("id", F.explode(F.sequence(F.col("index") + 1, end)).alias("fetch"))


def audio_schedule(buffers: DataFrame, timestamp: float, context_start: float) -> DataFrame:
    """Start time and offset of each buffer (id, ts, dur) from ``timestamp`` on; buffers that end before it are left out."""
    offset = F.greatest(F.lit(0.0), timestamp - F.col("ts"))
    kept = buffers.withColumn("play_offset", offset).where(F.col("play_offset") < F.col("dur"))
    return kept.select("id", (context_start + F.greatest(F.lit(0.0), F.col("ts") - timestamp)).alias("start_at"), "play_offset")


def until_first_error(packets: DataFrame) -> DataFrame:
    """Packets (stream, ord, failed) before the first that failed, and that one."""
    first = packets.where("failed").groupBy("stream").agg(F.min("ord").alias("stop"))
    return packets.join(first, "stream", "left").where("stop IS NULL OR ord <= stop").drop("stop")


def lru(reads: DataFrame, capacity: int) -> DataFrame:
    """Whether each read (session, ord, key) of a session finds its key among the last ``capacity`` keys used.

    Sessions are dealt out and sorted by Spark; a task walks its rows once and holds no more than
    ``capacity`` keys, however long a session is.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cache = None, OrderedDict()
        for batch in batches:
            hits = []
            for session, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if session != last:
                    last, cache = session, OrderedDict()
                hits.append(key in cache)
                cache[key] = True
                cache.move_to_end(key)
                if len(cache) > capacity:
                    cache.popitem(last=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.bool_())], names=["session", "ord", "hit"])

    kind = reads.schema["session"].dataType.simpleString()
    rows = reads.select("session", F.col("ord").cast("long").alias("ord"), "key").repartition("session").sortWithinPartitions("session", "ord")
    return rows.mapInArrow(walk, f"session {kind}, ord long, hit boolean")


def decode_events(packets: DataFrame) -> DataFrame:
    """Tagged event rows of a stream: log, one frame for each packet (stream, ord, failed) up to the first error, then the error or done."""
    w = Window.partitionBy("stream")
    kept = until_first_error(packets)
    frames = kept.select("stream", F.col("ord").alias("ord"), F.when(F.col("failed"), "error").otherwise("frame").alias("type"))
    head = packets.select("stream").distinct().select("stream", F.lit(-1).cast("long").alias("ord"), F.lit("log").alias("type"))
    tail = kept.withColumn("any", F.max(F.col("failed").cast("int")).over(w)).where("any = 0").groupBy("stream").agg((F.max("ord") + 1).alias("ord")).select("stream", "ord", F.lit("done").alias("type"))
    return head.unionByName(frames).unionByName(tail)
