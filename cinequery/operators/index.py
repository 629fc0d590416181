"""Index tables: slices of clip-wrapped essence, contiguity checks, and the position look-up as a bucketed range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions.binary import column
from cinequery.operators.stats import carried

#: Positions of a bucket of the range join.
BUCKET = 128


def segment_length(duration: str = "duration", entries: str = "n_entries") -> Column:
    return F.when(F.col(duration) > 0, F.col(duration)).otherwise(F.col(entries)).cast("long")


def at_position(positions: DataFrame, segments: DataFrame, bucket: int = BUCKET, by: tuple[str, ...] = ()) -> DataFrame:
    """positions (id, body_sid, position) with the number of segments (body_sid, start, length, segment) that cover each, and the covering one where just one does; within each ``by``.

    Both sides are dealt into buckets of positions, so the join is by equality and a long segment
    stands in as many buckets as it covers.
    """
    spread = segments.where("length > 0").select(*by, "body_sid", "start", "length", "segment", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(start + length - 1) div {bucket}"))).alias("bucket"))
    asked = positions.select(*by, "id", "body_sid", "position").withColumn("bucket", F.expr(f"position div {bucket}"))
    covers = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("length"))
    met = asked.join(spread, [*by, "body_sid", "bucket"], "left").withColumn("covers", F.coalesce(covers, F.lit(False)))
    found = met.groupBy(*by, "id", "body_sid", "position").agg(F.count_if("covers").alias("covering"), *(F.min(F.when(F.col("covers"), F.col(c))).alias(c) for c in ("segment", "start")))
    return found.withColumns({c: F.when(F.col("covering") == 1, F.col(c)) for c in ("segment", "start")})


def contiguous(segments: DataFrame, length: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each body_sid the summed length of its segments in order of start, and whether each begins where the one before ends; empty segments don't count."""
    w = Window.partitionBy(*by, "body_sid").orderBy("start", "segment")
    ends = segments.where(F.col(length) > 0).withColumns({"turn": F.row_number().over(w), "before": F.lag(F.expr(f"try_add(start, {length})")).over(w)})
    follows = (F.col("turn") == 1) | F.coalesce(F.col("before") == F.col("start"), F.lit(False))
    return ends.groupBy(*by, "body_sid").agg(F.sum(length).alias("total"), F.bool_and(follows).alias("ok"))


def unit_sizes(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each body_sid how many sizes of a unit its segments give (0 is none), whether they disagree, and the size if it is one."""
    given = F.when(F.col("unit_bytes") > 0, F.col("unit_bytes"))
    counted = segments.groupBy(*by, "body_sid").agg(F.count_distinct(given).alias("sizes"), F.min(given).alias("unit"))
    return counted.withColumns({"conflict": F.col("sizes") > 1, "unit": F.when(F.col("sizes") == 1, F.col("unit"))})


def bodies(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What the segments (offset, body_sid, start, length, n_entries, unit_bytes) say of each body: one unit size or a conflict, positions and entries, and whether those follow on each other."""
    rows = segments.withColumn("segment", F.col("offset"))
    key = [*by, "body_sid"]
    part = lambda length, n, ok: contiguous(rows, length, by).withColumnsRenamed({"total": n, "ok": ok})
    all_ = unit_sizes(rows, by).join(part("length", "indexed", "indexed_ok"), key, "left").join(part("n_entries", "n_entries", "entries_ok"), key, "left")
    return all_.fillna(0, ["indexed", "n_entries"]).fillna(True, ["indexed_ok", "entries_ok"])


def body_entries(segments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The entries of each body in order of its segments: slice (from 0), place after the first entry, the next one's place, and whether it lies past the one before."""
    rows = segments.where("n_entries > 0").select(*by, "body_sid", "start", "offset", F.posexplode("entries").alias("pos", "e"))
    w = Window.partitionBy(*by, "body_sid").orderBy("start", "offset", "pos")
    rows = rows.withColumns({"slice": F.row_number().over(w).cast("long") - 1, "place": F.col("e.stream_offset") - F.first("e.stream_offset").over(w)})
    rises = F.col("place").isNotNull() & ((F.col("slice") == 0) | F.coalesce(F.col("place") > F.lag("place").over(w), F.lit(False)))
    return rows.withColumns({"past": F.lead("place").over(w), "rises": rises}).select(*by, "body_sid", "slice", "place", "past", "rises")


def element_slices(elements: DataFrame, entries: DataFrame, by: tuple[str, ...], most: int = 2_000_000) -> DataFrame:
    """Slices of elements (ord, value_length, how and the columns of ``bodies``): equal ones, those at the entries, or the whole.

    An element has none if its body's unit sizes disagree, if the segments it is cut by don't follow
    on each other, if entries don't rise within it, or if it would have over ``most``.
    """
    key = [*by, "body_sid"]
    rows = elements.where("NOT coalesce(conflict, false)")
    kept = [*by, "ord", "body_sid", "number", "value_offset"]
    whole = rows.where("how = 'whole'").select(*kept, F.lit(0).cast("long").alias("slice"), F.lit(0).cast("long").alias("slice_offset"), F.col("value_length").alias("slice_length"))
    n = F.least(F.floor(F.col("value_length") / F.col("unit")).cast("long"), F.when(F.col("indexed") > 0, F.col("indexed")).otherwise(F.lit((1 << 53) - 1)))
    equal = rows.where("how = 'constant' AND indexed_ok").withColumn("n", n).where(F.col("n") <= most).select(*kept, "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"))
    equal = equal.select(*kept, "slice", (F.col("slice") * F.col("unit")).alias("slice_offset"), F.col("unit").cast("long").alias("slice_length"))
    good = entries.groupBy(*key).agg(F.bool_and("rises").alias("rise"), F.max("place").alias("top")).where("rise")
    clips = rows.where("how = 'variable' AND entries_ok").join(good, key).where("top < value_length")
    cut = clips.select(*kept, "value_length").join(entries.select(*key, "slice", "place", "past"), key)
    cut = cut.select(*kept, "slice", F.col("place").alias("slice_offset"), (F.coalesce("past", "value_length") - F.col("place")).alias("slice_length"))
    return whole.unionByName(equal).unionByName(cut)


def constant_slices(essence: DataFrame) -> DataFrame:
    """essence (id, value_length, unit, indexed) cut into equal slices; a remainder is dropped, and no more slices than indexed (0: no bound)."""
    n = F.least(F.floor(F.col("value_length") / F.col("unit")), F.when(F.col("indexed") > 0, F.col("indexed")).otherwise(F.lit((1 << 53) - 1))).cast("long")
    cut = essence.where("unit > 0 AND value_length >= unit * 2").select("id", "unit", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("slice"))
    return cut.select("id", "slice", (F.col("slice") * F.col("unit")).alias("slice_offset"), F.col("unit").cast("long").alias("slice_length"))


def variable_slices(entries: DataFrame) -> DataFrame:
    """entries (id, pos, stream_offset, value_length) as slices from each offset to the next, the last to the value's end; an element whose offsets don't rise within its value is left out."""
    w = Window.partitionBy("id").orderBy("pos")
    all_ = Window.partitionBy("id")
    rows = entries.withColumn("o", F.col("stream_offset") - F.first("stream_offset").over(w))
    rows = rows.withColumn("good", (F.col("o") >= 0) & (F.col("o") < F.col("value_length")) & F.coalesce(F.col("o") > F.lag("o").over(w), F.lit(True)))
    rows = rows.withColumn("ok", F.bool_and("good").over(all_)).withColumn("past", F.coalesce(F.lead("o").over(w), F.col("value_length")))
    return rows.where("ok").select("id", F.col("pos").alias("slice"), F.col("o").alias("slice_offset"), (F.col("past") - F.col("o")).alias("slice_length"))


def owners(segments: DataFrame, partitions: DataFrame, by: list[str], bucket: int = 1 << 26) -> DataFrame:
    """Each segment (offset, ...) with the offset of the last partition at or before it in its file: both in one order, carried within buckets of ``bucket`` bytes and from one to the next."""
    both = segments.select(*by, "offset", F.lit(None).cast("long").alias("p"), F.lit(1).alias("side")).unionByName(partitions.select(*by, "offset", F.col("offset").alias("p"), F.lit(0).alias("side")))
    return carried(both, by, ["offset", "side"], "p", "owner", bucket).where("side = 1").select(*by, "offset", "owner")


def slice_kind(unit: Column | str, value_length: Column | str, elements: Column | str, n_entries: Column | str) -> Column:
    """How an element is cut: by a constant size, at its entries' offsets, or not at all."""
    u, length = column(unit), column(value_length)
    return F.when((u > 0) & (length >= u * 2), "constant").when((column(elements) == 1) & (column(n_entries) > 1), "variable").otherwise("whole")
