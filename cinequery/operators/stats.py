"""Statistics over groups: sample differences, nearest-rank percentiles, benchmark summaries, and the edit-rate search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.operators.settle import settled

#: Bins of a range of values, and copies of a key's ranges over which its values are dealt.
BINS, COPIES = 4096, 16


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str, bucket: int) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row of its group in ``order``, a number.

    The order is dealt into buckets of ``bucket``; a bucket's rows start from the sum of the buckets
    before, so a group of any size is summed in many tasks.
    """
    dealt = rows.withColumns({"in bucket": F.floor(F.col(order) / bucket), "its value": value})
    sums = dealt.groupBy(*by, "in bucket").agg(F.sum("its value").alias("all of it"))
    earlier = Window.partitionBy(*by).orderBy("in bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "in bucket", F.coalesce(F.sum("all of it").over(earlier), F.lit(0)).alias("before it"))
    within = Window.partitionBy(*by, "in bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, [*by, "in bucket"]).withColumn(name, F.col("before it") + F.sum("its value").over(within)).select(*rows.columns, name)


def differences(rows: DataFrame, key: str) -> DataFrame:
    """Largest and mean distance of ``left`` and ``right``, and how many are over 1, 2 and 8."""
    d = F.abs(F.col("left") - F.col("right"))
    return rows.groupBy(key).agg(F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), *(F.count_if(d > n).alias(f"over_{n}") for n in (1, 2, 8)))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Nearest-rank percentiles of each key: exact, by default the median p50 and p95; ``shares`` has (numerator, denominator) by column name.

    Values are counted by (key, value) in many tasks. Then the range that holds each rank is cut
    into BINS, the bins' counts tell which one the rank falls into, and that bin's own smallest and
    largest value are the next range, until these are one value. So no task holds a key's values:
    a key takes part with its bins alone. Keys without a value give null; NaN is above all numbers.
    """
    shares = shares or {"p50": (1, 2), "p95": (19, 20)}
    keys = rows.select(F.col(key).alias("its key")).distinct().withColumn("name", F.explode(F.array(*map(F.lit, shares))))
    copy = F.pmod(F.xxhash64("v"), F.lit(COPIES)).cast("int").alias("copy")
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("its key"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counted = settled(counted.select("its key", "v", "n", copy))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for name, (a, b) in shares.items()))).alias("share")
    whole = counted.groupBy("its key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"))
    rank = F.greatest(F.expr("(share.a * all + share.b - 1) div share.b"), F.lit(1).cast("long"))
    state = settled(whole.select("its key", "low", "high", "all", asked).select("its key", "share.name", "low", "high", rank.alias("rank")))
    done = state.where("low = high")
    while not (state := state.where("low < high")).isEmpty():
        # A key's ranges are repeated, so that a hot key's values meet them in many tasks.
        ranges = state.withColumnRenamed("its key", "of").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        met = counted.join(ranges, F.col("its key").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("to"))).where("v >= low AND v <= high")
        at = (F.col("v").cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low")) * BINS
        inner = F.when(F.isnan(at), 1).otherwise(F.least(F.greatest(F.floor(at), F.lit(1)), F.lit(BINS - 2)))
        bin_ = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), BINS - 1).otherwise(inner).cast("int")
        bins = met.groupBy("its key", "name", "rank", bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("its key", "name").orderBy("bin"))
        bins = bins.withColumn("upto", upto).where("rank <= upto AND rank > upto - n")
        state = settled(bins.select("its key", "name", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        done = done.unionByName(state.where("low = high"))
    found = keys.join(done.select(F.col("its key").alias("k"), F.col("name").alias("m"), "low"), F.col("its key").eqNullSafe(F.col("k")) & (F.col("name") == F.col("m")), "left")
    return found.groupBy(F.col("its key").alias(key)).agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in shares))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Frames, frames a second of milliseconds in ``value``, median, 95th percentile and sum."""
    totals = rows.groupBy(key).agg(F.count("*").alias("frames"), F.round(F.count("*") / F.sum(value) * 1000, 3).alias("fps"), F.round(F.sum(value), 3).alias("total"))
    ranked = percentiles(rows, key, value).withColumnRenamed(key, "of")
    return totals.join(ranked, F.col(key).eqNullSafe(F.col("of"))).select(key, "frames", "fps", "p50", "p95", "total")


def carried(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, bucket: int) -> DataFrame:
    """``rows`` with the last value that isn't null at or before each row of its group, in the order of the columns ``order``, of which the first is a number.

    That number is dealt into buckets of ``bucket``: each row looks within its bucket, and where
    nothing stands before it there, at the last value of the buckets before. A group of any size is
    so carried through in many tasks, and only its buckets meet in one. Groups and orders aren't null.
    """
    dealt = rows.withColumn("in bucket", F.floor(F.col(order[0]) / bucket))
    place = F.struct(*order)
    last = dealt.groupBy(*by, "in bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("last of it"))
    earlier = Window.partitionBy(*by).orderBy("in bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*by, "in bucket", F.last("last of it", True).over(earlier).alias("before it"))
    within = Window.partitionBy(*by, "in bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before.hint("merge"), [*by, "in bucket"]).withColumn(name, F.coalesce(F.last(value, True).over(within), "before it")).select(*rows.columns, *([name] if name not in rows.columns else []))


def listed(rows: DataFrame, by: list[str], order: str, value: str, bucket: int, size: int) -> DataFrame:
    """The values of each group in order, as lists of ``size`` at most: by, chunk (from 0), list.

    Rows are numbered within buckets of ``order`` after the counts of those before (``running``), so
    no task holds a group, and a list is of bounded size whatever the group's.
    """
    numbered = running(rows, by, order, F.lit(1).cast("long"), "its number", bucket)
    chunk = F.expr(f"(`its number` - 1) div {size}").alias("chunk")
    return numbered.groupBy(*by, chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("its number", value))), lambda e: e[value]).alias("list"))


def sniff_rate(files: DataFrame, key: str, tag_hex: str, window: int = 2 << 20) -> DataFrame:
    """The first rational after a tag in the file's first bytes that is a rate of 1 to 240; null where none is."""
    # One character a byte, so that the search stays on byte borders.
    text = F.decode(F.substring("payload", 1, window), "ISO-8859-1")
    tag = "".join(f"\\x{tag_hex[i : i + 2]}" for i in range(0, len(tag_hex), 2))
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"(?s){tag}(.{{8}})"), 1), lambda h: F.hex(F.encode(h, "ISO-8859-1")))
    number = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    good = F.filter(hits, lambda h: (number(h, 1) > 0) & (number(h, 9) > 0) & (number(h, 1) / F.greatest(number(h, 9), F.lit(1)) >= 1) & (number(h, 1) / F.greatest(number(h, 9), F.lit(1)) <= 240))
    first = F.get(good, 0)
    return files.select(key, number(first, 1).alias("numerator"), number(first, 9).alias("denominator"))
