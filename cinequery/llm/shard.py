"""K-d tree sharding by weighted medians over document metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.common import cut

#: Metadata dimensions of a group of equal texts, each as a number.
DIMENSIONS = ("d_lang", "d_source", "d_size")
#: Bits of a place on the cut dimension, and of each of the two steps that refine ties by hash.
BITS = 13, 16, 16
#: Groups of equal texts over this share of a shard's bytes are dealt out in pieces.
PIECE = 1 / 16


def _number(column: str) -> Column:
    """A string's first six bytes as a number: ordered as the strings are, with no table of values."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(column, F.lit("")), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    here = {c.lower() for c in docs.columns}
    value = lambda c: F.col(c).cast("string") if c in here else F.lit(None).cast("string")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("g"), value("lang").alias("lang"), value("source").alias("source"))


def _place() -> Column:
    """Position on the node's dimension in BITS[0] bits, then the bits of the group's hash."""
    value = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
    first = F.when(F.col("width") > 0, F.least(F.lit((1 << BITS[0]) - 1), F.floor((value - F.col("lo")) / F.col("width") * (1 << BITS[0])))).otherwise(F.lit(0)).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64("g", "size", "piece"), 64 - sum(BITS[1:]))
    return F.shiftleft(first, sum(BITS[1:])).bitwiseOR(tie)


def _medians(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, dim, lo, width, want: bytes to go left) with ``at``: places up to it go left. One histogram of bytes a step narrows the weighted median down; no node's rows meet in one task."""
    nodes = nodes.withColumns({"prefix": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    shift = sum(BITS)
    for step, bits in enumerate(BITS):
        shift -= bits
        placed = items.join(F.broadcast(nodes), "node").withColumn("place", _place())
        if step:
            placed = placed.where(F.shiftright("place", shift + bits) == F.col("prefix"))
        steps = placed.groupBy("node", F.shiftright("place", shift).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.first("want").alias("want"))
        along = Window.partitionBy("node").orderBy("bucket")
        upto = steps.withColumns({"upto": F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, 0)), "last": F.max("bucket").over(Window.partitionBy("node"))})
        found = upto.where((F.col("upto") >= F.col("want")) | (F.col("bucket") == F.col("last"))).groupBy("node").agg(F.min(F.struct("bucket", "upto", "bytes")).alias("b"))
        met = nodes.drop("prefix", "at").join(found, "node")
        below = F.col("b.upto") - F.col("b.bytes")
        over = F.col("b.upto") - F.col("want") > F.col("want") - below  # the bucket's few groups go to the nearer side
        nodes = cut(met.select("node", "dim", "lo", "width", (F.col("want") - below).alias("want"), F.col("b.bucket").alias("prefix"), (F.col("b.bucket") - over.cast("long")).alias("at")))
    return nodes


def _tree(items: DataFrame, shards: int) -> DataFrame:
    """items (node 0) with shard: each node with several shards is cut at the weighted median of its widest dimension, level by level.

    The nodes are rows, ``shards`` of them at most, as are the cuts joined to the items; a level's
    items are written before the next is read. node 2k + 1 and 2k + 2 are the sides of node k.
    """
    spans = [F.expr(f"{f}({d}) AS {f}_{i}") for i, d in enumerate(DIMENSIONS) for f in ("min", "max")]
    whole = items.agg(*spans).first()
    scale = [(whole[f"max_{i}"] - whole[f"min_{i}"]) or 1.0 if whole.min_0 is not None else 1.0 for i in range(len(DIMENSIONS))]
    nodes = items.sparkSession.createDataFrame([(0, 0, shards)], "node long, first int, n int")
    for _ in range(math.ceil(math.log2(shards))):
        open_ = nodes.where("n > 1")
        ranges = items.join(F.broadcast(open_), "node").groupBy("node", "n").agg(F.sum("bytes").alias("bytes"), *spans)
        widths = F.array(*((F.col(f"max_{i}") - F.col(f"min_{i}")) / F.lit(x) for i, x in enumerate(scale)))
        dim = (F.array_position("widths", F.array_max("widths")) - 1).cast("int")
        pick = lambda f: F.element_at(F.array(*(F.col(f"{f}_{i}") for i in range(len(DIMENSIONS)))), F.col("dim") + 1)
        table = ranges.withColumn("widths", widths).withColumn("dim", dim).select("node", "dim", pick("min").alias("lo"), (pick("max") - pick("min")).alias("width"), (F.floor((F.col("n") + 1) / 2) / F.col("n") * F.col("bytes")).alias("want"))
        cuts = _medians(items, cut(table)).select("node", "dim", "lo", "width", "at")
        side = F.when(F.col("at").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(_place() <= F.col("at"), 1).otherwise(2))
        items = cut(items.join(F.broadcast(cuts), "node", "left").withColumn("node", side).drop("dim", "lo", "width", "at"))
        left = F.floor((F.col("n") + 1) / 2).cast("int")
        sides = open_.select(F.explode(F.array(F.struct((F.col("node") * 2 + 1).alias("node"), F.col("first").alias("first"), left.alias("n")), F.struct((F.col("node") * 2 + 2).alias("node"), (F.col("first") + left).alias("first"), (F.col("n") - left).alias("n")))).alias("s")).select("s.*")
        nodes = cut(nodes.where("n = 1").unionByName(sides))
    return items.join(F.broadcast(nodes.select("node", F.col("first").alias("shard"))), "node").drop("node")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``.

    Leaves of the tree are the shards: ``shards`` of them, or as many as bring each near
    ``target_bytes``. Law ``bytes``: sizes (UTF-8 bytes plus one; null texts have none) are as near
    equal as whole groups allow. Equal texts share a shard unless they exceed PIECE of one; then
    they are dealt out by doc_id in pieces of that size. Equal rows and null ids are rows as any.
    slot counts each shard's rows from 0, gapless. An empty table gives an empty result. Texts of any
    length count whole; a shard holds at least one text, so one beyond a shard's bytes makes it larger.
    """
    rows = cut(_metadata(docs))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    shards = shards or max(1, math.ceil((total.bytes or 0) / target_bytes))
    group = ["g", "size", "crc"]
    limit = max(1, int((total.bytes or 0) / shards * PIECE))
    # At most shards / PIECE groups can be that large.
    hot = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") * F.col("size") > limit).select(*group, F.ceil(F.col("n") * F.col("size") / limit).alias("pieces"))
    pieces = rows.join(F.broadcast(hot), group, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")).drop("pieces")
    grouped = pieces.groupBy(*group, "piece").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    items = cut(grouped.select(*group, "piece", "bytes", F.lit(0).cast("long").alias("node"), _number("lang").alias("d_lang"), _number("source").alias("d_source"), F.log2(F.col("size").cast("double")).alias("d_size")))
    placed = pieces.join(_tree(items, shards).select(*group, "piece", "shard"), [*group, "piece"])
    # Slots: rows are counted in small buckets, which start where the earlier ones of their shard end.
    buckets = max(64, math.ceil(total.n / shards / 50_000))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g"), F.lit(buckets)).cast("int"))
    begins = placed.groupBy("shard", "bucket").count().withColumn("begin", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    turn = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g"))
    return placed.join(begins, ["shard", "bucket"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("begin") + turn - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
