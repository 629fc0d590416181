"""Container relations: keys, sets, tracks, compositions and packets as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions.binary import be_i64, be_u64, be_uint, column, cut, hex_lower, safe_integer, signed_byte, utf16be
from cinequery.operators.klv import ESSENCE_PREFIXES, PARTITION_PREFIX, SET_TYPES
from cinequery.operators.settle import settled
from cinequery.operators.stats import carried, running

#: The most rows of a container that are taken before it is refused.
LIMITS = {"metadata_sets": 100_000, "klv_packets": 2_000_000, "tracks": 1_024, "packets": 2_000_000, "metadata_bytes": 64 << 20, "resync_bytes": 16 << 20}


def key_class(key: Column | str) -> Column:
    k = column(key)
    essence = reduce(lambda a, b: a | b, (F.startswith(k, F.lit(p)) for p in ESSENCE_PREFIXES))
    partition = F.startswith(k, F.lit(PARTITION_PREFIX)) & F.substring(k, 27, 2).isin("02", "03", "04")
    return F.when(essence, "essence").when(partition, "partition").otherwise("other")


def set_types(spark) -> DataFrame:
    return spark.createDataFrame(list(SET_TYPES.items()), "key_hex string, type string")


def set_type(key: Column | str) -> Column:
    """The type of a set by its key, null of any other key."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in SET_TYPES.items() for x in pair)), column(key))


def essence_kind(item_type: Column | str) -> Column:
    t = column(item_type)
    return F.when(t == 0x14, "system").when(t == 0x15, "video").when(t == 0x16, "audio").when(t == 0x17, "data").otherwise("unknown")


def data_definition_kind(label: Column | str) -> Column:
    ends = lambda tail: F.endswith(column(label), F.lit(tail))
    return F.when(ends("0103020101000000"), "timecode").when(ends("0103020201000000"), "video").when(ends("0103020202000000"), "audio").otherwise("unknown")


def partition_kind(code: Column | str) -> Column:
    c = column(code)
    return F.when(c == 2, "header").when(c == 3, "body").when(c == 4, "footer").otherwise("unknown")


def operational_pattern(label: Column | str) -> Column:
    v = column(label)
    return F.when(v.rlike("^060e2b34040101010d01020101[0-9a-f]{4}00$"), "op1a").when(v.rlike("^060e2b34040101020d01020110[0-9a-f]{4}00$"), "opatom")


def partition_pack(value: Column | str) -> Column:
    """Fields of a partition pack of at least 80 bytes, else null. Essence containers are none where their list is cut short or its items aren't 16 bytes."""
    u = lambda at, n: be_uint(value, at, n)
    safe = lambda at: safe_integer(be_u64(value, at))
    count, size = u(80, 4), u(84, 4)
    fits = (size == 16) & (F.octet_length(column(value)) >= 88 + count * 16) & (count > 0)
    containers = F.when(F.coalesce(fits, F.lit(False)), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0))), lambda i: hex_lower(cut(value, 88 + i * 16, 16)))).otherwise(F.array().cast("array<string>"))
    return F.when(
        F.octet_length(column(value)) >= 80,
        F.struct(
            u(0, 2).cast("int").alias("major"), u(2, 2).cast("int").alias("minor"), u(4, 4).alias("kag_size"), safe(8).alias("this_partition"), safe(16).alias("previous_partition"), safe(24).alias("footer_partition"),
            safe(32).alias("header_byte_count"), safe(40).alias("index_byte_count"), u(48, 4).alias("index_sid"), safe(52).alias("body_offset"), u(60, 4).alias("body_sid"), hex_lower(cut(value, 64, 16)).alias("operational_pattern"), containers.alias("essence_containers"),
        ),
    )


def fixed_entries(value: Column | str, start: Column | int, count: Column, width: Column | int, make) -> Column:
    """``count`` structs of ``width`` bytes each, from ``start`` on; make(offset) gives one."""
    begin = F.lit(start) if isinstance(start, int) else start
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count.cast("long") - 1, F.lit(0).cast("long"))), lambda i: make(begin + i * width))).otherwise(F.array())


def counted_entries(value: Column | str, least: int, make) -> Column:
    """Entries after a count and a length of each, which may be longer than the ``least`` bytes that are read; null where they don't fit, none in a value too short for the counts."""
    count, width, size = be_uint(value, 0, 4), be_uint(value, 4, 4), F.octet_length(column(value))
    fits = (width >= least) & (8 + count * width <= size)
    return F.when(fits | (size < 8), fixed_entries(value, 8, F.when(size >= 8, count).otherwise(0), width, make))


def primer_entries(value: Column | str) -> Column:
    return counted_entries(value, 18, lambda at: F.struct(be_uint(value, at, 2).cast("int").alias("tag"), hex_lower(cut(value, at + 2, 16)).alias("label")))


def index_entries(value: Column | str) -> Column:
    return counted_entries(value, 11, lambda at: F.struct(signed_byte(be_uint(value, at, 1)).alias("temporal"), signed_byte(be_uint(value, at + 1, 1)).alias("key"), be_uint(value, at + 2, 1).cast("int").alias("flags"), safe_integer(be_u64(value, at + 3)).alias("stream_offset")))


def random_index(value: Column | str) -> Column:
    """Rows of 12 bytes before the four-byte trailer."""
    count = F.floor((F.octet_length(column(value)) - 4) / 12)
    return fixed_entries(value, 0, count, 12, lambda at: F.struct(be_uint(value, at, 4).alias("body_sid"), safe_integer(be_u64(value, at + 4)).alias("byte_offset")))


def reference_array(value: Column | str) -> Column:
    """References as hex, the first 16 bytes of each entry; empty where the header or length doesn't fit."""
    count, size = be_uint(value, 0, 4), be_uint(value, 4, 4)
    fits = F.coalesce((size >= 16) & (F.octet_length(column(value)) >= 8 + count * size), F.lit(False))
    return F.when(fits & (count > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))), lambda i: hex_lower(cut(value, 8 + i * size, 16)))).otherwise(F.array().cast("array<string>"))


def item(items: Column | str, tag: int) -> Column:
    """The first value of a tag, or null."""
    return F.get(F.filter(column(items), lambda i: i["tag"] == tag), 0)["value"]


def item_u32(items: Column | str, tag: int) -> Column:
    return be_uint(item(items, tag), 0, 4)


def item_u16(items: Column | str, tag: int) -> Column:
    return be_uint(item(items, tag), 0, 2)


def item_i64(items: Column | str, tag: int) -> Column:
    return be_i64(item(items, tag), 0)


def item_uid(items: Column | str, tag: int) -> Column:
    """The first 16 bytes of a value as hex, null of a shorter one."""
    v = item(items, tag)
    return F.when(F.octet_length(v) >= 16, hex_lower(cut(v, 0, 16)))


def item_hex(items: Column | str, tag: int) -> Column:
    return hex_lower(item(items, tag))


def item_string(items: Column | str, tag: int) -> Column:
    return utf16be(item(items, tag))


def item_references(items: Column | str, tag: int) -> Column:
    return reference_array(item(items, tag))


def item_rational(items: Column | str, tag: int) -> Column:
    v = item(items, tag)
    num, den = be_uint(v, 0, 4), be_uint(v, 4, 4)
    return F.when((num != 0) & (den != 0), F.struct(num.alias("num"), den.alias("den")))


def stored_depth(block_align: Column | str, channels: Column | str, bits: Column | str) -> Column:
    """Bits of a stored sample: from the block size where that divides, else the valid bits."""
    a, c = column(block_align), column(channels)
    return F.when((a > 0) & (c > 0) & (a % F.when(c == 0, 1).otherwise(c) == 0), F.floor(a / c).cast("long") * 8).otherwise(column(bits))


def descriptor(items: Column | str) -> Column:
    """The sixteen fields of a descriptor set but its instance_uid: null where a tag is missing or short."""
    channels, bits, align = item_u32(items, 0x3D07), item_u32(items, 0x3D01), item_u16(items, 0x3D0A)
    fields = {
        "linked_track_id": item_u32(items, 0x3006), "essence_container": item_hex(items, 0x3004),
        "codec": F.coalesce(item_hex(items, 0x3201), item_hex(items, 0x3D06), item_hex(items, 0x3005)),
        "width": item_u32(items, 0x3203), "height": item_u32(items, 0x3202), "aspect_ratio": item_rational(items, 0x320E),
        "component_depth": item_u32(items, 0x3301), "horizontal_subsampling": item_u32(items, 0x3302), "vertical_subsampling": item_u32(items, 0x3308),
        "sample_rate": item_rational(items, 0x3D03), "channels": channels, "bits_per_sample": bits, "stored_bits_per_sample": stored_depth(align, channels, bits),
        "block_align": align, "duration": item_i64(items, 0x3002),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def carry_body_sid(rows: DataFrame, by: list[str], order: str, bucket: int = 100_000) -> DataFrame:
    """Each row with the body_sid of the last partition at or before it in its file, 0 before the first: looked up within buckets of ``order`` after the last of those before, so that a file of any length is carried through in many tasks."""
    return carried(rows, by, [order], "partition_body_sid", "body_sid", bucket).withColumn("body_sid", F.coalesce("body_sid", F.lit(0).cast("long")))


TRACK = ["body_sid", "number"]


def track_groups(essence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of elements and kind of the first of each (body_sid, number), in each file where ``by`` names it."""
    return essence.groupBy(*by, *TRACK).agg(F.count("*").alias("packet_count"), F.min_by("item_type", "ord").alias("item_type"), F.min("ord").alias("first_ord"))


def match_tracks(sets: DataFrame, essence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Track sets with their essence: by (linked_sid, number), or for sets without a link by number in every body. One row for each matching group, with has_descriptor and the set's order."""
    groups = track_groups(essence, by)
    linked = sets.where("linked_sid > 0").withColumn("body_sid", F.col("linked_sid")).join(groups, [*by, *TRACK])
    free = sets.where("linked_sid IS NULL OR linked_sid = 0").join(groups, [*by, "number"])
    return linked.unionByName(free)


def preferred(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each (body_sid, number) the first candidate with a descriptor, or the first; place is where the first candidate stands."""
    group = Window.partitionBy(*by, *TRACK)
    w = group.orderBy(F.desc("has_descriptor"), "set_ord")
    return candidates.withColumns({"turn": F.row_number().over(w), "place": F.min("set_ord").over(group)}).where("turn = 1").drop("turn")


def synthetic_tracks(essence: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Tracks for essence that no set describes: edit rate 1/1, duration the number of elements."""
    rest = track_groups(essence, by).join(tracks.select(*by, *TRACK), [*by, *TRACK], "left_anti")
    return rest.select(*by, "body_sid", "number", F.col("number").alias("track_id"), "packet_count", F.col("packet_count").alias("duration"), F.lit(1).alias("rate_num"), F.lit(1).alias("rate_den"), "item_type", "first_ord")


def packet_index(essence: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Each element's place among its track's, from 0: counted within buckets of ``ord`` after the counts of those before, so that a track of any length is numbered in many tasks."""
    counted = running(essence, TRACK, "ord", F.lit(1).cast("long"), "packet_index", bucket)
    return counted.withColumn("packet_index", F.col("packet_index") - 1)


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def timing(index: Column | str, origin: Column | str, num: Column | str, den: Column | str) -> dict[str, Column]:
    duration = column(den).cast("double") / column(num)
    start = (column(index).cast("double") + column(origin).cast("double")) * duration
    return {"timestamp": start, "duration": duration, "timestamp_us": js_round(start * 1_000_000), "duration_us": js_round(duration * 1_000_000)}


def limit_failures(counts: DataFrame) -> DataFrame:
    """Rows (what, n) whose n exceeds LIMITS."""
    table = counts.sparkSession.createDataFrame(list(LIMITS.items()), "what string, most long")
    return counts.join(F.broadcast(table), "what").where("n > most")


def flatten(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """Leaves under each root in depth-first order: root, leaf, path; a sequence met on its own path gives a cycle row (leaf null).

    ``graph``: parent, pos, child, is_leaf. Levels are joined one by one until none is open, which
    cycle rows make certain; each level is checkpointed, so that none is computed twice.
    """
    level = roots.select("root", F.col("root").alias("node"), F.array(F.col("root").cast("string")).alias("seen"), F.array().cast("array<long>").alias("path"))
    done = None
    edges = graph.select(F.col("parent").alias("node"), "pos", "child", "is_leaf")
    while True:
        step = settled(level.join(edges, "node").select("root", F.col("child").alias("node"), "is_leaf", F.array_contains("seen", F.col("child").cast("string")).alias("cycle"), "seen", F.array_append("path", F.col("pos").cast("long")).alias("path")))
        found = step.where("is_leaf OR cycle").select("root", F.when(~F.col("cycle"), F.col("node")).alias("leaf"), "path")
        done = found if done is None else done.unionByName(found)
        level = step.where("NOT is_leaf AND NOT cycle").select("root", "node", F.array_append("seen", F.col("node").cast("string")).alias("seen"), "path")
        if level.isEmpty():
            break
    return done
