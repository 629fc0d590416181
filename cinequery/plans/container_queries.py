"""Container metadata: packs, sets, tracks, joins, packets and structure."""

from pyspark.sql import functions as F

from cinequery.functions import binary as B
from cinequery.operators import container as C
from cinequery.operators import index as I
from cinequery.operators import klv, stats, validate
from cinequery.plans.registry import query
from cinequery.sources.tables import held, read

#: Essence elements out of the events table; the same text runs in Spark and in the counterpart.
ESS = "SELECT event_id AS ord, CAST(ascii(event_type) % 3 + 1 AS BIGINT) AS body_sid, user_id % 16 AS number, 20 + event_id % 4 AS item_type, CAST(floor(abs(value) * 100) AS BIGINT) AS value_length FROM events"
#: Track sets: three for each number, with and without a link or a descriptor.
SETS = "SELECT DISTINCT user_id % 24 AS number, k AS set_ord, CASE k WHEN 0 THEN CAST(NULL AS BIGINT) ELSE k END AS linked_sid, (user_id + k) % 2 = 0 AS has_descriptor FROM (SELECT user_id, unnest([0, 1, 2]) AS k FROM events WHERE user_id % 24 <> 3)"
#: Index segments: body_sid, start, length of runs of events, with gaps and overlaps.
SEG = "SELECT DISTINCT event_id // 100 AS segment, event_id // 100 % 3 + 1 AS body_sid, event_id // 300 * 100 AS start, CASE WHEN event_id // 100 % 7 = 0 THEN 130 WHEN event_id // 100 % 11 = 0 THEN 0 ELSE 100 END AS length FROM events"
PART = "SELECT o_orderkey, o_orderkey // 16 AS file, (o_orderkey % 16) * 1024 AS off, o_orderkey % 16 AS k FROM orders"
H = "lpad(hex({}), {}, '0')"


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def essence(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id AS ord", "CAST(ascii(event_type) % 3 + 1 AS BIGINT) AS body_sid", "user_id % 16 AS number", "20 + event_id % 4 AS item_type", "CAST(floor(abs(value) * 100) AS BIGINT) AS value_length")


def track_sets(spark, sf_dir):
    numbers = events(spark, sf_dir).where("user_id % 24 <> 3").selectExpr("user_id", "explode(array(0, 1, 2)) AS k")
    return numbers.selectExpr("user_id % 24 AS number", "k AS set_ord", "CAST(nullif(k, 0) AS BIGINT) AS linked_sid", "(user_id + k) % 2 = 0 AS has_descriptor").distinct()


def segments(spark, sf_dir):
    s = events(spark, sf_dir).selectExpr("event_id div 100 AS segment").distinct()
    return s.selectExpr("segment", "segment % 3 + 1 AS body_sid", "segment div 3 * 100 AS start", "CAST(CASE WHEN segment % 7 = 0 THEN 130 WHEN segment % 11 = 0 THEN 0 ELSE 100 END AS BIGINT) AS length")


@query(
    "essence_elements",
    """SELECT event_id, event_id % 4 AS element_number, coalesce(last_value(CASE WHEN event_id % 50 = 0 THEN event_id // 50 % 7 END IGNORE NULLS) OVER (PARTITION BY user_id % 8 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS body_sid FROM events""",
)
def essence_elements(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", "user_id % 8 AS file", "event_id % 4 AS element_number", "CASE WHEN event_id % 50 = 0 THEN event_id div 50 % 7 END AS partition_body_sid")
    return C.carry_body_sid(rows, ["file"], "event_id").select("event_id", "element_number", "body_sid")


@query("essence_kind", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'system' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'data' ELSE 'unknown' END AS kind FROM events")
def essence_kind(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", C.essence_kind(0x14 + F.col("event_id") % 7).alias("kind"))


@query("datadef_kind", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'timecode' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'unknown' END AS kind FROM events")
def datadef_kind(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ("0103020101000000", "0103020201000000", "0103020202000000", "0103020203000000"))), (F.col("event_id") % 4).cast("int") + 1)
    return events(spark, sf_dir).select("event_id", C.data_definition_kind(F.concat(F.lit("060e2b3404010101"), tail)).alias("kind"))


@query(
    "partition_decode",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'header' WHEN 3 THEN 'body' ELSE 'unknown' END AS kind, o_orderkey % 3 AS major, o_orderkey * 1024 AS this_partition, o_orderkey % 9 AS index_sid, o_orderkey % 5 AS body_sid,
    CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 3 END AS containers, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 3 > 0 THEN lpad(lower(hex(o_orderkey)), 32, '0') END AS first_container FROM orders""",
)
def partition_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    zero = lambda n: F.unhex(F.lit("00" * n))
    label = F.unhex(F.lpad(F.hex(k), 32, "0"))
    count = k % 3
    pack = F.concat(B.be_bytes(count, 2), zero(2), B.be_bytes(F.lit(512), 4), B.be_bytes(k * 1024, 8), zero(32), B.be_bytes(k % 9, 4), zero(8), B.be_bytes(k % 5, 4), label, B.be_bytes(count, 4), B.be_bytes(F.when(k % 6 == 0, 15).otherwise(16), 4), F.when(count > 0, label).otherwise(zero(0)), F.when(count > 1, label).otherwise(zero(0)))
    packs = read(spark, sf_dir, "orders").select("o_orderkey", held(pack))
    rows = packs.select("o_orderkey", C.partition_kind(k % 4).alias("kind"), F.explode(F.array(C.partition_pack("value"))).alias("p"))
    return rows.select("o_orderkey", "kind", F.col("p.major").cast("long").alias("major"), "p.this_partition", "p.index_sid", "p.body_sid", F.size("p.essence_containers").cast("long").alias("containers"), F.get("p.essence_containers", F.lit(0)).alias("first_container"))


@query(
    "primer_map",
    """SELECT file, tag, label FROM (SELECT event_id // 100 AS file, CAST(32768 + user_id % 40 AS INTEGER) AS tag, lpad(lower(hex(event_id)), 32, '0') AS label,
    row_number() OVER (PARTITION BY event_id // 100, user_id % 40 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def primer_map(spark, sf_dir):
    value = F.concat(B.be_bytes(F.lit(1), 4), B.be_bytes(F.lit(18), 4), B.be_bytes(32768 + F.col("user_id") % 40, 2), F.unhex(F.lpad(F.hex("event_id"), 32, "0")))
    primers = events(spark, sf_dir).select("event_id", F.expr("event_id div 100").alias("file"), held(value)).select("event_id", "file", F.explode(C.primer_entries("value")).alias("e"))
    return primers.groupBy("file", F.col("e.tag").alias("tag")).agg(F.max_by("e.label", "event_id").alias("label"))


def order_sets(spark, sf_dir):
    """Local sets out of orders: tag 0x3006 the key, 0x3d07 channels, 0x3d0a block size, 0x3d01 bits, 0x3202 a name; every ninth with a byte too many."""
    k = F.col("o_orderkey")
    item = lambda tag, value, n: F.concat(B.be_bytes(F.lit(tag), 2), B.be_bytes(F.lit(n), 2), value)
    payload = F.concat(
        item(0x3006, B.be_bytes(k, 4), 4), item(0x3D07, B.be_bytes(k % 4, 4), 4), item(0x3D0A, B.be_bytes(k % 13, 2), 2), item(0x3D01, B.be_bytes(16 + k % 9, 4), 4),
        item(0x3002, B.be_bytes(k - 1000, 8), 8), item(0x4B01, F.concat(B.be_bytes(k % 3 * 30000, 4), B.be_bytes(F.lit(1001), 4)), 8), F.when(k % 9 == 0, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit(""))),
    )
    return klv.local_sets(read(spark, sf_dir, "orders").select(k.alias("id"), payload.alias("payload")))


@query(
    "local_set",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 6 END AS n_items, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS linked_track, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey - 1000 END AS duration, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 3 > 0 THEN o_orderkey % 3 * 30000 END AS rate_num FROM orders",
)
def local_set(spark, sf_dir):
    sets = order_sets(spark, sf_dir)
    return sets.select(F.col("id").alias("o_orderkey"), F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), C.item_u32("items", 0x3006).alias("linked_track"), C.item_i64("items", 0x3002).alias("duration"), C.item_rational("items", 0x4B01)["num"].alias("rate_num"))


@query(
    "descriptor_depth",
    """SELECT o_orderkey, c AS channels, CASE WHEN a > 0 AND c > 0 AND a % c = 0 THEN a // c * 8 ELSE bits END AS stored_bits
    FROM (SELECT o_orderkey, o_orderkey % 4 AS c, o_orderkey % 13 AS a, 16 + o_orderkey % 9 AS bits FROM orders WHERE o_orderkey % 9 <> 0)""",
)
def descriptor_depth(spark, sf_dir):
    d = order_sets(spark, sf_dir).where("items IS NOT NULL").select(F.col("id").alias("o_orderkey"), C.item_u32("items", 0x3D07).alias("channels"), C.item_u16("items", 0x3D0A).alias("align"), C.item_u32("items", 0x3D01).alias("bits"))
    return d.select("o_orderkey", "channels", C.stored_depth("align", "channels", "bits").alias("stored_bits"))


@query(
    "index_decode",
    """SELECT o_orderkey, CAST(i AS BIGINT) AS pos, CAST(CASE WHEN (o_orderkey + i) % 256 > 127 THEN (o_orderkey + i) % 256 - 256 ELSE (o_orderkey + i) % 256 END AS INTEGER) AS temporal, CAST(128 AS INTEGER) AS flags, o_orderkey * 4096 + i AS stream_offset
    FROM orders, unnest(range(0, o_orderkey % 4)) t(i)""",
)
def index_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    entry = lambda i: F.concat(B.be_bytes(k + i, 1), B.be_bytes(F.lit(0), 1), B.be_bytes(F.lit(128), 1), B.be_bytes(k * 4096 + i, 8))
    none = F.unhex(F.lit(""))
    value = F.concat(B.be_bytes(k % 4, 4), B.be_bytes(F.lit(11), 4), *(F.when(k % 4 > i, entry(i)).otherwise(none) for i in range(3)))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", held(value)).select("o_orderkey", F.posexplode(C.index_entries("value")).alias("pos", "e"))
    return rows.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "e.temporal", "e.flags", "e.stream_offset")


@query("rip_decode", "SELECT o_orderkey, i AS body_sid, o_orderkey * 100 + i AS byte_offset FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4)) AS i FROM orders)")
def rip_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.unhex(F.lit(""))
    value = F.concat(*(F.when(k % 4 > i, F.concat(B.be_bytes(F.lit(i), 4), B.be_bytes(k * 100 + i, 8))).otherwise(none) for i in range(3)), B.be_bytes(F.lit(0), 4))
    return read(spark, sf_dir, "orders").select("o_orderkey", held(value)).select("o_orderkey", F.explode(C.random_index("value")).alias("e")).select("o_orderkey", "e.body_sid", "e.byte_offset")


@query("ref_array", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0 ELSE o_orderkey % 3 END AS n, CASE WHEN o_orderkey % 5 NOT IN (0, 1) AND o_orderkey % 3 > 0 THEN lpad(lower(hex(o_orderkey)), 32, '0') END AS first FROM orders")
def ref_array(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = F.unhex(F.lpad(F.hex(k), 32, "0"))
    none = F.unhex(F.lit(""))
    n = F.when(k % 5 == 1, 9).otherwise(k % 3)
    value = F.concat(B.be_bytes(n, 4), B.be_bytes(F.when(k % 5 == 0, 12).otherwise(16), 4), F.when(k % 3 > 0, ref).otherwise(none), F.when(k % 3 > 1, ref).otherwise(none))
    return read(spark, sf_dir, "orders").select("o_orderkey", held(value)).select("o_orderkey", F.explode(F.array(C.reference_array("value"))).alias("r")).select("o_orderkey", F.size("r").cast("long").alias("n"), F.get("r", F.lit(0)).alias("first"))


@query("op_classify", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'op1a' WHEN 1 THEN 'opatom' END AS pattern FROM orders")
def op_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    start = F.when(k % 3 == 0, "060e2b34040101010d01020101").when(k % 3 == 1, "060e2b34040101020d01020110").otherwise("060e2b34040101010d01020102")
    return read(spark, sf_dir, "orders").select("o_orderkey", C.operational_pattern(F.concat(start, F.lpad(F.lower(F.hex(k % 65536)), 4, "0"), F.lit("00"))).alias("pattern"))


@query("dim_metadata_type", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Track' WHEN 1 THEN 'Sequence' END AS type FROM orders")
def dim_metadata_type(spark, sf_dir):
    k = F.col("o_orderkey")
    keys = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "060e2b34025301010d01010101013b00").when(k % 3 == 1, "060e2b34025301010d01010101010f00").otherwise("060e2b34025301010d01010101017f00").alias("key_hex"))
    return keys.join(F.broadcast(C.set_types(spark)), "key_hex", "left").select("o_orderkey", "type")


@query("packets_for_track", f"SELECT ord, body_sid FROM ({ESS}) WHERE number = 5")
def packets_for_track(spark, sf_dir):
    return essence(spark, sf_dir).where("number = 5").select("ord", "body_sid")


@query("packets_for_keyed_track", f"SELECT ord FROM ({ESS}) WHERE number = 5 AND body_sid = 2")
def packets_for_keyed_track(spark, sf_dir):
    return essence(spark, sf_dir).where("number = 5 AND body_sid = 2").select("ord")


GROUPS = f"SELECT body_sid, number, count(*) AS packet_count, min_by(item_type, ord) AS item_type FROM ({ESS}) GROUP BY ALL"
MATCHED = f"""SELECT g.body_sid, g.number, s.set_ord, s.has_descriptor, g.packet_count, g.item_type FROM ({GROUPS}) g JOIN ({SETS}) s ON s.number = g.number AND (s.linked_sid IS NULL OR s.linked_sid = g.body_sid)"""


@query("join_essence_track", f"SELECT body_sid, number, set_ord, packet_count FROM ({MATCHED}) WHERE set_ord > 0")
def join_essence_track(spark, sf_dir):
    return C.match_tracks(track_sets(spark, sf_dir).where("linked_sid > 0"), essence(spark, sf_dir)).select("body_sid", "number", "set_ord", "packet_count")


@query("join_fallback", f"SELECT body_sid, number, set_ord, packet_count FROM ({MATCHED})")
def join_fallback(spark, sf_dir):
    return C.match_tracks(track_sets(spark, sf_dir), essence(spark, sf_dir)).select("body_sid", "number", "set_ord", "packet_count")


@query("dedup_prefer", f"SELECT body_sid, number, set_ord, has_descriptor FROM ({MATCHED}) QUALIFY row_number() OVER (PARTITION BY body_sid, number ORDER BY has_descriptor DESC, set_ord) = 1")
def dedup_prefer(spark, sf_dir):
    return C.preferred(C.match_tracks(track_sets(spark, sf_dir), essence(spark, sf_dir))).select("body_sid", "number", "set_ord", "has_descriptor")


@query("join_anti_synth", f"SELECT body_sid, number, number AS track_id, packet_count, packet_count AS duration, 1 AS rate_num, 1 AS rate_den FROM ({GROUPS}) WHERE number NOT IN (SELECT number FROM ({SETS}))")
def join_anti_synth(spark, sf_dir):
    e = essence(spark, sf_dir)
    return C.synthetic_tracks(e, C.match_tracks(track_sets(spark, sf_dir), e)).drop("item_type", "first_ord")


@query("join_descriptor", "SELECT o.o_orderkey, min(l.l_linenumber) AS descriptor FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND list_contains([1, 3, o.o_orderkey % 7], l.l_linenumber) GROUP BY o.o_orderkey")
def join_descriptor(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit(1).cast("long"), F.lit(3).cast("long"), F.col("o_orderkey") % 7).alias("allowed"))
    met = wanted.join(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), (F.col("l_orderkey") == F.col("o_orderkey")) & F.array_contains("allowed", F.col("l_linenumber").cast("long")), "left")
    return met.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("descriptor"))


@query(
    "join_container_data",
    "SELECT n.n_nationkey AS container, r.r_name AS package, c.c_custkey AS track FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey",
)
def join_container_data(spark, sf_dir):
    tracks = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    data = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return data.join(tracks, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_nationkey").alias("container"), F.col("r_name").alias("package"), F.col("c_custkey").alias("track"))


@query("descriptor_expand", "SELECT DISTINCT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderkey, o_orderkey + 1, o_orderkey, o_orderkey + 2] ELSE [o_orderkey] END) AS uid FROM orders")
def descriptor_expand(spark, sf_dir):
    k = F.col("o_orderkey")
    subs = F.when(k % 3 == 0, F.array(k + 1, k, k + 2)).otherwise(F.array().cast("array<long>"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_union(F.array(k), subs)).alias("uid"))


@query("join_source_clip", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, count(s.s_suppkey) AS tracks FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = l.l_partkey % 25 GROUP BY ALL")
def join_source_clip(spark, sf_dir):
    clips = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_partkey % 25 AS track_id")
    tracks = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "CAST(s_nationkey AS BIGINT) AS track_id", "s_suppkey AS source_track")
    return clips.join(tracks, ["l_suppkey", "track_id"], "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("source_track").alias("tracks"))


@query("semi_referenced", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1) AS referenced FROM part")
def semi_referenced(spark, sf_dir):
    tracks, clips = read(spark, sf_dir, "part").select("p_partkey"), read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return tracks.join(clips, "p_partkey", "left_semi").withColumn("referenced", F.lit(True)).unionByName(tracks.join(clips, "p_partkey", "left_anti").withColumn("referenced", F.lit(False)))


@query(
    "range_join_index",
    f"""SELECT e.id, e.body_sid, e.position, count(s.segment) AS covering, CASE WHEN count(s.segment) = 1 THEN min(s.segment) END AS segment, CASE WHEN count(s.segment) = 1 THEN min(s.start) END AS start
    FROM (SELECT event_id AS id, user_id % 3 + 1 AS body_sid, event_id * 7 % (SELECT max(event_id) // 3 + 200 FROM events) AS position FROM events) e LEFT JOIN ({SEG}) s ON s.body_sid = e.body_sid AND e.position >= s.start AND e.position < s.start + s.length GROUP BY ALL""",
)
def range_join_index(spark, sf_dir):
    e = events(spark, sf_dir)
    top = F.broadcast(e.agg((F.expr("max(event_id) div 3") + 200).alias("top")))
    asked = e.join(top).select(F.col("event_id").alias("id"), (F.col("user_id") % 3 + 1).alias("body_sid"), (F.col("event_id") * 7 % F.col("top")).alias("position"))
    return I.at_position(asked, segments(spark, sf_dir))


@query("asof_owner", "SELECT e.user_id % 8 AS file, e.event_id * 3 AS \"offset\", p.o AS owner FROM events e ASOF LEFT JOIN (SELECT event_id * 3 + 1 AS o, user_id % 8 AS f FROM events WHERE event_id % 20 = 0) p ON p.f = e.user_id % 8 AND e.event_id * 3 >= p.o")
def asof_owner(spark, sf_dir):
    e = events(spark, sf_dir)
    return I.owners(e.selectExpr("user_id % 8 AS file", "event_id * 3 AS offset"), e.where("event_id % 20 = 0").selectExpr("user_id % 8 AS file", "event_id * 3 + 1 AS offset"), ["file"])


#: Partitions out of orders: sixteen to a file, with faults at fixed remainders of the key.
PARTS = """SELECT o_orderkey, o_orderkey // 16 AS file, o_orderkey % 16 * 1024 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS off, CASE WHEN o_orderkey % 16 = 15 THEN 'footer' WHEN o_orderkey % 16 = 0 THEN 'header' ELSE 'body' END AS kind,
o_orderkey % 5 AS body_sid, o_orderkey % 3 AS index_sid, o_orderkey % 16 * 1024 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 101 = 0 THEN 8 ELSE 0 END AS this_partition, CASE WHEN o_orderkey % 16 = 0 THEN 0 ELSE (o_orderkey % 16 - 1) * 1024 END AS previous_partition,
CASE WHEN o_orderkey % 89 = 0 THEN 77 ELSE 15360 END AS footer_partition, CASE WHEN o_orderkey % 2 = 0 THEN 512 ELSE 1 END AS kag_size FROM orders"""
ENTRIES = f"SELECT file, off AS byte_offset, CASE WHEN o_orderkey % 83 = 0 THEN 99 ELSE body_sid END AS body_sid, o_orderkey FROM ({PARTS}) WHERE o_orderkey % 79 <> 0 UNION ALL SELECT file, CASE WHEN o_orderkey % 146 = 0 THEN 999999 ELSE off END, body_sid, o_orderkey FROM ({PARTS}) WHERE o_orderkey % 73 = 0"


def spark_sql(text):
    return text.replace("//", "div")


def structure(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    sql = lambda text: spark.sql(spark_sql(text).replace("FROM orders", "FROM {orders}"), orders=orders)
    partitions = sql(PARTS).withColumnRenamed("off", "offset")
    entries = sql(ENTRIES)
    segs = partitions.where("o_orderkey % 4 = 1").selectExpr("file", "offset + 5 AS offset", "CASE WHEN o_orderkey % 61 = 0 THEN 9 ELSE index_sid END AS index_sid", "CASE WHEN o_orderkey % 67 = 0 THEN 8 ELSE body_sid END AS body_sid")
    return partitions, segs, entries


@query("partition_chain", f"SELECT file, off AS \"offset\", lag(off) OVER (PARTITION BY file ORDER BY off) AS before, coalesce(lag(off) OVER (PARTITION BY file ORDER BY off) = previous_partition, true) AS linked FROM ({PARTS})")
def partition_chain(spark, sf_dir):
    from pyspark.sql.window import Window

    partitions, _, _ = structure(spark, sf_dir)
    before = F.lag("offset").over(Window.partitionBy("file").orderBy("offset"))
    return partitions.select("file", "offset", before.alias("before"), F.coalesce(before == F.col("previous_partition"), F.lit(True)).alias("linked"))


_PART_FAULTS = f"""SELECT file, rule, off FROM (SELECT *, lag(off) OVER (PARTITION BY file ORDER BY off) AS before, off IN (SELECT 1) AS x, (SELECT count(*) FROM ({PARTS}) f WHERE f.file = p.file AND f.kind = 'footer' AND f.off = p.footer_partition) AS foot FROM ({PARTS}) p) q,
(VALUES ('this'), ('previous'), ('footer'), ('kag')) r(rule) WHERE (rule = 'this' AND this_partition <> off) OR (rule = 'previous' AND before IS NOT NULL AND previous_partition <> before) OR (rule = 'footer' AND footer_partition <> 0 AND foot = 0) OR (rule = 'kag' AND kag_size > 1 AND off % kag_size <> 0)"""
_RIP_FAULTS = f"""SELECT coalesce(e.file, p.file) AS file, rule, coalesce(e.byte_offset, p.off) AS off FROM (SELECT file, byte_offset, count(*) AS n, min(body_sid) AS low, max(body_sid) AS high FROM ({ENTRIES}) GROUP BY ALL) e
FULL JOIN ({PARTS}) p ON p.file = e.file AND p.off = e.byte_offset, (VALUES ('rip unknown'), ('rip body'), ('rip repeated'), ('rip omitted')) r(rule)
WHERE (rule = 'rip unknown' AND p.off IS NULL) OR (rule = 'rip body' AND (low <> p.body_sid OR high <> p.body_sid)) OR (rule = 'rip repeated' AND p.off IS NOT NULL AND n > 1) OR (rule = 'rip omitted' AND n IS NULL)"""
_INDEX_FAULTS = f"""SELECT s.file, rule, s.off FROM (SELECT file, off + 5 AS off, off AS own, index_sid AS own_sid, CASE WHEN o_orderkey % 61 = 0 THEN 9 ELSE index_sid END AS index_sid, CASE WHEN o_orderkey % 67 = 0 THEN 8 ELSE body_sid END AS body_sid FROM ({PARTS}) WHERE o_orderkey % 4 = 1) s,
(VALUES ('index sid'), ('index body')) r(rule) WHERE (rule = 'index sid' AND (s.index_sid = 0 OR s.index_sid <> own_sid)) OR (rule = 'index body' AND (s.body_sid = 0 OR NOT EXISTS (SELECT 1 FROM ({PARTS}) p WHERE p.file = s.file AND p.body_sid = s.body_sid)))"""


@query("rip_membership", f'SELECT file, rule, off AS "offset" FROM ({_RIP_FAULTS})')
def rip_membership(spark, sf_dir):
    partitions, _, entries = structure(spark, sf_dir)
    return validate.random_index_faults(entries, partitions)


@query("structure_violations", f'SELECT file, rule, off AS "offset" FROM ({_PART_FAULTS} UNION ALL {_RIP_FAULTS} UNION ALL {_INDEX_FAULTS})')
def structure_violations(spark, sf_dir):
    return validate.faults(*structure(spark, sf_dir))


@query("limits_check", "SELECT what, n, most FROM (SELECT 'tracks' AS what, count(*) AS n, CAST(1024 AS BIGINT) AS most FROM events UNION ALL SELECT 'packets', count(*), 2000000 FROM lineitem UNION ALL SELECT 'metadata_sets', count(*), 100000 FROM lineitem) WHERE n > most")
def limits_check(spark, sf_dir):
    count = lambda what, table: read(spark, sf_dir, table).agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return C.limit_failures(count("tracks", "events").unionByName(count("packets", "lineitem")).unionByName(count("metadata_sets", "lineitem")))


#: Elements of a chunk of a track's values.
LISTED = 256


@query("group_collect", f"SELECT body_sid, number, count(*) AS n, string_agg(CAST(value_length AS VARCHAR), ',' ORDER BY ord) AS lengths FROM ({ESS}) GROUP BY ALL")
def group_collect(spark, sf_dir):
    """The whole list of each track: its values are ordered in chunks, and only the chunks' texts meet in its row."""
    lists = stats.listed(essence(spark, sf_dir), C.TRACK, "ord", "value_length", 100_000, LISTED)
    texts = lists.select(*C.TRACK, "chunk", F.size("list").cast("long").alias("n"), F.array_join(F.col("list").cast("array<string>"), ",").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return texts.groupBy(*C.TRACK).agg(F.sum("n").alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), ",").alias("lengths"))


@query("count_per_track", f"SELECT body_sid, number, count(*) AS n FROM ({ESS}) GROUP BY ALL")
def count_per_track(spark, sf_dir):
    return essence(spark, sf_dir).groupBy(*C.TRACK).agg(F.count("*").alias("n"))


@query("packet_count", f"SELECT t.body_sid, t.number, count(e.ord) AS n FROM (SELECT b AS body_sid, k AS number FROM unnest(range(1, 4)) x(b), unnest(range(0, 20)) y(k)) t LEFT JOIN ({ESS}) e ON e.body_sid = t.body_sid AND e.number = t.number GROUP BY ALL")
def packet_count(spark, sf_dir):
    tracks = spark.range(1, 4).select(F.col("id").alias("body_sid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("number"))
    counts = essence(spark, sf_dir).groupBy(*C.TRACK).agg(F.count("*").alias("n"))
    return tracks.join(counts, C.TRACK, "left").fillna(0, ["n"])


@query("distinct_conflict", "SELECT user_id, count(DISTINCT nullif(event_id % 3, 0)) AS sizes, count(DISTINCT nullif(event_id % 3, 0)) > 1 AS conflict FROM events GROUP BY user_id")
def distinct_conflict(spark, sf_dir):
    sizes = I.unit_sizes(events(spark, sf_dir).selectExpr("user_id AS body_sid", "event_id % 3 AS unit_bytes"))
    return sizes.select(F.col("body_sid").alias("user_id"), "sizes", "conflict")


@query("contiguous_duration", f"SELECT body_sid, CAST(sum(length) AS BIGINT) AS total, bool_and(coalesce(before = start, true)) AS ok FROM (SELECT *, lag(start + length) OVER (PARTITION BY body_sid ORDER BY start, segment) AS before FROM ({SEG}) WHERE length > 0) GROUP BY body_sid")
def contiguous_duration(spark, sf_dir):
    return I.contiguous(segments(spark, sf_dir), "length")


@query("contiguous_entries", f"SELECT user_id AS body_sid, CAST((r - 1) // {LISTED} AS BIGINT) AS chunk, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY ALL")
def contiguous_entries(spark, sf_dir):
    lists = stats.listed(events(spark, sf_dir).select(F.col("user_id").alias("body_sid"), "event_id"), ["body_sid"], "event_id", "event_id", 10_000, LISTED)
    return lists.select("body_sid", "chunk", F.size("list").cast("long").alias("n"), F.array_join(F.col("list").cast("array<string>"), ",").alias("entries"))


RATE = "CASE WHEN number % 3 = 0 THEN 30000 WHEN number % 3 = 1 THEN 25 ELSE 60 END"
DEN = "CASE WHEN number % 3 = 0 THEN 1001 ELSE 1 END"
INDEXED = f"SELECT *, row_number() OVER (PARTITION BY body_sid, number ORDER BY ord) - 1 AS packet_index, {RATE} AS num, {DEN} AS den, number % 5 AS origin FROM ({ESS})"
TIMED = f"""SELECT ord, body_sid, number, CAST(packet_index AS BIGINT) AS packet_index, (packet_index + origin) * (CAST(den AS DOUBLE) / num) AS "timestamp", CAST(den AS DOUBLE) / num AS duration,
CAST(floor((packet_index + origin) * (CAST(den AS DOUBLE) / num) * 1000000 + 0.5) AS BIGINT) AS timestamp_us, CAST(floor(CAST(den AS DOUBLE) / num * 1000000 + 0.5) AS BIGINT) AS duration_us FROM ({INDEXED})"""


def timed(spark, sf_dir):
    rows = C.packet_index(essence(spark, sf_dir)).withColumns({"num": F.expr(RATE), "den": F.expr(DEN), "origin": F.expr("number % 5")})
    return rows.withColumns(C.timing("packet_index", "origin", "num", "den"))


@query("packet_index", f"SELECT ord, body_sid, number, CAST(packet_index AS BIGINT) AS packet_index FROM ({INDEXED})")
def packet_index(spark, sf_dir):
    return C.packet_index(essence(spark, sf_dir)).select("ord", "body_sid", "number", "packet_index")


@query("packet_timing", TIMED)
def packet_timing(spark, sf_dir):
    return timed(spark, sf_dir).select("ord", "body_sid", "number", "packet_index", "timestamp", "duration", "timestamp_us", "duration_us")


@query("keyframe", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 256 >= 128 END AS keyframe FROM events")
def keyframe(spark, sf_dir):
    flags = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 256)
    return events(spark, sf_dir).select("event_id", (flags.bitwiseAND(F.lit(128)) != 0).alias("keyframe"))


@query("track_duration", f'SELECT body_sid, number, max("timestamp" + duration) AS duration FROM ({TIMED}) GROUP BY ALL')
def track_duration(spark, sf_dir):
    return timed(spark, sf_dir).groupBy(*C.TRACK).agg(F.max(F.col("timestamp") + F.col("duration")).alias("duration"))


@query("span_duration", f'SELECT body_sid, number, CAST(floor((max_by("timestamp" + duration, ord) - min_by("timestamp", ord)) * 1000000 + 0.5) AS BIGINT) AS duration_us FROM ({TIMED}) GROUP BY ALL')
def span_duration(spark, sf_dir):
    return timed(spark, sf_dir).groupBy(*C.TRACK).agg(C.js_round((F.max_by(F.col("timestamp") + F.col("duration"), "ord") - F.min_by("timestamp", "ord")) * 1_000_000).alias("duration_us"))


CONST = "SELECT event_id AS id, CAST(floor(abs(value) * 10) AS BIGINT) AS value_length, 40 + user_id % 5 AS unit, event_id % 4 * 3 AS indexed FROM events"


@query("clip_slices_const", f"SELECT id, i AS slice, i * unit AS slice_offset, unit AS slice_length FROM (SELECT *, least(value_length // unit, CASE WHEN indexed > 0 THEN indexed ELSE 9007199254740991 END) AS n FROM ({CONST}) WHERE value_length >= 2 * unit), unnest(range(0, n)) t(i)")
def clip_slices_const(spark, sf_dir):
    return I.constant_slices(events(spark, sf_dir).selectExpr("event_id AS id", "CAST(floor(abs(value) * 10) AS BIGINT) AS value_length", "40 + user_id % 5 AS unit", "event_id % 4 * 3 AS indexed"))


ENTRY = "SELECT event_id // 8 AS id, event_id % 8 AS pos, event_id * 10 + CASE WHEN event_id // 8 % 9 = 0 AND event_id % 8 = 4 THEN 25 ELSE 0 END AS stream_offset, 80 - event_id // 8 % 13 AS value_length FROM events"
SLICED = f"""SELECT *, stream_offset - first_value(stream_offset) OVER (PARTITION BY id ORDER BY pos) AS o FROM ({ENTRY})"""
GOOD = f"SELECT *, o >= 0 AND o < value_length AND coalesce(o > lag(o) OVER (PARTITION BY id ORDER BY pos), true) AS good, coalesce(lead(o) OVER (PARTITION BY id ORDER BY pos), value_length) AS past FROM ({SLICED})"


def entries(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id div 8 AS id", "event_id % 8 AS pos", "event_id * 10 + CASE WHEN event_id div 8 % 9 = 0 AND event_id % 8 = 4 THEN 25 ELSE 0 END AS stream_offset", "80 - event_id div 8 % 13 AS value_length")


@query("clip_slices_var", f"SELECT id, pos AS slice, o AS slice_offset, past - o AS slice_length FROM ({GOOD}) QUALIFY bool_and(good) OVER (PARTITION BY id)")
def clip_slices_var(spark, sf_dir):
    return I.variable_slices(entries(spark, sf_dir))


@query("monotonic_check", f"SELECT id, bool_and(good) AS ok FROM ({GOOD}) GROUP BY id")
def monotonic_check(spark, sf_dir):
    e = entries(spark, sf_dir)
    good = I.variable_slices(e).select("id").distinct().withColumn("good", F.lit(True))
    return e.select("id").distinct().join(good, "id", "left").select("id", F.coalesce("good", F.lit(False)).alias("ok"))


@query("essence_slices", f"""SELECT id, CASE WHEN unit > 0 AND value_length >= 2 * unit THEN 'constant' WHEN elements = 1 AND n_entries > 1 THEN 'variable' ELSE 'whole' END AS how FROM (SELECT event_id AS id, CAST(floor(abs(value) * 10) AS BIGINT) AS value_length, event_id % 3 * 20 AS unit, event_id % 2 + 1 AS elements, user_id % 4 AS n_entries FROM events)""")
def essence_slices(spark, sf_dir):
    e = events(spark, sf_dir).selectExpr("event_id AS id", "CAST(floor(abs(value) * 10) AS BIGINT) AS value_length", "event_id % 3 * 20 AS unit", "event_id % 2 + 1 AS elements", "user_id % 4 AS n_entries")
    return e.select("id", I.slice_kind("unit", "value_length", "elements", "n_entries").alias("how"))


@query("packets", f"""SELECT t.ord, t.body_sid, t.number, t.packet_index, t.timestamp_us, t.duration_us, CASE WHEN count(s.segment) = 1 THEN min(s.segment) % 2 = 0 END AS keyframe FROM ({TIMED}) t LEFT JOIN ({SEG}) s ON s.body_sid = t.body_sid AND t.packet_index >= s.start AND t.packet_index < s.start + s.length GROUP BY ALL""")
def packets(spark, sf_dir):
    rows = timed(spark, sf_dir)
    asked = rows.select(F.col("ord").alias("id"), "body_sid", F.col("packet_index").alias("position"))
    found = I.at_position(asked, segments(spark, sf_dir)).select(F.col("id").alias("ord"), ((F.col("segment") % 2) == 0).alias("keyframe"))
    return rows.join(found, "ord").select("ord", "body_sid", "number", "packet_index", "timestamp_us", "duration_us", "keyframe")


@query("primary_track", f"SELECT item_type, min(number) AS number FROM ({ESS}) WHERE item_type IN (21, 22) GROUP BY item_type")
def primary_track(spark, sf_dir):
    return essence(spark, sf_dir).where("item_type IN (21, 22)").groupBy("item_type").agg(F.min("number").alias("number"))


#: A sequence graph: conversations are roots, turns their components, every third turn a sequence over the turn's two leaves.
@query(
    "seq_flatten",
    "SELECT conv_id AS root, turn * 10 + leaf AS leaf, row_number() OVER (PARTITION BY conv_id ORDER BY turn, leaf) - 1 AS ord FROM (SELECT conv_id, turn, unnest(CASE WHEN turn % 3 = 2 THEN [1, 2] ELSE [0] END) AS leaf FROM conversations)",
)
def seq_flatten(spark, sf_dir):
    from pyspark.sql.window import Window

    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn % 3 = 2 AS nested")
    name = "concat('t', conv_id, '.', turn)"
    top = turns.selectExpr("concat('c', conv_id) AS parent", "CAST(turn AS BIGINT) AS pos", f"{name} AS child", "NOT nested AS is_leaf")
    inner = turns.where("nested").selectExpr(f"{name} AS parent", "explode(array(1L, 2L)) AS pos", f"{name} AS base").selectExpr("parent", "pos", "concat(base, '/', pos) AS child", "true AS is_leaf")
    roots = turns.selectExpr("concat('c', conv_id) AS root").distinct()
    flat = C.flatten(top.unionByName(inner), roots)
    leaf = F.element_at("path", 1) * 10 + F.when(F.size("path") > 1, F.element_at("path", 2)).otherwise(0)
    order = Window.partitionBy("root").orderBy("path")
    return flat.select(F.substring("root", 2, 20).cast("long").alias("root"), leaf.alias("leaf"), (F.row_number().over(order).cast("long") - 1).alias("ord"))


@query("compositions", "SELECT conv_id AS package, count(DISTINCT role) AS tracks, count(*) AS clips, string_agg(role || ':' || CAST(turn AS VARCHAR), ',' ORDER BY role, turn) AS clip_list FROM conversations GROUP BY conv_id")
def compositions(spark, sf_dir):
    clips = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    packages = clips.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "turns"))).alias("tracks"))
    names = F.flatten(F.transform("tracks", lambda t: F.transform(t["turns"], lambda x: F.concat_ws(":", t["role"], x.cast("string")))))
    return packages.select(F.col("conv_id").alias("package"), F.size("tracks").cast("long").alias("tracks"), F.size(names).cast("long").alias("clips"), F.array_join(names, ",").alias("clip_list"))


@query("timecode_tracks", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def timecode_tracks(spark, sf_dir):
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("r", first).where("r = 1").select("conv_id", "turn", "text")
