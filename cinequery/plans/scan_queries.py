"""Sources, byte scans and binary fields."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions import binary as B
from cinequery.functions import header as H
from cinequery.operators import frame_scan, klv, probe
from cinequery.plans.registry import query
from cinequery.sources import frames
from cinequery.sources.tables import ESSENCE_KEY, document_files, read

DOCS = "SELECT doc_id, doc_id // 16 AS file, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents"
OFFSETS = f"""SELECT *, row_number() OVER w - 1 AS ord, coalesce(sum(20 + n) OVER (PARTITION BY file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
FROM ({DOCS}) WINDOW w AS (PARTITION BY file ORDER BY doc_id)"""


@query("src_slice", "SELECT doc_id, lower(hex(encode(text))[1 + 2 * (doc_id % 5) : 2 * (doc_id % 5) + 24]) AS part FROM documents")
def src_slice(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", B.hex_lower(B.cut(F.encode("text", "utf-8"), F.col("doc_id") % 5, 12)).alias("part"))


@query("src_bytes_read", f"SELECT file, CAST(sum(20 + n) AS BIGINT) AS bytes_read, count(*) AS reads FROM ({DOCS}) GROUP BY file")
def src_bytes_read(spark, sf_dir):
    return klv.scan(document_files(spark, sf_dir)).groupBy("file").agg(F.sum(F.col("next_offset") - F.col("offset")).alias("bytes_read"), F.count("*").alias("reads"))


@query("src_range_ok", "SELECT event_id, (event_id % 70 - 5 >= 0 AND user_id % 40 - 1 >= 0 AND event_id % 70 - 5 + user_id % 40 - 1 <= 64) AS ok FROM events")
def src_range_ok(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", B.range_ok(F.col("event_id") % 70 - 5, F.col("user_id") % 40 - 1, F.lit(64)).alias("ok"))


@query(
    "klv_scan",
    f"""SELECT file, CAST(ord AS BIGINT) AS ord, CAST(off AS BIGINT) AS "offset", '{ESSENCE_KEY}' AS key_hex, 4 AS length_field_length, CAST(off + 20 AS BIGINT) AS value_offset,
    CAST(n AS BIGINT) AS value_length, CAST(off + 20 + n AS BIGINT) AS next_offset FROM ({OFFSETS})""",
)
def klv_scan(spark, sf_dir):
    return klv.scan(document_files(spark, sf_dir)).drop("error")


@query(
    "klv_ber_length",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 1 ELSE 1 + 4 + o_orderkey % 4 END AS length_field_length,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey % 128 ELSE o_orderkey * 37 END AS value_length FROM orders""",
)
def klv_ber_length(spark, sf_dir):
    n = 4 + F.col("o_orderkey") % 4
    long_form = F.unhex(F.concat(F.hex(128 + n), F.lpad(F.hex(F.col("o_orderkey") * 37), (2 * n).cast("int"), F.lit("0"))))
    field = F.when(F.col("o_orderkey") % 11 == 0, F.unhex(F.lit("80"))).when(F.col("o_orderkey") % 5 == 0, B.be_bytes(F.col("o_orderkey") % 128, 1)).otherwise(long_form)
    return ber(read(spark, sf_dir, "orders").select("o_orderkey", field.alias("field")))


def ber(df):
    """Length of a BER length field and the length it tells, null where indefinite or over 8 bytes."""
    first = B.be_uint("field", 0, 1)
    n = first.bitwiseAND(F.lit(127))
    value = F.conv(F.hex(B.cut("field", 1, n)), 16, 10).cast("long")
    return df.select("o_orderkey", F.when(first < 128, 1).when(n.between(1, 8), 1 + n).cast("long").alias("length_field_length"), F.when(first < 128, first).when(n.between(1, 8), value).alias("value_length"))


@query("klv_resync", "SELECT page_id, CAST(strlen(html) + 7 AS BIGINT) AS found FROM pages")
def klv_resync(spark, sf_dir):
    junk = F.concat(F.unhex(F.lit("060e2b0606")), F.encode("html", "utf-8"), F.unhex(F.lit("0000")))
    files = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.concat(junk, F.unhex(F.lit(ESSENCE_KEY + "0141"))).alias("payload"))
    return klv.scan(files).where("error IS NULL").select(F.col("file").alias("page_id"), F.col("offset").alias("found"))


@query("packet_read", f"SELECT doc_id, md5(text) AS digest FROM ({DOCS})")
def packet_read(spark, sf_dir):
    values = klv.payloads(document_files(spark, sf_dir))
    return values.select((F.col("file") * 16 + F.col("ord")).alias("doc_id"), F.md5("payload").alias("digest"))


@query(
    "find_ascii",
    """SELECT page_id, needle, CAST(i - 1 AS BIGINT) AS "offset" FROM (SELECT page_id, html, unnest(['<div', 'href', '<p>']) AS needle FROM pages), unnest(range(1, length(html) + 1)) t(i)
    WHERE substr(html, i, length(needle)) = needle""",
)
def find_ascii(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array(*map(F.lit, ("<div", "href", "<p>")))).alias("needle"))
    # A hit stands where the text before it ends: the texts between hits are summed in order, each once.
    gaps = pages.select("page_id", "needle", F.posexplode(F.expr("transform(split(html, concat('\\\\Q', needle, '\\\\E'), -1), x -> CAST(char_length(x) AS BIGINT))")).alias("i", "size"))
    order = Window.partitionBy("page_id", "needle").orderBy("i")
    places = gaps.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "more": F.lead("i").over(order).isNotNull()})
    return places.where("more").select("page_id", "needle", (F.col("before") + F.col("i") * F.char_length("needle")).alias("offset"))


@query("ext_filter", "SELECT page_id, lower(regexp_extract(url || CASE page_id % 4 WHEN 0 THEN '.MXF' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' ELSE '' END, '\\.[^.]*$')) AS ext FROM pages WHERE page_id % 4 IN (0, 1)")
def ext_filter(spark, sf_dir):
    suffix = F.when(F.col("page_id") % 4 == 0, ".MXF").when(F.col("page_id") % 4 == 1, ".mov").when(F.col("page_id") % 4 == 2, ".txt").otherwise("")
    names = read(spark, sf_dir, "pages").select("page_id", F.concat("url", suffix).alias("name"))
    return names.select("page_id", F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).alias("ext")).where(F.col("ext").isin(".mxf", ".mov", ".mp4", ".dnx", ".dnxhd", ".dnxhr"))


BIG = "(event_id * 2654435761 + user_id * 97)"


@query(
    "be_ints",
    f"""SELECT event_id, CAST({BIG} >> 48 & 65535 AS BIGINT) AS u16, CAST({BIG} >> 32 AS BIGINT) AS u32, CAST({BIG} AS DECIMAL(20,0)) AS u64,
    CAST(({BIG}) - 4611686018427387904 AS BIGINT) AS i64 FROM events""",
)
def be_ints(spark, sf_dir):
    v = F.col("event_id") * 2654435761 + F.col("user_id") * 97
    b = read(spark, sf_dir, "events").select("event_id", B.be_bytes(v, 8).alias("b"), B.be_bytes(v - 4611686018427387904, 8).alias("c"))
    return b.select("event_id", B.be_uint("b", 0, 2).alias("u16"), B.be_uint("b", 0, 4).alias("u32"), B.be_u64("b", 0).alias("u64"), B.be_i64("c", 0).alias("i64"))


@query("safe_int", "SELECT o_orderkey, CASE WHEN o_orderkey * 1000000000000 <= 9007199254740991 THEN o_orderkey * 1000000000000 END AS safe FROM orders")
def safe_int(spark, sf_dir):
    b = read(spark, sf_dir, "orders").select("o_orderkey", B.be_bytes(F.col("o_orderkey") * 1000000000000, 8).alias("b"))
    return b.select("o_orderkey", B.safe_integer(B.be_u64("b", 0)).alias("safe"))


@query("hex_lower", "SELECT p_partkey, lower(hex(encode(p_name))) AS h FROM part")
def hex_lower(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", B.hex_lower(F.encode("p_name", "utf-8")).alias("h"))


@query("signed_byte", "SELECT event_id, CAST(CASE WHEN event_id % 256 > 127 THEN event_id % 256 - 256 ELSE event_id % 256 END AS INTEGER) AS v FROM events")
def signed_byte(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", B.signed_byte(B.be_uint(B.be_bytes(F.col("event_id"), 1), 0, 1)).alias("v"))


@query("utf16be", "SELECT doc_id, text AS t FROM documents")
def utf16be(spark, sf_dir):
    padded = F.concat(F.encode("text", "UTF-16BE"), F.unhex(F.lit("0000")))
    return read(spark, sf_dir, "documents").select("doc_id", B.utf16be(padded).alias("t"))


@query("bit_fields", "SELECT event_id, CAST((event_id * 7919 >> (24 - event_id % 8)) & 255 AS BIGINT) AS field FROM events")
def bit_fields(spark, sf_dir):
    b = read(spark, sf_dir, "events").select("event_id", B.be_bytes(F.col("event_id") * 7919, 4).alias("b"))
    return b.select("event_id", B.bits(B.be_uint("b", 0, 4), 32, F.col("event_id") % 8, 8).alias("field"))


@query(
    "key_class",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'essence' WHEN o_orderkey % 4 = 1 THEN 'essence' WHEN o_orderkey % 4 = 2 AND o_orderkey % 6 BETWEEN 2 AND 4 THEN 'partition' ELSE 'other' END AS class FROM orders""",
)
def key_class(spark, sf_dir):
    from cinequery.operators.container import key_class

    k = F.col("o_orderkey")
    key = (
        F.when(k % 4 == 0, F.lit(ESSENCE_KEY))
        .when(k % 4 == 1, F.lit("060e2b34010201010e04030115010501"))
        .when(k % 4 == 2, F.concat(F.lit("060e2b34020501010d01020101"), F.lpad(F.hex(k % 6), 2, "0"), F.lit("0400")))
        .otherwise(F.lit("060e2b34010101020301021001000000"))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", key_class(F.lower(key)).alias("class"))


@query("is_container", "SELECT page_id, page_id % 3 = 0 AS yes FROM pages")
def is_container(spark, sf_dir):
    payload = F.concat(F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("060e2b34"))).otherwise(F.unhex(F.lit("060e2b35"))), F.encode("html", "utf-8"))
    return read(spark, sf_dir, "pages").select("page_id", B.matches_prefix(B.cut(payload, 0, 4), "060e2b34").alias("yes"))


@query("le_samples", "SELECT event_id, event_id % 256 AS s8, event_id * 31 % 65536 AS s16 FROM events")
def le_samples(spark, sf_dir):
    v = F.col("event_id") * 31 % 65536
    b = F.concat(B.be_bytes(F.col("event_id"), 1), B.be_bytes(v, 1), B.be_bytes(F.shiftright(v, 8), 1))
    return read(spark, sf_dir, "events").select("event_id", B.le_uint(b, 0, 1).alias("s8"), B.le_uint(b, 1, 2).alias("s16"))


@query("first_header", "SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN CAST(p_partkey % 700 AS BIGINT) END AS found FROM part")
def first_header(spark, sf_dir):
    padded = F.concat(F.expr("unhex(repeat('07', CAST(p_partkey % 700 AS INT)))"), F.col("packet"))
    files = frames.headers(spark, sf_dir).select(F.col("p_partkey").alias("file"), F.lit(None).cast("string").alias("name"), padded.alias("payload"))
    return probe.searched(files).select(F.col("file").alias("p_partkey"), F.col("header_offset").alias("found"))


#: Files of a filler, for every third an atom, for every fifth one or two sample entries, and a frame's header.
_GOOD = "k % 13 <> 0 AND k % 17 <> 0"
_ENTRY = "k % 700 + CASE WHEN k % 3 = 0 THEN 12 ELSE 0 END"
_NAMED = "k % 4 IN (0, 3)"


@query(
    "probe",
    f"""SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'QuickTime/ISO BMFF' WHEN {_GOOD} THEN 'raw frame' END AS container, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 = 0 THEN 'AVdn' ELSE 'AVdh' END WHEN {_GOOD} THEN CASE WHEN hcid BETWEEN 1270 AND 1274 THEN 'AVdh' ELSE 'AVdn' END END AS stream,
    CAST(CASE WHEN k % 5 = 0 OR {_GOOD} THEN 0.95 WHEN k % 3 = 0 THEN 0.65 ELSE 0.35 END AS DOUBLE) AS confidence, CASE WHEN k % 5 = 0 THEN CAST({_ENTRY} AS BIGINT) END AS entry_offset, CASE WHEN {_GOOD} THEN CAST({_ENTRY} + CASE WHEN k % 10 = 0 THEN 8 WHEN k % 5 = 0 THEN 4 ELSE 0 END AS BIGINT) END AS header_offset
    FROM (SELECT p_partkey AS k, {frames.cid_sql()} AS hcid FROM (SELECT p_partkey, {frames.FIELDS["profile_index"]} AS profile_index FROM part)) WHERE ({_NAMED}) OR k % 5 = 0 OR ({_GOOD})""",
)
def probe_files(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("a.b"), F.when(k % 4 == 0, ".MXF").when(k % 4 == 1, ".txt").when(k % 4 == 2, "").otherwise(".mov"))
    text = F.concat(F.expr("repeat('.', CAST(p_partkey % 700 AS INT))"), F.when(k % 3 == 0, "ftypqt..free").otherwise(""), F.when(k % 10 == 0, "AVdnAVdh").when(k % 5 == 0, "AVdh").otherwise(""))
    files = frames.headers(spark, sf_dir).select(k.alias("file"), name.alias("name"), F.concat(F.encode(text, "utf-8"), F.col("packet")).alias("payload"))
    return probe.probe(files).select(F.col("file").alias("p_partkey"), "container", "stream", "confidence", F.get("entries", F.lit(0))["offset"].alias("entry_offset"), "header_offset")


@query("raw_frame_scan", "SELECT file, CAST(k * 8192 + 3 * (k + 1) AS BIGINT) AS \"offset\", CAST(8192 AS BIGINT) AS byte_length FROM (SELECT p_partkey // 8 AS file, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS k FROM part)")
def raw_frame_scan(spark, sf_dir):
    return frame_scan.scan(raw_files(spark, sf_dir)).select("file", "offset", "byte_length")


def raw_files(spark, sf_dir):
    """file, payload: eight parts' frames of 8,192 bytes, three other bytes before each."""
    head = "0000028003" + "00" * (0x18 - 5) + "00800280" + "00" * (0x21 - 0x1C) + "20" + "00" * (0x28 - 0x22) + f"{1274:08x}" + "00" * (8192 - 0x2C)
    return read(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 8").alias("file")).agg(F.unhex(F.array_join(F.collect_list(F.lit("ffffff" + head)), "")).alias("payload"))


@query("chunked_frame_scan", "SELECT file, CAST(k AS BIGINT) AS ord, CAST(k * 8192 + 3 * (k + 1) AS BIGINT) AS \"offset\", CAST(8192 AS BIGINT) AS byte_length FROM (SELECT p_partkey // 8 AS file, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS k FROM part)")
def chunked_frame_scan(spark, sf_dir):
    """The same frames from chunks of 8,000 bytes, so that headers and frames lie across them."""
    return frame_scan.scan_chunks(frame_scan.chunks(raw_files(spark, sf_dir), 8000), 8000, 16_000)
