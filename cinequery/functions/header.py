"""Frame headers: 640 bytes to a struct, the profile dimension, sizes, rules and colour, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.binary import be_uint, column, cut

#: Id, profile, width, height, frame size, coding unit size, bit depth, flags, scale numerator and denominator of each profile.
PROFILES = [
    (1235, "dnxhd", 1920, 1080, 917504, 917504, 10, [], None, None),
    (1237, "dnxhd", 1920, 1080, 606208, 606208, 8, [], None, None),
    (1238, "dnxhd", 1920, 1080, 917504, 917504, 8, [], None, None),
    (1241, "dnxhd", 1920, 1080, 917504, 458752, 10, ["interlaced"], None, None),
    (1242, "dnxhd", 1920, 1080, 606208, 303104, 8, ["interlaced"], None, None),
    (1243, "dnxhd", 1920, 1080, 917504, 458752, 8, ["interlaced"], None, None),
    (1244, "dnxhd", 1440, 1080, 606208, 303104, 8, ["interlaced"], None, None),
    (1250, "dnxhd", 1280, 720, 458752, 458752, 10, [], None, None),
    (1251, "dnxhd", 1280, 720, 458752, 458752, 8, [], None, None),
    (1252, "dnxhd", 1280, 720, 303104, 303104, 8, [], None, None),
    (1253, "dnxhd", 1920, 1080, 188416, 188416, 8, [], None, None),
    (1256, "dnxhd", 1920, 1080, 1835008, 1835008, 10, ["444"], None, None),
    (1258, "dnxhd", 960, 720, 212992, 212992, 8, [], None, None),
    (1259, "dnxhd", 1440, 1080, 417792, 417792, 8, [], None, None),
    (1260, "dnxhd", 1440, 1080, 835584, 417792, 8, ["interlaced", "mbaff"], None, None),
    (1270, "dnxhr_444", None, None, None, None, None, ["444"], 57344, 255),
    (1271, "dnxhr_hqx", None, None, None, None, None, [], 28672, 255),
    (1272, "dnxhr_hq", None, None, None, None, 8, [], 28672, 255),
    (1273, "dnxhr_sq", None, None, None, None, 8, [], 18944, 255),
    (1274, "dnxhr_lb", None, None, None, None, 8, [], 5888, 255),
]
PROFILE_SCHEMA = "cid int, profile string, p_width int, p_height int, frame_size int, unit_size int, p_depth int, flags array<string>, scale_num int, scale_den int"
HEADER_BYTES = 0x280


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def byte(b: Column | str, offset: int) -> Column:
    return be_uint(b, offset, 1).cast("int")


def flag(b: Column | str, offset: int, bit: int) -> Column:
    return F.shiftright(byte(b, offset), bit).bitwiseAND(F.lit(1)) == 1


def prefix_kind(b: Column | str) -> Column:
    """classic, hr, or null where the first five bytes are neither."""
    offset = be_uint(b, 0, 4)
    classic = (offset == HEADER_BYTES) & byte(b, 4).isin(1, 2)
    hr = (byte(b, 4) == 3) & (offset >= HEADER_BYTES) & (offset <= 0x2170) & (offset % 4 == 0)
    return F.when(classic, "classic").when(hr, "hr")


def bit_depth(code: Column) -> Column:
    return F.when(code == 1, 8).when(code == 2, 10).when(code == 3, 12)


def color_space(code: Column) -> Column:
    return F.when(code == 0, "bt709").when(code == 1, "bt2020-ncl").when(code == 2, "bt2020-cl").otherwise("unspecified")


def pixel_format(depth: Column | str, is444: Column | str, act: Column | str) -> Column:
    d, text = column(depth), column(depth).cast("string")
    high = F.when(d.isin(10, 12), F.when(column(act), F.concat(F.lit("yuv444p"), text)).otherwise(F.concat(F.lit("gbrp"), text))).otherwise("unknown")
    low = F.when(d == 8, "yuv422p8").when(d == 10, "yuv422p10").otherwise("yuv422p12")
    return F.when(column(is444), high).otherwise(low)


def blocks(size: Column | str) -> Column:
    return F.ceil(column(size) / 16).cast("long")


def frame_size(width: Column | str, height: Column | str) -> Column:
    """The table's size, or the scaled number of macroblocks rounded to 4096; needs the profile's columns."""
    unaligned = F.floor(blocks(width) * blocks(height) * F.col("scale_num") / F.col("scale_den"))
    return F.coalesce(F.col("frame_size").cast("long"), (F.floor((unaligned + 2048) / 4096) * 4096).cast("long"))


def gcd(a: Column | str, b: Column | str) -> Column:
    """Euclid's algorithm in 32 fixed rounds: enough for any pair of 16-bit numbers; 1 for two zeros."""
    start = F.struct(F.abs(column(a)).cast("long").alias("a"), F.abs(column(b)).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["a"]), F.lit(1))


def parse(frames: DataFrame, packet: str = "packet", declared_length: str | None = None) -> DataFrame:
    """``frames`` with the header's fields: null where the packet is no frame. The profile table is a broadcast of 20 rows."""
    b = packet
    raw = frames.withColumn("kind", F.when(F.octet_length(b) >= HEADER_BYTES, prefix_kind(b)))
    raw = raw.withColumn("field_height", be_uint(b, 0x18, 2).cast("int")).withColumn("encoded_width", be_uint(b, 0x1A, 2).cast("int")).withColumn("bit_depth", bit_depth(F.shiftright(byte(b, 0x21), 5)))
    raw = raw.withColumn("ok", F.coalesce(F.col("kind").isNotNull() & F.col("bit_depth").isNotNull() & (F.col("encoded_width") > 0) & (F.col("field_height") > 0), F.lit(False)))
    raw = raw.withColumn("header_cid", be_uint(b, 0x28, 4))
    table = F.broadcast(profiles(frames.sparkSession).withColumn("header_cid", F.col("cid").cast("long")).drop("cid"))
    h = raw.join(table, "header_cid", "left")
    h = h.withColumns({
        "width": F.coalesce("p_width", "encoded_width"),
        "is444": flag(b, 0x2C, 6),
        "act": flag(b, 0x2C, 0),
        "interlaced": flag(b, 5, 1),
        "mbaff": flag(b, 6, 5),
        "alpha": flag(b, 7, 0),
        "low_latency_alpha": flag(b, 7, 1),
        "macroblock_height": be_uint(b, 0x16C, 2).cast("int"),
        "color_space": color_space(F.shiftright(byte(b, 0x2C), 1).bitwiseAND(F.lit(3))),
        "field_parity": F.when(flag(b, 5, 1), F.when(flag(b, 5, 0), "bottom").otherwise("top")),
        "fourcc": F.when(F.col("header_cid").between(1270, 1274), "AVdh").otherwise("AVdn"),
        "length": (F.col(declared_length) if declared_length else F.octet_length(b)).cast("long"),
    })
    h = h.withColumn("height", F.when(F.col("interlaced"), F.coalesce("p_height", "field_height")).otherwise(F.col("field_height")))
    h = h.withColumn("pixel_format", pixel_format("bit_depth", "is444", "act"))
    h = h.withColumn("macroblock_width", blocks("width").cast("int"))
    h = h.withColumn("data_offset", F.when((F.col("kind") == "hr") & (F.col("macroblock_height") > 68), 0x170 + F.shiftleft("macroblock_height", 2)).otherwise(HEADER_BYTES))
    h = h.withColumn("expected_size", F.when(F.col("profile").isNotNull(), F.when(F.col("mbaff"), F.col("unit_size").cast("long")).otherwise(frame_size("width", "height"))))
    h = h.withColumn("divisor", gcd("encoded_width", "width")).withColumn("par_num", (F.col("encoded_width") / F.col("divisor")).cast("long")).withColumn("par_den", (F.col("width") / F.col("divisor")).cast("long"))
    return h.withColumn("reasons", unsupported_reasons()).withColumn("supported", F.size("reasons") == 0)


def unsupported_reasons() -> Column:
    """The violated rules in order, as codes with their parameters; needs the header's columns."""
    known = F.col("profile").isNotNull()
    allows_mbaff, is_interlaced = F.array_contains("flags", "mbaff"), F.array_contains("flags", "interlaced")
    want = is_interlaced & ~F.col("mbaff")
    rules = [
        F.when(~known, "unknown profile"),
        F.when(known & F.col("mbaff") & ~allows_mbaff, "mbaff not permitted"),
        F.when(known & (F.col("interlaced") != want), F.when(F.col("interlaced"), "interlaced not permitted").otherwise("interlaced required")),
        F.when((F.col("width") > 4096) | (F.col("height") > 2160), "frame too large"),
        F.when(F.col("alpha") | F.col("low_latency_alpha"), "alpha"),
        F.when(F.col("macroblock_height") <= 0, "macroblock height"),
        F.when(F.col("pixel_format") == "unknown", "pixel format"),
        F.when(F.col("expected_size").isNotNull() & (F.col("length") < F.col("expected_size")), "packet too small"),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def summary(profile: str, cid: str, width: str, height: str, depth: str, is444: str) -> Column:
    chroma = F.when(F.col(is444), "4:4:4").otherwise("4:2:2")
    return F.format_string("%s CID %s %sx%s %s-bit %s", F.col(profile), *(F.col(c).cast("string") for c in (cid, width, height, depth)), chroma)


def color_codes(space: Column | str) -> dict[str, Column]:
    """Numeric codes of primaries, transfer and matrix."""
    s = column(space)
    wide, none = s.isin("bt2020-ncl", "bt2020-cl"), s == "unspecified"
    return {
        "primaries": F.when(none, 2).when(wide, 9).otherwise(1),
        "transfer": F.when(none | wide, 2).otherwise(1),
        "matrix": F.when(none, 2).when(s == "bt2020-ncl", 9).when(s == "bt2020-cl", 10).otherwise(1),
    }


def color_names(primaries: Column | str, transfer: Column | str, matrix: Column | str) -> dict[str, Column]:
    p, t, m = column(primaries), column(transfer), column(matrix)
    return {"primaries_name": F.when(p == 1, "bt709").when(p == 9, "bt2020"), "transfer_name": F.when(t == 1, "bt709"), "matrix_name": F.when(m == 1, "bt709").when(m == 9, "bt2020-ncl").when(m == 10, "bt2020-cl")}


def scan_type(interlaced: Column | str, parity: Column | str) -> Column:
    return F.when(column(interlaced), F.when(column(parity) == "bottom", "interlaced-bottom-field-first").otherwise("interlaced-top-field-first")).otherwise("progressive")


def native_supported(depth: Column | str, is444: Column | str, interlaced: Column | str, alpha: Column | str) -> Column:
    return (column(depth) == 8) & ~column(is444) & ~column(interlaced) & ~column(alpha)


def row_spans(frames: DataFrame, key: str, packet: str = "packet") -> DataFrame:
    """key, row, first, past, length, valid of each macroblock row of parsed frames: offsets from the scan table, each row ending where the next begins."""
    rows = frames.where("ok AND macroblock_height > 0").select(key, packet, "data_offset", (F.octet_length(packet) - F.col("data_offset")).alias("payload"), "macroblock_height", F.explode(F.sequence(F.lit(0), F.col("macroblock_height") - 1)).alias("row"))
    at = lambda row: be_uint(packet, 0x170 + row * 4, 4)
    rows = rows.withColumn("start", at(F.col("row"))).withColumn("before", F.when(F.col("row") > 0, at(F.col("row") - 1)).otherwise(0))
    rows = rows.withColumn("end", F.when(F.col("row") + 1 < F.col("macroblock_height"), F.coalesce(at(F.col("row") + 1), F.col("payload"))).otherwise(F.col("payload")).cast("long"))
    valid = F.coalesce((F.col("payload") > 0) & (F.col("start") >= F.col("before")) & (F.col("start") <= F.col("payload")) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("payload")), F.lit(False))
    return rows.select(key, "row", (F.col("data_offset") + F.col("start")).alias("first"), (F.col("data_offset") + F.col("end")).alias("past"), (F.col("end") - F.col("start")).alias("length"), valid.alias("valid"))


def macroblock_header(row_bytes: Column | str, mbaff: Column | str) -> Column:
    """qscale, act and interlaced of a row's first bits; null in rows that end early."""
    word = be_uint(row_bytes, 0, 2)
    m = column(mbaff)
    qscale = F.when(m, F.shiftright(word, 5).bitwiseAND(F.lit(0x3FF))).otherwise(F.shiftright(word, 5)).cast("int")
    act = F.shiftright(word, 4).bitwiseAND(F.lit(1)) == 1
    return F.when(word.isNotNull(), F.struct(qscale.alias("qscale"), act.alias("act"), (m & (F.shiftright(word, 15) == 1)).alias("interlaced")))


def layout(width: Column | str, height: Column | str, is444: Column | str, depth: Column | str) -> Column:
    """Planes of a coded frame: width, height, stride and bytes of luma and chroma, and all bytes."""
    w, h = blocks(width) * 16, blocks(height) * 16
    c = F.when(column(is444), w).otherwise(F.floor(w / 2)).cast("long")
    n = F.when(column(depth) == 8, 1).otherwise(2).cast("long")
    return F.struct(w.alias("coded_width"), h.alias("coded_height"), c.alias("chroma_width"), n.alias("bytes_per_sample"), (w * n).alias("luma_stride"), (c * n).alias("chroma_stride"), (w * h * n + 2 * c * h * n).alias("byte_length"))


def first_header(payload: Column | str, limit: int) -> Column:
    """The first offset up to ``limit`` at which a header parses, or null; only places whose five-byte prefix fits are looked at closer."""
    def good(o: Column) -> Column:
        b = cut(payload, o, HEADER_BYTES)
        kind = prefix_kind(b)
        return (F.octet_length(b) == HEADER_BYTES) & kind.isNotNull() & bit_depth(F.shiftright(byte(b, 0x21), 5)).isNotNull() & (be_uint(b, 0x18, 2) > 0) & (be_uint(b, 0x1A, 2) > 0)

    last = F.least(F.lit(limit), F.octet_length(column(payload)) - HEADER_BYTES)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(places, lambda o: F.coalesce(good(o), F.lit(False))), 0)
