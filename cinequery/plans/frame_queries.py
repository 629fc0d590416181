"""Frame headers, layouts, samples, transforms and colour."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions import binary as B
from cinequery.functions import header as H
from cinequery.functions import media as M
from cinequery.functions import signal as S
from cinequery.operators import code_tables, decode, frame_decode
from cinequery.operators.code_tables import TABLES
from cinequery.operators.settle import settled
from cinequery.plans.registry import query
from cinequery.sources import coded, frames
from cinequery.sources.tables import read

_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{'+'.join(v)}'" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")" for p in H.PROFILES)
#: The synthetic headers' fields and their profile, by arithmetic on the part table.
FIELDS = f"""SELECT *, {frames.cid_sql()} AS hcid FROM (SELECT p_partkey, {", ".join(f"{sql} AS {name}" for name, sql in frames.FIELDS.items())} FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0)"""
JOINED = f"""SELECT f.*, p.*, CASE depth_code WHEN 1 THEN 8 WHEN 2 THEN 10 ELSE 12 END AS depth, CAST(coalesce(pw, hwidth) AS BIGINT) AS width, CASE WHEN hinterlaced = 1 THEN CAST(coalesce(ph, hfield) AS BIGINT) ELSE CAST(hfield AS BIGINT) END AS height,
CASE hcolor WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020-ncl' WHEN 2 THEN 'bt2020-cl' ELSE 'unspecified' END AS space
FROM ({FIELDS}) f LEFT JOIN (VALUES {_VALUES}) p(cid, profile, pw, ph, fsize, usize, pdepth, flags, snum, sden) ON p.cid = f.hcid"""
SIZED = f"""SELECT *, CASE WHEN h444 = 1 THEN CASE WHEN depth IN (10, 12) THEN CASE WHEN hact = 1 THEN 'yuv444p' || depth ELSE 'gbrp' || depth END ELSE 'unknown' END WHEN depth = 8 THEN 'yuv422p8' WHEN depth = 10 THEN 'yuv422p10' ELSE 'yuv422p12' END AS pixfmt,
CASE WHEN profile IS NULL THEN NULL WHEN hmbaff = 1 THEN usize WHEN fsize IS NOT NULL THEN fsize ELSE (((width + 15) // 16 * ((height + 15) // 16) * snum) // sden + 2048) // 4096 * 4096 END AS expected FROM ({JOINED})"""


def parsed(spark, sf_dir):
    return H.parse(frames.headers(spark, sf_dir)).where("ok")


@query(
    "frame_header",
    f"""SELECT p_partkey, CASE WHEN hcid BETWEEN 1270 AND 1274 THEN 'AVdh' ELSE 'AVdn' END AS fourcc, CASE hkind WHEN 3 THEN 'hr' ELSE 'classic' END AS kind, CAST(hcid AS BIGINT) AS header_cid, coalesce(profile, 'unknown') AS profile, CAST(width AS INTEGER) AS width, CAST(hwidth AS INTEGER) AS encoded_width, CAST(height AS INTEGER) AS height,
    CAST(depth AS INTEGER) AS bit_depth, h444 = 1 AS is444, hact = 1 AS act, halpha = 1 AS alpha, hmbaff = 1 AS mbaff, hinterlaced = 1 AS interlaced, CASE WHEN hinterlaced = 1 THEN CASE WHEN hparity = 1 THEN 'bottom' ELSE 'top' END END AS field_parity, space AS color_space,
    CAST((width + 15) // 16 AS INTEGER) AS macroblock_width, CAST(hmb AS INTEGER) AS macroblock_height, pixfmt AS pixel_format FROM ({SIZED})""",
)
def frame_header(spark, sf_dir):
    h = parsed(spark, sf_dir).withColumn("profile", F.coalesce("profile", F.lit("unknown")))
    return h.select("p_partkey", "fourcc", "kind", "header_cid", "profile", "width", "encoded_width", "height", "bit_depth", "is444", "act", "alpha", "mbaff", "interlaced", "field_parity", "color_space", "macroblock_width", "macroblock_height", "pixel_format")


@query("cid_lookup", f"SELECT p_partkey, profile, CAST(pdepth AS INTEGER) AS p_depth FROM ({JOINED})")
def cid_lookup(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", "profile", "p_depth")


@query("frame_size", f"SELECT p_partkey, CAST(expected AS BIGINT) AS expected_size FROM ({SIZED})")
def frame_size(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", "expected_size")


@query(
    "support_rules",
    f"""SELECT p_partkey, concat_ws('; ', CASE WHEN profile IS NULL THEN 'unknown profile' END, CASE WHEN hmbaff = 1 AND flags NOT LIKE '%mbaff%' THEN 'mbaff not permitted' END,
    CASE WHEN (hinterlaced = 1) <> (flags LIKE '%interlaced%' AND hmbaff = 0) THEN CASE WHEN hinterlaced = 1 THEN 'interlaced not permitted' ELSE 'interlaced required' END END, CASE WHEN width > 4096 OR height > 2160 THEN 'frame too large' END, CASE WHEN halpha = 1 THEN 'alpha' END,
    CASE WHEN hmb <= 0 THEN 'macroblock height' END, CASE WHEN pixfmt = 'unknown' THEN 'pixel format' END, CASE WHEN 640 < expected THEN 'packet too small' END) AS reasons FROM ({SIZED})""",
)
def support_rules(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", F.array_join("reasons", "; ").alias("reasons"))


@query("pixel_format", f"SELECT pixfmt AS pixel_format, count(*) AS n FROM ({SIZED}) GROUP BY pixfmt")
def pixel_format(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("pixel_format").agg(F.count("*").alias("n"))


@query("color_meta", f"SELECT p_partkey, CASE hcolor WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 9 END AS primaries, CASE hcolor WHEN 0 THEN 1 ELSE 2 END AS transfer, CASE hcolor WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 10 ELSE 2 END AS matrix, CASE WHEN hinterlaced = 0 THEN 'progressive' WHEN hparity = 1 THEN 'interlaced-bottom-field-first' ELSE 'interlaced-top-field-first' END AS scan_type FROM ({JOINED})")
def color_meta(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in H.color_codes("color_space").items()), H.scan_type("interlaced", "field_parity").alias("scan_type"))


@query("color_names", f"SELECT p_partkey, CASE hcolor WHEN 0 THEN 'bt709' WHEN 3 THEN NULL ELSE 'bt2020' END AS primaries_name, CASE hcolor WHEN 0 THEN 'bt709' END AS transfer_name, CASE hcolor WHEN 0 THEN 'bt709' WHEN 1 THEN 'bt2020-ncl' WHEN 2 THEN 'bt2020-cl' END AS matrix_name FROM ({JOINED})")
def color_names(spark, sf_dir):
    codes = color_meta(spark, sf_dir)
    return codes.select("p_partkey", *(c.alias(n) for n, c in H.color_names("primaries", "transfer", "matrix").items()))


@query("color_merge", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'smpte432' WHEN hcolor = 0 THEN 'bt709' WHEN hcolor = 3 THEN 'unspecified' ELSE 'bt2020' END AS primaries FROM ({JOINED})")
def color_merge(spark, sf_dir):
    h = parsed(spark, sf_dir).withColumn("track", F.when(F.col("p_partkey") % 3 == 0, "smpte432").when(F.col("p_partkey") % 3 == 1, "nonsense"))
    fallback = F.when(F.col("color_space").startswith("bt2020"), "bt2020").otherwise(F.col("color_space"))
    return h.select("p_partkey", M.color_or("track", ["bt709", "bt470bg", "smpte170m", "bt2020", "smpte432"], fallback).alias("primaries"))


@query("header_summary", f"SELECT p_partkey, coalesce(profile, 'unknown') || ' CID ' || hcid || ' ' || width || 'x' || height || ' ' || depth || '-bit ' || CASE WHEN h444 = 1 THEN '4:4:4' ELSE '4:2:2' END AS summary FROM ({JOINED})")
def header_summary(spark, sf_dir):
    h = parsed(spark, sf_dir).withColumn("profile", F.coalesce("profile", F.lit("unknown")))
    return h.select("p_partkey", H.summary("profile", "header_cid", "width", "height", "bit_depth", "is444").alias("summary"))


@query("native_supported", f"SELECT p_partkey, depth = 8 AND h444 = 0 AND hinterlaced = 0 AND halpha = 0 AS supported FROM ({JOINED})")
def native_supported(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", H.native_supported("bit_depth", "is444", "interlaced", "alpha").alias("supported"))


@query("aspect_ratio", f"SELECT p_partkey, CAST(hwidth // gcd(hwidth, width) AS BIGINT) AS par_num, CAST(width // gcd(hwidth, width) AS BIGINT) AS par_den FROM ({JOINED})")
def aspect_ratio(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", "par_num", "par_den")


@query("container_par", "SELECT p_partkey, (p_size * 16 * 9) // gcd(p_size * 16 * 9, (p_partkey % 7 + 1) * 80) AS num, ((p_partkey % 7 + 1) * 80) // gcd(p_size * 16 * 9, (p_partkey % 7 + 1) * 80) AS den FROM part WHERE p_size > 0")
def container_par(spark, sf_dir):
    p = read(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", (F.col("p_size").cast("long") * 144).alias("a"), ((F.col("p_partkey") % 7 + 1) * 80).alias("b"))
    g = p.withColumn("g", H.gcd("a", "b"))
    return g.select("p_partkey", (F.col("a") / F.col("g")).cast("long").alias("num"), (F.col("b") / F.col("g")).cast("long").alias("den"))


@query(
    "row_spans",
    f"""SELECT p_partkey, CAST(i AS INTEGER) AS "row", CAST(640 + i * 3 AS BIGINT) AS first, CAST(CASE WHEN i + 1 < hmb THEN 640 + (i + 1) * 3 ELSE 640 + 180 END AS BIGINT) AS past, CAST(CASE WHEN i + 1 < hmb THEN 3 ELSE 180 - i * 3 END AS BIGINT) AS length, true AS valid
    FROM ({FIELDS}), unnest(range(0, hmb)) t(i)""",
)
def row_spans(spark, sf_dir):
    h = frames.headers(spark, sf_dir).select("p_partkey", F.explode(F.array(F.when(F.octet_length("packet") == 640, F.concat("packet", F.unhex(F.lit("5a" * 180)))).otherwise(F.col("packet")))).alias("packet"))
    return H.row_spans(H.parse(h), "p_partkey")


@query("mb_header", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey * 37 % 65536) >> 5 & 1023 ELSE (p_partkey * 37 % 65536) >> 5 END AS INTEGER) AS qscale, ((p_partkey * 37 % 65536) >> 4 & 1) = 1 AS act, p_partkey % 2 = 0 AND (p_partkey * 37 % 65536) >> 15 = 1 AS interlaced FROM part")
def mb_header(spark, sf_dir):
    row = B.be_bytes(F.col("p_partkey") * 37, 2)
    return read(spark, sf_dir, "part").select("p_partkey", H.macroblock_header(row, F.col("p_partkey") % 2 == 0).alias("m")).select("p_partkey", "m.qscale", "m.act", "m.interlaced")


PLANES = f"SELECT p_partkey, (width + 15) // 16 * 16 AS w, (height + 15) // 16 * 16 AS h, CASE WHEN h444 = 1 THEN (width + 15) // 16 * 16 ELSE (width + 15) // 16 * 8 END AS c, CASE WHEN depth = 8 THEN 1 ELSE 2 END AS n FROM ({JOINED})"


@query("frame_layout", f"SELECT p_partkey, CAST(w AS BIGINT) AS coded_width, CAST(h AS BIGINT) AS coded_height, CAST(c AS BIGINT) AS chroma_width, CAST(n AS BIGINT) AS bytes_per_sample, CAST(w * n AS BIGINT) AS luma_stride, CAST(c * n AS BIGINT) AS chroma_stride, CAST(w * h * n + 2 * c * h * n AS BIGINT) AS byte_length FROM ({PLANES})")
def frame_layout(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", H.layout("width", "height", "is444", "bit_depth").alias("l")).select("p_partkey", "l.*")


COPY = f"SELECT p_partkey, k AS plane, CASE k WHEN 0 THEN w * n ELSE c * n END AS row_bytes, h FROM ({PLANES}), unnest([0, 1, 2]) t(k)"
RESOLVED = f"SELECT *, row_bytes * h AS byte_length, coalesce(sum(row_bytes * h) OVER (PARTITION BY p_partkey ORDER BY plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({COPY})"


def resolved(spark, sf_dir):
    from cinequery.operators.layout import resolve

    planes = frame_layout(spark, sf_dir).select("p_partkey", F.col("coded_height").alias("height"), F.posexplode(F.array("luma_stride", "chroma_stride", "chroma_stride")).alias("plane", "row_bytes"))
    return resolve(planes, "p_partkey")


@query("copy_layout", f'SELECT p_partkey, plane, CAST(off AS BIGINT) AS "offset", CAST(row_bytes AS BIGINT) AS stride, CAST(byte_length AS BIGINT) AS byte_length, false AS overlaps FROM ({RESOLVED})')
def copy_layout(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("allocation_size", f"SELECT p_partkey, CAST(max(off + byte_length) AS BIGINT) AS size FROM ({RESOLVED}) GROUP BY p_partkey")
def allocation_size(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("p_partkey").agg(F.max(F.col("offset") + F.col("byte_length")).alias("size"))


@query("plane_contiguous", f"SELECT p_partkey, count(*) AS planes, true AS contiguous FROM ({RESOLVED}) GROUP BY p_partkey")
def plane_contiguous(spark, sf_dir):
    w = Window.partitionBy("p_partkey").orderBy("offset")
    next_ = resolved(spark, sf_dir).withColumn("ok", F.coalesce(F.lag(F.col("offset") + F.col("byte_length")).over(w) == F.col("offset"), F.lit(True)))
    return next_.groupBy("p_partkey").agg(F.count("*").alias("planes"), F.bool_and("ok").alias("contiguous"))


@query("video_frame_eligible", f"SELECT p_partkey, CASE pixfmt WHEN 'yuv420p8' THEN 'I420' WHEN 'yuv422p8' THEN 'I422' WHEN 'yuv444p8' THEN 'I444' END AS format, CAST(floor(CAST(width AS DOUBLE) * (hwidth // gcd(hwidth, width)) / (width // gcd(hwidth, width)) + 0.5) AS BIGINT) AS display_width FROM ({SIZED})")
def video_frame_eligible(spark, sf_dir):
    f = F.col("pixel_format")
    name = F.when(f == "yuv420p8", "I420").when(f == "yuv422p8", "I422").when(f == "yuv444p8", "I444")
    return parsed(spark, sf_dir).select("p_partkey", name.alias("format"), F.floor(F.col("width").cast("double") * F.col("par_num") / F.col("par_den") + 0.5).alias("display_width"))


@query("sample_desc", f"SELECT p_partkey, upper(coalesce(profile, 'unknown')) AS name, width || 'x' || height AS size FROM ({JOINED})")
def sample_desc(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", F.upper(F.coalesce("profile", F.lit("unknown"))).alias("name"), F.concat_ws("x", "width", "height").alias("size"))


@query("track_decodable", f"SELECT p_partkey // 10 AS track, arg_min(profile IS NOT NULL AND hmb > 0 AND pixfmt <> 'unknown', p_partkey) AS decodable FROM ({SIZED}) GROUP BY p_partkey // 10")
def track_decodable(spark, sf_dir):
    ok = F.col("profile").isNotNull() & (F.col("macroblock_height") > 0) & (F.col("pixel_format") != "unknown")
    return parsed(spark, sf_dir).groupBy(F.expr("p_partkey div 10").alias("track")).agg(F.min_by(ok, "p_partkey").alias("decodable"))


@query("frame_filled", f"SELECT p_partkey, profile IS NOT NULL AND expected IS NOT NULL AS filled FROM ({SIZED})")
def frame_filled(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", F.forall(F.array(F.col("profile").isNull(), F.col("expected_size").isNull(), F.col("pixel_format").isNull()), lambda x: ~x).alias("filled"))


@query("decode_status", """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'unexpected-eof' WHEN p_partkey % 13 = 0 THEN 'invalid-data' WHEN p_partkey % 21 = 20 THEN 'not-supported' ELSE 'header-ok' END AS status FROM part""")
def decode_status(spark, sf_dir):
    h = H.parse(frames.headers(spark, sf_dir))
    return h.select("p_partkey", F.when(F.octet_length("packet") < H.HEADER_BYTES, "unexpected-eof").when(~F.col("ok"), "invalid-data").when(F.col("profile").isNull(), "not-supported").otherwise("header-ok").alias("status"))




@query("dc_prediction", f"SELECT event_id, CAST(512 + sum(user_id - 75) OVER (PARTITION BY event_id // 24, event_id % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dc FROM events")
def dc_prediction(spark, sf_dir):
    w = Window.partitionBy(F.expr("event_id div 24"), F.col("event_id") % 3).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "events").select("event_id", (512 + F.sum(F.col("user_id") - 75).over(w)).alias("dc"))


@query("zigzag_position", "SELECT event_id, CAST(sum(user_id % 7 + 1) OVER w AS BIGINT) AS pos, sum(user_id % 7 + 1) OVER w > 63 AS error FROM events WINDOW w AS (PARTITION BY event_id // 16 ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def zigzag_position(spark, sf_dir):
    w = Window.partitionBy(F.expr("event_id div 16")).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    pos = F.sum(F.col("user_id") % 7 + 1).over(w)
    return read(spark, sf_dir, "events").select("event_id", pos.alias("pos"), (pos > 63).alias("error"))


_LUMA = ", ".join(f"({k}, {at}, {t.luma[at]})" for k, (_, t) in enumerate(sorted(TABLES.items())) for at in range(0, 64, 9))


@query("qscale_weights", f"SELECT event_id, CAST(place AS BIGINT) AS pos, event_id % 1024 * weight AS weight FROM events JOIN (VALUES {_LUMA}) w(k, place, weight) ON k = user_id % 20")
def qscale_weights(spark, sf_dir):
    """The scale times the luma weights of each of twenty profiles, at every ninth place."""
    luma = F.array(*(F.array(*(F.lit(t.luma[at]) for at in range(0, 64, 9))) for _, t in sorted(TABLES.items())))
    e = read(spark, sf_dir, "events").select("event_id", F.posexplode(F.get(luma, (F.col("user_id") % 20).cast("int"))).alias("i", "w"))
    return e.select("event_id", (F.col("i") * 9).cast("long").alias("pos"), (F.col("event_id") % 1024 * F.col("w")).alias("weight"))


@query("dc_delta", "SELECT event_id, CASE WHEN n = 0 THEN 0 WHEN v < (1 << (n - 1)) THEN v - ((1 << n) - 1) ELSE v END AS delta FROM (SELECT event_id, CAST(user_id % 12 AS INTEGER) AS n, event_id % (1 << CAST(user_id % 12 AS INTEGER)) AS v FROM events WHERE user_id % 12 > 0 UNION ALL SELECT event_id, 0, 0 FROM events WHERE user_id % 12 = 0)")
def dc_delta(spark, sf_dir):
    n = (F.col("user_id") % 12).cast("int")
    v = F.col("event_id") % F.call_function("shiftleft", F.lit(1).cast("long"), n)
    return read(spark, sf_dir, "events").select("event_id", S.dc_delta(v, n).alias("delta"))


@query("dequantise", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END * ((level * scale + (scale >> 1) + bias) >> shift) AS coefficient FROM (SELECT event_id, event_id % 500 AS level, user_id + 3 AS scale, CASE WHEN event_id % 3 = 0 THEN 32 ELSE 0 END AS bias, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 4 END AS shift FROM events)")
def dequantise(spark, sf_dir):
    third = F.col("event_id") % 3 == 0
    c = S.dequantise(F.col("event_id") % 500, F.col("user_id") + 3, F.when(third, 32).otherwise(0), F.when(third, 6).otherwise(4), F.col("event_id") % 2 == 1)
    return read(spark, sf_dir, "events").select("event_id", c.alias("coefficient"))


@query("block_placement", "SELECT event_id, CASE b WHEN 0 THEN 'Y' WHEN 1 THEN 'Y' WHEN 2 THEN 'Cb' ELSE 'Cr' END AS plane, CASE WHEN b < 2 THEN mb * 16 + b * 8 ELSE mb * 8 END + i % 8 AS x, r * 16 + i // 8 AS y FROM (SELECT event_id, event_id % 4 AS b, event_id // 4 % 120 AS mb, event_id // 480 AS r, user_id % 64 AS i FROM events)")
def block_placement(spark, sf_dir):
    from cinequery.operators.layout import place

    e = read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 4 AS block", "event_id div 4 % 120 AS macroblock", "event_id div 480 AS mb_row", "user_id % 64 AS i")
    return e.select("event_id", *(c.alias(n) for n, c in place("block", "macroblock", "mb_row", "i").items()))


_BASIS = ", ".join(f"({x}, {u}, {v!r})" for x, line in enumerate(S.basis()) for u, v in enumerate(line))
COEF = "SELECT vec_id, i - 1 AS i, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) + CASE WHEN i = 1 THEN 1024 ELSE 0 END AS c FROM embeddings, unnest(range(1, 65)) t(i)"
ROWS = f"SELECT vec_id, i // 8 AS v, x, sum(c * b ORDER BY u) AS s FROM ({COEF}) c JOIN (VALUES {_BASIS}) k(x, u, b) ON k.u = i % 8 GROUP BY ALL"


def blocks(spark, sf_dir):
    c = F.transform("embedding", lambda x, i: F.floor(x.cast("double") * 1000).cast("long") + F.when(i == 0, 1024).otherwise(0))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), c.alias("coefficients"))


@query("idct8x8", f"SELECT vec_id, CAST(y * 8 + q.x AS INTEGER) AS pos, CAST(least(1023, greatest(0, floor(sum(s * b ORDER BY v) / 4 + 0.5))) AS INTEGER) AS sample FROM ({ROWS}) q JOIN (VALUES {_BASIS}) k(y, u, b) ON k.u = q.v GROUP BY vec_id, y, q.x")
def idct8x8(spark, sf_dir):
    done = decode.idct(blocks(spark, sf_dir), 10)
    return done.select(F.col("id").alias("vec_id"), F.posexplode("samples").alias("pos", "sample"))


@query("idct_dc_only", "SELECT event_id, CAST(least(255, greatest(0, floor(CAST(user_id * 17 - 300 AS DOUBLE) / 8 + 0.5))) AS INTEGER) AS sample FROM events")
def idct_dc_only(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", S.idct_dc(F.col("user_id") * 17 - 300, F.lit(8)).alias("sample"))


SAMPLE = "SELECT event_id, event_id % 1024 AS a, user_id * 13 % 1024 AS b, event_id * 7 % 1024 AS c FROM events"


def samples(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 1024 AS a", "user_id * 13 % 1024 AS b", "event_id * 7 % 1024 AS c")


@query("chroma_420", "SELECT pair, CAST((sum(s) + 1) AS BIGINT) >> 1 AS s FROM (SELECT event_id // 2 AS pair, event_id * 13 % 256 AS s FROM events) GROUP BY pair HAVING count(*) = 2")
def chroma_420(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("event_id div 2 AS pair", "event_id", "event_id * 13 % 256 AS s")
    below = F.lead("s").over(Window.partitionBy("pair").orderBy("event_id"))
    return rows.withColumn("below", below).where("below IS NOT NULL").select("pair", S.chroma_420(F.col("s"), F.col("below")).alias("s"))


@query("chroma_444", "SELECT event_id * 2 + k AS x, event_id * 13 % 256 AS s FROM events, unnest([0, 1]) t(k)")
def chroma_444(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 13 % 256).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    return rows.select((F.col("event_id") * 2 + F.col("k")).alias("x"), "s")


@query("gbr_to_yuv", f"""SELECT event_id, CAST(least(1023, greatest(0, floor(64 + 876.0::DOUBLE * l + 0.5))) AS INTEGER) AS y, CAST(least(1023, greatest(0, floor(512 + 896.0::DOUBLE * ((bb - l) / {2 * (1 - 0.0722)!r}::DOUBLE) + 0.5))) AS INTEGER) AS cb, CAST(least(1023, greatest(0, floor(512 + 896.0::DOUBLE * ((rr - l) / {2 * (1 - 0.2126)!r}::DOUBLE) + 0.5))) AS INTEGER) AS cr
FROM (SELECT *, 0.2126::DOUBLE * rr + {1 - 0.2126 - 0.0722!r}::DOUBLE * gg + 0.0722::DOUBLE * bb AS l FROM (SELECT event_id, a / 1023.0::DOUBLE AS gg, b / 1023.0::DOUBLE AS bb, c / 1023.0::DOUBLE AS rr FROM ({SAMPLE})))""")
def gbr_to_yuv(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in S.gbr_to_yuv(F.col("a"), F.col("b"), F.col("c"), 10).items()))


_RGB = f"""SELECT event_id, 1.164383::DOUBLE * (a * 0.25::DOUBLE - 16) AS l, b * 0.25::DOUBLE - 128 AS cb, c * 0.25::DOUBLE - 128 AS cr FROM ({SAMPLE})"""
_CHANNELS = {"r": "l + 1.792741::DOUBLE * cr", "g": "l + -0.213249::DOUBLE * cb + -0.532909::DOUBLE * cr", "b": "l + 2.112402::DOUBLE * cb"}


@query("yuv_to_rgba", f"SELECT event_id, {', '.join(f'CAST(least(255, greatest(0, floor({e} + 0.5))) AS INTEGER) AS {n}' for n, e in _CHANNELS.items())}, 255 AS a FROM ({_RGB})")
def yuv_to_rgba(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in S.yuv_to_rgb(F.col("a"), F.col("b"), F.col("c"), 10).items()), F.lit(255).alias("a"))


@query("yuv_to_rgb_float", f"SELECT event_id, {', '.join(f'CAST(least(255, greatest(0, {e})) AS DOUBLE) AS {n}' for n, e in _CHANNELS.items())} FROM ({_RGB})")
def yuv_to_rgb_float(spark, sf_dir):
    rgb = S.yuv_to_rgb(F.col("a"), F.col("b"), F.col("c"), 10, rounded=False)
    return samples(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in rgb.items()))


@query("yuv_to_rgb_native", f"SELECT event_id, CAST(least(255, greatest(0, (298 * (a - 16) + 459 * (c - 128) + 128) >> 8)) AS INTEGER) AS r, CAST(least(255, greatest(0, (298 * (a - 16) - 55 * (b - 128) - 136 * (c - 128) + 128) >> 8)) AS INTEGER) AS g, CAST(least(255, greatest(0, (298 * (a - 16) + 541 * (b - 128) + 128) >> 8)) AS INTEGER) AS b FROM (SELECT event_id, a % 256 AS a, b % 256 AS b, c % 256 AS c FROM ({SAMPLE}))")
def yuv_to_rgb_native(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in S.yuv_to_rgb_native(*(F.col(x) % 256 for x in "abc")).items()))


@query("depth_reduce", "SELECT event_id, (event_id % 4096) >> 4 AS s FROM events")
def depth_reduce(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", S.depth_reduce(F.col("event_id") % 4096, 12).alias("s"))


@query("bob_deinterlace", "SELECT t.f, t.r, least(k - 1, t.r // 2) * 2 AS source, s.line FROM (SELECT event_id // 8 AS f, event_id % 8 AS r, 4 AS k FROM events) t JOIN (SELECT event_id // 8 AS f, event_id % 8 AS r, user_id AS line FROM events) s ON s.f = t.f AND s.r = least(k - 1, t.r // 2) * 2")
def bob_deinterlace(spark, sf_dir):
    from cinequery.operators.layout import bob

    return bob(read(spark, sf_dir, "events").selectExpr("event_id div 8 AS f", "event_id % 8 AS r", "user_id AS line"), "f", "r", "line", 8, 0)


@query("weave_fields", "SELECT event_id // 8 AS f, event_id % 4 * 2 + event_id // 4 % 2 AS r, user_id AS line FROM events")
def weave_fields(spark, sf_dir):
    from cinequery.operators.layout import weave

    fields = read(spark, sf_dir, "events").selectExpr("event_id div 8 AS f", "event_id % 4 AS r", "event_id div 4 % 2 AS parity", "user_id AS line")
    return weave(fields, "f", "r", "parity").select("f", "r", "line")


PCM = "SELECT event_id, event_id * 7919 % 65536 AS raw, 16 - user_id % 5 AS valid FROM events"


@query("pcm_samples", f"SELECT event_id, CAST((CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END) >> CAST(16 - valid AS INTEGER) AS DOUBLE) / pow(2.0, valid - 1) AS v FROM ({PCM})")
def pcm_samples(spark, sf_dir):
    raw = F.col("event_id") * 7919 % 65536
    b = F.concat(B.be_bytes(raw, 1), B.be_bytes(F.shiftright(raw, 8), 1))
    return read(spark, sf_dir, "events").select("event_id", S.pcm_sample(b, 0, F.lit(16), 16 - F.col("user_id") % 5).alias("v"))


@query("pcm_layout", "SELECT event_id, CASE WHEN s IN (16, 24, 32) AND v BETWEEN 1 AND s THEN CAST(s // 8 AS INTEGER) END AS bytes FROM (SELECT event_id, user_id % 33 AS v, CASE WHEN event_id % 3 = 0 THEN user_id % 33 ELSE event_id % 5 * 8 END AS s FROM events)")
def pcm_layout(spark, sf_dir):
    stored = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5 * 8)
    return read(spark, sf_dir, "events").select("event_id", S.pcm_layout(F.col("user_id") % 33, stored).alias("l")).select("event_id", "l.bytes")


#: Two-byte little-endian words of the whole texts, as hex.
_WORDS = "SELECT doc_id, strlen(text) AS n, regexp_extract_all(hex(encode(text)), '.{4}') AS ws FROM documents"
_RAW = f"SELECT doc_id, n, i, CAST('0x' || w[3:4] || w[1:2] AS INTEGER) AS raw FROM (SELECT doc_id, n, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM ({_WORDS}))"
_PCM = f"SELECT doc_id, i // 2 AS frame, i % 2 AS channel, CAST(CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END AS DOUBLE) / 32768 AS v FROM ({_RAW})"


@query("pcm_deinterleave", f"{_PCM} WHERE n % 4 = 0")
def pcm_deinterleave(spark, sf_dir):
    from cinequery.operators.layout import deinterleave

    return deinterleave(read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload")), "doc_id", 2, partial="reject")


@query("pcm_unpack_native", f"{_PCM} WHERE i < n // 4 * 2")
def pcm_unpack_native(spark, sf_dir):
    from cinequery.operators.layout import deinterleave

    return deinterleave(read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload")), "doc_id", 2, partial="floor")


ALLOWED = "CASE p_partkey % 4 WHEN 0 THEN ['yuv444p8', 'yuv420p8'] WHEN 1 THEN ['yuv420p8', 'yuv420p10'] WHEN 2 THEN ['yuv444p10', 'yuv444p12'] ELSE ['yuv422p8', 'gbrp12'] END"


@query("select_format", f"""SELECT p_partkey, CASE WHEN list_contains(ok, pixfmt) THEN pixfmt WHEN pixfmt LIKE 'gbrp%' THEN CASE WHEN list_contains(ok, 'yuv444p' || depth) THEN 'yuv444p' || depth END
WHEN pixfmt LIKE 'yuv422%' THEN list_extract(list_filter(ok, lambda x: x LIKE '%p' || depth AND x LIKE 'yuv%'), 1) END AS chosen FROM (SELECT *, {ALLOWED} AS ok FROM ({SIZED}))""")
def select_format(spark, sf_dir):
    k = F.col("p_partkey") % 4
    some = lambda *x: F.array(*map(F.lit, x))
    allowed = F.when(k == 0, some("yuv444p8", "yuv420p8")).when(k == 1, some("yuv420p8", "yuv420p10")).when(k == 2, some("yuv444p10", "yuv444p12")).otherwise(some("yuv422p8", "gbrp12"))
    return parsed(spark, sf_dir).select("p_partkey", S.select_format("pixel_format", allowed).alias("chosen"))


@query("format_dim", f"SELECT p_partkey, pixfmt AS format, CAST(CASE WHEN pixfmt LIKE 'yuv%' THEN depth END AS INTEGER) AS depth FROM ({SIZED})")
def format_dim(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", F.col("pixel_format").alias("format"), S.format_depth("pixel_format").alias("depth"))


@query("chroma_dims", f"SELECT p_partkey, CAST(CASE WHEN pixfmt LIKE 'yuv444%' OR pixfmt LIKE 'gbrp%' THEN width ELSE (width + 1) // 2 END AS BIGINT) AS chroma_width, CAST(height AS BIGINT) AS chroma_height FROM ({SIZED})")
def chroma_dims(spark, sf_dir):
    return parsed(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in S.chroma_size("pixel_format", F.col("width"), F.col("height")).items()))


@query("convert_dispatch", f"SELECT p_partkey, CASE WHEN pixfmt LIKE 'gbrp%' THEN 'matrix' WHEN pixfmt LIKE 'yuv422%' AND p_partkey % 2 = 0 THEN 'average rows' WHEN pixfmt LIKE 'yuv422%' THEN 'repeat columns' ELSE 'none' END AS step FROM ({SIZED})")
def convert_dispatch(spark, sf_dir):
    f = F.col("pixel_format")
    target = F.when(F.col("p_partkey") % 2 == 0, "420").otherwise("444")
    step = F.when(F.startswith(f, F.lit("gbrp")), "matrix").when(F.startswith(f, F.lit("yuv422")) & (target == "420"), "average rows").when(F.startswith(f, F.lit("yuv422")) & (target == "444"), "repeat columns").otherwise("none")
    return parsed(spark, sf_dir).select("p_partkey", step.alias("step"))


@query("render_supported", f"SELECT p_partkey, pixfmt <> 'unknown' AND hcolor <> 2 AS ok FROM ({SIZED})")
def render_supported(spark, sf_dir):
    l = H.layout("width", "height", "is444", "bit_depth")
    row = F.col("width") * l["bytes_per_sample"]
    fits = (l["luma_stride"] >= row) & (l["byte_length"] >= l["luma_stride"] * (F.col("height") - 1) + row)
    return parsed(spark, sf_dir).select("p_partkey", ((F.col("pixel_format") != "unknown") & (F.col("color_space") != "bt2020-cl") & fits).alias("ok"))


_SPANS = ", ".join(f"({cid}, {symbol}, {code << (16 - length)}, {(code + 1) << (16 - length)}, {length})" for cid, t in sorted(TABLES.items()) for symbol, (code, length) in enumerate(t.ac))


@query("huffman_lut", f"SELECT event_id, symbol, length FROM (SELECT event_id, event_id * 7919 % 65536 AS bits, user_id % 20 AS k FROM events) JOIN (SELECT *, dense_rank() OVER (ORDER BY cid) - 1 AS rank FROM (VALUES {_SPANS}) s(cid, symbol, first, past, length)) ON rank = k AND bits >= first AND bits < past")
def huffman_lut(spark, sf_dir):
    """The coefficient symbol that sixteen bits begin with in the code of one of twenty profiles, and its length."""
    spans = code_tables.spans(spark, {k: TABLES[cid].ac for k, cid in enumerate(sorted(TABLES))})
    e = read(spark, sf_dir, "events").selectExpr("event_id", "event_id * 7919 % 65536 AS bits", "CAST(user_id % 20 AS INT) AS code_id")
    return e.join(F.broadcast(spans), "code_id").where("bits >= first AND bits < past").select("event_id", "symbol", "length")


_PARAMETERS = ", ".join(f"({cid}, {t.index_bits}, {t.bias}, {t.shift})" for cid, t in sorted(TABLES.items()))


@query(
    "row_table_params",
    f"""SELECT p_partkey, CASE WHEN depth = 12 THEN 6 ELSE index_bits END AS index_bits, CASE WHEN depth = 12 THEN CASE WHEN h444 = 1 THEN 32 ELSE 8 END ELSE bias END AS level_bias, CASE WHEN depth = 12 THEN 4 ELSE shift END AS level_shift
    FROM ({JOINED}) f LEFT JOIN (VALUES {_PARAMETERS}) t(cid, index_bits, bias, shift) ON t.cid = f.hcid WHERE t.cid IS NOT NULL""",
)
def row_table_params(spark, sf_dir):
    """Extra bits, bias and shift that decode each frame of a known profile, as its tables give them at the frame's depth."""
    rows = [(cid, depth, is444, *(lambda t: (t.index_bits, t.bias, t.shift))(t.at_depth(depth, is444))) for cid, t in TABLES.items() for depth in (8, 10, 12) for is444 in (False, True)]
    chosen = F.broadcast(spark.createDataFrame(rows, "header_cid long, bit_depth int, is444 boolean, index_bits int, level_bias int, level_shift int"))  # six rows a profile
    return parsed(spark, sf_dir).join(chosen, ["header_cid", "bit_depth", "is444"]).select("p_partkey", "index_bits", "level_bias", "level_shift")


#: Weights of each profile's tables, the place in a block that stands for each coded place, and the component of each block of a macroblock.
_WEIGHTS = ", ".join(f"({cid}, {c}, {at}, {w})" for cid in sorted({k.cid for k in coded.KINDS}) for c, line in enumerate((TABLES[cid].luma, TABLES[cid].chroma)) for at, w in enumerate(line))
_PLACES = ", ".join(map(str, frame_decode.ZIGZAG.tolist()))
COMPONENTS = f"SELECT *, CASE WHEN is444 = 1 THEN block // 2 % 3 WHEN block // 2 % 2 = 1 THEN 1 + block % 2 ELSE 0 END AS component FROM ({coded.BLOCKS})"
DC = f"SELECT *, CAST((1 << (depth + 2)) + sum(delta * CASE WHEN depth = 12 THEN 4 ELSE 1 END) OVER (PARTITION BY frame, unit, mb_row, component ORDER BY block) AS BIGINT) AS dc FROM ({COMPONENTS})"
LEVELS = f"""SELECT frame, unit, mb_row, block, [{_PLACES}][CAST(s.spot + 1 AS BIGINT)] AS place, CASE WHEN minus <> unit THEN -1 ELSE 1 END * (((base + extra * 128) * scale * weight + (scale * weight >> 1) + CASE WHEN used < 32 OR weight <> used THEN used ELSE 0 END) >> moved) AS value
FROM (SELECT b.*, CASE WHEN depth = 12 THEN CASE WHEN is444 = 1 THEN 32 ELSE 8 END ELSE t.bias END AS used, CASE WHEN depth = 12 THEN 4 ELSE t.shift END AS moved FROM ({COMPONENTS}) b JOIN (VALUES {_PARAMETERS}) t(table_cid, index_bits, bias, shift) ON table_cid = b.cid) b
JOIN ({coded.SYMBOLS}) s ON l_partkey = p_partkey JOIN (VALUES {_WEIGHTS}) w(weight_cid, chroma, weight_at, weight) ON weight_cid = cid AND chroma = least(component, 1) AND weight_at = s.spot"""


@query(
    "entropy_decode",
    f"""SELECT d.frame, d.unit, d.mb_row, d.block, dc, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(placed, 0) AS placed, mbaff = 1 AND d.mb_row % 2 = 1 AS crossed FROM ({DC}) d
    LEFT JOIN (SELECT frame, unit, mb_row, block, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * place) AS BIGINT) AS placed FROM ({LEVELS}) GROUP BY ALL) USING (frame, unit, mb_row, block)""",
)
def entropy_decode(spark, sf_dir):
    """Of each coded block of frames of thirteen kinds its constant term, and number and sums of its other coefficients, from the bits of its row."""
    rows = frame_decode.coefficients(settled(coded.packets(spark, sf_dir)), "frame", TABLES).where("code = 0")
    per = F.when(F.size("blocks") / F.size("crossed") == 12, 12).otherwise(8)  # what is coded stands in a row's first macroblock
    blocks = rows.select("frame", "unit", F.col("row").alias("mb_row"), F.col("crossed")[0].alias("crossed"), F.posexplode(F.slice("blocks", F.lit(1), per)).alias("block", "b"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    placed = F.zip_with("b.places", "b.values", lambda p, v: p.cast("long") * v)
    return blocks.select("frame", "unit", F.col("mb_row").cast("long").alias("mb_row"), F.col("block").cast("long").alias("block"), F.col("b.dc").cast("long").alias("dc"), F.size("b.places").cast("long").alias("n"), total("b.values").alias("total"), total(placed).alias("placed"), "crossed")


#: A code for synthetic frames: differences of a fixed four-bit length, blocks that end at once.
FLAT = frame_decode.RowTables(dc=[(n, 4) for n in range(12)], ac=[(0, 1), (2, 2)], levels=[(0, 0), (1, 0)], run=[(0, 1)], runs=[1], end=0, luma=[32] * 64, chroma=[32] * 64)
#: Sixteen parts make a frame of one macroblock a row and two rows; a part gives a block its difference, of seven bits with a sign.
BLOCKS = "SELECT p_partkey // 16 AS frame, p_partkey % 16 // 8 AS mb_row, p_partkey % 8 AS block, p_partkey * 29 % 64 + 64 AS raw, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 29 % 64 - 127 ELSE p_partkey * 29 % 64 + 64 END AS delta, p_partkey % 3 = 0 AS negative FROM part"
WHOLE = f"SELECT * FROM ({BLOCKS}) WHERE frame IN (SELECT p_partkey // 16 FROM part GROUP BY 1 HAVING count(*) = 16)"


def coded_frames(spark, sf_dir):
    """frame, packet: headers of 16 by 32 samples in 8 bits, two rows of eight blocks of a constant each; every eleventh frame is cut after the third block of its second row."""
    sql = BLOCKS.replace("//", "div").replace("FROM part", "FROM {part}")
    blocks = spark.sql(sql, part=read(spark, sf_dir, "part"))
    digits = lambda c, n: F.lpad(F.bin(c), n, "0")
    bits = F.concat(F.lit("0111"), digits(F.when(F.col("negative"), F.col("raw") - 64).otherwise(F.col("raw")), 7), F.lit("0"))
    rows = blocks.select("frame", "mb_row", "block", bits.alias("bits")).groupBy("frame", "mb_row").agg(F.count("*").alias("n"), F.expr("listagg(bits) WITHIN GROUP (ORDER BY block)").alias("bits"))
    # Eleven bits of scale and one of transform before eight blocks of twelve bits: 108, filled to 112.
    rows = rows.withColumn("hex", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.conv(F.substring(F.concat(F.lit("000000000010"), "bits", F.lit("0000")), i * 4 + 1, F.lit(4)), 2, 16)), ""))
    frames = rows.groupBy("frame").agg(F.sum("n").alias("n"), F.expr("listagg(hex) WITHIN GROUP (ORDER BY mb_row)").alias("hex")).where("n = 16")
    head = bytearray(0x280)
    head[0:5] = (0x280).to_bytes(4, "big") + b"\x03"
    head[0x18:0x1C] = (32).to_bytes(2, "big") + (16).to_bytes(2, "big")
    head[0x21] = 0x20
    head[0x28:0x2C] = (1274).to_bytes(4, "big")
    head[0x16C:0x16E] = (2).to_bytes(2, "big")
    head[0x174:0x178] = (14).to_bytes(4, "big")
    whole = F.unhex(F.concat(F.lit(bytes(head).hex()), "hex"))
    return frames.select("frame", F.when(F.col("frame") % 11 == 0, F.substring(whole, 1, 640 + 20)).otherwise(whole).alias("packet"))


@query(
    "frame_decode",
    f"""SELECT frame, CASE WHEN frame % 11 = 0 THEN NULL ELSE plane END AS plane, CASE WHEN frame % 11 = 0 THEN NULL ELSE total END AS total, CASE WHEN frame % 11 = 0 THEN 'DC code' ELSE 'ok' END AS status FROM (SELECT frame, plane, CAST(sum(64 * sample) AS BIGINT) AS total
    FROM (SELECT frame, CASE WHEN block IN (2, 6) THEN 'cb' WHEN block IN (3, 7) THEN 'cr' ELSE 'y' END AS plane, least(255, greatest(0, floor(CAST(1024 + sum(delta) OVER (PARTITION BY frame, mb_row, CASE WHEN block IN (2, 6) THEN 1 WHEN block IN (3, 7) THEN 2 ELSE 0 END ORDER BY block ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 8 + 0.5))) AS sample
    FROM ({WHOLE})) GROUP BY ALL)""",
)
def frame_decode_query(spark, sf_dir):
    """Sums of the samples of each plane of decoded frames, with what went wrong."""
    done = frame_decode.decode(coded_frames(spark, sf_dir), "frame", {1274: FLAT})
    planes = F.explode(F.array(*(F.struct(F.lit(p).alias("plane"), F.col(p).alias("bytes")) for p in ("y", "cb", "cr"))))
    rows = done.select("frame", "status", planes.alias("p"))
    # Two hex digits a sample.
    total = F.aggregate(F.sequence(F.lit(0), F.octet_length("p.bytes") - 1), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.hex(F.substring(F.col("p.bytes"), i + 1, F.lit(1))), 16, 10).cast("long"))
    ok = F.col("status") == "ok"
    return rows.select("frame", F.when(ok, F.col("p.plane")).alias("plane"), F.when(ok, total).alias("total"), "status")


_SIZES = ", ".join(f"({k}, {x.width})" for k, x in enumerate(coded.KINDS))
#: Samples of the frames of one macroblock a row: the coefficients, and their transform by columns of a row and rows of a column.
_COEFFICIENTS = f"SELECT frame, unit, mb_row, block, 0 AS place, dc AS value FROM ({DC}) UNION ALL SELECT frame, unit, mb_row, block, place, value FROM ({LEVELS})"
_LINES = f"SELECT frame, unit, mb_row, block, place // 8 AS v, x, sum(CAST(value AS DOUBLE) * b ORDER BY u) AS s FROM ({_COEFFICIENTS}) JOIN (VALUES {_BASIS}) k(x, u, b) ON u = place % 8 WHERE frame % {len(coded.KINDS)} IN ({', '.join(str(k) for k, x in enumerate(coded.KINDS) if x.width == 16)}) GROUP BY ALL"
_SAMPLES = f"SELECT frame, unit, mb_row, block, q.x, y, floor(sum(s * b ORDER BY v) / 4 + 0.5) AS sample FROM ({_LINES}) q JOIN (VALUES {_BASIS}) k(y, u, b) ON u = q.v GROUP BY ALL"
_SUMS = f"SELECT frame, component, CAST(sum(least((1 << depth) - 1, greatest(0, sample))) AS BIGINT) AS total FROM ({_SAMPLES}) JOIN (SELECT frame, unit, mb_row, block, component, depth FROM ({COMPONENTS})) USING (frame, unit, mb_row, block) GROUP BY ALL"


@query(
    "frame_planes",
    f"""SELECT frame, plane, 'ok' AS status, CAST(units * (24 // blocks) AS BIGINT) AS rows, CAST(units * (24 // blocks) * (w // 16) AS BIGINT) AS macroblocks, CAST(units * (24 // blocks) * 16 * w // CASE WHEN plane = 'y' OR is444 = 1 THEN 1 ELSE 2 END * CASE WHEN depth = 8 THEN 1 ELSE 2 END AS BIGINT) AS bytes, total
    FROM (SELECT DISTINCT frame, kind, units, blocks, is444, depth FROM ({coded.BLOCKS})) JOIN (VALUES {_SIZES}) k(kind_number, w) ON kind_number = kind CROSS JOIN (VALUES ('y', 0), ('cb', 1), ('cr', 2)) p(plane, component) LEFT JOIN ({_SUMS}) USING (frame, component)""",
)
def frame_planes(spark, sf_dir):
    """Size of each plane of frames of thirteen kinds, what was decoded, and of frames of one macroblock a row the sum of the samples."""
    done = frame_decode.decode(settled(coded.packets(spark, sf_dir)), "frame", TABLES)
    planes = F.explode(F.array(*(F.struct(F.lit(p).alias("plane"), F.col(p).alias("bytes")) for p in ("y", "cb", "cr"))))
    rows = done.select("frame", "status", F.col("rows").cast("long").alias("rows"), F.col("macroblocks").cast("long").alias("macroblocks"), "width", "bit_depth", planes.alias("p"))
    sample = F.when(F.col("bit_depth") == 8, 1).otherwise(2)
    value = lambda i: F.conv(F.hex(F.substring("p.bytes", i + 1, F.lit(1))), 16, 10).cast("long") * F.when(i % sample == 0, 1).otherwise(256)
    total = F.aggregate(F.sequence(F.lit(0), F.octet_length("p.bytes") - 1), F.lit(0).cast("long"), lambda s, i: s + value(i))
    return rows.select("frame", "p.plane", "status", "rows", "macroblocks", F.octet_length("p.bytes").cast("long").alias("bytes"), F.when(F.col("width") == 16, total).alias("total"))


_MADE = "CASE WHEN frame % 11 <> 0 THEN {} END"


@query(
    "frame_fields",
    f"""SELECT frame, {", ".join(f"{_MADE.format(v)} AS {c}" for c, v in (("coded_width", "CAST(16 AS BIGINT)"), ("coded_height", "CAST(32 AS BIGINT)"), ("visible_width", "16"), ("visible_height", "32"), ("pixel_format", "'yuv422p8'"), ("color_space", "'bt709'"), ("color_primaries", "1"), ("scan_type", "'progressive'"), ("bytes", "CAST(1024 AS BIGINT)")))},
    frame % 11 <> 0 AS filled FROM (SELECT DISTINCT frame FROM ({WHOLE}))""",
)
def frame_fields(spark, sf_dir):
    """Fields of decoded frames, and whether all sixteen are there: those of cut frames aren't."""
    rows = frame_decode.fields(coded_frames(spark, sf_dir), "frame", {1274: FLAT})
    return rows.select("frame", "coded_width", "coded_height", "visible_width", "visible_height", "pixel_format", "color_space", "color_primaries", "scan_type", F.col("layout.byte_length").alias("bytes"), "filled")


@query(
    "plane_convert",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 2 END AS bytes, CASE event_id % 3 WHEN 0 THEN a WHEN 1 THEN (a + b + 1) // 2 END AS first, CASE event_id % 3 WHEN 0 THEN b WHEN 1 THEN (a + b + 1) // 2 END AS last
    FROM (SELECT event_id, event_id * 7 % 256 AS a, user_id * 13 % 256 AS b FROM events)""",
)
def plane_convert(spark, sf_dir):
    """Planes of four by two samples to whole chroma, to half of its rows, and to a format that can't be had."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", "event_id * 7 % 256 AS a", "user_id * 13 % 256 AS b")
    line = lambda c, n: F.unhex(F.repeat(F.lpad(F.hex(c), 2, "0"), F.lit(n)))
    third = F.col("event_id") % 3
    target = F.when(third == 0, "yuv444p8").when(third == 1, "yuv420p8").otherwise("yuv422p10")
    chroma = F.concat(line("a", 2), line("b", 2))
    frames = e.select("event_id", F.concat(line("a", 4), line("b", 4)).alias("y"), chroma.alias("cb"), chroma.alias("cr"), F.lit(4).alias("coded_width"), F.lit("yuv422p8").alias("source"), target.alias("target"), F.lit(None).cast("string").alias("matrix"))
    done = frame_decode.convert(frames, "event_id")
    at = lambda i: F.conv(F.hex(F.substring("cb", i, F.lit(1))), 16, 10).cast("long")
    size = F.octet_length("cb")
    return done.select("event_id", size.alias("bytes"), at(F.lit(1)).alias("first"), at(size).alias("last"))
