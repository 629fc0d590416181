"""Time, playback, probing, audio and benchmark statistics."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions import media as M
from cinequery.functions import signal as S
from cinequery.operators import playback as P
from cinequery.operators import stats
from cinequery.operators.frame_decode import RESULTS
from cinequery.plans.registry import query
from cinequery.sources.tables import read


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


_TC = "SELECT event_id, event_id * 37 - 5000 AS n, CASE user_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 30 ELSE 60 END AS base, user_id % 4 >= 2 AND user_id % 8 >= 4 AS d FROM events"
_TC2 = f"SELECT *, CASE WHEN d THEN CASE base WHEN 60 THEN 4 ELSE 2 END ELSE 0 END AS skip FROM ({_TC})"
_TC3 = f"SELECT *, base * 600 - skip * 9 AS ten, CASE WHEN d THEN (base * 600 - skip * 9) * 144 ELSE base * 86400 END AS day FROM ({_TC2})"
_TC4 = f"SELECT *, ((n % day) + day) % day AS shown FROM ({_TC3})"
_TC5 = f"SELECT *, CASE WHEN d THEN shown + skip * 9 * (shown // ten) + CASE WHEN shown % ten >= skip THEN skip * ((shown % ten - skip) // (base * 60 - skip)) ELSE 0 END ELSE shown END AS f FROM ({_TC4})"


@query("timecode", f"SELECT event_id, lpad(CAST(f // (base * 3600) AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // (base * 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(f // base % 60 AS VARCHAR), 2, '0') || CASE WHEN d THEN ';' ELSE ':' END || lpad(CAST(f % base AS VARCHAR), 2, '0') AS formatted FROM ({_TC5})")
def timecode(spark, sf_dir):
    u = F.col("user_id") % 4
    base = F.when(u == 0, 24).when(u == 1, 25).when(u == 2, 30).otherwise(60)
    drop = (u >= 2) & (F.col("user_id") % 8 >= 4)
    tc = M.timecode(F.col("event_id") * 37 - 6000, F.lit(900), F.lit(100), base, drop)
    return events(spark, sf_dir).select("event_id", tc.alias("t")).select("event_id", "t.formatted")


@query("timing_fallback", "SELECT event_id, CAST(CASE WHEN user_id % 3 = 0 THEN floor(CAST(event_id AS DOUBLE) * 1000000 / 30 + 0.5) ELSE floor(event_id * 0.02::DOUBLE * 1000000 + 0.5) END AS BIGINT) AS timestamp_us FROM events")
def timing_fallback(spark, sf_dir):
    given = F.when(F.col("user_id") % 3 > 0, F.col("event_id") * F.lit(0.02))
    return events(spark, sf_dir).select("event_id", M.timestamp_us(given, F.col("event_id")).alias("timestamp_us"))


@query("seek_timing", "SELECT event_id, event_id * CAST(floor(CASE user_id % 3 WHEN 0 THEN 1001.0::DOUBLE * 1000000 / 30000 WHEN 1 THEN 1000000.0::DOUBLE / 25 ELSE 1000000.0::DOUBLE / 60 END + 0.5) AS BIGINT) AS timestamp_us FROM events")
def seek_timing(spark, sf_dir):
    u = F.col("user_id") % 3
    num, den = F.when(u == 0, 30000).when(u == 1, 25).otherwise(60), F.when(u == 0, 1001).otherwise(1)
    return events(spark, sf_dir).select("event_id", (F.col("event_id") * M.frame_duration_us(F.lit(None).cast("double"), num, den)).alias("timestamp_us"))


@query("frame_duration", "SELECT event_id, CAST(CASE WHEN user_id % 4 = 0 AND value > 0 THEN floor(value + 0.5) WHEN user_id % 4 = 1 THEN floor(1001.0::DOUBLE * 1000000 / 24000 + 0.5) ELSE 33333 END AS BIGINT) AS us FROM events")
def frame_duration(spark, sf_dir):
    u = F.col("user_id") % 4
    override, num = F.when(u == 0, F.col("value")), F.when(u == 1, 24000).otherwise(0)
    return events(spark, sf_dir).select("event_id", M.frame_duration_us(override, num, F.lit(1001)).alias("us"))


@query("edit_rate_timing", 'SELECT event_id, event_id * (1001.0::DOUBLE / 30000) AS "timestamp", 1001.0::DOUBLE / 30000 AS duration, event_id AS sequence_number FROM events')
def edit_rate_timing(spark, sf_dir):
    duration = F.lit(1001).cast("double") / F.lit(30000)
    return events(spark, sf_dir).select("event_id", (F.col("event_id") * duration).alias("timestamp"), duration.alias("duration"), F.col("event_id").alias("sequence_number"))


@query("av_decision", "SELECT event_id, CASE WHEN value - user_id < -(1.0::DOUBLE / 60) THEN 'drop' WHEN value - user_id > 1.0::DOUBLE / 60 THEN 'hold' ELSE 'present' END AS decision FROM events")
def av_decision(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", M.decision(F.col("value"), F.col("user_id").cast("double")).alias("decision"))


@query("clock_sample", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS DOUBLE) ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, user_id + greatest(0.0::DOUBLE, value - 20))) END AS t FROM events")
def clock_sample(spark, sf_dir):
    user = F.col("user_id").cast("double")
    return events(spark, sf_dir).select("event_id", M.clock_time(F.col("event_id") % 3 > 0, user, user, F.lit(20.0), F.col("value"), F.lit(100.0)).alias("t"))


#: A clock's events: in each session of 12 the first starts at 3, the eighth seeks to 50, the tenth pauses; the rest only ask. A session whose start is missing never runs.
@query(
    "clock_fold",
    """SELECT event_id // 12 AS session, event_id AS ord, CASE WHEN first IS NULL THEN CASE WHEN k < 8 THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END WHEN k = 0 THEN 0.0::DOUBLE WHEN k < 8 THEN least(60.0::DOUBLE, 3 + (event_id - first) * 0.5::DOUBLE) WHEN k <= 10 THEN least(60.0::DOUBLE, 50 + (event_id - s7) * 0.5::DOUBLE) ELSE least(60.0::DOUBLE, 50 + (s10 - s7) * 0.5::DOUBLE) END AS media_time
    FROM (SELECT *, min(event_id) FILTER (k = 0) OVER s AS first, min(event_id) FILTER (k = 7) OVER s AS s7, min(event_id) FILTER (k = 10) OVER s AS s10 FROM (SELECT event_id, event_id % 12 AS k FROM events) WINDOW s AS (PARTITION BY event_id // 12))""",
)
def clock_fold(spark, sf_dir):
    k = F.col("event_id") % 12
    kind = F.when(k == 0, "start").when(k == 7, "seek").when(k == 10, "pause").otherwise("tick")
    rows = events(spark, sf_dir).select(F.expr("event_id div 12").alias("session"), F.col("event_id").alias("ord"), (F.col("event_id") * F.lit(0.5)).alias("at"), kind.alias("kind"), F.when(k == 0, 3.0).otherwise(50.0).alias("value"))
    return P.clock_fold(rows, 60.0)


SEEKS = "SELECT user_id, event_id, event_id % 100 AS target, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS opens FROM events"


@query("underrun_recovery", "SELECT user_id AS session, event_id AS ord, 'start' AS kind, least(60.0::DOUBLE, greatest(0.0::DOUBLE, value)) AS value FROM events WHERE event_id % 3 > 0 AND value < 60 AND user_id % 4 = 0")
def underrun_recovery(spark, sf_dir):
    samples = events(spark, sf_dir).selectExpr("user_id AS session", "event_id AS ord", "event_id % 3 > 0 AS running", "value AS media_time", "user_id % 4 AS sources")
    return P.recoveries(samples, 60.0)


@query("seek_coalesce", f"SELECT user_id AS session, CAST(burst AS BIGINT) AS burst, max_by(target, event_id) AS target, max(event_id) AS ord FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS burst FROM ({SEEKS})) GROUP BY user_id, burst")
def seek_coalesce(spark, sf_dir):
    return P.coalesce_seeks(events(spark, sf_dir).selectExpr("user_id AS session", "event_id AS ord", "CAST(event_id AS DOUBLE) AS at", "event_id % 100 AS target"), 100.0)


@query("prefetch", "SELECT event_id AS id, unnest(range(event_id % 50 + 1, least(event_id % 50 + 4, 49) + 1)) AS fetch FROM events")
def prefetch(spark, sf_dir):
    return P.prefetch(events(spark, sf_dir).selectExpr("event_id AS id", "event_id % 50 AS index", "49L AS last"), 4)


@query("index_progress", "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_read FROM events")
def index_progress(spark, sf_dir):
    return stats.running(events(spark, sf_dir).select("event_id", "event_type", "user_id"), ["event_type"], "event_id", F.col("user_id"), "bytes_read", 10_000).select("event_id", "bytes_read")


@query("stop_at_first_error", "SELECT event_id AS ord, user_id AS stream FROM events e WHERE event_id <= coalesce((SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_id % 41 = 0), 9223372036854775807)")
def stop_at_first_error(spark, sf_dir):
    return P.until_first_error(events(spark, sf_dir).selectExpr("user_id AS stream", "event_id AS ord", "event_id % 41 = 0 AS failed")).select("ord", "stream")


_KEPT = "SELECT user_id AS stream, event_id AS ord, event_id % 41 = 0 AS failed, min(CASE WHEN event_id % 41 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events"


@query(
    "decode_events",
    f"""SELECT DISTINCT user_id AS stream, CAST(-1 AS BIGINT) AS ord, 'log' AS type FROM events UNION ALL SELECT stream, ord, CASE WHEN failed THEN 'error' ELSE 'frame' END FROM ({_KEPT}) WHERE first IS NULL OR ord <= first
    UNION ALL SELECT stream, max(ord) + 1, 'done' FROM ({_KEPT}) WHERE first IS NULL GROUP BY stream""",
)
def decode_events(spark, sf_dir):
    return P.decode_events(events(spark, sf_dir).selectExpr("user_id AS stream", "event_id AS ord", "event_id % 41 = 0 AS failed"))


_READS = "SELECT user_id AS session, event_id AS ord, event_id * 7 % 11 AS key FROM events"


@query(
    "lru_sim",
    f"""SELECT session, ord, coalesce((SELECT count(DISTINCT m.key) FROM ({_READS}) m WHERE m.session = r.session AND m.ord > r.last AND m.ord < r.ord) < 4, false) AND last IS NOT NULL AS hit
    FROM (SELECT *, lag(ord) OVER (PARTITION BY session, key ORDER BY ord) AS last FROM ({_READS})) r""",
)
def lru_sim(spark, sf_dir):
    return P.lru(events(spark, sf_dir).selectExpr("user_id AS session", "event_id AS ord", "event_id * 7 % 11 AS key"), 4)


@query("frame_range", "SELECT user_id, event_id, r - 1 AS frame FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r - 1 >= 3 AND r - 1 < 13")
def frame_range(spark, sf_dir):
    numbered = events(spark, sf_dir).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1)
    return numbered.where("frame >= 3 AND frame < 13").select("user_id", "event_id", "frame")


@query("top_hits", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8")
def top_hits(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return events(spark, sf_dir).withColumn("r", first).where("r <= 8").select("user_id", "event_id")


@query("track_detail", "SELECT user_id, count(*) AS packets, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (r <= 12) AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def track_detail(spark, sf_dir):
    numbered = events(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    few = F.sort_array(F.collect_list(F.when(F.col("r") <= 12, F.col("event_id"))))
    return numbered.groupBy("user_id").agg(F.count("*").alias("packets"), F.array_join(few, ",").alias("first"))


@query("probe_confidence", "SELECT page_id, CAST(CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 0.95 WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 0.65 WHEN page_id % 2 = 0 THEN 0.35 ELSE 0.1 END AS DOUBLE) AS confidence FROM pages")
def probe_confidence(spark, sf_dir):
    p = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", M.confidence(p % 2 == 0, p % 3 == 0, p % 5 == 0, p % 7 == 0).alias("confidence"))


_ERR = "CASE event_id % 6 WHEN 0 THEN 'Allocation failed here' WHEN 1 THEN 'Unexpected end of data' WHEN 2 THEN 'index is outside the packet' WHEN 3 THEN 'bad marker' WHEN 4 THEN 'smaller than expected' ELSE 'Out of Memory' END"


@query("error_classify", "SELECT event_id, CASE WHEN user_id % 3 = 0 OR event_id % 6 IN (0, 5) THEN 'out-of-memory' WHEN user_id % 3 = 1 OR event_id % 6 IN (1, 2, 4) THEN 'unexpected-eof' ELSE 'invalid-data' END AS class FROM events")
def error_classify(spark, sf_dir):
    name = F.when(F.col("user_id") % 3 == 0, "RangeError").when(F.col("user_id") % 3 == 1, "UnexpectedEofError").otherwise("Error")
    return events(spark, sf_dir).select("event_id", M.error_class(name, F.expr(_ERR)).alias("class"))


_NAMES = f"(VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in RESULTS.items())}) t(code, name)"


@query("native_error_dim", f"SELECT name, count(*) AS n, bool_and(code = 0) AS ok FROM events JOIN {_NAMES} ON code = event_id % 13 GROUP BY name")
def native_error_dim(spark, sf_dir):
    """How many results of each name, and whether it stands for success."""
    return named(spark, sf_dir).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.bool_and(F.col("code") == 0).alias("ok"))


@query("native_error_names", f"SELECT event_id, CAST(event_id % 13 AS INTEGER) AS code, name FROM events LEFT JOIN {_NAMES} ON code = event_id % 13")
def native_error_names(spark, sf_dir):
    return named(spark, sf_dir)


def named(spark, sf_dir):
    """event_id, code, name of results; null of codes that the decoder doesn't give."""
    code = (F.col("event_id") % 13).cast("int")
    return events(spark, sf_dir).select("event_id", code.alias("code"), F.element_at(F.create_map(*(F.lit(x) for pair in RESULTS.items() for x in pair)), code).alias("name"))


@query("fourcc_norm", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'AVdn' WHEN 1 THEN 'AVdh' END AS fourcc FROM events")
def fourcc_norm(spark, sf_dir):
    k = F.col("event_id") % 4
    return events(spark, sf_dir).select("event_id", M.fourcc(F.when(k == 0, "AVDN").when(k == 1, "avdh").when(k == 2, "apch")).alias("fourcc"))


_AUDIO = "SELECT event_id, user_id % 3 * 48000 AS rate, user_id % 4 AS channels, CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 20 ELSE 33 END AS bits, CASE WHEN event_id % 5 = 0 THEN '060e2b34040101010d0103010207' ELSE '060e2b34040101010d0103010206' END AS label FROM events"
_GOOD = "rate > 0 AND channels > 0 AND bits IN (16, 24) AND label LIKE '%06'"


def audio(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id", "user_id % 3 * 48000 AS rate", "user_id % 4 AS channels", "CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 20 ELSE 33 END AS bits", "CASE WHEN event_id % 5 = 0 THEN '060e2b34040101010d0103010207' ELSE '060e2b34040101010d0103010206' END AS label")


def supported():
    return M.pcm_supported(F.col("rate"), F.lit(1), F.col("channels"), S.pcm_layout("bits", F.lit(None).cast("int")), F.col("label"))


@query("pcm_supported", f"SELECT event_id, {_GOOD} AS ok FROM ({_AUDIO})")
def pcm_supported(spark, sf_dir):
    return audio(spark, sf_dir).select("event_id", supported().alias("ok"))


@query("audio_track_pick", f"SELECT event_id // 6 AS file, min(event_id) FILTER ({_GOOD}) AS track FROM ({_AUDIO}) GROUP BY event_id // 6")
def audio_track_pick(spark, sf_dir):
    return audio(spark, sf_dir).groupBy(F.expr("event_id div 6").alias("file")).agg(F.min(F.when(supported(), F.col("event_id"))).alias("track"))


@query(
    "audio_unsupported_msg",
    f"""SELECT event_id // 6 AS file, string_agg('track ' || event_id || ', essence ' || label || ', ' || bits || '-bit valid, ' || CASE WHEN rate > 0 THEN rate || ' Hz' ELSE 'unknown sample rate' END || ', ' || CASE WHEN channels > 0 THEN channels || ' channel' || CASE WHEN channels = 1 THEN '' ELSE 's' END ELSE 'unknown channels' END, '; ' ORDER BY event_id) AS message
    FROM ({_AUDIO}) GROUP BY event_id // 6 HAVING count(*) FILTER ({_GOOD}) = 0""",
)
def audio_unsupported_msg(spark, sf_dir):
    rate = F.when(F.col("rate") > 0, F.concat(F.col("rate").cast("string"), F.lit(" Hz"))).otherwise("unknown sample rate")
    many = F.when(F.col("channels") == 1, "").otherwise("s")
    channels = F.when(F.col("channels") > 0, F.concat(F.col("channels").cast("string"), F.lit(" channel"), many)).otherwise("unknown channels")
    line = F.concat(F.lit("track "), F.col("event_id").cast("string"), F.lit(", essence "), "label", F.lit(", "), F.col("bits").cast("string"), F.lit("-bit valid, "), rate, F.lit(", "), channels)
    tracks = audio(spark, sf_dir).withColumn("line", line).withColumn("ok", supported())
    groups = tracks.groupBy(F.expr("event_id div 6").alias("file")).agg(F.bool_or("ok").alias("any"), F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("lines"))
    return groups.where("NOT any").select("file", F.array_join(F.transform("lines", lambda x: x["line"]), "; ").alias("message"))


@query("audio_schedule", "SELECT event_id AS id, 5.0::DOUBLE + greatest(0.0::DOUBLE, event_id * 0.25::DOUBLE - 40) AS start_at, greatest(0.0::DOUBLE, 40 - event_id * 0.25::DOUBLE) AS play_offset FROM events WHERE greatest(0.0::DOUBLE, 40 - event_id * 0.25::DOUBLE) < 0.5::DOUBLE")
def audio_schedule(spark, sf_dir):
    buffers = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("event_id") * F.lit(0.25)).alias("ts"), F.lit(0.5).alias("dur"))
    return P.audio_schedule(buffers, 40.0, 5.0)


@query("decode_totals", "SELECT event_id // 2 AS frame, CAST(sum(user_id) AS BIGINT) AS rows_decoded, CAST(sum(user_id * 120) AS BIGINT) AS macroblocks FROM events GROUP BY event_id // 2")
def decode_totals(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.expr("event_id div 2").alias("frame")).agg(F.sum("user_id").alias("rows_decoded"), F.sum(F.col("user_id") * 120).alias("macroblocks"))


@query("sample_diff", "SELECT user_id, CAST(max(d) AS BIGINT) AS max_abs, avg(d) AS mean_abs, count(*) FILTER (d > 1) AS over_1, count(*) FILTER (d > 2) AS over_2, count(*) FILTER (d > 8) AS over_8 FROM (SELECT user_id, abs(event_id % 17 - event_id % 13) AS d FROM events) GROUP BY user_id")
def sample_diff(spark, sf_dir):
    return stats.differences(events(spark, sf_dir).selectExpr("user_id", "event_id % 17 AS left", "event_id % 13 AS right"), "user_id")


@query("latency_pctl", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def latency_pctl(spark, sf_dir):
    return stats.percentiles(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("bench_summary", "SELECT l_returnflag, count(*) AS frames, round(count(*) / sum(l_quantity) * 1000, 3) AS fps, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, round(sum(l_quantity), 3) AS total FROM lineitem GROUP BY l_returnflag")
def bench_summary(spark, sf_dir):
    return stats.summary(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("edit_rate_sniff", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN page_id % 3 * 30000 END AS numerator, CASE WHEN page_id % 3 > 0 THEN CAST(1001 AS BIGINT) END AS denominator FROM pages")
def edit_rate_sniff(spark, sf_dir):
    from cinequery.functions import binary as B

    tag = lambda num: F.concat(F.unhex(F.lit("3d030008")), B.be_bytes(num, 4), B.be_bytes(F.lit(1001), 4))
    payload = F.concat(F.unhex(F.lit("060e2b34")), F.encode("html", "utf-8"), tag(F.lit(999_999_999)), tag(F.col("page_id") % 3 * 30000))
    return stats.sniff_rate(read(spark, sf_dir, "pages").select("page_id", payload.alias("payload")), "page_id", tag_hex="3d030008")


@query("adapter_select", """SELECT conv_id AS file, CASE WHEN conv_id % 5 = 0 THEN 'unsupported pattern' WHEN count(DISTINCT role) <> 2 THEN 'track count' WHEN min(turn) FILTER (role = 'assistant') IS NULL THEN 'no video track' ELSE 'ok' END AS outcome, CASE WHEN conv_id % 5 <> 0 AND count(DISTINCT role) = 2 THEN min(turn) FILTER (role = 'assistant') END AS track FROM conversations GROUP BY conv_id""")
def adapter_select(spark, sf_dir):
    facts = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file")).agg(F.count_distinct("role").alias("n"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"))
    outcome = F.when(F.col("file") % 5 == 0, "unsupported pattern").when(F.col("n") != 2, "track count").when(F.col("first").isNull(), "no video track").otherwise("ok")
    return facts.select("file", outcome.alias("outcome"), F.when(outcome.isin("ok", "no video track"), F.col("first")).alias("track"))
