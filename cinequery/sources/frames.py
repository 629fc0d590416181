"""Frame packets synthesised from the parts table: 640 header bytes whose fields follow from the part's key and size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.binary import be_bytes
from cinequery.functions.header import PROFILES
from cinequery.sources.tables import read

#: Fields of the synthetic headers as SQL over part, the same in Spark and in the counterpart SQL.
FIELDS = {
    "profile_index": "p_partkey % 21",
    "depth_code": "1 + p_partkey % 3",
    "h444": "CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END",
    "hact": "CASE WHEN p_size % 8 = 0 THEN 1 ELSE 0 END",
    "hcolor": "p_size % 4",
    "hinterlaced": "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END",
    "hparity": "CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END",
    "hmbaff": "CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END",
    "halpha": "CASE WHEN p_size % 11 = 0 THEN 1 ELSE 0 END",
    "hfield": "64 + p_size * 48",
    "hwidth": "128 + p_size * 96",
    "hmb": "p_size % 50",
    "hkind": "CASE WHEN p_partkey % 13 = 0 THEN 9 WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END",
}


def cid_sql(column: str = "profile_index") -> str:
    cases = " ".join(f"WHEN {i} THEN {p[0]}" for i, p in enumerate(PROFILES))
    return f"CASE {column} {cases} ELSE 1999 END"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, packet: a header for each part, one in thirteen with a broken prefix, one in seventeen cut short."""
    # Dealt over all tasks: a few bytes of a part make a packet, so that parts of a file's size would be few.
    dealt = read(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    part = dealt.selectExpr("p_partkey", *(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in FIELDS.items())).withColumn("hcid", F.expr(f"CAST({cid_sql()} AS BIGINT)"))
    zero = lambda n: F.unhex(F.lit("00" * n))
    one = lambda sql: be_bytes(F.expr(sql), 1)
    scan = F.unhex(F.lit("".join(f"{3 * i:08x}" for i in range(68))))
    parts = [
        be_bytes(F.lit(0x280), 4), one("hkind"), one("hinterlaced * 2 + hparity"), one("hmbaff * 32"), one("halpha"),
        zero(0x18 - 8), be_bytes(F.col("hfield"), 2), be_bytes(F.col("hwidth"), 2), zero(0x21 - 0x1C), one("depth_code * 32"),
        zero(0x28 - 0x22), be_bytes(F.col("hcid"), 4), one("h444 * 64 + hcolor * 2 + hact"),
        zero(0x16C - 0x2D), be_bytes(F.col("hmb"), 2), zero(2), scan,
    ]
    packet = F.concat(*parts)
    # Exploded from a single element, so that filters on header fields don't copy the whole construction.
    return part.select("p_partkey", F.explode(F.array(F.when(F.col("p_partkey") % 17 == 0, F.substring(packet, 1, 600)).otherwise(packet))).alias("packet"))
