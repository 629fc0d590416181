"""The driver's tables and the media bytes synthesised from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.binary import be_bytes

#: Key of an essence element of the synthetic files: prefix, item type and element bytes.
ESSENCE_KEY = "060e2b34010201010d01030115010501"
#: Documents in a synthetic file.
FILE_DOCUMENTS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def klv(payload: Column, key: str = ESSENCE_KEY) -> Column:
    """A key, a three-byte length in long form and the value."""
    return F.concat(F.unhex(F.lit(key + "83")), be_bytes(F.octet_length(payload).cast("long"), 3), payload)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, payload: FILE_DOCUMENTS documents of consecutive ids as one file of key-length-value triplets, in the order of their ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", klv(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("triplet"))
    files = docs.groupBy(F.expr(f"doc_id div {FILE_DOCUMENTS}").alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "triplet"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: F.hex(p["triplet"])), F.array().cast("array<string>"), lambda all_, p: F.array_append(all_, p))
    return files.select("file", F.unhex(F.array_join(joined, "")).alias("payload"))


def held(value: Column) -> Column:
    """A synthetic value as the column ``value``, exploded from a single element, so that what reads its fields doesn't construct it anew for each."""
    return F.explode(F.array(value)).alias("value")
