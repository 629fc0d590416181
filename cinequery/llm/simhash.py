"""SimHash near-duplicates, found through deletion variants of fingerprint halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.common import cut, released, text_blocks
from cinequery.llm.components import components

#: Links join fingerprints that differ in so many bits at most. Of two halves, one then differs in one bit at most.
BITS = 3
#: Shared variants with more fingerprints than this are cut once more before pairs are formed.
CROWD = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles, repeats included. No words: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(width)), strict=False)) if len(parts) >= width else [b" ".join(parts)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _print(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20):
            raw = data.tobytes()
            prints = [fingerprint(raw[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, print (the 64 bits as a long) of each row. Null and wordless texts have the print 0."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(_print(batches, width)), schema)


#: The halves of a print, as numbers of 32 bits.
HALVES = ("(print & 4294967295L)", "shiftrightunsigned(print, 32)")


#: The half that a variant's key doesn't hold.
OTHER = f"(CASE WHEN key < {1 << 40}L THEN {HALVES[1]} ELSE {HALVES[0]} END)"


def _far(bits: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits


def variants(prints: DataFrame) -> DataFrame:
    """print, key, bit: each half as it is (bit null), and with each of its bits struck out (bit: what was struck out).

    Two halves that differ in just one place share the variant without it, with unlike bits;
    equal halves share the whole one. So every pair is met at most once per half.
    """
    parts = []
    for k, half in enumerate(HALVES):
        parts.append(f"array(struct({k << 40 | 32 << 33}L | {half} AS key, CAST(NULL AS INT) AS bit))")
        parts.append(f"""transform(sequence(0, 31), place -> struct(
            {k << 40}L + shiftleft(CAST(place AS BIGINT), 33) + ({half} & ~shiftleft(1L, place)) AS key,
            CAST(shiftrightunsigned({half}, place) & 1 AS INT) AS bit))""")
    return prints.selectExpr("print", f"explode(concat({', '.join(parts)})) AS v").select("print", "v.key", "v.bit")


def _met(prints: DataFrame) -> DataFrame:
    """print, key, bit, part: the variants that several prints share, cut into parts where they are a crowd."""
    shared = Window.partitionBy("key")
    # A number of partitions is given, as a print is a few bytes and its variants are many.
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "print")
    met = variants(dealt).withColumn("n", F.count("*").over(shared)).where("n > 1")
    # A crowd shares a half; the other half differs in three bits at most, so of its four bytes one is equal.
    parts = F.expr(f"""CASE WHEN n <= {CROWD} THEN array(-1L) ELSE transform(sequence(0, 3), i ->
        256L * i + (shiftrightunsigned({OTHER}, 8 * i) & 255)) END""")
    return cut(met.select("print", "key", "bit", F.explode(parts).alias("part")))


def _pairs(met: DataFrame, bits: int, apart: Column) -> DataFrame:
    """a, b and what else stands beside them (name a, name b) of the pairs of prints within ``bits`` for which ``apart`` holds: of equal halves, and of halves without the bit in which they differ."""
    side = lambda rows, end: rows.select("key", "part", *(F.col(c).alias(end if c == "print" else f"{c} {end}") for c in rows.columns if c not in ("key", "part", "bit")))
    pick = lambda bit: met.where(F.col("bit").isNull() if bit is None else F.col("bit") == bit)
    equal = side(pick(None), "a").join(side(pick(None), "b"), ["key", "part"]).where((F.col("a") < F.col("b")) & _far(bits) & apart)
    return equal.unionByName(side(pick(0), "a").join(side(pick(1), "b"), ["key", "part"]).where(_far(bits) & apart)).drop("key", "part")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: the pairs of distinct prints that differ in at most ``bits`` (3) bits, each once."""
    return _pairs(_met(prints), bits, F.lit(True)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """node, component of the prints that are linked: the smallest print each reaches.

    Not all pairs are formed. First each print is linked to those that differ in one bit, and within
    each shared half to the print before it and to the first, where these are near: as many links
    as there are rows. Of the other pairs only those between prints that these links leave apart
    count, and of them one for each two classes.
    """
    met = _met(prints)
    single = met.where("bit IS NOT NULL").groupBy("key", F.expr(OTHER).alias("other")).agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a < b").select("a", "b")
    group = Window.partitionBy("key", "part").orderBy("print")
    near = met.where("bit IS NULL").select(F.col("print").alias("b"), F.lag("print").over(group).alias("before"), F.first("print").over(group).alias("first")).select("b", F.explode(F.array("before", "first")).alias("a"))
    first = cut(components(single.unionByName(near.where("a < b").where(_far(bits)).select("a", "b"))))
    named = met.join(first.withColumnRenamed("node", "print"), "print", "left").withColumn("class", F.coalesce("component", "print")).drop("component")
    further = _pairs(named, bits, F.col("class a") != F.col("class b")).select(F.greatest("class a", "class b").alias("a"), F.least("class a", "class b").alias("b")).distinct()
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(further))


def groups(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    One row per row of ``docs``; equal prints are linked through their smallest id. Null ids take
    part under their text, but name no component unless they are alone (then it is null). An empty
    table gives an empty result; a text of any length is hashed whole, in parts of bounded memory.
    """
    prints = cut(fingerprints(docs, width))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    joined = classes(nodes.select("print"), bits).withColumnRenamed("node", "print")
    named = nodes.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id, of repeated ids that with the smallest hash of its text. Rows count by themselves: of one id, each text stays or goes with its own group. All columns stay; rows without an id cannot be named and stay."""
    named = docs.where("doc_id IS NOT NULL").withColumn("hash of its text", F.xxhash64("text"))
    row = ["doc_id", "hash of its text"]
    prints = cut(fingerprints(named.select(F.struct("doc_id", F.col(row[1]).alias("text_hash")).alias("doc_id"), "text"), width))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    joined = classes(nodes.select("print"), bits).withColumnRenamed("node", "print")
    keep = nodes.join(joined, "print", "left").groupBy(F.coalesce("component", "print")).agg(F.min("first").alias("first")).select("first.doc_id", F.col("first.text_hash").alias(row[1]))
    turn = F.row_number().over(Window.partitionBy(*row).orderBy(F.xxhash64(*docs.columns)))
    kept = named.join(keep, row, "left_semi").withColumn("turn of its text", turn).where(F.col("turn of its text") == 1)
    return kept.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
