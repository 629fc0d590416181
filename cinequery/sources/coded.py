"""Coded frames made from parts and line items: a part gives a block its constant term, its line items the further coefficients.

Twenty-four parts make a frame. The first macroblock of each row holds their blocks; the rest of a
profile's width is filled with flat ones. The SQL texts here describe what is coded, so that a
counterpart can work out the coefficients without looking at bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.operators.code_tables import TABLES
from cinequery.operators.frame_decode import RowTables
from cinequery.sources.tables import read


@dataclass(frozen=True)
class Kind:
    cid: int
    depth: int
    width: int = 16
    is444: bool = False
    mbaff: bool = False
    fields: int = 0  # bytes of a field, 0 in progressive frames

    @property
    def blocks(self) -> int:
        """Blocks of a macroblock."""
        return 12 if self.is444 else 8


#: A frame's kind is its number modulo theirs: all code tables, three depths, both samplings, fields and macroblocks of mixed lines.
KINDS = (
    Kind(1274, 8), Kind(1272, 8), Kind(1271, 10), Kind(1271, 12), Kind(1270, 10, is444=True), Kind(1270, 12, is444=True), Kind(1242, 8, 1920, fields=303104),
    Kind(1252, 8, 1280), Kind(1250, 10, 1280), Kind(1260, 8, 1440, mbaff=True), Kind(1251, 8, 1280), Kind(1235, 10, 1920), Kind(1237, 8, 1920),
)
PARTS = 24
_CASES = ", ".join(f"({k}, {x.cid}, {x.depth}, {x.blocks}, {int(x.is444)}, {int(x.mbaff)}, {2 if x.fields else 1})" for k, x in enumerate(KINDS))
#: Blocks of whole frames, a row each and field: place, what is coded of the constant term, and the macroblock's scale.
BLOCKS = f"""SELECT b.*, kinds.*, unit, i // blocks AS mb_row, i % blocks AS block, 1 + (b.frame * 7 + i // blocks * 11) % 40 AS scale, CASE WHEN unit = 1 THEN -d ELSE d END AS delta
FROM (SELECT p_partkey, p_partkey // {PARTS} AS frame, p_partkey % {PARTS} AS i, p_partkey * 29 % 127 - 63 AS d, p_partkey // {PARTS} % {len(KINDS)} AS kind FROM part) b
JOIN (VALUES {_CASES}) kinds(kind_id, cid, depth, blocks, is444, mbaff, units) ON kind_id = kind
JOIN (VALUES (0), (1)) u(unit) ON unit < units
JOIN (SELECT p_partkey // {PARTS} AS whole FROM part GROUP BY 1 HAVING count(*) = {PARTS}) w ON whole = b.frame"""
#: Further coefficients of a part: place, level (odd, in order of the series), extra bits above it, run of zeros and sign.
SYMBOLS = """SELECT * FROM (SELECT l_partkey, step - 1 AS run, base, extra, minus, sum(step) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS spot FROM (
SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN 1 + l_linenumber * 7 WHEN l_suppkey % 4 = 0 THEN 2 ELSE 1 END AS step, 3 + l_suppkey * 7 % 64 * 2 AS base,
CASE WHEN l_orderkey % 5 = 0 THEN 1 + l_linenumber ELSE 0 END AS extra, l_linenumber % 2 AS minus FROM (SELECT l_partkey, l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber))) WHERE spot <= 63"""


def bits(value: int, length: int) -> str:
    return format(value, f"0{length}b") if length else ""


class Writer:
    """Symbols of a profile as text of zeros and ones."""

    def __init__(self, tables: RowTables, kind: Kind):
        self.kind, self.t = kind, tables.at_depth(kind.depth, kind.is444)
        text = lambda codes: [bits(*c) for c in codes]
        self.dc, self.ac, self.run = text(tables.dc), text(tables.ac), dict(zip(tables.runs, text(tables.run), strict=True))
        self.symbol = dict(zip(tables.levels, self.ac, strict=True))
        self.flat = self.macroblock(1, False, [(0, [])] * kind.blocks)

    def difference(self, delta: int) -> str:
        size = abs(delta).bit_length()
        return self.dc[size] + bits(delta if delta > 0 else delta + (1 << size) - 1, size)

    def coefficient(self, run: int, base: int, extra: int, minus: int) -> str:
        flags = (1 if extra else 0) | (2 if run else 0)
        return self.symbol[base, flags] + str(minus) + (bits(extra, self.t.index_bits) if extra else "") + (self.run[run] if run else "")

    def macroblock(self, scale: int, crossed: bool, blocks: list[tuple[int, list[tuple[int, int, int, int]]]]) -> str:
        """A scale of 1 to 1023, whether its lines are mixed, and blocks of (difference, coefficients)."""
        head = str(int(crossed)) + bits(scale, 10) if self.kind.mbaff else bits(scale, 11)
        return head + "0" + "".join(self.difference(d) + "".join(self.coefficient(*c) for c in more) + self.ac[self.t.end] for d, more in blocks)

    def row(self, first: str, macroblocks: int) -> bytes:
        text = first + self.flat * (macroblocks - 1)
        n = -(-len(text) // 8)
        return int(text.ljust(8 * n, "0"), 2).to_bytes(n, "big")

    def unit(self, rows: list[bytes], field: int | None) -> bytes:
        """A frame or field: header, places of the rows, rows."""
        head = bytearray(0x280)
        head[0:5] = (0x280).to_bytes(4, "big") + (b"\x03" if self.kind.cid >= 1270 else b"\x01")
        head[5] = 0 if field is None else 2 | field
        head[6] = 0x20 if self.kind.mbaff else 0
        head[0x18:0x1C] = (len(rows) * 16).to_bytes(2, "big") + self.kind.width.to_bytes(2, "big")
        head[0x21] = (self.kind.depth // 2 - 3) << 5
        head[0x28:0x2C] = self.kind.cid.to_bytes(4, "big")
        head[0x2C] = 0x40 if self.kind.is444 else 0
        head[0x16C:0x16E] = len(rows).to_bytes(2, "big")
        at = 0
        for k, row in enumerate(rows):
            head[0x170 + 4 * k : 0x174 + 4 * k] = at.to_bytes(4, "big")
            at += len(row)
        return (bytes(head) + b"".join(rows)).ljust(self.kind.fields, b"\0")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writers = [Writer(TABLES[k.cid], k) for k in KINDS]
    for batch in batches:
        for frame, blocks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = writers[frame % len(KINDS)]
            found = sorted(blocks.as_py(), key=lambda b: (b["unit"], b["mb_row"], b["block"]))
            units = []
            for unit in sorted({b["unit"] for b in found}):
                rows = []
                for mb_row in sorted({b["mb_row"] for b in found}):
                    own = [b for b in found if (b["unit"], b["mb_row"]) == (unit, mb_row)]
                    coded = [(b["delta"], [(s["run"], s["base"], s["extra"], s["minus"] ^ unit) for s in b["symbols"]]) for b in own]
                    rows.append(w.row(w.macroblock(own[0]["scale"], bool(mb_row % 2), coded), -(-w.kind.width // 16)))
                units.append(w.unit(rows, unit if w.kind.fields else None))
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), pa.array([b"".join(units)], pa.binary())], names=["frame", "packet"])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, packet of all whole frames. A block's symbols are 63 at most, a frame's blocks 48."""
    tables = {"part": read(spark, sf_dir, "part"), "lineitem": read(spark, sf_dir, "lineitem")}
    spoken = lambda sql: sql.replace("//", "div").replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}")
    blocks, symbols = spark.sql(spoken(BLOCKS), part=tables["part"]), spark.sql(spoken(SYMBOLS), lineitem=tables["lineitem"])
    lists = symbols.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("spot", "run", "base", "extra", "minus"))).alias("symbols"))
    long = "array<struct<spot:long,run:long,base:long,extra:long,minus:long>>"
    whole = blocks.join(lists, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("symbols", F.coalesce(F.col("symbols").cast(long), F.array().cast(long)))
    frames = whole.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.collect_list(F.struct("unit", "mb_row", "block", F.col("scale").cast("long").alias("scale"), F.col("delta").cast("long").alias("delta"), "symbols")).alias("blocks"))
    # Dealt over all tasks: partitions merged by the size of their symbols would be few.
    frames = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
    return frames.mapInArrow(_written, "frame long, packet binary")
