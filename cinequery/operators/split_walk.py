"""A walk of large container files in parts: split where the random index says that partitions begin, walked apart, and stitched.

A file's last triplet lists where its partitions stand. Each part begins with a partition's pack, so
its body is known without what came before; ordinals of triplets and of a track's elements are counted
within a part after the sums of the parts before. A file whose index is missing or lies (a part
doesn't begin with a pack, has a fault, or doesn't end where the next begins) is walked in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.operators import klv
from cinequery.operators.settle import settled

PARTS = "file {file}, part long, start long, past long, bytes binary"


class Piece:
    """Bytes of a file from ``start`` on, read by the file's own offsets."""

    def __init__(self, data: bytes, start: int):
        self.data, self.start, self.size = data, start, start + len(data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[max(0, offset - self.start) : max(0, offset - self.start + length)]


class Until:
    """A file up to ``past``."""

    def __init__(self, source: klv.Reader, past: int):
        self.source, self.size = source, past

    def read(self, offset: int, length: int) -> bytes:
        return self.source.read(offset, max(0, min(length, self.size - offset)))


def starts(source: klv.Reader) -> list[int]:
    """Where the partitions of a file begin by its random index; [0] if it has none, or one that names anything but partitions."""
    if source.size < 20:
        return [0]
    at = source.size - int.from_bytes(source.read(source.size - 4, 4), "big")
    if not 0 < at <= source.size - 20 or source.read(at, 16).hex() != klv.RANDOM_INDEX_KEY:
        return [0]
    found = klv.triplet(source, at)
    if isinstance(found, str) or found[2] + found[3] != source.size or found[3] < 4 or (found[3] - 4) % 12:
        return [0]
    rows = source.read(found[2], found[3] - 4)
    offsets = sorted({int.from_bytes(rows[i + 4 : i + 12], "big") for i in range(0, len(rows), 12)})
    good = offsets and offsets[0] == 0 and offsets[-1] < at and all(klv.is_partition(source.read(o, 16).hex()) for o in offsets)
    return offsets if good else [0]


def parts(files: DataFrame) -> DataFrame:
    """file, part, start, past, bytes: the parts of files (file, payload)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for file, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not payload.is_valid:
                    continue
                data = payload.as_py()
                for part, (a, b) in enumerate(pairwise([*starts(klv.Bytes(data)), len(data)])):
                    rows.append((file, part, a, b, data[a:b]))
                    held += b - a
                    if held > klv.BATCH_BYTES:
                        yield made(rows, batch.schema.field(0).type)
                        rows, held = [], 0
            if rows:
                yield made(rows, batch.schema.field(0).type)

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "part", "start", "past", "bytes"])

    return files.select("file", "payload").mapInArrow(cut, PARTS.format(file=files.schema["file"].dataType.simpleString()))


def path_parts(listed: DataFrame) -> DataFrame:
    """The parts of files (file: a path that all workers see), without their bytes: only their random index and the keys it leads to are read."""
    from cinequery.sources.media import File

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                source = File(file)
                try:
                    rows = [(file, part, a, b, None) for part, (a, b) in enumerate(pairwise([*starts(source), source.size]))]
                finally:
                    source.close()
                if rows:
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "part", "start", "past", "bytes"])

    return listed.select("file").mapInArrow(cut, PARTS.format(file="string"))


def _walked(batches: Iterator[pa.RecordBatch], max_resync: int) -> Iterator[pa.RecordBatch]:
    from cinequery.sources.media import File

    def walked(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, (file, part, start, past) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
            held = batch.column(4)[k]
            source = Piece(held.as_py(), start) if held.is_valid else File(file)
            try:
                for ordinal, row in enumerate(klv.contents(source if held.is_valid else Until(source, past), max_resync, start=start)):
                    yield file, ordinal, *row, part, past
            finally:
                if not held.is_valid:
                    source.close()

    for batch in batches:
        yield from klv.batches_of(walked(batch), batch.schema.field(0).type, ("part", "past"))


def scan(cuts: DataFrame, max_resync: int = 16 << 20) -> DataFrame:
    """The rows of ``klv.scan`` with contents, of files given in parts (``parts``, ``path_parts``): each part is a row of its own, so that the parts of one file go to many tasks."""
    kind = cuts.schema["file"].dataType.simpleString()
    schema = f"{klv.SCHEMA.format(file=kind)}, {klv.CONTENT}"
    dealt = settled(cuts).repartition("file", "part")
    rows = settled(dealt.mapInArrow(lambda batches: _walked(batches, max_resync), f"{schema}, part long, past long"))
    faulty = rows.groupBy("file", "part").agg(F.bool_or(F.col("error").isNotNull()).alias("fault"), (F.max("next_offset") != F.max("past")).alias("off"), F.count("*").alias("many"))
    several = faulty.groupBy("file").agg(F.count("*").alias("parts"), F.bool_or(F.coalesce(F.col("fault") | F.col("off"), F.lit(True))).alias("wrong"))
    again = settled(several.where("wrong AND parts > 1").select("file"))
    # Places are counted after the parts before; a file has as many parts as partitions.
    order = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = faulty.select("file", "part", F.coalesce(F.sum("many").over(order), F.lit(0)).alias("rows before"))
    tail = F.substring("key_hex", 25, 8)
    of_track = rows.where("element IS NOT NULL").groupBy("file", "part", "body_sid", tail.alias("tail")).agg((F.max("element") + 1).alias("many"))
    order = Window.partitionBy("file", "body_sid", "tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = of_track.select("file", "part", "body_sid", "tail", F.coalesce(F.sum("many").over(order), F.lit(0)).alias("elements before"))
    met = rows.withColumn("tail", F.when(F.col("element").isNotNull(), tail)).join(before, ["file", "part"]).join(earlier, ["file", "part", "body_sid", "tail"], "left")
    element = F.col("element") + F.col("elements before")
    met = met.withColumns({"ord": F.col("ord") + F.col("rows before"), "value": F.when(F.coalesce(element, F.lit(0)) == 0, F.col("value")), "element": element})
    columns = [f.name for f in rows.schema.fields if f.name not in ("part", "past")]
    stitched = met.join(again, "file", "left_anti").select(columns)
    # What is in doubt is walked in order: its parts are put together again.
    whole = dealt.join(again, "file").groupBy("file").agg(F.min("start").alias("start"), F.max("past").alias("past"), F.expr("listagg(bytes) WITHIN GROUP (ORDER BY part)").alias("bytes"))
    whole = whole.select("file", F.lit(0).cast("long").alias("part"), "start", "past", "bytes")
    return stitched.unionByName(whole.mapInArrow(lambda batches: _walked(batches, max_resync), f"{schema}, part long, past long").select(columns))
