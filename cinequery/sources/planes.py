"""A sink for planes and packets: ``df.write.format("planes").mode("append").save(folder)`` writes a file for each row, whole or not at all.

Rows have ``name`` and ``planes``, an array of (bytes, row_bytes, offset, stride) in the order they
are laid. Row r of a plane goes to offset + r * stride; bytes between are 0. A null offset is the end
of the plane before, a null stride the row's own bytes, null row_bytes the whole plane as one row, as
a packet is. The folder is one that the driver and all workers see; it holds the files of a write
only once all its tasks are done, by renaming, and nothing of one that failed.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PLANE = "struct<bytes:binary,row_bytes:long,offset:long,stride:long>"
SCHEMA = f"name string, planes array<{PLANE}>"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they stand and what they will be named."""

    files: list[tuple[str, str]]


def resolved(planes: list) -> list[tuple[bytes, int, int, int]]:
    """Bytes, row bytes, offset and stride of each plane, all given; an error where rows don't fit their stride or planes overlap."""
    out, end = [], 0
    for p in planes:
        data = bytes(p["bytes"] or b"")
        row = p["row_bytes"] if p["row_bytes"] is not None else len(data)
        if row < 0 or (row and len(data) % row) or (not row and data):
            raise ValueError(f"a plane of {len(data)} bytes isn't of rows of {row}")
        offset, stride = p["offset"] if p["offset"] is not None else end, p["stride"] if p["stride"] is not None else row
        rows = len(data) // row if row else 0
        if offset < 0 or (rows > 1 and stride < row):
            raise ValueError(f"rows of {row} bytes don't fit a stride of {stride} from {offset}")
        end = offset + (rows - 1) * stride + row if rows else offset
        out.append((data, row, offset, stride))
    spans = sorted((o, o + (len(d) // r - 1) * s + r) for d, r, o, s in out if d)
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise ValueError("planes overlap")
    return out


def laid(planes: list) -> bytes:
    """The planes in one buffer."""
    placed = resolved(planes)
    size = max((o + (len(d) // r - 1) * s + r for d, r, o, s in placed if d), default=0)
    buffer = bytearray(size)
    for data, row, offset, stride in placed:
        for k in range(len(data) // row if row else 0):
            buffer[offset + k * stride : offset + k * stride + row] = data[k * row : (k + 1) * row]
    return bytes(buffer)


class PlaneWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.under_way = os.path.join(path, f"_under_way-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        own = os.path.join(self.under_way, uuid.uuid4().hex)  # another one for each attempt of a task
        os.mkdir(own)  # which fails once the write is given up
        files = []
        for row in iterator:
            name = row["name"]
            if not name or os.path.basename(name) != name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} is no name for a file")
            at = os.path.join(own, name)
            if os.path.exists(at):
                raise ValueError(f"several rows are named {name!r}")
            with open(at, "wb") as f:
                f.write(laid(row["planes"] or []))
            files.append((at, os.path.join(self.path, name)))
        return Written(files)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("several rows have the same name")
        if self.overwrite:
            for old in os.listdir(self.path):
                if not old.startswith("_"):
                    os.remove(os.path.join(self.path, old))
        for at, to in files:
            os.replace(at, to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """What isn't committed goes: first its name, so that tasks still running can add nothing."""
        if os.path.isdir(self.under_way):
            os.rename(self.under_way, f"{self.under_way}-gone")
        shutil.rmtree(f"{self.under_way}-gone", ignore_errors=True)


class PlaneSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "planes"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        path = self.options.get("path")
        if not path:
            raise ValueError("a folder is needed")
        writer = PlaneWriter(path, overwrite)
        os.makedirs(writer.under_way)
        return writer


def register(spark: SparkSession) -> None:
    """Registers the sink; repeated calls do nothing new."""
    spark.dataSource.register(PlaneSink)


def frames(decoded: DataFrame, name: Column, padding: int = 0) -> DataFrame:
    """Rows for the sink of decoded frames (y, cb, cr, bit_depth, is444, width): rows of each plane in its coded width, each ``padding`` bytes apart."""
    sample = F.when(F.col("bit_depth") == 8, 1).otherwise(2)
    wide = (F.ceil(F.col("width") / 16) * 16 * sample).cast("long")
    narrow = F.when(F.col("is444"), wide).otherwise(F.floor(wide / 2).cast("long"))
    plane = lambda c, row: F.struct(F.col(c).alias("bytes"), row.alias("row_bytes"), F.lit(None).cast("long").alias("offset"), (row + padding).alias("stride"))
    return decoded.select(name.cast("string").alias("name"), F.array(plane("y", wide), plane("cb", narrow), plane("cr", narrow)).cast(f"array<{PLANE}>").alias("planes"))


def packets(rows: DataFrame, name: Column, payload: str = "payload") -> DataFrame:
    """Rows for the sink of packets, each as it is."""
    none = F.lit(None).cast("long")
    return rows.select(name.cast("string").alias("name"), F.array(F.struct(F.col(payload).alias("bytes"), none.alias("row_bytes"), none.alias("offset"), none.alias("stride"))).cast(f"array<{PLANE}>").alias("planes"))
