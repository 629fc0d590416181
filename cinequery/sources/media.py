"""A Spark data source for container files: a partition for each file, rows from positional reads of keys and lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from cinequery.operators.klv import CONTENT, contents, walk

SCHEMA = "file string, ord long, offset long, key_hex string, length_field_length int, value_offset long, value_length long, next_offset long, error string"


class File:
    """Positional reads of a file; counts what it reads."""

    def __init__(self, path: str):
        self.path = path
        self._file = open(path, "rb")  # noqa: SIM115
        self.size = os.fstat(self._file.fileno()).st_size
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside {self.size} bytes")
        self.bytes_read += length
        return os.pread(self._file.fileno(), length, offset)

    def close(self) -> None:
        self._file.close()


class OnePath(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.extensions = tuple(options.get("extensions", ".mxf").lower().split(","))
        self.files: set[str] | None = None  # what filters leave of the files listed; none left gives no rows
        self.prefixes: list[str] = []
        self.limit = int(options.get("maxResyncBytes", 16 << 20))
        self.contents = options.get("contents", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes a file's path and a key's starts, all of which must hold; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.files = {f.value} if self.files is None else self.files & {f.value}
            elif isinstance(f, StringStartsWith) and f.attribute == ("key_hex",):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            if os.path.isdir(path):
                found += [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.lower().endswith(self.extensions)]
            else:
                found.append(path)
        return [OnePath(p) for p in sorted(set(found)) if self.files is None or p in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition:  # no file is left
            return
        source = File(partition.path)
        try:
            rows = contents(source, self.limit) if self.contents else walk(source, self.limit)
            for ordinal, row in enumerate(rows):
                if all((row[1] or "").startswith(p) for p in self.prefixes):
                    yield (partition.path, ordinal, *row)
        finally:
            source.close()


class ContainerSource(DataSource):
    """``spark.read.format("klv").load(path)``: the triplets of files and folders, payloads unread. Options: extensions, maxResyncBytes, contents (true: with the metadata's values, as ``klv.contents`` reads them)."""

    @classmethod
    def name(cls) -> str:
        return "klv"

    def schema(self) -> str:
        return f"{SCHEMA}, {CONTENT}" if self.options.get("contents", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the source; repeated calls do nothing new. Spark 4 or later is needed."""
    if int(spark.version.split(".")[0]) < 4:
        raise RuntimeError(f"Python data sources need Spark 4, this is {spark.version}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)


def packets(located, length: str = "value_length", batch_bytes: int = 64 << 20):
    """``located`` (file, value_offset, a length) with the payload bytes, read by position where the rows are. A batch holds ``batch_bytes`` of payload at most, or one packet."""
    import pyarrow as pa

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        file, offset, size = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("file", "value_offset", length))
        out, held, source, first = [], 0, None, 0

        def done(to: int) -> pa.RecordBatch:
            rows = batch.slice(first, to - first)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "payload"])

        try:
            for k in range(batch.num_rows):
                if out and held + size[k] > batch_bytes:
                    yield done(k)
                    out, held, first = [], 0, k
                if source is None or source.path != file[k]:
                    if source is not None:
                        source.close()
                    source = File(file[k])
                out.append(source.read(offset[k], size[k]))
                held += size[k]
            if out:
                yield done(batch.num_rows)
        finally:
            if source is not None:
                source.close()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parts(batch)

    from pyspark.sql.types import BinaryType, StructField, StructType

    return located.mapInArrow(fetch, StructType([*located.schema.fields, StructField("payload", BinaryType())]))
