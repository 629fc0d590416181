"""What a file may hold, by its name and first bytes: container, stream, how sure that is, and where it shows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions import header as H
from cinequery.functions import media as M
from cinequery.operators.frame_scan import headers

#: Extensions of files that may hold such streams, atoms of a movie container, and its sample entries.
EXTENSIONS = (".mov", ".mxf", ".dnxhd", ".dnxhr")
ATOMS, ENTRIES = (b"ftyp", b"moov", b"mdat"), (b"AVdn", b"AVdh")
#: Bytes searched for atoms and headers, bytes searched for entries, and entries listed.
HEAD, MOVIE, LISTED = 512 << 10, 4 << 20, 8
_NEEDLES = re.compile(b"|".join(ATOMS + ENTRIES))
FOUND = "atom_offset long, entries array<struct<entry:string,offset:long>>, header_offset long, packet binary"


def found(data: bytes, head: int = HEAD, movie: int = MOVIE) -> tuple[int | None, list[tuple[str, int]], int | None, bytes | None]:
    """The first atom's place, the first entries, and the first header with its place: one pass for all needles, as none begins within another."""
    atom, entries = None, []
    for hit in _NEEDLES.finditer(data, 0, min(len(data), movie)):
        if hit[0] in ENTRIES:
            if len(entries) < LISTED:
                entries.append((hit[0].decode(), hit.start()))
        elif atom is None and hit.end() <= head:
            atom = hit.start()
    at = next(headers(data, head), None)
    return atom, entries, at, None if at is None else data[at : at + H.HEADER_BYTES]


def searched(files: DataFrame, head: int = HEAD, movie: int = MOVIE) -> DataFrame:
    """``files`` (file, name, payload: at least the first MOVIE bytes, or all) with what is found in place of the payload."""
    kept = files.select("file", "name", "payload")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                atom, entries, at, packet = found(batch.column(2)[k].as_py() or b"", head, movie)
                listed = pa.array([[{"entry": e, "offset": o} for e, o in entries]], pa.list_(pa.struct([("entry", pa.string()), ("offset", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:2], pa.array([atom], pa.int64()), listed, pa.array([at], pa.int64()), pa.array([packet], pa.binary())], names=["file", "name", "atom_offset", "entries", "header_offset", "packet"])

    return kept.mapInArrow(search, f"file {files.schema['file'].dataType.simpleString()}, name string, {FOUND}")


def probe(files: DataFrame, head: int = HEAD, movie: int = MOVIE) -> DataFrame:
    """file, name, container, stream, confidence, entries, header_offset, summary and reasons of files (file, name, payload) that may hold a stream of frames; others have no row.

    A file may by its extension, by a sample entry in its first ``movie`` bytes or by a frame's header
    in its first ``head`` bytes. Null names and payloads say nothing; empty files are judged by name.
    """
    rows = H.parse(searched(files, head, movie), "packet")
    named = F.coalesce(F.lower(F.regexp_extract("name", r"\.[^.]*$", 0)).isin(*EXTENSIONS), F.lit(False))
    atom, entry, header = F.col("atom_offset").isNotNull(), F.size("entries") > 0, F.col("header_offset").isNotNull()
    summary = H.summary("known", "header_cid", "width", "height", "bit_depth", "is444")
    return rows.withColumn("known", F.coalesce("profile", F.lit("unknown"))).where(named | entry | header).select(
        "file", "name", F.when(atom, "QuickTime/ISO BMFF").when(header, "raw frame").alias("container"), F.coalesce(F.get("entries", F.lit(0))["entry"], F.when(header, F.col("fourcc"))).alias("stream"),
        M.confidence(named, atom, entry, header).alias("confidence"), "entries", "header_offset", F.when(header, summary).alias("summary"), F.when(header, F.col("reasons")).alias("reasons"),
    )


def probe_path(spark: SparkSession, path: str) -> DataFrame:
    """The same of files at a path that all workers see: they are listed by Spark, which leaves out empty ones, and of each only the first MOVIE bytes are read."""
    from cinequery.sources import media

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.lit(0).cast("long").alias("value_offset"), F.least("length", F.lit(MOVIE).cast("long")).alias("value_length"))
    return probe(media.packets(listed).select("file", F.col("file").alias("name"), "payload"))
