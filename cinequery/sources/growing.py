"""Container files that still grow, as a stream: ``spark.readStream.format("klv_stream").load(folder)`` gives tagged rows.

A file's offset is (byte, ord, body_sid, done): a place where a triplet begins, how many rows were
before, and the body there. The driver finds how far whole triplets reach by their keys and lengths
alone; tasks read each file from its offset to the next one. A file is done once it ends with a
random index that tells its own length. Until then what doesn't fit its end may still be written, so
the file waits there; when done, faults are errors as in a walk of the whole file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cinequery.operators import klv
from cinequery.operators.split_walk import Until
from cinequery.sources.media import File

SCHEMA = "file string, event string, ord long, offset long, key_hex string, value_offset long, value_length long, body_sid long, error string"
#: byte, ord, body_sid, done.
State = tuple[int, int, int, bool]
START: State = (0, 0, 0, False)


def finished(source: klv.Reader) -> bool:
    """Whether a file ends with a random index whose last number is its own length."""
    if source.size < 20:
        return False
    at = source.size - int.from_bytes(source.read(source.size - 4, 4), "big")
    if not 0 <= at <= source.size - 20 or source.read(at, 16).hex() != klv.RANDOM_INDEX_KEY:
        return False
    found = klv.triplet(source, at)
    return not isinstance(found, str) and found[2] + found[3] == source.size


def rows(source: klv.Reader, state: State, whole: bool, max_resync: int) -> Iterator[tuple[tuple, State]]:
    """Rows (event, ord, offset, key, value offset and length, body_sid, error) from a state on, each with the state after it. Of a file that isn't ``whole`` up to the first place where no triplet fits."""
    _, ord_, body_sid, _ = state
    for offset, key, _, at, length, after, error in klv.walk(source, max_resync, state[0]):
        if key is None and not whole:
            return
        if key is not None and klv.is_partition(key) and length >= 80:
            body_sid = int.from_bytes(source.read(at + 60, 4), "big")
        event = "error" if key is None else "frame" if key.startswith(klv.ESSENCE_PREFIXES) else "other"
        ord_ += 1
        yield (event, ord_ - 1, offset, key, at, length, body_sid, error), (source.size if after is None else after, ord_, body_sid, False)


class Part(InputPartition):
    def __init__(self, path: str, begin: State, end: State):
        super().__init__(path)
        self.path, self.begin, self.end = path, begin, end


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.extensions = tuple(options.get("extensions", ".mxf").lower().split(","))
        self.limit = int(options.get("maxResyncBytes", 16 << 20))
        self.known: dict[str, State] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[str]:
        found = []
        for path in self.paths:
            found += [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.lower().endswith(self.extensions)] if os.path.isdir(path) else [path] if os.path.exists(path) else []
        return sorted(set(found))

    def latestOffset(self) -> dict:
        """How far each file reaches; what earlier batches found is gone on from, a fresh reader begins at the files' start and so never stays behind what a restarted stream has."""
        for path in self._files():
            state = self.known.get(path, START)
            if state[3]:
                continue
            source = File(path)
            try:
                whole = finished(source)
                for _, after in rows(source, state, whole, self.limit):
                    state = after
                self.known[path] = (*state[:3], whole and state[0] == source.size)
            finally:
                source.close()
        return {path: {"byte": s[0], "ord": s[1], "body_sid": s[2], "done": s[3]} for path, s in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        state = lambda offsets, path: (lambda o: (o["byte"], o["ord"], o["body_sid"], o["done"]))(offsets[path]) if path in offsets else START
        parts = [Part(path, state(start, path), state(end, path)) for path in sorted(end)]
        return [p for p in parts if p.begin != p.end]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        begin, end, path = partition.begin, partition.end, partition.path
        if begin[0] == 0 and begin[1] == 0:
            yield (path, "log", -1, 0, None, None, None, 0, None)
        source = File(path)
        try:
            # Within the batch all is known to fit; the file's end counts where it is done.
            bound = source if end[3] else Until(source, end[0])
            for row, after in rows(bound, begin, True, self.limit):
                yield (path, *row)
                if after[1] >= end[1]:
                    break
        finally:
            source.close()
        if end[3]:
            yield (path, "done", end[1], end[0], None, None, None, end[2], None)

    def commit(self, end: dict) -> None:
        """Nothing is held for what is done."""


class GrowingSource(DataSource):
    """Options: extensions, maxResyncBytes."""

    @classmethod
    def name(cls) -> str:
        return "klv_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the source; repeated calls do nothing new."""
    spark.dataSource.register(GrowingSource)
