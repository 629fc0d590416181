"""Files read while they grow give the rows of a walk of the whole files, whatever the batches and restarts."""

import random

from cinequery.operators import klv
from cinequery.sources import growing, media

VIDEO = bytes.fromhex("060e2b34010201010d01030115010501")


def triplet(key, value):
    return key + b"\x83" + len(value).to_bytes(3, "big") + value


def container(rng, junk=False):
    value = bytearray(88)
    data = b""
    for sid in (0, 1, 2):
        value[60:64] = sid.to_bytes(4, "big")
        data += triplet(bytes.fromhex(klv.PARTITION_PREFIX + "030400"), bytes(value))
        for _ in range(4):
            data += triplet(VIDEO, rng.randbytes(rng.randint(0, 400))) + (rng.randbytes(rng.randint(0, 9)) if junk else b"")
    rip = bytes(12)
    return data + triplet(bytes.fromhex(klv.RANDOM_INDEX_KEY), rip + (24 + len(rip)).to_bytes(4, "big"))


def walked(path):
    source = media.File(str(path))
    return [(o, k, at, n, e) for o, k, _, at, n, _, e in klv.walk(source)]


def test_states_go_on_where_they_stopped():
    rng = random.Random(4)
    data = container(rng)
    for most in (1, 3, 100):
        state, got = growing.START, []
        for size in [*sorted(rng.sample(range(len(data)), 12)), len(data)]:
            source = klv.Bytes(data[:size])
            for k, (row, after) in enumerate(growing.rows(source, state, growing.finished(source), 1 << 20), 1):
                got.append(row)
                state = after
                if k == most:
                    break
        while state[0] < len(data):
            for row, state in growing.rows(klv.Bytes(data), state, True, 1 << 20):
                got.append(row)
        assert [(r[2], r[3], r[4], r[5], r[7]) for r in got] == [(o, k, at, n, e) for o, k, _, at, n, _, e in klv.walk(klv.Bytes(data))]
        assert [r[1] for r in got] == list(range(len(got))) and [r[6] for r in got[:5]] == [0] * 5


def test_the_stream_equals_the_walk_after_restarts(spark, tmp_path):
    growing.register(spark)
    rng = random.Random(9)
    whole = {"a.mxf": container(rng), "b.mxf": container(rng, junk=True), "c.mxf": container(rng)}
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("klv_stream").load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for share in (0.3, 0.7, 0.95, 1.0):
        for name, data in whole.items():
            (tmp_path / "in" / name).write_bytes(data[: int(len(data) * share)])
        run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for name in whole:
        own = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.ord)
        assert [r.event for r in own][0] == "log" and [r.event for r in own][-1] == "done" and [r.ord for r in own] == list(range(-1, len(own) - 1))
        assert [(r.offset, r.key_hex, r.value_offset, r.value_length, r.error) for r in own[1:-1]] == walked(tmp_path / "in" / name)
