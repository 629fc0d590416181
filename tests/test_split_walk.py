"""Files walked in parts equal files walked in order, also when their index lies or their bytes are changed."""

import random

from cinequery.operators import klv, split_walk
from cinequery.sources import media

VIDEO, AUDIO = (bytes.fromhex("060e2b34010201010d010301" + tail) for tail in ("15010501", "16010101"))


def triplet(key, value):
    return key + b"\x83" + len(value).to_bytes(3, "big") + value


def pack(kind, body_sid):
    value = bytearray(88)
    value[60:64] = body_sid.to_bytes(4, "big")
    return triplet(bytes.fromhex(klv.PARTITION_PREFIX + f"{kind:02x}0400"), bytes(value))


def container(rng, partitions=5, lie=None):
    data, places = b"", []
    for p in range(partitions):
        places.append((p % 3, len(data)))
        data += pack(2 if p == 0 else 4 if p == partitions - 1 else 3, p % 3)
        for _ in range(rng.randint(0, 6)):
            data += triplet(rng.choice([VIDEO, AUDIO]), rng.randbytes(rng.randint(0, 900)))
    if lie == "inside":
        places[2] = (0, places[2][1] + 130)
    if lie == "omit":
        del places[2]
    if lie == "first":
        del places[0]
    rip = b"".join(sid.to_bytes(4, "big") + at.to_bytes(8, "big") for sid, at in places)
    total = 20 + len(rip) + 4
    return data + triplet(bytes.fromhex(klv.RANDOM_INDEX_KEY), rip + (total + (lie == "length")).to_bytes(4, "big"))


def plain(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else tuple(map(tuple, x)) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


def test_parts_equal_the_walk(spark):
    rng = random.Random(6)
    files = [container(rng, rng.randint(1, 7)) for _ in range(12)] + [container(rng, 5, lie) for lie in ("inside", "omit", "first", "length")] + [b"", None, b"\0" * 30]
    # A partition's key within a value, which a lying index points to.
    inner = triplet(VIDEO, pack(3, 7) * 2)
    head, foot = pack(2, 0), pack(4, 0)
    rip = b"".join((0).to_bytes(4, "big") + at.to_bytes(8, "big") for at in (0, len(head) + 20, len(head) + len(inner)))
    files.append(head + inner + foot + triplet(bytes.fromhex(klv.RANDOM_INDEX_KEY), rip + (24 + len(rip)).to_bytes(4, "big")))
    for _ in range(20):
        data = bytearray(container(rng))
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data[: rng.randint(len(data) // 2, len(data))] if rng.random() < 0.3 else data))
    frame = spark.createDataFrame(list(enumerate(files)), "file int, payload binary")
    want = klv.scan(frame, with_contents=True)
    got = split_walk.scan(split_walk.parts(frame))
    assert got.columns == want.columns
    assert plain(got.collect()) == plain(want.collect())
    assert split_walk.parts(frame).groupBy("file").count().where("count > 1").count() > 10


def test_parts_of_paths_read_little(spark, tmp_path):
    rng = random.Random(2)
    data = b"".join([pack(2, 0), *(triplet(VIDEO, bytes(200_000)) for _ in range(5))])
    at = len(data)
    data += pack(3, 1) + b"".join(triplet(AUDIO, bytes(90_000)) for _ in range(5))
    rip = b"".join(s.to_bytes(4, "big") + o.to_bytes(8, "big") for s, o in ((0, 0), (1, at)))
    data += triplet(bytes.fromhex(klv.RANDOM_INDEX_KEY), rip + (24 + len(rip)).to_bytes(4, "big"))
    for name in ("a.mxf", "b.mxf"):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "c.mxf").write_bytes(container(rng, 4, "inside"))
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.mxf", "b.mxf", "c.mxf")], "file string")
    media.register(spark)
    want = spark.read.format("klv").options(contents="true").load(str(tmp_path))
    assert plain(split_walk.scan(split_walk.path_parts(listed)).collect()) == plain(want.collect())
    source = media.File(str(tmp_path / "a.mxf"))
    assert split_walk.starts(source) == [0, at] and source.bytes_read < len(data) / 20
