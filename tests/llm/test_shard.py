import random
import zlib

from cinequery.llm import shard

SCHEMA = "doc_id long, text string, lang string, source string, shard string, slot string"


def rows():
    rng = random.Random(3)
    out = [(i, "word " * rng.randint(1, 400), rng.choice(["en", "de", None]), f"s{rng.randint(0, 9)}", "x", "y") for i in range(1500)]
    out += [(5000 + i, "hot copy " * 40, "en", f"s{i % 7}", "x", "y") for i in range(900)]  # over a third of all rows
    return out + [(9000, None, None, None, None, None), (9001, "", "en", "s0", "", ""), (None, "é" * 300, "fr", "s1", "", ""), (9002, "é" * 300, "fr", "s2", "", ""), (9002, "é" * 300, "fr", "s2", "", "")]


def test_bytes_are_near_equal_slots_gapless_and_texts_together(spark):
    data = rows()
    got = shard.shard(spark.createDataFrame(data, SCHEMA), shards=8).collect()
    text = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, len(text(t)) + 1, zlib.crc32(text(t))) for d, t, *_ in data), key=repr)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    bytes_, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(bytes_) < 1.06 * sum(bytes_) / 8 and min(bytes_) > 0.94 * sum(bytes_) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert len({r.shard for r in got if r.doc_id in (None, 9002)}) == 1


def test_target_bytes_and_small_inputs(spark):
    data = [(i, "x" * 99, "en", "s", "", "") for i in range(64)]
    got = shard.shard(spark.createDataFrame(data, SCHEMA), target_bytes=1600).collect()
    assert {r.shard for r in got} == set(range(4))
    assert shard.shard(spark.createDataFrame([], SCHEMA), shards=8).count() == 0
    one = shard.shard(spark.createDataFrame(data[:1], SCHEMA), shards=8).collect()
    assert [(r.slot, 0 <= r.shard < 8) for r in one] == [(0, True)]
    only = shard.shard(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), shards=2).collect()
    assert len({r.shard for r in only}) == 2


def plain_tree(items, shards, first=0):
    """Shard of each (key, place, bytes): halves at the weighted median, the group on it to the nearer side."""
    if shards == 1 or not items:
        return {k: first for k, _, _ in items}
    items = sorted(items, key=lambda x: x[1])
    left = (shards + 1) // 2
    want, total, at = left / shards * sum(b for *_, b in items), 0, 0
    for at, (_, _, size) in enumerate(items):
        if total + size >= want or at == len(items) - 1:
            break
        total += size
    upto = total + items[at][2]
    cut = at + 1 if upto - want <= want - total else at
    return plain_tree(items[:cut], left, first) | plain_tree(items[cut:], shards - left, first + left)


def test_equals_a_plain_tree_of_true_medians(spark):
    import math

    sizes = [round(1.02**k * 40) + k for k in range(300)]
    docs = [(k, "x" * n, "en", "s", "", "") for k, n in enumerate(sizes)]
    random.Random(1).shuffle(docs)
    for shards in (2, 5, 8):
        want = plain_tree([(d, math.log2(len(t) + 1), len(t) + 1) for d, t, *_ in docs], shards)
        got = shard.shard(spark.createDataFrame(docs, SCHEMA), shards=shards).collect()
        assert {r.doc_id: r.shard for r in got} == want
