"""Percentiles, carried values and lists of groups, also of one that holds most rows, against plain versions."""

import math
import random

import pytest

from cinequery.operators import klv, stats


def rank(values, a, b):
    s = sorted(values, key=lambda v: (isinstance(v, float) and math.isnan(v), v))
    return s[max(1, -(-a * len(s) // b)) - 1] if s else None


@pytest.mark.parametrize("bins", [16, 4096])
def test_percentiles_equal_sorted_values(spark, monkeypatch, bins):
    monkeypatch.setattr(stats, "BINS", bins)
    rng = random.Random(bins)
    groups = {"hot": [rng.choice([rng.random(), rng.gauss(0, 1e6), 7.0, 10.0 ** rng.randint(-9, 9)]) for _ in range(3000)], "one": [4.0], "same": [2.5] * 40, "odd": [math.inf, -math.inf, math.nan, 0.0, -0.5, 3.0, math.inf], "none": [], None: [1.0, 2.0, 9.0, 5.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("hot", None)]
    shares = {"low": (1, 100), "p50": (1, 2), "p95": (19, 20), "top": (1, 1)}
    got = {r.key: r for r in stats.percentiles(spark.createDataFrame(rows, "key string, v double"), "key", "v", shares).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, (a, b) in shares.items():
            want = rank(vs, a, b)
            assert got[k][name] == want or (want is not None and math.isnan(want) and math.isnan(got[k][name])), (k, name)


def test_percentiles_of_whole_numbers_and_no_rows(spark):
    rows = [("a", v) for v in [5, 1, 9, 9, 2]]
    assert tuple(stats.percentiles(spark.createDataFrame(rows, "key string, v long"), "key", "v").first()) == ("a", 5, 9)
    assert stats.percentiles(spark.createDataFrame([], "key string, v long"), "key", "v").count() == 0


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_carried_values_equal_a_walk(spark, bucket):
    rng = random.Random(bucket)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), at, rng.randrange(2), rng.choice([None, None, None, rng.randrange(9)])) for at in range(-20, 300)]
    got = {(r.f, r.at, r.side): r.found for r in stats.carried(spark.createDataFrame(rows, "f string, at long, side int, v long"), ["f"], ["at", "side"], "v", "found", bucket).collect()}
    last, want = {}, {}
    for f, at, side, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[f] = v if v is not None else last.get(f)
        want[f, at, side] = last[f]
    assert got == want


def test_lists_hold_no_group_whole(spark):
    rows = [("hot", i * 3, i) for i in range(1000)] + [("b", i, -i) for i in range(5)]
    got = sorted(tuple(r) for r in stats.listed(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", 100, 64).collect())
    assert got == sorted([("hot", c, list(range(c * 64, min(1000, c * 64 + 64)))) for c in range(16)] + [("b", 0, [0, -1, -2, -3, -4])])


def test_sets_of_unknown_type_are_passed_over():
    broken = bytes.fromhex("060e2b34025301010d01010101017f00") + b"\x05\xff\xff\xff\xff\xff"
    known = bytes.fromhex("060e2b34025301010d01010101013b00") + b"\x05\xff\xff\xff\xff\xff"
    errors = [(row[0], row[6]) for row in klv.contents(klv.Bytes(broken + known))]
    assert errors == [(0, None), (len(broken), "set items don't fit")]


def test_a_track_is_collected_whole(spark, tmp_path):
    """One row a track, however many values it has."""
    from cinequery.plans import container_queries as Q

    many = 3 * Q.LISTED + 5
    rows = spark.range(many).selectExpr("id AS event_id", "'a' AS event_type", "CAST(id % 2 * 16 AS BIGINT) AS user_id", "CAST(id AS DOUBLE) / 100 AS value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.number: (r.n, r.lengths) for r in Q.group_collect(spark, str(tmp_path)).collect()}
    want = [str(r.v) for r in rows.orderBy("event_id").selectExpr("CAST(floor(abs(value) * 100) AS BIGINT) AS v").collect()]
    assert got == {0: (many, ",".join(want))}
