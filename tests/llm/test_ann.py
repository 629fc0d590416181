import numpy as np
from pyspark.sql import functions as F

from cinequery.llm import ann
from cinequery.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def exact(rows, queries, top=20):
    good = {i: np.array(v, np.float64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            s = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))
            out[q] = [(i, -x) for x, i in s[:top]]
    return out


def test_finds_nearly_all_on_the_test_table(spark):
    table = read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    want = exact(rows, [i for i, _ in rows if i % 20 == 0])
    got = ann.search(table, table.where(F.col("vec_id") % 20 == 0), list_size=128).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(i in {v for v, _ in found[q].values()} for q, best in want.items() for i, _ in best)
    assert hits >= 0.95 * sum(map(len, want.values())) and set(found) == set(want)
    by_id = dict(rows)
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, 21))
        order = [(-s, v) for _, (v, s) in sorted(ranks.items())]
        assert order == sorted(order) and all(abs(s - np.dot(by_id[q], by_id[v])) < 1e-12 for v, s in ranks.values())


def test_odd_rows_ties_and_varied_norms(spark):
    rng = np.random.default_rng(0)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rng.normal(size=8) * rng.uniform(0.1, 3))) for i in range(400)]
    hot = f32(5 * rng.normal(size=8))
    rows += [(1000 + i, hot) for i in range(300)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, [float("inf")] + [0.0] * 7), (2100, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    want = exact([r for r in rows if r[0] < 2000], [i for i, _ in rows if i % 20 == 0])
    got = ann.search(df, df.where(F.col("vec_id") % 20 == 0), list_size=64).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {v for _, v in found[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [v for _, v in sorted(found[1200])] == [1000 + i for i in range(20)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [0.5, 0.5], 1, ""), (2, [0.5, 0.5], 1, "")], SCHEMA)
    got = ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty, empty).count() == 0


def test_graph_finds_the_nearest_centres():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 16))
    c = ann.Centroids.build(points, 1.0)
    x = rng.normal(size=(64, 16))
    ids, d = c.search(x, 16)
    assert (ids[:, 0] == ann._squares(x, points).argmin(1)).mean() > 0.95 and (np.diff(d, axis=1) >= 0).all()


def test_short_lists_still_give_all_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 1, "") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(df, df.where("vec_id % 20 = 0"), list_size=4).groupBy("query_id").count().collect()
    assert len(got) == 10 and {r["count"] for r in got} == {20}


def test_a_large_group_of_equal_vectors_of_greatest_norm(spark):
    rng = np.random.default_rng(5)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rng.normal(size=8))) for i in range(400)]
    hot = [4.0] * 4 + [0.0] * 4  # of norm 8, so the lifted coordinate is 0 and means are exact
    rows += [(1000 + i, hot) for i in range(600)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    want = exact(rows, [i for i, _ in rows if i % 20 == 0])
    found = {}
    for r in ann.search(df, df.where(F.col("vec_id") % 20 == 0), list_size=64).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == set(want) and all(len(f) == 20 for f in found.values())
    hits = sum(len({i for i, _ in want[q]} & {v for _, v in found[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [v for _, v in sorted(found[1200])] == [1000 + i for i in range(20)]


def test_a_table_of_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 2.0], 1, "") for i in range(1000)], SCHEMA)
    got = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    assert len(got) == 200 and {r.score for r in got} == {9.0}
    assert sorted(r.vec_id for r in got if r.query_id == 0) == list(range(1, 21))


def test_a_query_at_a_centre_reaches_other_lists():
    points = np.array([[3.0, 0.0, 0.0], [2.0, 1.0, 2.0], [-3.0, 0.0, 0.0]])
    c = ann.Centroids.build(ann.apart(np.concatenate([points, points[:1]]), 3.0), 3.0)
    assert len(c.points) == 3
    d = np.sort(np.sqrt(ann._squares(np.array([[3.0, 0.0, 0.0]]), c.points)))
    assert d[0, 0] == 0 and c.base(d)[0, 0] == d[0, 1] and ann._ratios(d).size == 0
    assert ann._ratios(np.array([[0.0, 0.0, 2.0], [1.0, 2.0, 4.0]])).tolist() == [1.0, 2.0, 4.0]


def test_recall_is_measured_against_all_vectors(spark):
    table = read(spark, "/root/testdata/sf0.1", "embeddings")
    found = ann.search(table, table.where(F.col("vec_id") % 20 == 0))
    exact_found = found.where("rank <= 20").count()
    measured = ann.recall(table, found, queries=1000)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    want = exact(rows, [i for i, _ in rows if i % 20 == 0])
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(i in got.get(q, ()) for q, best in want.items() for i, _ in best)
    assert abs(measured - hits / sum(map(len, want.values()))) < 1e-9 and measured >= 0.9 and exact_found == 20 * len(want)
    assert ann.recall(table, found.limit(0)) == 1.0


def test_more_equal_vectors_than_ranks_and_repeated_rows(spark):
    rng = np.random.default_rng(8)
    hot = [1.0, 1.0, 0.0, 0.0]
    rows = [(i, hot, 1, "") for i in range(100)] + [(i, hot, 1, "") for i in range(0, 100, 3)] + [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=4) * 0.1], 1, "") for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), list_size=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 100, 20):
        assert [v for _, v in sorted(got[q])] == [i for i in range(21) if i != q][:20]
