import numpy as np

from cinequery.llm import language, toxicity
from cinequery.llm.common import read, remainder


def test_threshold_is_best_by_brute_force():
    rng = np.random.default_rng(0)
    p, y = (0.05 + 0.9 * rng.random(60)).round(2), rng.integers(0, 2, 60)
    f1 = lambda t: 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum())
    assert abs(f1(toxicity.threshold(p, y)) - max(f1(t) for t in [*p, 0, 1.1])) < 1e-9


def test_responses_match_windows_taken_one_by_one():
    rng = np.random.default_rng(1)
    net = toxicity.Net(rng.normal(size=(2 * toxicity.BUCKETS, toxicity.HALF)).astype(np.float32), [rng.normal(size=(w, 2 * toxicity.HALF, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], np.zeros(3 * toxicity.FILTERS, np.float32), np.zeros(3 * toxicity.FILTERS, np.float32), 0.0)
    size = np.array([4, 0, 1, 7])
    first = rng.integers(0, toxicity.BUCKETS, 12)
    second = rng.integers(0, toxicity.BUCKETS, 12) + toxicity.BUCKETS
    best, place = net.responses(first, second, size)
    at = 0
    for r, n in enumerate(size):
        x = np.concatenate([net.table[first[at : at + n]], net.table[second[at : at + n]]], 1)
        for i, w in enumerate(net.filters):
            z = np.array([sum((x[t + k] @ w[k] for k in range(len(w)) if t + k < n), np.zeros(toxicity.FILTERS)) for t in range(n)])
            cols = slice(i * toxicity.FILTERS, (i + 1) * toxicity.FILTERS)
            if n:
                assert np.allclose(best[r, cols], z.max(0), atol=1e-4) and (place[r, cols] - at == z.argmax(0)).all()
            else:
                assert (best[r] == 0).all() and (place[r] == -1).all()
        at += n


def test_held_out_quality_and_odd_texts(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held), labels.where(~held), language.fit(docs.where(~held), 3000), 3000)
    got = toxicity.score(docs.where(held), model).join(labels, "doc_id").toPandas()
    true, said = got["toxic"] == 1, got["predicted"] == 1
    f1 = 2 * (true & said).sum() / (true.sum() + said.sum())
    assert f1 > 0.85
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "word " * 30_000, "c")], "doc_id long, text string, score string")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and rows[0].score == rows[2].score


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), language.fit(docs))
    assert toxicity.score(docs, model).first().predicted == 0


def test_empty_tables_and_clashing_columns(spark):
    from cinequery.llm import language, toxicity

    schema = "doc_id long, text string, lang string, toxic string, score string, grams string"
    docs = spark.createDataFrame([(k, f"word{k % 7} calm river" if k % 2 else "vile awful rage", "en", "clash", "clash", "clash") for k in range(60)], schema)
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(3, "another text under the same id", "en", "", "", "")], schema))
    labels = spark.createDataFrame([(k, 1 - k % 2, "clash") for k in range(60)] + [(2, 1, ""), (None, 1, ""), (7, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, language.fit(docs))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id not in (3,))
    assert toxicity.score(docs.limit(0), model).count() == 0
    few = toxicity.fit(docs, labels, language.fit(docs), fit_bytes=600)
    assert toxicity.score(docs, few).count() == docs.count()
    none = toxicity.fit(docs.limit(0), labels, language.fit(docs))
    assert all(r.score < 1e-6 for r in toxicity.score(docs, none).collect())


def test_all_labelled_rows_are_learned_from_in_shards(spark, monkeypatch):
    """A word that one labelled row of many holds is learned, and several shards tell the classes apart as one does."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    docs = spark.createDataFrame([(k, f"calm river w{k} stone" if k % 2 else f"vile awful w{k} rage", "en") for k in range(500)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(500)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "begun", lambda s, t, share, begun=toxicity.begun: seen.append(s) or begun(s, t, share))
    model = toxicity.fit(docs, labels, language.fit(docs))
    learned = sum(r.n for r in docs.selectExpr("pmod(xxhash64('aside', doc_id), 4294967296) >= 1073741824 AS n").selectExpr("CAST(n AS INT) AS n").collect())
    assert seen[0][: toxicity.BUCKETS].max() >= learned // 2 - 40 and seen[0][: toxicity.BUCKETS].sum() >= 3.9 * learned
    assert all(r.predicted == 1 - r.doc_id % 2 for r in toxicity.score(docs, model).collect())


def test_defaults_bound_no_rows():
    import inspect

    assert inspect.signature(toxicity.fit).parameters["fit_rows"].default is None and inspect.signature(toxicity.fit).parameters["fit_bytes"].default is None
    assert inspect.signature(language.fit).parameters["fit_rows"].default is None
