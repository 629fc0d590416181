import numpy as np
import pytest

from cinequery.llm import language
from cinequery.llm.common import read, remainder

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
EN, DE, RU = "the house is near the river and the mill", "das Haus ist nahe an dem Fluss und der Mühle", "дом стоит у реки и мельницы"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(3 * i + k, f"{t} {i}", lang, "", "") for i in range(20) for k, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")])]
    return language.fit(spark.createDataFrame(rows, SCHEMA))


def test_spans_and_defined_results(spark, model):
    texts = [None, "", "123 !?", EN, DE.upper(), RU, f"{EN}. {DE}", "ελληνικά", "x " * 20_000]
    got = language.predict(spark.createDataFrame([(i, t, "en", "", "") for i, t in enumerate(texts)], SCHEMA), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:6]] == ["und", "und", "und", "en", "de", "ru"]
    assert [r.score for r in got[:4]] == [0, 0, 0, 1]
    assert [(s.lang, s.first, s.past) for s in got[6].spans] == [("en", 0, 9), ("de", 9, 19)]
    assert all(0 <= r.score <= 1 for r in got) and got[7].lang_pred in ("en", "de", "ru")


def brute(emit):
    """Best path by dynamic programming over single words."""
    best, back = emit[0].copy(), []
    for e in emit[1:]:
        step = [[best[a] - (0 if a == b else language.SWITCH) for a in range(len(e))] for b in range(len(e))]
        back.append([max(range(len(e)), key=lambda a: (s[a], a == b)) for b, s in enumerate(step)])
        best = np.array([max(s) for s in step]) + e
    return best.max()


def test_viterbi_is_optimal(model):
    text = f"{EN} {DE} haus river {RU} mill und the " * 3
    words = language.split([text, EN], model.table)
    emit, label = model.scores(words)[words.which], model.label(words, 2)
    for r in (0, 1):
        e, path = emit[words.row == r], label[words.row == r]
        total = e[np.arange(len(e)), path].sum() - language.SWITCH * (path[1:] != path[:-1]).sum()
        assert abs(total - brute(e)) < 1e-6


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    held = remainder("doc_id", 4) == 2
    got = language.predict(docs, language.fit(docs.where(~held))).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_nothing_learned_and_filter(spark, model):
    none = language.fit(spark.createDataFrame([], SCHEMA))
    rows = spark.createDataFrame([(1, EN, None, "", ""), (2, "42", "en", "", ""), (None, DE, "", None, None)], SCHEMA)
    assert {r.lang_pred for r in language.predict(rows, none).collect()} == {"und"}
    kept = language.recognised(rows, model)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {1, None}


def test_repeated_rows_null_ids_and_empty_tables(spark, model):
    rows = [(1, EN, None, "", ""), (1, EN, None, "", ""), (None, DE, "x", "", ""), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for spans in (True, False):
        got = language.predict(frame, model, spans=spans)
        assert got.columns == ["doc_id", "lang_pred", "score"] + ["spans"] * spans
        assert sorted(((r.doc_id, r.lang_pred) for r in got.collect()), key=repr) == [(1, "en"), (1, "en"), (None, "de"), (None, "und")]
        assert language.predict(frame.limit(0), model, spans=spans).count() == 0
    assert language.recognised(frame.limit(0), model).count() == 0 and language.fit(frame.limit(0)).languages == []


def test_recognised_sets_the_language_and_drops_strange_scripts(spark, model):
    rows = [(1, EN, "xx", "", ""), (2, "ελληνικά γράμματα μόνο", "en", "", ""), (3, f"{DE} ελληνικά", None, "", ""), (4, RU, "de", "", "")]
    got = language.recognised(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert {r.doc_id: r.lang for r in got} == {1: "en", 3: "de", 4: "ru"}


def test_blocks_do_not_change_labels(spark, model, monkeypatch):
    import random

    rng = random.Random(9)
    words = f"{EN} {DE} {RU}".split()
    frame = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 300))), None, None, None) for k in range(60)], SCHEMA).coalesce(1)
    whole = sorted(map(str, language.predict(frame, model).collect()))
    batch = frame.select("doc_id", "text").toArrow().to_batches()
    monkeypatch.setattr(language, "BLOCK_BYTES", 500)
    parts = [r for b in language._predict(iter(batch), model, True) for r in b.to_pylist()]
    for r in parts:
        r["spans"] = [tuple(s.values()) for s in r["spans"]]
    want = [(r.doc_id, r.lang_pred, r.score, [tuple(s) for s in r.spans]) for r in language.predict(frame, model).collect()]
    assert sorted(tuple(r.values()) for r in parts) == sorted(want) and whole
