import random
import re
from collections import Counter

import numpy as np
import pytest

from cinequery.llm import collocation

DOCS = "doc_id long, text string, lang string, n string, phrase string"


def plain(docs, least, longest, percent=100, top=2000):
    """The same, from all n-grams in memory and all longer phrases."""
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    within = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    rows = []
    for (lang, p), a in often.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= percent * a and within(p, q) for (x, q), b in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out, ranks = [], Counter()
    for lang, score, a, p, left, right, all_ in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], p.decode(), -a, left, right, all_, -score))
    return out


def found(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, x, "clash", "clash") for d, t, x in docs], DOCS)
    return sorted(tuple(r) for r in collocation.collocations(frame, **how).collect())


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "É", "éa", "naïve", "x-1", "漢字", "9", "(c)", "a b"]
    line = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\x0c"]) for _ in range(k))
    docs = [(i, line(rng.randrange(1, 60)), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    docs += [(None, "in the year of the fox. In the year of the fox", "en")] * 5
    docs += [(100, None, "en"), (101, "", None), (102, " \t.,;", "fr"), (103, "one", "fr"), (104, "go go go go go go go", "en"), (105, line(20000), "de")]
    return docs


@pytest.mark.parametrize("how", [{"least": 2, "longest": 5}, {"least": 5, "longest": 3, "top": 7}, {"least": 3, "longest": 2}, {"least": 3, "longest": 5, "percent": 60}, {"least": 1, "longest": 4}])
def test_equals_all_ngrams_in_memory(spark, how):
    docs = corpus()
    if how["least"] < 3:
        docs = [d for d in docs if d[0] != 105]  # the plain version looks at all pairs of phrases
    assert found(spark, docs, **how) == sorted(plain(docs, **how)) != []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    docs = corpus(5)[:-1]
    want = sorted(plain(docs, 3, 5))
    monkeypatch.setattr(collocation, "BITS_EACH", 0)
    monkeypatch.setattr(collocation, "PAGE", 1 << 15)
    assert found(spark, docs, least=3, longest=5) == want
    everything = collocation.Filter(2, np.full(4096, 255, np.uint8))
    assert everything.holds(np.arange(5, dtype=np.uint64)).all()


def test_large_products_stay_exact(spark):
    rows = [("en", 0, None, 3 * 10**15), ("en", 1, "a", 10**13), ("en", 1, "b", 10**13 + 1), ("en", 2, "a b", 10**13 - 1)]
    row = collocation.scored(spark.createDataFrame(rows, collocation.SCHEMA)).first()
    assert row.score == 1000 * (10**13 - 1) * (3 * 10**15) // (10**13 * (10**13 + 1))


def test_equal_scores_take_the_first_cut_and_ties_go_by_bytes(spark):
    docs = [(i, "a b c", "en") for i in range(4)] + [(i, "z é", "en") for i in range(4)] + [(i, "z y", "en") for i in range(4)]
    rows = found(spark, docs, least=4, longest=3)
    assert rows == sorted(plain(docs, 4, 3)) and [r[2] for r in sorted(rows, key=lambda r: r[1])] == ["a b c", "z y", "z é"]
    assert (rows[0][4], rows[0][5]) == (4, 4)


def test_a_hot_language_and_repeated_rows(spark):
    docs = [(7, "same words here. same words", "en")] * 900 + [(i, f"w{i % 5} v{i % 3} u", "de") for i in range(90)]
    assert found(spark, docs, least=10, longest=4, top=3) == sorted(plain(docs, 10, 4, top=3))


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, None)]) == []
