import random
import re

import pytest

from cinequery.llm import licences

DOCS = "doc_id long, text string, spans string, phrases string, n_words string"


def runs_of(text, templates):
    """(start, past) of the longest runs of words found in some template that ends at each word, where no word prolongs them; by looking for each run."""
    w, t = licences.split(text), [licences.split(x) for _, x in templates]
    inside = lambda part: any(x[i : i + len(part)] == part for x in t for i in range(len(x)))
    longest = [max([n for n in range(1, min(k + 1, 80) + 1) if inside(w[k + 1 - n : k + 1])], default=0) for k in range(len(w))]
    return w, [(k + 1 - n, k + 1) for k, n in enumerate(longest) if n and not (k + 1 < len(w) and longest[k + 1] == n + 1)]


def plain(docs, templates, base, match, gap, covered):
    out = []
    for doc, text in docs:
        w, runs = runs_of(text or "", (*templates, *base))
        places = [(label, i) for label, p in base for i in range(len(w)) if w[i : i + len(licences.split(p))] == licences.split(p)]
        labels, best = {x for x, _ in places}, 1.0 if places else 0.0
        for label, t in templates:
            t = licences.split(t)
            at = [(a, b, e - (b - a), e) for a, b in runs if b - a >= match for e in range(b - a, len(t) + 1) if t[e - (b - a) : e] == w[a:b]]
            at.sort(key=lambda x: (x[1], x[3]))
            chain = []
            for a, b, s, e in at:
                chain.append(max([b - a, *(c + min(b - a, b - b2, e - e2) for c, (a2, b2, s2, e2) in zip(chain, at, strict=False) if a - b2 <= gap and s - e2 <= gap and b2 < b and e2 < e)]))
            share = max(chain, default=0) / len(t)
            best = max(best, share)
            labels |= {label} if share >= covered else set()
        starts = [i for _, i in places]
        out.append((doc, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places})), ",".join(sorted(labels)), round(best, 9)))
    return sorted(out, key=repr)


def got(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    return sorted(((*(r[c] for c in cols), round(r.score, 9)) for r in licences.report(frame, **how).collect()), key=repr)


def altered(rng, text, share):
    w = text.split()
    return " ".join(x for x in w for x in ([x, "zz"] if rng.random() < share else [] if rng.random() < share else [x]))


def notices():
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["the", "of", "a", "copy", "License", "tree", "été", "2.0"]) for _ in range(n))
    docs = [(None, None), (1, ""), (2, " -- "), (3, "MIT license mit License, mit-license"), (3, "general public license apache license"), (4, "mit. The license")]
    docs += [(10 + i, f"{fill(9)} {altered(rng, text, share)} {fill(9)}") for i, (_, text) in enumerate(licences.TEMPLATES) for share in (0, 0.03, 0.2)]
    return docs + [(90, fill(3000)), (91, "Licensed under CC BY-NC 4.0."), (91, "Licensed under CC BY-NC 4.0."), (92, "license under cc"), (93, fill(40) + licences.TEMPLATES[2][1] + fill(40) + licences.TEMPLATES[2][1])]


def test_notices_match_brute_force(spark):
    how = {"match": 4, "gap": 12, "covered": 0.8}
    found = got(spark, notices())
    assert found == plain(notices(), licences.TEMPLATES, licences.BASE, **how)
    assert sum("," not in f[6] and f[6] != "" for f in found) > 20


@pytest.mark.parametrize("how", [{"match": 2, "gap": 3, "covered": 0.7}, {"match": 3, "gap": 0, "covered": 0.5}, {"match": 1, "gap": 1, "covered": 1.0}])
def test_random_words_match_brute_force(spark, how):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    templates = tuple((rng.choice(["x", "y"]), text(rng.randrange(2, 14))) for _ in range(8))
    base = (("p", "a b"), ("q", "b b c"), ("r", "a"))
    docs = [(i, text(rng.randrange(60)).replace("b c", "b, d c" if i % 3 else "b c")) for i in range(40)]
    assert got(spark, docs, templates=templates, base=base, **how) == plain(docs, templates, base, **how)


def test_statistics_equal_search():
    rng = random.Random(1)
    for _ in range(60):
        texts = tuple(("x", " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 6)))
        t = licences.Templates(texts, ())
        names = sorted({w for _, x in texts for w in x.split()})
        line = [rng.choice(names) for _ in range(30)]
        for k, (state, length) in enumerate(t.statistics([names.index(w) for w in line])):
            inside = lambda n, k=k: [(s, m.start() // 2 + n) for s, (_, x) in enumerate(texts) for m in re.finditer("(?=" + " ".join(line[k + 1 - n : k + 1]) + ")", x)] if n <= k + 1 else []
            assert inside(length) and not inside(length + 1)
            assert sorted(t.ends[slice(*t.part[state])]) == sorted(inside(length))


def test_spans_are_placed(spark):
    text = "one two " + licences.TEMPLATES[4][1].replace("compliance", "full compliance") + " three"
    (row,) = licences.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len(licences.split(text))
    assert [(s.label, s.first, s.past) for s in row.spans if s.template == 4] == [("apache", 2, n - 1)]
    assert [s.covered for s in row.spans if s.template == 4] == [n - 4]


def test_clean_texts_get_no_label(spark):
    docs = [(1, "the licence of this work is not a public one, see the file for the rights"), (2, "apache, license; mit of license general public"), (3, "under the terms of a copy")]
    assert [(f[2], f[6]) for f in got(spark, docs)] == [(0, ""), (1, "apache"), (0, "")]


def test_the_query_on_the_whole_table(spark, sf_dir):
    from cinequery.llm.queries import op12_license_scan

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in op12_license_scan(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        w = licences.split(text or "")
        places = [(label, i) for label, p in licences.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = rows[doc]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for x, _ in places})))
        assert (r.first_word, r.last_word) == (min((i for _, i in places), default=None), max((i for _, i in places), default=None))
        if "Licensed under CC BY-NC 4.0." in (text or ""):
            assert r.labels == "cc-by-nc"


def test_long_text_and_empty_table(spark):
    long = "license " * 200_000 + "released under the mit license"
    (row,) = got(spark, [(1, long)])
    assert row[:7] == (1, 200_005, 1, 200_003, 200_003, "mit", "mit")
    assert got(spark, []) == []
    with pytest.raises(ValueError):
        licences.Templates((("x", "..."),))
