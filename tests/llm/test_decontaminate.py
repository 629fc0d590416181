import hashlib
import random
import re

import pytest

from cinequery.llm import decontaminate

DOCS = "doc_id long, text string, items string, n_words string"


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, bench):
    windows = {}
    for item, text in bench:
        w = split(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w = split(text)
        hit, items = set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items |= names
        names = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((doc, len(w), len(hit), len([x for x in items if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "É", "naïve", "x1", "9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(1, text(40)), (2, text(12)), (10, "b c, a!"), (11, None), (12, "..."), (13, text(10))]
    bench.append((14, bench[1][1]))
    docs = [(0, None), (1, ""), (2, "-- "), (3, "b C-a"), (3, "B c A b c a"), (None, bench[0][1]), (5, text(5000)), (6, bench[1][1].upper() * 3)]
    docs += [(10 + i, text(20) + " " + " ".join(split(bench[0][1])[i : i + 12]) + "; " + text(20)) for i in range(20)]
    return docs, bench


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 200}, {"block_bytes": 150}])
def test_report_matches_brute_force(spark, how):
    docs, bench = corpus()
    docs += [docs[5], docs[-1], docs[-1]]
    frame = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], DOCS)
    got = decontaminate.report(frame, spark.createDataFrame(bench, "item_id long, text string"), **how)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == plain(docs, bench)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 150}])
def test_clean_removes_exactly_the_contaminated_rows(spark, how):
    docs, bench = corpus()
    frame = spark.createDataFrame([(d, t, "clash", "clash") for d, t in docs], DOCS)
    kept = decontaminate.clean(frame, spark.createDataFrame(bench, "item_id long, text string"), **how)
    assert kept.columns == frame.columns
    want = [t for d, t in docs if not plain([(d, t)], bench)[0][5]]
    assert sorted((r.text for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_longest_match_goes_past_the_window(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + " ".join(item.split()[4:29]) + " after")], "doc_id long, text string")
    row = decontaminate.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row.longest, [tuple(h) for h in row.hits], row["items"]) == (25, [(1, 26)], ["7"])


def test_longest_match_of_items_that_share_their_begin(spark):
    both, a, b = ([f"{k}{i}" for i in range(30)] for k in "qab")
    items = [(1, " ".join(both + a)), (2, " ".join(both + b))]
    docs = [(1, "x " + " ".join((both + a)[:50]) + " y"), (2, "x " + " ".join((both + b)[:50]) + " y")]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.longest for r in got} == {1: 50, 2: 50}


@pytest.mark.parametrize("how", [{}, {"block_bytes": 150}])
def test_longest_matches_brute_force(spark, how):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    bench = [(k, text(rng.choice([6, 40, 80]))) for k in range(12)]
    bench += [(20, bench[0][1]), (21, bench[1][1] + " b " + bench[2][1])]
    docs = [(k, text(60) + " " + rng.choice(bench)[1] + " c " + " ".join(rng.choice(bench)[1].split()[3:]) + text(9)) for k in range(30)]

    def longest(doc):
        best, w = 0, split(doc)
        for _, item in bench:
            v = split(item)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    best = max(best, n if n >= min(10, len(v)) else 0)
        return best

    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), **how).collect()
    assert {r.doc_id: r.longest for r in got} == {k: longest(t) for k, t in docs}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b", "", "")], DOCS)
    assert decontaminate.report(some, bench).first().n_words == 2 and decontaminate.clean(some, bench).count() == 1
