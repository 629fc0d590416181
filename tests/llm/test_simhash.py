import random
import re
from itertools import combinations

import xxhash

from cinequery.llm import simhash

SCHEMA = "doc_id long, text string, lang string, print string"


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def corpus():
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "ΣΑ", "a b"]
    texts = [None, "", " \t\n", "One", "one", "one two", "x" * 50_000]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" \n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
        texts.append(" ".join(base))
    return texts


def test_groups_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()}
    prints = [plain_print(t) for t in texts]
    want = plain_groups(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in enumerate(prints)}


def test_links_find_every_near_pair_in_a_crowd(spark, monkeypatch):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "CROWD", 4)
    rows = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_one_each_and_odd_inputs(spark):
    rows = [(5, "a b c d", "en", "x"), (3, "A b C d", "en", "x"), (3, "a b c d", "en", "x"), (None, "a b c d", None, None), (9, None, None, None), (8, "other words here now", "de", "x")]
    kept = simhash.one_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "print"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, None, 9, 8] if plain_print("a b c d") else [], key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(empty).count() == 0 and simhash.one_each(empty).count() == 0


def test_one_each_goes_by_row_where_ids_repeat(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    first = text()
    rows = [(3, first, "en", "x")]
    for i in range(10, 16):
        own = [text(), text()]
        rows += [(i, first, "en", "x"), (i, own[0], "en", "x"), (i, own[1], "de", "y"), (i, own[1], "de", "y"), (i + 10, own[0], "en", "x")]
    groups = plain_groups([plain_print(t) for _, t, *_ in rows])
    want = sorted({g: row for g, row in zip(reversed(groups), reversed(rows), strict=True)}.values())
    kept = simhash.one_each(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert len(want) == 13 and sorted(map(tuple, kept.collect())) == want


def test_classes_equal_those_of_all_pairs_in_crowds(spark, monkeypatch):
    rng = random.Random(21)
    prints = set()
    for spread in (1, 2, 3):
        centre = rng.getrandbits(64)
        for _ in range(80):
            p = centre
            for b in rng.sample(range(64), spread):
                p ^= 1 << b
            prints.add(p)
    chain = rng.getrandbits(64)
    for _ in range(60):
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
        prints.add(chain)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    groups = plain_groups(prints)
    least = {}
    for s, g in zip(signed, groups, strict=True):
        least[g] = min(least.get(g, s), s)
    for crowd in (4, 64):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        rows = simhash.classes(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
        found = {r.node: r.component for r in rows}
        assert [found.get(s, s) for s in signed] == [least[g] for g in groups] and len(found) == len(rows) > 200
