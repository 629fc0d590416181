import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_pieces import WORDS, segmentations

from cinequery.llm import lattice
from cinequery.llm.common import remainder
from cinequery.llm.pieces import EDGE, Lattice, Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def ways(pieces, log, text):
    """Every way to cut the text: (log probability, its pieces; None for each byte)."""
    if not text:
        return [(0.0, [])]
    out = []
    for i in range(1, len(text) + 1):
        if text[:i] in pieces.log:
            step = log[text[:i]], [text[:i]]
        elif i == 1:
            n = len(text[0].encode())
            step = n * (log[None] - math.log(256)), [None] * n
        else:
            continue
        out += [(step[0] + p, step[1] + names) for p, names in ways(pieces, log, text[i:])]
    return out


def plain_learning(pieces, counts, ends, rounds, prior):
    first = dict(pieces.log) | {None: pieces.byte + math.log(256), "": pieces.end}
    log, whole = first, sum(math.exp(p) for p in first.values())
    for _ in range(rounds):
        total = Counter({"": ends})
        for word, c in counts.items():
            all_ways = ways(pieces, log, EDGE + word)
            z = math.log(sum(math.exp(p) for p, _ in all_ways))
            for p, names in all_ways:
                for name in names:
                    total[name] += c * math.exp(p - z)
        n = sum(total.values())
        log = {k: math.log((total[k] + prior * math.exp(p)) / (n + prior * whole) * whole) for k, p in first.items()}
    return log


def test_marginals_match_all_segmentations(pieces):
    got = Lattice(pieces).marginals(WORDS)
    for w, g in zip(WORDS, got.tolist(), strict=True):
        assert abs(g - math.log(sum(math.exp(p) for p, _ in segmentations(pieces, EDGE + w)))) < 1e-9
    assert abs(Lattice(pieces).marginals(["ab" * 3000])[0] - pieces.marginal("ab" * 3000) * math.log(10)) < 1e-6


def test_weights_sum_to_one(pieces):
    first = Lattice(pieces)
    later = first.learned(np.arange(len(first.weights), dtype=float), 5.0)
    for x in (first, later):
        assert abs(np.exp(x.weights).sum() - 1) < 1e-9


def test_learned_scores_match_brute_force(spark, pieces):
    import zlib

    rng = random.Random(8)
    vocabulary = ["the", "theory", "tion", "é", "漢字", "mill", "houses", "zqx"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))), "clash", 1) for k in range(40)]
    rows += [(100, None, "", 0), (101, "", "", 0), (7, rows[7][1], "x", 1), (None, "The unseen", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score int")
    learn = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    counts = Counter(w for d, t, *_ in rows if learn(d) for w in (t or "").lower().split())
    log = plain_learning(pieces, counts, sum(learn(d) for d, *_ in rows), 2, lattice.PRIOR)
    of = lambda w: math.log10(sum(math.exp(p) for p, _ in ways(pieces, log, EDGE + w)))
    want = sorted(((d, round(sum(of(w) for w in (t or "").lower().split()) + log[""] / math.log(10), 6)) for d, t, *_ in rows), key=repr)
    for hot in (1, 200_000):
        got = lattice.score(df, remainder("doc_id", 7) != 2, PATH, hot_words=hot, rounds=2).collect()
        assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=repr) == want


def test_learning_raises_the_corpus_likelihood(spark, pieces):
    words = [("theory", 50), ("theories", 9), ("mill", 70), ("abcabc", 4)]
    frame = spark.createDataFrame(words, "word string, c long")
    first = Lattice(pieces)
    likelihood = lambda x: float((x.marginals([w for w, _ in words]) * [c for _, c in words]).sum()) + 40 * x.end
    steps = [likelihood(lattice.learned(frame, first, 40, rounds, prior=1e-6)) for rounds in range(4)]
    assert all(b > a - 1e-6 for a, b in zip(steps, steps[1:], strict=False)) and steps[1] > steps[0]


def test_nothing_to_learn_from_and_empty(spark, pieces):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = lattice.score(df, remainder("doc_id", 7) == 99, PATH, rounds=2).first()
    assert row.train_tokens == 0 and abs(row.score - pieces.marginal("abc") - pieces.end / math.log(10)) < 1e-9
    assert lattice.score(df.limit(0), remainder("doc_id", 7) != 2, PATH, rounds=2).count() == 0
