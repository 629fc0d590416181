import math
import random
from collections import Counter

import public_tokenizers
import pytest

from cinequery.llm import lattice
from cinequery.llm.common import remainder
from cinequery.llm.pieces import EDGE, Pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def segmentations(pieces, text):
    """Every way to cut the text: (log probability, pieces)."""
    if not text:
        return [(0.0, 0)]
    out = []
    for i in range(1, len(text) + 1):
        p = pieces.log.get(text[:i])
        if p is None and i == 1:
            p = pieces.spelled(text[0])
        if p is not None:
            out += [(p + q, n + 1) for q, n in segmentations(pieces, text[i:])]
    return out


WORDS = ["a", "the", "theory", "Über", "漢字", "😀x", "tionon", "thether", "there", "ththth", "▁", "é", "x9."]


def test_both_programs_match_all_segmentations(pieces):
    best = pieces.counts(WORDS)
    for w in WORDS:
        ways = segmentations(pieces, EDGE + w)
        top = max(p for p, _ in ways)
        assert abs(best[w][1] - top) < 1e-9 and best[w][0] == min(n for p, n in ways if p > top - 1e-12)
        assert abs(pieces.marginal(w) - math.log10(sum(math.exp(p) for p, _ in ways))) < 1e-9


def test_token_counts(spark, pieces):
    rows = [(1, "the theory\tthe", "x"), (1, "the theory\tthe", "x"), (None, None, None), (2, " \n", ""), (3, "x" * 20_000, "")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    c = pieces.counts(["the", "theory"])
    assert [(r.doc_id, r.n_words, r.n_tokens) for r in got[:4]] == [(1, 3, 2 * c["the"][0] + c["theory"][0])] * 2 + [(None, 0, 0), (2, 0, 0)]
    assert got[4].n_words == 1 and got[4].n_tokens > 1000
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_signs_without_a_piece_count_as_their_bytes(spark, pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = ["漢", "漢漢", "漢字", "ሰላም", "😀", "𝒳", "🫠漢", "the"]
    assert "漢" not in pieces.log and len(model.encode("漢")) == 4
    rows = [(k, w) for k, w in enumerate(words)] + [(100, " ".join(words))]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    want = {k: len(model.encode(w)) for k, w in enumerate(words)}
    assert got == want | {100: sum(want.values())}


def test_best_segmentations_with_bytes_apart(pieces):
    def ways(text):
        if not text:
            return [(0.0, 0)]
        out = []
        for i in range(1, len(text) + 1):
            p, n = pieces.log.get(text[:i]), 1
            if p is None and i == 1:
                p, n = pieces.spelled(text[0]), 1 if text[0] == EDGE else len(text[0].encode())
            if p is not None:
                out += [(p + q, n + m) for q, m in ways(text[i:])]
        return out

    best = pieces.counts(WORDS, bytes_apart=True)
    for w in WORDS:
        all_ways = ways(EDGE + w)
        top = max(p for p, _ in all_ways)
        assert abs(best[w][1] - top) < 1e-9 and best[w][0] == min(n for p, n in all_ways if p > top - 1e-12)


@pytest.mark.parametrize("hot", [1, 20, 200_000])
def test_lattice_scores_match_brute_force(spark, pieces, hot):
    import zlib

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "the", "É", "é", "house", "tion%d" % rng.randint(0, 40)]) for _ in range(rng.randint(0, 30))), "x", 1) for i in range(80)]
    rows += [(100, None, "", 0), (101, "", "", 0), (7, rows[7][1], "x", 1), (None, "the end", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score int")
    learn = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()]
    counts = Counter(w for d, t, *_ in rows if learn(d) for w in low(t))
    ends = sum(learn(d) for d, *_ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    unseen = v / (n + v)
    got = lattice.score(df, remainder("doc_id", 7) != 2, PATH, hot_words=hot).collect()
    want = []
    for d, t, *_ in rows:
        words = low(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        score = sum(math.log10(unseen * 10 ** pieces.marginal(w) + (1 - unseen) * counts[w] / n) for w in words) + math.log10(unseen * math.exp(pieces.end) + (1 - unseen) * ends / n)
        want.append((d, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, round(base, 6), round(score, 6)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr) == sorted(want, key=repr)


def test_lattice_without_learning(spark, pieces):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = lattice.score(df, remainder("doc_id", 7) == 99, PATH).first()
    assert row.train_tokens == 0 and abs(row.score - pieces.marginal("abc") - pieces.end / math.log(10)) < 1e-9
    assert lattice.score(df.limit(0), remainder("doc_id", 7) != 2, PATH).count() == 0
