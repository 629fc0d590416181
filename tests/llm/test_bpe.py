import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from cinequery.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(1)
    signs = "abcdeinorst" * 4 + "ABCÉßİΣςñ漢字한글зд 0123456789''’.,!?-–_@#%&*()\t\n \u0085 é😀👍🏽\x1c\x1f"
    out = [None, "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "The QUICK brown fox's can't we'll I'M", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> <|EndOfText|>", "x" * 30_000, "ΑΣ ΟΔΟΣ", "</w> w>", "ﬁ ① Ⅷ ½ ٣"]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    vowels = ["the", "ing", "tion", "er", "on", "an", "re", "at", "ou", "é", "ä"]
    out += [" ".join("".join(rng.choice(vowels) for _ in range(rng.randint(1, 6))) for _ in range(60)) for _ in range(60)]
    return out


def test_equals_the_library(spark, library):
    rows = [(i % 300, t, "clash", 1) for i, t in enumerate(texts())]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int"), PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, list(g.ids), g.decoded) == w


def test_report_hashes_and_empty_table(spark, library):
    schema = "doc_id long, text string"
    row = bpe.report(spark.createDataFrame([(None, "Hello, World")], schema), PATH).first()
    ids = library.encode("Hello, World", add_special_tokens=False).ids
    assert row.doc_id is None and row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.report(spark.createDataFrame([], schema), PATH).count() == 0


def test_memory_is_bounded():
    walker = bpe.Walker(bpe.WordBPE(PATH), limit=5)
    first = walker.encode(["one two three four five six seven"])[0].tolist()
    assert walker.encode(["one two three four five six seven"])[0].tolist() == first and len(walker.number) <= 7
