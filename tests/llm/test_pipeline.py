import hashlib
import random
import re

import public_tokenizers
import pytest
from test_decontaminate import plain as plain_hits
from test_pii import plain as plain_spans
from test_simhash import plain_groups, plain_print

tokenizers = pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = ["email", "ip", "card", "phone"]


def corpus():
    rng = random.Random(12)
    english = "river house garden winter letter evening market teacher window bridge mountain summer doctor village paper".split()
    german = "straße fluss garten abend brücke lehrer fenster dorf arzt sommer winter brief markt berg haus".split()
    bench = [(k, " ".join(rng.choice(english) + str(rng.randint(0, 9)) for _ in range(n))) for k, n in ((1, 30), (2, 12), (3, 4))]
    private = ["me@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+1 (706) 555-3138"]
    rows = [(900, None), (901, ""), (902, " ... 12 34 "), (903, "Hello"), (904, "hello")]
    for k in range(60):
        words = [rng.choice(german if k % 3 == 0 else english) for _ in range(rng.randint(30, 90))]
        if k % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(private))
        if k % 7 == 0:
            item = bench[k % 3][1].split()
            words[5:5] = item[:11] if k % 2 else item[: rng.choice([3, 9])]
        rows.append((k, " ".join(words)))
        if k % 4 == 0:
            rows += [(200 + k, " ".join(words)), (300 + k, " ".join([*words[:-1], "another"]).upper())]
    return rows, bench


def masked(text):
    out, at = [], 0
    for a, b, kind in sorted((a, b, KINDS.index(k)) for k, a, b in plain_spans(text)):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def expected(rows, bench):
    kept = sorted((d, t) for d, t in rows if re.search(r"[^\W\d_]", t or ""))
    groups = plain_groups([plain_print(t) for _, t in kept])
    kept = [row for k, row in enumerate(kept) if groups[k] == k]
    kept = [row for row in kept if not plain_hits([row], bench)[0][5]]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    out = []
    for d, t in kept:
        ids = library.encode(masked(t), add_special_tokens=False).ids
        out.append((d, len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def write(spark, tmp_path, rows, bench):
    docs = [(d, t, None if d == 3 else "de" if d % 3 == 0 else "en", None, None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")


def test_run_matches_brute_force(spark, tmp_path):
    rows, bench = corpus()
    write(spark, tmp_path, rows, bench)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(rows, bench)
    assert 0 < len(want) < len(rows)
    assert sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in got) == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, bench = corpus()
    write(spark, tmp_path, rows, bench)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
