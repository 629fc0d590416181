"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.llm import ann, bpe, collocation, decontaminate, language, lattice, licences, merkle, pieces, pii, shard, simhash, toxicity
from cinequery.llm.common import read, remainder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(documents(spark, sf_dir), shards=8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(documents(spark, sf_dir), WORD_BPE)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(documents(spark, sf_dir), PIECES)


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 4) == 2
    found = language.predict(docs, language.fit(docs.where(~held_out)), spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    learned = docs.where(~held_out)
    model = toxicity.fit(learned, read(spark, sf_dir, "labels").where(~held_out), language.fit(learned))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 7) == 2
    scored = lattice.score(documents(spark, sf_dir), ~held_out, PIECES, rounds=lattice.ROUNDS)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kd_shards, op2_simhash, op3_bpe_trie, op4_pii, op5_decontamination, op6_token_counts, op7_posting_lists, op8_language, op9_toxicity, op10_lattice_lm, op11_merkle_manifest, op12_license_scan, op13_collocations)}
