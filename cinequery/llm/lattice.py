"""Language-model scores: subword lattice likelihood over the pieces of an existing vocabulary.

A word's probability sums over all its segmentations into pieces. The vocabulary's scores weight
the pieces at first; rounds of expectation-maximisation over the corpus' words (how often each piece
occurs, by the probabilities of all segmentations) then learn their weights, and the words'
probabilities multiply to the marginal probability of the text. Without rounds the vocabulary's
scores stay, and a further arc spans each word the corpus holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import cut, released, text_blocks
from cinequery.llm.pieces import Lattice, Pieces

#: Words with at least 1 / HOT of all tokens, so HOT words at most, are broadcast; the others are joined.
HOT = 200_000
#: Rounds of learning, and tokens by the vocabulary's own scores that count besides the corpus.
ROUNDS, PRIOR = 2, 10_000.0


def _tokens(raw: bytes, a: int, b: int) -> list[bytes]:
    return raw[a:b].lower().split()


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _count(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Words with their numbers in learning rows and in all rows, in parts of bounded size."""
    learned: Counter[bytes] = Counter()
    others: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for counts, weight in ((learned, 1), (others, 0)):
            items = iter(counts.items())
            while part := [*islice(items, 50_000)]:
                yield pa.RecordBatch.from_arrays([pa.array([_text(w) for w, _ in part], pa.string()), pa.array([n * weight for _, n in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["word", "c", "n"])
            counts.clear()

    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20):
            raw = data.tobytes()
            for learn, a, b in zip(rows.column(rows.schema.get_field_index("learn")).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                (learned if learn else others).update(_tokens(raw, a, b))
            if len(learned) + len(others) > limit:
                yield from flush()
    yield from flush()


def _marginals(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = lattice.marginals(batch.column(0).to_pylist()) / math.log(10)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "lattice"])


def _expected(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(lattice.weights))
    for batch in batches:
        total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.float64())})


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """word, c (its number in rows that ``learn`` marks), n (in all rows), once for each distinct word."""
    return docs.select("text", learn.alias("learn")).mapInArrow(lambda batches: released(_count(batches)), "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learned(counts: DataFrame, lattice: Lattice, ends: int, rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """``lattice`` with the weights that ``rounds`` of expectation-maximisation over the words of ``counts`` (word, c) give, and ``ends`` texts. What reaches the driver is a number for each piece of the vocabulary."""
    words = counts.where("c > 0").select("word", "c")
    for _ in range(rounds):
        known = counts.sparkSession.sparkContext.broadcast(lattice)  # of the vocabulary's fixed size
        found = words.mapInArrow(lambda batches, known=known: released(_expected(batches, known.value)), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(lattice.weights))
        total[found["piece"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        total[-1] = ends
        lattice = lattice.learned(total, prior)
    return lattice


def word_table(counts: DataFrame, lattice) -> DataFrame:
    """``counts`` with lattice: log10 of each word's marginal probability."""
    return counts.mapInArrow(lambda batches: released(_marginals(batches, lattice.value)), "word string, c long, n long, lattice double")


class Mixture:
    """Weights of the two ways to a word: the corpus has it with 1 - unseen, the lattice spells it with unseen (Witten and Bell: distinct words over tokens and distinct words)."""

    def __init__(self, tokens: int, distinct: int):
        self.tokens = tokens
        self.unseen = distinct / (tokens + distinct) if tokens else 1.0

    def log10(self, c: int, lattice: float) -> float:
        if not c:
            return math.log10(self.unseen) + lattice
        return math.log10(self.unseen * 10.0**lattice + (1 - self.unseen) * c / self.tokens)

    def column(self, c: str, lattice: str) -> Column:
        seen = F.log10(F.lit(self.unseen) * F.pow(F.lit(10.0), lattice) + F.lit((1 - self.unseen) / max(self.tokens, 1)) * F.col(c))
        return F.when(F.col(c) > 0, seen).otherwise(F.lit(math.log10(self.unseen)) + F.col(lattice))


def _score(batches: Iterator[pa.RecordBatch], hot: dict[bytes, tuple[int, float, float]], end: tuple[int, float, float]) -> Iterator[pa.RecordBatch]:
    """A row for each text with what its hot words add, and one for each of its other words. Word keys of the former hold blanks, so no word meets them."""
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 1 << 20):
            raw = data.tobytes()
            names = rows.column(1).to_pylist()
            of, word, n, docs, known, base, score = [], [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                tokens = _tokens(raw, a, b)
                total_known, total_base, total_score = end
                cold: list[bytes] = []
                for w, m in Counter(tokens).items():
                    if (h := hot.get(w)) is None:
                        cold.append(w)
                        of.append(k)
                        n.append(m)
                    else:
                        total_known += m * h[0]
                        total_base += m * h[1]
                        total_score += m * h[2]
                word += map(_text, cold)
                docs += [0] * len(cold)
                known += [0] * len(cold)
                base += [0.0] * len(cold)
                score += [0.0] * len(cold)
                of.append(k)
                n.append(len(tokens) + 1)
                word.append(f" {names[k]}")
                docs.append(1)
                known.append(total_known)
                base.append(total_base)
                score.append(total_score)
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(at), rows.column(1).take(at), pa.array(word, pa.string()), *(pa.array(x, pa.int64()) for x in (n, docs, known)), *(pa.array(x, pa.float64()) for x in (base, score))],
                names=["doc_id", "text_hash", "word", "n", "docs", "known", "base", "score"],
            )


def score(docs: DataFrame, learn: Column, path: str, hot_words: int = HOT, rounds: int = 0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``; ``learn`` marks the rows to learn from.

    Tokens are the words (ASCII white space parts them, A-Z count as a-z) and one end. base_score
    is log10 under add-one counts of whole tokens; score is the log10 probability of the text under
    the lattice whose weights ``rounds`` have learned, or without rounds under the mixture of the
    vocabulary's own lattice and whole words. Null texts are empty, so just an end. Equal rows are
    scored once and returned as often as they come; an empty table gives an empty result. A word of
    any length is scored whole. Without rows to learn from, the vocabulary's lattice scores.
    """
    spark = docs.sparkSession
    counts = word_counts(docs, learn)
    lattice = Lattice(Pieces(path))
    ends = docs.where(learn).count()
    if rounds and ends:
        counts = cut(counts)
        lattice = learned(counts, lattice, ends, rounds)
    table = cut(word_table(counts, spark.sparkContext.broadcast(lattice)))
    sums = table.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = (sums.c or 0) + ends, sums.v + (ends > 0)
    model = Mixture(tokens, distinct)
    of_word = (lambda c, lattice: lattice) if rounds else model.log10
    word_score = F.col("lattice") if rounds else model.column("c", "lattice")
    add_one = lambda c: math.log10((c + 1) / (tokens + distinct + 1))
    # Each of these has n >= all / hot_words, so there are hot_words at most.
    frequent = table.where(F.col("n") * hot_words >= (sums.n or 0)).collect()
    hot = spark.sparkContext.broadcast({r.word.encode(): (int(r.c > 0), add_one(r.c), of_word(r.c, r.lattice)) for r in frequent})
    end = (int(ends > 0), add_one(ends), of_word(ends, lattice.end / math.log(10)))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, word string, n long, docs long, known long, base double, score double"
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lambda batches: released(_score(batches, hot.value, end)), schema)
    cold = parts.join(table.select("word", "c", "lattice"), "word", "left")
    met = F.col("c").isNotNull()
    summed = cold.groupBy("doc_id", "text_hash").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.col("n") * F.col("docs")).alias("n_tokens"),
        F.sum(F.col("known") + F.when(met & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(met, F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1)))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(met, F.col("n") * word_score).otherwise(0.0)).alias("score"),
    )
    one = summed.select("doc_id", *((F.col(x) / F.col("docs")).cast("long").alias(x) for x in ("n_tokens", "n_known")), *((F.col(x) / F.col("docs")).alias(x) for x in ("base_score", "score")), F.explode(F.sequence(F.lit(1), F.col("docs"))).alias("copy"))
    return one.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
