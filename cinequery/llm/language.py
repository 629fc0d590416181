"""Language identification of words and spans: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import bounded_sample, mix, released, runs, text_blocks

#: First and last code points of scripts, from the Unicode charts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
#: Longest letter sequences counted, and buckets of their hashes.
GRAMS, BUCKETS = 4, 1 << 15
#: A script is a language's own if it writes this share of its letters at least.
SCRIPT_SHARE = 0.02
#: What a switch of language between two words costs, in nats.
SWITCH = 4.0
UNKNOWN = "und"
#: Bytes of text labelled at once: the arrays take some fifty times as much.
BLOCK_BYTES = 1 << 20


def letter_table() -> np.ndarray:
    """Of each code point: 0 no letter, 1 a letter of another script, 2.. a letter of the scripts in order."""
    table = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)], np.uint8)
    for k, spans in enumerate(SCRIPTS.values()):
        for a, b in spans:
            table[a : b + 1] *= k + 2
    return table


@dataclass
class Words:
    """The words (runs of letters, lower case) of a block of texts: row, number of letters and the distinct words' grams."""

    row: np.ndarray
    letters: np.ndarray
    which: np.ndarray  # the distinct word of each word
    script: np.ndarray  # of each distinct word
    owner: np.ndarray  # the distinct word of each gram
    bucket: np.ndarray  # the hashed gram


def split(texts: list[str], table: np.ndarray) -> Words:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *map(len, low)])
    kind = table[np.minimum(codes, 0x10FFFF)]
    inside = kind > 0
    starts, ends = runs(inside, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    length = ends - starts
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none)
    # Distinct words by a hash of their code points.
    step = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(int(length.max()) + 1, step, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inner = np.flatnonzero(inside)
    at = np.arange(len(inner)) - np.repeat(np.cumsum(length) - length, length)
    valued = mix(codes[inner].astype(np.uint64) + np.uint64(1)) * powers[at]
    h = np.add.reduceat(valued, np.cumsum(length) - length)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[first], length[first]
    script = kind[s].astype(np.int64)
    # The distinct words with a border before and after; grams of 1..GRAMS signs inside them.
    begin = np.cumsum(n + 2) - (n + 2)
    signs = np.ones(int((n + 2).sum()), np.uint64)
    place = np.repeat(begin + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
    signs[place] = codes[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]
    word = np.repeat(np.arange(len(n)), n + 2)
    owner, bucket = [], []
    gram = np.zeros(len(signs), np.uint64)
    for k in range(GRAMS):
        m = len(signs) - k
        gram = gram[:m] * step + mix(signs[k:] + np.uint64(k))[:m]
        ok = word[:m] == word[k:]
        owner.append(word[:m][ok])
        bucket.append((mix(gram[ok]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return Words(row, length, which.ravel(), script, np.concatenate(owner), np.concatenate(bucket))


class Model:
    """Log probabilities of grams and the scripts of each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: counts by language and bucket; scripts: letters by language and script."""
        self.languages = languages
        self.table = letter_table()
        total = grams.sum(1, keepdims=True)
        self.weights = np.log((grams + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32).copy()  # bucket, language
        self.own = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)) & (scripts > 0)

    def scores(self, words: Words) -> np.ndarray:
        """Of each distinct word and language: the log probability of its grams, each sign's GRAMS grams counted as one. Languages that don't write in its script are out, unless all are."""
        out = np.stack([np.bincount(words.owner, self.weights[words.bucket, k], len(words.script)) for k in range(len(self.languages))], 1)
        out = out / GRAMS
        out -= out.max(1, keepdims=True)
        out = np.maximum(out, -12.0)
        fits = self.own[:, words.script].T
        return np.where(fits | ~fits.any(1, keepdims=True), out, -1e6)

    def label(self, words: Words, rows: int) -> np.ndarray:
        """The language of each word on the best path of its row: all rows go word by word in step."""
        if not len(words.row):
            return np.zeros(0, np.int64)
        emit = self.scores(words)[words.which]
        size = np.bincount(words.row, minlength=rows)
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], begin[order]
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), "left")  # rows with more than t words
        best = emit[begin[: live[0]]].copy()
        source = np.zeros(emit.shape, np.int8)
        for t in range(1, steps):
            here = best[: live[t]]
            top = here.argmax(1)
            jump = here[np.arange(len(here)), top] - SWITCH
            switch = here < jump[:, None]
            at = begin[: live[t]] + t
            source[at] = np.where(switch, top[:, None], np.arange(emit.shape[1]))
            best[: live[t]] = np.maximum(here, jump[:, None]) + emit[at]
        out = np.zeros(len(emit), np.int64)
        state = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            at = begin[:n] + t
            out[at] = state[:n]
            state[:n] = source[at, state[:n]]
        return out

    def decide(self, words: Words, label: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the number of the language of most letters (-1: none), its share of the letters, and the share of letters in words of a script that no learned language writes."""
        if not self.languages or not len(words.row):
            return np.full(rows, -1), np.zeros(rows), np.zeros(rows)
        k = len(self.languages)
        mass = np.bincount(words.row * k + label, words.letters, rows * k).reshape(rows, k)
        total = mass.sum(1)
        top = mass.argmax(1)
        strange = ~self.own[:, words.script].any(0)[words.which]
        apart = np.bincount(words.row[strange], words.letters[strange], rows)
        most = np.maximum(total, 1)
        return np.where(total > 0, top, -1), mass[np.arange(rows), top] / most, apart / most

    def name(self, number: int) -> str:
        return self.languages[number] if number >= 0 else UNKNOWN

    def languages_of(self, texts: list[str]) -> list[str]:
        """The language of each text alone."""
        words = split(texts, self.table)
        return [self.name(i) for i in self.decide(words, self.label(words, len(texts)) if self.languages else None, len(texts))[0].tolist()]

    def spans(self, words: Words, label: np.ndarray, rows: int) -> pa.Array:
        """Of each row its runs of words of one language."""
        turn = np.flatnonzero((np.diff(words.row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)) if len(label) else np.zeros(0, np.int64)
        begin = np.searchsorted(words.row, np.arange(rows))
        of = words.row[turn]
        past = np.append(turn[1:], len(words.row))[: len(turn)]
        offsets = np.searchsorted(of, np.arange(rows + 1))
        names = pa.array(self.languages, pa.string()).take(pa.array(label[turn], pa.int64()))
        columns = [pa.array(turn - begin[of], pa.int64()), pa.array(past - begin[of], pa.int64()), names]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["first", "past", "lang"]))


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each language: gram counts, and letters by script under the numbers -1, -2, ..."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, BLOCK_BYTES):
            names = rows.column(rows.schema.get_field_index("lang")).to_pylist()
            words = split(_texts(data, offsets), table)
            if not len(words.row):
                continue
            languages = sorted(set(names))
            of = np.array([languages.index(x) for x in names])[words.row]
            for k, name in enumerate(languages):
                count = np.bincount(words.which[of == k], minlength=len(words.script))
                grams[name] = grams.get(name, 0) + np.bincount(words.bucket, count[words.owner], BUCKETS)
                scripts[name] = scripts.get(name, 0) + np.bincount(words.script[words.which[of == k]], words.letters[of == k], len(SCRIPTS) + 2)
    for name, counts in grams.items():
        used = np.flatnonzero(counts)
        own = np.flatnonzero(scripts[name])
        yield pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(name, pa.string()), len(used) + len(own)), "bucket": np.concatenate([used, -1 - own]), "n": np.concatenate([counts[used], scripts[name][own]]).astype(np.float64)})


def fit(labelled: DataFrame, fit_rows: int | None = None) -> Model:
    """Learns from (text, lang) of all rows, or of about ``fit_rows`` at most, chosen by a hash of doc_id; their counts are summed by Spark, and what reaches the driver is BUCKETS numbers a language."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    if fit_rows is not None:
        rows = bounded_sample(rows, "doc_id", fit_rows)
    table = labelled.sparkSession.sparkContext.broadcast(letter_table())
    counts = rows.mapInArrow(lambda batches: released(_count(batches, table.value)), "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    at = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    bucket, n = counts["bucket"].to_numpy(np.int64), counts["n"].to_numpy(float)
    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(SCRIPTS) + 2))
    grams[at[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    scripts[at[bucket < 0], -1 - bucket[bucket < 0]] = n[bucket < 0]
    return Model(languages, grams, scripts)


def _predict(batches: Iterator[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, BLOCK_BYTES):
            n = len(rows)
            words = split(_texts(data, offsets), model.table)
            label = model.label(words, n) if model.languages else np.zeros(0, np.int64)
            top, score, _ = model.decide(words, label, n)
            out = [rows.column(rows.schema.get_field_index("doc_id")), pa.array([model.name(i) for i in top.tolist()], pa.string()), pa.array(score, pa.float64())]
            if spans:
                out.append(model.spans(words if model.languages else split([], model.table), label, n))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])


def predict(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans of each row of ``docs``.

    lang_pred is the language of most letters on the Viterbi path, ties to the first by name;
    score is its share of the letters; spans are runs of words (runs of letters, counted from 0)
    of one language. A null text, one without a letter, or no learned language: ``und``, 0, none.
    Repeated rows are labelled each, an empty table gives an empty result. A text of any length is
    labelled whole: texts are taken in blocks of BLOCK_BYTES, a longer one by itself.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language and a table of fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<first:long,past:long,lang:string>>" * spans
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(_predict(batches, known.value, spans)), schema)


def _keep(batches: Iterator[pa.RecordBatch], model: Model, strange: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, BLOCK_BYTES):
            words = split(_texts(data, offsets), model.table)
            top, _, apart = model.decide(words, model.label(words, len(rows)) if model.languages else None, len(rows))
            keep = (top >= 0) & (apart <= strange)
            at = rows.schema.get_field_index("lang")
            if at >= 0:
                rows = rows.set_column(at, rows.schema.field(at), pa.array([model.name(i) for i in top.tolist()], rows.schema.field(at).type))
            yield rows.filter(pa.array(keep))


def recognised(docs: DataFrame, model: Model, strange: float = 0.5) -> DataFrame:
    """``docs`` without the rows in which no language is found, and with ``lang``, if there, set to the language recognised.

    No language is found in a null text, in one without a letter, and where words of scripts that
    no learned language writes hold over ``strange`` of the letters, as the model can't tell them
    apart. All columns stay, as do repeated rows; an empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    lang = next((f.name for f in docs.schema if f.name == "lang" and f.dataType.simpleString() != "string"), None)
    if lang:
        raise TypeError(f"lang is {docs.schema[lang].dataType.simpleString()}, not string")
    return docs.mapInArrow(lambda batches: released(_keep(batches, known.value, strange)), docs.schema)
