"""Collocations: phrases whose words keep company more often than their parts would by chance.

The n-grams of a text become rows, counted per language by hash aggregation. What cannot reach the
count asked for is left out of the rows, so the result is that of all n-grams: a phrase is frequent
only if each phrase within it is, so words are counted first, then the pairs of frequent words, then
what is longer and made of frequent pairs; and before phrases become rows their hashes are counted in
a sketch, whose counters are never less than the counts of their phrases. Scores come from joins with
the counts of the parts, in decimals; phrases that a longer one explains leave by an anti-join with
one-word extensions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.common import LOWER, cut, hashes, mix, released, runs, text_blocks

#: Bytes that end a piece, and those that part words within one.
BREAKS = np.array([bytes([b]) in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
BLANKS = np.array([b in (0x20, 0x09) for b in range(256)])
#: Bits of a filter of frequent phrases: for each phrase, and at most. Beyond the latter it lets more pass that the counts then drop.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits of one row of a filter while it is built, as Spark's bitmap aggregate has them.
PAGE = 32768
#: Counters of the sketch that rules out phrases before they become rows, and how many phrases a task holds until it packs them.
COUNTERS, HELD = 1 << 28, 2 << 20
#: Copies of a language's total.
COPIES = 64
SCHEMA = "lang string, n int, phrase string, f long"


@dataclass
class Filter:
    """Phrases of ``width`` words that may be frequent: a bit for each hash; frequent ones always have theirs set."""

    width: int
    bits: np.ndarray

    def holds(self, codes: np.ndarray) -> np.ndarray:
        place = codes & np.uint64(len(self.bits) * 8 - 1)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _language(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The languages of a block's rows, and a hash of each row's."""
    coded = rows.column(0).dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest((x or "").encode(), 13) for x in coded.dictionary.to_pylist()], np.uint64)
    return rows.column(0), names[coded.indices.to_numpy(zero_copy_only=False)]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word of a block: row, piece (a running number), start, end, hash; and the block's lower-cased bytes."""
    low = LOWER[data]
    breaks = BREAKS[low]
    starts, ends = runs(~(breaks | BLANKS[low]), offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(breaks, dtype=np.int64)[starts] + row if len(starts) else starts
    return row, piece, starts, ends, hashes(low, starts, ends), low


def _codes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words that begin at each word."""
    codes = h
    for k in range(1, width):
        codes = mix(codes[: max(0, len(h) - k)] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    return codes


def _written(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, a space after each, and where each begins; the last place is the whole length."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    text = np.full(at[-1], 32, np.uint8)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(at[:-1], sizes) + within] = low[np.repeat(starts, sizes) + within]
    return text, at


def _strings(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    what = text[np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to.tobytes()), pa.py_buffer(what.tobytes())).cast(pa.string())


class Block:
    """The words of some texts, and which of their phrases may be frequent."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        self.names, language = _language(rows)
        self.row, self.piece, self.starts, self.ends, self.words, self.low = _pieces(data, offsets)
        self.language = language[self.row]

    def alive(self, widths: list[int], known: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Width, places and hashes of the phrases of one piece whose parts of ``known``'s width all pass it."""
        first, n = known.width if known else 1, len(self.words)
        alive = self.piece[: max(0, n - first + 1)] == self.piece[first - 1 :]
        if known:
            alive = alive & known.holds(_codes(self.words, first) ^ self.language[: len(alive)])
        for width in range(first, widths[-1] + 1):
            if width > first:
                alive = alive[:-1] & alive[1:] & (self.piece[: max(0, n - width + 1)] == self.piece[width - 1 :])
            if width in widths:
                places = np.flatnonzero(alive)
                yield width, places, _codes(self.words, width)[places] ^ self.language[places]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20):
            block = Block(rows, data, offsets)
            if len(block.words):
                yield block


def _counted(batches: Iterator[pa.RecordBatch], widths: list[int], known: Filter | None, likely: Filter | None) -> Iterator[pa.RecordBatch]:
    """lang, n, phrase, f: each block's phrases of these widths, those out of the question left out, with their number. Where words are counted, also n = 0: all of a language."""
    columns = ["lang", "n", "phrase", "f"]
    for block in _blocks(batches):
        text, at = _written(block.low, block.starts, block.ends)
        for width, places, codes in block.alive(widths, known):
            if likely:
                passed = likely.holds(codes)
                places, codes = places[passed], codes[passed]
            _, one, number = np.unique(codes, return_index=True, return_counts=True)
            one = places[one]
            yield pa.RecordBatch.from_arrays([block.names.take(pa.array(block.row[one])), pa.array(np.full(len(one), width, np.int32)), _strings(text, at[one], at[one + width] - 1), pa.array(number.astype(np.int64))], names=columns)
        if known is None:
            _, one, number = np.unique(block.language, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([block.names.take(pa.array(block.row[one])), pa.array(np.zeros(len(one), np.int32)), pa.nulls(len(one), pa.string()), pa.array(number.astype(np.int64))], names=columns)


def _sketched(batches: Iterator[pa.RecordBatch], widths: list[int], known: Filter, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """page, entries: how many phrases fall to each place of a sketch of ``bits`` counters, up to ``least``, some millions at a time: distances of the places met and their counts, packed."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        places, number = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        page, within = places // PAGE, places % PAGE
        first = np.flatnonzero(np.diff(page, prepend=-1))
        steps = np.diff(within, prepend=0)
        steps[first] = within[first]
        steps, number = steps.astype(np.uint16), np.minimum(number, least).astype(np.uint32)
        to = [*first[1:].tolist(), len(page)]
        packed = [zlib.compress(steps[a:b].tobytes() + number[a:b].tobytes(), 1) for a, b in zip(first.tolist(), to, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(page[first]), pa.array(packed, pa.binary())], names=["page", "entries"])

    for block in _blocks(batches):
        for _, _, codes in block.alive(widths, known):
            held.append((codes & np.uint64(bits - 1)).astype(np.int64))
        if sum(map(len, held)) > HELD:
            yield out()
    if sum(map(len, held)):
        yield out()


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """page, bits of the counters that reach ``least``. Rows come by page."""
    page, sums = None, np.zeros(PAGE, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

    for batch in batches:
        for number, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number != page:
                if page is not None and (sums >= least).any():
                    yield out()
                page, sums = number, np.zeros(PAGE, np.int64)
            raw = zlib.decompress(entries)
            n = len(raw) // 6
            sums[np.cumsum(np.frombuffer(raw[: 2 * n], np.uint16), dtype=np.int64)] += np.frombuffer(raw[2 * n :], np.uint32)
    if page is not None and (sums >= least).any():
        yield out()


def _slots(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """page, bit of each phrase's hash in a filter of ``bits`` bits."""
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20, "phrase"):
            _, language = _language(rows)
            _, _, starts, ends, h, _ = _pieces(data, offsets)
            place = ((_codes(h, width)[::width] ^ language) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // PAGE), pa.array(place % PAGE)], names=["page", "bit"])


def fitted(frequent: DataFrame, width: int) -> Filter:
    """A filter of frequent phrases (lang, phrase). Its bits are set in Spark, a page a row; what reaches the driver is the filter alone, MOST_BITS at most."""
    bits = PAGE
    while bits < min(MOST_BITS, BITS_EACH * frequent.count()):
        bits *= 2
    pages = frequent.select("lang", "phrase").mapInArrow(lambda batches: _slots(batches, width, bits), "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return _gathered(pages, width, bits)


def _gathered(pages: DataFrame, width: int, bits: int) -> Filter:
    out = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for page in pages.toLocalIterator():
        out[page.page] = np.frombuffer(page.bits, np.uint8)
    return Filter(width, out.reshape(-1))


def counts(docs: DataFrame, least: int, longest: int, bits: int = COUNTERS) -> DataFrame:
    """lang, n, phrase, f: how often each phrase of 1 to ``longest`` words occurs within pieces, where that is ``least`` times or more; n = 0 has all words of a language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    context = texts.sparkSession.sparkContext

    def level(widths: list[int], known: Filter | None) -> DataFrame:
        shared, likely = context.broadcast(known), context.broadcast(None)
        if known:
            entries = texts.mapInArrow(lambda batches: released(_sketched(batches, widths, shared.value, least, bits)), "page long, entries binary")
            pages = entries.repartition("page").sortWithinPartitions("page").mapInArrow(lambda batches: _summed(batches, least), "page long, bits binary")
            likely = context.broadcast(_gathered(pages, widths[0], bits))
        grams = texts.mapInArrow(lambda batches: released(_counted(batches, widths, shared.value, likely.value)), SCHEMA)
        return cut(grams.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n") == 0)))

    found = level([1], None)
    for widths in ([2], list(range(3, longest + 1))):
        if widths and widths[0] <= longest:
            width = widths[0] - 1
            found = found.unionByName(level(widths, fitted(found.where(F.col("n") == width), width)))
    return found


def scored(known: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two words and more: floor(1000 a n / (l r)) of the cut where that is lowest, the first of equal ones."""
    words = F.split("phrase", " ")
    cuts = known.where("n > 1").select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("rest"))
    part = lambda name, f: known.where("n > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # Languages are few and hot: their totals are repeated, and phrases dealt over the copies.
    total = known.where("n = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    cuts = cuts.withColumn("copy", F.pmod(F.xxhash64("phrase"), F.lit(COPIES)).cast("int")).join(total, ["lang", "copy"])
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("best"))
    return lowest.select("lang", "phrase", *(f"best.{c}" for c in ("words", "a", "l", "r", "n", "score")))


def unexplained(phrases: DataFrame, percent: int) -> DataFrame:
    """``phrases`` without those within a longer one that has ``percent`` of their occurrences or more.

    All phrases between the two occur as often as the longer one at least, so some phrase longer by
    one word explains the short one too; only those are looked at.
    """
    w = F.split("phrase", " ")
    longer = phrases.where("words > 2").select("lang", F.col("a").alias("most"), w.alias("w"), "words")
    shorter = F.explode(F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))).alias("phrase")
    extended = longer.select("lang", "most", shorter).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    left = phrases.alias("p").join(extended.alias("e"), (F.col("p.lang") == F.col("e.lang")) & (F.col("p.phrase") == F.col("e.phrase")) & (F.col("e.most") * 100 >= F.col("p.a") * percent), "left_anti")
    return left


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, then a, then the phrase in byte order.

    Texts are split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and
    tabs; A-Z count as a-z. a is the number of occurrences within pieces, l and r those of the two
    parts where the phrase is cut, n all words of the language. Null and empty texts have no words;
    a null lang is ``und``, together with texts that say so; equal rows count as often as they come;
    ids and further columns are not read. An empty table gives an empty result. A text is held
    whole by a task, with some 60 bytes for each of its own.

    Each language's best of many parts are ranked first, so that no task ranks a whole language. The
    sketch has COUNTERS counters, 32 MB as bits: it rules out nearly all rare phrases up to some ten
    billion words, for ``least`` of 100; with more words for each of ``least`` it rules out fewer, and
    more rows are counted.
    """
    phrases = unexplained(cut(scored(counts(docs, least, longest))), percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
