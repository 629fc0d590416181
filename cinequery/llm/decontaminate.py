"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a bounded block of whole documents) gets an array of the places where a benchmark
window can begin, in the order of their first words; every distinct window is binary-searched in
it, and the range of equal prefixes gives all its places. From each place on, the range of
benchmark suffixes in their full order is narrowed word by word, which gives the longest verbatim
match. Shards need no shuffle, so a passage that many documents share costs no more than any other
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import cut, released, runs, text_blocks, words

SCHEMA = "doc_id {id}, text_hash long, n_words long, hits array<struct<first:long,past:long>>, items array<string>, longest long"


class Suffixes:
    """The suffixes of a block of benchmark items, as rows of word numbers; number 0 is any word that no item has."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        names: list[str | None] = []
        sequences: list[np.ndarray] = []
        for name, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            _, h, _ = words(raw, np.array([0, len(raw)]))
            if len(h):
                names.append(name)
                sequences.append(h)
        self.names = names
        self.vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        self.window = window
        flat = [np.searchsorted(self.vocabulary, s) + 1 for s in sequences]
        lengths = [len(s) for s in flat]
        self.words = np.concatenate([*flat, np.zeros(window, np.int64)]) if flat else np.zeros(window, np.int64)
        begins = np.cumsum([0, *lengths])
        start, item, width = [], [], []
        for k, n in enumerate(lengths):
            for j in range(n - min(n, window) + 1):
                start.append(begins[k] + j)
                item.append(k)
                width.append(min(n, window))
        self.start, self.item, self.width = (np.array(x, np.int64) for x in (start, item, width))
        self.past = begins[1:][self.item] if len(self.item) else np.zeros(0, np.int64)
        self.shortest = int(self.width.min()) if len(self.width) else window
        # Equal windows are searched once; groups[i]:groups[i+1] are the suffixes that begin with window i.
        table = np.where(np.arange(window) < self.width[:, None], self.words[self.start[:, None] + np.arange(window)], -1) if len(self.start) else np.zeros((0, window), np.int64)
        self.windows, which = np.unique(table, axis=0, return_inverse=True)
        # Within a group they stand in the order of all their words.
        rank = suffix_ranks(self.words[: begins[-1]], np.repeat(begins[1:], lengths))
        self.order = np.lexsort((rank[self.start], which.ravel()))
        self.groups = np.searchsorted(which.ravel()[self.order], np.arange(len(self.windows) + 1))
        self.widths = (self.windows >= 0).sum(1)


    def after(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The word at ``depth`` of the suffixes at places ``at`` of the order; past an item's end 0."""
        suffix = self.order[at]
        place = self.start[suffix] + depth
        return np.where(place < self.past[suffix], self.words[np.minimum(place, len(self.words) - 1)], 0)

    def narrowed(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range of the order whose suffixes agree up to ``depth`` the part that goes on with ``word``."""
        sides = []
        for upper in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                middle = (a[open_] + b[open_]) >> 1
                there = self.after(middle, depth[open_])
                right = there <= word[open_] if upper else there < word[open_]
                a[open_] = np.where(right, middle + 1, a[open_])
                b[open_] = np.where(right, b[open_], middle)
            sides.append(a)
        return sides[0], sides[1]


def suffix_ranks(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each place its rank by all words up to its item's end, which comes before any word; equal suffixes share one. The compared length doubles until no more suffixes part."""
    n = len(numbers)
    rank, step, count = numbers, 1, len(np.unique(numbers))
    while n:
        further = np.arange(n) + step
        key = rank * (n + 2) + np.where(further < ends, rank[np.minimum(further, n - 1)] + 1, 0)
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == count:
            break
        count, step = len(distinct), 2 * step
    return rank


def suffix_array(numbers: np.ndarray, row: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """Places in ``numbers`` in the order of their first ``depth`` words. A place is left out if a word of no item, or its row's end, comes within ``shortest`` words: no window can match there."""
    n = len(numbers)
    if n < shortest:
        return np.zeros(0, np.int64)
    known = numbers > 0
    stop = np.where(~known, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    ends = np.searchsorted(row, row, "right")
    live = np.flatnonzero(np.minimum(stop, ends) - np.arange(n) >= shortest)
    if not len(live):
        return live
    padded = np.concatenate([numbers, np.zeros(depth, numbers.dtype)])
    rows = np.concatenate([row, np.full(depth, -1, row.dtype)])
    bits = max(1, int(numbers.max()).bit_length())
    together = max(1, 63 // bits)  # words of a key
    keys = []
    for k in range(0, depth, together):
        key = np.zeros(len(live), np.int64)
        for j in range(k, min(k + together, depth)):
            key = (key << bits) | padded[live + j] * (rows[live + j] == row[live])
        keys.append(key)
    return live[np.lexsort(keys[::-1])]


def ranges(numbers: np.ndarray, row: np.ndarray, array: np.ndarray, queries: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the first and the past place in ``array`` whose suffix begins with the query's words: two binary searches, all queries in step."""
    padded = np.concatenate([numbers, np.full(queries.shape[1], 0, numbers.dtype)])
    rows = np.concatenate([row, np.full(queries.shape[1], -1, row.dtype)])

    def side(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(array), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            place = array[middle]
            sign, undecided = np.zeros(len(open_), np.int64), np.ones(len(open_), bool)
            for k in range(queries.shape[1]):
                undecided &= k < widths[open_]
                if not undecided.any():
                    break
                word = padded[place + k] * (rows[place + k] == row[place])
                d = np.sign(word - queries[open_, k]) * undecided
                sign = np.where(undecided, d, sign)
                undecided &= d == 0
            right = sign <= 0 if upper else sign < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        return low

    return side(False), side(True)


def longest_matches(numbers: np.ndarray, row: np.ndarray, place: np.ndarray, window: np.ndarray, tests: Suffixes) -> np.ndarray:
    """Words that the text at each place shares with the benchmark suffix that goes along with it farthest, of all that begin with the window."""
    low, high, length = tests.groups[window], tests.groups[window + 1], tests.widths[window]
    live = np.arange(len(place))
    while live.size:
        at = place[live] + length[live]
        inside = at < len(numbers)
        at = np.minimum(at, len(numbers) - 1)
        inside &= (row[at] == row[place[live]]) & (numbers[at] > 0)
        live, at = live[inside], at[inside]
        first, past = tests.narrowed(low[live], high[live], numbers[at], length[live])
        on = past > first
        live = live[on]
        low[live], high[live] = first[on], past[on]
        length[live] += 1
    return length


def search(numbers: np.ndarray, row: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a window: place, window number, and the longest match of the suffixes beginning with it."""
    none = np.zeros(0, np.int64)
    array = suffix_array(numbers, row, tests.shortest, tests.window)
    if not len(array) or not len(tests.windows):
        return none, none, none
    low, high = ranges(numbers, row, array, tests.windows, tests.widths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return none, none, none
    counts = high[found] - low[found]
    window = np.repeat(found, counts)
    place = array[np.repeat(low[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    return place, window, longest_matches(numbers, row, place, window, tests)


def occurrences(data: np.ndarray, offsets: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, ...]:
    """Of a shard: the row of each word, the words of each row, and what ``search`` finds."""
    row, h, _ = words(data, offsets)
    numbers = np.zeros(len(h), np.int64)
    if len(tests.vocabulary):
        at = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
        numbers = np.where(tests.vocabulary[at] == h, at + 1, 0)
    return row, np.bincount(row, minlength=len(offsets) - 1), *search(numbers, row, tests)


def scan(batches: Iterator[pa.RecordBatch], tests: Suffixes, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, shard_bytes):
            row, size, place, window, length = occurrences(data, offsets, tests)
            begin = np.cumsum(size) - size
            hits: list[list] = [[] for _ in range(len(rows))]
            items: list[list] = [[] for _ in range(len(rows))]
            longest = np.zeros(len(rows), np.int64)
            if len(place):
                depth = np.zeros(len(row) + 1, np.int64)
                np.add.at(depth, place, 1)
                np.add.at(depth, place + tests.widths[window], -1)
                first, past = runs(np.cumsum(depth)[:-1] > 0, begin)
                for a, b in zip(first.tolist(), past.tolist(), strict=True):
                    hits[row[a]].append({"first": a - int(begin[row[a]]), "past": b - int(begin[row[a]])})
                np.maximum.at(longest, row[place], length)
                for r, w in np.unique(np.stack([row[place], window]), axis=1).T.tolist():
                    items[r] += [tests.names[i] for i in tests.item[tests.order[tests.groups[w] : tests.groups[w + 1]]]]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(size, pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
                    pa.array([sorted({x for x in i if x is not None}) for i in items], pa.list_(pa.string())),
                    pa.array(longest, pa.int64()),
                ],
                names=["doc_id", "text_hash", "n_words", "hits", "items", "longest"],
            )


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of at most ``limit`` bytes, or one item; the block searched and the next one are on the driver at a time."""
    block, size = [], 0
    for item in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(item.text) * 4 > limit:
            yield block
            block, size = [], 0
        block.append((item.item_id, item.text))
        size += len(item.text) * 4
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: n_words, the word ranges covered by benchmark windows, the items they come from, and the longest match in words.

    An item of fewer than ``window`` words is one window; one without words matches nothing.
    Benchmarks over ``block_bytes`` are searched block by block over all documents and the
    findings merged, so what is broadcast stays bounded. Null texts have no words; a null
    item_id marks words but names no item. Rows with equal ids stay apart; equal rows have equal
    findings, so blocks are merged by (doc_id, text) and returned as often as the rows come. An empty
    table of documents gives an empty result, an empty benchmark no findings; a text longer than a
    shard is one by itself.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    blocks = item_blocks(benchmark, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    parts = []
    while block is not None:
        tests = texts.sparkSession.sparkContext.broadcast(Suffixes(block, window))
        part = texts.mapInArrow(lambda batches, tests=tests: released(scan(batches, tests.value, shard_bytes)), schema)
        if not parts and after is None:
            return part.drop("text_hash")
        parts.append(cut(part))  # what is found of a block is kept, so that the block itself can go
        tests.destroy()
        block, after = after, next(blocks, None)
    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("block", F.lit(k))
        whole = whole.unionByName(part) if whole is not None else part
    # Of equal rows one finding a block is kept, with their number, so that no key gathers more rows than there are blocks.
    found = ("n_words", "hits", "items", "longest")
    whole = whole.groupBy("doc_id", "text_hash", "block").agg(F.max(F.struct(*found)).alias("found"), F.count("*").alias("copies")).select("doc_id", "text_hash", "copies", *(f"found.{c}" for c in found))
    merged = whole.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    joined = F.aggregate(
        "hits",
        F.array().cast("array<struct<first:long,past:long>>"),
        lambda done, hit: F.when(
            (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1)["past"], F.lit(-1)) >= hit["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["first"].alias("first"), F.greatest(F.get(done, F.size(done) - 1)["past"], hit["past"]).alias("past")))),
        ).otherwise(F.concat(done, F.array(hit))),
    )
    return merged.withColumn("hits", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *found)


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, hit: n + hit["past"] - hit["first"])


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The digest of ``matches``: counts of words, of words inside windows and of items, a hash of the items, and whether the document is contaminated."""
    names = F.array_join(F.array_sort("items"), ",")
    return matches(docs, benchmark, **how).select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"), "longest")


def keep(batches: Iterator[pa.RecordBatch], tests: Suffixes, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, shard_bytes):
            row, _, place, _, _ = occurrences(data, offsets, tests)
            mask = np.ones(len(rows), bool)
            mask[row[place]] = False
            yield rows.filter(pa.array(mask))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay. No shuffle. With several blocks of benchmark what each leaves is written before the next is read."""
    blocks = item_blocks(benchmark, block_bytes)
    block, after = next(blocks, None), next(blocks, None)
    alone = after is None
    while block is not None:
        tests = docs.sparkSession.sparkContext.broadcast(Suffixes(block, window))
        docs = docs.mapInArrow(lambda batches, tests=tests: released(keep(batches, tests.value, shard_bytes)), docs.schema)
        if not alone:
            docs = cut(docs)
            tests.destroy()
        block, after = after, next(blocks, None)
    return docs
