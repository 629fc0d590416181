"""BPE encoding and decoding over a trie of distinct words.

The last token of a prefix's encoding is a state of the trie's node: it is the one vocabulary
entry that ends the prefix and is compatible with the last token of what comes before it. A
depth-first walk hands these states down, so a prefix shared by many words is encoded once, and
each word's ids are read backwards along its path. No shuffle: each task walks its own words.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm.common import released, text_blocks


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it shows, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


LETTERS = byte_letters()
#: Bytes of chunks and words, and pairs of tokens, that a worker remembers; an entry counts with its table's share, some OVERHEAD bytes.
MEMORY, PAIRS, OVERHEAD = 128 << 20, 300_000, 200


class WordBPE:
    """A BPE vocabulary with word ends, read from a tokenizers file: NFC, lower case and white space runs folded; words by the file's pattern; bytes as letters."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        #: Ends of vocabulary entries: beyond one that isn't here no longer entry can end.
        self.tails = {t[i:] for t in self.whole() for i in range(len(t))}
        self.normalizer = spec["normalizer"]
        self._walker: Walker | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_walker": None}

    def walker(self, memory: int = 0) -> Walker:
        """One for each process, so that a task starts with what earlier ones of the same worker have learned; its memory is bounded."""
        if self._walker is None:
            self._walker = Walker(self, memory=memory or MEMORY)
        return self._walker

    def release(self) -> None:
        """Forgets the walker and gives its memory back."""
        self._walker = None

    def whole(self) -> Iterable[str]:
        """Entries as the walk sees them: the word end is one sign, a blank, which no letter is."""
        return (t[: -len(self.end)] + " " if t.endswith(self.end) else t for t in self.vocabulary)

    def symbols(self, token: str) -> list[str]:
        return [*token[:-2], token[-2] + self.end] if token.endswith(" ") else [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the pair of least rank first, of equal ones the leftmost."""
        after, before, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts) and (r := self.rank.get((parts[i], parts[after[i]]))) is not None:
                heappush(heap, (r, i, parts[i], parts[after[i]]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p, ok in zip(parts, alive, strict=True) if ok]


class Walker:
    """Encodes words for one worker. What it remembers is bounded: it starts anew beyond ``memory`` bytes or ``limit`` chunks and words, or ``pairs`` of tokens."""

    def __init__(self, bpe: WordBPE, limit: int | None = None, pairs: int = PAIRS, memory: int = MEMORY):
        from tokenizers.normalizers import NFC, Lowercase, Replace, Sequence
        from tokenizers import Regex

        self.bpe, self.limit, self.pairs, self.memory = bpe, limit, pairs, memory
        self.entry = {t: bpe.vocabulary[t[:-1] + bpe.end] if t.endswith(" ") else bpe.vocabulary[t] for t in bpe.whole()}
        self.fits: dict[int, bool] = {}  # by both tokens' ids
        self.alone: dict[str, bool] = {}
        self.split = regex.compile(bpe.pattern).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")").split
        self.library = Sequence([NFC(), Replace(Regex(r"\s+"), " "), Lowercase()])
        self.names = pa.array([bpe.names.get(i, "") for i in range(max(bpe.names) + 1)], pa.string())
        self.forget()

    def forget(self) -> None:
        """Chunks and words are numbered anew, in one table: each has its ids' place and number in one array."""
        self.number: dict = {}
        self.ids, self.begin, self.size = array("i"), array("q"), array("q")
        self.held = 0

    def full(self) -> bool:
        return self.held > self.memory or (self.limit is not None and len(self.number) > self.limit)

    def add(self, key: str | tuple, ids: Iterable[int]) -> None:
        self.number[key] = len(self.begin)
        self.begin.append(len(self.ids))
        self.ids.extend(ids)
        self.size.append(len(self.ids) - self.begin[-1])
        self.held += OVERHEAD + len(key if isinstance(key, str) else key[0]) + 4 * self.size[-1]

    def of(self, key: str | tuple) -> array:
        n = self.number[key]
        return self.ids[self.begin[n] : self.begin[n] + self.size[n]]

    def compatible(self, key: int, left: str, right: str) -> bool:
        """Whether BPE keeps the border between two tokens, which ``key`` stands for."""
        if len(self.fits) > self.pairs:
            self.fits.clear()
        a, b = (self.bpe.symbols(t) for t in (left, right))
        known = self.fits[key] = self.bpe.merge(a + b) == ["".join(a), "".join(b)]
        return known

    def own(self, token: str) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = len(self.bpe.merge(self.bpe.symbols(token))) == 1
        return known

    def learn(self, new: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word and its ids. Walks the trie of ``new`` words in order: sorted words that follow each other share their longest common prefix, whose states stay on the stack."""
        letters = {word if word.isascii() and word.isprintable() else "".join([LETTERS[b] for b in word.encode()]): word for word in new}
        entry, tails, fits = self.entry, self.bpe.tails, self.fits
        states, marks, path = [""], [0], ""  # states[i]: the last token of the encoding of the path's first i letters; marks: its id
        for mapped in sorted(letters):
            size = len(mapped)
            shared, most = 0, min(size - 1, len(path))
            while shared < most and mapped[shared] == path[shared]:
                shared += 1
            del states[shared + 1 :], marks[shared + 1 :]
            path = mapped[:-1]
            signs = mapped + " "
            for end in [*range(shared + 1, size), size + 1]:
                i = end - 1 if end < size else size - 1
                while True:
                    token = signs[i:end]
                    if (number := entry.get(token)) is not None:
                        if i:
                            ok = fits.get(key := marks[i] << 32 | number)
                            if ok is None:
                                ok = self.compatible(key, states[i], token)
                        else:
                            ok = self.own(token)
                        if ok:
                            break
                    elif token not in tails:
                        raise AssertionError(f"no token ends {signs[:end][-40:]!r}")
                    i -= 1
                if end < size:
                    states.append(token)
                    marks.append(number)
            ids = [number]
            while i:
                ids.append(marks[i])
                i -= len(states[i])
            ids.reverse()
            yield letters[mapped], ids

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if not regex.search("[\x1c-\x1f]", text) else self.library.normalize_str(text)
        if unicodedata.is_normalized("NFC", text) and not regex.search("[\x1c-\x1fΣİ]", text):
            return text.lower()
        return self.library.normalize_str(text)

    def chunks(self, text: str) -> list:
        """The text between white space, and special tokens as one-element tuples."""
        if "<|" not in text:
            return self.pieces(self.normal(text))
        out: list = []
        for part in self.apart(text):
            if part in self.bpe.special:
                out.append((part,))
            elif part:
                out += self.pieces(self.normal(part))
        return out

    @staticmethod
    def pieces(normal: str) -> list[str]:
        return normal.split() if not regex.search("[\x1c-\x1f]", normal) else regex.split(r"\s+", normal.strip(" "))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """ids of all texts in one array, their offsets, and the decoded texts."""
        parts = [self.chunks(t) for t in texts]
        if self.full():
            self.forget()
        fresh = [c for c in dict.fromkeys(chain.from_iterable(parts)) if c not in self.number]
        split = {c: ([c] if c.isascii() and c.isalpha() else self.split(c)) if isinstance(c, str) else [] for c in fresh}
        # A word is kept under its own text if it is split into itself alone, as then it is the chunk's encoding too.
        keys = {w: w if (w.isascii() and w.isalpha()) or self.split(w) == [w] else (w, 0) for ws in split.values() for w in ws}
        for word, ids in self.learn({w for w, key in keys.items() if key not in self.number}):
            self.add(keys[word], ids)
        for c in fresh:
            if c not in self.number:
                self.add(c, list(chain.from_iterable([self.of(keys[w]) for w in split[c]])) if isinstance(c, str) else [self.bpe.special[c[0]]])
        get = self.number.__getitem__
        numbers = [list(map(get, p)) for p in parts]
        which = np.fromiter(chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
        n = np.frombuffer(self.size, np.int64)[which] if len(which) else which
        ends = np.cumsum(n)
        first = np.frombuffer(self.begin, np.int64)[which] - ends + n if len(which) else which
        ids = np.frombuffer(self.ids, np.int32)[np.repeat(first, n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int32)
        borders = np.append(0, ends)[np.cumsum([0, *map(len, numbers)])]
        return ids, borders, self.decoded(ids, borders)

    def decoded(self, ids: np.ndarray, borders: np.ndarray) -> pa.Array:
        """The vocabulary's strings of each text joined by blanks: the file has no decoder of its own."""
        names = pa.LargeListArray.from_arrays(pa.array(borders.astype(np.int64)), self.names.take(pa.array(ids)))
        return pc.binary_join(names, " ")


def _encode(batches: Iterator[pa.RecordBatch], bpe: WordBPE, memory: int, keep: bool) -> Iterator[pa.RecordBatch]:
    walker = bpe.walker(memory)
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 1 << 20):
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids, ends, decoded = walker.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, decoded.cast(pa.string())], names=["doc_id", "ids", "decoded"])
    if not keep:
        del walker
        bpe.release()


def encode(docs: DataFrame, path: str, memory: int = MEMORY, keep: bool = True) -> DataFrame:
    """doc_id, ids, decoded of each row of ``docs`` under the vocabulary file ``path``: no special tokens are added, those in the text count as themselves. Null texts are empty, repeated rows stay, an empty table gives an empty result. A text is held whole with its tokens, however long. A worker remembers ``memory`` bytes of words, and for its next tasks too if ``keep``."""
    bpe = docs.sparkSession.sparkContext.broadcast(WordBPE(path))  # of the vocabulary's fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(_encode(batches, bpe.value, memory, keep)), schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """The number of tokens, and hashes of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
