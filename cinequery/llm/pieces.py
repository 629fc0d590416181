"""Unigram scores of an existing subword vocabulary, and the two dynamic programs over them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinequery.llm.common import mix, released, text_blocks

#: What stands before a word's first letter in the vocabulary.
EDGE = "▁"


class Pieces:
    """Log probabilities (natural) of the pieces of a sentencepiece file.

    The file stores each piece's rank as a score; Zipf's law makes a probability of it, in
    proportion to 1 / (rank + 2). Bytes, which spell signs without a piece, each count as the
    last rank. So all pieces and bytes and the end sum to one.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e6]
        weight = {model.id_to_piece(i): 1 / (2 - model.get_score(i)) for i in normal}
        last = min(weight.values())
        total = sum(weight.values()) + 256 * last + 0.5
        self.log = {p: math.log(w / total) for p, w in weight.items()}
        # Signs that the file's encoder gives one token, also those it has no rank for (the edge alone).
        self.signs = {p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and len(p := model.id_to_piece(i)) == 1}
        self.byte = math.log(last / total)
        self.end = math.log(0.5 / total)
        self.heads = {p[:i] for p in self.log for i in range(1, len(p) + 1)}
        self.tails = {p[i:] for p in self.log for i in range(len(p))}

    def spelled(self, sign: str) -> float:
        return len(sign.encode("utf-8", "surrogatepass")) * self.byte

    def tokens(self, sign: str) -> int:
        """Tokens of a sign by itself: one if the file has it, or its bytes."""
        return 1 if sign in self.signs else len(sign.encode("utf-8", "surrogatepass"))

    def marginal(self, word: str) -> float:
        """log10 of the summed probability of all ways to cut the word into pieces: forward recursion in log space."""
        text = EDGE + word
        n = len(text)
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        log, heads = self.log, self.heads
        for i in range(n):
            here = forward[i]
            if here == -math.inf:
                continue
            for j in range(i + 1, n + 1):
                part = text[i:j]
                p = log.get(part)
                if p is None:
                    if j == i + 1:
                        p = self.spelled(part)
                    elif part not in heads:
                        break
                    else:
                        continue
                    new = here + p
                else:
                    new = here + p
                old = forward[j]
                if new > old:
                    forward[j] = new + math.log1p(math.exp(old - new)) if old > -math.inf else new
                else:
                    forward[j] = old + math.log1p(math.exp(new - old))
                if j == i + 1 and part not in heads:
                    break
        return forward[n] / math.log(10)

    def counts(self, words: Iterable[str], bytes_apart: bool = False) -> dict[str, tuple[int, float]]:
        """Of each word the number of pieces of its best segmentation and that one's log probability; of equally good ones the shortest. A spelled sign counts as one piece, or with ``bytes_apart`` as its ``tokens``.

        Words are inserted in a trie and walked depth first: in sorted order, the states of a
        prefix that two words share stay on the stack, so its scores are computed once. A word's
        terminal keeps its count.
        """
        out: dict[str, tuple[int, float]] = {}
        states: list[tuple[float, int]] = [(0.0, 0)]
        path = ""
        for word in sorted(words):
            text = EDGE + word
            shared = 0
            for a, b in zip(text, path, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                states.append(self._best(text, end, states, bytes_apart))
            path = text
            best, n = states[-1]
            out[word] = (-n, best)
        return out

    def _best(self, text: str, end: int, states: list[tuple[float, int]], bytes_apart: bool) -> tuple[float, int]:
        best = (-math.inf, 0)
        for i in range(end - 1, -1, -1):
            part = text[i:end]
            p, n = self.log.get(part), 1
            if p is None and i == end - 1:
                p = self.spelled(part)
                if bytes_apart:
                    n = self.tokens(part)
            if p is not None:
                best = max(best, (states[i][0] + p, states[i][1] - n))
            if part not in self.tails:
                break
        return best


class Lattice:
    """All ways to cut words into pieces at once: words of one length are columns of the same arrays.

    ``weights`` are log probabilities (natural) of each piece, of all bytes together and of the
    end; without any they are those of ``pieces``. A sign without a piece is spelled by its bytes,
    each the 256th part of theirs.
    """

    def __init__(self, pieces: Pieces, weights: np.ndarray | None = None):
        names = sorted(pieces.log)
        self.first = np.array([*(pieces.log[x] for x in names), pieces.byte + math.log(256), pieces.end])
        self.weights = self.first if weights is None else weights
        self.longest = max(map(len, names))
        sums = np.array([self._hash(x) for x in names], np.uint64)
        self.order = np.argsort(sums)
        self.sums = sums[self.order]
        self.end = float(self.weights[-1])

    def learned(self, counts: np.ndarray, prior: float) -> Lattice:
        """The same with the shares of ``counts``, to which ``prior`` tokens by the first weights are added."""
        other = object.__new__(Lattice)
        other.__dict__ = self.__dict__ | {"weights": np.log(counts + prior * np.exp(self.first)) - math.log(counts.sum() + prior * np.exp(self.first).sum()) + math.log(np.exp(self.first).sum())}
        other.end = float(other.weights[-1])
        return other

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _hash(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for code in self._codes(text):
            h = h * _STEP + mix(code[None] if np.ndim(code) else np.array([code], np.uint64))
        return h[0]

    def _arcs(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each length the piece (-1: none) and log weight of what begins at each place, and the bytes of each sign. codes: (words, signs)."""
        signs = mix(codes.astype(np.uint64))
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        ids, logs = [], []
        h = np.zeros_like(signs)
        for k in range(min(self.longest, codes.shape[1])):
            h = h[:, : codes.shape[1] - k] * _STEP + signs[:, k:]
            at = np.minimum(np.searchsorted(self.sums, h), len(self.sums) - 1)
            piece = np.where(self.sums[at] == h, self.order[at], -1)
            log = np.where(piece >= 0, self.weights[piece], -np.inf)
            if not k:
                log = np.where(piece >= 0, log, size * (self.weights[-2] - math.log(256)))
            ids.append(piece)
            logs.append(log)
        return ids, logs, size

    def _forward(self, logs: list[np.ndarray]) -> np.ndarray:
        n, m = logs[0].shape
        forward = np.zeros((n, m + 1))
        for j in range(1, m + 1):
            forward[:, j] = _log_sum([forward[:, j - k - 1] + logs[k][:, j - k - 1] for k in range(min(j, len(logs)))])
        return forward

    def _blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words by length: their places in the list and their signs, the edge first."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for length in np.unique(lengths):
            same = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, "right")]
            step = max(1, ARCS // ((int(length) + 1) * self.longest))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                yield part, self._codes("".join(EDGE + words[k] for k in part.tolist())).reshape(len(part), -1)

    def marginals(self, words: list[str]) -> np.ndarray:
        """Of each word the log probability (natural) of all its ways together."""
        out = np.zeros(len(words))
        for part, codes in self._blocks(words):
            out[part] = self._forward(self._arcs(codes)[1])[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece, and bytes, occur in ``counts`` of each word, by the probabilities of its ways: forward and backward recursion."""
        total = np.zeros(len(self.weights))
        for part, codes in self._blocks(words):
            ids, logs, size = self._arcs(codes)
            forward = self._forward(logs)
            n, m = logs[0].shape
            backward = np.zeros((n, m + 1))
            for i in range(m - 1, -1, -1):
                backward[:, i] = _log_sum([logs[k][:, i] + backward[:, i + k + 1] for k in range(min(m - i, len(logs)))])
            for k, (piece, log) in enumerate(zip(ids, logs, strict=True)):
                share = np.exp(forward[:, : m - k] + log + backward[:, k + 1 :] - forward[:, -1:]) * counts[part, None]
                known = piece >= 0
                total += np.bincount(piece[known], share[known], len(total))
                if not k:
                    total[-2] += (share * size)[~known].sum()
        return total


#: Arcs of a block of words that are held at once.
ARCS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    x = np.stack(parts)
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def _count(batches: Iterator[pa.RecordBatch], pieces: Pieces, limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple[int, float]] = {}
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, 4 << 20):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if len(known) > limit:
                known.clear()
            fresh = {w for ws in texts for w in ws if w not in known}
            names = {w: w.decode("utf-8", "replace") for w in fresh}
            got = pieces.counts(set(names.values()), bytes_apart=True)
            known.update((w, got[name]) for w, name in names.items())
            found = [[known[w] for w in ws] for ws in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(map(len, texts), pa.int64()), pa.array([sum(x[0] for x in f) for f in found], pa.int64()), pa.array([math.fsum(x[1] for x in f) for f in found], pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "log_score"],
            )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, log_score of each row of ``docs``: words are what ASCII white space parts, tokens the pieces of their best segmentations (of a sign without a piece, its bytes), and log_score their natural log probability. Null and empty texts have none; repeated rows stay; an empty table gives an empty result. A text and a word of any length are counted whole."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))  # of the vocabulary's fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, log_score double"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(_count(batches, pieces.value)), schema)
