"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding joins two hashed halves, so two words share it only if both hashes meet.
Filters of several widths slide over the words; the strongest response of each in the whole
document, however long, decides. All labelled rows are learned from, in shards of bounded size that
start each round from the same net and whose steps are averaged by Spark. Per-language thresholds
(language as recognised in the text) are set on rows kept out of the training, and scores are scaled
so that 0.5 is the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequery.llm import language
from cinequery.llm.common import bounded_sample, cut, mix, released, text_blocks, words

#: Buckets of each hash, numbers of each half, filter widths, filters of each width.
BUCKETS, HALF, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 12
#: Share of rows kept out for thresholds, rows a step, step size.
CALIBRATE, BATCH, RATE = 0.25, 32, 0.08
#: Rounds of training, and in each the passes of a single shard and of one of several.
ROUNDS, ALONE, AMONG = 3, 2, 1
#: Rows and bytes of text of a shard; four bytes a word are held.
SHARD_ROWS, SHARD_BYTES = 8_000, 32 << 20
#: Bytes of text scored at once: the steps of a block's longest text are shared by more rows.
SCORE_BYTES = 2 << 20
#: Numbers of a vector that are summed together, and steps of a log odd that thresholds tell apart.
BLOCK, STEPS = 1 << 13, 1000
#: Pseudo-documents that pull a bucket's first embedding number, its log odds, to none.
SMOOTH = 20.0
#: Positives that a language needs for a threshold of its own.
ENOUGH = 20


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and both buckets of each word; the second half's buckets follow the first's."""
    row, h, _ = words(data, offsets)
    first = (h & np.uint64(BUCKETS - 1)).astype(np.int32)
    second = (mix(h + np.uint64(1)) & np.uint64(BUCKETS - 1)).astype(np.int32) + BUCKETS
    return row, first, second


@dataclass
class Net:
    table: np.ndarray  # 2 * BUCKETS rows of HALF numbers
    filters: list[np.ndarray]  # of each width: width, 2 * HALF, FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    def responses(self, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and filter the strongest response and its place; a row without words responds with 0 at -1. A window past the row's end sees nothing there."""
        n = len(size)
        best, place = np.zeros((n, len(self.bias)), np.float32), np.full((n, len(self.bias)), -1, np.int64)
        full = np.flatnonzero(size)
        if not len(full):
            return best, place
        x = np.concatenate([self.table[first], self.table[second]], 1)
        begin = (np.cumsum(size) - size)[full]
        left = np.repeat(begin + size[full], size[full]) - np.arange(len(x))
        for i, w in enumerate(self.filters):
            z = x @ w[0]
            for k in range(1, len(w)):
                z[:-k] += (x[k:] @ w[k]) * (left[:-k] > k)[:, None]
            top = np.maximum.reduceat(z, begin, axis=0)
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best[full, cols] = top
            hit = z == np.repeat(top, size[full], axis=0)
            at = np.where(hit, np.arange(len(z))[:, None], len(z))
            place[full, cols] = np.minimum.reduceat(at, begin, axis=0)
        return best, place

    def probability(self, best: np.ndarray) -> np.ndarray:
        active = np.maximum(best + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(active @ self.out + self.shift, -30, 30)))


def shapes() -> list[tuple[int, ...]]:
    """Of a net's numbers: table, filters, bias, out, shift."""
    n = len(WIDTHS) * FILTERS
    return [(2 * BUCKETS, HALF), *((w, 2 * HALF, FILTERS) for w in WIDTHS), (n,), (n,), (1,)]


def parts_of(flat: np.ndarray) -> list[np.ndarray]:
    """The views of a flat vector that ``shapes`` names."""
    ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes())])
    return [flat[a:b].reshape(x) for a, b, x in zip(ends[:-1], ends[1:], shapes(), strict=True)]


def net_of(flat: np.ndarray) -> Net:
    table, *filters, bias, out, shift = parts_of(flat)
    return Net(table, filters, bias, out, float(shift[0]))


def begun(seen: np.ndarray, toxic: np.ndarray, share: float, seed: int = 7) -> np.ndarray:
    """A net to start from, flat: small random numbers, and in each bucket's first the log odds of the documents that hold it."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(x)) for x in shapes()), np.float32)
    table, *filters, bias, out, shift = parts_of(flat)
    p = (toxic + SMOOTH * share) / (seen + SMOOTH)
    table[:] = rng.normal(0, 0.05, table.shape)
    table[:, 0] = np.log(p / (1 - p)) - np.log(share / (1 - share))
    for w in filters:
        w[:] = rng.normal(0, 0.1, w.shape)
        w[0, 0] += 0.4
        w[0, HALF] += 0.4
    bias[:], out[:], shift[:] = -0.5, 0.15, -2.0
    return flat


def train(flat: np.ndarray, grown: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, share: float, passes: int, seed: int) -> None:
    """Changes a flat net and its sums of squared gradients. docs: of each the two bucket rows (2, words). Adagrad on the log loss, both classes weighted alike; gradients touch only the words that won a maximum."""
    rng = np.random.default_rng(seed)
    net, sums = net_of(flat), parts_of(grown)
    table, filters, shift = net.table, net.filters, parts_of(flat)[-1]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))

    def step(x: np.ndarray, g: np.ndarray, k: int) -> None:
        sums[k] += g * g
        x -= RATE * g / np.sqrt(sums[k])

    for _ in range(passes):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), BATCH):
            chosen = order[b : b + BATCH]
            size = np.array([docs[i].shape[1] for i in chosen])
            both = np.concatenate([docs[i] for i in chosen], 1)
            best, place = net.responses(both[0], both[1], size)
            active = np.maximum(best + net.bias, 0)
            error = ((net.probability(best) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = error[:, None] * net.out * (active > 0) * (place >= 0)
            ends = np.cumsum(size)[:, None]
            touched, pull = [], []
            for i, w in enumerate(filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                grad = np.zeros_like(w)
                for k in range(len(w)):
                    at = place[:, cols] + k
                    ok = (place[:, cols] >= 0) & (at < ends) & (back[:, cols] != 0)
                    r, f = np.nonzero(ok)
                    if not len(r):
                        continue
                    word, g = at[r, f], back[:, cols][r, f][:, None]
                    x = np.concatenate([table[both[0][word]], table[both[1][word]]], 1)
                    np.add.at(grad[k].T, f, x * g)
                    d = g * w[k].T[f]
                    touched += [both[0][word], both[1][word]]
                    pull += [d[:, :HALF], d[:, HALF:]]
                step(w, grad, i + 1)
            step(net.bias, back.sum(0), len(filters) + 1)
            step(net.out, active.T @ error, len(filters) + 2)
            step(shift, error.sum(keepdims=True), len(filters) + 3)
            net.shift = float(shift[0])
            if touched:
                u, which = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(u), HALF), np.float32)
                np.add.at(g, which, np.concatenate(pull))
                sums[0][u] += g * g
                table[u] -= RATE * g / np.sqrt(sums[0][u])


def threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Between the two probabilities where the F1 measure is greatest; the middle of the widest gap among equals. With ``n``, y positives of n rows share a probability."""
    order = np.argsort(-p, kind="stable")
    p, y, n = p[order], y[order], np.ones(len(p)) if n is None else n[order]
    hits = np.cumsum(y)
    below = np.append(p[1:], 0.0)
    f1 = 2 * hits / (np.cumsum(n) + y.sum())
    f1[p == below] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((p - below)[best])]
    return float(np.clip((p[k] + below[k]) / 2, 1e-6, 1 - 1e-6))


@dataclass
class Classifier:
    net: Net
    languages: language.Model
    thresholds: dict[str, float]  # "" for all others

    def score(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, first, second = hashed(data, offsets)
        best, _ = self.net.responses(first, second, np.bincount(row, minlength=len(offsets) - 1))
        p = self.net.probability(best).astype(np.float64)
        names = self.languages.languages_of(texts)
        t = np.array([self.thresholds.get(x, self.thresholds[""]) for x in names])
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _features(batches: Iterator[pa.RecordBatch], model: language.Model) -> Iterator[pa.RecordBatch]:
    """The words' buckets of labelled texts, and the language of those kept out of the training."""
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, language.BLOCK_BYTES):
            row, first, second = hashed(data, offsets)
            cut_at = np.searchsorted(row, np.arange(len(rows) + 1))
            texts = _texts(data, offsets)
            aside = rows.column(rows.schema.get_field_index("aside")).to_pylist()
            found = iter(model.languages_of([t for t, a in zip(texts, aside, strict=True) if a]))
            names = [next(found) if a else None for a in aside]
            both = np.stack([first, second - BUCKETS]).astype(np.uint16)
            grams = [both[:, a:b].tobytes() for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "toxic", "aside")] + [pa.array(names, pa.string()), pa.array(grams, pa.binary())], names=["doc_id", "toxic", "aside", "lang", "grams"])


def _buckets(grams: bytes) -> np.ndarray:
    both = np.frombuffer(grams, np.uint16).reshape(2, -1).astype(np.int32)
    both[1] += BUCKETS
    return both


def _shard(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """A partition's documents and labels in order of doc_id."""
    rows = sorted((r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), key=lambda r: r[0])
    return [_buckets(r[2]) for r in rows], np.array([r[1] for r in rows], np.int64)


def summed(rows: DataFrame, vectors: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]], many: int) -> list[np.ndarray]:
    """The sums over partitions of the ``many`` vectors, equally long, that ``vectors`` makes of each: blocks of them are added by executors, and what reaches the driver is one vector's length each."""
    from pyspark import TaskContext

    names = [f"v{i}" for i in range(many)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [v.astype(np.float32) for v in vectors(batches)]
        part = TaskContext.get().partitionId()
        for block, at in enumerate(range(0, len(made[0]) if made else 0, BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), *(pa.array([v[at : at + BLOCK].tobytes()], pa.binary()) for v in made)], names=["block", "part", *names])

    def added(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        sums = [sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group.column(n).to_pylist()) for n in names]
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, sums, strict=True)}})

    fields = ", ".join(f"{n} binary" for n in names)
    done = rows.mapInArrow(lambda batches: released(blocks(batches)), f"block int, part int, {fields}").groupBy("block").applyInArrow(added, f"block int, {fields}").toPandas().sort_values("block")
    return [np.concatenate([np.frombuffer(x, np.float64) for x in done[n]]) if len(done) else np.zeros(0) for n in names]


def _held(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """Of each bucket the documents that hold it, and the toxic ones."""
    seen, toxic = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for d, y in zip(*_shard(batches), strict=True):
        u = np.unique(d)
        seen[u] += 1
        toxic[u] += y
    return [seen, toxic]


def trained(rows: DataFrame, share: float, shards: int) -> Net:
    """A net of (doc_id, toxic, grams), a shard each partition. In each round all shards go on from the same net; a number's new value is the mean over the shards that moved it."""
    context = rows.sparkSession.sparkContext
    flat = begun(*summed(rows, _held, 2), share)
    grown = np.full(len(flat), 1e-2, np.float32)
    for turn in range(ROUNDS):
        state = context.broadcast((flat, grown))  # of fixed size

        def moved(batches: Iterator[pa.RecordBatch], state=state, turn=turn) -> list[np.ndarray]:
            docs, labels = _shard(batches)
            if not docs:
                return []
            before, sums = state.value
            flat, grown = before.copy(), sums.copy()
            train(flat, grown, docs, labels, share, ALONE if shards == 1 else AMONG, turn)
            return [flat - before, grown - sums, grown != sums]

        by, more, shared = summed(rows, moved, 3)
        flat = (flat + by / np.maximum(shared, 1)).astype(np.float32)
        grown = (grown + more / np.maximum(shared, 1)).astype(np.float32)
        state.destroy()
    return net_of(flat)


def _odds(batches: Iterator[pa.RecordBatch], net: Net) -> Iterator[pa.RecordBatch]:
    """Of rows kept out (toxic, lang, grams): lang, toxic and the log odds in STEPS."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            toxic, lang, grams = batch.slice(at, 64).columns
            docs = [_buckets(x) for x in grams.to_pylist()]
            p = net.probability(net.responses(*np.concatenate(docs, 1), np.array([d.shape[1] for d in docs]))[0]).astype(np.float64)
            p = np.clip(p, 1e-12, 1 - 1e-12)
            yield pa.RecordBatch.from_arrays([lang, toxic, pa.array(np.round(np.log(p / (1 - p)) * STEPS).astype(np.int64))], names=["lang", "toxic", "odds"])


def fit(docs: DataFrame, labels: DataFrame, languages: language.Model, fit_rows: int | None = None, fit_bytes: int | None = None) -> Classifier:
    """Trains on all labelled texts; a caller may bound their number and bytes to about ``fit_rows`` and ``fit_bytes``, chosen by a hash of doc_id. Their texts become hashed words on the executors and stay there; sums of the shards' vectors and counts by language and log odds reach the driver.

    Of a doc_id labelled several times the greatest label counts, and of several texts the first in
    order; null labels are none. Without rows of both classes every text scores 0.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if fit_rows is not None:
        known = bounded_sample(known, "doc_id", fit_rows)
    model = docs.sparkSession.sparkContext.broadcast(languages)
    total = docs.select("doc_id", F.octet_length("text").alias("n")).join(known, "doc_id").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    if fit_bytes is not None and total.bytes > fit_bytes:
        known = known.where(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 32)) < int(fit_bytes / total.bytes * (1 << 32)))
    shards = max(1, -(-total.rows // SHARD_ROWS), -(-total.bytes // SHARD_BYTES))
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(1 << 32)) < int(CALIBRATE * (1 << 32))
    # Both sides are dealt into the shards, so that the rows are where they are learned from after one shuffle; Spark may have dealt them into more.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(shards, "doc_id").join(known.repartition(shards, "doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("aside", aside)
    made = texts.mapInArrow(lambda batches: released(_features(batches, model.value)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, aside boolean, lang string, grams binary")
    rows = cut(made.coalesce(shards))
    n = {r.aside: (r.n, r.toxic) for r in rows.groupBy("aside").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    every, positive = (sum(x) for x in zip(*n.values(), strict=True)) if n else (0, 0)
    if not 0 < positive < every:
        net = Net(np.zeros((2 * BUCKETS, HALF), np.float32), [np.zeros((w, 2 * HALF, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), -30.0 if not positive else 30.0)
        return Classifier(net, languages, {"": 0.5})
    apart = all(0 < n.get(side, (0, 0))[1] < n.get(side, (0, 0))[0] for side in (True, False))
    learned, kept = (rows.where("NOT aside"), rows.where("aside")) if apart else (rows, rows)
    size, toxic = n[False] if apart else (every, positive)
    net = trained(learned.select("doc_id", "toxic", "grams"), max(toxic / size, 1e-3), shards)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    counts = kept.select("toxic", "lang", "grams").mapInArrow(lambda batches: released(_odds(batches, sent.value)), "lang string, toxic int, odds long")
    counts = counts.groupBy("lang", "odds").agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).toPandas().sort_values(["odds", "lang"])
    p = lambda some: 1 / (1 + np.exp(-some["odds"].to_numpy() / STEPS))
    best = lambda some: threshold(p(some), some["y"].to_numpy(np.int64), some["n"].to_numpy(np.int64))
    thresholds = {"": best(counts.groupby("odds", as_index=False)[["n", "y"]].sum())}
    for name, some in counts.groupby("lang"):
        if some["y"].sum() >= ENOUGH:
            thresholds[name] = best(some)
    return Classifier(net, languages, thresholds)


def _score(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch, SCORE_BYTES):
            score = model.score(_texts(data, offsets), data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs``, from the text alone; null and wordless texts get the score of no word. Repeated rows are scored each, an empty table gives an empty result; of a text of any length each filter's strongest response counts."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(_score(batches, known.value)), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
