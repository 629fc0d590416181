"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors near a border stand in several lists. Centroids are found through an in-memory graph, and
a query visits the lists whose centroid is within a ratio of the nearest one's distance, a number
of them at most; both are set on a bounded sample so that its true neighbours are covered. The
nearest few lists are searched first, and give each query a bound: from the others only vectors
that reach it are passed on, so what is passed on follows the queries and not the lists. Lists are
dealt out in blocks of bounded size, so neither a long list nor a repeated vector fills one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.common import bounded_sample, cut

#: Vectors to fit on at most, lists at most (unless told otherwise as many as the root of the vectors), copies of a vector at most.
SAMPLE, LISTS, COPIES = 20_000, 4096, 4
#: Lists of a sample vector on average, besides its nearest: sets how much farther a list's centroid may be to hold it too.
EXTRA = 2.5
#: Share of the sample's true neighbours that the ratio and the number of lists must cover together.
COVER = 0.97
#: Lists that give a query its bound.
FIRST = 8
#: Vectors and queries of a block.
BLOCK, QUERIES = 16_384, 8192
#: Share of a bound by which a score may stay under it, for the rounding of sums.
SLACK = 1e-12
#: Shares of the greatest norm: centres this near are one, and a query this near to a centre counts as at it (the extra dimension is a root, so its rounding is that of half the digits).
SAME, AT = 1e-9, 1e-6


@dataclass
class Centroids:
    """List centres with a navigable graph: nearest neighbours, and a few far links from seeded draws."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    radius: float  # the greatest norm, for the extra dimension that turns products into distances
    border: float = 1.0  # a vector stands in lists whose centroid is within this ratio of its nearest one's distance
    ratio: float = 1.0  # a query visits such lists
    width: int = FIRST  # and no more of them

    @classmethod
    def build(cls, points: np.ndarray, radius: float, near: int = 24, far: int = 8, seed: int = 3) -> Centroids:
        rng = np.random.default_rng(seed)
        n = len(points)
        close = []
        for at in range(0, n, 512):
            d = _squares(points[at : at + 512], points)
            close.append(np.argsort(d, axis=1, kind="stable")[:, : min(near, n)])
        links = np.concatenate([np.concatenate(close), rng.integers(0, n, (n, far))], 1)
        return cls(points, links, rng.choice(n, min(n, 16), replace=False), radius)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """With one more number, all stored vectors have the same norm, so the nearest is the one of largest product."""
        rest = np.maximum(self.radius**2 - (vectors**2).sum(1), 0)
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)

    def flat(self, queries: np.ndarray) -> np.ndarray:
        """Queries scaled to the stored norm, with nothing on the extra dimension."""
        scale = self.radius / np.sqrt((queries**2).sum(1, keepdims=True))
        return np.concatenate([queries * scale, np.zeros((len(queries), 1))], 1)

    def base(self, d: np.ndarray) -> np.ndarray:
        """Of each query's distances the least that its lists are measured by: the nearest centroid's, or at a centroid the next one's, where a ratio of nothing would reach no other list."""
        return np.where(d > AT * self.radius, d, np.inf).min(1, keepdims=True)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``width`` nearest centroids of each row, nearest first; all rows walk the graph in step, each widening from its best unvisited centroid."""
        n, k = len(x), min(width, len(self.points))
        found = np.full((n, k), -1, np.int64)
        dist = np.full((n, k), np.inf)
        open_ = np.zeros((n, k), bool)
        seen = np.zeros((n, len(self.points)), bool)
        rows = np.arange(n)

        def offer(who: np.ndarray, what: np.ndarray) -> None:
            fresh = ~seen[who[:, None], what]
            order = np.argsort(what, axis=1, kind="stable")  # of an id offered twice, once
            s = np.take_along_axis(what, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
            fresh &= ~twice
            seen[who[:, None], what] = True
            d = ((x[who][:, None, :] - self.points[what]) ** 2).sum(2)
            d[~fresh] = np.inf
            ids = np.concatenate([found[who], what], 1)
            all_d = np.concatenate([dist[who], d], 1)
            state = np.concatenate([open_[who], fresh], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :k]
            found[who], dist[who], open_[who] = (np.take_along_axis(a, best, 1) for a in (ids, all_d, state))

        offer(rows, np.broadcast_to(self.entries, (n, len(self.entries))).copy())
        live = rows
        while len(live):
            first = np.argmax(open_[live], axis=1)
            ok = open_[live, first]
            live, first = live[ok], first[ok]
            if len(live):
                at = found[live, first]
                open_[live, first] = False
                offer(live, self.links[at])
        return np.where(np.isfinite(dist), found, -1), np.sqrt(dist)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centres(x: np.ndarray, k: int, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """``k`` cluster means of near equal size: sets are halved again and again between two means, each half taking its share of the rows, and the means then settle in a few rounds."""
    rng = np.random.default_rng(seed)
    parts, centres = [(np.arange(len(x)), k)], []
    while parts:
        rows, n = parts.pop()
        if n == 1 or len(rows) < 2:
            centres += [x[rows].mean(0)] * n
            continue
        pair = x[rng.choice(rows, 2, replace=False)]
        share = (n + 1) // 2
        for _ in range(8):
            d = _squares(x[rows], pair)
            order = np.argsort(d[:, 0] - d[:, 1], kind="stable")
            cut_at = min(max(1, round(len(rows) * share / n)), len(rows) - 1)
            pair = np.stack([x[rows[order[:cut_at]]].mean(0), x[rows[order[cut_at:]]].mean(0)])
        parts += [(rows[order[:cut_at]], share), (rows[order[cut_at:]], n - share)]
    centres = np.stack(centres)
    for _ in range(rounds):
        which = np.concatenate([_squares(x[at : at + 2048], centres).argmin(1) for at in range(0, len(x), 2048)])
        for c in np.flatnonzero(np.bincount(which, minlength=k)):
            centres[c] = x[which == c].mean(0)
    return centres


def apart(centres: np.ndarray, radius: float) -> np.ndarray:
    """The centres, of coincident ones the first: equal vectors that fill several sets give as many equal means."""
    _, first = np.unique(np.round(centres / (SAME * radius)), axis=0, return_index=True)
    return centres[np.sort(first)]


def _ratios(d: np.ndarray) -> np.ndarray:
    """Distances after the first over the first. A vector at its centre has no ratio, save to centres that it is at as well: 1."""
    near, further = np.broadcast_to(d[:, :1], d[:, 1:].shape), d[:, 1:]
    none = near == 0
    return np.where(none, 1.0, further / np.where(none, 1.0, near))[~none | (further == 0)]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of rows that take part: not null, not zero, all components finite, and of the commonest length (of equally common ones the longest)."""
    rows = vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (common[0].n if common else 0))


def fit(rows: DataFrame, sample: int = SAMPLE, list_size: int | None = None) -> Centroids | None:
    """Centres, graph and bounds of a query's lists from about ``sample`` vectors at most, chosen by a hash of vec_id and vector; of equal rows one."""
    some = bounded_sample(rows, "vec_id", sample, "embedding").dropDuplicates().orderBy("vec_id", "embedding").toPandas()
    if not len(some):
        return None
    x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(embedding, 0D, (s, v) -> s + double(v) * v)")).alias("m")).first()
    radius = float(np.sqrt(stats.m))
    lifted = Centroids(np.zeros((1, 1)), np.zeros((1, 1), int), np.zeros(1, int), radius).lift(x)
    k = int(np.clip(round(stats.n / list_size if list_size else stats.n**0.5), 1, min(LISTS, max(1, len(x) // 8))))
    centroids = Centroids.build(apart(balanced_centres(lifted, k), radius), radius)
    _, d = _nearest(centroids, lifted)
    further = _ratios(d)
    centroids.border = float(np.quantile(further, min(1.0, EXTRA / (d.shape[1] - 1)))) if further.size else 1.0
    centroids.ratio, centroids.width = _query_bounds(centroids, x, lifted)
    return centroids


def _query_bounds(centroids: Centroids, x: np.ndarray, lifted: np.ndarray, top: int = 20, queries: int = 400) -> tuple[float, int]:
    """The ratio and the number of lists within which COVER of the sample's true neighbours have a list of theirs. Each may lose half of the rest."""
    lists, near = _lists(centroids, lifted)
    ratios, ranks = [], []
    for q in np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(top, len(x) - 1)]
        d = np.sqrt(((centroids.flat(x[q : q + 1]) - centroids.points) ** 2).sum(1))
        own = np.where(near[best], d[lists[best]], np.inf).min(1)
        ratios.append(np.maximum(own / centroids.base(d[None])[0], 1.0))
        ranks.append(np.searchsorted(np.sort(d), own, "right"))
    if not sum(map(len, ratios)):
        return 1.0, FIRST
    share = (1 + COVER) / 2
    return float(np.quantile(np.concatenate(ratios), share)) + 1e-9, max(FIRST, int(np.ceil(np.quantile(np.concatenate(ranks), share))))


def _nearest(centroids: Centroids, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector COPIES centroids and their distances, nearest first."""
    parts = [centroids.search(lifted[at : at + 1024], 4 * COPIES) for at in range(0, len(lifted), 1024)]
    return tuple(np.concatenate([p[i] for p in parts])[:, :COPIES] for i in (0, 1))


def _lists(centroids: Centroids, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector COPIES centroids, nearest first, and which of them hold it: the nearest always."""
    ids, d = _nearest(centroids, lifted)
    near = (d <= centroids.border * d[:, :1]) & (ids >= 0)
    near[:, 0] = True
    return ids, near


def _assign(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, near = _lists(centroids, centroids.lift(_matrix(part.column(1))))
            row, col = np.nonzero(near)
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[row, col].astype(np.int32))], names=[*part.schema.names, "list"])


def _probe(batches: Iterator[pa.RecordBatch], centroids: Centroids, sizes: np.ndarray, enough: int) -> Iterator[pa.RecordBatch]:
    """The lists within the ratio, ``width`` at most, and the next ones while those before hold fewer than ``enough`` postings; turn counts a query's lists, nearest first."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            x, width = centroids.flat(_matrix(part.column(1))), centroids.width
            while True:
                ids, d = centroids.search(x, width)
                held = np.where(ids >= 0, sizes[ids], 0)
                if width >= len(centroids.points) or (held.sum(1) >= enough).all():
                    break
                width *= 2
            before = np.cumsum(held, axis=1) - held
            within = (d <= centroids.ratio * centroids.base(d)) & (np.arange(d.shape[1]) < centroids.width)
            row, col = np.nonzero((within | (before < enough)) & (ids >= 0))
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(ids[row, col].astype(np.int32)), pa.array(col.astype(np.int32))], names=[*part.schema.names, "list", "turn"])


def _best(queries: pa.Table, vectors: pa.Table, top: int) -> pa.Table:
    """Of each query its ``top`` nearest of the vectors, those that reach its bound."""
    out: list[tuple[np.ndarray, ...]] = []
    if queries.num_rows and vectors.num_rows:
        vectors = vectors.sort_by("vec_id")
        ids, v = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"])
        who, q, bound = queries["vec_id"].to_numpy(), _matrix(queries["embedding"]), queries["bound"].to_numpy()
        for at in range(0, len(who), 64):
            s = np.einsum("qd,vd->qv", q[at : at + 64], v)
            s[who[at : at + 64, None] == ids[None, :]] = -np.inf
            s[s < bound[at : at + 64, None]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :top]
            score = np.take_along_axis(s, order, 1)
            r, c = np.nonzero(np.isfinite(score))
            out.append((who[at + r], ids[order[r, c]], score[r, c]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def _blocked(postings: DataFrame, probes: DataFrame, n: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (list, piece, block), each key with about BLOCK vectors and QUERIES queries (``n``: vectors of each list): vectors and queries of a list are dealt by id, and repeated for each part of the other side."""
    spark = postings.sparkSession
    m = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}  # LISTS rows at most
    sizes = F.broadcast(spark.createDataFrame([(k, -(-n[k] // BLOCK), -(-m[k] // QUERIES)) for k in n if k in m], "list int, pieces int, blocks int"))
    own = lambda parts: F.pmod(F.xxhash64("vec_id"), F.col(parts)).cast("int")
    all_ = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = probes.join(sizes, "list").withColumn("block", own("blocks")).withColumn("piece", all_("pieces"))
    right = postings.join(sizes, "list").withColumn("piece", own("pieces")).withColumn("block", all_("blocks"))
    return left.select("list", "piece", "block", "vec_id", "embedding", "bound"), right.select("list", "piece", "block", "vec_id", "embedding")


def _searched(postings: DataFrame, probes: DataFrame, n: dict[int, int], top: int) -> DataFrame:
    left, right = _blocked(postings, probes, n)
    key = ["list", "piece", "block"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lambda q, v: _best(q, v, top), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """Of each query the ``top`` nearest, each once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, sample: int = SAMPLE, list_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of ``queries`` (rows of ``vectors``) the ``top`` nearest found, its own id apart, nearest first, ties to the smaller id.

    score is the inner product of the original components in double precision. Rows that
    ``usable`` leaves out are neither searched nor found; of rows with equal ids and vectors one
    is found. Equal vectors are as near to any query, so of more than ``top`` + 1 ids with one
    vector those past the smallest can't be among its ``top`` nearest; each vector is indexed once
    with those. An empty table gives an empty result, as do no queries.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi") if queries is not vectors else rows
    centroids = fit(rows, sample, list_size)
    if centroids is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double").select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    known = spark.sparkContext.broadcast(centroids)  # LISTS centroids at most
    kind = rows.schema["embedding"].dataType.simpleString()
    rows, asked = (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for df in (rows, asked))
    among_equal = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    reachable = rows.dropDuplicates().withColumn("turn", among_equal).where(F.col("turn") <= top + 1).drop("turn")
    listed = f"vec_id long, embedding {kind}, list int"
    postings = cut(reachable.mapInArrow(lambda batches: _assign(batches, known.value), listed))
    n = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # LISTS rows at most
    sizes = np.array([n.get(k, 0) for k in range(len(centroids.points))], np.int64)
    enough = COPIES * (top + 1)  # postings of top other vectors at least, as each has COPIES at most
    probes = cut(asked.mapInArrow(lambda batches: _probe(batches, known.value, sizes, enough), f"{listed}, turn int"))
    first = cut(_ranked(_searched(postings, probes.where(F.col("turn") < FIRST).withColumn("bound", F.lit(-math.inf)), n, top), top))
    bounds = first.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), (F.col("score") - F.abs("score") * SLACK).alias("bound"))
    rest = probes.where(F.col("turn") >= FIRST).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
    return _ranked(first.drop("rank").unionByName(_searched(postings, rest, n, top)), top)


def _scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = pa.table({"vec_id": ids, "embedding": pa.array(list(q)), "bound": np.full(len(ids), -np.inf)})
        yield from _best(asked, pa.table(batch), top).to_batches()


def recall(vectors: DataFrame, found: DataFrame, top: int = 20, queries: int = 200) -> float:
    """Share of the true ``top`` nearest that ``found`` (of ``search``) holds, measured by brute force over all vectors for ``queries`` of its queries at most, chosen by a hash. Without any it is 1."""
    spark = vectors.sparkSession
    rows = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    some = found.select(F.col("query_id").alias("vec_id")).distinct().orderBy(F.xxhash64("vec_id")).limit(queries)
    asked = rows.join(F.broadcast(some), "vec_id").dropDuplicates(["vec_id"]).toPandas()
    if not len(asked):
        return 1.0
    ids, q = asked["vec_id"].to_numpy(np.int64), np.stack(asked["embedding"].to_numpy()).astype(np.float64)
    known = spark.sparkContext.broadcast((ids, q))  # ``queries`` vectors
    true = _ranked(rows.mapInArrow(lambda batches: _scan(batches, *known.value, top), "query_id long, vec_id long, score double"), top)
    met = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = met.agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return row.hits / row.n if row.n else 1.0
