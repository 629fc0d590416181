"""A manifest of a dataset as Merkle trees: one a language over its rows in order, and one over these.

Rows are placed by a range sort, cut into aligned blocks, and each block's authentication paths come
from a fractal traversal: of each level of subtrees it holds the one that the present leaf is in
(existing) and builds the one to its right (desired) by two steps of tree hashing a leaf, so memory
is a few subtrees whatever the block. Blocks' roots are placed and walked in the same way, and their
paths are joined to the rows as upper proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.llm.common import cut, released, remainder

#: Levels of a block, and of the subtrees in which it is walked.
BLOCK, SUBTREE = 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(left: bytes | None, right: bytes | None) -> bytes | None:
    """The digest of a run of two digests, or of one alone; null without either."""
    if left is None:
        return None
    return sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


class Growing:
    """A subtree under way: the nodes of its levels, and the stack of tree hashing over the leaves below it."""

    def __init__(self, leaves: list[bytes], root: int, low: int, high: int) -> None:
        """Of the node number ``root`` at level ``high``, the levels from ``low`` to below ``high``."""
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.past = root << high, (root + 1) << high
        self.stack: list[tuple[int, int, bytes | None]] = []  # level, number, digest
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.top: bytes | None = None

    def step(self) -> bool:
        """One unit of work, a leaf or a join; false once the subtree is whole."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            (level, _, right), (_, number, left) = s.pop(), s.pop()
            self._put(level + 1, number >> 1, joined(left, right))
        elif self.next < self.past:
            self._put(0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
            self.next += 1
        else:
            return False
        return True

    def _put(self, level: int, number: int, digest: bytes | None) -> None:
        self.stack.append((level, number, digest))
        if level == self.high:
            self.top = digest
        elif level >= self.low and digest is not None:
            self.nodes[level, number] = digest

    def whole(self) -> Growing:
        while self.step():
            pass
        return self


def height(leaves: int) -> int:
    """Levels above the leaves of a tree of its own."""
    return max(0, leaves - 1).bit_length()


def traverse(leaves: list[bytes], levels: int, subtree: int = SUBTREE) -> Iterator[tuple[list[bytes | None], bytes]]:
    """Of each leaf in turn: its siblings level by level, null where it has none, and the root.

    Per band of levels one existing and one desired subtree are held, each of fewer than
    ``2 << subtree`` nodes with a stack of one node a level.
    """
    bands = [(low, min(low + subtree, levels)) for low in range(0, levels, subtree)]
    if not bands:
        yield [], leaves[0]
        return
    existing = [Growing(leaves, 0, low, high).whole() for low, high in bands]
    root = existing[-1].top
    desired = [Growing(leaves, 1, low, high) for low, high in bands[:-1]]
    for leaf in range(len(leaves)):
        yield [existing[k // subtree].nodes.get((k, (leaf >> k) ^ 1)) for k in range(levels)], root
        for band, (low, high) in enumerate(bands[:-1]):
            desired[band].step()
            desired[band].step()
            if (leaf + 1) & ((1 << high) - 1) == 0:
                existing[band] = desired[band].whole()  # it is by now: two steps a leaf are enough
                desired[band] = Growing(leaves, ((leaf + 1) >> high) + 1, low, high)


def _walked(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Each row with its path and its block's root; rows come by tree and position, so a block's rows are together."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        leaves = rows.column("digest").to_pylist()
        total = rows.column("total")[0].as_py()
        found = list(traverse(leaves, height(total) if total <= 1 << block else block))
        paths = pa.array([p for p, _ in found], pa.list_(pa.binary()))
        roots = pa.array([r for _, r in found], pa.binary())
        return rows.append_column("path", paths).append_column("block_root", roots).to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(batch.schema.get_field_index("tree")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        number = batch.column(batch.schema.get_field_index("position")).to_numpy() >> block
        first = np.flatnonzero((tree[1:] != tree[:-1]) | (number[1:] != number[:-1])) + 1
        if held and (held[-1].column("tree")[-1] != batch.column("tree")[0] or held[-1].column("position")[-1].as_py() >> block != number[0]):
            yield out(pa.Table.from_batches(held))
            held = []
        borders = [0, *first.tolist(), batch.num_rows]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield out(pa.Table.from_batches(held))
                held = []
    if held:
        yield out(pa.Table.from_batches(held))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with position, their number within their tree by ``order``, and total, its rows.

    A range sort deals them out; each part's rows are numbered from the sum of the parts before.
    Equal rows are told apart by a number, so no part has to take all of them.
    """
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "row").sortWithinPartitions("tree", *order, "row")
    ranged = cut(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    parts = ranged.groupBy("tree", "part").agg(F.min("row").alias("least"), F.count("*").alias("many"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("tree", "part", (before - F.col("least")).alias("from"), F.sum("many").over(tree).alias("total"))
    return ranged.join(starts, ["tree", "part"]).withColumn("position", F.col("row") + F.col("from")).drop("row", "part", "from")


def walked(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes`` (tree, position, total, digest, ...) with path, their siblings within their block of 2^block nodes, and block_root."""
    dealt = nodes.withColumn("block", F.shiftright("position", block)).repartition("tree", "block").sortWithinPartitions("tree", "position")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", path array<binary>, block_root binary"
    return cut(dealt.mapInArrow(lambda batches: released(_walked(batches, block)), schema))


def rooted(nodes: DataFrame, block: int) -> DataFrame:
    """``nodes`` (tree, position, total, digest, ...) with path, the siblings up to their tree's root, and tree_root.

    As many rounds as the largest tree has levels of blocks; each takes one node of 2^block to the next.
    """
    inside = walked(nodes, block)
    ends = inside.where(F.col("position") % (1 << block) == 0).select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / (1 << block)).alias("total"), F.col("block_root").alias("digest"))
    alone = ends.where("total = 1").select("tree", F.col("position").alias("block"), F.array().cast("array<binary>").alias("above"), F.col("digest").alias("tree_root"))
    more = ends.where("total > 1")
    if more.isEmpty():
        upper = alone
    else:
        upper = alone.unionByName(rooted(more, block).select("tree", F.col("position").alias("block"), F.col("path").alias("above"), "tree_root"))
    return inside.join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "above")).drop("block", "block_root", "above")


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _field(x: Column) -> Column:
    x = x.cast("string")
    return F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its bytes' number, ``:`` and itself."""
    return _digest(F.concat(*(_field((changed or {}).get(c, F.col(c))) for c in FIELDS)))


def folded(first: Column, path: Column, position: Column) -> Column:
    """The root that a digest leads to by its siblings: at each level the node stands right if its number is odd, and alone where the sibling is null."""
    start = F.struct(_hex(first).alias("acc"), position.cast("long").alias("at"))

    def up(s: Column, sibling: Column) -> Column:
        other = F.coalesce(_hex(sibling), F.lit(""))
        both = F.when(s["at"] % 2 == 1, F.concat(other, s["acc"])).otherwise(F.concat(s["acc"], other))
        return F.struct(F.sha2(both, 256).alias("acc"), F.shiftright(s["at"], 1).alias("at"))

    return F.aggregate(path, start, up, lambda s: s["acc"])


def manifest(docs: DataFrame, *extra: str, block: int = BLOCK) -> DataFrame:
    """doc_id, lang, position, digest (the leaf), path, subroot, lang_position, lang_path, root, and ``extra`` columns, of each row.

    Per lang, null one of its own and first, rows stand by doc_id, null first, rows with equal ids
    by their leaves. Wholly equal rows are leaves of their own. Any text is hashed whole in the JVM.
    An empty table has no rows and no root. Of other columns those named ``extra`` are carried.
    """
    named = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf().alias("digest"), *extra)
    rows = placed(named.withColumn("tree", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))), "doc_id", "digest")
    inside = walked(rows, block)
    ends = inside.where(F.col("position") % (1 << block) == 0).select("tree", F.col("block").alias("position"), F.ceil(F.col("total") / (1 << block)).alias("total"), F.col("block_root").alias("digest"))
    upper = rooted(ends, block).select("tree", F.col("position").alias("block"), F.col("path").alias("above"), F.col("tree_root").alias("subroot"))
    trees = upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("digest"))
    top = rooted(placed(trees, "of"), block).select(F.col("of").alias("tree"), F.col("position").alias("lang_position"), F.col("path").alias("lang_path"), F.col("tree_root").alias("root"))
    # Blocks take their language's proof first, so that rows are joined by block and no key is a whole language.
    proofs = upper.join(top, "tree")
    found = inside.join(proofs, ["tree", "block"]).withColumn("path", F.concat("path", "above"))
    return found.select("doc_id", "lang", "position", "digest", "path", "subroot", "lang_position", "lang_path", "root", *extra)


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest as hexadecimal digests, and each row verified against the root: from its original leaf, or where 7 divides the id's crc32, from one whose n_chars is one more.

    proof_sha256 is the digest of the siblings on the way to the root, of none that of the empty
    text. A null id counts as the empty text, so 7 divides its crc32; a null n_chars stays null, so
    its row is verified.
    """
    more = F.when(F.col("n_chars").isNotNull(), F.col("n_chars").cast("decimal(38,0)") + 1)
    altered = F.when(remainder("doc_id", 7) == 0, leaf({"n_chars": more})).alias("altered leaf")
    found = manifest(docs.select(*FIELDS, altered), "altered leaf", block=block)
    siblings = F.filter(F.concat("path", "lang_path"), lambda x: x.isNotNull())
    proof = F.sha2(F.array_join(F.transform(siblings, _hex), ""), 256)
    subroot = folded(F.coalesce("altered leaf", "digest"), F.col("path"), F.col("position"))
    found = found.withColumn("root reached", folded(F.unhex(subroot), F.col("lang_path"), F.col("lang_position")))
    return found.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), proof.alias("proof_sha256"), F.col("root reached").alias("folded_root"), (F.col("root reached") == _hex(F.col("root"))).alias("verified"))
