import hashlib
import random
import zlib

import pytest

from cinequery.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, position string, path string, digest string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def up(nodes):
    return [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def way(nodes, at):
    """Siblings with their side, level by level, and the root."""
    steps = []
    while len(nodes) > 1:
        other = at ^ 1
        steps.append((other < at, nodes[other] if other < len(nodes) else None))
        nodes, at = up(nodes), at >> 1
    return steps, nodes[0]


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {x: sorted((r for r in rows if r[2] == x), key=order) for x in langs}
    subroots = [way([leaf(r) for r in trees[x]], 0)[1] for x in langs]
    out = []
    for k, lang in enumerate(langs):
        leaves = [leaf(r) for r in trees[lang]]
        for at, r in enumerate(trees[lang]):
            steps, subroot = way(leaves, at)
            more, root = way(subroots, k)
            steps += more
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            acc = leaf((*r[:3], r[3] + 1, r[4])) if tampered and r[3] is not None else leaf(r)
            for left, s in steps:
                acc = H(acc) if s is None else H(s, acc) if left else H(acc, s)
            out.append((r[0], leaf(r), subroot, root, H(*(s for _, s in steps if s)), acc, acc == root))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], DOCS)
    return sorted((tuple(r) for r in merkle.report(frame, **how).collect()), key=repr)


def corpus(n, langs=("en", "en", "en", "de", None, "fr", "")):
    rng = random.Random(n)
    rows = [(i * 3, f"s{i % 4}", rng.choice(langs), rng.choice([None, 1, 99]), "é漢" * (i % 5) + str(i)) for i in range(n)]
    rows += [(5, "a", "en", 1, "same"), (5, "a", "en", 1, "other"), (None, None, None, None, None), (None, "s", "en", 1, ""), (6, None, "de", None, "")]
    return rows + [(7, "a", "en", 1, "again")] * 9 + [(2**63 - 1, "a", "en", 2**63 - 1, "-")]


@pytest.mark.parametrize("n,block", [(0, 8), (40, 8), (150, 2), (90, 3), (700, 4)])
def test_equals_a_plain_tree(spark, n, block):
    rows = corpus(n)
    found = got(spark, rows, block=block)
    assert found == plain(rows) and {v for *_, v in found} == {True, False}


def test_one_row_and_one_language(spark):
    row = (4, "s", "en", 3, "abc")
    assert got(spark, [row]) == plain([row])
    (found,) = got(spark, [row])
    assert found[1] == found[2] == found[3] and found[4] == H()
    many = [(i, "s", "en", 3, "abc") for i in range(33)]
    assert got(spark, many, block=2) == plain(many)


def test_languages_in_byte_order(spark):
    rows = [(i, "s", lang, 1, "t") for i, lang in enumerate(["b", "B", "é", "z", "漢", "", None, "aa", "a"])]
    assert got(spark, rows, block=1) == plain(rows)


@pytest.mark.parametrize("subtree", [1, 2, 3, 5])
def test_traversal_equals_all_nodes(subtree):
    for n in [*range(1, 35), 64, 100]:
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        for levels in {merkle.height(n), 7} if n <= 128 else {merkle.height(n)}:
            nodes = [leaves]
            for _ in range(levels):
                last = nodes[-1]
                nodes.append([merkle.joined(last[i], last[i + 1] if i + 1 < len(last) else None) for i in range(0, len(last), 2)])
            want = [([nodes[k][(i >> k) ^ 1] if (i >> k) ^ 1 < len(nodes[k]) else None for k in range(levels)], nodes[-1][0]) for i in range(n)]
            assert list(merkle.traverse(leaves, levels, subtree)) == want


def test_traversal_holds_few_nodes(monkeypatch):
    alive, most = [], 0
    first = merkle.Growing.__init__

    def counted(self, *a):
        first(self, *a)
        alive.append(self)

    monkeypatch.setattr(merkle.Growing, "__init__", counted)
    leaves = [hashlib.sha256(i.to_bytes(2, "big")).digest() for i in range(1 << 10)]
    for _ in merkle.traverse(leaves, 10, 2):
        alive[:] = alive[-9:] if len(alive) > 40 else alive
        most = max(most, max(len(g.nodes) + len(g.stack) for g in alive))
    assert most <= (2 << 2) + 11  # a subtree and a stack, not the block's 2,047 nodes


def test_a_changed_text_changes_the_root(spark):
    rows = [(i, "s", "en", 3, f"text {i}") for i in range(20)]
    before = got(spark, rows, block=2)[0][3]
    assert got(spark, [*rows[:7], (7, "s", "en", 3, "text 8"), *rows[8:]], block=2)[0][3] != before
    assert got(spark, rows[::-1], block=2)[0][3] == before


def test_empty_table(spark):
    assert got(spark, []) == []
