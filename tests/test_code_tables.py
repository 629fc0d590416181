"""The profiles' codes are complete, equal known look-ups, and frames written with them decode to what was written."""

import numpy as np
import pytest

from cinequery.operators import code_tables as T
from cinequery.operators import frame_decode as D
from cinequery.operators.decode import CodeTable
from cinequery.sources import coded


def looked_up(codes, prefix):
    t = CodeTable(codes)
    return (int(t.length[prefix]) - 1) << 12 | int(t.symbol[prefix]) + 1


@pytest.mark.parametrize("cid", sorted(T.TABLES))
def test_codes_are_complete(cid):
    t = T.TABLES[cid]
    assert all(T.complete(codes) for codes in (t.dc, t.ac, t.run))
    assert sorted(t.levels) == sorted([(0, 0), *((level, flags) for level in range(3, 130, 2) for flags in range(4))])
    assert len(t.ac) == 257 and t.levels[t.end] == (0, 0) and sorted(t.runs) == list(range(1, 63)) and len(t.run) == 62
    assert len(t.luma) == len(t.chroma) == 64 and t.luma[:2] == t.chroma[:2] == [0, 32]


def test_known_look_ups():
    t = T.TABLES[1237]
    assert [looked_up(t.dc, p) for p in (0, 1, 0x8000)] == [8193, 8193, 8199]
    assert [looked_up(t.ac, p) for p in (0, 0x8000)] == [4097, 8195] and looked_up(t.run, 0) == 1 and t.runs[0] == 1


def test_incomplete_codes_are_told():
    assert T.complete([(0, 1), (2, 2), (3, 2)]) and not T.complete([(0, 1), (2, 2)]) and not T.complete([(0, 1), (1, 2), (3, 2), (2, 2)])
    assert T.canonical([0, 2, 1, 2]) == [(0, 2), (1, 2), (4, 3), (10, 4), (11, 4)]


@pytest.mark.parametrize("k", range(len(coded.KINDS)))
def test_every_symbol_goes_through(k):
    """All levels with and without run and extra bits, all runs, all sizes of differences, at several scales."""
    kind = coded.KINDS[k]
    w, t = coded.Writer(T.TABLES[kind.cid], kind), T.TABLES[kind.cid].at_depth(kind.depth, kind.is444)
    rng = np.random.default_rng(k)
    blocks, want = [], []
    most = len(t.dc) - 1
    for n in range(kind.blocks):
        delta = int(rng.integers(-(1 << most) + 1, 1 << most)) if n % 2 else [0, 1, -1][n // 2 % 3]
        at, symbols = 0, []
        while True:
            run = int(rng.choice([0, 0, 0, 1, 5, 40]))
            if at + run + 1 > 63:
                break
            at += run + 1
            symbols.append((run, int(rng.integers(1, 65)) * 2 + 1, int(rng.choice([0, 0, 1, (1 << t.index_bits) - 1])), int(rng.integers(2)), at))
        blocks.append((delta, [s[:4] for s in symbols]))
        want.append(symbols)
    width = -(-kind.width // 16)
    raw = w.row(w.macroblock(37, kind.mbaff, blocks), width)
    out, crossed, done, code = D.decode_rows([raw], T.TABLES[kind.cid], width, kind.depth, kind.is444, kind.mbaff)
    assert code.tolist() == [0] and done.tolist() == [width] and crossed[0, 0] == kind.mbaff
    last = [1 << (kind.depth + 2)] * 3
    for n, (delta, _) in enumerate(blocks):
        c = (n >> 1) % 3 if kind.is444 else (1 + (n & 1) if n & 2 else 0)
        last[c] += delta * (4 if kind.depth == 12 else 1)
        weights = t.chroma if c else t.luma
        expected = np.zeros(64, np.int64)
        expected[0] = last[c]
        for _, base, extra, minus, at in want[n]:
            s = 37 * weights[at]
            v = ((base + (extra << 7)) * s + (s >> 1) + (t.bias if t.bias < 32 or weights[at] != t.bias else 0)) >> t.shift
            expected[D.ZIGZAG[at]] = -v if minus else v
        assert out[0, n].tolist() == expected.tolist()


def test_cut_rows_are_faults(spark):
    w = coded.Writer(T.TABLES[1274], coded.KINDS[0])
    raw = w.row(w.macroblock(3, False, [(5, [(0, 129, 0, 1), (62, 3, 0, 0)][:1])] * 8), 1)
    for size in range(len(raw) - 1):
        _, _, _, code = D.decode_rows([raw[:size]], T.TABLES[1274], 1, 8, False, False)
        assert code[0] in (2, 4, 5, 6, 7, 8, 10)
