"""The profiles' code tables: prefix codes built from the number of codes of each length, what symbols mean, and weights.

All codes but those of the constant term's differences are canonical: symbols by length, codes of a
length one after the other. The symbols of further coefficients are four series of odd levels,
3, 5, ... 129, one for each pair of flags, and the end of a block; a profile's table says how its code
goes through the series.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from cinequery.operators.frame_decode import RowTables

#: Fixed values. Codes of each length from 1 bit on, of the symbols of further coefficients.
AC_LENGTHS = {
    1235: [0, 2, 1, 2, 3, 4, 4, 6, 7, 10, 11, 16, 18, 22, 33, 118],
    1237: [0, 2, 2, 1, 2, 4, 2, 5, 5, 6, 8, 10, 11, 16, 17, 166],
    1238: [0, 2, 1, 2, 3, 4, 4, 6, 8, 9, 10, 14, 17, 25, 28, 124],
    1250: [0, 2, 1, 2, 3, 4, 4, 6, 7, 9, 12, 16, 21, 25, 35, 110],
    1251: [0, 2, 1, 2, 3, 4, 4, 6, 6, 10, 14, 15, 23, 26, 35, 106],
    1252: [0, 2, 1, 3, 2, 3, 3, 6, 5, 8, 10, 12, 15, 18, 23, 146],
}
#: Fixed values. The flags of the series that a code goes on with, and how many symbols it takes of it; END is the end of a block.
EXTRA, RUN, END = 1, 2, None
AC_ORDER = {
    1235: [(0, 1), (2, 1), (0, 2), (END, 1), (0, 2), (2, 1), (0, 3), (2, 1), (0, 3), (2, 1), (0, 5), (2, 1), (0, 5), (2, 2), (0, 8), (2, 2), (0, 9), (2, 2), (0, 12), (2, 4), (0, 13), (1, 1), (2, 4), (0, 1), (1, 16), (2, 5), (1, 25), (2, 8), (1, 22), (2, 32), (3, 64)],
    1237: [(0, 1), (2, 1), (0, 1), (END, 1), (0, 2), (2, 1), (0, 3), (2, 1), (0, 5), (2, 2), (0, 4), (2, 1), (0, 5), (2, 1), (0, 6), (2, 2), (0, 7), (2, 3), (0, 7), (2, 4), (0, 11), (2, 5), (0, 10), (1, 1), (2, 6), (0, 2), (1, 63), (2, 37), (3, 64)],
    1238: [(0, 1), (2, 1), (0, 2), (END, 1), (0, 2), (2, 1), (0, 3), (2, 1), (0, 3), (2, 1), (0, 5), (2, 1), (0, 6), (2, 2), (0, 7), (2, 2), (0, 8), (2, 2), (0, 11), (2, 3), (0, 13), (2, 4), (0, 3), (1, 16), (2, 6), (1, 22), (2, 6), (1, 26), (2, 34), (3, 64)],
    1250: [(0, 1), (2, 1), (0, 2), (END, 1), (0, 2), (2, 1), (0, 3), (2, 1), (0, 3), (2, 1), (0, 5), (2, 1), (0, 6), (2, 1), (0, 7), (2, 2), (0, 10), (2, 2), (0, 13), (2, 3), (0, 12), (1, 5), (2, 4), (1, 21), (2, 4), (1, 29), (2, 6), (1, 9), (2, 37), (3, 64)],
    1251: [(0, 1), (2, 1), (0, 2), (END, 1), (0, 2), (2, 1), (0, 3), (2, 1), (0, 3), (2, 1), (0, 5), (2, 1), (0, 5), (2, 1), (0, 8), (2, 2), (0, 11), (2, 3), (0, 12), (2, 3), (0, 12), (1, 8), (2, 3), (1, 21), (2, 5), (1, 29), (2, 6), (1, 6), (2, 36), (3, 64)],
    1252: [(0, 1), (2, 1), (0, 2), (2, 1), (END, 1), (0, 4), (2, 1), (0, 7), (2, 2), (0, 4), (2, 1), (0, 6), (2, 2), (0, 8), (2, 2), (0, 9), (2, 3), (0, 12), (2, 3), (0, 11), (1, 3), (2, 4), (1, 18), (2, 5), (1, 43), (2, 39), (3, 64)],
}
#: Fixed values. Levels that don't stand in order: by table and flags, the level before them and they themselves.
AC_AHEAD = {(1237, 0): (123, [129]), (1238, 1): (75, [81]), (1250, 1): (107, [111, 113])}
#: Fixed values. Code and its bits of each length of a difference.
DC = {
    1235: [(10, 4), (62, 6), (11, 4), (12, 4), (13, 4), (0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (14, 4), (30, 5), (126, 7), (127, 7)],
    1237: [(0, 3), (12, 4), (13, 4), (1, 3), (2, 3), (3, 3), (4, 3), (5, 3), (14, 4), (30, 5), (62, 6), (63, 6)],
}
#: Fixed values. Codes of each length of runs, and the runs they stand for: all from 1 to 62, some of them earlier than in order.
RUN_LENGTHS = {
    1235: [1, 0, 1, 2, 4, 4, 1, 1, 4, 44],
    1237: [1, 0, 1, 2, 3, 5, 2, 1, 13, 34],
    1250: [1, 0, 2, 1, 3, 1, 3, 1, 2, 48],
}
RUNS_AHEAD = {1235: (16, [18, 20]), 1237: (21, [53, 57, 58, 59, 60, 61, 62]), 1238: (16, [20, 21]), 1250: (62, [])}
#: Fixed values. Weights of luma and chroma in coded order.
WEIGHTS = {
    1235: ([
        0, 32, 32, 32, 33, 32, 32, 32, 32, 31, 32, 33, 33, 33, 33, 35,
        36, 36, 34, 34, 36, 37, 37, 36, 36, 35, 36, 38, 39, 39, 37, 36,
        37, 37, 39, 41, 42, 41, 39, 39, 40, 41, 42, 43, 42, 42, 41, 41,
        41, 44, 47, 46, 46, 48, 51, 51, 50, 50, 53, 55, 55, 56, 60, 60,
    ], [
        0, 32, 33, 34, 34, 33, 34, 35, 37, 40, 43, 42, 39, 38, 39, 41,
        43, 44, 47, 50, 55, 61, 63, 56, 48, 46, 49, 54, 59, 58, 55, 58,
        63, 65, 67, 74, 84, 82, 75, 72, 70, 74, 84, 87, 87, 94, 93, 81,
        75, 78, 83, 89, 91, 86, 82, 85, 90, 90, 85, 79, 73, 73, 73, 73,
    ]),
    1237: ([
        0, 32, 33, 34, 34, 36, 37, 36, 36, 37, 38, 38, 38, 39, 41, 44,
        43, 41, 40, 41, 46, 49, 47, 46, 47, 49, 51, 54, 60, 62, 59, 55,
        54, 56, 58, 61, 65, 66, 64, 63, 66, 73, 78, 79, 80, 79, 78, 78,
        82, 87, 89, 90, 93, 95, 96, 97, 97, 100, 104, 102, 98, 98, 99, 99,
    ], [
        0, 32, 36, 39, 39, 38, 39, 41, 45, 51, 57, 58, 53, 48, 47, 51,
        55, 58, 66, 75, 81, 83, 82, 78, 73, 72, 74, 77, 83, 85, 83, 82,
        89, 99, 96, 90, 94, 97, 99, 105, 109, 105, 95, 89, 92, 95, 94, 93,
        92, 88, 89, 90, 93, 95, 96, 97, 97, 100, 104, 102, 98, 98, 99, 99,
    ]),
    1238: ([
        0, 32, 32, 33, 34, 33, 33, 33, 33, 33, 33, 33, 33, 35, 37, 37,
        36, 36, 35, 36, 38, 38, 36, 35, 36, 37, 38, 41, 42, 41, 39, 38,
        38, 38, 39, 41, 42, 41, 39, 39, 40, 41, 43, 44, 44, 44, 44, 44,
        45, 47, 47, 47, 49, 50, 51, 51, 51, 53, 55, 57, 58, 59, 57, 57,
    ], [
        0, 32, 35, 35, 35, 34, 34, 35, 39, 43, 45, 45, 41, 39, 40, 41,
        42, 44, 48, 55, 59, 63, 65, 59, 53, 52, 52, 55, 61, 62, 58, 58,
        63, 66, 66, 65, 70, 74, 70, 66, 65, 68, 75, 77, 74, 74, 77, 76,
        73, 73, 73, 73, 76, 80, 89, 90, 82, 77, 80, 86, 84, 82, 82, 82,
    ]),
    1241: ([
        0, 32, 33, 34, 34, 35, 36, 37, 36, 37, 38, 38, 38, 39, 39, 40,
        40, 38, 38, 39, 38, 37, 39, 41, 41, 42, 43, 45, 45, 46, 47, 46,
        45, 43, 39, 37, 37, 40, 44, 45, 45, 46, 46, 46, 47, 47, 46, 44,
        42, 43, 45, 47, 48, 49, 50, 49, 48, 46, 47, 48, 48, 49, 49, 49,
    ], [
        0, 32, 36, 38, 37, 37, 40, 41, 40, 40, 42, 42, 41, 41, 41, 41,
        42, 43, 44, 44, 45, 46, 46, 45, 44, 45, 45, 45, 45, 46, 47, 46,
        45, 44, 42, 41, 43, 45, 45, 47, 48, 48, 48, 46, 47, 47, 46, 47,
        46, 45, 45, 47, 48, 49, 50, 49, 48, 46, 48, 49, 48, 49, 49, 49,
    ]),
    1242: ([
        0, 32, 33, 33, 34, 35, 36, 35, 33, 33, 35, 36, 37, 37, 38, 37,
        37, 37, 36, 37, 37, 37, 38, 39, 37, 36, 37, 40, 42, 45, 46, 44,
        41, 42, 44, 45, 47, 49, 50, 48, 46, 48, 49, 50, 52, 52, 50, 49,
        47, 48, 50, 50, 51, 51, 50, 49, 49, 51, 52, 51, 49, 47, 47, 47,
    ], [
        0, 32, 37, 42, 45, 45, 45, 44, 38, 37, 40, 42, 44, 49, 51, 47,
        41, 40, 43, 44, 46, 48, 51, 54, 51, 47, 47, 45, 47, 50, 51, 49,
        46, 47, 49, 47, 50, 55, 55, 51, 48, 49, 51, 51, 52, 52, 54, 54,
        49, 49, 52, 53, 54, 54, 53, 53, 55, 59, 63, 62, 60, 60, 60, 60,
    ]),
    1243: ([
        0, 32, 32, 33, 33, 35, 35, 35, 35, 35, 35, 35, 34, 35, 38, 40,
        39, 37, 37, 37, 36, 35, 36, 38, 40, 41, 42, 44, 45, 44, 42, 41,
        40, 38, 36, 36, 37, 38, 40, 43, 44, 45, 45, 45, 45, 45, 45, 41,
        39, 41, 45, 47, 47, 48, 48, 48, 46, 44, 45, 47, 47, 48, 47, 47,
    ], [
        0, 32, 36, 37, 36, 37, 39, 39, 41, 43, 43, 42, 41, 41, 41, 42,
        43, 43, 43, 44, 44, 44, 46, 47, 46, 45, 45, 45, 45, 46, 44, 44,
        45, 44, 42, 41, 43, 46, 45, 44, 45, 45, 45, 46, 46, 46, 45, 44,
        45, 44, 45, 47, 47, 48, 49, 48, 46, 45, 46, 47, 47, 48, 47, 47,
    ]),
    1250: ([
        0, 32, 32, 33, 34, 35, 35, 35, 34, 34, 35, 36, 36, 36, 36, 36,
        37, 38, 38, 38, 38, 38, 39, 39, 38, 38, 39, 41, 43, 43, 42, 41,
        40, 40, 39, 40, 41, 41, 39, 39, 40, 42, 47, 50, 47, 45, 46, 46,
        44, 45, 46, 47, 49, 54, 58, 54, 48, 49, 54, 57, 60, 62, 63, 63,
    ], [
        0, 32, 35, 36, 36, 35, 36, 39, 41, 43, 45, 44, 41, 39, 40, 42,
        43, 43, 45, 48, 49, 51, 52, 50, 50, 51, 51, 51, 51, 52, 53, 54,
        51, 49, 51, 52, 52, 56, 57, 55, 54, 54, 55, 56, 55, 58, 58, 58,
        60, 61, 62, 62, 59, 57, 58, 58, 61, 59, 59, 59, 60, 62, 63, 63,
    ]),
    1251: ([
        0, 32, 32, 34, 34, 34, 34, 35, 35, 35, 36, 37, 36, 36, 35, 36,
        38, 38, 38, 38, 38, 38, 38, 38, 38, 38, 39, 41, 44, 43, 41, 40,
        40, 40, 40, 39, 40, 41, 40, 39, 40, 43, 46, 46, 44, 44, 44, 42,
        41, 43, 46, 48, 50, 55, 58, 53, 48, 50, 55, 58, 61, 62, 62, 62,
    ], [
        0, 32, 35, 36, 36, 35, 36, 39, 41, 43, 45, 44, 41, 39, 40, 42,
        43, 43, 45, 48, 48, 48, 50, 50, 50, 51, 51, 51, 51, 52, 53, 54,
        51, 49, 51, 52, 52, 56, 57, 55, 54, 54, 55, 56, 55, 58, 58, 58,
        60, 61, 62, 62, 59, 57, 58, 58, 61, 59, 59, 59, 61, 62, 62, 62,
    ]),
    1252: ([
        0, 32, 34, 35, 36, 36, 36, 37, 36, 37, 39, 40, 41, 40, 40, 40,
        41, 41, 42, 41, 41, 43, 44, 44, 45, 46, 48, 55, 60, 57, 52, 50,
        49, 49, 52, 52, 53, 55, 58, 62, 65, 73, 82, 82, 80, 78, 73, 68,
        71, 82, 90, 90, 88, 87, 90, 95, 100, 107, 103, 97, 95, 93, 99, 99,
    ], [
        0, 32, 35, 36, 37, 37, 38, 40, 42, 46, 49, 50, 50, 49, 49, 53,
        56, 56, 57, 58, 60, 62, 64, 65, 63, 64, 64, 65, 66, 65, 67, 71,
        72, 74, 74, 74, 74, 77, 81, 78, 72, 73, 82, 85, 89, 88, 84, 80,
        90, 100, 90, 90, 88, 87, 90, 95, 114, 128, 125, 129, 134, 125, 116, 116,
    ]),
    1260: ([
        0, 32, 33, 34, 36, 37, 37, 36, 34, 33, 34, 35, 37, 38, 40, 41,
        40, 39, 38, 37, 34, 33, 34, 37, 40, 44, 48, 52, 53, 49, 47, 45,
        42, 38, 36, 36, 38, 41, 43, 44, 46, 49, 52, 54, 54, 49, 44, 44,
        44, 47, 51, 51, 52, 51, 48, 50, 52, 53, 53, 50, 50, 54, 54, 54,
    ], [
        0, 32, 34, 38, 42, 40, 38, 36, 35, 35, 38, 42, 43, 43, 42, 40,
        38, 39, 43, 43, 42, 41, 43, 43, 42, 44, 46, 45, 45, 46, 47, 46,
        44, 44, 45, 46, 46, 46, 50, 50, 47, 47, 49, 49, 49, 49, 51, 53,
        51, 49, 53, 57, 56, 52, 50, 52, 56, 56, 53, 53, 53, 54, 58, 58,
    ]),
}


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """The codes (bits, length) of a canonical prefix code with so many codes of each length from 1 on."""
    codes, code = [], 0
    for length, number in enumerate(lengths, 1):
        code <<= 1
        codes += [(code + k, length) for k in range(number)]
        code += number
    return codes


def complete(codes: list[tuple[int, int]]) -> bool:
    """Whether no code begins another and every stream of bits goes on with some code: sorted by their place among 16 bits, each begins where the one before ends."""
    at = 0
    for first, past in sorted((code << (16 - length), (code + 1) << (16 - length)) for code, length in codes):
        if first != at:
            return False
        at = past
    return at == 1 << 16


def spans(spark: SparkSession, codes: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """code_id, symbol, first, past, length: the values of sixteen bits that begin with each symbol's code, a few hundred rows a code."""
    rows = [(k, symbol, bits << (16 - length), (bits + 1) << (16 - length), length) for k, c in codes.items() for symbol, (bits, length) in enumerate(c)]
    return spark.createDataFrame(rows, "code_id int, symbol int, first int, past int, length int")


def _ahead(series: list[int], after: int, moved: list[int]) -> list[int]:
    rest = [x for x in series if x not in moved]
    at = rest.index(after) + 1
    return rest[:at] + moved + rest[at:]


def symbols(table: int) -> list[tuple[int, int]]:
    """Level and flags of each symbol in the order of its code; (0, 0) ends a block."""
    series = {flags: list(range(3, 130, 2)) for flags in range(4)}
    for (of, flags), moved in AC_AHEAD.items():
        if of == table:
            series[flags] = _ahead(series[flags], *moved)
    out = []
    for flags, number in AC_ORDER[table]:
        if flags is END:
            out.append((0, 0))
            continue
        out += [(level, flags) for level in series[flags][:number]]
        del series[flags][:number]
    return out


def table(dc: int, ac: int, run: int, runs: int, weights: int, wide: bool) -> RowTables:
    """A profile's tables by the names of its parts; ``wide`` ones have six extra bits, bias 8 and shift 4."""
    meaning = symbols(ac)
    luma, chroma = WEIGHTS[weights]
    extra = {"index_bits": 6, "bias": 8, "shift": 4} if wide else {}
    return RowTables(dc=DC[dc], ac=canonical(AC_LENGTHS[ac]), levels=meaning, run=canonical(RUN_LENGTHS[run]), runs=_ahead(list(range(1, 63)), *RUNS_AHEAD[runs]), end=meaning.index((0, 0)), luma=luma, chroma=chroma, **extra)


def _tables() -> dict[int, RowTables]:
    high, low, middle = table(1235, 1235, 1235, 1235, 1235, True), table(1237, 1237, 1237, 1237, 1237, False), table(1237, 1238, 1235, 1238, 1238, False)
    small = {cid: table(1237, cid, 1250, 1250, cid, False) for cid in (1251, 1252)}
    weighted = lambda t, cid, **more: replace(t, luma=WEIGHTS[cid][0], chroma=WEIGHTS[cid][1], **more)
    rgb = replace(high, bias=32, shift=6, chroma=WEIGHTS[1235][0])
    return {
        1235: high, 1237: low, 1238: middle, 1241: weighted(high, 1241), 1242: weighted(low, 1242), 1243: weighted(middle, 1243), 1244: weighted(low, 1260),
        1250: table(1235, 1250, 1250, 1250, 1250, True), **small, 1253: low, 1256: rgb, 1258: small[1252], 1259: low, 1260: weighted(low, 1260),
        1270: rgb, 1271: weighted(high, 1241, bias=32, shift=6), 1272: middle, 1273: low, 1274: low,
    }


#: The tables of all profiles by their id.
TABLES = _tables()
