"""Frames to planes: rows of macroblocks are decoded apart, in step, and their strips joined by frame.

A row of macroblocks is a unit of work, as only its own prediction runs along it. The rows of an
Arrow batch that share their parameters advance together: each step of the loop reads the next
symbol of every row that isn't done, so the loop's length is that of the longest row, not their sum.
The code tables and weights of a profile are parameters (``RowTables``); those of the known profiles
are in ``code_tables.TABLES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequery.functions import header as H
from cinequery.functions import signal as S
from cinequery.functions.binary import cut
from cinequery.operators.decode import CodeTable, inverse_blocks
from cinequery.operators.settle import settled

#: Places of the coefficients of a block in the order they are coded.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: What the native decoder's result codes stand for.
RESULTS = {
    0: "ok", 1: "invalid arguments", 2: "macroblock header", 3: "ACT not supported", 4: "DC code", 5: "DC delta",
    6: "AC sign", 7: "AC level", 8: "run code", 9: "coefficient overrun", 10: "AC code",
}
#: Rows decoded together at most, and bytes of their coefficients.
TOGETHER, COEFFICIENTS = 256, 64 << 20


@dataclass(frozen=True)
class RowTables:
    """A profile's codes as (bits, length) by symbol, what they mean, and its weights in coded order."""

    dc: list[tuple[int, int]]  # symbol: length of the difference
    ac: list[tuple[int, int]]
    levels: list[tuple[int, int]]  # of each AC symbol: level, and flags 1 (extra bits follow) and 2 (a run follows)
    run: list[tuple[int, int]]
    runs: list[int]
    end: int  # the AC symbol that ends a block
    luma: list[int]
    chroma: list[int]
    index_bits: int = 4
    bias: int = 32
    shift: int = 6

    @classmethod
    def load(cls, path: str) -> dict[int, RowTables]:
        """Tables by profile id from a JSON file."""
        with open(path) as f:
            return {int(k): cls(**v) for k, v in json.load(f).items()}

    def at_depth(self, depth: int, is444: bool) -> RowTables:
        """Frames of 12 bits take other extra bits, bias and shift."""
        return replace(self, index_bits=6, bias=32 if is444 else 8, shift=4) if depth == 12 else self


class Readers:
    """The bits of many rows: each has its own place and end."""

    def __init__(self, rows: list[bytes]):
        size = np.array([len(r) for r in rows], np.int64)
        self.data = np.frombuffer(b"".join(r + bytes(4) for r in rows), np.uint8)
        self.at = (np.cumsum(size + 4) - size - 4) * 8
        self.end = self.at + size * 8

    def window(self, who: np.ndarray) -> np.ndarray:
        """The next 16 bits of each; zeros stand past the end."""
        at = np.minimum(self.at[who], self.end[who])
        byte = at >> 3
        three = (self.data[byte].astype(np.int64) << 16) | (self.data[byte + 1].astype(np.int64) << 8) | self.data[byte + 2]
        return (three >> (8 - (at & 7))) & 0xFFFF

    def read(self, who: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The next ``n`` bits (16 at most) of each, and whether they were there."""
        value = self.window(who) >> (16 - n)
        self.at[who] += n
        return value, self.at[who] <= self.end[who]

    def symbol(self, who: np.ndarray, table: CodeTable) -> np.ndarray:
        """The next symbol of each, -1 where no code fits in what is left."""
        window = self.window(who)
        length = table.length[window]
        fits = (table.symbol[window] >= 0) & (self.at[who] + length <= self.end[who])
        self.at[who] += np.where(fits, length, 0)
        return np.where(fits, table.symbol[window], -1)


def decode_rows(rows: list[bytes], tables: RowTables, width: int, depth: int, is444: bool, mbaff: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (row, block, 64) of rows of ``width`` macroblocks, which of these are interlaced, macroblocks done, and a code of RESULTS for each row."""
    t = tables.at_depth(depth, is444)
    dc, ac, run = CodeTable(t.dc), CodeTable(t.ac), CodeTable(t.run)
    base, flags = (np.array([x[k] for x in t.levels], np.int64) for k in (0, 1))
    runs, weights = np.array(t.runs, np.int64), np.array([t.luma, t.chroma], np.int64)
    n, blocks = len(rows), 12 if is444 else 8
    component_of = np.array([(b >> 1) % 3 if is444 else (1 + (b & 1) if b & 2 else 0) for b in range(blocks)])
    bits = Readers(rows)
    out = np.zeros((n, width * blocks, 64), np.int64)
    crossed = np.zeros((n, width), bool)
    result = np.zeros(n, np.int64)
    last = np.full((n, 3), 1 << (depth + 2), np.int64)
    scale = np.zeros(n, np.int64)
    block, place = np.zeros(n, np.int64), np.zeros(n, np.int64)  # blocks begun in the row, and place in the block
    head, inside = np.ones(n, bool), np.zeros(n, bool)  # a macroblock begins; a block's further coefficients follow
    live = np.arange(n)

    def fail(who: np.ndarray, bad: np.ndarray, code: int) -> np.ndarray:
        result[who[bad]] = code
        return who[~bad]

    while live.size:
        who = live[head[live]]
        if who.size:
            crossing, ok = bits.read(who, 1) if mbaff else (np.zeros(len(who), np.int64), np.ones(len(who), bool))
            q, ok_q = bits.read(who, 10 if mbaff else 11)
            act, ok_a = bits.read(who, 1)
            bad = ~(ok & ok_q & ok_a)
            crossed[who, block[who] // blocks] = crossing == 1
            scale[who] = q
            head[who] = False
            result[who[bad]] = 2
            if not is444:
                result[who[~bad & (act == 1)]] = 3
        who = live[~head[live] & ~inside[live] & (result[live] == 0)]
        if who.size:
            size = bits.symbol(who, dc)
            bad = size < 0
            who, size = fail(who, bad, 4), size[~bad]
            raw, ok = bits.read(who, size)
            who, size, raw = fail(who, ~ok, 5), size[ok], raw[ok]
            delta = np.where(size == 0, 0, np.where(raw < (1 << np.maximum(size - 1, 0)), raw - ((1 << size) - 1), raw))
            component = component_of[block[who] % blocks]
            last[who, component] += delta << (2 if depth == 12 else 0)
            out[who, block[who], 0] = last[who, component]
            inside[who], place[who] = True, 0
        who = live[inside[live] & (result[live] == 0)]
        if who.size:
            symbol = bits.symbol(who, ac)
            bad = symbol < 0
            who, symbol = fail(who, bad, 10), symbol[~bad]
            ends = symbol == t.end
            done = who[ends]
            inside[done] = False
            block[done] += 1
            head[done] = block[done] % blocks == 0
            who, symbol = who[~ends], symbol[~ends]
            sign, ok = bits.read(who, 1)
            who, symbol, sign = fail(who, ~ok, 6), symbol[ok], sign[ok]
            level = base[symbol]
            more = np.flatnonzero(flags[symbol] & 1)
            extra, ok = bits.read(who[more], t.index_bits)
            level[more] += extra << 7
            result[who[more[~ok]]] = 7
            far = np.flatnonzero((flags[symbol] & 2 > 0) & (result[who] == 0))
            r = bits.symbol(who[far], run)
            result[who[far[r < 0]]] = 8
            place[who[far[r >= 0]]] += runs[r[r >= 0]]
            place[who] += 1
            result[who[(place[who] > 63) & (result[who] == 0)]] = 9
            good = result[who] == 0
            who, level, sign = who[good], level[good], sign[good]
            w = weights[np.minimum(component_of[block[who] % blocks], 1), place[who]]
            s = scale[who] * w
            value = level * s + (s >> 1)
            value = np.where((t.bias < 32) | (w != t.bias), value + t.bias, value) >> t.shift
            out[who, block[who], ZIGZAG[place[who]]] = np.where(sign == 1, -value, value)
        live = live[(result[live] == 0) & (block[live] < width * blocks)]
    return out, crossed, np.minimum(block // blocks, width), result


def strips(samples: np.ndarray, crossed: np.ndarray, is444: bool) -> list[np.ndarray]:
    """The planes of rows of decoded blocks (row, block, 64) as (row, 16 lines, samples): a macroblock's upper and lower blocks, or its even and odd lines where it is interlaced."""
    n, width = crossed.shape
    b = samples.reshape(n, width, -1, 8, 8)
    pairs = [((2 * p, 2 * p + 1), (6 + 2 * p, 7 + 2 * p)) for p in range(3)] if is444 else [((0, 1), (4, 5)), ((2,), (6,)), ((3,), (7,))]
    planes = []
    for upper, lower in pairs:
        top, bottom = (np.concatenate([b[:, :, k] for k in side], axis=3) for side in (upper, lower))
        whole = np.concatenate([top, bottom], axis=2)
        mixed = np.stack([top, bottom], axis=3).reshape(whole.shape)
        lines = np.where(crossed[:, :, None, None], mixed, whole)
        planes.append(lines.transpose(0, 2, 1, 3).reshape(n, 16, -1))
    return planes


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes | None], tuple]]:
    """Rows of a batch that are decoded in step: their places, bytes and what they share, so many that their coefficients keep within COEFFICIENTS; only their bytes are taken out of the batch."""
    shape = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("header_cid", "macroblock_width", "bit_depth", "is444", "mbaff")), strict=True))
    data = batch.column(batch.schema.get_field_index("bytes"))
    for kind in sorted(set(shape)):
        which = [k for k, s in enumerate(shape) if s == kind]
        step = max(1, min(TOGETHER, COEFFICIENTS // (kind[1] * 12 * 64 * 8)))
        for at in range(0, len(which), step):
            part = which[at : at + step]
            yield part, [data[k].as_py() for k in part], kind


def _decode(batches: Iterator[pa.RecordBatch], tables: dict[int, RowTables], keys: int) -> Iterator[pa.RecordBatch]:
    names = ["y", "cb", "cr", "macroblocks", "code"]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        for part, rows, (cid, width, depth, is444, mbaff) in _alike(batch):
            if part:
                out, crossed, done, code = decode_rows([r or b"" for r in rows], tables[cid], width, depth, is444, mbaff)
                code = np.where([r is None for r in rows], 1, code)
                samples = inverse_blocks(out.reshape(-1, 64), depth).astype(np.uint8 if depth == 8 else "<u2").reshape(out.shape)
                planes = strips(samples, crossed, is444)
                data = [[p[k].tobytes() if not code[k] else None for k in range(len(part))] for p in planes]
                own = batch.take(pa.array(part)).columns[:keys]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip([*data, done.tolist(), code.tolist()], types, strict=True))], names=[*batch.schema.names[:keys], *names])


def coded_rows(frames: DataFrame, key: str, packet: str = "packet") -> DataFrame:
    """The coding units of frames and their rows: key, unit, parity (null of a progressive frame), row, the row's bytes, what decodes them, and error where a frame has none.

    An interlaced frame is two units of the profile's size, each with a header of its own; these
    must agree on the profile and name different fields.
    """
    whole = H.parse(frames.select(key, packet), packet)
    kept = ["header_cid", "profile", "macroblock_width", "bit_depth", "is444", "mbaff", "macroblock_height", "width", "height"]
    single = whole.where("ok AND NOT interlaced").withColumns({"unit": F.lit(0), "parity": F.lit(None).cast("int")})
    paired = whole.where("ok AND interlaced").select(key, packet, "unit_size", F.col("header_cid").alias("whole_cid"))
    fits = (F.col("unit_size") > 0) & (F.octet_length(packet) >= F.col("unit_size") * 2)
    halves = paired.where(fits).select(key, "whole_cid", F.posexplode(F.array(*(cut(packet, F.col("unit_size") * k, F.col("unit_size")) for k in (0, 1)))).alias("unit", packet))
    fields = H.parse(halves, packet).withColumn("parity", F.when(F.col("field_parity") == "top", 0).when(F.col("field_parity") == "bottom", 1))
    agree = fields.groupBy(key).agg(F.count_if(F.col("ok") & F.col("interlaced") & (F.col("header_cid") == F.col("whole_cid"))).alias("good"), F.count_distinct("parity").alias("parities"))
    fields = fields.join(agree.where("good = 2 AND parities = 2").select(key), key, "left_semi")
    units = single.select(key, packet, "unit", "parity", "ok", "data_offset", *kept).unionByName(fields.select(key, packet, "unit", "parity", "ok", "data_offset", *kept))
    # Rows are cut where their unit stands: its packet goes through no shuffle.
    spans = H.row_spans(units.withColumn("piece", F.struct(key, "unit", "parity", packet, *kept)), "piece", packet)
    bytes_ = F.when(F.col("valid"), cut(F.col(f"piece.{packet}"), F.col("first"), F.col("length")))
    return spans.select(F.col(f"piece.{key}").alias(key), "piece.unit", "piece.parity", "row", bytes_.alias("bytes"), *(F.col(f"piece.{c}").alias(c) for c in kept))


def _coefficients(batches: Iterator[pa.RecordBatch], tables: dict[int, RowTables], keys: int) -> Iterator[pa.RecordBatch]:
    blocks = pa.list_(pa.struct([("dc", pa.int32()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.int32()))]))
    for batch in batches:
        for part, rows, (cid, width, depth, is444, mbaff) in _alike(batch):
            out, crossed, done, code = decode_rows([r or b"" for r in rows], tables[cid], width, depth, is444, mbaff)
            code = np.where([r is None for r in rows], 1, code)
            found = []
            for k, c in enumerate(out):
                row, at = np.nonzero(c[:, 1:])
                borders = np.searchsorted(row, np.arange(len(c) + 1)).tolist()
                values = c[row, at + 1].tolist()
                places = (at + 1).tolist()
                found.append([{"dc": dc, "places": places[a:b], "values": values[a:b]} for dc, a, b in zip(c[:, 0].tolist(), borders[:-1], borders[1:], strict=True)] if not code[k] else None)
            own = batch.take(pa.array(part)).columns[:keys]
            mixed = pa.array([m.tolist() for m in crossed], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, blocks), mixed, pa.array(code.tolist(), pa.int32())], names=[*batch.schema.names[:keys], "blocks", "crossed", "code"])


def coefficients(frames: DataFrame, key: str, tables: dict[int, RowTables], packet: str = "packet") -> DataFrame:
    """key, unit, parity, row, blocks, crossed, code of each row of macroblocks: of each block its constant term and the other coefficients that aren't 0 by their place in the block, and which macroblocks have mixed lines. blocks is null unless code (of RESULTS) is 0."""
    rows = coded_rows(frames, key, packet).where(_known(tables))
    given = frames.sparkSession.sparkContext.broadcast(tables)  # a table of a few hundred codes a profile
    carried = [key, "unit", "parity", "row"]
    able = rows.select(*carried, "header_cid", "macroblock_width", "bit_depth", "is444", "mbaff", "bytes")
    schema = ", ".join(f"{c} {able.schema[c].dataType.simpleString()}" for c in carried) + ", blocks array<struct<dc:int,places:array<int>,values:array<int>>>, crossed array<boolean>, code int"
    return able.mapInArrow(lambda batches: _coefficients(batches, given.value, len(carried)), schema)


def _known(tables: dict[int, RowTables]) -> Column:
    return F.col("header_cid").isin([int(k) for k in tables]) & ~(F.col("is444") & (F.col("bit_depth") == 8))


def decode_strips(frames: DataFrame, key: str, tables: dict[int, RowTables], packet: str = "packet") -> DataFrame:
    """key, unit, parity, row and the decoded planes of each row of macroblocks (y, cb, cr: 16 lines), macroblocks done, and code (of RESULTS). Profiles without tables, and 4:4:4 in 8 bits, have code 1."""
    rows = coded_rows(frames, key, packet)
    known = _known(tables)
    carried = [key, "unit", "parity", "row", "bit_depth", "is444", "width", "height"]
    able = rows.where(known).select(*carried[:-4], "bit_depth", "is444", "width", "height", "header_cid", "macroblock_width", "mbaff", "bytes")
    given = frames.sparkSession.sparkContext.broadcast(tables)  # a table of a few hundred codes a profile
    fields = {f.name: f.dataType.simpleString() for f in able.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in carried) + ", y binary, cb binary, cr binary, macroblocks int, code int"
    done = able.mapInArrow(lambda batches: _decode(batches, given.value, len(carried)), schema)
    rest = rows.where(~known).select(*carried, *(F.lit(None).cast("binary").alias(p) for p in ("y", "cb", "cr")), F.lit(0).alias("macroblocks"), F.lit(1).alias("code"))
    return done.unionByName(rest)


def decode(frames: DataFrame, key: str, tables: dict[int, RowTables], packet: str = "packet") -> DataFrame:
    """key, status, the planes y, cb, cr of the coded frame, bit_depth, is444, width, height, rows and macroblocks decoded of each frame.

    status is ok, the first row's fault as RESULTS names it, or what is wrong with the frame itself;
    planes are null unless it is ok. Fields are woven line by line.
    """
    rows = settled(decode_strips(frames, key, tables, packet))  # what follows reads them three times
    facts = rows.groupBy(key).agg(
        F.min_by("code", F.when(F.col("code") > 0, F.struct("unit", "row"))).alias("code"), F.count_if(F.col("code") == 0).alias("rows"), F.sum("macroblocks").alias("macroblocks"),
        *(F.first(c).alias(c) for c in ("bit_depth", "is444", "width")), (F.first("height") * F.max(F.when(F.col("parity").isNull(), 1).otherwise(2))).alias("height"),
    )
    stride = lambda p: (F.octet_length(p) / 16).cast("int")
    line = lambda p: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: cut(p, i * stride(p), stride(p)))
    woven = rows.where("parity IS NOT NULL").select(key, "parity", "row", F.posexplode(F.arrays_zip(line("y").alias("y"), line("cb").alias("cb"), line("cr").alias("cr"))).alias("i", "l"))
    woven = woven.select(key, ((F.col("row") * 16 + F.col("i")) * 2 + F.col("parity")).alias("at"), *(F.col(f"l.{p}").alias(p) for p in ("y", "cb", "cr")))
    pieces = rows.where("parity IS NULL").select(key, F.col("row").alias("at"), "y", "cb", "cr").unionByName(woven)
    planes = pieces.groupBy(key).agg(*(F.expr(f"listagg({p}) WITHIN GROUP (ORDER BY at)").alias(p) for p in ("y", "cb", "cr")))
    heads = H.parse(frames.select(key, packet), packet).select(key, "ok", "interlaced")
    whole = heads.join(facts, key, "left").join(planes, key, "left")
    names = F.element_at(F.create_map(*(F.lit(x) for pair in RESULTS.items() for x in pair)), F.col("code"))
    status = F.when(~F.col("ok"), "no frame").when(F.col("rows").isNull(), F.when(F.col("interlaced"), "fields don't pair").otherwise("no rows")).when(F.col("code").isNotNull(), names).otherwise("ok")
    good = status == "ok"
    return whole.select(key, status.alias("status"), *(F.when(good, F.col(p)).alias(p) for p in ("y", "cb", "cr")), "bit_depth", "is444", "width", "height", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("macroblocks", F.lit(0)).alias("macroblocks"))


def fields(frames: DataFrame, key: str, tables: dict[int, RowTables], packet: str = "packet") -> DataFrame:
    """key, status and the sixteen fields of each decoded frame (data, coded and visible size, formats, colour, aspect, scan, header, layout), null where decoding gave none, and filled: whether all are there."""
    done = decode(frames, key, tables, packet).select(key, "status", F.when(F.col("y").isNotNull(), F.struct("y", "cb", "cr")).alias("data"))
    h = H.parse(frames.select(key, packet), packet).where("ok").withColumn("l", H.layout("width", "height", "is444", "bit_depth"))
    codes = H.color_codes("color_space")
    head = h.select(
        key, F.col("l.coded_width").alias("coded_width"), F.col("l.coded_height").alias("coded_height"), F.col("width").alias("visible_width"), F.col("height").alias("visible_height"), "pixel_format", F.col("pixel_format").alias("original_pixel_format"), "color_space",
        F.struct("par_num", "par_den").alias("pixel_aspect_ratio"), *(codes[c].alias(f"color_{c}") for c in ("primaries", "transfer", "matrix")), F.lit(False).alias("color_range_full"), H.scan_type("interlaced", "field_parity").alias("scan_type"),
        F.struct("header_cid", "kind", "fourcc", "bit_depth", "is444", "mbaff", "interlaced").alias("header"), F.col("l").alias("layout"),
    )
    rows = done.join(head, key, "left")
    names = ["data", *head.columns[1:]]
    decoded = F.col("status") == "ok"
    kept = rows.select(key, "status", *(F.when(decoded, F.col(c)).alias(c) for c in names))
    return kept.withColumn("filled", reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names)))


def _converted(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, source: str, target: str, matrix: str) -> list[np.ndarray] | None:
    depth = S.FORMAT_DEPTHS.get(target)
    if source == target:
        return [y, cb, cr]
    if source.startswith("gbrp") and target == f"yuv444p{source[4:]}" and matrix != "bt2020-cl":
        kr, kb = (0.2627, 0.0593) if matrix == "bt2020-ncl" else (0.2126, 0.0722)
        top, shift = (1 << depth) - 1, depth - 8
        g, b, r = (p / top for p in (y, cb, cr))
        luma = kr * r + (1 - kr - kb) * g + kb * b
        parts = [(16 << shift) + (219 << shift) * luma, (128 << shift) + (224 << shift) * ((b - luma) / (2 * (1 - kb))), (128 << shift) + (224 << shift) * ((r - luma) / (2 * (1 - kr)))]
        return [np.clip(np.floor(p + 0.5), 0, top) for p in parts]
    if source.startswith("yuv422p") and S.FORMAT_DEPTHS.get(source) == depth:
        if target.startswith("yuv420"):
            return [y, *((p[::2].astype(np.int64) + p[np.minimum(np.arange(1, len(p) + len(p) % 2, 2), len(p) - 1)] + 1) >> 1 for p in (cb, cr))]
        if target.startswith("yuv444"):
            return [y, *(np.repeat(p, 2, axis=1) for p in (cb, cr))]
    return None


def convert(frames: DataFrame, key: str) -> DataFrame:
    """The planes of frames (key, y, cb, cr, coded_width, source, target, matrix: formats and the colour matrix of RGB) in their target format; null where it can't be had from the source.

    From 4:2:2 chroma rows are averaged in pairs or columns repeated, RGB goes through the matrix.
    """

    def made(batch: pa.RecordBatch, first: int, out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *(pa.array([o[k] for o in out], pa.binary()) for k in range(3))], names=[key, "y", "cb", "cr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, first = [], 0, 0
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                planes = None
                if None not in (row["y"], row["cb"], row["cr"], row["source"], row["target"]):
                    kind = np.dtype(np.uint8 if row["source"].endswith("p8") else "<u2")
                    wide = row["coded_width"] // 2 if row["source"].startswith(("yuv422", "yuv420")) else row["coded_width"]
                    planes = _converted(*(np.frombuffer(row[p], kind).reshape(-1, w) for p, w in (("y", row["coded_width"]), ("cb", wide), ("cr", wide))), row["source"], row["target"], row["matrix"])
                out.append([p.astype(kind).tobytes() for p in planes] if planes else [None] * 3)
                held += sum(len(p) for p in out[-1] if p)
                if held > COEFFICIENTS:
                    yield made(batch, first, out)
                    out, held, first = [], 0, k + 1
            if out:
                yield made(batch, first, out)

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "y", "cb", "cr", "coded_width", "source", "target", "matrix").mapInArrow(run, f"{key} {kind}, y binary, cb binary, cr binary")
