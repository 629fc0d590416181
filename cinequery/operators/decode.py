"""Block kernels in numpy over Arrow batches, and the entropy decoding of rows with given code tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cinequery.functions.signal import basis

_BASIS = np.array(basis())


def inverse_blocks(coefficients: np.ndarray, depth: int) -> np.ndarray:
    """Samples of (n, 64) coefficients, summed in the order of the column expression, so that both agree to the bit."""
    c = coefficients.reshape(-1, 8, 8).astype(np.float64)
    rows = np.zeros_like(c)
    for u in range(8):
        rows += c[:, :, u, None] * _BASIS[None, None, :, u]
    out = np.zeros_like(c)
    for v in range(8):
        out += rows[:, v, None, :] * _BASIS[None, :, v, None]
    return np.clip(np.floor(out / 4 + 0.5), 0, (1 << depth) - 1).astype(np.int32).reshape(-1, 64)


def idct(blocks: DataFrame, depth: int) -> DataFrame:
    """id, samples of each (id, coefficients) row; rows whose coefficients aren't 64 numbers give null."""

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            good = [v is not None and len(v) == 64 and None not in v for v in values]
            done = iter(inverse_blocks(np.array([v for v, ok in zip(values, good, strict=True) if ok], np.int64).reshape(-1, 64), depth).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([next(done) if ok else None for ok in good], pa.list_(pa.int32()))], names=["id", "samples"])

    return blocks.select("id", "coefficients").mapInArrow(transform, f"id {blocks.schema['id'].dataType.simpleString()}, samples array<int>")


class CodeTable:
    """A prefix code as a look-up over the next 16 bits; of entries that share a prefix the shortest code wins."""

    def __init__(self, codes: list[tuple[int, int]]):
        """codes: (bits, length) of each symbol."""
        self.symbol = np.full(1 << 16, -1, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        for symbol, (code, n) in sorted(enumerate(codes), key=lambda x: -x[1][1]):
            first = code << (16 - n)
            self.symbol[first : first + (1 << (16 - n))] = symbol
            self.length[first : first + (1 << (16 - n))] = n


class Bits:
    """Bits of a byte string, highest first. Past the end reads give None."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def read(self, n: int) -> int | None:
        if self.at + n > self.size:
            return None
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def symbol(self, table: CodeTable) -> int | None:
        """The next symbol of a code; None if no code fits in what is left."""
        left = self.size - self.at
        if left <= 0:
            return None
        n = min(16, left)
        window = (self.value >> (left - n) & ((1 << n) - 1)) << (16 - n)
        if (s := int(self.symbol_at(table, window))) < 0 or table.length[window] > left:
            return None
        self.at += int(table.length[window])
        return s

    @staticmethod
    def symbol_at(table: CodeTable, window: int) -> int:
        return int(table.symbol[window])


def entropy_block(bits: Bits, dc: CodeTable, ac: CodeTable, zigzag: list[int], last_dc: int) -> tuple[list[int], int] | str:
    """64 coefficients of a block and its new constant term: a length-coded difference, then symbols of 16 * zeros + length, 0 for the end. A string says what is wrong."""
    n = bits.symbol(dc)
    raw = None if n is None else bits.read(n)
    if raw is None:
        return "ends in the constant term"
    delta = raw - ((1 << n) - 1) if n and raw < 1 << (n - 1) else raw
    block = [0] * 64
    block[0] = last_dc + delta
    at = 0
    while True:
        s = bits.symbol(ac)
        if s is None:
            return "ends in a run"
        if s == 0:
            return block, block[0]
        zeros, n = s >> 4, s & 15
        at += zeros + 1
        raw = bits.read(n)
        if at > 63 or raw is None:
            return "run past the block" if at > 63 else "ends in a level"
        block[zigzag[at]] = raw - ((1 << n) - 1) if n and raw < 1 << (n - 1) else raw


def decode_rows(rows: DataFrame, dc: list[tuple[int, int]], ac: list[tuple[int, int]], zigzag: list[int], start_dc: int = 0) -> DataFrame:
    """id, blocks, error of each (id, payload, n_blocks) row: the constant term is predicted along the row, so a row is one unit of work."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = CodeTable(dc), CodeTable(ac)
        for batch in batches:
            blocks, errors = [], []
            for payload, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bits, last, done, error = Bits(payload or b""), start_dc, [], None
                for _ in range(n or 0):
                    found = entropy_block(bits, *tables, zigzag, last)
                    if isinstance(found, str):
                        error = found
                        break
                    done.append(found[0])
                    last = found[1]
                blocks.append(done)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.list_(pa.list_(pa.int32()))), pa.array(errors, pa.string())], names=["id", "blocks", "error"])

    return rows.select("id", "payload", "n_blocks").mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, blocks array<array<int>>, error string")
