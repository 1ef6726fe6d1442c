"""Shared helpers of the corpus operators: written tables, hashes, text blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions.folders import delete, scratch


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A table survives the loss of executors. ``drop`` removes tables that
    nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch(spark, name)
        self.count = 0

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def table(self, df: DataFrame, tag: str, *parts: str) -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch_path)

    def drop_part(self, table: DataFrame, part: str) -> None:
        """Remove the rows of one part (``column=value``) of a table, which nothing reads any more."""
        delete(self.spark, f"{table._scratch_path}/{part}")


def crc_of_id(col: Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(col.cast("string").cast("binary"))


# ---------------------------------------------------------------- numpy helpers

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on the given integers alone."""
    h = np.array([0x243F6A8885A308D3], np.uint64)
    for p in parts:
        p = p.astype(np.uint64) if isinstance(p, np.ndarray) else np.array([p % 2**64], np.uint64)
        h = mix64(p + h * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row boundaries of a text column; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Rows and text bytes that a task works on at once.
PART_ROWS, PART_BYTES = 512, 1 << 20


def text_parts(batches, text: str, rows: int = PART_ROWS, size: int = PART_BYTES):
    """Slices of Arrow batches of at most so many rows and, but for single longer texts, so many bytes of text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(upto, upto[at] + size, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the row it is in.

    Words are runs without ASCII white space; they never cross rows.
    """
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x2545F4914F6CDD1D | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            have = _POWERS[name] = np.cumprod(p)
    return have[:n]


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial sum."""
    n = len(raw)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw] * _powers("up", _BASE, n), out=total[1:])
        h = (total[ends] - total[starts]) * _powers("down", _UNBASE, n + 1)[starts]
        return mix64(h + (ends - starts).astype(np.uint64))


def local_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links i-j."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            break
        a, b = a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        i, j = a, b
    return label
