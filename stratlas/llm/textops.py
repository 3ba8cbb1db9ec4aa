"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on Arrow string columns inside a task: the UTF-8 buffer of a
slice of rows is viewed as one byte array, and words, word hashes and window
hashes of all its rows are computed by numpy at once.  ``slices`` bounds the
bytes that are in work at a time, so memory follows the slice (or the longest
single text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 18

#: Arrow batches between Spark and Python.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_R_INV = _U(pow(int(_R), -1, 1 << 64))


def _class(keep) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


#: Byte classes of the two word definitions; bytes over 0x7F belong to characters outside ASCII.
ALNUM_WORD = _class(lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
SPACE_WORD = _class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def fresh(taken, *names: str) -> list[str]:
    """Column names that clash with none of ``taken``."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the context, which all executors share; one of this machine only in local mode, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints/stratlas")
    return jsc.getCheckpointDir().get()


def for_python(df: DataFrame) -> DataFrame:
    """``df``, which goes to Python next, in batches of at most ``BATCH_BYTES``, so a task's memory doesn't follow the length of its texts.

    This is a setting of the session and stays for the caller's later queries; a smaller one of theirs is kept.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_KEY, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about ``limit`` bytes of text each, every row once."""
    data, at = strings(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """The words of all rows of a slice: byte ranges, owning row, and row extents in words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = kind[self.data]
        opens = inside[:n].copy()
        opens[1:] &= ~inside[: n - 1] if n else inside[:0]
        firsts = at[:-1][at[:-1] < at[1:]]
        opens[firsts] = inside[firsts]
        self.start = np.flatnonzero(opens)
        closes = inside[:n] & ~inside[1:]
        lasts = at[1:][at[:-1] < at[1:]] - 1
        closes[lasts] = inside[lasts]
        self.end = np.flatnonzero(closes) + 1
        #: Row r owns words first[r] to first[r + 1].
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power = _powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * power[0][:n], out=prefix[1:])
        h = (prefix[self.end] - prefix[self.start]) * power[1][self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << _U(56)))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS[:] = []
        for base in (_R, _R_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def windows(h: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` consecutive words within a row, and each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * _R + h[at + j]
    return mix(out), at
