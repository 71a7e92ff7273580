"""What the text operators share: lineage cuts, joins behind a size check, and vectorised word hashing.

Texts reach Python as Arrow batches. A batch is handled in chunks of about ``CHUNK`` bytes, so memory follows the
chunk (or the longest single text), never the partition. Hashes are 64-bit and depend on the bytes only.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.session import shared_folder

#: Bytes of text handled at once in a task.
CHUNK = 1 << 18
#: Most rows, and most bytes, of a side that is broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 48 << 20
#: Files of a settled table whose rows are counted before: so many, and one more for so many rows.
LEAST_FILES, FILE_ROWS = 12, 250_000


class Scratch:
    """Tables written to the shared folder for one run of an operator; each may be deleted when no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label

    def settle(self, df: DataFrame, name: str, *folders: str, most: int | None = None) -> DataFrame:
        """Write and read back: cuts the lineage, and the copy outlives executors. ``folders``: columns that part it.

        ``most``: rows it can have at most. Narrow tables of few rows then go to few files, however many shuffle
        partitions there are: each file costs a task's commit, and on a local disk a child process of the executor.
        """
        if most is not None:
            df = df.coalesce(LEAST_FILES + most // FILE_ROWS)
        path = f"{shared_folder(self.spark).rstrip('/')}/{self.label}-{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*folders).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete settled tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object by value, class and all: workers need no installed copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(shared: Broadcast):
    """The object of ``ship``, in a task."""
    return pickle.loads(shared.value)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"__{k}"])
        on = c if on is None else on & c
    return left.join(right, on, how).drop(*[f"__{k}" for k in keys])


def checked_broadcast(small: DataFrame, weight: Column | None = None, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a settled table for broadcast if its counted rows and bytes are below the bounds; else leave it to a shuffle.

    ``weight``: bytes of a row, for columns of varying length.
    """
    n, total = small.agg(F.count(F.lit(1)), F.sum(weight if weight is not None else F.lit(32))).first()
    return F.broadcast(small) if n <= rows and (total or 0) <= size else small


# --- vectorised words -------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
LOWER_BYTE = BYTE[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; short tables are kept."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 1 << 20:
            _POWERS[base] = kept
    return kept[:n]


def inverse_powers(n: int) -> np.ndarray:
    """``BASE ** -i`` modulo 2**64 for i below n."""
    return powers(n, pow(int(BASE), -1, 2**64))


def text_parts(array: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; null texts are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: start and hash of each, and the bounds of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(data)
        self.solid = ~SPACE[data]
        before = np.ones(n, bool)
        before[1:] = ~self.solid[:-1]
        inner = offsets[:-1]
        before[inner[inner < n]] = True
        self.start = np.flatnonzero(self.solid & before)
        self.bounds = np.searchsorted(self.start, offsets)
        if len(self.start):
            first = self.start[0]
            lengths = np.diff(np.append(self.start, n))
            place = np.ones(n - first, np.int64)
            place[0] = 0
            place[self.start[1:] - first] -= lengths[:-1]
            np.cumsum(place, out=place)
            value = (LOWER_BYTE if lower else BYTE).take(data[first:])
            value *= powers(int(lengths.max())).take(place)
            value *= self.solid[first:]
            self.hash = mix(np.add.reduceat(value, self.start - first))
        else:
            self.hash = np.zeros(0, np.uint64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, at their first word, and which of them stay inside one text."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            h += self.hash[i : m - k + 1 + i] * np.uint64((0xA0761D6478BD642F * (2 * i + 3)) % 2**64 | 1)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return mix(h), text[: m - k + 1] == text[k - 1 :]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; the whole sequence if it has fewer words; nothing without words."""
    words = Words(data, offsets)
    hashes, inside = words.shingles(k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            tag = np.uint64(b - a)
            out.append(mix(np.array([int(sum(int(x) * (2 * i + 5) for i, x in enumerate(words.hash[a:b])) % 2**64)], np.uint64) + tag))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_array(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
