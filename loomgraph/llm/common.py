"""What the operators of this subpackage share: session settings, and hashing of words in NumPy over Arrow buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass takes at a time; arrays of eight bytes a byte follow from it.
SLICE_BYTES = 1 << 20

_B, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the folder of spark.checkpoint.dir, which all executors share. Where the
    setting is absent, on one machine, a temporary folder is set; on a cluster that is an error."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that checkpoints go to, set if it isn't yet."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written as Parquet where checkpoints go and read again, and what deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    """The column of this very name, dots and all."""
    return F.col(quoted(name))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: np.uint64) -> np.uint64:
    return np.uint64(pow(int(a), -1, 1 << 64))


class _Powers:
    """base**i and base**-i modulo 2**64, for as many i as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_B), _Powers(_Q)


def large_strings(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array of 64-bit offsets; nulls become empty."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    a = a.cast(pa.large_string())
    return a.fill_null("") if a.null_count else a


def offsets_of(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)


def slices(a: pa.Array, most: int = SLICE_BYTES):
    """(from, to) row ranges of about this many bytes; a longer text is a range of its own."""
    off = offsets_of(a)
    i = 0
    while i < len(a):
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(a))
        yield i, j
        i = j


class Words:
    """The words of an array of texts: runs of bytes over 32, that is, all but ASCII white space and control bytes.

    start, end: bytes from the first text's begin; doc: the row of each; first: a row's first word, with one more at the
    end; hash: 64 bits that depend on the word's bytes alone."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        off = offsets_of(texts)
        base = int(off[0])
        data = texts.buffers()[2] if len(texts) else None
        n = int(off[-1]) - base
        buf = np.frombuffer(data, np.uint8, n, base) if n else np.zeros(0, np.uint8)
        self.buf, self.off = buf, off - base
        ink = buf > 32
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = ink[:-1], ink[1:]
        self.start = np.flatnonzero(ink & (~before | edge[:-1]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashed:
            up, down = _BYTES.to(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(buf * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def sums(self) -> np.ndarray:
        up, _ = _WORDS.to(len(self) + 1)
        total = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(self.hash * up[: len(self)], out=total[1:])
        return total

    def grams(self, n: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n words from each word on, and whether these lie in one text."""
        total = self.sums() if total is None else total
        m = len(self) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        _, down = _WORDS.to(len(self) + 1)
        return mix((total[n:] - total[:m]) * down[:m]), self.doc[:m] == self.doc[n - 1 :]

    def spans(self, at: np.ndarray, to: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hashes of the words at..to."""
        _, down = _WORDS.to(len(self) + 1)
        return mix((total[to] - total[at]) * down[at])


class Groups:
    """Cuts rows that come sorted by the 64-bit integers of a column into tables, at changes of it only."""

    def __init__(self, key: int = 0):
        self.key = key
        self.held: list[pa.RecordBatch] = []

    def push(self, b: pa.RecordBatch) -> list[pa.Table]:
        """What is whole, now that this batch has come."""
        if not b.num_rows:
            return []
        out = []
        k = b.column(self.key).to_numpy(zero_copy_only=False)
        if self.held and self.held[-1].column(self.key)[-1].as_py() != int(k[0]):
            out += self.end()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            out.append(pa.Table.from_batches([*self.held, b.slice(0, cut)]))
            self.held = []
        self.held.append(b.slice(cut))
        return out

    def end(self) -> list[pa.Table]:
        out = [pa.Table.from_batches(self.held)] if self.held else []
        self.held = []
        return out


def whole_groups(batches, key: int = 0):
    """Tables of rows that come sorted by the 64-bit integers of a column, cut at changes of it only."""
    g = Groups(key)
    for b in batches:
        yield from g.push(b)
    yield from g.end()


def column(t: pa.Table | pa.RecordBatch, i: int) -> np.ndarray:
    """A column without nulls as NumPy."""
    c = t.column(i)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.to_numpy(zero_copy_only=False)


def run_starts(k: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, with the length at the end."""
    if not len(k):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))


def arrow_lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def from_binary(a: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """The rows of a binary array without nulls, each of so many numbers."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    a = a.cast(pa.large_binary())
    off = offsets_of(a)
    if not len(a):
        return np.zeros((0, width), dtype)
    n = (int(off[-1]) - int(off[0])) // np.dtype(dtype).itemsize
    return np.frombuffer(a.buffers()[2], dtype, n, int(off[0])).reshape(len(a), width)
