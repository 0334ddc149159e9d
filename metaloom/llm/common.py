"""What several of these operators share: table access, stored intermediates, and vectorised hashing of words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, opened by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver reach: spark.checkpoint.dir, or, on a local master alone, a temporary one."""
    if (d := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.gettempdir()}/metaloom-shared"
    return d.rstrip("/")


def fresh(columns, *names: str) -> list[str]:
    """The given names, each lengthened until it clashes with none of ``columns``, upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def repeats(base: DataFrame, key: str = "id") -> bool:
    """Whether a key stands in several rows."""
    return not base.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage and outlives lost executors. It goes when the driver ends, or by ``discard``.

    ``file_rows``: the most rows of a file, for large rows: a reader decodes up to 4,096 rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/metaloom/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._metaloom_path = path
    atexit.register(_remove, spark, path)
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes a stored intermediate that nothing reads any more."""
    _remove(spark, df._metaloom_path)


def free_memory() -> None:
    """Gives what this process has freed back to the system, where its C library can: else the driver keeps the peak of a training for good."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def random_table(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random unsigned 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = random_table(256, 11)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), 95, *range(128, 256)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def text_slices(column: pa.Array, most_bytes: int = 1 << 21):
    """(first, last + 1, bytes, offsets) of runs of texts of about ``most_bytes``; a null is an empty text, and a longer text is a run of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def thin(batches, rows: int = 1024):
    """Batches of at most ``rows`` rows, so that copies of their texts stay small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, none of which crosses a text's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    return np.flatnonzero(mask & (~before | edge[:-1])), np.flatnonzero(mask & (~after | edge[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each of the ascending, disjoint, non-empty spans of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum()), dtype=np.int64)
    inner = at - np.repeat(first, n)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max()), _STEP, np.uint64)]), dtype=np.uint64)
    table = _BYTE if not seed else random_table(256, 11 + seed)
    h = np.add.reduceat(table[data[at + np.repeat(starts - first, n)]] * powers[inner], first)
    return mix64(h + n.astype(np.uint64))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits, _ and bytes beyond ASCII) and each text's first word, with an end."""
    starts, ends = runs(_WORD_BYTE[data], off)
    return span_hashes(data, starts, ends), np.searchsorted(starts, off)


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words and each text's first one, with an end. A text of fewer words, but one at least, has one of all its words."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    length = np.minimum(np.repeat(n, count), width)
    h = np.zeros(len(start), np.uint64)
    for k in range(width):
        has = length > k
        w = words[np.minimum(start + k, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(has, h * np.uint64(0xC2B2AE3D27D4EB4F) + w, h)
    return mix64(h + length.astype(np.uint64)), at
