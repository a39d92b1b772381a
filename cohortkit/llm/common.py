"""What the operators share: inputs, staged tables, text batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit import sinks

#: Text handled at once in a task; a longer document is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table in the cluster's shared folder: computed once, outlives executors."""
    return sinks.stage(df, sinks.shared_folder(df.sparkSession))


def text_column(df: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def tasks(df: DataFrame) -> int:
    """Partitions for work by key: as many as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives its memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return tidied


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names for ``n`` helper columns that no column of ``df`` has, whatever the letters' case."""
    have = {c.lower() for c in df.columns}
    return [name for name in (f"helper{i}" for i in range(len(have) + n)) if name not in have][:n]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that results of these ``names`` replace."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def limited(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes.

    What the work on a batch has freed goes back to the machine before the next.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            trim()
            start, base = stop, int(ends[stop - 1])


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch, and where each text starts (and the last ends)."""
    whole = pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_string())])
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[
        whole.offset : whole.offset + len(whole) + 1
    ]
    data = whole.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

# Fixed random numbers, one for a byte; and an odd base with its inverse modulo 2**64.
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 2048


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to the ``n``-th, as products of a coarse and a fine one."""

    def row(base: int, size: int) -> np.ndarray:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return row(pow(base, _STEP, 2**64), n // _STEP + 1), row(base, _STEP)


def release() -> None:
    """Give memory that this worker process no longer uses back to the machine.

    Spark reuses Python workers; what one task has freed should not stand beside the next
    task's memory.
    """
    gc.collect()
    trim()


def trim() -> None:
    """``release`` for use between the batches of a task: a few milliseconds, no search for cycles."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not on this platform
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text.

    The third array has one more entry than there are texts: text i has the words
    ``first[i]`` up to ``first[i + 1]``.
    """
    n = len(raw)
    inside = ~BLANK[raw]
    opens, closes = inside.copy(), np.zeros(n + 1, bool)
    opens[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    opens[cut] |= inside[cut]
    starts = np.flatnonzero(opens)
    closes[1:n] = inside[:-1] & ~inside[1:]
    if n:
        closes[n] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[cut > 0]
    closes[cut] |= inside[cut - 1]
    ends = np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: the same bytes, the same hash, anywhere.

    A polynomial over random numbers per byte, from differences of one running sum.
    """
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.take(_TABLE, raw, out=sums[1:], mode="clip")
    coarse, fine = _powers(_BASE, n)
    for k in range(len(coarse)):
        own = sums[1 + k * _STEP : 1 + (k + 1) * _STEP]
        own *= fine[: len(own)]
        own *= coarse[k]
    np.cumsum(sums, out=sums)
    coarse, fine = _powers(pow(_BASE, -1, 2**64), n)
    value = sums[ends] - sums[starts]
    value *= coarse[starts // _STEP]
    value *= fine[starts % _STEP]
    return mix(value + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text and the text each belongs to.

    A text with fewer words (but at least one) has its whole sequence as its shingle.
    """
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(words):
        return np.zeros(0, np.uint64), owner
    place = np.arange(len(words)) - first[:-1][owner]
    total = counts[owner]
    left = np.minimum(total - place, k)
    keep = (left == k) | ((place == 0) & (total < k))
    value = words.copy()
    for j in range(1, k):
        nxt = np.zeros_like(words)
        nxt[:-j] = words[j:] if j < len(words) else 0
        value = np.where(left > j, mix(value * np.uint64(_BASE) + nxt + np.uint64(j)), value)
    value = mix(value + left.astype(np.uint64))
    return value[keep], owner[keep]


def hex_digest(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()
