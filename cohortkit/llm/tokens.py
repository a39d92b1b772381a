"""Token ids as binary blocks with Elias-Fano coded document boundaries.

The file format is a Parquet table, written by Spark's own committer (so that a lost
executor leaves no half file) to any store Spark can write.  A row is a block: some
documents in ascending doc_id order, their ids end to end in 16 or 32 bits, where each
document starts as one Elias-Fano sequence, and the doc_ids as another.  A sequence of n
values up to u takes about n * (2 + log2(u / n)) bits; a select structure, the place of
every 256th one bit, finds the i-th value without reading the rest.  Where a block starts
among all ids follows from the totals of the parts.

Null texts are empty and have only the end id.  Documents without doc_id come first and
are counted per block; equal doc_ids stand in the order of a hash of their texts.  An empty
table gives an empty table.  Extra columns are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import limited, tasks, text_column
from cohortkit.llm.pieces import gather, pieces

#: Ids in a block, unless its only document has more.
BLOCK_IDS = 1 << 19
#: One bits between two entries of the select structure.
SAMPLE = 256
#: Pieces a task keeps the ids of; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Pieces given to the library at once.
TOGETHER = 10_000

BLOCK = (
    "part int, block int, before long, n_docs int, n_ids long, width int, ids binary, "
    "starts_low binary, starts_high binary, starts_select binary, starts_bits int, "
    "n_null int, first_doc long, docs_low binary, docs_high binary, docs_select binary, "
    "docs_bits int"
)


@dataclass(frozen=True)
class EliasFano:
    """Ascending numbers: ``bits`` low bits of each packed, the rest in unary."""

    n: int
    bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = np.arange(bits, dtype=np.uint64)
        low = ((values[:, None] >> places) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(
            n, bits, np.packbits(low, bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(last - first, np.uint64)
        start, stop = first * self.bits, last * self.bits
        raw = np.frombuffer(self.low, np.uint8)[start // 8 : (stop + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[start % 8 :][: stop - start]
        weights = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return bits.reshape(-1, self.bits).astype(np.uint64) @ weights

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample on, at most ``SAMPLE`` ones are counted."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, seen, raw = i % SAMPLE, at - at % 8, np.frombuffer(self.high, np.uint8)
        skip = at % 8
        while True:
            bits = np.unpackbits(raw[seen // 8 : seen // 8 + 64], bitorder="little")
            ones = np.flatnonzero(bits[skip:]) + skip
            if left < len(ones):
                place = seen + int(ones[left])
                break
            left, seen, skip = left - len(ones), seen + len(bits), 0
        return ((place - i) << self.bits) | int(self._low(i, i + 1)[0])

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        high = (ones[: self.n] - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(0, self.n)


class Tokens:
    """One task's tokenizer and the pieces it has met lately."""

    _own: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._own:
            cls._own = {path: cls(path)}
        return cls._own[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text starts."""
        different, numbers, first = pieces(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        words = different.to_numpy(zero_copy_only=False).tolist()
        row = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(row < 0)
        fresh = [words[k] for k in new.tolist()]
        parts, counts = [self.ids], []
        for i in range(0, len(fresh), TOGETHER):
            coded = self.tokenizer.encode_batch_fast(fresh[i : i + TOGETHER], add_special_tokens=False)
            flat: list[int] = []
            for c in coded:
                before = len(flat)
                flat += c.ids  # the property makes a list each time
                counts.append(len(flat) - before)
            parts.append(np.fromiter(flat, np.uint32, len(flat)))
        if fresh:
            row[new] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(fresh, row[new].tolist(), strict=True))
            self.ids = np.concatenate(parts)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return gather(self.ids, self.ends, row[numbers] if len(numbers) else numbers, first)


def _block(part: int, block: int, before: int, width: int, docs: list, lists: list) -> dict:
    counts = np.array([len(x) for x in lists], np.int64)
    null = sum(d is None for d in docs)
    known = np.array([d for d in docs if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    starts = EliasFano.encode(np.cumsum(counts) - counts)
    names = EliasFano.encode(known.astype(np.uint64) - np.int64(base).astype(np.uint64))
    ids = np.concatenate(lists)
    return {
        "part": part, "block": block, "before": before, "n_docs": len(docs), "n_ids": len(ids),
        "width": width, "ids": ids.astype(f"<u{width}").tobytes(),
        "starts_low": starts.low, "starts_high": starts.high, "starts_select": starts.samples,
        "starts_bits": starts.bits, "n_null": null, "first_doc": base, "docs_low": names.low,
        "docs_high": names.high, "docs_select": names.samples, "docs_bits": names.bits,
    }


_ARROW = pa.schema(
    [
        (name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (x.split() for x in BLOCK.split(", "))
    ]
)


def write_blocks(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS
) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(tokenizer)
        width = tokens.width if end_id < 1 << 8 * tokens.width else 4
        part, block, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        lists: list = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal block, before, names, lists, held
            row = _block(part, block, before, width, names, lists)
            block, before, names, lists, held = block + 1, before + held, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in limited(batches):
            ids, bounds = tokens.encode(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                if names and held + len(own) > block_ids:
                    yield full()
                names.append(doc)
                lists.append(own)
                held += len(own)
        if names:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(tasks(docs), *order).sortWithinPartitions(*order, "text")
    dealt.mapInArrow(work, BLOCK).write.mode("overwrite").parquet(path)


def _starts(row: dict) -> EliasFano:
    return EliasFano(row["n_docs"], row["starts_bits"], row["starts_low"], row["starts_high"], row["starts_select"])


def _names(row: dict) -> EliasFano:
    n = row["n_docs"] - row["n_null"]
    return EliasFano(n, row["docs_bits"], row["docs_low"], row["docs_high"], row["docs_select"])


def document(row: dict, i: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the i-th document of a block, by select; nothing else is decoded."""
    first = _starts(row).select(i)
    last = _starts(row).select(i + 1) if i + 1 < row["n_docs"] else row["n_ids"]
    width = row["width"]
    ids = np.frombuffer(row["ids"][first * width : last * width], f"<u{width}")
    k = i - row["n_null"]
    return (None if k < 0 else row["first_doc"] + _names(row).select(k)), ids


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each task that wrote.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").withColumn("before", F.col("before") + F.col("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                starts = _starts(row).decode().astype(np.int64)
                ends = np.append(starts[1:], len(ids))
                docs = [None] * row["n_null"] + [row["first_doc"] + int(x) for x in _names(row).decode()]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()), pa.array(starts + row["before"], pa.int64()),
                        pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.drop("base").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
