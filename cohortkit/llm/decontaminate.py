"""Benchmark passages in documents, found by fingerprints of item-sized windows.

Words are lower-cased (A-Z) and cut at blanks; an item is the multiset of its five-word
shingles (all its words, if fewer).  A document matches an item if some window as long as
the item (or the whole document, if shorter) has a weighted Jaccard similarity, the sum of
the lesser over the sum of the greater multiplicities, of at least 0.8.

Which windows: one that reaches 0.8 shares a shingle, and moving it right to its first
shared shingle keeps all it shares.  So the windows that start at a shared shingle (moved
left where the document ends) are enough, and all of them are taken.  Each gets a 64-bit
SimHash of its shingles.  The items' fingerprints are indexed by blocks of bits: two
fingerprints within RADIUS differ in some block by at most RADIUS // BLOCKS bits, so looking
up a window's blocks finds every item within RADIUS.  Those are verified exactly.  At a
similarity of 0.8 fingerprints are expected to differ in 10 of 64 bits, with a deviation of
3; RADIUS leaves more than three deviations, so about one pair in 2,000 at the very edge of
0.8 is not looked at, and next to none above it.  Few shingles make coarser sums, which vary
more: windows or items of under SURE shingles are verified against every item they share a
shingle with.

The benchmark is held in slices of at most SLICE shingles, one pass over the documents for
each, so what a task holds does not grow with it.  Null and empty texts hold nothing and
match nothing, as do null and empty items.  Equal items match alike; repeated rows each get
their matches; a null item_id is a match without a name.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import (
    limited, lower_ascii, mix, raw_text, release, shingle_hashes, span_hashes, word_spans,
)

WORDS = 5
SIMILAR = 0.8
RADIUS = 20
BLOCKS = 7
SURE = 24
SLICE = 2_000_000
#: Bytes of text cut into shingles at once, and of windows whose items a slice remembers.
TEXT = 1 << 20
REMEMBERED = 4 << 20

_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
_BITS = int(np.diff(_EDGES).max())
MATCHES = "array<struct<item_id:long,start_word:int,n_words:int,similarity:double>>"


def simhash(shingles: np.ndarray) -> int:
    """Sign of the sum over shingles (repeated ones as often) of each bit as plus or minus one."""
    bits = np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays as multisets."""
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(inverse[: len(a)], minlength=len(values))
    right = np.bincount(inverse[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / max(np.maximum(left, right).sum(), 1))


def _block(value: int, k: int) -> int:
    low, high = int(_EDGES[k]), int(_EDGES[k + 1])
    return (value >> low) & ((1 << (high - low)) - 1)


def _code(size, block, value):
    """Key of a block's value in the fingerprint of an item of ``size`` words."""
    return (size * BLOCKS + block) << _BITS | value


def _near(value: int, width: int) -> list[int]:
    """All block values within RADIUS // BLOCKS bits."""
    return [
        value ^ sum(1 << b for b in flips)
        for n in range(RADIUS // BLOCKS + 1)
        for flips in combinations(range(width), n)
    ]


@dataclass
class Slice:
    """Some items of one shingle length: shingles, fingerprints, and the block index."""

    k: int
    ids: list = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # in words
    shingles: list[np.ndarray] = field(default_factory=list)  # sorted

    def close(self) -> Slice:
        self.prints = [simhash(s) for s in self.shingles]
        values, codes = np.array(self.prints, np.uint64), []
        for block in range(BLOCKS):
            width = int(_EDGES[block + 1] - _EDGES[block])
            own = (values >> np.uint64(_EDGES[block])).astype(np.int64) & ((1 << width) - 1)
            near = own[:, None] ^ np.array(_near(0, width))
            codes.append((_code(np.array(self.sizes)[:, None], block, near)).ravel())
        items = [np.repeat(np.arange(len(values), dtype=np.int32), len(c) // len(values)) for c in codes]
        order = np.argsort(flat_codes := np.concatenate(codes), kind="stable")
        self.codes, self.items = flat_codes[order], np.concatenate(items)[order]
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.shingles])
        flat = np.concatenate(self.shingles)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.flat >> np.uint64(42)).astype(np.int64)] = True
        self.memo: dict[bytes, list[tuple[int, float]]] = {}
        self.held = 0
        return self

    def alike(self, size: int, window: np.ndarray) -> list[tuple[int, float]]:
        """Items of ``size`` words that the window's shingles match."""
        window = np.sort(window)
        key = size.to_bytes(4, "big") + window.tobytes()
        if key not in self.memo:
            if self.held > REMEMBERED:
                self.memo.clear()
                self.held = 0
            self.held += len(key) + 200
            value = simhash(window)
            asked = [_code(size, block, _block(value, block)) for block in range(BLOCKS)]
            left, right = (np.searchsorted(self.codes, asked, side) for side in ("left", "right"))
            held = {i for a, b in zip(left, right, strict=True) for i in self.items[a:b].tolist()}
            near = {i for i in held if (value ^ self.prints[i]).bit_count() <= RADIUS}
            if min(len(window), size - self.k + 1) < SURE:
                left, right = (np.searchsorted(self.flat, window, side) for side in ("left", "right"))
                sharing = {i for a, b in zip(left, right, strict=True) for i in self.owner[a:b].tolist()}
                near |= {i for i in sharing if self.sizes[i] == size}
            found = [(i, weighted_jaccard(window, self.shingles[i])) for i in sorted(near)]
            self.memo[key] = [(i, s) for i, s in found if s >= SIMILAR]
        return self.memo[key]

    def search(self, words: np.ndarray, first: np.ndarray) -> dict[int, dict]:
        """Per text: item to its best match (similarity, first word, number of words)."""
        counts = np.diff(first)
        value, owner = shingle_hashes(words, first, self.k)
        maybe = np.flatnonzero(self.seen[(value >> np.uint64(42)).astype(np.int64)])
        left = np.searchsorted(self.flat, value[maybe], "left")
        right = np.searchsorted(self.flat, value[maybe], "right")
        hit = np.flatnonzero(right > left)
        per_text = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
        out: dict[int, dict] = {}
        tried: set[tuple[int, int, int]] = set()
        for h in hit.tolist():
            at = int(maybe[h])
            text = int(owner[at])
            base, total, n = int(per_text[text]), int(counts[text]), int(per_text[text + 1] - per_text[text])
            for size in {self.sizes[i] for i in self.owner[left[h] : right[h]].tolist()}:
                start = max(0, min(at - base, total - size))
                if (text, start, size) in tried:
                    continue
                tried.add((text, start, size))
                last = min(start + max(size - self.k + 1, 1), n)
                for i, similar in self.alike(size, value[base + start : base + last]):
                    best = out.setdefault(text, {})
                    if similar > best.get(i, (0.0,))[0]:
                        best[i] = (similar, start, min(size, total))
        return out


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = raw_text(texts)
    raw = lower_ascii(raw)
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def slices(benchmark: DataFrame, most: int = SLICE) -> Iterator[list[Slice]]:
    """The benchmark (item_id, text) in parts of about ``most`` shingles."""
    open_: dict[int, Slice] = {}
    held = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        words, first = _hashed(pa.array([row.text or ""]))
        if not len(words):
            continue
        k = min(WORDS, len(words))
        own = open_.setdefault(k, Slice(k))
        own.ids.append(row.item_id)
        own.sizes.append(len(words))
        own.shingles.append(np.sort(shingle_hashes(words, first, k)[0]))
        held += len(own.shingles[-1])
        if held >= most:
            yield [s.close() for s in open_.values()]
            open_, held = {}, 0
    if open_:
        yield [s.close() for s in open_.values()]


def _matches(texts: pa.Array, parts: list[Slice]) -> list[list[dict]]:
    words, first = _hashed(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for part in parts:
        for text, items in part.search(words, first).items():
            out[text] += [
                {"item_id": part.ids[i], "start_word": start, "n_words": n, "similarity": similar}
                for i, (similar, start, n) in sorted(items.items())
            ]
    return out


_MATCH = pa.list_(pa.struct(
    [("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]
))


def _finder(sent: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def work(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            whole = pa.RecordBatch.from_arrays([texts], ["text"])
            rows = [m for batch in limited([whole], most=TEXT) for m in _matches(batch.column(0), sent.value)]
            yield pa.array(rows, _MATCH)
        release()

    work.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return work


def matches(text: Column, benchmark: DataFrame) -> Column:
    """The best window of each matching item in ``text``; an empty array without a match."""
    context = benchmark.sparkSession.sparkContext
    whole = F.coalesce(text.cast("string"), F.lit(""))
    found = [
        F.arrow_udf(_finder(context.broadcast(part)), MATCHES)(whole) for part in slices(benchmark)
    ]
    if not found:
        return F.from_json(F.lit("[]"), MATCHES)
    return found[0] if len(found) == 1 else F.concat(*found)
