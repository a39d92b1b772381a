"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are runs of letters in lower case.  How much likelier a token is in toxic documents
comes from counts over all labelled documents with Dirichlet priors in a chain: a token's
prior is what its first eight bytes say, theirs what the first six say, then four, then the
share of all tokens.  A rare or new word of a known family so leans on its stem, and a word
without evidence stays near zero.  Counts are of documents that hold a token, kept in hashed
tables of fixed size; whole tokens have two, and the one with less evidence counts, so that a
token has to meet another in both to be taken for it.

A text's tokens score their log-odds less a drift.  One linear pass finds every maximal
segment of that sequence; merging needs only the runs of positive scores.  How high the best
segment of harmless text of that length reaches is an extreme-value law fitted on harmless
documents; segments beyond it are the passages reported, and the excess of the best and of
all together gives, by a logistic line, the document's score.

The lines are fitted on at most SAMPLE labelled documents, each scored without its own
counts.  Rows of a null or contradictory label teach nothing; without both classes every
score is the share of toxic labels (0 without labels).  A null is an empty text; texts
without tokens have no segment and score as the line says at zero.  Rows are only mapped:
repeated rows get equal scores, extra columns stay, empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import boost
from cohortkit.llm.common import limited, lower_ascii, raw_text, span_hashes

#: Bits of the hashed tables: whole tokens, and stems of 8, 6 and 4 bytes.
WORD_BITS, STEM_BITS = 20, 18
STEMS = (8, 6, 4)
#: Slots collected as one row.
BLOCK = 4096
#: Weight of a prior, in documents.
PRIOR = 4.0
DRIFT = 2.5
SAMPLE = 20_000
#: Broadcast the labels up to this many; beyond it the join shuffles.
FEW_LABELS = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True

Segment = tuple[int, int, float]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Owner, byte start and slots (stems from short to long, then the token) of all tokens."""
    raw, offsets = raw_text(texts)
    raw = lower_ascii(raw)
    inside = _LETTER[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    opens[cut] |= inside[cut]
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(~inside | opens)  # where a token may end
    ends = np.append(stops, len(raw))[np.searchsorted(stops, starts, "right")]
    owner = np.searchsorted(offsets, starts, "right") - 1
    slots = []
    for size in sorted(STEMS):
        stem = span_hashes(raw, starts, np.minimum(starts + size, ends))
        slots.append((stem >> np.uint64(64 - STEM_BITS)).astype(np.int64))
    whole = span_hashes(raw, starts, ends)
    slots.append((whole >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    slots.append((whole & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64))
    return owner, starts - offsets[owner], slots


def _sizes() -> list[int]:
    return [1 << STEM_BITS] * len(STEMS) + [1 << WORD_BITS] * 2


def segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's linear scan.

    Only positive scores open segments, so the scan goes over those; what lies between is in
    the running sums.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, lower one
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


@dataclass(frozen=True)
class Counts:
    """Documents that hold a slot, harmless and toxic, per table; and the share of toxic."""

    harmless: tuple[np.ndarray, ...]
    toxic: tuple[np.ndarray, ...]
    share: float

    def log_odds(self, slots: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of tokens against the overall share; ``own`` is the label of each token's
        document where that document was counted and is now left out."""
        p = np.full(len(slots[0]), self.share)
        found = []
        for table, slot in enumerate(slots):
            toxic, harmless = self.toxic[table][slot], self.harmless[table][slot]
            if own is not None:
                toxic, harmless = toxic - (own == 1), harmless - (own == 0)
            found.append((toxic, harmless))
        (t, h), (other_t, other_h) = found[-2:]
        less = other_t + other_h < t + h
        found[-2:] = [(np.where(less, other_t, t), np.where(less, other_h, h))]
        for toxic, harmless in found:
            p = (toxic + PRIOR * p) / (toxic + harmless + PRIOR)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))


@dataclass(frozen=True)
class Model:
    counts: Counts | None
    rate: float = 1.0  # of the extreme-value law
    size: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float = 0.0

    def excess(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far a segment is beyond the best of ``n`` harmless tokens, in nats."""
        return self.rate * score - np.log(np.maximum(self.size * n, 1e-9))


def _batch_best(scores: np.ndarray, owner: np.ndarray, n: int) -> list[list[Segment]]:
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return [segments(scores[bounds[k] : bounds[k + 1]]) for k in range(n)]


def _labels(labels: DataFrame) -> DataFrame:
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most").drop("most")
    )


def count(training: DataFrame) -> Counts:
    """Counts over all of ``training`` (text, toxic), summed per task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, size), np.int32) for size in _sizes()]
        docs = np.zeros(2, np.int64)
        for batch in limited(batches):
            label = np.asarray(batch.column(1), np.int64)
            docs += np.bincount(label, minlength=2)
            owner, _, slots = tokens(batch.column(0))
            for table, slot in zip(sums, slots, strict=True):
                size = table.shape[1]
                once = np.unique(owner * size + slot)
                np.add.at(table.reshape(-1), label[once // size] * size + once % size, 1)
        for k, table in enumerate(sums):
            at = np.flatnonzero(table.any(0))
            for i in range(0, len(at), 100_000):
                part = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)),
                        pa.array(table[0, part].astype(np.int64)), pa.array(table[1, part].astype(np.int64)),
                    ],
                    names=["level", "slot", "harmless", "toxic"],
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int32()), *(pa.array([int(d)]) for d in docs)],
            names=["level", "slot", "harmless", "toxic"],
        )

    parts = training.mapInArrow(work, "level int, slot int, harmless long, toxic long")
    rows = parts.groupBy("level", "slot").agg(F.sum("harmless").alias("h"), F.sum("toxic").alias("t"))

    def pack(group: pa.Table) -> pa.Table:
        slot = np.asarray(group["slot"]) % BLOCK
        both = np.zeros((2, BLOCK), np.float32)
        both[0, slot], both[1, slot] = np.asarray(group["h"]), np.asarray(group["t"])
        return pa.table({"level": group["level"][:1], "block": group["block"][:1], "both": pa.array([both.tobytes()], pa.binary())})

    blocks = rows.withColumn("block", F.floor(F.col("slot") / BLOCK).cast("int")).groupBy("level", "block")
    # The tables' fixed size, however large the corpus.
    got = blocks.applyInArrow(pack, "level int, block int, both binary").toArrow()
    harmless, toxic = ([np.zeros(size, np.float32) for size in _sizes()] for _ in range(2))
    docs = np.zeros(2)
    for level, block, both in zip(*(got[c] for c in ("level", "block", "both")), strict=True):
        values = np.frombuffer(both.as_buffer(), np.float32).reshape(2, BLOCK)
        if level.as_py() < 0:
            docs += values[:, 0]
            continue
        at = slice(block.as_py() * BLOCK, (block.as_py() + 1) * BLOCK)
        harmless[level.as_py()][at], toxic[level.as_py()][at] = values
    share = float(docs[1] / docs.sum()) if docs.sum() else 0.0
    return Counts(tuple(harmless), tuple(toxic), share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    known = _labels(labels)
    n = known.count()
    side = F.broadcast(known) if n <= FEW_LABELS else known
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(side, "doc_id")
    counts = count(rows.select("text", "toxic"))
    if not 0 < counts.share < 1:
        return Model(None, constant=counts.share)
    sent = spark.sparkContext.broadcast(counts)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in limited(batches):
            label = np.asarray(batch.column(1), np.int64)
            owner, _, slots = tokens(batch.column(0))
            scores = sent.value.log_odds(slots, label[owner]) - DRIFT
            found = [[s for *_, s in own] for own in _batch_best(scores, owner, len(label))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(label.astype(np.int32)), pa.array(np.bincount(owner, minlength=len(label))),
                    pa.array(found, pa.list_(pa.float64())),
                ],
                names=["toxic", "n", "scores"],
            )

    scale = 1_000_003
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, sample / max(n, 1))) + 1)
    got = drawn.select("text", "toxic").mapInArrow(best, "toxic int, n long, scores array<double>").toPandas()
    y, size = got.toxic.to_numpy(float), np.maximum(got.n.to_numpy(float), 1)
    if len(y) < 20 or y.min() == y.max():
        return Model(None, constant=counts.share)
    top = np.array([max(s, default=0.0) if len(s) else 0.0 for s in got.scores])
    # For the best of n harmless tokens: rate * top - log(n) is Gumbel around log(size).
    calm = (y == 0) & (top > 0)
    rate, k = 1.0, 1.0
    if calm.sum() >= 10:
        t, ln = top[calm], np.log(size[calm])
        for _ in range(100):  # maximum likelihood; the size has a closed form for a given rate
            k = len(t) / np.exp(ln - rate * t).sum()
            u = k * np.exp(ln - rate * t)
            slope = len(t) / rate - (t * (1 - u)).sum()
            curve = -len(t) / rate**2 - (t**2 * u).sum() + (t * u).sum() ** 2 / len(t)
            rate = float(np.clip(rate - slope / min(curve, -1e-9), rate / 2, rate * 2))
    model = Model(counts, rate, float(k))
    x = np.array([_summary(model, np.array(s, float), m) for s, m in zip(got.scores, size, strict=True)])
    order = np.lexsort((x[:, 1], x[:, 0], y))
    w = boost.fit_logistic(x[order] / [10.0, 3.0], y[order], ridge=1e-4, steps=600)
    return Model(counts, rate, float(k), (float(w[0] / 10), float(w[1] / 3), float(w[2])))


def _summary(model: Model, scores: np.ndarray, n: float) -> tuple[float, float]:
    """Excess of the best segment (within bounds), and of all segments together (in logs)."""
    if not len(scores):
        return -10.0, 0.0
    excess = model.excess(scores, np.float64(n))
    return float(np.clip(excess.max(), -10, 40)), float(np.log1p(np.maximum(excess, 0).sum()))


def score(text: Column, model: Model) -> Column:
    """A struct of ``score`` and ``passages`` (first byte, end byte, excess) of ``text``."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,excess:double>>")
    def work(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for part in parts:
            frames = []
            for batch in limited([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])]):
                frames.append(_scored(batch.column(0), own))
            yield pd.concat(frames) if frames else pd.DataFrame({"score": [], "passages": []})

    return work(F.coalesce(text.cast("string"), F.lit("")))


def _scored(texts: pa.Array, model: Model) -> pd.DataFrame:
    if model.counts is None:
        return pd.DataFrame({"score": [model.constant] * len(texts), "passages": [[]] * len(texts)})
    raw, offsets = raw_text(texts)
    owner, starts, slots = tokens(texts)
    odds = model.counts.log_odds(slots) - DRIFT
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    sizes = np.diff(bounds)
    scores, passages = [], []
    for k in range(len(texts)):
        own = segments(odds[bounds[k] : bounds[k + 1]])
        values = np.array([s for *_, s in own])
        x = _summary(model, values, max(sizes[k], 1))
        z = model.weights[0] * x[0] + model.weights[1] * x[1] + model.weights[2]
        scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        excess = model.excess(values, np.float64(max(sizes[k], 1))) if len(own) else []
        places = starts[bounds[k] : bounds[k + 1]]
        length = int(offsets[k + 1] - offsets[k])
        passages.append(
            [
                {"start": int(places[s]), "end": int(places[e]) if e < len(places) else length, "excess": float(x)}
                for (s, e, _), x in zip(own, excess, strict=True)
                if x > 0
            ]
        )
    return pd.DataFrame({"score": scores, "passages": passages})
