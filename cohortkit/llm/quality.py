"""Quality by co-training: a text view and a metadata view teach each other.

The text view sees how kinds of characters follow each other and how words repeat; the
metadata view sees source, language, length and line layout.  Both are logistic models,
first fitted on labelled documents.  In each round both views score all unlabelled documents
in one Spark pass; each labels those on which its calibrated probability is confident, for the
other to learn from, and both refit.  A confident label is one at a probability where the
view's held-out precision is CONFIDENT.  At the end each view is calibrated on held-out
labelled documents, a last regression weighs the two log-odds, and every document is scored.

The models are fitted on bounded samples of labelled rows, drawn by hash of doc_id: at most
SAMPLE documents labelled by hand, and of those labelled by either view in a round, at most
TAUGHT for each view and class.  Equal doc_ids count once.  Labels that are null, or differ
for one doc_id, are left out.  With fewer than two classes every score is the share of good
labels (0.5 without labels).  Nulls are empty texts and unknown metadata; empty texts are
scored as such.  Repeated rows get equal scores; extra columns stay; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import boost
from cohortkit.llm.common import limited, raw_text, release, span_hashes, staged, tidy, word_spans

SAMPLE = 3_000
TAUGHT = 750
ROUNDS = 4
CONFIDENT = 0.97
#: Documents whose views are made at once.
TOGETHER = 128

# Lower case, upper case, digit, blank, line end, beyond ASCII, and each sign on its own.
_SIGNS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 0, 1, 2, 3, 4
_CLASS[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
_N = 6 + len(_SIGNS)
_HASHED = 64

META = ("source", "lang")


def text_view(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of pairs of character kinds, and how words repeat."""
    raw, offsets = raw_text(texts)
    n = len(offsets) - 1
    out = np.zeros((n, _N * _N + 3), np.float32)
    if not len(raw):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    code = _CLASS[raw]
    within = owner[1:] == owner[:-1]
    pair = owner[1:] * (_N * _N) + code[:-1] * _N + code[1:]
    counts = np.bincount(pair[within], minlength=n * _N * _N).reshape(n, -1)
    out[:, :-3] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(raw, starts, ends)
    if len(words):
        doc = np.repeat(np.arange(n), np.diff(first))
        total = np.maximum(np.diff(first), 1)
        same = np.zeros(len(words))
        same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((words, doc))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        out[:, -3] = np.bincount(doc, same, n) / total
        out[:, -2] = np.bincount(doc[order], new, n) / total
        out[:, -1] = np.bincount(doc, (ends - starts) > 24, n) / total
    return out


def meta_view(batch: dict[str, list], texts: pa.Array) -> np.ndarray:
    """Source and language by hash, length by powers of two, lines and their length."""
    raw, offsets = raw_text(texts)
    n = len(offsets) - 1
    out = np.zeros((n, 2 * _HASHED + 24), np.float32)
    for k, name in enumerate(META):
        names = pa.array(batch[name], pa.string()).fill_null("\0")
        data, bounds = raw_text(names)
        slot = span_hashes(data, bounds[:-1], bounds[1:]) % np.uint64(_HASHED)
        out[np.arange(n), k * _HASHED + slot.astype(np.int64)] = 1
    sizes = np.diff(offsets)
    chars = np.array([s if c is None else c for c, s in zip(batch["n_chars"], sizes, strict=True)], float)
    bucket = np.clip(np.log2(np.maximum(chars, 1)).astype(int), 0, 19)
    out[np.arange(n), 2 * _HASHED + bucket] = 1
    lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(raw == 10), "right") - 1, minlength=n)
    out[:, -4] = np.log1p(lines) / 10
    out[:, -3] = np.log1p(sizes / (lines + 1)) / 10
    out[:, -2] = np.log1p(sizes) / 10
    out[:, -1] = lines > 0
    return out


@dataclass(frozen=True)
class Model:
    """Weights of both views, their calibration lines, and the weights of the combination."""

    text: np.ndarray | None
    meta: np.ndarray | None
    lines: tuple[tuple[float, float], ...] = ()
    combine: np.ndarray | None = None
    constant: float = 0.5

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None or self.meta is None or self.combine is None:
            return np.full(len(text), self.constant)
        odds = [
            a * (x @ w[:-1] + w[-1]) + b
            for x, w, (a, b) in zip((text, meta), (self.text, self.meta), self.lines, strict=True)
        ]
        z = np.clip(np.stack(odds, 1), -30, 30) @ self.combine[:-1] + self.combine[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sure(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Least probability above which, and highest below which, held-out labels agree."""

    def edge(score: np.ndarray, right: np.ndarray) -> float:
        down = np.argsort(-score, kind="stable")
        good = np.cumsum(right[down]) / np.arange(1, len(right) + 1) >= CONFIDENT
        good &= np.arange(1, len(right) + 1) >= 10
        at = np.flatnonzero(good)
        return float(score[down][at[-1]]) if len(at) else math.inf

    return edge(p, y == 1), 1 - edge(1 - p, y == 0)


#: Views of documents and the labels given to them.
Taught = tuple[tuple[np.ndarray, np.ndarray], np.ndarray]


def cotrain(
    views: tuple[np.ndarray, np.ndarray], y: np.ndarray,
    teach: Callable[[int, list[np.ndarray], list[tuple[float, float]], list[tuple[float, float]]], list[Taught]],
    rounds: int = ROUNDS,
) -> Model:
    """From ``views`` of labelled rows with labels ``y``.  ``teach`` is told the round, both
    views' weights, calibration lines and confident probabilities (least for good, most for
    bad), and returns what each view labels."""
    if len(y) < 20 or y.min() == y.max():
        return Model(None, None, constant=float(y.mean()) if len(y) else 0.5)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::3]] = True
    taught: list[Taught] = []
    for turn in range(rounds):
        weights, lines, sure = [], [], []
        for k in (0, 1):
            x, labels = views[k][~held], y[~held]
            if taught:
                other, guess = taught[1 - k]
                x, labels = np.vstack([x, other[k]]), np.concatenate([labels, guess])
            weights.append(boost.fit_logistic(x, labels))
            s = views[k][held] @ weights[k][:-1] + weights[k][-1]
            lines.append(boost.fit_line(s, y[held]))
            sure.append(_sure(_probability(views[k][held], weights[k], lines[k]), y[held]))
        if turn + 1 < rounds:
            taught = teach(turn, weights, lines, sure)
    odds = np.stack([a * (v[held] @ w[:-1] + w[-1]) + b for v, w, (a, b) in zip(views, weights, lines, strict=True)], 1)
    combine = boost.fit_logistic(np.clip(odds, -30, 30), y[held], ridge=1e-2)
    return Model(weights[0], weights[1], tuple(lines), combine)


def _probability(x: np.ndarray, weights: np.ndarray, line: tuple[float, float]) -> np.ndarray:
    odds = line[0] * (x @ weights[:-1] + weights[-1]) + line[1]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _columns(docs: DataFrame) -> list[Column]:
    have = dict(docs.dtypes)
    meta = [F.col(c).cast("string") if c in have else F.lit(None).cast("string") for c in META]
    chars = F.col("n_chars").cast("long") if "n_chars" in have else F.lit(None).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [text.alias("text"), meta[0].alias("source"), meta[1].alias("lang"), chars.alias("n_chars")]


def _views(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch: text, source, lang and n_chars."""
    parts = []
    for i in range(0, max(len(columns[0]), 1), TOGETHER):
        text, source, lang, chars = (c.slice(i, TOGETHER) for c in columns)
        meta = {"source": source.to_pylist(), "lang": lang.to_pylist(), "n_chars": chars.to_pylist()}
        parts.append((text_view(text), meta_view(meta, text)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, taught: int = TAUGHT) -> Model:
    """Fit on about ``sample`` labelled documents, and in each round on about ``taught`` of those
    that either view labels good or bad, from all others."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most").drop("most")
    )
    scale = 1_000_003
    rows = docs.where("doc_id is not null").select("doc_id", *_columns(docs))

    def drawn(salt: int, n: int, most: int) -> Column:
        """About ``most`` of ``n`` documents, by hash."""
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(scale)) < int(scale * min(1.0, most / max(n, 1))) + 1

    def fetched(picked: DataFrame) -> pa.Table:
        """The rows of a drawn, hence bounded, sample of doc_ids."""
        found = rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
        return found.toArrow().sort_by("doc_id").combine_chunks()

    def viewed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _views([pa.concat_arrays(table[c].chunks) if table.num_rows else pa.array([], table.schema.field(c).type)
                       for c in ("text", *META, "n_chars")])

    def teach(
        turn: int, weights: list[np.ndarray], lines: list[tuple[float, float]], sure: list[tuple[float, float]]
    ) -> list[Taught]:
        def guesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in limited(batches):
                given = []
                for x, w, line, (high, low) in zip(_views(batch.columns[1:]), weights, lines, sure, strict=True):
                    p = _probability(x, w, line)
                    given.append(pa.array((p >= high).astype(np.int32), mask=(p < high) & (p > low)))
                both = pa.RecordBatch.from_arrays([batch.column(0), *given], names=["doc_id", "text", "meta"])
                yield both.filter(pc.or_(given[0].is_valid(), given[1].is_valid()))

        kind = docs.schema["doc_id"].dataType.simpleString()
        sure_ = staged(rows.mapInArrow(tidy(guesses), f"doc_id {kind}, text int, meta int").join(known, "doc_id", "left_anti"))
        found = [(view, c) for view in ("text", "meta") for c in (0, 1)]
        counts = sure_.agg(*(F.count(F.when(F.col(view) == c, 1)) for view, c in found)).first()
        picks = [(F.col(view) == c) & drawn(turn + 1, n, taught) for (view, c), n in zip(found, counts, strict=True)]
        few = sure_.select("doc_id", *(
            F.when(picks[2 * k], 0).when(picks[2 * k + 1], 1).alias(f"by_{view}") for k, view in enumerate(("text", "meta"))
        ))
        table = fetched(few.where("by_text is not null or by_meta is not null"))
        views = viewed(table)
        out: list[Taught] = []
        for name in ("by_text", "by_meta"):
            labels = table[name].to_numpy().astype(float)  # null is NaN
            own = ~np.isnan(labels)
            out.append(((views[0][own], views[1][own]), labels[own]))
        return out

    some = fetched(known.where(drawn(0, known.count(), sample)))
    return cotrain(viewed(some), some["quality"].to_numpy().astype(float), teach)


def score(docs: DataFrame, model: Model) -> Column:
    """Probability that a row of ``docs`` is of good quality."""

    @F.arrow_udf("double")
    def work(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in parts:
            batch = pa.RecordBatch.from_arrays(list(part), names=["text", *META, "n_chars"])
            found = [model.score(*_views(own.columns)) for own in limited([batch])]
            yield pa.array(np.concatenate([np.zeros(0), *found]))
        release()

    return work(*_columns(docs))
