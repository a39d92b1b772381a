"""Personal data: rule spans, and candidate spans selected by boosted trees.

Rules report e-mail addresses, IPv4 addresses, card numbers that pass the Luhn check and
international phone numbers; their spans always stay.  Generators with high recall propose
more and overlapping spans (numbers with any separators, disguised addresses, account
numbers).  Account numbers whose ISO 7064 check (mod 97) holds are confirmed and always added,
also where a rule takes part of their digits for something else.  Boosted trees judge every
other candidate by its format and its context; it is added when its calibrated probability
reaches the threshold of its family and no rule span or confirmed account overlaps it.

The trees learn without span labels: rule spans, the same spans disguised (no plus sign or
country code, other separators, "at" and "dot" spelt out) and confirmed accounts, in their own
context, are positive.  Candidates that nothing confirms are unlabelled, as real data may be
among them: a first fit counts them and some positives (spies) as negative, and only those
below nearly all spies are taken for negatives; the others neither teach nor count.  The fit
is on the candidates of all documents, equal ones as one with their number; up to HELD different
ones are fitted on the driver, more by passes over a staged table, with the same trees.  A
family's threshold is the least probability whose precision on the held-out half is PRECISION,
and a family with fewer than LEAST held-out cases adds only what is confirmed.

A null is an empty text; spans count code points, the end exclusive.  Rows are only mapped:
repeated rows, ties, extra columns and empty tables need no rule.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit import sinks
from cohortkit.llm import boost
from cohortkit.llm.common import limited, release

#: Different examples that the driver fits on itself at most.
HELD = 50_000
TREES = 40
#: Margins count in steps of 1 / STEPS, so that their numbers are a table of bounded size.
STEPS = 1024
PRECISION = 0.99
LEAST = 30
#: Share of the positives that spy among the unlabelled, and of the spies below the negatives' limit.
SPIES, LOST = 0.15, 0.05

KINDS = ("email", "ip", "card", "phone", "number", "address", "account")
BASE_KINDS = KINDS[:4]

# The rules.  (The look-behind and possessive runs only save time: a run that
# fails from its first character fails from any other.)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators.
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?![0-9])")
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]| at )\s?[A-Za-z0-9-]{1,64}"
    r"(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]{2,24}){1,4}"
)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
# The same from every place, as one match may hide another.
_ACCOUNTS = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?))")
ACCOUNT_LEAST = 15
_CUES = re.compile(
    r"phone|tel|call|fax|mobile|mail|contact|card|visa|credit|account|iban|bank|ssn|passport|ip", re.I
)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, each kind's leftmost matches, failing ones dropped."""
    found: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return found


def is_account(text: str) -> bool:
    """Whether the ISO 7064 check of letters and digits holds (the first four go last)."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def accounts(text: str) -> list[Span]:
    """Confirmed account numbers, leftmost first and each as long as can be; none overlap."""
    found: list[Span] = []
    end = 0
    for m in _ACCOUNTS.finditer(text):
        start = m.start()
        if start < end:
            continue
        # A match may go on into the words behind the number.
        stops = [m.end(1), *(start + k for k in range(len(m[1]) - 1, 0, -1) if m[1][k] == " ")]
        for stop in stops:
            bare = text[start:stop].replace(" ", "")
            if len(bare) >= ACCOUNT_LEAST and not text[stop : stop + 1].isalnum() and is_account(bare):
                found.append((start, stop, "account"))
                end = stop
                break
    return found


def candidates(text: str) -> list[Span]:
    """Proposed spans; they may overlap each other and the rules' spans."""
    found = [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    if "@" in text or " at " in text or "(at)" in text or "[at]" in text:
        found += [(*m.span(), "address") for m in _ADDRESS.finditer(text)]
    found += [(*m.span(), "account") for m in _ACCOUNT.finditer(text)]
    return found


def features(before: str, span: str, after: str, kind: str) -> list[float]:
    """Format of the span and the characters and words around it."""
    digits = [c for c in span if c in "0123456789"]
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    letters = sum(c.isalpha() for c in span)
    cue = _CUES.search(before)
    digits_text = "".join(digits)
    return [
        len(span), len(digits), letters, len(groups), groups[0], groups[-1], max(groups),
        min(groups), span.count(" "), span.count("-"), span.count("."), span.count("/"),
        span.count("("), float(span[:1] == "+"), float(span[:1] == "("), float("@" in span),
        float(" at " in span or "(at)" in span or "[at]" in span),
        float(bool(re.search(r"\.[A-Za-z]{2,24}$", span))), float(digits_text[:1] == "0"),
        float(13 <= len(digits) <= 19 and luhn(digits_text)), len(set(digits)),
        float(bool(cue)), float(before[-1:].isspace()), float(before[-1:].isalnum()),
        float(before[-1:] in "=:\"'"), float(after[:1].isspace()), float(after[:1].isalnum()),
        float(after[:1] in ".,;"), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        float(kind == "number"), float(kind == "address"), float(kind == "account"),
    ]


_CONTEXT = 24


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - _CONTEXT) : start], text[start:end], text[end : end + _CONTEXT]


def _disguises(span: str, kind: str) -> list[tuple[str, str]]:
    if kind == "phone":
        bare = span.lstrip("+")
        national = re.sub(r"^\+[0-9]{1,3}(?:[ .-]+|(?=\())", "", span)
        own = [(national, "number")] if national != span and sum(c.isdigit() for c in national) >= 7 else []
        return [(span, "number"), (bare, "number"), (re.sub(r"[ ()]+", "-", bare).strip("-"), "number"), *own]
    if kind == "email":
        spelt = span.replace("@", " at ").replace(".", " dot ")
        return [(span, "address"), (spelt, "address"), (span.replace("@", " (at) "), "address")]
    if kind == "card":
        digits = re.sub(r"[ -]", "", span)
        return [(span, "number"), (" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "number")]
    return [(span, "number")]


def _examples(text: str) -> list[tuple[list[float], int]]:
    """Features, and 1 for positive or 0 for unlabelled."""
    base, sure = base_spans(text), accounts(text)
    out = []
    for start, end, kind in base:
        before, span, after = _around(text, start, end)
        out += [(features(before, s, after, k), 1) for s, k in _disguises(span, kind)]
    out += [(features(*_around(text, start, end), kind), 1) for start, end, kind in sure]
    for start, end, kind in candidates(text):
        if not any(start < e and s < end for s, e, _ in base + sure):
            out.append((features(*_around(text, start, end), kind), 0))
    return out


@dataclass(frozen=True)
class Selector:
    """Trees, the line that calibrates their margin, and the threshold of each family."""

    trees: boost.Trees | None
    slope: float
    shift: float
    least: dict[str, float]

    def chosen(self, text: str, base: list[Span]) -> list[Span]:
        sure = accounts(text)
        proposed = [
            (s, e, k) for s, e, k in candidates(text)
            if k in self.least and not any(s < y and x < e for x, y, _ in base + sure)
        ]
        if not proposed or self.trees is None:
            return sure
        x = np.array([features(*_around(text, s, e), k) for s, e, k in proposed])
        p = 1 / (1 + np.exp(-(self.slope * _steps(self.trees, x) / STEPS + self.shift)))
        return sure + [span for span, v in zip(proposed, p, strict=True) if v >= self.least[span[2]]]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        return base, base + self.chosen(text, base)


def _steps(trees: boost.Trees, x: np.ndarray) -> np.ndarray:
    return np.rint(trees.margin(x) * STEPS)


def _tally(weight: np.ndarray, *columns: np.ndarray) -> Counter:
    """Sums of ``weight`` by equal rows of ``columns``."""
    if not len(weight):
        return Counter()
    rows, at = np.unique(np.stack(columns, 1).astype(float), axis=0, return_inverse=True)
    return Counter(dict(zip(map(tuple, rows.tolist()), np.bincount(at.ravel(), weight).tolist(), strict=True)))


def _table(tally: Counter) -> np.ndarray:
    """Rows of the columns and the sum, in order."""
    return np.array([(*k, v) for k, v in sorted(tally.items())])


def _family(x: np.ndarray) -> np.ndarray:
    return x[:, -3:].argmax(1)  # number, address, account


def _cells(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Different examples x, y, half and spy of all documents and the number n of each; how many
    there are, and of which classes in which half.  Equal rows count once, so a group of copies
    does not outweigh others."""

    @F.arrow_udf("array<struct<x:binary,y:boolean>>")
    def examples(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("x", pa.binary()), ("y", pa.bool_())]))
        for texts in parts:
            done = [
                pa.array([[{"x": np.array(x, np.float32).tobytes(), "y": bool(y)} for x, y in _examples(t)] for t in own.column(0).to_pylist()], kind)
                for own in limited([pa.RecordBatch.from_arrays([texts], ["text"])])
            ]
            yield pa.concat_arrays(done) if done else pa.array([], kind)
        release()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    # The halves are of documents: disguises of one span, and its copies, stand in one of them.
    half = (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("half")
    found = rows.select("doc_id", F.sha2("text", 256).alias("digest"), half, examples("text").alias("found"))
    once = found.where(F.size("found") > 0).dropDuplicates(["doc_id", "digest"])
    each = once.select("doc_id", "digest", "half", F.posexplode("found").alias("place", "e")).select("*", "e.x", "e.y")
    spy = F.pmod(F.xxhash64("doc_id", "digest", "place"), F.lit(1_000_003)) < int(SPIES * 1_000_003)
    each = each.withColumn("spy", F.col("half") & F.col("y") & spy)
    cells = each.groupBy("x", "y", "half", "spy").agg(F.count("*").alias("n"))
    seen = {"cells": F.count("*"), "spies": F.count_if("spy")}
    seen |= {f"{y}{half}": F.count_if((F.col("y") == bool(y)) & (F.col("half") == bool(half))) for y in (0, 1) for half in (0, 1)}
    return sinks.stage_counted(cells, sinks.shared_folder(docs.sparkSession), seen)


def _over(cells: DataFrame | pa.Table, pick: Callable) -> Callable[[Callable], Any]:
    """Sums over all cells of what a function of what ``pick`` gives of x, y, half, spy, n returns:
    taken on the driver of a table, on the executors of a DataFrame."""

    def arrays(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x, y, half, spy, n = (np.array(part.column(c)) for c in ("x", "y", "half", "spy", "n"))
        wide = np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1).astype(float)
        return pick(wide, y.astype(float), half.astype(bool), spy.astype(bool), n.astype(float))

    if isinstance(cells, pa.Table):
        held = arrays(cells)
        return lambda work: work(*held)

    def summed(work: Callable) -> Any:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = work(*arrays(batch))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

        return functools.reduce(operator.add, (pickle.loads(r.part) for r in cells.mapInArrow(run, "part binary").collect()))

    return summed


def _fit(cells: DataFrame | pa.Table, pick: Callable) -> boost.Trees:
    """Trees on the rows x, y, weight that ``pick`` gives of the cells."""

    def values(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Counter:
        parts = (_tally(weight, np.full(len(x), k), x[:, k]) for k in range(x.shape[1]))
        return functools.reduce(operator.or_, parts)

    known = _table(_over(cells, pick)(values))
    grid = np.linspace(0, 1, boost.BINS + 1)[1:-1]
    each = [known[known[:, 0] == k] for k in range(int(known[-1, 0]) + 1)]
    cuts = [np.unique(boost.quantiles(v[:, 1], v[:, 2], grid)) for v in each]

    def coded(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, weight = pick(*columns)
        return boost.codes(x, cuts), y, weight

    return boost.grow(_over(cells, coded), cuts, TREES)


def _limits(cells: DataFrame | pa.Table) -> tuple[boost.Trees, np.ndarray]:
    """Trees that take spies for negative, and the margin of each family below which nearly no
    spy is."""

    def hidden(x, y, half, spy, n):
        return x[half], np.where(spy, 0.0, y)[half], n[half]

    trees = _fit(cells, hidden)

    def spies(x, y, half, spy, n):
        return x[spy], n[spy]

    seen = _table(_over(cells, spies)(lambda x, n: _tally(n, _steps(trees, x), _family(x))))

    def limit(rows: np.ndarray) -> float:
        return float(boost.quantiles(rows[:, 0], rows[:, 2], np.array([LOST]))[0])

    own = [seen[seen[:, 1] == k] for k in range(3)]
    return trees, np.array([limit(r if r[:, 2].sum() >= LEAST else seen) for r in own])


def fit_selector(docs: DataFrame) -> Selector:
    """Fit on the candidates of all documents."""
    nothing = Selector(None, 1.0, 0.0, {})
    cells, seen = _cells(docs)
    if not all(seen[f"{y}{half}"] for y in (0, 1) for half in (0, 1)) or not seen["spies"]:
        return nothing
    if seen["cells"] <= HELD:
        cells = cells.toArrow()
    first, limits = _limits(cells)

    def known(side: bool) -> Callable:
        def pick(x, y, half, spy, n):
            mine = (half == side) & ((y == 1) | (_steps(first, x) < limits[_family(x)]))
            return x[mine], y[mine], n[mine]

        return pick

    for side in (True, False):
        up, down = _over(cells, known(side))(lambda x, y, n: np.array([(n * y).sum(), (n * (1 - y)).sum()]))
        if not (up and down):
            return nothing
    trees = _fit(cells, known(True))
    held = _table(_over(cells, known(False))(lambda x, y, n: _tally(n, -_steps(trees, x), y, _family(x))))
    margin, y, family, n = -held[:, 0] / STEPS, *held[:, 1:].T
    slope, shift = boost.fit_line(margin, y, n)
    least = {}
    for k, kind in enumerate(("number", "address", "account")):
        mine = family == k
        if n[mine].sum() < LEAST:
            continue
        scores, at = np.unique(-margin[mine], return_inverse=True)  # the highest margin first
        ups, all_ = (np.bincount(at, v) for v in ((n * y)[mine], n[mine]))
        good = np.flatnonzero(np.cumsum(ups) / np.cumsum(all_) >= PRECISION)
        if len(good):
            least[kind] = max(0.5, float(1 / (1 + np.exp(-(slope * -scores[good[-1]] + shift)))))
    return Selector(trees, slope, shift, least)


def listed(spans: list[Span]) -> str:
    """kind:start:end by kind as in KINDS, then start, joined by commas."""
    ordered = sorted(set(spans), key=lambda s: (KINDS.index(s[2]), s[0], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def report(text: Column, selector: Selector) -> Column:
    """A struct of counts of rule spans, their digest, and all spans of ``text``."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def work(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for t in part:
                base, all_ = selector.spans(t)
                kinds = [kind for _, _, kind in base]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*map(kinds.count, BASE_KINDS), digest, listed(all_)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
        release()

    return work(F.coalesce(text.cast("string"), F.lit("")))


def redacted_text(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one, named after the first."""
    out, at, hidden = [], 0, 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= hidden:
            out += [text[at:start] if start > at else "", f"[{kind.upper()}]"]
        hidden = at = max(hidden, end)
    return "".join([*out, text[at:]])


def redact(text: Column, selector: Selector) -> Column:
    """``text`` with every selected span replaced by its kind; null stays null."""

    @F.arrow_udf("string")
    def work(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            done = [
                pa.array([None if t is None else redacted_text(t, selector.spans(t)[1]) for t in own.column(0).to_pylist()], pa.string())
                for own in limited([pa.RecordBatch.from_arrays([texts], ["text"])])
            ]
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())
        release()

    return work(text.cast("string"))
