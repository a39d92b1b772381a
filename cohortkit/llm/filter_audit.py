"""What every order of a set of filters would remove, from difference arrays over Lehmer ranks.

The orders of n filters, sorted, are numbered by their Lehmer rank from 0 to n! - 1.  A
document counts by its mask, the set of filters it fails.  It goes at the first letter of an
order that its mask holds, so the orders in which filter f removes it at step s are those
that begin with s - 1 filters it passes, then f; each such beginning is one run of
(n - s)! ranks.  The counts of a mask are added where a run begins and taken off behind its
end, and one prefix sum over the ranks gives the removals of all orders.  No document meets
an order, and the data is reduced to one row per part and mask first.

A null part is the empty string; a part is any value of the column, empty tables have none.
Parts do not affect each other.  Repeated rows each count.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, repetitive, capitals, signs.

    A: under 200 words.  B: under half of the words differ.  C: over 3 % of the characters
    are A to Z.  D: any of ``#$%&*|``.  A null text counts as empty.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, "[A-Z]+", ""))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(whole).cast("long"),
        whole.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def with_repeats(rows: DataFrame, text_key: str, doc_id: str, bit: int, by: Sequence[str]) -> DataFrame:
    """``by``, ``mask``, ``n``: rows counted, ``bit`` added to the mask of those whose
    ``text_key`` a smaller ``doc_id`` has as well.

    Rows of one text are combined before any of them meet, so a text that a third of all
    rows share is a row per task.  A null ``doc_id`` neither is smaller nor has a smaller.
    """
    once = rows.groupBy(doc_id, text_key, *by, "mask").agg(F.count(F.lit(1)).alias("c"))
    # Within a text and ``by``: how many rows, how many at the smallest number, how many without.
    groups = once.groupBy(text_key, *by, "mask").agg(
        F.sum("c").alias("n"),
        F.min(doc_id).alias("least"),
        F.min_by("c", doc_id).alias("at_least"),
        F.sum(F.when(F.col(doc_id).isNull(), F.col("c")).otherwise(0)).alias("unnamed"),
    )
    first = F.min("least").over(Window.partitionBy(text_key))
    kept = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    repeats = F.col("n") - F.col("unnamed") - kept
    split = groups.withColumn("first", first).withColumn("repeats", F.coalesce(repeats, F.lit(0)))
    both = F.array(
        F.struct(F.col("mask"), (F.col("n") - F.col("repeats")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), F.col("repeats").alias("n")),
    )
    return split.select(*by, F.inline(both)).where("n > 0")


def removal_runs(filters: str) -> list[tuple[int, int, int, int]]:
    """mask, step, first rank, rank behind the last: the orders that remove a mask at a step."""
    n = len(filters)
    runs = []
    for step in range(1, n + 1):
        length = factorial(n - step)
        for k, start in enumerate(permutations(range(n), step)):  # in the order of their ranks
            *before, letter = start
            rest = [i for i in range(n) if i not in start]
            for chosen in range(1 << len(rest)):
                mask = 1 << letter | sum(1 << i for j, i in enumerate(rest) if chosen >> j & 1)
                runs.append((mask, step, k * length, (k + 1) * length))
    return runs


def audit(counts: DataFrame, filters: str, part: str, lost: Sequence[str] = ()) -> DataFrame:
    """One row per ``part``, order of ``filters`` and step, zeros included.

    ``counts`` has ``part``, ``mask`` (bit i: fails the i-th filter), ``n`` and the columns
    ``lost``, numbers of which each row's share goes with its documents.  The result has
    part, filter_order, step, kept, removed, redundant, unique_fails, one ``<name>_lost``
    for each of ``lost``, and shapley.
    """
    spark, amounts = counts.sparkSession, ["n", *lost]
    orders = ["".join(p) for p in permutations(filters)]
    # A fixed number of rows for a number of filters (840 for five).
    runs = spark.createDataFrame(removal_runs(filters), "mask int, step int, begin int, behind int")
    masks = counts.groupBy(part, "mask").agg(*(F.sum(a).alias(a) for a in amounts))
    ends = F.array(
        F.struct(F.col("begin").alias("rank"), *(F.col(a) for a in amounts)),
        F.struct(F.col("behind").alias("rank"), *((-F.col(a)).alias(a) for a in amounts)),
    )
    steps = masks.join(F.broadcast(runs), "mask").select(part, "step", F.inline(ends))
    changes = steps.groupBy(part, "step", "rank").agg(*(F.sum(a).alias(a) for a in amounts))

    def holds(i: int) -> Column:
        return F.col("mask").bitwiseAND(1 << i) != 0

    def number(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))

    parts = masks.groupBy(part).agg(
        F.sum("n").alias("total"),
        F.array(*(
            F.struct(
                F.lit(f).alias("letter"), number(holds(i)).alias("fails"),
                number(F.col("mask") == 1 << i).alias("unique_fails"),
            )
            for i, f in enumerate(filters)
        )).alias("letters"),
    )
    grid = parts.select(part, "total", "letters", F.explode(F.array(*(F.lit(i) for i in range(len(orders))))).alias("rank"))
    grid = grid.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1))
    grid = grid.withColumn("step", F.explode(F.array(*(F.lit(i + 1) for i in range(len(filters))))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    grid = grid.withColumn("own", F.filter("letters", lambda x: x["letter"] == letter)[0])

    along = Window.partitionBy(part, "step").orderBy("rank")
    summed = grid.join(changes, [part, "step", "rank"], "left").withColumns(
        {f"sum:{a}": F.sum(F.coalesce(F.col(a), F.lit(0))).over(along) for a in amounts}
    )
    removed = F.col("`sum:n`")
    gone = F.sum(removed).over(Window.partitionBy(part, "filter_order").orderBy("step"))
    return summed.select(
        part, "filter_order", "step",
        (F.col("total") - gone).alias("kept"), removed.alias("removed"),
        (F.col("own.fails") - removed).alias("redundant"), F.col("own.unique_fails"),
        *(F.col(f"`sum:{a}`").alias(f"{a}_lost") for a in lost),
        F.sum(removed).over(Window.partitionBy(part, "own.letter")).alias("shapley"),
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to D of ``text_failures`` and E, a text that a smaller doc_id has as well,
    over ``docs`` by lang, with the labelled good and toxic documents each order loses.

    Several labels of a document count as the union of what they say; a null doc_id has none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text_failures(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("text_key"),
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    known = judged.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    counted = with_repeats(known, "text_key", "doc_id", 1 << 4, ["part", "good", "toxic"])
    shared = counted.select(
        "part", "mask", "n", (F.col("good") * F.col("n")).alias("good"), (F.col("toxic") * F.col("n")).alias("toxic")
    )
    return audit(shared, "ABCDE", "part", ["good", "toxic"])
