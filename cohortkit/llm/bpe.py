"""Byte-level BPE in DuckDB: recursive queries merge, an ordered aggregation decodes.

Each task keeps one small in-memory DuckDB.  A batch of texts is cut into pieces, the
different pieces into words by the tokenizer's pattern, and the words not seen lately go,
those of like lengths together, through a recursive query: a word is a row with its tokens, its pairs join the merge table,
every word contracts its leftmost pair of least rank, words without a pair drop out, until
none is left.  Decoding joins token rows with the vocabulary and aggregates bytes by position.

Nulls encode like empty texts, to no ids.  The same text gives the same ids in any row.
Rows are only mapped: repeated rows, ties and extra columns stay as they are; empty tables
give empty tables.  Helper columns take free names; a column that has the name of a result
gives way to it.  An id outside the vocabulary is an error when decoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import free_names, limited, release, trim, without
from cohortkit.llm.pieces import gather, one_word, pieces

#: Bytes of words and ids kept between the batches of a task; beyond it the memory starts anew.
REMEMBERED = 32 << 20
#: What a word takes beside its bytes (twice) and ids: two ends, a place in a lookup's table.
WORD_COST = 48
#: The recursive query keeps the tokens of all its steps, which for a word of n bytes are up
#: to n * n / 2.  Words go together up to this many tokens; longer words than LONG_WORD are
#: contracted one by one with a heap, in the same order.
STEPS = 300_000
LONG_WORD = 512
#: Ids decoded by one aggregation (a longer run of ids is one on its own).
DECODED = 100_000
#: Bytes of text encoded at once.
TEXT = 2 << 20

CONTRACT = """
WITH RECURSIVE state(step, word, ids) AS (
    SELECT 0, word, ids FROM words
    UNION ALL (
        WITH pairs AS (
            SELECT word, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS place
            FROM state WHERE len(ids) > 1
        ), least AS (
            SELECT p.word, min(m.merged::BIGINT * 4294967296 + p.place) AS code
            FROM pairs p JOIN merges m ON m.l = p.l AND m.r = p.r GROUP BY p.word
        )
        SELECT s.step + 1, s.word,
               s.ids[:code % 4294967296 - 1] || [(code // 4294967296)::INTEGER]
                   || s.ids[code % 4294967296 + 2:]
        FROM state s JOIN least l ON l.word = s.word
    )
)
SELECT word, arg_max(ids, step) AS ids FROM state GROUP BY word ORDER BY word
"""

DECODE = """
SELECT unhex(list_aggregate(list(v.hex ORDER BY t.place), 'string_agg', '')) AS bytes
FROM tokens t LEFT JOIN vocabulary v ON v.id = t.id
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _database() -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    base.execute("SET threads = 1")
    base.execute("SET memory_limit = '100MB'")
    return base


class Task:
    """A task's DuckDB, with the merge table and the vocabulary.  Ends with the task.

    Only the tables' rows stay with the worker process for its next task: some megabytes,
    whatever the texts.
    """

    _rows: dict[str, tuple[dict[bytes, int], pa.Table, pa.Table]] = {}

    def __init__(self, path: str) -> None:
        if path not in Task._rows:
            Task._rows = {path: _tables(path)}
        self.ranks, merges, vocabulary = Task._rows[path]
        self.base = _database()
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.base.register("rows", rows)
            self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.base.unregister("rows")

    def __enter__(self) -> Task:
        return self

    def __exit__(self, *_: object) -> None:
        self.base.close()
        release()


def _tables(path: str) -> tuple[dict[bytes, int], pa.Table, pa.Table]:
    ranks = read_ranks(path)
    pairs = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    columns = np.array(pairs, np.int32).reshape(-1, 3).T
    merges = pa.table(dict(zip(("l", "r", "merged"), map(pa.array, columns), strict=True)))
    ids = pa.array(list(ranks.values()), pa.int32())
    return ranks, merges, pa.table({"id": ids, "hex": [t.hex() for t in ranks]})


def _in_steps(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in order, in groups whose contraction takes at most STEPS tokens (or one word)."""
    rows = np.cumsum([len(w) * (len(w) + 1) // 2 for w in words], dtype=np.int64)
    start, base = 0, 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(rows, base + STEPS, "right")))
        yield words[start:stop]
        start, base = stop, int(rows[stop - 1])


class Encoder:
    """The words a task has met lately, and how to contract others."""

    def __init__(self, task: Task, pattern: str) -> None:
        self.ranks, self.base = task.ranks, task.base
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())  # a word's ids lie between two ends
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.bytes = 0

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end and their number for each, by the recursive query."""
        at = np.concatenate([[0], np.cumsum([*map(len, words)])])
        lists = pa.ListArray.from_arrays(
            pa.array(at, pa.int32()), pa.array(self.of_byte[np.frombuffer(b"".join(words), np.uint8)])
        )
        self.base.register("words", pa.table({"word": np.arange(len(words), dtype=np.int32), "ids": lists}))
        done = self.base.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        return np.asarray(done.flatten(), np.int32), np.asarray(done.value_lengths())

    def contract_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: a heap of pairs by rank and place, over a linked list."""
        token = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(word):
                both = token[i] + token[after[i]]
                if both in self.ranks:
                    heapq.heappush(heap, (self.ranks[both], i, both))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not token[i] or j >= len(word) or token[i] + token[j] != both:
                continue
            token[i], token[j], after[i] = both, b"", after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[t] for t in token if t], np.int32)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Numbers of the different ``words``; those not known yet are contracted first."""
        # The lookup's table is of the batch's words, far fewer than those remembered.
        met = pc.index_in(self.words, value_set=words)
        held = np.flatnonzero(np.asarray(met.is_valid()))
        numbers = np.full(len(words), -1, np.int64)
        numbers[np.asarray(met.drop_null())] = held
        del met, held
        at = np.flatnonzero(numbers < 0)
        if not len(at):
            return numbers
        fresh = words.take(pa.array(at))
        raws = fresh.cast(pa.large_binary()).to_pylist()
        single, plain = [], []
        parts, counts = [self.ids], []
        for k, whole in enumerate(map(self.ranks.get, raws)):
            if whole is None and len(raws[k]) <= LONG_WORD:
                plain.append(k)
                continue
            own = self.contract_long(raws[k]) if whole is None else np.array([whole], np.int32)
            single.append(k)
            parts.append(own)
            counts.append([len(own)])
        # A query has as many steps as its longest word.
        plain.sort(key=lambda k: len(raws[k]))
        for together in _in_steps([raws[k] for k in plain]):
            ids, sizes = self.contract(together)
            parts.append(ids)
            counts.append(sizes)
        order = np.array(single + plain)
        numbers[at[order]] = len(self.words) + np.arange(len(order))
        self.words = pa.concat_arrays([self.words, fresh.take(pa.array(order))])
        self.ids = np.concatenate(parts)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts)))
        self.bytes += WORD_COST * len(raws) + 2 * sum(map(len, raws)) + 4 * sum(map(len, parts[1:]))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text starts."""
        different, numbers, first = pieces(texts)
        if self.bytes > REMEMBERED:
            self.forget()
        whole = one_word(different)
        rest = [*map(self.split, different.filter(pa.array(~whole)).to_pylist())]
        per_piece = np.ones(len(whole), np.int64)
        per_piece[~whole] = np.fromiter(map(len, rest), np.int64, len(rest))
        bounds = np.concatenate([[0], np.cumsum(per_piece)])
        # The words of pieces that are one, then those of the others; and where each stands.
        split = pa.array([*chain.from_iterable(rest)], pa.large_string())
        coded = pa.concat_arrays([different.filter(pa.array(whole)), split]).dictionary_encode()
        ones = np.repeat(whole, per_piece)
        place = np.empty(len(ones), np.int64)
        place[ones], place[~ones] = np.arange(ones.sum()), ones.sum() + np.arange(len(split))
        del different, rest, split
        rows = self.learn(coded.dictionary)[np.asarray(coded.indices)[place]]
        del coded, ones, place
        ids, ends = gather(self.ids, self.ends, rows, bounds)
        return gather(ids, ends, numbers, first)


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array, of: str) -> pa.RecordBatch:
    """``batch`` with ``column`` called ``name`` instead of the column ``of``, if it has that."""
    names = [n for n in batch.schema.names if n != of]
    columns = [*(batch.column(batch.schema.get_field_index(n)) for n in names), column]
    return pa.RecordBatch.from_arrays(columns, names=[*names, name])


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``ids``, array<int>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Task(vocabulary) as task:
            encoder = Encoder(task, pattern)
            for batch in limited(batches, text, TEXT):
                got, bounds = encoder.encode(batch.column(batch.schema.get_field_index(text)))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got, pa.int32()))
                yield _with_column(batch, ids, lists, text)

    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(text, whole).mapInArrow(work, schema)


class Decoder:
    """Bytes of ids, from a task's vocabulary."""

    def __init__(self, task: Task) -> None:
        self.last = max(task.ranks.values(), default=-1)
        self.base = task.base
        self.opens = np.zeros(self.last + 1, bool)  # tokens that start with a blank
        self.sizes = np.zeros(self.last + 1, np.int64)
        for token, rank in task.ranks.items():
            self.opens[rank], self.sizes[rank] = token[:1] == b" ", len(token)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids, the lists end to end between ``bounds``.

        Runs of ids from one blank to the next are decoded once, however often they come.
        """
        if len(ids) and (ids.min() < 0 or ids.max() > self.last):
            raise ValueError("ids outside the vocabulary")
        ids = np.ascontiguousarray(ids, np.int32)
        cut = np.ones(len(ids) + 1, bool)
        cut[:-1] = self.opens[ids]
        cut[bounds] = True
        places = np.flatnonzero(cut)
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places * 4), pa.py_buffer(ids)]
        ).dictionary_encode()
        parts = self._runs(np.frombuffer(b"".join(runs.dictionary.to_pylist()), np.int32), np.asarray(pc.binary_length(runs.dictionary)) // 4)
        numbers = np.asarray(runs.indices)
        first = np.searchsorted(places, bounds)
        return [
            b"".join(map(parts.__getitem__, numbers[i:j].tolist()))
            for i, j in zip(first[:-1], first[1:], strict=True)
        ]

    def _runs(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run: an aggregation over many runs end to end, cut by the tokens' sizes."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds]
        out: list[bytes] = []
        start = 0
        while start < len(counts):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + DECODED, "right")) - 1)
            whole = self._decode(ids[bounds[start] : bounds[stop]])
            at = (ends[start : stop + 1] - ends[start]).tolist()
            out += [whole[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            start = stop
        return out

    def _decode(self, ids: np.ndarray) -> bytes:
        tokens = pa.table({"place": np.arange(len(ids), dtype=np.int32), "id": ids})
        self.base.register("tokens", tokens)
        return self.base.sql(DECODE).fetchall()[0][0]


def decode(
    df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``df`` with the column ``ids`` replaced by ``decoded``, the bytes they stand for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Task(vocabulary) as task:
            decoder = Decoder(task)
            for batch in batches:
                lists = batch.column(batch.schema.get_field_index(ids))
                counts = np.asarray(lists.value_lengths().fill_null(0))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                bytes_ = decoder.decode(np.asarray(lists.flatten(), np.int32), bounds)
                yield _with_column(batch, decoded, pa.array(bytes_, pa.binary()), ids)

    kept = [f for f in df.schema.fields if f.name != ids]
    return df.mapInArrow(work, T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``docs`` without its text: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead.

    The first digest is of the decimal ids joined by spaces, the second of the bytes that
    decoding these ids gives.  ``keep_ids`` adds the ids.  One task encodes and decodes, so
    that a core has one Python worker.  A column of ``docs`` that has the name of a result
    gives way to it.
    """
    docs = without(docs, ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])
    ids_, bytes_, text_ = free_names(docs, 3)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Task(vocabulary) as task:
            encoder, decoder = Encoder(task, pattern), Decoder(task)
            for batch in limited(batches, text_, TEXT):
                ids, bounds = encoder.encode(batch.column(batch.schema.get_field_index(text_)))
                trim()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                back = pa.array(decoder.decode(ids, bounds), pa.binary())
                yield _with_column(_with_column(batch, ids_, lists, text_), bytes_, back, "")

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField(ids_, T.ArrayType(T.IntegerType(), False)), T.StructField(bytes_, T.BinaryType())])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    done = docs.select(*(f.name for f in kept), text.alias(text_)).mapInArrow(work, schema)
    ids = F.col(ids_)
    return done.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256),
            "decoded_sha256": F.sha2(bytes_, 256),
            **({"ids": ids} if keep_ids else {}),
        }
    ).drop(ids_, bytes_)
