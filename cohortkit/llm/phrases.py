"""Phrases whose words stand together more often than chance, counted in HAT-tries.

Counting.  Every place in a piece of text starts a phrase of up to LONGEST words; the counts of
all shorter phrases follow from those, as their prefixes.  A task puts its phrases into a
trie of word ids: hash containers of id strings, each shared by neighbouring first words until
it grows beyond BURST and bursts, first into one for each word, then by the next word.  When
a task's tries hold more than HELD phrases, the largest subtrees are spilled whole as sorted
runs.  Runs are cut into blocks and dealt to partitions by ranges of prefixes; each partition
gets its blocks in the order of their first phrases and merges them as they come, with no more
in memory than overlaps.  A prefix is counted while its phrases pass by.  One that touches the
edge of its partition may go on in the next, so the parts of such prefixes are added up at the
end.  The ranges are cut at quantiles of a hashed sample of phrases; they decide who counts a
phrase, not its count, and split a first word or pair of any size over as many partitions as
it fills.

Scoring.  A phrase of two or more words that occurs ``least`` times or more is a candidate.
Cut after k words, it has a score floor(1000 a n / (l r)), exact in decimals of 38 digits;
the lowest counts.  Parts occur at least as often as the whole, so all l and r are among the
phrases counted.  A candidate all of whose occurrences lie in a longer phrase is dropped;
it suffices to look one word further, as the counts between can only lie between.

A null text is empty, a null lang is ``und``.  Repeated rows each count; empty tables have no
phrases.  Words may hold control characters.  Only text and lang are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import limited, lower_ascii, mix, raw_text, release, span_hashes, staged, tasks

LONGEST = 5
#: Phrases in a container before it bursts, in a task's tries before subtrees are spilled,
#: and words a task knows before everything is.
BURST = 16_384
HELD = 400_000
WORDS = 300_000
#: Bytes of text counted at once.
TEXT = 2 << 20
#: Phrases of one block of a run, and those that a partition lets wait before it counts them.
ROWS = 4_096
MERGED = 100_000
#: Phrases sampled for each range, to cut the ranges, and texts that they come from.
SAMPLED = 100
DOCS = 50
LEAST_SAMPLE = 20_000
#: Best phrases are found in so many parts of a language first.
PARTS = 64

_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x20]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True

# Keys are words joined by tabs.  So that a tab sorts before what words hold, the control
# characters below it are written as a line feed, which no word holds, and a letter.
# No word holds a carriage return either; it ends a key in a block.
_TAB, _MARK, _END = b"\t", b"\n", b"\r"


def _escaped(word: bytes) -> bytes:
    if min(word, default=0x20) > 0x08:
        return word
    return b"".join(_MARK + bytes([0x40 + c]) if c < 0x09 else bytes([c]) for c in word)


def _plain(key: bytes) -> str:
    """A key as text: words joined by blanks."""
    if _MARK in key:
        first, *rest = key.split(_MARK)
        key = first + b"".join(bytes([part[0] - 0x40]) + part[1:] for part in rest)
    return key.replace(_TAB, b" ").decode("utf-8", "surrogatepass")


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of all words; for each word how many words its
    piece has from it on; and the text it is in."""
    raw, offsets = raw_text(texts)
    raw = lower_ascii(raw)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return raw, none, none, none, none
    kind = _BREAK[raw]
    inside = ~(kind | _BLANK[raw])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    opens = inside & (cut[:n] | ~np.concatenate([[False], inside[:-1]]))
    closes = inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        return raw, none, none, none, none
    piece = np.cumsum(kind)[starts]
    owner = np.searchsorted(offsets, starts, "right") - 1
    last = np.ones(len(starts), bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(last)
    left = at[np.searchsorted(at, np.arange(len(starts)))] - np.arange(len(starts)) + 1
    return raw, starts, ends, left, owner


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these spans, as binary."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[at])]
    )


class Trie:
    """Counts of strings of word ids (four bytes an id, high byte first), all of one length.

    A node shares a hash container among the 256 neighbouring ids with the same ``width`` = 3
    first bytes; one that bursts becomes a node with a container for each id (``width`` = 1
    more byte), and one of those again a node for the next id.
    """

    def __init__(self, width: int = 3) -> None:
        self.width = width
        self.children: dict[bytes, Trie | Counter[bytes]] = {}
        self.size = 0

    def add(self, strings: list[bytes]) -> int:
        """Count strings, those with the same first id next to each other; how many are new."""
        width = self.width
        heads = [s[:width] for s in strings]
        ends = [i for i in range(1, len(heads)) if heads[i] != heads[i - 1]]
        return self.add_groups([heads[0], *(heads[i] for i in ends)], [*ends, len(heads)], [s[width:] for s in strings])

    def add_groups(self, heads: list[bytes], ends: list[int], tails: list[bytes]) -> int:
        """The same from heads, where the strings of each end, and what follows the heads."""
        width, children, before, start = self.width, self.children, self.size, 0
        for head, end in zip(heads, ends, strict=True):
            own = tails[start:end]
            start = end
            child = children.get(head)
            if child is None:
                child = children[head] = Counter()
            if isinstance(child, Trie):
                self.size += child.add(own)
                continue
            held = len(child)
            child.update(own)
            self.size += len(child) - held
            if len(child) > BURST:
                children[head] = burst = Trie(4 - width)
                parts: dict[bytes, Counter[bytes]] = defaultdict(Counter)
                for tail, c in child.items():
                    parts[tail[: burst.width]][tail[burst.width :]] = c
                burst.children, burst.size = dict(parts), len(child)
        return self.size - before

    def subtrees(self) -> list[tuple[int, bytes]]:
        """Sizes and heads of the children."""
        return [(c.size if isinstance(c, Trie) else len(c), head) for head, c in self.children.items()]

    def take(self, head: bytes, strings: list[bytes], counts: list[int], before: bytes = b"") -> None:
        """Move the subtree under ``head``, whole, to the ends of these lists."""
        child = self.children.pop(head)
        if isinstance(child, Trie):
            for below in list(child.children):
                child.take(below, strings, counts, before + head)
        else:
            strings += [before + head + tail for tail in child]
            counts += child.values()


class TaskCounts:
    """A task's words and one trie for each language."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.word: list[bytes] = []
        self.tries: dict[str, Trie] = {}
        self.held = 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        raw, starts, ends, left, owner = word_rows(texts)
        if not len(starts):
            return
        coded = _words(raw, starts, ends).dictionary_encode()
        own_words = coded.dictionary.to_pylist()
        new = [w for w in own_words if w not in self.number]
        self.number.update(zip(new, range(len(self.word) + 1, len(self.word) + 1 + len(new)), strict=True))
        self.word += map(_escaped, new)
        # Id 0 stands for no word.
        ids = np.fromiter(map(self.number.__getitem__, own_words), np.uint32, len(own_words))
        of_word = ids[coded.indices.to_numpy(zero_copy_only=False)]
        ahead = np.concatenate([of_word.astype(">u4"), np.zeros(LONGEST - 1, ">u4")])
        table = np.lib.stride_tricks.sliding_window_view(ahead, LONGEST) * (left[:, None] > np.arange(LONGEST))
        rows = np.ascontiguousarray(table.astype(">u4")).view(f"V{4 * LONGEST}").ravel()
        two = of_word.astype(np.uint64) << np.uint64(32)
        two[:-1] |= np.where(left[:-1] > 1, of_word[1:], 0).astype(np.uint64)
        tongues = langs.dictionary_encode()
        tongue = tongues.indices.to_numpy(zero_copy_only=False)[owner]
        for t, lang in enumerate(tongues.dictionary.to_pylist()):
            own = np.flatnonzero(tongue == t)
            if not len(own):
                continue
            order = own[np.argsort(two[own])]
            bucket = of_word[order] >> np.uint32(8)
            at = np.flatnonzero(np.diff(bucket)) + 1
            flat = rows[order].tobytes()
            heads = [int(k).to_bytes(3, "big") for k in bucket[np.concatenate([[0], at])]]
            tails = [flat[i + 3 : i + 4 * LONGEST] for i in range(0, len(flat), 4 * LONGEST)]
            self.held += self.tries.setdefault(lang, Trie()).add_groups(heads, [*at.tolist(), len(own)], tails)

    def spill(self, down_to: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """Whole subtrees as sorted runs (language, keys, counts), largest first, until
        ``down_to`` phrases are held."""
        words = pa.array([b"", *self.word], pa.large_binary())
        rank = np.empty(len(words), np.uint64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.uint64)
        largest = [(size, lang, head) for lang, trie in self.tries.items() for size, head in trie.subtrees()]
        if down_to:
            largest.sort(reverse=True)
        taken: dict[str, tuple[list[bytes], list[int]]] = {}
        for size, lang, head in largest:
            if self.held <= down_to:
                break
            trie = self.tries[lang]
            trie.take(head, *taken.setdefault(lang, ([], [])))
            trie.size -= size
            self.held -= size
        for lang, (strings, times) in taken.items():
            ids = np.frombuffer(b"".join(strings), ">u4").reshape(-1, LONGEST).astype(np.uint32)
            counts = np.array(times, np.int64)
            by, bits = rank[ids], np.uint64(len(words).bit_length())
            code = np.zeros((2, len(ids)), np.uint64)  # a task knows few words: three in 64 bits
            for j in range(LONGEST):
                code[j // 3] = code[j // 3] << bits | by[:, j]
            at = np.lexsort((code[1], code[0]))
            yield lang, keys(words, ids[at]), counts[at]


def keys(words: pa.Array, ids: np.ndarray) -> pa.Array:
    """Words joined by tabs; id 0 is no word."""
    columns = [pc.take(words, pa.array(c, mask=c == 0)) for c in ids.T]
    return pc.binary_join_element_wise(*columns, pa.scalar(_TAB, pa.large_binary()), null_handling="skip")


def _first_from(own: pa.Array, bound: bytes) -> int:
    """The place of the first of sorted keys that is not below ``bound``."""
    low, high = 0, len(own)
    while low < high:
        middle = (low + high) // 2
        if own[middle].as_py() < bound:
            low = middle + 1
        else:
            high = middle
    return low


_BLOCK = "to int, lang string, first binary, keys binary, counts binary"


def blocks(lang: str, own: pa.Array, counts: np.ndarray, begin: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """A sorted run in blocks, none across the beginning of a range."""
    code = lang.encode()
    to = sum(b < code for b, _ in begin)  # ranges that begin in a language before
    cuts = [_first_from(own, key) for b, key in begin if b == code]
    rows: list[tuple] = []
    for low, high in zip([0, *cuts], [*cuts, len(own)], strict=True):
        for i in range(low, high, ROWS):
            part = own.slice(i, min(ROWS, high - i))
            ends = pa.array([0, len(part)], pa.int64())
            joined = pc.binary_join(pa.LargeListArray.from_arrays(ends, part), pa.scalar(_END, pa.large_binary()))
            rows.append((to, lang, part[0].as_py(), joined[0].as_py(), counts[i : i + len(part)].tobytes()))
        to += 1
    if rows:
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["to", "lang", "first", "keys", "counts"])


def _opened(block: bytes) -> pa.Array:
    """The keys of a block."""
    raw = np.frombuffer(block, np.uint8)
    ends = np.append(np.flatnonzero(raw == _END[0]), len(raw))
    return _words(raw, np.concatenate([[0], ends[:-1] + 1]), ends)


class Merger:
    """Merges one partition's blocks, in the order of their first keys, and counts prefixes.

    What it yields is language, key, words and count.
    """

    def __init__(self, least: int) -> None:
        self.least = least
        self.lang = ""
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.waiting, self.limit = 0, MERGED
        self.open: dict[int, list] = {}
        self.words: Counter[str] = Counter()

    def add(self, lang: str, first: bytes, block: bytes, counts: bytes) -> Iterator[tuple[str, bytes, int, int]]:
        if lang != self.lang:
            yield from self.settle(None)
            self.lang = lang
        elif self.waiting > self.limit:
            yield from self.settle(first)
            # What overlaps stays; sorting it again at each block would take the square of it.
            self.limit = max(MERGED, 2 * self.waiting)
        self.keys.append(_opened(block))
        self.counts.append(np.frombuffer(counts, np.int64))
        self.waiting += len(self.counts[-1])

    def settle(self, first: bytes | None) -> Iterator[tuple[str, bytes, int, int]]:
        """Count the waiting phrases below ``first``, which no later block can add to."""
        if not self.keys:
            return
        own, counts = pa.concat_arrays(self.keys), np.concatenate(self.counts)
        order = pc.sort_indices(own)
        own, counts = own.take(order), counts[order.to_numpy()]
        cut = len(own) if first is None else _first_from(own, first)
        self.keys, self.counts = ([own.slice(cut)], [counts[cut:]]) if cut < len(own) else ([], [])
        self.waiting = len(own) - cut
        for i in range(0, cut, MERGED):
            part = slice(i, min(i + MERGED, cut))
            self.words[self.lang] += int(counts[part].sum())
            yield from prefixes(self.lang, own.slice(i, part.stop - i), counts[part], self.open, self.least)

    def close(self) -> Iterator[tuple[str, bytes | None, int, int]]:
        yield from self.settle(None)
        for k, (lang, key, count, _) in self.open.items():
            yield lang, key, k, count  # may go on in the next range
        for lang, n in self.words.items():
            yield lang, None, 0, n


def prefixes(
    lang: str, own: pa.Array, counts: np.ndarray, open_: dict[int, list], least: int
) -> Iterator[tuple[str, bytes, int, int]]:
    """lang, key, words, count of the prefixes that end within these sorted keys.

    ``open_`` keeps, for each number of words, the prefix that may go on: its language, key and
    count, and whether it was the first of the partition.
    """
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    tabs = np.append(np.flatnonzero(data == _TAB[0]), len(data))
    first = np.searchsorted(tabs[:-1], offsets)
    words = np.diff(first) + 1
    for k in range(1, LONGEST + 1):
        rows = np.flatnonzero(words >= k)
        if not len(rows):
            continue
        end = np.where(words[rows] > k, tabs[np.minimum(first[rows] + k - 1, len(tabs) - 1)], offsets[rows + 1])
        heads = _words(data, offsets[rows], end)
        new = np.ones(len(rows), bool)
        new[1:] = pc.not_equal(heads.slice(1), heads.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts[rows], at)
        held = open_.get(k)
        if held is not None and (held[0], held[1]) == (lang, heads[0].as_py()):
            total[0] += held[2]
            edge = held[3]
        else:
            if held is not None and (held[2] >= least or held[3]):
                yield held[0], held[1], k, int(held[2])
            edge = held is None
        done = total[:-1] >= least
        if edge and len(done):
            done[0] = True
        for i in np.flatnonzero(done):
            yield lang, heads[int(at[i])].as_py(), k, int(total[i])
        open_[k] = [lang, heads[int(at[-1])].as_py(), int(total[-1]), edge and len(at) == 1]


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _ranges(texts: DataFrame, parts: int) -> list[tuple[str, bytes]]:
    """Where the ranges of prefixes begin, from the second on.

    From the phrases with the least hashes of a sample of texts, drawn by hash; at most
    SAMPLED for each range.
    """
    n = max(1, texts.count())
    share = min(1.0, DOCS * parts / n)
    # So many phrases as texts of a hundred words would need, however the texts are dealt.
    bound = np.uint64(min(2**64 - 1, int(2**64 * max(SAMPLED * parts, LEAST_SAMPLE) / (100 * n * share))))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) <= int(1_000_003 * share))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(0, np.uint64)
        held: dict[int, tuple[str, bytes]] = {}
        for batch in limited(batches, most=TEXT):
            raw, starts, ends, left, owner = word_rows(batch.column(1))
            if not len(starts):
                continue
            words = span_hashes(raw, starts, ends)
            value = words.copy()
            for j in range(1, LONGEST):
                value = np.where(left > j, mix(value * np.uint64(31) + np.roll(words, -j) + np.uint64(j)), value)
            once, first = np.unique(mix(value), return_index=True)
            few = min(SAMPLED * parts, int(np.searchsorted(once, bound, "right")))
            if not few:
                continue
            once, first = once[:few], first[:few]
            least = np.unique(np.concatenate([least, once]))[: SAMPLED * parts]
            for h, i in zip(once.tolist(), first.tolist(), strict=True):
                if h <= least[-1]:
                    own = range(i, i + min(int(left[i]), LONGEST))
                    held[h] = batch.column(0)[int(owner[i])].as_py(), _TAB.join(_escaped(raw[starts[k] : ends[k]].tobytes()) for k in own)
            if len(held) > 4 * SAMPLED * parts:
                held = {h: held[h] for h in least.tolist() if h in held}
        rows = [(h - (1 << 63), *held[h]) for h in least.tolist() if h in held]
        if rows:
            h, lang, key = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang), pa.array(key, pa.binary())], names=["h", "lang", "key"])

    found = drawn.mapInArrow(sample, "h long, lang string, key binary")
    cuts = found.orderBy("h").limit(SAMPLED * parts).select("lang", "key").collect()  # bounded by the limit
    cuts = sorted({(r.lang.encode(), bytes(r.key)) for r in cuts})
    at = np.unique(np.linspace(0, len(cuts), parts + 1).astype(int)[1:-1])
    return [(cuts[i][0].decode(), cuts[i][1]) for i in at if i < len(cuts)]


def frequent(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase (words joined by blanks), words, f: the phrases of up to LONGEST words that
    occur ``least`` times or more, and for each lang a row without phrase whose f is the number
    of all words."""
    texts = _text_rows(docs)
    parts = tasks(docs)
    begin = [(lang.encode(), key) for lang, key in _ranges(texts, parts)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TaskCounts()

        def spilt(down_to: int) -> Iterator[pa.RecordBatch]:
            for run in counts.spill(down_to):
                yield from blocks(*run, begin)

        for batch in limited(batches, most=TEXT):
            counts.add(batch.column(0), batch.column(1))
            if len(counts.word) > WORDS:
                yield from spilt(0)
                counts.forget()
            elif counts.held > HELD:
                yield from spilt(HELD // 4)
        yield from spilt(0)
        counts.forget()
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, out = Merger(least), []

        def sent() -> pa.RecordBatch:
            lang, key, k, f = zip(*out, strict=True)
            phrase = [None if x is None else _plain(x) for x in key]
            columns = [pa.array(lang), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(f, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                out += merger.add(*(c[i].as_py() for c in batch.columns))
                if len(out) > ROWS:
                    yield sent()
                    out = []
        out += merger.close()
        if out:
            yield sent()
        release()

    runs = texts.mapInArrow(count, _BLOCK)
    dealt = runs.repartitionById(parts, F.col("to")).drop("to").sortWithinPartitions("lang", "first")
    counted = dealt.mapInArrow(merge, "lang string, phrase string, words int, f long")
    whole = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= least) | F.col("phrase").isNull())


def collocations(docs: DataFrame, least: int, most: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language."""
    found = staged(frequent(docs, least))
    phrases = found.where("phrase is not null")
    total = found.where("phrase is null").select("lang", F.col("f").alias("n"))
    word = F.split("phrase", " ", -1)
    candidates = phrases.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words", word.alias("w"))

    def part(begin: Column, length: Column) -> Column:
        return F.array_join(F.slice("w", begin, length), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = "decimal(19,0)"
    # A lang's number of words meets its phrases in PARTS tasks.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")
    totals = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    cuts = cuts.withColumn("salt", salt).join(totals, ["lang", "salt"]).withColumn(
        "score",
        F.expr(f"(cast(1000 as decimal(4,0)) * cast(cast(a as {wide}) * cast(n as {wide}) as decimal(34,0))) div (cast(l as {wide}) * cast(r as {wide}))"),
    )
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))

    # A longer phrase of the same count takes its two parts, one word shorter, with it.
    longer = candidates.where("words >= 3")
    inner = longer.select(
        "lang", F.col("a"), F.explode(F.array(
            part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1)
        )).alias("phrase"),
    ).dropDuplicates()
    kept = best.join(inner, ["lang", "phrase", "a"], "left_anti")
    scored = kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        scored = scored.withColumn("rank", rank).where(F.col("rank") <= most)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
