"""Documents that share n-grams: exact Jaccard joins over size-banded tiles.

A document is the set of its distinct word shingles (the whole sequence, if shorter), kept
as sorted 64-bit hashes; two documents link when shared * 100 >= percent * union.

Tiles.  Sizes fall into bands.  Sets that link differ in at most d shingles, d following
from the band, so of more than d segments (dealt by shingle hash) some are equal.  A tile is
a band, a segment and its content: every link lies within a tile.  Documents at the foot of
a band also enter the band below, as a link may cross.  Empty segments are left out, as long
as spare segments still guarantee a common one.

Within tiles only connectivity is needed.  Equal sets become one representative first.  Every
member is compared with its tile's least; then members of one tile that are still in
different components are compared block by block.  A comparison first counts the bits in
which two hashed bitmaps differ: each needs a shingle of its own, so the count bounds the
overlap from above.  Only pairs that can still link are intersected exactly: first the pairs
that would join a block's components, were they links; then, of what those leave apart, all,
within the block.  Neither step lists more pairs than a block has components.

What is kept of a text: documents without words have no shingles and link with nothing.
Nulls are empty texts.  Rows may repeat and doc_ids may be null or repeat: links are between
rows, equal rows are copies, and a component is named by its least doc_id (null if it has
none; a document without shingles is its own component).  Extra columns do not matter; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import (
    free_names, limited, lower_ascii, mix, raw_text, shingle_hashes, span_hashes, staged, tasks, text_column,
    tidy, word_spans,
)

#: Members of a tile compared at once, on either side, and the shingles they may have.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 18
#: Bytes of text cut into shingles at once: they take some fifty times as many.
TEXT = 1 << 20
#: Broadcast the documents to fetch up to this many; beyond it the join shuffles.
FEW = 1_000_000


def bands(limit: int) -> np.ndarray:
    """Where the bands of sizes start: 1, then half as much again each."""
    edges = [1]
    while edges[-1] <= limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


_EDGES = bands(1 << 40)


def differences(size: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two linked sets differ in at most, the lesser having ``size``."""
    return size * (100 - percent) // percent


def segments(most: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of segments of a band whose greatest size is ``most``, and how many are spare."""
    d = differences(most, percent)
    spare = 1 + d // 12
    return d + 1 + spare, spare


def sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, text after text, and where each text starts."""
    raw, offsets = raw_text(texts)
    raw = lower_ascii(raw)
    starts, ends, first = word_spans(raw, offsets)
    value, owner = shingle_hashes(span_hashes(raw, starts, ends), first, words)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _bitmaps(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits set an odd number of times, in at least twice as many places as shingles.

    With fewer places differences fall together, and sets well below the limit still pass.
    """
    sizes = np.diff(bounds)
    words = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes / 32, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(value ^ np.uint64(0xB17)) & (words[owner] * 64 - 1).astype(np.uint64)
    out = np.zeros(int(at[-1]), np.uint64)
    np.bitwise_xor.at(
        out, at[owner] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63))
    )
    return out, at


def _keys(value: np.ndarray, bounds: np.ndarray, percent: int) -> list[np.ndarray]:
    """Tile keys of each text."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(_EDGES, np.maximum(sizes, 1), "right") - 1
    crossing = (sizes > 0) & (-(-sizes * percent // 100) < _EDGES[band]) & (band > 0)
    spread = mix(value ^ np.uint64(0x5E6))
    content = mix(value ^ np.uint64(0xC047))
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    for below in (0, 1):
        own = band - below
        most = _EDGES[np.maximum(own, 0) + 1] - 1
        count, spare = segments(most, percent)
        # Without a difference to allow, linked sets are equal and already one.
        used = (sizes > 0) & (differences(most, percent) > 0) & (crossing if below else True)
        count = np.where(used, count, 0)
        at = np.concatenate([[0], np.cumsum(count)])
        mine = used[owner]
        o = owner[mine]
        slot = at[o] + (spread[mine] % np.maximum(count[o], 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(int(at[-1]), np.uint64)
        np.add.at(sums, slot, content[mine])
        full = np.bincount(slot, minlength=int(at[-1])) > 0
        doc = np.repeat(np.arange(len(sizes)), count)
        empty = count - np.bincount(doc[full], minlength=len(sizes))
        segment = np.arange(int(at[-1])) - at[doc]
        name = mix((own[doc] * (1 << 32) + segment).astype(np.uint64))
        key = mix(sums + name)
        keep = full | (empty > spare)[doc]
        kept = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(sizes)))])
        key = key[keep]
        for k in np.flatnonzero(used).tolist():
            out[k].append(key[kept[k] : kept[k + 1]])
    return [np.concatenate(k) if k else np.zeros(0, np.uint64) for k in out]


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: size and digests of the set, bitmap, and tile keys; staged under a row number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in limited(batches, most=TEXT):
            value, bounds = sets(batch.column(2), words)
            sums = []
            for seed in (0x11, 0x22):
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(seed)), dtype=np.uint64)])
                sums.append(running[bounds[1:]] - running[bounds[:-1]])
            bits, at = _bitmaps(value, bounds)
            keys = _keys(value, bounds, percent)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(bounds)),
                    *(pa.array(s.view(np.int64)) for s in sums), _lists(bits, at), _lists(flat, ends),
                ],
                names=["doc_id", "text_hash", "n", "h1", "h2", "bits", "keys"],
            )

    text = text_column(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, n long, h1 long, h2 long, bits array<long>, keys array<long>"
    return staged(rows.mapInArrow(tidy(work), schema).withColumn("row", F.monotonically_increasing_id()))


def _fold(longer: str) -> str:
    half = f"size({longer}) div 2"
    return f"zip_with(slice({longer}, 1, {half}), slice({longer}, 1 + {half}, {half}), (x, y) -> x ^ y)"


#: Whether two sets can still link: ``na``, ``nb`` shingles, bitmaps ``ba``, ``bb``.
def can_link(percent: int) -> str:
    left = f"if(size(ba) > size(bb), {_fold('ba')}, ba)"
    right = f"if(size(bb) > size(ba), {_fold('bb')}, bb)"
    differ = f"aggregate(zip_with({left}, {right}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    overlap = f"((na + nb - {differ}) div 2)"
    return f"{100 + percent} * {overlap} >= {percent} * (na + nb)"


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of rows those that the bit counts leave."""
    a = reps.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = reps.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(a, "a").join(b, "b").where(F.expr(can_link(percent))).select("a", "b")


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link, by intersecting sorted arrays.

    The partners of ``a`` come to it in groups of at most about ``BLOCK``, each with a's own
    array first; a task holds one array and a batch.
    """
    groups = pairs.groupBy("a").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    spread = pairs.join(groups.select("a", parts.alias("parts")), "a")
    needed = spread.select(
        F.col("b").alias("row"), "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.lit(1).alias("side")
    ).union(
        groups.select(
            F.col("a").alias("row"), "a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            F.lit(0).alias("side"),
        )
    )
    wanted = staged(needed.join(reps.select("row", F.col("doc_id").alias("id"), "text_hash"), "row"))
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    text = text_column(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = rows.join(side, (rows["hash"] == side["text_hash"]) & rows["doc_id"].eqNullSafe(side["id"]))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in limited(batches, most=TEXT):
            value, bounds = sets(batch.column(4), words)
            lists = [value[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(lists, pa.binary())], names=["a", "part", "side", "row", "shingles"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3)]
            for a, side_, row, raw in zip(*columns, batch.column(4), strict=True):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if side_ == 0:
                    own, mine = a, other.copy()
                elif own == a:
                    shared = _shared(mine, other)
                    if 100 * shared >= percent * (len(mine) + len(other) - shared):
                        left.append(a)
                        right.append(row)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    loaded = found.select("a", "part", "side", "row", "text").mapInArrow(
        tidy(load), "a long, part int, side int, row long, shingles binary"
    )
    ordered = loaded.repartition(tasks(docs), "a", "part").sortWithinPartitions("a", "part", "side")
    return ordered.mapInArrow(tidy(compare), "a long, b long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, of every node with an edge.

    Alternates large and small stars (each a minimum per node, combined before the shuffle,
    and a join) until nothing changes; every round is written, none is held by executors.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _together(tiled: DataFrame) -> DataFrame:
    """tile, row and the tile's least row, of tiles with more than one row.

    A task reads its tiles in order and holds a batch, however many rows a tile has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "row", "least"]
        last: tuple[int, int, bool] | None = None  # tile, its least row, whether that is out
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, row = (np.asarray(batch.column(k)) for k in (0, 1))
            opens = np.ones(len(tile), bool)
            opens[1:] = tile[1:] != tile[:-1]
            least = row[np.maximum.accumulate(np.where(opens, np.arange(len(tile)), 0))]
            out = ~opens
            out[:-1] |= ~opens[1:]
            if last and last[0] == tile[0]:
                run = len(tile) if opens.sum() == 1 else int(np.flatnonzero(opens)[1])
                least[:run], out[:run] = last[1], True
                if not last[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([last[1]])], names)
            last = (int(tile[-1]), int(least[-1]), bool(out[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (tile, row, least)], names)

    dealt = tiled.repartition(tasks(tiled), "tile").sortWithinPartitions("tile", "row")
    return dealt.mapInArrow(tidy(work), "tile long, row long, least long")


def _split(placed: DataFrame, by: list[str]) -> DataFrame:
    """The members (row, root) of groups ``by`` that are not within one component."""
    ends = placed.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return placed.join(ends.select(*by), by, "left_semi")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (tile, row, root, n, bits) of tiles in groups (tile, i, j) of bounded size, in
    which those of ``side`` 0 meet those of ``side`` 1.

    The members outside the component of the tile's least row form blocks; every member
    meets each block of others once.
    """
    facts = members.groupBy("tile").agg(
        F.min(F.struct("row", "root")).getField("root").alias("main"), F.count("*").alias("m"),
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.lit(BLOCK_SHINGLES) / F.max("n"))).cast("int").alias("most"),
    ).where("low <> high")
    open_ = members.join(facts, "tile")
    others = open_.where("root <> main").groupBy("tile").agg(F.count("*").alias("others"))
    open_ = open_.join(others, "tile").withColumns(
        {
            "outer": F.col("root") != F.col("main"),
            "blocks": F.ceil(F.col("others") / F.col("most")).cast("int"),
            "mains": F.ceil((F.col("m") - F.col("others")) / F.col("most")).cast("int"),
        }
    )
    own = F.when(F.col("outer"), F.pmod(F.hash("row"), F.col("blocks"))).otherwise(F.pmod(F.hash("row"), F.col("mains")))
    open_ = open_.withColumn("own", own)
    keep = ("tile", "row", "root", "n", "bits")
    # The other members of block i meet the main ones of block j, and the others of block j.
    as_block = open_.where("outer").select(
        *keep, F.col("own").alias("i"), F.explode(F.expr("sequence(-blocks, mains - 1)")).alias("j"), F.lit(0).alias("side")
    ).where("j >= 0 or -j - 1 >= i")
    as_main = open_.where("not outer").select(
        *keep, F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")
    )
    as_other = open_.where("outer").select(
        *keep, F.explode(F.expr("sequence(0, own)")).alias("i"), (-F.col("own") - 1).alias("j"), F.lit(1).alias("side")
    )
    return as_block.unionByName(as_main).unionByName(as_other)


class _Group:
    """The members of a block: rows, sizes, bitmaps folded to one width, labels of components."""

    def __init__(self, group: pa.Table, n: np.ndarray, bits: np.ndarray, at: np.ndarray, percent: int) -> None:
        self.row, self.n, self.percent = np.asarray(group["row"]), n, percent
        self.label = np.unique(np.asarray(group["root"]), return_inverse=True)[1]
        widths = np.diff(at)
        words = int(widths.min(initial=1 << 30))
        self.maps = np.zeros((len(n), words), np.uint64)
        for width in np.unique(widths).tolist():
            of = np.flatnonzero(widths == width)
            whole = bits[at[of][:, None] + np.arange(width)].reshape(len(of), -1, words)
            self.maps[of] = np.bitwise_xor.reduce(whole, axis=1)
        side = np.asarray(group["side"])
        self.zero, self.one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Members of side 0 with those of side 1 in other components that the bit counts let
        link with them, nearest first."""
        one, n, label, percent = self.one, self.n, self.label, self.percent
        maps = self.maps[one]
        step = max(1, (1 << 20) // max(maps.size, 1))
        for i in range(0, len(self.zero), step):
            zero = self.zero[i : i + step]
            differ = np.bitwise_count(self.maps[zero][:, None] ^ maps).sum(2, dtype=np.int64)
            a, b = n[zero][:, None], n[one]
            total = a + b
            fits = ((100 + percent) * ((total - differ) // 2) >= percent * total) & (label[zero][:, None] != label[one])
            fits &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            for k in np.flatnonzero(fits.any(1)).tolist():
                at = np.flatnonzero(fits[k])
                yield int(zero[k]), one[at[np.argsort(differ[k, at] / total[k, at], kind="stable")]]


def _merge(label: np.ndarray, k: int, others: np.ndarray) -> None:
    label[np.isin(label, label[others])] = label[k]


def _doubtful(blocks: DataFrame, percent: int) -> DataFrame:
    """The members of blocks that the bit counts let link with another component there.

    Their ``partners`` are pairs that would join all such components of the block, were all
    of them links: fewer than the block has components.
    """

    def mark(group: pa.Table) -> pa.Table:
        lists = group["bits"].combine_chunks()
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        own = _Group(group, np.asarray(group["n"]), np.asarray(lists.flatten()).view(np.uint64), at, percent)
        marked, joined = np.zeros(len(own.row), bool), own.label.copy()
        partners: list[list[int]] = [[] for _ in own.row]
        for k, near in own.pairs():
            marked[near] = marked[k] = True
            near = near[joined[near] != joined[k]]
            near = near[np.unique(joined[near], return_index=True)[1]]
            partners[k] = own.row[near].tolist()
            _merge(joined, k, near)
        kept = group.select(["tile", "i", "j", "side", "row", "root"])
        return kept.append_column("partners", pa.array(partners, pa.list_(pa.int64()))).filter(pa.array(marked))

    schema = "tile long, i int, j int, side int, row long, root long, partners array<long>"
    return blocks.groupBy("tile", "i", "j").applyInArrow(mark, schema)


def _within(docs: DataFrame, reps: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of blocks of ``members``, by intersecting the sets
    of all pairs that are not joined by then."""
    wanted = staged(members.select("row").distinct().join(reps.select("row", F.col("doc_id").alias("id"), "text_hash"), "row"))
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    text = text_column(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = rows.join(side, (rows["hash"] == side["text_hash"]) & rows["doc_id"].eqNullSafe(side["id"]))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in limited(batches, most=TEXT):
            value, bounds = sets(batch.column(1), words)
            lists = [value[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], names=["row", "shingles"])

    def compare(group: pa.Table) -> pa.Table:
        values = [np.frombuffer(v.as_buffer(), np.uint64) for v in group["shingles"]]
        n = np.array([len(v) for v in values], np.int64)
        own = _Group(group, n, *_bitmaps(np.concatenate(values), np.concatenate([[0], np.cumsum(n)])), percent)
        joined = own.label.copy()
        left: list[int] = []
        right: list[int] = []
        for k, near in own.pairs():
            for j in near.tolist():
                if joined[j] == joined[k]:
                    continue
                shared = _shared(values[k], values[j])
                if 100 * shared >= percent * (n[k] + n[j] - shared):
                    left.append(int(min(own.row[k], own.row[j])))
                    right.append(int(max(own.row[k], own.row[j])))
                    _merge(joined, k, np.array([j]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    loaded = found.select("row", "text").mapInArrow(tidy(load), "row long, shingles binary")
    # Equal rows of ``docs`` give the same set.
    once = loaded.groupBy("row").agg(F.first("shingles").alias("shingles"))
    return members.join(once, "row").groupBy("tile", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, and whether
    the row is ``kept``, the one of its component with the least doc_id."""
    rows = signatures(docs, words, percent)
    # Equal sets: the least doc_id (nulls last), then the least row, stands for all.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = staged(
        rows.where("n > 0").groupBy("n", "h1", "h2")
        .agg(F.min(order).alias("o"))
        .select("n", "h1", "h2", F.col("o.row").alias("rep"), F.col("o.doc_id").alias("least"))
    )
    reps = rows.join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    tiled = reps.select(F.explode("keys").alias("tile"), "row")
    met = staged(_together(tiled))
    # Tiles with the same members are one tile.
    sizes = met.groupBy("tile", "least").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("members")
    )
    single = sizes.groupBy("least", "m", "members").agg(F.min("tile").alias("tile")).select("tile", "m")
    members = staged(met.join(single, "tile"))
    stars = members.where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b")).distinct()
    links = staged(verified(docs, reps, staged(possible(stars, reps, percent)), words, percent).distinct())
    first = staged(components(links))
    root = F.coalesce("root", "row")
    placed = members.where("m > 2").join(first, F.col("row") == F.col("node"), "left").select("tile", "row", root.alias("root"))
    # A tile within one component has nothing left to compare.
    whole, rest = first, _split(placed, ["tile"]).join(reps.select("row", "n", "bits"), "row")
    doubtful = staged(_doubtful(_blocks(rest), percent))
    if not doubtful.isEmpty():
        likely = doubtful.select(F.col("row").alias("x"), F.explode("partners").alias("y"))
        likely = staged(likely.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        links = links.union(staged(verified(docs, reps, likely, words, percent).distinct()))
        whole = staged(components(links))
        block = ["tile", "i", "j"]
        placed = doubtful.select(*block, "side", "row").join(whole, F.col("row") == F.col("node"), "left").select(*block, "side", "row", root.alias("root"))
        apart = _split(placed, block).join(reps.select("row", "n", "bits"), "row")
        apart = staged(_doubtful(apart, percent).drop("partners"))
        if not apart.isEmpty():
            whole = staged(components(links.union(staged(_within(docs, reps, apart, words, percent)))))
    named = groups.join(whole, F.col("rep") == F.col("node"), "left").select(
        "n", "h1", "h2", "rep", "least", F.coalesce("root", "rep").alias("root")
    )
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "rep")).alias("o"))
    final = named.join(best, "root").select(
        "n", "h1", "h2", F.col("o.least").alias("component"), F.col("o.rep").alias("chosen")
    )
    alone = rows.where("n = 0").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    linked = rows.where("n > 0").select("row", "doc_id", "text_hash", "n", "h1", "h2").join(final, ["n", "h1", "h2"]).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("row") == F.col("chosen")).alias("kept"),
    )
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component; documents without shingles all stay."""
    marked = near_duplicates(docs, words, percent)
    text = text_column(docs)
    # Rows of equal doc_id and text share a fate; of those that repeat, one stays.
    fate = staged(marked.groupBy("doc_id", "text_hash", (F.col("n_shingles") > 0).alias("some")).agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("kept"))
    id_, hash_, repeats, own = free_names(docs, 4)
    fate = fate.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), (F.col("some") & (F.col("times") > 1)).alias(repeats))
    keyed = docs.withColumn(own, F.xxhash64(text))
    stay = keyed.join(fate, (F.col(own) == F.col(hash_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    once = stay.where(~F.col(repeats)).select(*docs.columns)
    again = stay.where(F.col(repeats)).dropDuplicates([id_, hash_]).select(*docs.columns)
    return once.unionByName(again)
