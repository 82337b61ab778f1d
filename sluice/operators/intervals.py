"""Problem 2: overlapping, nested and gapped integer intervals become continuous periods and the gaps between them.

``continuous(intervals)`` works on any ``key, start, end`` (half open, decimal(38,0), of either sign).

1. Each interval is written as canonical dyadic blocks ``[i * 2**level, (i + 1) * 2**level)``.
2. A set of blocks is *reduced*: blocks covered by an ancestor are removed and sibling pairs merged upward until none is
   left.  Reducing is associative, so it is done once over each Arrow batch before anything is shuffled, and again over
   what meets in a cell.
3. Blocks are spread by (key, cell), a cell being the part of a block's start above ``CELL_BITS``.  A hot key is thereby
   split over all its cells; a block larger than a cell lies in the cell it starts in.  Each cell is read once, sorted; what
   is held is its maximal blocks.  ``maximal_blocks`` gives them as they leave the stage.
4. Adjacent maximal blocks of a cell are coalesced to runs, and the runs of different cells are stitched with the carry of
   their cells (one row a cell), so that only rows of cells, never all rows of a key, meet in one window.

``row_intervals`` reads the S elements of segment timelines, one interval a row; ``p2_found`` gives these to the blocks as
they are.

Defined results: a row with null or zero d covers nothing and ends where it starts; null r is 0; r below -1 covers
nothing; r = -1 without a later t covers nothing; a first row with null t starts at 0; exact duplicates change nothing;
null key parts are equal to each other; a product beyond 38 digits covers nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import cut, ship, table

#: Bits of a block's start that lie inside a cell (at 90 kHz a cell is about three minutes), and bits of the cell's number;
#: what lies above both is ``top``, which is 0 for all times below 2**84.
CELL_BITS, TOP_BITS = 24, 60

_WIDE = pa.decimal128(38, 0)
_CELL, _TOP = (1 << CELL_BITS) - 1, (1 << TOP_BITS) - 1
TIMELINE = ("mpd_id", "period_id", "as_id")
_PLACE = [T.StructField("top", T.LongType()), T.StructField("cell", T.LongType())]


def dyadic_blocks(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The canonical blocks (start, level) of [start, end), from the left edge up and down to the right edge."""
    right: list[tuple[int, int]] = []
    level = 0
    while start < end:
        if start & 1:
            yield start << level, level
            start += 1
        if end & 1:
            end -= 1
            right.append((end << level, level))
        start, end, level = start >> 1, end >> 1, level + 1
    yield from reversed(right)


def _canonical(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, level`` of the canonical blocks of many intervals of numbers from 0 to 2**62.

    Start and end part at their highest unlike bit; between start and the multiple of that power below end lies one block for
    each bit of their distance, and so it does between that multiple and end.
    """
    apart = start ^ end
    for k in (1, 2, 4, 8, 16, 32):
        apart |= apart >> k
    middle = end & ~(apart >> 1)
    up, down = middle - start, end - middle
    rows, starts, levels = [], [], []
    for bit in range(int(max(up.max(initial=0), down.max(initial=0))).bit_length()):
        for hit, first in ((np.flatnonzero((up >> bit) & 1), lambda i: middle[i] - ((up[i] >> bit) << bit)), (np.flatnonzero((down >> bit) & 1), lambda i: middle[i] + ((down[i] >> (bit + 1)) << (bit + 1)))):
            if len(hit):
                rows.append(hit)
                starts.append(first(hit))
                levels.append(np.full(len(hit), bit, np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(levels)


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The low and high 64 bits of decimals."""
    words = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset : column.offset + len(column)]
    return words[:, 0].view(np.uint64), words[:, 1]


def decompose(start: pa.Array, end: pa.Array) -> tuple[np.ndarray, ...]:
    """``row, top, cell, off, level`` of the blocks of all intervals."""
    (lo_a, hi_a), (lo_b, hi_b) = _halves(start), _halves(end)
    narrow = (hi_a >= 0) & (hi_b < 1 << (CELL_BITS + TOP_BITS - 64 - 1))
    own = np.flatnonzero(narrow)
    cell_of = lambda lo, hi: (lo >> np.uint64(CELL_BITS)).astype(np.int64) | (hi << (64 - CELL_BITS))
    a, b = cell_of(lo_a[own], hi_a[own]), cell_of(lo_b[own], hi_b[own])
    x, y = (lo_a[own] & np.uint64(_CELL)).astype(np.int64), (lo_b[own] & np.uint64(_CELL)).astype(np.int64)
    parts = []
    for cell, left, right in ((a, x, np.where(a == b, y, np.where(x > 0, _CELL + 1, 0))), (b, np.zeros_like(y), np.where(a == b, 0, y))):
        some = np.flatnonzero(left < right)
        row, off, level = _canonical(left[some], right[some])
        parts.append((own[some[row]], cell[some[row]], off, level))
    first = a + (x > 0)
    some = np.flatnonzero(first < b)
    row, cell, level = _canonical(first[some], b[some])
    parts.append((own[some[row]], cell, np.zeros(len(cell), np.int64), level + CELL_BITS))
    row, cell, off, level = map(np.concatenate, zip(*parts))
    top = np.zeros(len(row), np.int64)
    if len(own) < len(start):  # negative or beyond 2**83: whole numbers of any size
        others = np.flatnonzero(~narrow)
        wide = [(i, s >> (CELL_BITS + TOP_BITS), (s >> CELL_BITS) & _TOP, s & _CELL, v) for i, p, q in zip(others.tolist(), start.take(pa.array(others)).to_pylist(), end.take(pa.array(others)).to_pylist()) for s, v in dyadic_blocks(int(p), int(q))]
        if wide:
            extra = np.array(wide, np.int64).T
            row, top, cell, off, level = (np.concatenate(p) for p in zip((row, top, cell, off, level), extra))
    return row, top, cell, off, level


def reduce_blocks(key: np.ndarray, top: np.ndarray, cell: np.ndarray, off: np.ndarray, level: np.ndarray, ordered: bool = False) -> np.ndarray | tuple[np.ndarray, ...]:
    """The maximal blocks in order: repeated and covered ones removed, sibling pairs merged upward.

    Blocks of one key, top and cell are reduced together.  A block larger than a cell is only merged with its sibling where
    both lie in one batch of whole cells (levels below ``CELL_BITS`` always are).
    """
    if not ordered:
        order = np.lexsort((-level, off, cell, top, key))
        key, top, cell, off, level = (c[order] for c in (key, top, cell, off, level))
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (top[1:] != top[:-1]) | (cell[1:] != cell[:-1])]) if len(key) else key
    # within a cell a block reaches to off + 2**level; what is larger than the cell covers all of it
    reach = off + (np.int64(1) << np.minimum(level, CELL_BITS))
    stride = np.int64(1) << (CELL_BITS + 1)
    top_of = np.maximum.accumulate(group * stride + reach) if len(group) else reach  # groups follow one another, so one pass serves all
    kept = np.r_[True, (group[1:] * stride + off[1:]) >= top_of[:-1]] if len(group) else np.zeros(0, bool)
    key, top, cell, off, level, group = (c[kept] for c in (key, top, cell, off, level, group))
    while len(key) > 1:
        small = np.minimum(level, CELL_BITS - 1)
        left = (group[1:] == group[:-1]) & (level[1:] == level[:-1]) & (level[1:] < CELL_BITS) & ((off[:-1] >> small[:-1]) & 1 == 0) & (off[1:] - off[:-1] == np.int64(1) << small[1:])
        at = np.flatnonzero(left)
        if not len(at):
            break
        level = level.copy()
        level[at] += 1
        stay = np.ones(len(key), bool)
        stay[at + 1] = False
        key, top, cell, off, level, group = (c[stay] for c in (key, top, cell, off, level, group))
    return key, top, cell, off, level


def _key_numbers(keys: pa.StructArray) -> np.ndarray:
    """The same number for equal keys of a batch (null parts are equal)."""
    number = np.zeros(len(keys), np.int64)
    for part in keys.flatten():
        coded = part.dictionary_encode()
        number = np.unique(number * (len(coded.dictionary) + 1) + np.asarray(coded.indices.fill_null(len(coded.dictionary))), return_inverse=True)[1]
    return number


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 4000) for b in batches for i in range(0, b.num_rows, 4000)):
        row, top, cell, off, level = decompose(batch.column("start"), batch.column("end"))
        numbers = _key_numbers(batch.column("key"))
        first = np.zeros(numbers.max(initial=0) + 1, np.int64)
        first[numbers] = np.arange(len(numbers))
        key, top, cell, off, level = reduce_blocks(numbers[row], top, cell, off, level)
        yield _blocks(batch.column("key").take(pa.array(first[key])), top, cell, off, level)


def _blocks(key: pa.Array, top: np.ndarray, cell: np.ndarray, off: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(top), pa.array(cell), pa.array(off.astype(np.int32)), pa.array(level.astype(np.int32))], names=["key", "top", "cell", "off", "level"])


def _cells(give):
    """Whole cells from sorted blocks: the maximal blocks of all cells that are complete go to ``give``, those of the last
    one are held until more of it, or its end, has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns)], schema=batch.schema) if held is not None else batch
            now = _reduced(batch)
            place = [np.asarray(now.column(c)) for c in ("top", "cell")]
            numbers = _key_numbers(now.column("key"))
            last = np.flatnonzero((place[0] != place[0][-1]) | (place[1] != place[1][-1]) | (numbers != numbers[-1]))
            split = int(last[-1]) + 1 if len(last) else 0
            held = now.slice(split)
            if split:
                yield give(now.slice(0, split))
        if held is not None:
            yield give(held)

    return run


def _reduced(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The maximal blocks of a batch that is sorted by key, top, cell, off and falling level, or nearly (what was held comes
    first, and its cell goes on)."""
    numbers = _key_numbers(batch.column("key"))
    change = np.cumsum(np.r_[False, numbers[1:] != numbers[:-1]])  # keys in the order they come
    own = np.r_[0, np.flatnonzero(np.diff(change)) + 1]
    key, top, cell, off, level = reduce_blocks(change, *(np.asarray(batch.column(c)).astype(np.int64) for c in ("top", "cell", "off", "level")))
    return _blocks(batch.column("key").take(pa.array(own[key])), top, cell, off, level)


def _runs(blocks: pa.RecordBatch) -> pa.RecordBatch:
    """Adjacent maximal blocks of a cell coalesced; the bounds are whole numbers of any size."""
    top, cell, off, level = (np.asarray(blocks.column(c)).astype(np.int64) for c in ("top", "cell", "off", "level"))
    numbers = _key_numbers(blocks.column("key"))
    small = np.minimum(level, CELL_BITS)
    joined = (numbers[1:] == numbers[:-1]) & (top[1:] == top[:-1]) & (cell[1:] == cell[:-1]) & (off[1:] == off[:-1] + (np.int64(1) << small[:-1]))
    first = np.r_[0, np.flatnonzero(~joined) + 1]
    last = np.r_[first[1:] - 1, len(top) - 1]
    whole = lambda i: (((int(top[i]) << TOP_BITS) + int(cell[i])) << CELL_BITS) + int(off[i])
    starts = pa.array([Decimal(whole(i)) for i in first.tolist()], _WIDE)
    ends = pa.array([Decimal(whole(i) + (1 << int(level[i]))) for i in last.tolist()], _WIDE)
    return pa.RecordBatch.from_arrays([blocks.column("key").take(pa.array(first)), pa.array(top[first]), pa.array(cell[first]), starts, ends], names=["key", "top", "cell", "start", "end"])


def _by_cell(intervals: DataFrame) -> DataFrame:
    """Reduced blocks, each cell whole in one partition and sorted."""
    ship(intervals.sparkSession)
    wide = T.DecimalType(38, 0)
    rows = intervals.select("key", F.col("start").cast(wide).alias("start"), F.col("end").cast(wide).alias("end")).where(F.col("start") < F.col("end"))
    blocks = rows.mapInArrow(_to_blocks, T.StructType([intervals.schema["key"], *_PLACE, T.StructField("off", T.IntegerType()), T.StructField("level", T.IntegerType())]))
    return blocks.repartition("key", "top", "cell").sortWithinPartitions("key", "top", "cell", "off", F.desc("level"))


def maximal_blocks(intervals: DataFrame) -> DataFrame:
    """``key, top, cell, off, level``: the maximal dyadic blocks of each cell; a block starts at ``(top << 84) + (cell << 24) + off``."""
    blocks = _by_cell(intervals)
    return blocks.mapInArrow(_cells(lambda b: b), blocks.schema)


def continuous(intervals: DataFrame) -> DataFrame:
    """``key, kind, start, end``: each longest covered stretch (``period``) and each hole between two (``gap``).

    ``intervals`` has ``key`` (a struct), ``start`` and ``end``; rows with a null or start >= end are ignored.  Starts may be
    negative.
    """
    wide = T.DecimalType(38, 0)
    blocks = _by_cell(intervals)
    runs = cut(blocks.mapInArrow(_cells(_runs), T.StructType([blocks.schema["key"], *_PLACE, T.StructField("start", wide), T.StructField("end", wide)])), "runs")

    cell = ("key", "top", "cell")
    before = W.partitionBy("key").orderBy("top", "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = runs.groupBy(*cell).agg(F.max("end").alias("last"))
    carry = cells.withColumn("carry", F.max("last").over(before)).select(*cell, "carry")
    inside = W.partitionBy(*cell).orderBy("start")
    seen = runs.join(carry, list(cell)).withColumn("prev", F.greatest("carry", F.lag("end").over(inside)))
    breaks = seen.where(F.col("prev").isNull() | (F.col("start") > F.col("prev"))).select(*cell, "start", "prev")

    after = W.partitionBy("key").orderBy("top", "cell").rowsBetween(1, W.unboundedFollowing)
    firsts = breaks.groupBy(*cell).agg(F.min(F.struct("start", "prev")).alias("f"))
    ends = cells.groupBy("key").agg(F.max("last").alias("total"))
    nexts = firsts.withColumn("next", F.min(F.col("f.prev")).over(after)).select(*cell, "next")
    closed = breaks.join(nexts, list(cell)).join(ends, "key")
    closed = closed.withColumn("stop", F.coalesce(F.lead("prev").over(inside), "next", "total"))
    period = F.struct(F.lit("period").alias("kind"), F.col("start").alias("start"), F.col("stop").alias("end"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("start"), F.col("start").alias("end"))
    both = F.when(F.col("prev").isNull(), F.array(period)).otherwise(F.array(gap, period))
    return closed.select("key", F.explode(both).alias("x")).select("key", "x.kind", "x.start", "x.end")


def row_intervals(s: DataFrame) -> DataFrame:
    """``key, snap, start, end``: what each row of each copy of a SegmentTimeline covers."""
    wide = "decimal(38,0)"
    key = F.struct(*TIMELINE).alias("key")
    rows = s.select(key, "snap", "ord", F.col("t").cast(wide).alias("t"), F.col("d").cast(wide).alias("d"), F.coalesce("r", F.lit(0)).alias("r"))
    rows = rows.repartition("key", "snap").dropDuplicates()  # the window below uses the same partitioning
    copy = W.partitionBy("key", "snap").orderBy("ord", "t", "d", "r")
    zero = F.lit(0).cast(wide)
    length = F.when((F.col("d") > 0) & (F.col("r") >= 0), F.expr(f"cast(try_multiply(d, cast(r + 1 as decimal(19,0))) as {wide})"))
    rows = rows.withColumns({"len": F.coalesce(length, zero), "next_t": F.lead("t").over(copy)})
    upto = copy.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("len").over(upto).cast(wide) - F.col("len"))
    rows = rows.withColumns({"anchor": F.coalesce(F.last("t", True).over(upto), zero), "anchor_run": F.coalesce(F.last(F.when(F.col("t").isNotNull(), F.col("run")), True).over(upto), zero)})
    rows = rows.withColumn("start", (F.col("anchor") + F.col("run") - F.col("anchor_run")).cast(wide))
    end = F.when((F.col("r") == -1) & (F.col("d") > 0), F.coalesce("next_t", "start")).otherwise(F.col("start") + F.col("len"))
    return rows.select("key", "snap", "start", end.cast(wide).alias("end")).where(F.col("start") < F.col("end"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    out = continuous(row_intervals(table(spark, folder, "segment_timeline_s")))
    return out.select(*[F.col(f"key.{c}").alias(c) for c in TIMELINE], "kind", F.col("start").cast("string").alias("start_t"), F.col("end").cast("string").alias("end_t"))
