"""Problem 5: two copies of the same data are compared, field by field.

Both copies of a row are read into cells ``path, field, value`` (an element itself is the cell with the empty field).
A checksum matrix of key bucket by field holds, for each copy, the sum of a 128-bit hash of its cells (kept as six limbs, so
that sums of any number of rows stay exact; one copy with a minus); equal copies of one row cancel to zero, those of unlike
rows of one document never.  Only the buckets that do not cancel are read again, and only their unequal fields meet in the
comparison.  There is one bucket for about ``ROWS_A_BUCKET`` rows, so that what an unequal row makes read again does not grow
with the table; sums are made map-side, so no key is ever gathered.  The unequal part of the matrix and the cells of the
second reading are narrow written tables, as each is read twice.

Defined results: outer white space, order, comments and XML style never matter; named fields compare as booleans or
numbers, a text that is neither compares as text; an empty value is a value; a copy that is null or not well-formed is
missing as a whole (path ``MPD``); two missing copies give nothing; repeated rows give their differences once; a repeated
element path keeps the last value of a field.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import cut, scan, ship

# What is an element of the key chain, and how fields compare.
LEVELS = ("MPD", "Period", "AdaptationSet", "Representation")
BOOLEANS = frozenset(("segmentAlignment", "subsegmentAlignment", "bitstreamSwitching"))
NUMBERS = frozenset(("bandwidth", "width", "height", "startWithSAP", "maxPlayoutRate", "qualityRanking", "group"))

_SPACE = " \t\r\n"
#: Rows that share a bucket of the matrix.
ROWS_A_BUCKET = 4
_LEAST_BUCKETS = 1 << 10
SUMMED = "bucket bigint, salt bigint, side tinyint, path string, field string, value string"
CELLS = "doc_id string, pair bigint, bucket bigint, side tinyint, path string, anchor string, field string, value string"


def canonical(field: str, value: str) -> str:
    value = value.strip(_SPACE)
    if field in BOOLEANS:
        return {"1": "true", "0": "false"}.get(value, value)
    if field in NUMBERS:
        try:
            number = Decimal(value)
            return format(number.normalize(), "f") if number.is_finite() and abs(number.adjusted()) < 400 else value
        except InvalidOperation:
            return value
    return value


def read_copy(xml: str) -> list[tuple[str, str, str, str]]:
    """``path, anchor, field, value`` of one copy; the anchor is the path that must be on both sides for the cell to count.

    Raises expat.ExpatError where the text is not well-formed; a document type is refused, so nothing expands.
    """
    cells: dict[tuple[str, str], tuple[str, str]] = {}
    stack: list[str | None] = []
    text: list[str] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        local = name.rpartition(":")[2]
        depth = len(stack)
        text.clear()
        if depth < 4 and local == LEVELS[depth] and (not stack or stack[-1] is not None):
            step = local if not depth else f"{local}[{attrs.get('id', '').strip(_SPACE)}]"
            path = f"{stack[-1]}/{step}" if depth else step
            cells[path, ""] = (stack[-1] if depth else "", "")
            for k, v in attrs.items():
                if k != "id" and k != "xmlns" and not k.startswith("xmlns:"):
                    cells[path, k] = (path, canonical(k, v))
            stack.append(path)
        else:
            stack.append(None)

    def end(name: str) -> None:
        stack.pop()
        if name.rpartition(":")[2] == "BaseURL" and stack and stack[-1] is not None:
            cells[stack[-1], "BaseURL"] = (stack[-1], canonical("BaseURL", "".join(text)))
        text.clear()

    def refuse(*_: object) -> None:
        raise expat.ExpatError("document type")

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    parser.StartDoctypeDeclHandler = refuse
    parser.Parse(xml.encode("utf-8"), True)
    return [(path, anchor, field, value) for (path, field), (anchor, value) in cells.items()]


def _read(left: str, right: str, keys: tuple[str, ...], anchored: bool):
    """One row a cell, with the row's keys."""
    names = [*keys, "side", "path", *(["anchor"] if anchored else []), "field", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            of: list[int] = []
            sides: list[int] = []
            cells: list[tuple[str, str, str, str]] = []
            for i, copies in enumerate(zip(batch.column(left).to_pylist(), batch.column(right).to_pylist())):
                for side, xml in zip((1, -1), copies):
                    if xml is not None:
                        try:
                            got = read_copy(xml)
                        except expat.ExpatError:
                            continue
                        cells += got
                        of += [i] * len(got)
                        sides += [side] * len(got)
            if cells:
                path, anchor, field, value = (pa.array(c, pa.string()) for c in zip(*cells))
                own = [batch.column(k).take(pa.array(of, pa.int64())) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sides, pa.int8()), path, *([anchor] if anchored else []), field, value], names=names)

    return run


def _limbs(seed: int) -> list[Column]:
    """A 64-bit hash of a cell as three signed parts of 22, 21 and 21 bits."""
    h = F.xxhash64(F.lit(seed), "salt", "path", "field", "value")
    return [F.shiftright(h, 42), F.shiftright(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), h.bitwiseAND(F.lit((1 << 21) - 1))]


def compare_copies(df: DataFrame, left: str, right: str, buckets: int | None = None) -> DataFrame:
    """``doc_id, path, field, kind`` of all differences between the copies ``left`` and ``right``."""
    ship(df.sparkSession)
    buckets = buckets or max(_LEAST_BUCKETS, df.count() // ROWS_A_BUCKET)
    keyed = df.select("doc_id", left, right, F.xxhash64(left, F.col(left).isNull(), right, F.col(right).isNull()).alias("pair"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("bigint").alias("bucket"))
    keyed = keyed.where(F.col(left).isNotNull() | F.col(right).isNotNull())

    salted = keyed.select("bucket", F.xxhash64("doc_id", "pair").alias("salt"), left, right)
    cells = salted.mapInArrow(_read(left, right, ("bucket", "salt"), False), SUMMED)
    parts = [x for seed in (0, 1) for x in _limbs(seed)]
    sums = [F.sum(x * F.col("side")).alias(f"h{i}") for i, x in enumerate(parts)]
    matrix = cells.groupBy("bucket", "field").agg(*sums, F.sum("side").alias("n"))
    differs = F.col("n") != 0
    for i in range(len(parts)):
        differs = differs | (F.col(f"h{i}") != 0)
    unequal = cut(matrix.where(differs).select("bucket", "field"), "unequal")

    again = keyed.join(unequal.select("bucket").distinct(), "bucket", "left_semi")
    marked = again.mapInArrow(_read(left, right, ("doc_id", "pair", "bucket"), True), CELLS).join(unequal.withColumn("hit", F.lit(True)), ["bucket", "field"], "left")
    kept = marked.where(F.col("hit") | (F.col("field") == ""))
    one = lambda side, what: F.max(F.when(F.col("side") == side, what))
    joined = kept.groupBy("doc_id", "pair", "path", "anchor", "field").agg(one(1, F.col("value")).alias("a"), one(-1, F.col("value")).alias("b"))
    joined = cut(joined, "cells")
    a, b = F.col("a"), F.col("b")
    kind = F.when(b.isNull(), "only_original").when(a.isNull(), "only_regenerated").when(a != b, "differs")
    both = joined.where((F.col("field") == "") & a.isNotNull() & b.isNotNull()).select("doc_id", "pair", F.col("path").alias("anchor"), F.lit(True).alias("anchored"))
    found = joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).alias("f")
    same = lambda c: F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}"))
    linked = found.join(both.alias("e"), same("doc_id") & same("pair") & same("anchor"), "left")
    return linked.where(F.col("anchored") | (F.col("f.anchor") == "")).select("f.doc_id", "f.path", "f.field", "f.kind").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compare_copies(scan(spark, folder, "roundtrip", "doc_id", "original_mpd", "regenerated_mpd"), "original_mpd", "regenerated_mpd")
