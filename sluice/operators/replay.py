"""Problem 6: a feed of patch operations, repeated and out of order, is replayed into the current state.

* Transactions: deliveries with the same manifest and instant are one document; of a repeated operation the delivery
  received first counts.  A document is complete when its operation numbers run from 0 without a hole.
* Sequence gaps: a document names the instant it was made for (``before``).  Where no document of the manifest has that
  instant, and it is not the manifest's first, one is missing (``documents``, ``commits``).
* Watermark: per manifest, the instant of the last document before its first gap or incomplete document.  ``hold_gaps``
  exposes the state up to it, as an open feed needs; without it the feed is closed, nothing can fill a gap any more, and
  what was held is released in its order.  ``watermark`` exposes only documents up to one instant.
* Parallel keys: manifests cannot conflict.  Nor can *lanes*, the sets of Periods of one manifest that documents link
  (``lanes``), so each manifest with more than one in ``HOT`` of all operations is spread over its lanes; the result is the
  same.  A manifest whose Periods are also selected by place, or by another attribute than id, is one lane.
* Order: documents apply by instant, operations by number.  Deliveries are gathered to one row, their instants read once,
  and the fold reads its sorted partition as a stream; it holds the state of one lane and one document, never a group.
* Atomicity: what a document changes is logged and undone by inverse steps when a selector is outside the language or a
  Period, AdaptationSet or Representation step finds nothing.

Defined results: deliveries whose time is not one instant are left out; a patch of a manifest without initial state works
on an empty one; null selectors, unknown operations and unreadable payloads void their document; exact repeats change
nothing; an attribute that is no number is a null bandwidth; a hole in the places of AdaptationSets stands for sets without
Representations, however many, and is kept as a number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.columns import utc_micros
from sluice.functions.jsontext import loads, storable
from sluice.functions.selectors import Step, parse_selector
from sluice.operators.instants import normalise_instants
from sluice.session import cut, ship, table

LEVELS = ("Period", "AdaptationSet", "Representation")
#: A manifest with more than one in so many operations is split; there are fewer such manifests than this.
HOT = 64
STATE = "mpd_id string, period_id string, as_id int, rep_id string, bandwidth bigint"


class Void(Exception):
    """The document has no effect."""


class Node:
    """A Period, AdaptationSet or Representation: its attributes and its children of the next level, in order.  One with a
    ``span`` above 1 stands for so many empty ones."""

    __slots__ = ("attrs", "children", "by_id", "span", "holes")

    def __init__(self, attrs: dict[str, str], span: int = 1):
        self.attrs = attrs
        self.children: list[Node] = []
        self.by_id: dict[str | int, Node] | None = None  # the only child of each id; None where not known, or not the only one
        self.span, self.holes = span, 0

    def splice(self, level: str, at: int, n: int, new: list["Node"]) -> list["Node"]:
        """Put ``new`` in the place of n children, which are returned; the look-up by id follows where it can."""
        old = self.children[at : at + n]
        self.children[at : at + n] = new
        self.holes += sum(c.span > 1 for c in new) - sum(c.span > 1 for c in old)
        if self.by_id is not None:
            for c in old:
                if (key := _key(level, c.attrs.get("id"))) is not None:
                    self.by_id.pop(key, None)
            for c in new:
                if (key := _key(level, c.attrs.get("id"))) is not None and self.by_id.setdefault(key, c) is not c:
                    self.by_id = None
                    break
        return old


def _number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _key(level: str, own: str | None) -> str | int | None:
    """Ids of AdaptationSets are numbers, all others text."""
    number = _number(own) if level == "AdaptationSet" else None
    return own if number is None else number


def _same(have: str | None, want: str | None) -> bool:
    if have is None or want is None:
        return False
    return have == want or ((a := _number(have)) is not None and a == _number(want))


def _text(value: Any) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def build(level: int, payload: Any) -> Node:
    """A subtree from a JSON payload."""
    if not isinstance(payload, dict):
        raise Void
    node = Node({k: _text(v) for k, v in payload.items() if v is not None and not isinstance(v, (dict, list))})
    if level + 1 < len(LEVELS):
        inner = payload.get(LEVELS[level + 1])
        node.children = [build(level + 1, x) for x in (inner if isinstance(inner, list) else [] if inner is None else [inner])]
    return node


class Replay:
    """The state of one manifest."""

    def __init__(self) -> None:
        self.root = Node({})
        self.undo: list[tuple] = []
        self._loaded: dict[tuple[str | None, int], Node] = {}
        self._periods: dict[str | None, list] = {}  # Period and its number of places, while loading

    def document(self, ops: list[tuple]) -> bool:
        self.undo.clear()
        try:
            for op in ops:
                self.apply(op)
            return True
        except Void:
            for node, *was in reversed(self.undo):
                node.by_id = None
                if len(was) == 4:
                    node.splice(*was)
                else:
                    owner, name, value = was
                    if value is None:
                        owner.attrs.pop(name, None)
                    else:
                        owner.attrs[name] = value
            return False

    def splice(self, node: Node, level: str, at: int, n: int, new: list[Node]) -> None:
        self.undo.append((node, level, at, len(new), node.splice(level, at, n, new)))

    def set_attribute(self, node: Node, parent: Node, name: str, value: str | None) -> None:
        if name == "id":
            parent.by_id = None
        self.undo.append((parent, node, name, node.attrs.get(name)))
        if value is None:
            node.attrs.pop(name, None)
        else:
            node.attrs[name] = value

    def place_of(self, node: Node, level: str, position: int) -> int:
        """The index of the child at a place; one within a hole is made."""
        if not node.holes:
            if position > len(node.children):
                raise Void
            return position - 1
        before = 0
        for i, c in enumerate(node.children):
            if before + c.span >= position:
                if c.span > 1:
                    lead, rest = position - 1 - before, before + c.span - position
                    self.splice(node, level, i, 1, [*([Node({}, lead)] if lead else []), Node({}), *([Node({}, rest)] if rest else [])])
                    return i + (lead > 0)
                return i
            before += c.span
        raise Void

    def find(self, node: Node, step: Step) -> int:
        """The index of the child that a step selects."""
        if step.attribute is None:
            return self.place_of(node, step.name, step.position or 1)
        if step.value is None:
            raise Void
        if step.attribute == "id":
            key = _key(step.name, step.value)
            if node.by_id is None:
                seen: dict[str | int, Node] = {}
                for c in node.children:
                    if (own := _key(step.name, c.attrs.get("id"))) is not None:
                        seen.setdefault(own, c)
                if len(seen) == sum("id" in c.attrs for c in node.children):
                    node.by_id = seen
            else:
                seen = node.by_id
            if (got := seen.get(key)) is None:
                raise Void
            return node.children.index(got)
        for i, c in enumerate(node.children):
            if _same(c.attrs.get(step.attribute), step.value):
                return i
        raise Void

    def apply(self, op: tuple) -> None:
        _, _, _, kind, sel, pos, attr, name, payload, value = op
        selector = parse_selector(sel)
        if selector is None or kind not in ("add", "replace", "remove"):
            raise Void
        path: list[tuple[Node, int]] = []  # parent and index, for each level found
        node, beyond = self.root, False
        for step in selector.steps:
            if not beyond and len(path) < len(LEVELS) and step.name == LEVELS[len(path)]:
                i = self.find(node, step)
                path.append((node, i))
                node = node.children[i]
            elif step.name in LEVELS:
                raise Void
            else:
                beyond = True
        if beyond or (not path and (selector.attribute or kind != "add" or attr)):
            return  # other steps always find something, and hold nothing of the state
        attribute = selector.attribute or (attr.removeprefix("@") if attr else None)
        if attribute:
            if kind == "remove":
                self.set_attribute(node, path[-1][0], attribute, None)
            elif value is not None:
                self.set_attribute(node, path[-1][0], attribute, value)
            return
        if kind == "remove":
            self.splice(path[-1][0], LEVELS[len(path) - 1], path[-1][1], 1, [])
            return
        if kind == "replace" or pos in ("before", "after"):
            if not path:
                return
            parent, i, level = *path[-1], len(path) - 1
        else:
            parent, i, level = node, 0, len(path)
        if level >= len(LEVELS) or (name is not None and name != LEVELS[level]):
            if kind == "add" and name in LEVELS:
                raise Void
            return  # content that is not part of the state
        new = self.payload(payload, level)
        at = i if kind == "replace" or pos == "before" else i + 1 if pos == "after" else 0 if pos == "prepend" else len(parent.children)
        self.splice(parent, LEVELS[level], at, int(kind == "replace"), new)

    @staticmethod
    def payload(text: str | None, level: int) -> list[Node]:
        try:
            got = loads(text or "")
        except ValueError:
            raise Void from None
        return [build(level, x) for x in (got if isinstance(got, list) else [got])]

    def load(self, period_id: str | None, as_id: int | None, as_ord: int | None, rep_id: str | None, *values: Any) -> None:
        """One Representation of the initial state; rows come in order."""
        if period_id not in self._periods:
            period = Node({} if period_id is None else {"id": period_id})
            self._periods[period_id] = [period, 0]
            self.root.splice(LEVELS[0], len(self.root.children), 0, [period])
        period, places = self._periods[period_id]
        place = max(1, as_ord or places + 1)
        aset = self._loaded.get((period_id, place))
        if aset is None:
            if place > places:
                aset = Node({})
                hole = place - places - 1
                period.splice(LEVELS[1], len(period.children), 0, [*([Node({}, hole)] if hole else []), aset])
                self._periods[period_id][1] = place
            else:
                aset = period.children[self.place_of(period, LEVELS[1], place)]
            self._loaded[period_id, place] = aset
        if as_id is not None:
            period.by_id = None
            aset.attrs["id"] = str(as_id)
        named = zip(("id", "bandwidth", "width", "height", "codecs"), (rep_id, *values))
        aset.splice(LEVELS[2], len(aset.children), 0, [Node({k: str(v) for k, v in named if v is not None})])

    def rows(self) -> Iterator[tuple]:
        for p in self.root.children:
            for a in p.children:
                for r in a.children:
                    bandwidth = _number(r.attrs.get("bandwidth"))
                    yield p.attrs.get("id"), _number(a.attrs.get("id")), r.attrs.get("id"), bandwidth if bandwidth is None or abs(bandwidth) < 1 << 63 else None


_STATE_COLUMNS = ("period_id", "as_id", "as_ord", "rep_id", "bandwidth", "width", "height", "codecs")
_OP_COLUMNS = ("op_idx", "_received", "patch_id", "op", "sel", "pos", "attr", "payload_name", "payload_json", "value")


def in_order(ops: list[tuple]) -> list[tuple]:
    """Operations of one document by number; of a repeated number the one received first."""
    if len(ops) > 1:
        ops = sorted(ops, key=lambda o: tuple((x is not None, x) for x in o))
        ops = [o for i, o in enumerate(ops) if not i or o[0] != ops[i - 1][0]]
    return ops


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mpd, lane, state, instant = None, None, None, None
    ops: list[tuple] = []
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())

    def out() -> Iterator[pa.RecordBatch]:
        if ops:
            state.document(in_order(ops))
        rows = [(mpd, *r) for r in state.rows()]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), kinds)], names=["mpd_id", "period_id", "as_id", "rep_id", "bandwidth"])

    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        column = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
        lists = batch.column("ops")
        fields = lists.flatten()
        every = list(zip(*(fields.field(c).to_pylist() for c in _OP_COLUMNS)))
        at = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).tolist()
        initial = zip(*(column(c) for c in _STATE_COLUMNS))
        for i, (m, n, kind, when, row) in enumerate(zip(column("mpd_id"), column("lane"), column("kind"), column("instant"), initial)):
            if state is None or m != mpd or n != lane:
                if state is not None:
                    yield from out()
                mpd, lane, state, instant, ops = m, n, Replay(), None, []
            if kind == 0:
                state.load(*row)
                continue
            if when != instant and ops:
                state.document(in_order(ops))
                ops = []
            instant = when
            ops += every[at[i] : at[i + 1]]
    if state is not None:
        yield from out()


DELIVERY = ("mpd_id", "patch_id", "packager_id")


def delivery_instants(ops: DataFrame, packager: DataFrame, *fields: str) -> DataFrame:
    """``mpd_id, patch_id, packager_id, field, text, instant`` (microseconds) of the deliveries' times that are one instant, by the
    operator and the estimated zones of problem 1; a narrow written table."""
    got = normalise_instants(ops, packager, fields, DELIVERY).where(F.col("status") == "ok")
    return cut(got.select(*DELIVERY, "field", "text", F.col("_utc").alias("instant")), "deliveries")


ANY, NO_ID = "\x01any", "\x01none"


def periods_of(sel: str | None, attr: str | None, name: str | None, payload: str | None) -> list[str]:
    """The ids of the Periods an operation reads or changes, read as ``Replay.apply`` reads it; with ``ANY`` where they cannot
    be told; none where it has no effect on Periods (its selector is void or leads elsewhere)."""
    selector = parse_selector(sel)
    if selector is None or (selector.steps and selector.steps[0].name != LEVELS[0]) or (not selector.steps and (selector.attribute or attr)):
        return []
    own = [step.value if step.attribute == "id" and step.value is not None else ANY for step in selector.steps[:1]]
    if len(selector.steps) > 1:
        return own
    attribute = selector.attribute or (attr.removeprefix("@") if attr else None)
    if attribute:
        return [*own, ANY] if attribute == "id" else own
    if name is not None and name != LEVELS[0]:
        return own
    try:
        added = Replay.payload(payload, 0)
    except Void:
        return own
    return own + [NO_ID if (own_id := node.attrs.get("id")) is None else storable(own_id) for node in added]


def touched_periods(sel: Column, attr: Column, name: Column, payload: Column) -> Column:
    """``periods_of`` as a column; only rows of hot manifests are read so."""
    return F.udf(periods_of, "array<string>", useArrow=True)(sel, attr, name, payload)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of Period ids, sorted by manifest, to the lane of each id."""
    mpd, up, begun = None, {}, False

    def top(x: str) -> str:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def lanes() -> pa.RecordBatch:
        whole = ANY in up
        keys = list(up)
        return pa.RecordBatch.from_arrays([pa.array([mpd] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(["" if whole else top(k) for k in keys], pa.string())], names=["mpd_id", "key", "lane"])

    for batch in batches:
        for m, a, b in zip(*(batch.column(c).to_pylist() for c in ("mpd_id", "a", "b"))):
            if not begun or m != mpd:
                if begun:
                    yield lanes()
                mpd, up, begun = m, {}, True
            up.setdefault(a, a)
            up.setdefault(b, b)
            up[top(a)] = top(b)
    if begun:
        yield lanes()


def lanes(state: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mpd_id, key, lane`` of all Periods, and ``mpd_id, instant, key`` of the documents that touch any.

    Documents are reduced to distinct pairs of ids before the pairs of a manifest meet in one stream.
    """
    touched = ops.select("mpd_id", "instant", F.explode(touched_periods(F.col("sel"), F.col("attr"), F.col("payload_name"), F.col("payload_json"))).alias("key"))
    docs = touched.groupBy("mpd_id", "instant").agg(F.min("key").alias("a"), F.collect_set("key").alias("keys"))
    pairs = docs.select("mpd_id", "a", F.explode("keys").alias("b"))
    first = state.select("mpd_id", F.coalesce("period_id", F.lit(NO_ID)).alias("a"))
    pairs = pairs.unionByName(first.withColumn("b", F.col("a"))).distinct()
    found = pairs.repartition("mpd_id").sortWithinPartitions("mpd_id").mapInArrow(_unite, "mpd_id string, key string, lane string")
    return found, docs.select("mpd_id", "instant", F.col("a").alias("key"))


def hot_manifests(ops: DataFrame) -> list[str]:
    """Fewer than ``HOT`` names, by the count of one column."""
    total = ops.count()
    counts = ops.groupBy("mpd_id").agg(F.count("*").alias("n")).where(F.col("mpd_id").isNotNull() & (F.col("n") * HOT > total))
    return [r.mpd_id for r in counts.collect()]


def documents(deliveries: DataFrame) -> DataFrame:
    """``mpd_id, instant, before, operations, complete`` of each document, from deliveries with ``mpd_id, instant, before`` (may be
    missing) and ``numbers``, the array of their operation numbers."""
    before = F.col("before") if "before" in deliveries.columns else F.lit(None).cast("bigint")
    rows = deliveries.where(F.col("instant").isNotNull()).select("mpd_id", "instant", before.alias("before"), F.explode_outer("numbers").alias("number"))
    out = rows.groupBy("mpd_id", "instant").agg(F.min("before").alias("before"), F.count_distinct("number").alias("operations"), F.min("number").alias("_a"), F.max("number").alias("_b"))
    complete = F.coalesce((F.col("_a") == 0) & (F.col("_b") + 1 == F.col("operations")), F.lit(False))
    return out.select("mpd_id", "instant", "before", "operations", complete.alias("complete"))


def commits(docs: DataFrame) -> DataFrame:
    """``mpd_id, documents, committed, held, watermark, gap`` of each manifest: ``watermark`` is the instant of the last document of
    its contiguous prefix, ``gap`` that of the first document that must wait (null if none).

    Links are found by equal keys, so a manifest with any number of documents is spread; only counts meet per manifest.
    """
    docs = cut(docs, "documents")
    known = docs.select(F.col("mpd_id").alias("_m"), F.col("instant").alias("_i"), F.lit(True).alias("linked"))
    first = docs.groupBy(F.col("mpd_id").alias("_n")).agg(F.min("instant").alias("first"))
    linked = docs.join(known, docs["mpd_id"].eqNullSafe(F.col("_m")) & (docs["before"] == F.col("_i")), "left").drop("_m", "_i")
    missing = F.col("before").isNotNull() & F.col("linked").isNull()
    waits = linked.where(~F.col("complete") | missing)
    waits = waits.join(first, waits["mpd_id"].eqNullSafe(F.col("_n"))).where(~F.col("complete") | (F.col("instant") > F.col("first")))
    gaps = waits.groupBy(F.col("mpd_id").alias("_g")).agg(F.min("instant").alias("gap"))
    inside = F.col("gap").isNull() | (F.col("instant") < F.col("gap"))
    out = docs.join(gaps, docs["mpd_id"].eqNullSafe(F.col("_g")), "left").groupBy("mpd_id").agg(
        F.count("*").alias("documents"), F.count_if(inside).alias("committed"), F.max(F.when(inside, F.col("instant"))).alias("watermark"), F.min("gap").alias("gap")
    )
    return out.select("mpd_id", "documents", "committed", (F.col("documents") - F.col("committed")).alias("held"), "watermark", "gap")


def _split(both: DataFrame) -> DataFrame:
    """Rows of hot manifests with their lane; documents that touch no Period change nothing and are left out."""
    state, ops = both.where("kind = 0"), both.where("kind = 1")
    single = ops.select("mpd_id", "instant", F.explode("ops").alias("o")).select("mpd_id", "instant", "o.*")
    found, docs = lanes(state, single)
    found = found.withColumnsRenamed({"mpd_id": "_m", "key": "_k", "lane": "_lane"})
    at = F.col("mpd_id").eqNullSafe(F.col("_m"))
    placed = docs.join(found, at & (F.col("key") == F.col("_k"))).select(F.col("mpd_id").alias("_m"), F.col("instant").alias("_i"), "_lane")
    ops = ops.join(placed, at & (F.col("instant") == F.col("_i"))).drop("_m", "_i")
    state = state.join(found, at & (F.coalesce("period_id", F.lit(NO_ID)) == F.col("_k"))).drop("_m", "_k")
    return ops.unionByName(state).withColumn("lane", F.col("_lane")).drop("_lane")


#: Selectors that end in content which is not part of the state; what such operations carry is not sent to the replay.
_ASIDE = r"^/MPD(?:/Period(?:\[[^\]]*\])?(?:/AdaptationSet(?:\[[^\]]*\])?(?:/Representation(?:\[[^\]]*\])?)?)?)?/(?!Period\b|AdaptationSet\b|Representation\b|@)"


def replay(state: DataFrame, ops: DataFrame, hold_gaps: bool = False, watermark: int | None = None, instants: DataFrame | None = None, keys: tuple[str, ...] = ("instant",)) -> DataFrame:
    """The Representations after all documents.  ``ops`` has ``instant`` in microseconds (null: left out) and perhaps ``before``; or
    ``instants`` has them for the values of ``mpd_id, patch_id`` and ``keys``, which identify a delivery.
    """
    ship(state.sparkSession)
    times = [c for c in ("instant", "before") if c in (ops if instants is None else instants).columns]
    if instants is None:
        keys = tuple(times)
    hot = F.coalesce(F.col("mpd_id").isin(hot_manifests(ops)), F.lit(False))
    aside = F.coalesce(F.col("sel").rlike(_ASIDE), F.lit(False))
    one = ops.withColumns({"_received": utc_micros(ops, "received_at"), "payload_json": F.when(~aside, F.col("payload_json")), "value": F.when(~aside, F.col("value"))})
    kinds = {f.name: f.dataType for f in one.schema.fields}
    empty = F.lit(None).cast(T.StructType([T.StructField(c, kinds[c]) for c in _OP_COLUMNS]))
    one = one.select("mpd_id", F.lit(1).alias("kind"), *keys, "patch_id", F.struct(*_OP_COLUMNS).alias("_op"))
    first = state.select("mpd_id", F.lit(0).alias("kind"), *_STATE_COLUMNS, "ord", empty.alias("_op"))
    both = one.unionByName(first, allowMissingColumns=True)
    if instants is not None:  # rows of their own that meet the operations of their delivery by its keys, so there is no join
        both = both.unionByName(instants.select("mpd_id", F.lit(1).alias("kind"), *keys, "patch_id", *times), allowMissingColumns=True)

    def gathered(rows: DataFrame, *spread: str) -> DataFrame:
        """One row a delivery with the array of its operations, and the distinct rows of the initial state."""
        by = ("mpd_id", "kind", *keys, "patch_id", *_STATE_COLUMNS, "ord")
        found = [F.max(t).alias(t) for t in times if t not in keys]
        got = rows.repartition(*spread).groupBy(*by).agg(F.collect_set("_op").alias("ops"), *found)
        got = got.where((F.col("kind") == 0) | (F.col("instant").isNotNull() & (F.size("ops") > 0)))
        return (got if watermark is None else got.where((F.col("kind") == 0) | (F.col("instant") <= watermark))).withColumn("lane", F.lit(""))

    def folded(rows: DataFrame) -> DataFrame:
        order = ("mpd_id", "lane", "kind", "instant", "as_ord", "ord", "period_id", "rep_id")
        return rows.sortWithinPartitions(*order).select("mpd_id", "lane", "kind", "instant", *_STATE_COLUMNS, "ops").mapInArrow(_fold, STATE)

    if not hold_gaps:
        cold = folded(gathered(both.where(~hot), "mpd_id"))
        return cold.unionByName(folded(_split(gathered(both.where(hot), "mpd_id", "patch_id")).repartition("mpd_id", "lane")))
    rows = cut(gathered(both, "mpd_id", "patch_id"), "deliveries")
    done = commits(documents(rows.where("kind = 1").withColumn("numbers", F.transform("ops", lambda o: o["op_idx"]))))
    done = done.where(F.col("gap").isNotNull()).select(F.col("mpd_id").alias("_m"), F.col("gap").alias("_gap"))
    rows = rows.join(done, rows["mpd_id"].eqNullSafe(F.col("_m")), "left").where((F.col("kind") == 0) | F.col("_gap").isNull() | (F.col("instant") < F.col("_gap"))).drop("_m", "_gap")
    cold = folded(rows.where(~hot).repartition("mpd_id"))
    return cold.unionByName(folded(_split(rows.where(hot)).repartition("mpd_id", "lane")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    ops = table(spark, folder, "patch_op")
    instants = delivery_instants(ops, table(spark, folder, "packager"), "publish_time").withColumnRenamed("text", "publish_time").drop("field")
    return replay(table(spark, folder, "representation"), ops.where(F.col("publish_time").isNotNull()), instants=instants, keys=("packager_id", "publish_time")).distinct()


def p6_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """How far the feed of each manifest is committed, and what waits behind a gap."""
    ops = table(spark, folder, "patch_op")
    instants = delivery_instants(ops, table(spark, folder, "packager"), "publish_time", "original_publish_time")
    rows = ops.groupBy(*DELIVERY, "publish_time", "original_publish_time").agg(F.collect_set("op_idx").alias("numbers"))
    for field, name in (("publish_time", "instant"), ("original_publish_time", "before")):
        one = instants.where(F.col("field") == field).select(*[F.col(k).alias(f"_{k}") for k in DELIVERY], F.col("text").alias("_text"), F.col("instant").alias(name))
        same = F.col(field) == F.col("_text")
        for k in DELIVERY:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(one, same, "left").drop("_text", *[f"_{k}" for k in DELIVERY])
    return commits(documents(rows)).drop("gap")


def p6_committed(spark: SparkSession, folder: str) -> DataFrame:
    """An open feed: each user's events as patches made for the event before, every 23rd event lost.  The state exposed is that of
    the events before the first one that misses its predecessor."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("mpd_id"), F.col("event_id").alias("patch_id"), F.col("event_id").alias("instant"))
    e = e.withColumn("before", F.lag("instant").over(W.partitionBy("mpd_id").orderBy("instant")))
    text = lambda v: F.lit(v).cast("string")
    payload = F.to_json(F.struct(F.col("instant").cast("string").alias("id"), F.col("instant").alias("bandwidth")))
    ops = e.where(F.col("instant") % 23 != 0).select(
        "mpd_id", "patch_id", "instant", "before", F.lit(0).alias("op_idx"), text("add").alias("op"), text("/MPD/Period[@id='p']/AdaptationSet[1]").alias("sel"), text(None).alias("pos"), text(None).alias("attr"),
        text("Representation").alias("payload_name"), payload.alias("payload_json"), text(None).alias("value"), F.timestamp_micros("instant").alias("received_at"),
    )
    one, none = F.lit(1), F.lit(None).cast("int")
    state = e.select("mpd_id").distinct().select("mpd_id", text("p").alias("period_id"), one.alias("as_id"), one.alias("as_ord"), one.alias("ord"), text("r").alias("rep_id"), F.lit(0).cast("bigint").alias("bandwidth"), none.alias("width"), none.alias("height"), text(None).alias("codecs"))
    return replay(state, ops, hold_gaps=True).select("mpd_id", "rep_id", "bandwidth")
