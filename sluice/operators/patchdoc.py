"""Patches of JSON manifests: XML patches converted, selectors evaluated, operations applied as one transaction.

``apply_patch`` works on any part of a document, with types from the schema path.  A document with an unusable selector, or
one that finds nothing, changes nothing at all.  ``replay_documents`` folds the patches of each manifest in order.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.selectors import Selector, Step, parse_selector
from sluice.functions.xmltree import BadXml, Node, parse
from sluice.operators.convert import Reader, Rejected, dumps, model, read_json
from sluice.schema.types import coerce
from sluice.schema.xsd import Complex, Schema, Simple
from sluice.session import ship

OPERATIONS = ("add", "replace", "remove")
_VALUE_STEP = re.compile(r"\[\s*\.\s*=\s*(?:\"([^\"]*)\"|'([^']*)')\s*\]$")


class Unresolved(ValueError):
    """A selector that is not of the language, or finds nothing."""


def selector_of(text: str | None) -> Selector:
    """A parsed selector; a value predicate ``[.='v']`` of the last step counts as a predicate on ``$value``."""
    m = _VALUE_STEP.search(text or "")
    parsed = parse_selector(text[: m.start()] if m else text)
    if parsed is None or (m and (parsed.attribute or not parsed.steps or parsed.steps[-1][1:] != (None, None, None))):
        raise Unresolved(f"unsupported selector {text!r}")
    if m:
        value = m.group(1) if m.group(1) is not None else m.group(2)
        parsed = Selector((*parsed.steps[:-1], Step(parsed.steps[-1].name, None, "$value", value)), None)
    return parsed


def is_supported(text: str | None) -> bool:
    try:
        selector_of(text)
        return True
    except Unresolved:
        return False


def _equal(have: Any, want: str | None, t: Simple | None) -> bool:
    if have is None or want is None:
        return False
    if t is not None:
        try:
            return have == coerce(want, t)
        except ValueError:
            return False  # a value that the type has not matches nothing
    return str(have) == want


class Place:
    """What a selector stands for: ``holder[key]``, and ``index`` in it where that is an array."""

    def __init__(self, holder: dict, key: str | None, index: int | None, owner: Complex | None, kind: Any):
        self.holder, self.key, self.index, self.owner, self.kind = holder, key, index, owner, kind

    @property
    def value(self) -> Any:
        if self.key is None:
            return self.holder
        got = self.holder.get(self.key)
        return got[self.index] if self.index is not None else got


def locate(doc: dict, selector: Selector, schema: Schema) -> Place:
    owner: Complex | None = schema.types.get("MPDtype")
    place = Place(doc, None, None, None, owner)
    for step in selector.steps:
        here = place.value
        if isinstance(here, list):
            raise Unresolved(f"{step.name}: the step before needs a predicate")
        if not isinstance(here, dict) or here.get(step.name) is None:
            raise Unresolved(f"{step.name} finds nothing")
        owner = place.kind if isinstance(place.kind, Complex) else None
        known = owner.children.get(step.name) if owner else None
        kind = schema.type_of(known) if known else None
        index = None
        got = here[step.name]
        if isinstance(got, list):
            if step.position is not None:
                index = step.position - 1
            elif step.attribute is not None:
                index = next((i for i, x in enumerate(got) if _holds(x, step, kind)), len(got))
            if index is not None and index >= len(got):
                raise Unresolved(f"{step.name}: no item matches")
        elif step.position not in (None, 1) or (step.attribute is not None and not _holds(got, step, kind)):
            raise Unresolved(f"{step.name}: the single element does not match")
        place = Place(here, step.name, index, owner, kind)
    return place


def _holds(item: Any, step: Step, kind: Any) -> bool:
    if step.attribute == "$value":
        have = item.get("$value") if isinstance(item, dict) else item
        t = kind.content if isinstance(kind, Complex) else kind
        return _equal(have, step.value, t if isinstance(t, Simple) else None)
    if not isinstance(item, dict):
        return False
    known = kind.attributes.get(step.attribute) if isinstance(kind, Complex) else None
    return _equal(item.get(step.attribute), step.value, known.type if known else None)


def _typed(value: Any, t: Simple | None) -> Any:
    if t is None or not isinstance(value, str):
        return value
    try:
        return coerce(value, t)
    except ValueError as e:
        raise Unresolved(str(e)) from None


def apply_patch(doc: dict, operations: list[dict], schema: Schema | None = None, strict: bool = False) -> tuple[dict, int, str | None]:
    """The document after the operations, how many were applied, and why none were.

    Each operation is ``{op: {"sel": ..., "pos": ..., "type": "@name", "$value": scalar, Name: payload, "ws": ...}}``; it sees
    the result of the one before.  All selectors are checked first and a failure leaves the given document.  ``strict``
    also fails on removing or replacing an attribute that is absent.
    """
    types = schema or model()
    try:
        parsed = []
        for o in operations:
            name, body = next(iter(o.items())) if isinstance(o, dict) and len(o) == 1 else ("", {})
            if name not in OPERATIONS or not isinstance(body, dict):
                raise Unresolved("an operation must be one of add, replace, remove")
            parsed.append((name, body, selector_of(body.get("sel"))))
        out = copy.deepcopy(doc)
        for name, body, selector in parsed:
            _apply(out, name, body, selector, types, strict)
        return out, len(parsed), None
    except Unresolved as e:
        return doc, 0, str(e)


def _payload(body: dict) -> tuple[str | None, Any]:
    """The element payload: its name and value; several names are refused by the caller."""
    names = [k for k in body if k not in ("sel", "pos", "type", "ws", "$value")]
    return (names[0], body[names[0]]) if names else (None, None)


def _apply(doc: dict, name: str, body: dict, selector: Selector, schema: Schema, strict: bool) -> None:
    place = locate(doc, selector, schema)
    attribute = selector.attribute
    if name == "add" and isinstance(body.get("type"), str) and body["type"].startswith("@"):
        attribute = body["type"][1:]
    if attribute:
        target = place.value
        if not isinstance(target, dict):
            raise Unresolved(f"@{attribute} of something without attributes")
        known = place.kind.attributes.get(attribute) if isinstance(place.kind, Complex) else None
        if strict and name != "add" and attribute not in target:
            raise Unresolved(f"@{attribute} is absent")
        if name == "remove":
            target.pop(attribute, None)
        else:
            target[attribute] = _typed(body.get("$value"), known.type if known else None)
        return
    if name == "remove":
        if place.key is None:
            raise Unresolved("the root cannot be removed")
        if place.index is None:
            del place.holder[place.key]
        else:
            del place.holder[place.key][place.index]
        return
    key, payload = _payload(body)
    if name == "replace":
        if key is None:
            target = place.value
            if isinstance(place.kind, Complex) and isinstance(target, dict):
                target["$value"] = _typed(body.get("$value"), place.kind.content)
            elif place.index is not None:
                place.holder[place.key][place.index] = _typed(body.get("$value"), place.kind if isinstance(place.kind, Simple) else None)
            elif place.key is not None:
                place.holder[place.key] = _typed(body.get("$value"), place.kind if isinstance(place.kind, Simple) else None)
            return
        if place.key != key:
            raise Unresolved(f"{place.key} cannot be replaced by {key}")
        if place.index is not None:
            place.holder[key][place.index : place.index + 1] = payload if isinstance(payload, list) else [payload]
        else:
            place.holder[key] = payload
        return
    pos = body.get("pos")
    for key, payload in ((k, body[k]) for k in body if k not in ("sel", "pos", "type", "ws", "$value")):
        items = payload if isinstance(payload, list) else [payload]
        if pos in ("before", "after"):
            if place.key != key or place.index is None:
                raise Unresolved(f"{key} cannot stand beside {place.key}")
            at = place.index + (pos == "after")
            place.holder[key][at:at] = items
            continue
        target = place.value
        if not isinstance(target, dict):
            raise Unresolved("nothing can be added there")
        known = place.kind.children.get(key) if isinstance(place.kind, Complex) else None
        if isinstance(target.get(key), list):
            target[key][0 if pos == "prepend" else len(target[key]) : 0 if pos == "prepend" else len(target[key])] = items
        elif key in target and not (known and not known.many):
            target[key] = items + [target[key]] if pos == "prepend" else [target[key], *items]
        else:
            target[key] = items if known is None or known.many or isinstance(payload, list) else payload


# XML patch -> operations


def convert_patch(xml: str, schema: Schema | None = None) -> dict:
    """An XML patch as ``{mpdId, publishTime, originalPublishTime, operations}``; raises BadXml or Rejected."""
    types = schema or model()
    root = parse(xml)
    head = {k: root.attrs.get(k) for k in ("mpdId", "publishTime", "originalPublishTime")}
    if root.local != "Patch" or None in head.values():
        raise Rejected("not a patch: the root must be Patch with mpdId, publishTime and originalPublishTime")
    return {**head, "operations": [o for c in root.children if (o := _convert(c, types))]}


def _target(selector: Selector, schema: Schema) -> Complex | Simple | None:
    t: Any = schema.types.get("MPDtype")
    for step in selector.steps:
        known = t.children.get(step.name) if isinstance(t, Complex) else None
        t = schema.type_of(known) if known else None
    return t


def _convert(node: Node, schema: Schema) -> dict | None:
    if node.local not in OPERATIONS:
        return None
    body: dict[str, Any] = {k: node.attrs[k] for k in ("sel", "pos", "type", "ws") if k in node.attrs}
    if node.local == "remove":
        return {"remove": body}
    try:
        selector = selector_of(body.get("sel"))
    except Unresolved:
        selector = None
    t = _target(selector, schema) if selector else None
    if node.children:
        beside = node.local == "replace" or body.get("pos") in ("before", "after")
        owner = _target(Selector(selector.steps[:-1], None), schema) if selector and beside and selector.steps else t
        holder = Reader(schema)
        shell = Node("_", {}, node.scope, {}, node.children)
        got = holder.element(shell, owner if isinstance(owner, Complex) else None, "")
        many = {k for k, v in got.items() if isinstance(v, list) and len(v) > 1}
        body |= {k: v if k in many or not isinstance(v, list) else v[0] for k, v in got.items()}
    elif not node.attrs.get("type") or node.text:
        attribute = selector.attribute if selector else None
        if body.get("type", "").startswith("@"):
            attribute = body["type"][1:]
        known = t.attributes.get(attribute) if isinstance(t, Complex) and attribute else None
        simple = known.type if known else t.content if isinstance(t, Complex) and not attribute else t if isinstance(t, Simple) else None
        try:
            body["$value"] = coerce(node.text, simple) if simple is not None else node.text
        except ValueError:
            body["$value"] = node.text
    return {node.local: body}


OPS = "mpd_id string, publish_time string, original_publish_time string, op_idx int, op string, sel string, body string"


def patch_operations(df: DataFrame, xml: str = "xml", schema: Schema | None = None) -> DataFrame:
    """One row per operation of XML patch documents; ``body`` is the operation's JSON.  An unreadable document has one row
    with ``op`` null and the reason as body."""
    types = schema or model()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                if text is None:
                    continue
                try:
                    p = convert_patch(text, types)
                    rows += [(p["mpdId"], p["publishTime"], p["originalPublishTime"], i, *(k := next(iter(o.items())))[:1], k[1].get("sel"), dumps(k[1])) for i, o in enumerate(p["operations"])]
                except (BadXml, Rejected) as e:
                    rows.append((None, None, None, None, None, None, str(e)))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
                names = ["mpd_id", "publish_time", "original_publish_time", "op_idx", "op", "sel", "body"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return df.select(xml).mapInArrow(run, OPS)


STATE = "mpd_id string, json string, applied int, rejected int, last_error string"


def fold(rows: Iterator[dict], schema: Schema) -> Iterator[tuple]:
    """States of manifests from rows sorted by ``mpd_id, kind, seq, op_idx``: kind 0 is the document, 1 an operation."""
    mpd, doc, seq, ops = None, None, None, []
    applied = rejected = 0
    why: str | None = None
    begun = False

    def commit() -> None:
        nonlocal doc, applied, rejected, why, ops
        if ops:
            if doc is None:
                rejected, why = rejected + 1, "no manifest to patch"
            else:
                doc, n, e = apply_patch(doc, ops, schema)
                applied, rejected, why = applied + (e is None), rejected + (e is not None), e or why
        ops = []

    for r in rows:
        if not begun or r["mpd_id"] != mpd:
            if begun:
                commit()
                yield mpd, None if doc is None else dumps(doc), applied, rejected, why
            mpd, doc, seq, ops, applied, rejected, why, begun = r["mpd_id"], None, None, [], 0, 0, None, True
        try:
            value = read_json(r["json"] or "")
        except ValueError as e:
            value, why = None, str(e)
        if r["kind"] == 0:
            doc = value if isinstance(value, dict) else None
            continue
        if r["seq"] != seq:
            commit()
            seq = r["seq"]
        ops.append({r["op"]: value} if r["op"] else {})
    if begun:
        commit()
        yield mpd, None if doc is None else dumps(doc), applied, rejected, why


def _fold(schema: Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for row in fold((r for b in batches for r in b.to_pylist()), schema):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["mpd_id", "json", "applied", "rejected", "last_error"])

    return run


def replay_documents(docs: DataFrame, ops: DataFrame, schema: Schema | None = None) -> DataFrame:
    """``docs`` (mpd_id, json) after ``ops`` (mpd_id, seq, op_idx, op, body): one shuffle by manifest, a streamed fold."""
    ship(docs.sparkSession)
    one = docs.select("mpd_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("seq"), F.lit(-1).alias("op_idx"), F.lit(None).cast("string").alias("op"), "json")
    two = ops.select("mpd_id", F.lit(1).alias("kind"), F.col("seq").cast("string"), "op_idx", "op", F.col("body").alias("json"))
    return one.unionByName(two).repartition("mpd_id").sortWithinPartitions("mpd_id", "kind", "seq", "op_idx").mapInArrow(_fold(schema or model()), STATE)
