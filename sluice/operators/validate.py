"""Typed JSON manifests checked against the schema: required members, types, enumerations, ranges, patterns, lengths, counts,
exclusive choices and the namespace registry.  One Arrow stage; each document gets the array of its errors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.operators.convert import model, read_json
from sluice.schema.types import BUILT_IN, LEXICAL, java_pattern, kind
from sluice.schema.xsd import Complex, Schema, Simple
from sluice.session import ship


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:
        return None  # a pattern of another dialect is not checked


def check_value(value: Any, t: Simple) -> str | None:
    """Why a JSON value is not of a simple type; None if it is."""
    k = kind(t)
    facets = dict(t.facets)
    if k == "union":
        return None if any(check_value(value, m) is None for m in t.members) else f"not {t.name}"
    if k == "list":
        if not isinstance(value, list):
            return f"not a list of {t.item.name}"
        if any(check_value(v, t.item) for v in value):
            return f"an item is not {t.item.name}"
        size = len(value)
    elif k == "boolean":
        return None if isinstance(value, bool) else "not a boolean"
    elif k in ("integer", "number"):
        if k == "number" and value in ("INF", "-INF", "NaN"):
            return None
        if isinstance(value, bool) or not isinstance(value, int if k == "integer" else (int, float)):
            return f"not {'an integer' if k == 'integer' else 'a number'}"
        _, low, high = BUILT_IN[t.base]
        for name, bound, bad in (("minInclusive", low, lambda b: value < b), ("maxInclusive", high, lambda b: value > b), ("minExclusive", None, lambda b: value <= b), ("maxExclusive", None, lambda b: value >= b)):
            for limit in (bound, float(facets[name]) if name in facets else None):
                if limit is not None and bad(limit):
                    return f"{value} is outside {name} {limit:g}" if isinstance(limit, float) else f"{value} is outside {t.base}"
        return None if not t.enum or str(value) in t.enum else "not one of the enumeration"
    else:
        if not isinstance(value, str):
            return "not a string"
        if t.base in LEXICAL and not re.fullmatch(LEXICAL[t.base], value):
            return f"not a {t.base}"
        size = len(value)
    for name, bad in (("length", lambda n: size != n), ("minLength", lambda n: size < n), ("maxLength", lambda n: size > n)):
        if name in facets and bad(int(facets[name])):
            return f"{name} {facets[name]} is not kept"
    if t.enum and value not in t.enum:
        return "not one of the enumeration"
    patterns = [p for p in (_compiled(java_pattern(p)) for p in t.patterns) if p]
    return "does not match the pattern" if patterns and isinstance(value, str) and not any(p.match(value) for p in patterns) else None


def check_document(doc: Any, schema: Schema) -> list[dict[str, str]]:
    """All errors of a document, each with its path."""
    errors: list[dict[str, str]] = []
    note = lambda path, msg: errors.append({"path": path, "msg": msg})
    if not isinstance(doc, dict):
        return [{"path": "", "msg": "not an object"}]
    registry = doc.get("$ns", {})
    prefixes: list[Any] = []
    for uri, b in registry.items() if isinstance(registry, dict) else ():
        prefix = b.get("prefix") if isinstance(b, dict) else b
        if not isinstance(prefix, str):
            note("/$ns", f"{uri} has no prefix")
        prefixes.append(prefix)
    for p in {p for p in prefixes if isinstance(p, str) and prefixes.count(p) > 1}:
        note("/$ns", f"prefix {p} is bound twice")
    todo: list[tuple[str, Any, Complex]] = [("", doc, schema.types["MPDtype"])]
    while todo:
        path, obj, c = todo.pop()
        if not isinstance(obj, dict):
            note(path, "not an object")
            continue
        known = {"$ns", "$value", *(p for p in prefixes if isinstance(p, str))}
        if c.content and "$value" not in obj:
            note(path, "$value is required")
        elif c.content and (why := check_value(obj["$value"], c.content)):
            note(f"{path}/$value", why)
        for name, a in c.attributes.items():
            if a.namespace:
                known.add(a.namespace)
                continue
            known.add(name)
            if name not in obj:
                if a.required:
                    note(f"{path}/@{name}", "required")
            elif a.fixed is not None and obj[name] != a.fixed:
                note(f"{path}/@{name}", f"must be {a.fixed}")
            elif why := check_value(obj[name], a.type):
                note(f"{path}/@{name}", why)
        chosen: dict[int, str] = {}
        for name, e in c.children.items():
            known.add(name)
            if name not in obj:
                if e.least:
                    note(f"{path}/{name}", "required")
                continue
            if e.choice:
                if e.choice in chosen:
                    note(f"{path}/{name}", f"excludes {chosen[e.choice]}")
                chosen[e.choice] = name
            t = schema.type_of(e)
            items = obj[name] if e.many else [obj[name]]
            if not isinstance(items, list):
                note(f"{path}/{name}", "not an array")
                continue
            if len(items) < e.least or (e.most is not None and len(items) > e.most):
                note(f"{path}/{name}", "too few or too many")
            for i, x in enumerate(items):
                here = f"{path}/{name}[{i + 1}]" if e.many else f"{path}/{name}"
                if isinstance(t, Complex):
                    todo.append((here, x, t))
                elif why := check_value(x, t):
                    note(here, why)
        if not (c.any_element or c.any_attribute):
            for name in sorted(set(obj) - known):
                note(f"{path}/{name}", "unknown")
    return sorted(errors, key=lambda e: (e["path"], e["msg"]))


def validate(df: DataFrame, column: str = "json", schema: Schema | None = None) -> DataFrame:
    """``doc_id, errors``: an unreadable text has one error, a null text one too."""
    types = schema or model()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    out.append(check_document(read_json(text), types) if text is not None else [{"path": "", "msg": "no text"}])
                except (ValueError, RecursionError) as e:
                    out.append([{"path": "", "msg": str(e)}])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("msg", pa.string())])))], names=["doc_id", "errors"])

    return df.select("doc_id", column).mapInArrow(run, "doc_id string, errors array<struct<path string, msg string>>")
