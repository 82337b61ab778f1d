"""Manifests between XML and typed JSON, in both directions.

The type of every field comes from its path through the schema, never from its name alone.  One Arrow stage per direction
does whole documents; each row gets its result or its error, and no bad document fails a task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.functions.jsontext import Raw, loads, storable
from sluice.functions.xmltree import DASH, XLINK, XML, BadXml, Node, Out, parse, write
from sluice.schema.types import coerce, to_text
from sluice.schema.xsd import Complex, Schema, Simple, frozen
from sluice.session import ship

RESERVED = ("$ns", "$value")
#: Namespaces that only have attributes.
ATTRIBUTE_ONLY = {XLINK: "xlink"}
# Attributes with one possible value.
XLINK_FIXED = (("type", "simple"), ("show", "embed"))


class Rejected(ValueError):
    """The document cannot be converted."""


@lru_cache(maxsize=8)
def model(path: str | None = None) -> Schema:
    """A schema's types below MPD; the built-in core schema without a path."""
    return frozen(Schema(path or str(Path(__file__).resolve().parent.parent / "schema" / "core.xsd")), "MPD")


# XML -> JSON


class Reader:
    """One document on its way to JSON: namespace bindings met so far, and coercion errors."""

    def __init__(self, schema: Schema, value_key: str = "$value"):
        self.schema, self.value_key = schema, value_key
        self.prefix_of: dict[str, str] = {}
        self.uri_of: dict[str, str] = {}
        self.attributes: dict[str, set[str]] = {}
        self.default_ns: set[str] = set()
        self.elements: set[str] = set()
        self.errors: list[dict[str, str]] = []

    def document(self, root: Node) -> dict[str, Any]:
        if root.name != "MPD":
            raise Rejected("Failed to convert: the root is not MPD")
        body = self.element(root, self.schema.types["MPDtype"] if "MPDtype" in self.schema.types else next(iter(self.schema.types.values())), "MPD")
        registry = {}
        for uri, prefix in self.prefix_of.items():
            attributes = sorted(self.attributes.get(uri, ()))
            plain = not attributes and uri not in self.default_ns or (uri in ATTRIBUTE_ONLY and uri not in self.elements)
            registry[uri] = prefix if plain else {"prefix": prefix, **({"attributes": attributes} if attributes else {}), **({"defaultNs": True} if uri in self.default_ns else {})}
        return {**({"$ns": registry} if registry else {}), **body}

    def bind(self, prefix: str, uri: str, synthetic: bool = False) -> None:
        if uri == DASH:
            return
        if prefix in RESERVED:
            raise Rejected(f"prefix {prefix} is reserved")
        if self.uri_of.get(prefix, uri) != uri:
            raise Rejected(f"prefix {prefix} is bound to {self.uri_of[prefix]} and to {uri}")
        if self.prefix_of.get(uri, prefix) != prefix or (uri in self.prefix_of and synthetic != (uri in self.default_ns)):
            raise Rejected(f"namespace {uri} has two prefixes: {self.prefix_of[uri]} and {prefix}")
        self.uri_of[prefix], self.prefix_of[uri] = uri, prefix
        if synthetic:
            self.default_ns.add(uri)

    def declare(self, node: Node) -> None:
        for p, uri in node.declared.items():
            if p and uri != "http://www.w3.org/2001/XMLSchema-instance":
                self.bind(p, uri)

    def leaf(self, text: str, t: Simple, path: str) -> Any:
        try:
            return coerce(text, t)
        except ValueError as e:
            self.errors.append({"path": path, "msg": str(e)})
            return text

    def group(self, out: dict, prefix: str, c: Complex | None) -> dict:
        """The object that holds a namespace's content."""
        if c and (prefix in c.children or prefix in c.attributes):
            raise Rejected(f"prefix {prefix} is also a name of {c.name}")
        got = out.setdefault(prefix, {})
        if not isinstance(got, dict):
            raise Rejected(f"prefix {prefix} is also a name")
        return got

    def element(self, node: Node, c: Complex | None, path: str) -> dict[str, Any]:
        self.declare(node)
        out: dict[str, Any] = {}
        for p, local, uri, v in node.plain_attrs():
            if not p or uri == DASH:
                known = c.attributes.get(local) if c else None
                out[local] = self.leaf(v, known.type, f"{path}/@{local}") if known else v
            elif uri == XML:
                out[f"xml:{local}"] = v
            else:
                self.bind(p, uri or "")
                if uri == XLINK and (local, v) in XLINK_FIXED:
                    continue  # says nothing; the writer adds it again
                self.attributes.setdefault(uri or "", set()).add(local)
                known = c.attributes.get(f"{p}:{local}") if c else None
                self.group(out, p, c)[local] = self.leaf(v, known.type, f"{path}/@{p}:{local}") if known else v
        if c and c.content:
            out[self.value_key] = self.leaf(node.text, c.content, f"{path}/$value")
        elif node.text and (c is None or c.mixed):
            out[self.value_key] = node.text
        for child in node.children:
            if child.uri == DASH or (child.uri is None and not child.prefix) or (not child.prefix and child.uri == node.uri):
                known = c.children.get(child.local) if c else None
                t = self.schema.type_of(known) if known else None
                here = f"{path}/{child.local}"
                if c and not known:
                    self.errors.append({"path": here, "msg": "the schema has no such element; its values stay text"})
                if isinstance(t, Simple):
                    self.declare(child)
                    value: Any = self.leaf(child.text, t, here)
                else:
                    value = self.element(child, t, here)
                self.put(out, child.local, value, bool(known and known.many))
            elif not child.prefix:
                self.bind(child.local, child.uri or "", synthetic=True)
                if c and (child.local in c.children or child.local in c.attributes):
                    raise Rejected(f"element {child.local} of {child.uri} is also a name of {c.name}")
                value = self.extension(child, child.uri or "", child.local)
                self.put(out, child.local, value if isinstance(value, dict) else {self.value_key: value}, False)
            else:
                self.bind(child.prefix, child.uri or "")
                self.elements.add(child.uri or "")
                self.put(self.group(out, child.prefix, c), child.local, self.extension(child, child.uri or "", child.prefix), False)
        return out

    def extension(self, node: Node, uri: str, prefix: str) -> Any:
        """Content of another namespace: names without its prefix, values as text, foreign content under its own prefix."""
        self.declare(node)
        out: dict[str, Any] = {}
        for p, local, owner, v in node.plain_attrs():
            if owner == XML:
                out[f"xml:{local}"] = v
                continue
            self.attributes.setdefault(owner or uri, set()).add(local)
            if p and owner:
                self.bind(p, owner)
                self.group(out, p, None)[local] = v
            else:
                out[local] = v
        for child in node.children:
            if child.uri == uri:
                self.put(out, child.local, self.extension(child, uri, prefix), False)
            elif child.prefix:
                self.bind(child.prefix, child.uri or "")
                self.elements.add(child.uri or "")
                self.put(self.group(out, child.prefix, None), child.local, self.extension(child, child.uri or "", child.prefix), False)
            else:
                value = self.extension(child, child.uri or "", child.local)
                if child.uri and child.uri != DASH:
                    self.bind(child.local, child.uri, synthetic=True)
                self.put(out, child.local, value, False)
        if not out and not node.children:
            return node.text
        if node.text:
            out[self.value_key] = node.text
        return out

    @staticmethod
    def put(out: dict, key: str, value: Any, many: bool) -> None:
        if key not in out:
            out[key] = [value] if many else value
        elif isinstance(out[key], list):
            out[key].append(value)
        else:
            out[key] = [out[key], value]


def xml_to_json(xml: str, schema: Schema | None = None) -> tuple[dict[str, Any], list[dict[str, str]]]:
    """The JSON form and the values that do not fit their type (kept as text); raises BadXml or Rejected."""
    reader = Reader(schema or model())
    return reader.document(parse(xml)), reader.errors


# JSON -> XML


class Writer:
    """One JSON document on its way to XML."""

    def __init__(self, schema: Schema, doc: dict[str, Any]):
        self.schema = schema
        self.warnings: list[str] = []
        self.entries: dict[str, tuple[str, set[str], bool]] = {}  # prefix -> uri, attributes, default
        for uri, b in (doc.get("$ns") or {}).items():
            prefix = b.get("prefix") if isinstance(b, dict) else b
            if not isinstance(prefix, str) or prefix in self.entries:
                raise Rejected(f"$ns: prefix {prefix} is missing or bound twice")
            extended = b if isinstance(b, dict) else {}
            self.entries[prefix] = (uri, set(extended.get("attributes") or ()), bool(extended.get("defaultNs")))

    def document(self, doc: dict[str, Any]) -> Out:
        root = self.element("MPD", doc, self.schema.types.get("MPDtype"), True)
        declared = [("xmlns", DASH)] + [(f"xmlns:{p}", uri) for p, (uri, _, default) in self.entries.items() if not default]
        root.attrs = declared + root.attrs
        return root

    def element(self, name: str, obj: Any, c: Complex | None, top: bool = False) -> Out:
        out = Out(name)
        if not isinstance(obj, dict):
            out.text = None if obj is None else to_text(obj)
            return out
        children: list[tuple[int, Out]] = []
        last = len(c.order) if c else 0
        for key, value in obj.items():
            if key == "$ns":
                if not top:
                    self.warnings.append(f"{name}: a nested $ns is ignored")
            elif value is None:
                continue
            elif key == "$value":
                out.text = to_text(value)
            elif c and key in c.attributes:
                out.attrs.append((key, to_text(value)))
            elif c and key in c.children:
                known = self.schema.type_of(c.children[key])
                for v in value if isinstance(value, list) and c.children[key].many else [value]:
                    children.append((c.order[key], self.element(key, v, known if isinstance(known, Complex) else None)))
            elif key in self.entries:
                for a, e in self.extension(key, value):
                    out.attrs += a
                    children += [(last, x) for x in e]
            elif key.startswith("xml:") or (not isinstance(value, (dict, list)) and not key[:1].isupper()):
                out.attrs.append((key, to_text(value)))
            elif isinstance(value, list) and value and not any(isinstance(v, (dict, list)) for v in value) and not key[:1].isupper():
                out.attrs.append((key, to_text(value)))
            else:
                for v in value if isinstance(value, list) else [value]:
                    children.append((last, self.element(key, v, None)))
        children.sort(key=lambda x: x[0])  # schema order; others last, as they came
        out.children = [e for _, e in children]
        return out

    def extension(self, prefix: str, value: Any) -> Iterator[tuple[list[tuple[str, str]], list[Out]]]:
        """Attributes for the element around, and child elements, of one namespace group."""
        uri, attributes, default = self.entries[prefix]
        if default:
            for v in value if isinstance(value, list) else [value]:
                e = self.inner(prefix, v, prefix, "")
                e.attrs.insert(0, ("xmlns", uri))
                yield [], [e]
            return
        for k, v in value.items() if isinstance(value, dict) else ():
            if v is None:
                continue
            scalar = not isinstance(v, (dict, list))
            if scalar and (k in attributes or uri in ATTRIBUTE_ONLY):
                yield [(f"{prefix}:{k}", to_text(v))], []
            else:
                for x in v if isinstance(v, list) else [v]:
                    yield [], [self.inner(f"{prefix}:{k}", x, prefix, f"{prefix}:")]
        if uri == XLINK and isinstance(value, dict) and "href" in value:
            yield [(f"{prefix}:{k}", fixed) for k, fixed in XLINK_FIXED if k not in value], []

    def inner(self, name: str, obj: Any, prefix: str, lead: str) -> Out:
        """An element of extension content: listed scalars are its own attributes, other members its children."""
        out = Out(name)
        if not isinstance(obj, dict):
            out.text = None if obj is None else to_text(obj)
            return out
        attributes = self.entries[prefix][1]
        for k, v in obj.items():
            if k == "$value":
                out.text = to_text(v)
            elif v is None or k == "$ns":
                continue
            elif k in self.entries and isinstance(v, dict) and k != prefix:
                for a, e in self.extension(k, v):
                    out.attrs += a
                    out.children += e
            elif k == prefix and isinstance(v, dict) and lead:
                out.attrs += [(f"{prefix}:{x}", to_text(y)) for x, y in v.items()]
            elif not isinstance(v, (dict, list)) and (k in attributes or k.startswith("xml:")):
                out.attrs.append((k, to_text(v)))
            else:
                out.children += [self.inner(lead + k, x, prefix, lead) for x in (v if isinstance(v, list) else [v])]
        return out


def json_to_xml(doc: dict[str, Any], schema: Schema | None = None, declaration: bool = True, indent: str | None = "  ") -> tuple[str, list[str]]:
    """The XML text and warnings; raises Rejected."""
    writer = Writer(schema or model(), doc)
    return write(writer.document(doc), declaration, indent), writer.warnings


# DataFrames


def dumps(value: Any, pretty: bool = False) -> str:
    return storable(json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")))


def _numbers(value: Any) -> Any:
    """Numbers of a parsed JSON text as Python numbers, whole ones exact."""
    if isinstance(value, Raw):
        try:
            return int(value)
        except ValueError:
            return float(value)
    if isinstance(value, dict):
        return {k: _numbers(v) for k, v in value.items()}
    return [_numbers(v) for v in value] if isinstance(value, list) else value


def read_json(text: str) -> Any:
    return _numbers(loads(text))


_ERRORS = pa.list_(pa.struct([("path", pa.string()), ("msg", pa.string())]))


def _per_row(column: str, make, out_name: str, timed: str | None):
    """An Arrow stage that adds ``out_name``, ``error`` and ``errors`` by ``make(text) -> (text, errors)``, and the time it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[str | None] = []
            error: list[str | None] = []
            errors: list[list] = []
            took: list[float] = []
            for text in batch.column(column).to_pylist():
                got, why, bad = None, None, []
                began = time.perf_counter()
                try:
                    if text is None:
                        why = "no text"
                    else:
                        got, bad = make(text)
                except (ValueError, RecursionError, KeyError, AttributeError, TypeError) as e:
                    why = str(e) or type(e).__name__
                made.append(got)
                error.append(why)
                errors.append(bad)
                took.append(1000 * (time.perf_counter() - began))
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.string()), pa.array(error, pa.string()), pa.array(errors, _ERRORS), *([pa.array(took)] if timed else [])], names=[*batch.schema.names, out_name, "error", "errors", *([timed] if timed else [])])

    return run


def _with(df: DataFrame, column: str, make, out_name: str, timed: str | None) -> DataFrame:
    ship(df.sparkSession)
    df = df.drop(out_name, "error", "errors", *([timed] if timed else []))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_per_row(column, make, out_name, timed), f"{ddl}, `{out_name}` string, error string, errors array<struct<path string, msg string>>" + (f", `{timed}` double" if timed else ""))


def to_json(df: DataFrame, xml: str = "xml", out: str = "json", schema: Schema | None = None, pretty: bool = False, timed: str | None = None) -> DataFrame:
    """Add the JSON form, ``error`` (why there is none) and ``errors`` (values that do not fit their type); ``timed`` names a
    column for the milliseconds of each document."""
    types = schema or model()

    def make(text: str) -> tuple[str, list]:
        doc, errors = xml_to_json(text, types)
        return dumps(doc, pretty), errors

    return _with(df, xml, make, out, timed)


def to_xml(df: DataFrame, column: str = "json", out: str = "xml", schema: Schema | None = None, declaration: bool = True, indent: str | None = "  ", timed: str | None = None) -> DataFrame:
    """Add the XML form, ``error`` and ``errors`` (here: warnings)."""
    types = schema or model()

    def make(text: str) -> tuple[str, list]:
        doc = read_json(text)
        if not isinstance(doc, dict):
            raise Rejected("the root is not an object")
        xml, warnings = json_to_xml(doc, types, declaration, indent)
        return xml, [{"path": "", "msg": w} for w in warnings]

    return _with(df, column, make, out, timed)
