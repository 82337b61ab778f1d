"""Built-in XML Schema types: kind, range, JSON Schema and Spark type of each."""

from __future__ import annotations

import re
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from sluice.schema.xsd import Attribute, Complex, Schema, Simple

_I = "integer"
# Kind, lower and upper bound of the numeric and boolean types; every other built-in type is text.
BUILT_IN: dict[str, tuple[str, int | None, int | None]] = {
    "boolean": ("boolean", None, None),
    "decimal": ("number", None, None), "float": ("number", None, None), "double": ("number", None, None),
    "integer": (_I, None, None), "nonPositiveInteger": (_I, None, 0), "negativeInteger": (_I, None, -1),
    "nonNegativeInteger": (_I, 0, None), "positiveInteger": (_I, 1, None),
    "long": (_I, -(2**63), 2**63 - 1), "int": (_I, -(2**31), 2**31 - 1), "short": (_I, -(2**15), 2**15 - 1), "byte": (_I, -(2**7), 2**7 - 1),
    "unsignedLong": (_I, 0, 2**64 - 1), "unsignedInt": (_I, 0, 2**32 - 1), "unsignedShort": (_I, 0, 2**16 - 1), "unsignedByte": (_I, 0, 2**8 - 1),
}
# Formats of text types in JSON Schema.
FORMATS = {"duration": "iso-duration", "dateTime": "iso-date-time", "date": "date", "time": "iso-time", "anyURI": "uri-reference"}
# Patterns of the lexical forms, whole text.
LEXICAL = {
    "duration": r"-?P(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?",
    "dateTime": r"-?(?:[1-9]\d{3,}|0\d{3})-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?",
    "date": r"-?(?:[1-9]\d{3,}|0\d{3})-\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?",
    "time": r"\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?",
    "gYear": r"-?(?:[1-9]\d{3,}|0\d{3})(?:Z|[+-]\d\d:\d\d)?", "gYearMonth": r"-?(?:[1-9]\d{3,}|0\d{3})-\d\d(?:Z|[+-]\d\d:\d\d)?",
    "gMonth": r"--\d\d(?:Z|[+-]\d\d:\d\d)?", "gMonthDay": r"--\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?", "gDay": r"---\d\d(?:Z|[+-]\d\d:\d\d)?",
    "language": r"[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*", "hexBinary": r"(?:[0-9a-fA-F]{2})*",
    "NMTOKEN": r"[\w.:-]+", "Name": r"[A-Za-z_:][\w.:-]*", "NCName": r"[A-Za-z_][\w.-]*",
}
INTEGER, NUMBER = r"[+-]?\d+", r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def kind(t: Simple) -> str:
    """``list``, ``union``, ``boolean``, ``number``, ``integer`` or ``string``."""
    return t.base if t.base in ("list", "union") else BUILT_IN.get(t.base, ("string",))[0]


def coerce(text: str, t: Simple) -> Any:
    """The typed value of a text; raises ValueError where it has none.  INF and NaN stay text, as JSON has no such number."""
    k = kind(t)
    if k == "string":
        return text
    text = text.strip(" \t\r\n")
    if k == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}[text] if text in ("true", "1", "false", "0") else _bad(text, t)
    if k == "integer":
        return int(text) if re.fullmatch(INTEGER, text) else _bad(text, t)
    if k == "number":
        if text in ("INF", "-INF", "NaN"):
            return text
        return plain(Decimal(text)) if re.fullmatch(NUMBER, text) else _bad(text, t)
    if k == "list":
        return [coerce(x, t.item) for x in text.split()]
    for m in t.members:
        try:
            return coerce(text, m)
        except ValueError:
            pass
    return text


def plain(d: Decimal) -> int | float:
    """A whole number without a point, as JSON writers give it."""
    return int(d) if d == d.to_integral_value() and abs(d) < 10**21 else float(d)


def _bad(text: str, t: Simple) -> Any:
    raise ValueError(f"{text!r} is not {t.name}")


def to_text(value: Any) -> str:
    """The text of a typed value: lists joined by one space, true/false, whole numbers without a point."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return " ".join(to_text(v) for v in value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return str(value)


def spark_type(t: Simple) -> T.DataType:
    k = kind(t)
    if k == "boolean":
        return T.BooleanType()
    if k == "number":
        return T.DecimalType(38, 18) if t.base == "decimal" else T.DoubleType()
    if k == "list":
        return T.ArrayType(spark_type(t.item))
    if k == "integer":
        _, low, high = BUILT_IN[t.base]
        if low is not None and high is not None:
            for bits, made in ((7, T.ByteType()), (15, T.ShortType()), (31, T.IntegerType()), (63, T.LongType())):
                if -(2**bits) <= low and high < 2**bits:
                    return made
            return T.DecimalType(20, 0)
        return T.DecimalType(38, 0)
    return T.StringType()


def struct_of(schema: Schema, c: Complex, leaves: str = "typed", above: tuple[str, ...] = ()) -> T.StructType:
    """The StructType of a complex type; ``leaves="text"`` has a string for every leaf.  A type inside itself is text."""
    leaf = (lambda t: T.StringType()) if leaves == "text" else spark_type
    fields = [T.StructField("$value", leaf(c.content) if c.content else T.StringType())] if c.content or c.mixed else []
    groups: dict[str, list[Attribute]] = {}
    for a in c.attributes.values():
        if a.namespace:
            groups.setdefault(a.namespace, []).append(a)
        else:
            fields.append(T.StructField(a.name, leaf(a.type)))
    for e in c.children.values():
        t = schema.type_of(e)
        inner = leaf(t) if isinstance(t, Simple) else T.StringType() if t.name in above else struct_of(schema, t, leaves, (*above, c.name))
        fields.append(T.StructField(e.name, T.ArrayType(inner) if e.many else inner))
    names = {f.name for f in fields}
    fields += [T.StructField(g, T.StructType([T.StructField(a.name, leaf(a.type)) for a in attrs])) for g, attrs in groups.items() if g not in names]
    return T.StructType(fields)


def schema_fields(schema: Schema, root: str) -> list[tuple[str, str, str, str, str, bool, bool, str | None]]:
    """``path, owner, name, kind, type, required, many, default`` of every field, each path once."""
    out: list[tuple] = []

    def walk(path: str, c: Complex, above: tuple[str, ...]) -> None:
        for a in c.attributes.values():
            out.append((f"{path}/@{a.name}", c.name, a.name, "attribute", a.type.name, a.required, False, a.default))
        if c.content:
            out.append((f"{path}/$value", c.name, "$value", "content", c.content.name, True, False, None))
        for e in c.children.values():
            t = schema.type_of(e)
            out.append((f"{path}/{e.name}", c.name, e.name, "element", t.name, e.least > 0, e.many, e.default))
            if isinstance(t, Complex) and t.name not in above:
                walk(f"{path}/{e.name}", t, (*above, t.name))

    top = schema.root(root)
    walk(root, top, (top.name,))
    return out


def java_pattern(pattern: str) -> str:
    """An XML Schema pattern as a Java one: name classes written out, anchored as a whole."""
    out = pattern.replace(r"\i", "[A-Za-z_:]").replace(r"\c", "[A-Za-z0-9._:-]")
    return f"^(?:{out})$"
