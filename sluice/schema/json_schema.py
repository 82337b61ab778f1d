"""A JSON Schema (2020-12) of the typed JSON form."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from sluice.schema.types import BUILT_IN, FORMATS, LEXICAL, coerce, java_pattern, kind
from sluice.schema.xsd import Complex, Element, Schema, Simple


@dataclass(frozen=True)
class Options:
    mark_attributes: bool = True
    attribute_prefix: str = ""
    base_uri: str | None = None
    additional_properties: bool = False
    text_property: str = "$value"


def simple_schema(t: Simple) -> dict[str, Any]:
    k = kind(t)
    if k == "list":
        out: dict[str, Any] = {"type": "array", "items": simple_schema(t.item)}
    elif k == "union":
        return {"anyOf": [simple_schema(m) for m in t.members]}
    elif k == "string":
        out = {"type": "string"}
        if t.base in FORMATS:
            out["format"] = FORMATS[t.base]
        elif t.base in LEXICAL:
            out["pattern"] = f"^(?:{LEXICAL[t.base]})$"
        elif t.base == "base64Binary":
            out["contentEncoding"] = "base64"
        elif t.base in ("anySimpleType", "anyType"):
            out = {}
    else:
        out = {"type": k}
        if k == "integer":
            _, low, high = BUILT_IN[t.base]
            out |= {n: v for n, v in (("minimum", low), ("maximum", high)) if v is not None}
    facets = dict(t.facets)
    size = ("minItems", "maxItems") if k == "list" else ("minLength", "maxLength")
    if "length" in facets:
        out |= {size[0]: int(facets["length"]), size[1]: int(facets["length"])}
    for name, key in (("minLength", size[0]), ("maxLength", size[1])):
        if name in facets:
            out[key] = int(facets[name])
    for name, key in (("minInclusive", "minimum"), ("maxInclusive", "maximum"), ("minExclusive", "exclusiveMinimum"), ("maxExclusive", "exclusiveMaximum")):
        if name in facets:
            out[key] = coerce(facets[name], t)
    if t.enum:
        out["enum"] = [coerce(v, t) for v in t.enum]
    if len(t.patterns) == 1:
        out["pattern"] = java_pattern(t.patterns[0])
    elif t.patterns:
        out["pattern"] = "^(?:" + "|".join(f"(?:{p})" for p in t.patterns) + ")$"
    return out


def generate(schema: Schema, root: str, options: Options = Options()) -> dict[str, Any]:
    defs: dict[str, Any] = {}

    def ref(t: Complex | Simple) -> dict[str, Any]:
        if isinstance(t, Simple):
            return simple_schema(t)
        if t.name not in defs:
            defs[t.name] = {}
            defs[t.name] = body(t)
        return {"$ref": f"#/$defs/{t.name}"}

    def child(e: Element) -> dict[str, Any]:
        out = ref(schema.type_of(e))
        if e.fixed is not None:
            out = {**out, "const": e.fixed}
        elif e.default is not None:
            out = {**out, "default": e.default}
        if e.many:
            out = {"type": "array", "items": out, **({"minItems": e.least} if e.least else {}), **({"maxItems": e.most} if e.most else {})}
        return out

    def body(c: Complex) -> dict[str, Any]:
        base = schema.complex(c.base) if c.base else None
        props: dict[str, Any] = {}
        needed: list[str] = []
        if (c.content or c.mixed) and not (base and (base.content or base.mixed)):
            props[options.text_property] = simple_schema(c.content) if c.content else {"type": "string"}
            if c.content:
                needed.append(options.text_property)
        for a in c.attributes.values():
            if base and a.name in base.attributes:
                continue
            one = simple_schema(a.type) | ({"const": a.fixed} if a.fixed is not None else {}) | ({"default": _default(a.default, a.type)} if a.default is not None else {})
            if options.mark_attributes:
                one["x-xml-attribute"] = True
            if a.namespace:
                props.setdefault(a.namespace, {"type": "object", "properties": {}})["properties"][a.name] = one
                continue
            props[options.attribute_prefix + a.name] = one
            if a.required:
                needed.append(options.attribute_prefix + a.name)
        if c.repeating_choice and all(e.choice is not None for e in c.children.values()):
            # the order of unlike options matters, so they are items of one array
            one = [{"type": "object", "required": [e.name], "properties": {e.name: ref(schema.type_of(e))}, "additionalProperties": False} for e in c.children.values()]
            other = [{"type": "object", "not": {"anyOf": [{"required": [e.name]} for e in c.children.values()]}}] if c.any_element else []
            props["operations"] = {"type": "array", "items": {"oneOf": one + other}, **({"minItems": 1} if c.choice_required else {})}
            needed += ["operations"] if c.choice_required else []
        for e in () if "operations" in props and c.repeating_choice else c.children.values():
            if not (base and e.name in base.children):
                props[e.name] = child(e)
                if e.least:
                    needed.append(e.name)
        out: dict[str, Any] = {"type": "object", "properties": props}
        if needed:
            out["required"] = needed
        options_of: dict[int, list[str]] = {}
        for e in c.children.values():
            if e.choice:
                options_of.setdefault(e.choice, []).append(e.name)
        alone = [{"not": {"required": [a, b]}} for names in options_of.values() for i, a in enumerate(names) for b in names[i + 1 :]]
        if base:
            out = {"allOf": [ref(base), out, *alone]}
        elif alone:
            out["allOf"] = alone
        if c.any_element:
            out["x-xml-any"] = True
        if c.any_attribute:
            out["x-xml-any-attribute"] = True
        if c.any_element or c.any_attribute or options.additional_properties:
            out["additionalProperties"] = True
        return out

    top = ref(schema.root(root))
    registry = {"type": "object", "additionalProperties": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["prefix"], "properties": {"prefix": {"type": "string"}, "attributes": {"type": "array", "items": {"type": "string"}}, "defaultNs": {"type": "boolean"}}}]}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **({"$id": options.base_uri} if options.base_uri else {}), **top, "properties": {"$ns": registry}, "$defs": defs}


def _default(text: str, t: Simple) -> Any:
    try:
        return coerce(text, t)
    except ValueError:
        return text
