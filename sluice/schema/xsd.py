"""XML Schema to a resolved type model: types flattened over their bases, groups and references replaced.

Entities of an internal document type are expanded by the parser (with its own guard against blow-up).  Imports and
includes are followed transitively, a URL by its base name beside the importing file, each file once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path
from xml.etree import ElementTree as ET

XS = "{http://www.w3.org/2001/XMLSchema}"


@dataclass(frozen=True)
class Simple:
    """A simple type: ``base`` is the built-in type it comes from; lists have ``item``, unions ``members``."""

    name: str
    base: str
    item: "Simple | None" = None
    members: tuple["Simple", ...] = ()
    enum: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    facets: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Attribute:
    name: str
    type: Simple
    required: bool = False
    default: str | None = None
    fixed: str | None = None
    namespace: str | None = None


@dataclass(frozen=True)
class Element:
    """A child: ``type`` is a name of ``Schema.types`` (complex) or a simple type."""

    name: str
    type: "str | Simple"
    least: int = 1
    most: int | None = 1
    default: str | None = None
    fixed: str | None = None
    choice: int | None = None  # number of the choice it is one option of

    @property
    def many(self) -> bool:
        return self.most is None or self.most > 1


@dataclass
class Complex:
    name: str
    attributes: dict[str, Attribute] = field(default_factory=dict)
    children: dict[str, Element] = field(default_factory=dict)  # in schema order
    content: Simple | None = None
    mixed: bool = False
    any_element: bool = False
    any_attribute: bool = False
    base: str | None = None
    repeating_choice: bool = False
    choice_required: bool = False

    @cached_property
    def order(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.children)}


def local(name: str) -> str:
    return name.rpartition(":")[2]


class Schema:
    """All named definitions of a schema and what it imports."""

    def __init__(self, paths: list[Path] | Path | str, text: str | None = None):
        self.roots: dict[str, dict[str, ET.Element]] = {k: {} for k in ("element", "complexType", "simpleType", "attribute", "group", "attributeGroup")}
        self.types: dict[str, Complex] = {}
        self._simple: dict[str, Simple] = {}
        self._choices = 0
        self.target: str | None = None
        if text is not None:
            self._add(ET.fromstring(text), None)
        else:
            seen: set[Path] = set()
            for p in paths if isinstance(paths, list) else [Path(paths)]:
                self._load(Path(p), seen)

    def _load(self, path: Path, seen: set[Path]) -> None:
        path = path.resolve()
        if path in seen or not path.exists():
            return
        seen.add(path)
        root = ET.parse(path).getroot()
        self._add(root, (path, seen))

    def _add(self, root: ET.Element, at) -> None:
        namespace = root.get("targetNamespace")
        self.target = self.target or namespace
        for node in root:
            kind = node.tag.removeprefix(XS)
            if kind in self.roots and node.get("name"):
                node.set("_ns", namespace or "")
                self.roots[kind].setdefault(node.get("name"), node)
            elif kind in ("import", "include") and at and node.get("schemaLocation"):
                where = node.get("schemaLocation")
                self._load(at[0].parent / (where.rpartition("/")[2] if "://" in where else where), at[1])

    # simple types

    def simple(self, name: str) -> Simple:
        """A named simple type, or a built-in one."""
        bare = local(name)
        if bare not in self._simple:
            node = self.roots["simpleType"].get(bare)
            self._simple[bare] = Simple(bare, bare) if node is None else self._read_simple(node, bare)
        return self._simple[bare]

    def _read_simple(self, node: ET.Element, name: str) -> Simple:
        one = node.find(f"{XS}restriction")
        if one is not None:
            inner = one.find(f"{XS}simpleType")
            return self._restrict(self._read_simple(inner, name) if inner is not None else self.simple(one.get("base")), one, name)
        one = node.find(f"{XS}list")
        if one is not None:
            inner = one.find(f"{XS}simpleType")
            return Simple(name, "list", item=self._read_simple(inner, name) if inner is not None else self.simple(one.get("itemType")))
        one = node.find(f"{XS}union")
        members = [self.simple(m) for m in (one.get("memberTypes") or "").split()] + [self._read_simple(m, name) for m in one.findall(f"{XS}simpleType")]
        return Simple(name, "union", members=tuple(members))

    @staticmethod
    def _restrict(base: Simple, node: ET.Element, name: str) -> Simple:
        values = [(f.tag.removeprefix(XS), f.get("value")) for f in node if f.get("value") is not None]
        enum = tuple(v for k, v in values if k == "enumeration")
        patterns = tuple(v for k, v in values if k == "pattern")
        own = {k: v for k, v in values if k not in ("enumeration", "pattern")}
        return replace(base, name=name, enum=enum or base.enum, patterns=patterns or base.patterns, facets=tuple({**dict(base.facets), **own}.items()))

    # complex types

    def complex(self, name: str) -> Complex:
        """A named complex type with its base's fields before its own."""
        bare = local(name)
        if bare not in self.types:
            made = self.types[bare] = Complex(bare)  # first, so that a recursive type ends here
            self._read_complex(self.roots["complexType"][bare], made)
        return self.types[bare]

    def type_of(self, element: Element) -> "Complex | Simple":
        return self.complex(element.type) if isinstance(element.type, str) else element.type

    def root(self, name: str) -> Complex:
        node = self.roots["element"][name]
        kind = self._element(node, name).type
        return self.complex(kind) if isinstance(kind, str) else Complex(name, content=kind)

    def _read_complex(self, node: ET.Element, out: Complex) -> None:
        out.mixed = node.get("mixed") == "true"
        body = node
        for kind in ("simpleContent", "complexContent"):
            content = node.find(f"{XS}{kind}")
            if content is None:
                continue
            out.mixed |= content.get("mixed") == "true"
            body = next(x for x in content if x.tag in (f"{XS}extension", f"{XS}restriction"))
            base = local(body.get("base"))
            extends = body.tag == f"{XS}extension"
            if base in self.roots["complexType"]:
                up = self.complex(base)
                out.base, out.content, out.mixed = base, up.content, out.mixed or up.mixed
                out.attributes.update(up.attributes)
                out.any_element, out.any_attribute = up.any_element, up.any_attribute
                if extends:
                    out.children.update(up.children)
            elif kind == "simpleContent":
                out.content = self.simple(base)
            if kind == "simpleContent" and not extends and out.content is not None:
                out.content = self._restrict(out.content, body, out.content.name)
        self._particles(body, out, None, 1, 1)
        self._attributes(body, out)

    def _attributes(self, node: ET.Element, out: Complex) -> None:
        for a in node:
            kind = a.tag.removeprefix(XS)
            if kind == "attribute":
                namespace = None
                own = a
                if a.get("ref"):
                    own = self.roots["attribute"].get(local(a.get("ref")), a)
                    namespace = a.get("ref").rpartition(":")[0] or None
                name = own.get("name") or local(a.get("ref"))
                if a.get("use") == "prohibited":
                    out.attributes.pop(name, None)
                    continue
                inner = own.find(f"{XS}simpleType")
                kind_of = self._read_simple(inner, name) if inner is not None else self.simple(own.get("type") or "string")
                fixed = a.get("fixed") or own.get("fixed")
                out.attributes[f"{namespace}:{name}" if namespace else name] = Attribute(name, kind_of, a.get("use") == "required", a.get("default") or own.get("default"), fixed, namespace)
            elif kind == "attributeGroup":
                group = self.roots["attributeGroup"].get(local(a.get("ref", "")))
                if group is not None:
                    self._attributes(group, out)
            elif kind == "anyAttribute":
                out.any_attribute = True

    def _particles(self, node: ET.Element, out: Complex, choice: int | None, least: int, most: int | None) -> None:
        for p in node:
            kind = p.tag.removeprefix(XS)
            low = int(p.get("minOccurs", "1")) * least
            top = p.get("maxOccurs", "1")
            high = None if top == "unbounded" or most is None else int(top) * most
            if kind == "element":
                e = self._element(p, out.name)
                new = replace(e, least=0 if choice is not None else low, most=high, choice=choice)
                old = out.children.get(e.name)
                out.children[e.name] = replace(new, most=None) if old else new  # a name in two places may come twice
            elif kind in ("sequence", "all"):
                self._particles(p, out, choice, low, high)
            elif kind == "choice":
                self._choices += 1
                options = [x for x in p if x.tag != f"{XS}annotation"]
                if high is None or high > 1:
                    out.repeating_choice, out.choice_required = True, low > 0
                self._particles(p, out, self._choices if len(options) > 1 and high == 1 else choice if len(options) == 1 else 0, 0 if len(options) > 1 else low, high)
            elif kind == "group":
                self._particles(self.roots["group"][local(p.get("ref"))], out, choice, low, high)
            elif kind == "any":
                out.any_element = True

    def _element(self, node: ET.Element, owner: str) -> Element:
        own = self.roots["element"].get(local(node.get("ref")), node) if node.get("ref") else node
        name = own.get("name") or local(node.get("ref"))
        kind: str | Simple
        if (inner := own.find(f"{XS}complexType")) is not None:
            kind = f"{owner}.{name}"
            if kind not in self.types:
                made = self.types[kind] = Complex(kind)
                self.roots["complexType"].setdefault(kind, inner)
                self._read_complex(inner, made)
        elif (inner := own.find(f"{XS}simpleType")) is not None:
            kind = self._read_simple(inner, name)
        else:
            named = local(own.get("type") or "string")
            if named in self.roots["complexType"]:
                kind = named
            else:
                kind = self.simple(named)
        return Element(name, kind, default=own.get("default"), fixed=own.get("fixed"))


def frozen(schema: Schema, root: str) -> Schema:
    """Everything below ``root`` resolved and nothing else kept, so that it is small to send to tasks."""
    todo = [schema.root(root)]
    seen: set[str] = set()
    while todo:
        c = todo.pop()
        if c.name in seen:
            continue
        seen.add(c.name)
        for e in c.children.values():
            t = schema.type_of(e)
            if isinstance(t, Complex):
                todo.append(t)
    out = Schema.__new__(Schema)
    out.roots, out._simple, out._choices, out.target = {}, {}, 0, schema.target
    out.types = {n: schema.types[n] for n in seen}
    return out
