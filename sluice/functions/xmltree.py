"""XML read into a small tree with namespaces kept, and the reverse."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

DASH = "urn:mpeg:dash:schema:mpd:2011"  # fixed value: the namespace of manifests
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"


class BadXml(ValueError):
    """The text is not well-formed, or has a document type."""


@dataclass
class Node:
    """An element.  ``attrs`` has names as written; ``scope`` the bindings in force here (prefix, '' for the default)."""

    name: str
    attrs: dict[str, str]
    scope: dict[str, str]
    declared: dict[str, str]
    children: list["Node"] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    @property
    def prefix(self) -> str:
        return self.name.rpartition(":")[0]

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    @property
    def uri(self) -> str | None:
        return self.scope.get(self.prefix)

    @property
    def text(self) -> str:
        return "".join(self.texts).strip(" \t\r\n")

    def plain_attrs(self) -> list[tuple[str, str, str | None, str]]:
        """``prefix, local, uri, value`` of all attributes that are neither declarations nor of the instance namespace."""
        out = []
        for k, v in self.attrs.items():
            p, _, local = k.rpartition(":")
            if k == "xmlns" or p == "xmlns":
                continue
            uri = XML if p == "xml" else self.scope.get(p) if p else None
            if uri != XSI:
                out.append((p, local, uri, v))
        return out


def parse(xml: str | bytes) -> Node:
    """The root; raises BadXml.  A document type is refused, so no entity can expand; text is kept where it stands."""
    stack: list[Node] = []
    root: list[Node] = []

    def start(name: str, attrs: dict[str, str]) -> None:
        declared = {k[6:] if k != "xmlns" else "": v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}
        above = stack[-1].scope if stack else {}
        node = Node(name, attrs, {**above, **declared} if declared else above, declared)
        if node.prefix and node.prefix not in node.scope:
            raise BadXml(f"prefix {node.prefix} is not bound")
        (stack[-1].children if stack else root).append(node)
        stack.append(node)

    def refuse(*_: object) -> None:
        raise BadXml("a document type is not accepted")

    parser = expat.ParserCreate("utf-8" if isinstance(xml, str) else None)
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda t: stack[-1].texts.append(t)
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass") if isinstance(xml, str) else xml, True)
    except (expat.ExpatError, UnicodeEncodeError) as e:
        raise BadXml(str(e)) from None
    return root[0]


@dataclass
class Out:
    """An element to be written."""

    name: str
    attrs: list[tuple[str, str]] = field(default_factory=list)
    children: list["Out"] = field(default_factory=list)
    text: str | None = None


def write(root: Out, declaration: bool = True, indent: str | None = "  ") -> str:
    """The XML text; an element without content closes itself.  ``indent=None`` writes one line."""
    parts = ['<?xml version="1.0" encoding="UTF-8"?>'] if declaration else []
    todo: list[tuple[Out | str, int]] = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        space = (indent or "") * depth
        if isinstance(node, str):
            parts.append(space + node)
            continue
        head = "".join(f" {k}={quoteattr(v, {chr(10): '&#10;', chr(13): '&#13;', chr(9): '&#9;'})}" for k, v in node.attrs)
        text = escape(node.text, {"\r": "&#13;"}) if node.text else ""
        if not node.children:
            parts.append(f"{space}<{node.name}{head}>{text}</{node.name}>" if text else f"{space}<{node.name}{head}/>")
            continue
        parts.append(f"{space}<{node.name}{head}>" + text)
        todo.append((f"</{node.name}>", depth))
        todo.extend((c, depth + 1) for c in reversed(node.children))
    return ("\n" if indent is not None else "").join(parts)
