"""JSON reading that keeps numbers as written and has no limit on depth."""

from __future__ import annotations

import json
import re
from typing import Any


class Raw(str):
    """The text of a JSON number, as written."""

    __slots__ = ()


def _refuse(name: str) -> None:
    raise ValueError(f"not JSON: {name}")


_DECODER = json.JSONDecoder(parse_int=Raw, parse_float=Raw, parse_constant=_refuse)
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
_LONE = re.compile("[\ud800-\udfff]")
_WORDS = {"true": True, "false": False, "null": None}


def loads(text: str) -> Any:
    """The value of a JSON text; numbers come as ``Raw``.  Raises ValueError where the text is not JSON."""
    try:
        return _DECODER.decode(text.lstrip("﻿"))
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> Any:
    """The same with an explicit stack of [container, pending key, what may come next]."""
    root: list = []
    stack: list[list] = [[root, None, "value"]]
    at, end = 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not JSON at {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        box, key, state = top = stack[-1]
        if mark in ("}", "]"):
            if (mark == "}") != isinstance(box, dict) or len(stack) == 1 or state not in ("next", "first"):
                raise ValueError(f"not JSON at {at}")
            stack.pop()
            continue
        if mark == ",":
            if state != "next" or len(stack) == 1:
                raise ValueError(f"not JSON at {at}")
            top[2] = "key" if isinstance(box, dict) else "value"
            continue
        if mark == ":":
            if state != "colon":
                raise ValueError(f"not JSON at {at}")
            top[2] = "value"
            continue
        if isinstance(box, dict) and state in ("first", "key"):
            if string is None:
                raise ValueError(f"not JSON at {at}")
            top[1], top[2] = json.loads(string), "colon"
            continue
        if state not in ("value", "first") or (len(stack) == 1 and root):
            raise ValueError(f"not JSON at {at}")
        value: Any = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string else Raw(number) if number else _WORDS[word]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        top[2] = "next"
        if mark:
            stack.append([value, None, "first"])
    if len(stack) != 1 or not root:
        raise ValueError("not JSON: it ends early")
    return root[0]


def scalar_text(value: Any) -> str:
    """A string as it is, null as empty, a number as written, a boolean as JSON text."""
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def storable(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, become U+FFFD."""
    return text if text.isascii() else _LONE.sub("\ufffd", text)
