"""The selector language of manifest patches: absolute from /MPD, child steps, at most one predicate a step."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

_NAME = r"[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?"
_STEP = re.compile(rf"/({_NAME})(?:\[\s*(?:([1-9][0-9]*)|@({_NAME})\s*=\s*(?:\"([^\"]*)\"|'([^']*)'))\s*\])?(?=/|$)")
_ATTRIBUTE = re.compile(rf"/@({_NAME})$")


class Step(NamedTuple):
    name: str
    position: int | None = None
    attribute: str | None = None
    value: str | None = None


class Selector(NamedTuple):
    steps: tuple[Step, ...]
    attribute: str | None


@lru_cache(maxsize=65536)
def parse_selector(text: str | None) -> Selector | None:
    """The steps below /MPD and the last attribute step; None for a selector outside the language."""
    if not text:
        return None
    at, steps, attribute = 0, [], None
    while at < len(text):
        m = _STEP.match(text, at)
        if m:
            name, position, attr, double, single = m.groups()
            steps.append(Step(name, int(position) if position else None, attr, double if double is not None else single))
            at = m.end()
            continue
        m = _ATTRIBUTE.match(text, at)
        if not m or not steps:
            return None
        attribute, at = m.group(1), m.end()
    if not steps or steps[0].name != "MPD":
        return None
    return Selector(tuple(steps[1:]), attribute)
