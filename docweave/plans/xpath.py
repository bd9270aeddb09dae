"""Slash paths over XML trees, as the same path syntax tree.

``/root/a/b[2]/@id``, ``//name``, ``a/*``, ``./x``, ``..``, ``[@id='1']``, ``[n='x']``, ``[n>3]``, ``text()``.  The first
step of an absolute path names the root element, which the tree does not hold; positions count from 1; the children
``item`` of a wrapper are the elements of its array.
"""

from __future__ import annotations

import re
from typing import Any

from .jsonpath import And, Compare, Filter, Index, Lit, Name, Or, Parent, Path, PathError, Query, Segment, Wild

_STEP = re.compile(r"(\.\.|\.|@?[A-Za-z_][\w.:-]*|@?\*|text\(\))((?:\[[^\]]*\])*)")
_TEST = re.compile(r"\s*(?:(@?[A-Za-z_][\w.:/@-]*|\.|text\(\))\s*(?:(=|!=|<=|>=|<|>)\s*('[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?))?|(\d+)|last\(\))\s*$")


def parse(text: str, item: str = "item", attribute: str = "@") -> Path:
    """A slash path as a :class:`Path`."""
    rest, root = text.strip(), "$"
    segments: list[Any] = []
    absolute = rest.startswith("/")
    first = absolute and not rest.startswith("//")
    if not absolute:
        root = "@"
        rest = "/" + rest
    while rest:
        deep = rest.startswith("//")
        if not rest.startswith("/"):
            raise PathError(f"expected / in {text!r}")
        rest = rest[2 if deep else 1 :]
        m = _STEP.match(rest)
        if not m:
            if not rest and not segments:  # the root itself
                break
            raise PathError(f"expected a step in {text!r}")
        rest = rest[m.end() :]
        name, tests = m[1], re.findall(r"\[([^\]]*)\]", m[2])
        if first and not deep:
            first = False
            continue
        if name == "..":
            segments.append(Parent())
            continue
        if name == ".":
            continue
        if name == "text()":
            segments.append(Segment((Name("#text"),), deep))
            continue
        if name == item and not deep:
            if tests and tests[0].strip().isdigit():
                segments.append(Segment((Index(int(tests.pop(0)) - 1),)))
            else:
                segments.append(Segment((Wild(),)))
        else:
            segments.append(Segment((Wild() if name.endswith("*") else Name(attribute + name[1:] if name[0] == "@" else name),), deep))
        for t in tests:
            segments.append(_filter(t, item, attribute, text))
    return Path(root, tuple(segments))


def _filter(test: str, item: str, attribute: str, text: str) -> Segment:
    if test.strip().isdigit():
        return Segment((Index(int(test) - 1),))
    if test.strip() == "last()":
        return Segment((Index(-1),))
    parts = [_both(p, item, attribute, text) for p in re.split(r"\s+or\s+", test)]
    return Segment((Filter(parts[0] if len(parts) == 1 else Or(tuple(parts))),))


def _both(test: str, item: str, attribute: str, text: str) -> Any:
    parts = []
    for p in re.split(r"\s+and\s+", test):
        m = _TEST.match(p)
        if not m or not m[1]:
            raise PathError(f"cannot read [{test}] in {text!r}")
        way = parse("." if m[1] == "." else "./" + m[1], item, attribute)
        if not m[2]:
            parts.append(Query(way))
            continue
        raw = m[3]
        value = raw[1:-1] if raw[0] in "'\"" else float(raw) if "." in raw else int(raw)
        parts.append(Compare({"=": "=="}.get(m[2], m[2]), Query(way), Lit(value)))
    return parts[0] if len(parts) == 1 else And(tuple(parts))
