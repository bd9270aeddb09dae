"""Shaping documents by a JSON Schema that is read as data: order, filter, skeleton.  Nothing is validated."""

from __future__ import annotations

import copy
from typing import Any

MAX_DEPTH = 32


class Reader:
    """Local ``$ref`` and the branches of allOf, anyOf, oneOf, then and else."""

    def __init__(self, root: Any):
        self.root = root

    def follow(self, s: Any, seen: frozenset = frozenset()) -> dict:
        while isinstance(s, dict) and isinstance(s.get("$ref"), str):
            ref = s["$ref"]
            if ref in seen or not ref.startswith("#"):
                return {}
            seen |= {ref}
            s = self.root
            for part in ref[1:].split("/")[1:]:
                part = part.replace("~1", "/").replace("~0", "~")
                s = s.get(part) if isinstance(s, dict) else None
        return s if isinstance(s, dict) else {}

    def branches(self, s: Any, data: Any, choose: bool, depth: int = 0) -> list[dict]:
        """The schema and all that may apply with it; with ``choose`` only branches whose tags fit the data."""
        s = self.follow(s)
        if depth > MAX_DEPTH:
            return [s]
        out = [s]
        for part in s.get("allOf") or []:
            out += self.branches(part, data, choose, depth + 1)
        for word in ("oneOf", "anyOf"):
            options = [o for o in s.get(word) or []]
            fitting = [o for o in options if self.fits(o, data)] if choose else []
            for o in fitting if len(fitting) == 1 else options:
                out += self.branches(o, data, choose, depth + 1)
        for word in ("then", "else"):
            if word in s:
                out += self.branches(s[word], data, choose, depth + 1)
        return out

    def fits(self, s: Any, data: Any) -> bool:
        """Whether all const and enum tags of the branch equal the data's, at least one being there."""
        tags = 0
        for part in self.branches(s, data, False):
            for name, p in (part.get("properties") or {}).items():
                p = self.follow(p)
                allowed = [p["const"]] if "const" in p else p.get("enum")
                if allowed is not None:
                    tags += 1
                    if not isinstance(data, dict) or data.get(name) not in allowed:
                        return False
        return tags > 0

    def view(self, s: Any, data: Any, choose: bool) -> tuple[dict[str, list], list, bool | None]:
        """Declared properties (name -> schemas), item schemas, and additionalProperties."""
        props: dict[str, list] = {}
        items: list = []
        extra = None
        for part in self.branches(s, data, choose):
            for name, p in (part.get("properties") or {}).items():
                props.setdefault(name, []).append(p)
            if isinstance(part.get("items"), dict):
                items.append(part["items"])
            items += [i for i in part.get("prefixItems") or [] if isinstance(i, dict)]
            extra = part.get("additionalProperties", extra)
        return props, items, extra


def _joined(parts: list) -> Any:
    return parts[0] if len(parts) == 1 else {"allOf": parts}


def order(shape: Any, data: Any, choose: bool = False, reader: Reader | None = None, depth: int = 0) -> Any:
    """Declared properties first, in the schema's order; the others behind, in their own."""
    reader = reader or Reader(shape)
    if depth > 128:
        return data
    props, items, _ = reader.view(shape, data, choose)
    if isinstance(data, dict) and props:
        first = {k: order(_joined(p), data[k], choose, reader, depth + 1) for k, p in props.items() if k in data}
        return first | {k: v for k, v in data.items() if k not in first}
    if isinstance(data, list) and items:
        return [order(_joined(items), v, choose, reader, depth + 1) for v in data]
    return data


def filter_(shape: Any, data: Any, keep_additional: bool = False, choose: bool = False, reader: Reader | None = None, depth: int = 0) -> Any:
    """Drops what the schema does not declare; a schema that says nothing about structure keeps a value whole."""
    reader = reader or Reader(shape)
    if depth > 128:
        return data
    props, items, extra = reader.view(shape, data, choose)
    if isinstance(data, dict) and props:
        out = {}
        for k, v in data.items():
            if k in props:
                out[k] = filter_(_joined(props[k]), v, keep_additional, choose, reader, depth + 1)
            elif keep_additional and extra is not False:
                out[k] = v
        return out
    if isinstance(data, list) and items:
        return [filter_(_joined(items), v, keep_additional, choose, reader, depth + 1) for v in data]
    return data


def skeleton(shape: Any, reader: Reader | None = None, depth: int = 0, seen: frozenset = frozenset()) -> Any:
    """The empty document of a schema: default, then const, then {} or [] or null; cycles end in null."""
    reader = reader or Reader(shape)
    ref = shape.get("$ref") if isinstance(shape, dict) else None
    if depth > MAX_DEPTH or (ref and ref in seen):
        return None
    seen = seen | {ref} if ref else seen
    parts = reader.branches(shape, None, False)
    for word in ("default", "const"):
        for p in parts:
            if word in p:
                return copy.deepcopy(p[word])
    props, _, _ = reader.view(shape, None, False)
    kinds = [p.get("type") for p in parts if p.get("type")]
    if props or "object" in kinds:
        return {k: skeleton(_joined(p), reader, depth + 1, seen) for k, p in props.items()}
    return [] if "array" in kinds or any("items" in p for p in parts) else None
