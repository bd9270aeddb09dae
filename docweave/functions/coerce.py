"""Coercions that decide results, shared by all functions of the dynamic tier."""

from __future__ import annotations

import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from typing import Any


class Failure(Exception):
    """A function that cannot answer: the command that asked writes nothing and the script stops."""


_NUMERIC = re.compile(r"\s*[+-]?(\d[\d,]*)?(\.\d*)?([eE][+-]?\d+)?\s*$")


def number(v: Any) -> float | None:
    """A number, a boolean (1 or 0) or numeric text, in which commas are thousands separators; else None."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, int | float):
        return float(v)
    if isinstance(v, str) and _NUMERIC.match(v) and any(c.isdigit() for c in v):
        try:
            return float(v.replace(",", ""))
        except ValueError:
            return None
    return None


def tidy(x: float) -> int | float:
    """Integral results are integers."""
    return int(x) if isinstance(x, float) and math.isfinite(x) and x == math.floor(x) and abs(x) < 2**63 else x


def half_away(x: float, digits: int = 0) -> float:
    """Round half away from zero on the shortest decimal text of the double."""
    if not math.isfinite(x):
        return x
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return repr(int(v)) if v == math.floor(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, int):
        return str(v)
    return compact(v)


def compact(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def truthy(v: Any) -> bool:
    return v is True or (isinstance(v, str) and v.lower() == "true")


def deep_equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    return type(a) is type(b) and a == b


def loose_equal(a: Any, b: Any) -> bool:
    """null = null; containers deeply; numbers by value (text ``7`` is 7); then booleans; then text."""
    if a is None or b is None:
        return a is b
    if isinstance(a, dict | list) or isinstance(b, dict | list):
        return deep_equal(a, b)
    if not isinstance(a, bool) and not isinstance(b, bool):
        x, y = number(a), number(b)
        if x is not None and y is not None:
            return x == y
    if isinstance(a, bool) or isinstance(b, bool):
        return text(a).lower() == text(b).lower()
    return text(a) == text(b)


def order(a: Any, b: Any) -> int | None:
    """-1, 0 or 1; None where null or a container makes it incomparable."""
    if a is None or b is None or isinstance(a, dict | list) or isinstance(b, dict | list):
        return None
    x, y = number(a), number(b)
    if x is None or y is None:
        x, y = text(a), text(b)
    return (x > y) - (x < y)


def flat(values: list) -> list:
    out: list = []
    for v in values:
        out.extend(flat(v)) if isinstance(v, list) else out.append(v)
    return out


class Criteria:
    """Spreadsheet criteria: an operator, wildcards ``* ?`` (``~`` escapes), case-insensitive text."""

    def __init__(self, raw: Any):
        s = text(raw).strip() if not isinstance(raw, str) else raw.strip()
        m = re.match(r"(>=|<=|<>|!=|>|<|=)?(.*)$", s, re.S)
        self.op = {"<>": "!=", None: "="}.get(m[1], m[1])
        self.operand = m[2].strip()
        self.empty = not s
        self.value = number(self.operand)
        self.pattern = None
        if self.op in ("=", "!=") and re.search(r"[*?]", self.operand):
            self.pattern = re.compile(self.regex() + r"\Z", re.I | re.S)

    def regex(self) -> str:
        out, i = [], 0
        while i < len(self.operand):
            c = self.operand[i]
            if c == "~" and self.operand[i + 1 : i + 2] in ("*", "?", "~") and i + 1 < len(self.operand):
                i += 1
                out.append(re.escape(self.operand[i]))
            else:
                out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
            i += 1
        return "".join(out)

    def test(self, v: Any) -> bool:
        if self.empty:
            return False
        if self.pattern is not None:
            return bool(self.pattern.match(text(v))) == (self.op == "=")
        x = number(v)
        if x is not None and self.value is not None:
            a, b = x, self.value
        else:
            a, b = text(v).lower(), self.operand.replace("~", "").lower() if "~" in self.operand else self.operand.lower()
        return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[self.op]
