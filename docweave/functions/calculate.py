"""``calculate``: arithmetic, comparison and logic over literals, read by a small parser of its own."""

from __future__ import annotations

import math
import re
from typing import Any

from .coerce import Failure, tidy

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|'((?:[^']|'')*)'|([A-Za-z]+)|(<=|>=|<>|[-+*/%()=<>,]))")


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Failure(f"cannot calculate {text!r}")
            self.tokens.append(("number", float(m[1]) if not m[1].isdigit() else int(m[1])) if m[1] else ("text", m[2].replace("''", "'")) if m[2] is not None else ("word", m[3].lower()) if m[3] else ("op", m[4]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.i = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", None)

    def take(self, *what: tuple[str, Any]) -> Any:
        t = self.peek()
        if t in what:
            self.i += 1
            return t[1]
        return None

    def chain(self, below, ops: list, apply) -> Any:
        left = below()
        while (op := self.take(*ops)) is not None:
            left = apply(op, left, below())
        return left

    def whole(self) -> Any:
        v = self.either()
        if self.peek()[0] != "end":
            raise Failure("cannot calculate: text is left over")
        return v

    def either(self) -> Any:
        return self.chain(self.both, [("word", "or")], lambda _, a, b: bool(a) or bool(b))

    def both(self) -> Any:
        return self.chain(self.negated, [("word", "and")], lambda _, a, b: bool(a) and bool(b))

    def negated(self) -> Any:
        return not self.negated() if self.take(("word", "not")) else self.compared()

    def compared(self) -> Any:
        def apply(op, a, b):
            try:
                return {"=": a == b, "<>": a != b}[op] if op in ("=", "<>") else {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
            except TypeError:
                raise Failure("cannot compare text and numbers") from None

        return self.chain(self.added, [("op", o) for o in ("=", "<>", "<", ">", "<=", ">=")], apply)

    def added(self) -> Any:
        return self.chain(self.times, [("op", "+"), ("op", "-")], lambda op, a, b: self.plus(op, a, b))

    @staticmethod
    def plus(op: str, a: Any, b: Any) -> Any:
        if op == "+" and (isinstance(a, str) or isinstance(b, str)):
            return str(a) + str(b)
        if isinstance(a, str) or isinstance(b, str):
            raise Failure("text cannot be subtracted")
        return a + b if op == "+" else a - b

    def times(self) -> Any:
        def apply(op, a, b):
            if isinstance(a, str) or isinstance(b, str):
                raise Failure("text has no product")
            if op == "*":
                return a * b
            if op == "%":
                if not b:
                    raise Failure("division by zero")
                return math.fmod(a, b)
            if b:
                return a / b
            return math.nan if not a else math.copysign(math.inf, a)

        return self.chain(self.signed, [("op", "*"), ("op", "/"), ("op", "%")], apply)

    def signed(self) -> Any:
        if self.take(("op", "-")):
            v = self.signed()
            if isinstance(v, str):
                raise Failure("text has no sign")
            return -v
        if self.take(("op", "+")):
            return self.signed()
        return self.atom()

    def atom(self) -> Any:
        kind, v = self.peek()
        self.i += 1
        if kind in ("number", "text"):
            return v
        if kind == "word" and v in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v]
        if kind == "word" and v == "iif" and self.take(("op", "(")):
            c = self.either()
            self.need(",")
            a = self.either()
            self.need(",")
            b = self.either()
            self.need(")")
            return a if c else b
        if (kind, v) == ("op", "("):
            inner = self.either()
            self.need(")")
            return inner
        raise Failure("cannot calculate")

    def need(self, op: str) -> None:
        if self.take(("op", op)) is None:
            raise Failure(f"expected {op}")


def calculate(text: str) -> Any:
    """The value; a result that is not finite is its name as text, for lack of a JSON number."""
    if not text.strip():
        raise Failure("nothing to calculate")
    v = _Reader(text).whole()
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    return tidy(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else v
