"""JSONPath: one parser with three dialects, and an evaluator over plain Python trees.

Dialects
  ``classic``   filters in ``[?(...)]``, strict ``===``/``!==``, ``<>``, regular expressions with ``=~``; a negative
                index is an error; date-looking strings are compared as dates
  ``rfc9535``   the standard: typed functions, missing values are 'nothing', negative indexes and steps
  ``extended``  both notations; negative indexes count from the end

The parse result is a list of segments that the native tier binds to a schema and the dynamic tier evaluates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from functools import lru_cache
from typing import Any

from ..functions import patterns

MAX_QUERY, MAX_DEPTH = 4096, 512
DIALECTS = ("classic", "rfc9535", "extended")


class PathError(ValueError):
    """A path that cannot be parsed, or that the dialect forbids."""


class _Nothing:
    def __repr__(self) -> str:
        return "NOTHING"

    def __bool__(self) -> bool:
        return False


NOTHING = _Nothing()


# ---- syntax tree ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Index:
    index: int


@dataclass(frozen=True)
class Slice:
    start: int | None
    stop: int | None
    step: int | None


@dataclass(frozen=True)
class Filter:
    test: Any


@dataclass(frozen=True)
class Segment:
    """Selectors of one step; ``deep`` for the descendant operator ``..``."""

    selectors: tuple
    deep: bool = False


@dataclass(frozen=True)
class Parent:
    """One step up: ``<--``."""


@dataclass(frozen=True)
class Path:
    root: str  # '$' or '@'
    segments: tuple = ()

    @property
    def singular(self) -> bool:
        """Whether the path can match one node at most."""
        return all(isinstance(s, Parent) or (not s.deep and len(s.selectors) == 1 and isinstance(s.selectors[0], Name | Index)) for s in self.segments)

    def __str__(self) -> str:
        return self.root + "".join(render(s) for s in self.segments)


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str


@dataclass(frozen=True)
class Query:
    path: Path


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: Any


def render(segment: Any) -> str:
    if isinstance(segment, Parent):
        return ".<--"
    one = segment.selectors[0]
    if len(segment.selectors) == 1 and isinstance(one, Name) and re.fullmatch(r"[A-Za-z_][\w-]*", one.name):
        return (".." if segment.deep else ".") + one.name
    inner = ",".join(_selector(s) for s in segment.selectors)
    return (".." if segment.deep else "") + f"[{inner}]"


def _selector(s: Any) -> str:
    if isinstance(s, Name):
        return "'" + s.name.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(s, Wild):
        return "*"
    if isinstance(s, Index):
        return str(s.index)
    if isinstance(s, Slice):
        return ":".join("" if x is None else str(x) for x in (s.start, s.stop)) + ("" if s.step is None else f":{s.step}")
    return "?(...)"


# ---- parser ---------------------------------------------------------------------------------------------------
class _Parser:
    def __init__(self, text: str, dialect: str):
        if len(text) > MAX_QUERY:
            raise PathError(f"a path has {MAX_QUERY} characters at most")
        if dialect not in DIALECTS:
            raise PathError(f"unknown dialect {dialect!r}")
        self.s, self.i, self.dialect = text, 0, dialect

    def fail(self, why: str) -> PathError:
        return PathError(f"{why} at {self.i} in {self.s!r}")

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i] in " \t\r\n":
            self.i += 1

    def take(self, what: str) -> bool:
        if self.s.startswith(what, self.i):
            self.i += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise self.fail(f"expected {what!r}")

    def whole(self) -> Path:
        self.space()
        if self.peek() in ("$", "@"):
            path = self.path()
        elif self.dialect == "rfc9535":
            raise self.fail("a path begins with $")
        else:  # a bare property chain is relative to the document
            path = Path("$", tuple(self.segments(first=True)))
        self.space()
        if self.i < len(self.s):
            raise self.fail("unexpected text")
        return path

    def path(self) -> Path:
        root = self.s[self.i]
        self.i += 1
        return Path(root, tuple(self.segments()))

    def segments(self, first: bool = False) -> Iterator[Any]:
        while True:
            mark = self.i
            self.space()
            if self.take(".."):
                if self.peek() == "[":
                    yield Segment(self.bracket(), True)
                elif self.take("*"):
                    yield Segment((Wild(),), True)
                else:
                    yield Segment((Name(self.name()),), True)
            elif self.take("."):
                if self.take("<--"):
                    yield Parent()
                elif self.take("*"):
                    yield Segment((Wild(),))
                elif self.peek() == "[" and self.dialect != "rfc9535":
                    yield Segment(self.bracket())
                else:
                    yield Segment((Name(self.name()),))
            elif self.peek() == "[":
                yield Segment(self.bracket())
            elif first and self.i < len(self.s):
                yield Segment((Wild(),)) if self.take("*") else Segment((Name(self.name()),))
            else:
                self.i = mark
                return
            first = False

    def name(self) -> str:
        pattern = r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*" if self.dialect == "rfc9535" else r"[^\s.\[\]()'\",=!<>&|?:@*~+/]+"
        m = re.compile(pattern).match(self.s, self.i)
        if not m:
            raise self.fail("expected a name")
        self.i = m.end()
        return m[0]

    def string(self) -> str:
        quote = self.s[self.i]
        self.i += 1
        out = []
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == quote:
                return "".join(out)
            if c == "\\":
                e = self.peek()
                self.i += 1
                if e == "u":
                    code = int(self.s[self.i : self.i + 4], 16)
                    self.i += 4
                    if 0xD800 <= code < 0xDC00 and self.take("\\u"):
                        low = int(self.s[self.i : self.i + 4], 16)
                        self.i += 4
                        code = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)
                    out.append(chr(code))
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
            else:
                out.append(c)
        raise self.fail("string without end")

    def integer(self) -> int | None:
        m = re.compile(r"-?\d+").match(self.s, self.i)
        if not m:
            return None
        if self.dialect == "rfc9535" and re.fullmatch(r"-0|-?0\d+", m[0]):
            raise self.fail("not an integer")
        self.i = m.end()
        return int(m[0])

    def bracket(self) -> tuple:
        self.need("[")
        out = []
        while True:
            self.space()
            c = self.peek()
            if c in ("'", '"'):
                out.append(Name(self.string()))
            elif self.take("*"):
                out.append(Wild())
            elif self.take("?"):
                self.space()
                out.append(Filter(self.either()))
            elif c and (c in ":-" or c.isdigit()):
                out.append(self.position())
            elif self.dialect != "rfc9535":
                out.append(Name(self.name()))
            else:
                raise self.fail("expected a selector")
            self.space()
            if self.take("]"):
                return tuple(out)
            self.need(",")

    def position(self) -> Any:
        start = self.integer()
        self.space()
        if not self.take(":"):
            if start is None:
                raise self.fail("expected an index")
            if start < 0 and self.dialect == "classic":
                raise self.fail("a negative index")
            return Index(start)
        self.space()
        stop = self.integer()
        self.space()
        step = None
        if self.take(":"):
            self.space()
            step = self.integer()
        if step == 0 and self.dialect == "classic":
            raise self.fail("a step of zero")
        return Slice(start, stop, step)

    # filters
    def either(self) -> Any:
        items = [self.both()]
        while self.spaced("||"):
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self) -> Any:
        items = [self.unary()]
        while self.spaced("&&"):
            items.append(self.unary())
        return items[0] if len(items) == 1 else And(tuple(items))

    def spaced(self, what: str) -> bool:
        self.space()
        return self.take(what)

    def unary(self) -> Any:
        self.space()
        if self.peek() == "!" and self.peek(2) != "!=":
            self.i += 1
            return Not(self.unary())
        if self.take("("):
            inner = self.either()
            self.space()
            self.need(")")
            return inner
        left = self.operand()
        self.space()
        for op in ("===", "!==", "==", "!=", "<>", "<=", ">=", "=~", "<", ">"):
            if self.take(op):
                if self.dialect == "rfc9535" and op in ("===", "!==", "<>", "=~"):
                    raise self.fail(f"{op} is not in this dialect")
                self.space()
                return Compare("!=" if op == "<>" else op, left, self.operand())
        return left

    def operand(self) -> Any:
        c = self.peek()
        if c in ("@", "$"):
            return Query(self.path())
        if c in ("'", '"'):
            return Lit(self.string())
        if c == "/":
            m = re.compile(r"/((?:[^/\\]|\\.)*)/([a-z]*)").match(self.s, self.i)
            if not m:
                raise self.fail("a regular expression without end")
            self.i = m.end()
            return Regex(m[1].replace("\\/", "/"), m[2])
        m = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?").match(self.s, self.i)
        if m:
            self.i = m.end()
            return Lit(float(m[0]) if m[1] or m[2] else int(m[0]))
        m = re.compile(r"[A-Za-z_]\w*").match(self.s, self.i)
        if not m:
            raise self.fail("expected a value")
        self.i = m.end()
        if m[0] in ("true", "false", "null"):
            return Lit({"true": True, "false": False, "null": None}[m[0]])
        if not self.take("("):
            raise self.fail("expected a value")
        args = []
        self.space()
        while not self.take(")"):
            args.append(self.operand())
            self.space()
            if not self.take(",") and self.peek() != ")":
                raise self.fail("expected , or )")
            self.space()
        if m[0] not in FUNCTIONS:
            raise self.fail(f"unknown function {m[0]}")
        if FUNCTIONS[m[0]].arity not in (None, len(args)):
            raise self.fail(f"{m[0]} takes {FUNCTIONS[m[0]].arity} arguments")
        return Call(m[0], tuple(args))


@lru_cache(maxsize=1024)
def parse(text: str, dialect: str = "classic") -> Path:
    """A path of a dialect; ``xpath`` reads slash paths (for XML documents) and falls back to ``classic``."""
    if dialect == "xpath":
        if text[:1] not in "$@":
            from .xpath import parse as slashes

            return slashes(text)
        dialect = "classic"
    return _Parser(text, dialect).whole()


# ---- evaluation over Python trees -------------------------------------------------------------------------------
@dataclass
class Match:
    """A node in its place: ``value``, the container ``parent`` that holds it under ``key``, and the way from the root."""

    value: Any
    parent: Any = None
    key: Any = None
    up: Match | None = None

    @property
    def path(self) -> str:
        out, m = [], self
        while m.up is not None:
            out.append(f"[{m.key}]" if isinstance(m.key, int) else render(Segment((Name(m.key),))))
            m = m.up
        return "$" + "".join(reversed(out))


@dataclass
class Function:
    run: Callable
    arity: int | None = None
    nodes: bool = False  # whether arguments are lists of matched values


FUNCTIONS: dict[str, Function] = {}


def register(name: str, run: Callable, arity: int | None = None, nodes: bool = False) -> None:
    """Add a function for filters; with ``nodes`` it gets the matched values of its path arguments as lists."""
    FUNCTIONS[name] = Function(run, arity, nodes)
    parse.cache_clear()


def iregexp(pattern: str) -> str:
    """An I-Regexp (RFC 9485) as a Python pattern: the dot does not match line ends, \\p classes are mapped."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            m = re.compile(r"\\([pP])\{([A-Z][a-z]?)\}").match(pattern, i)
            if m:
                out.append(_CATEGORY.get(m[2], ("\\w", "\\W"))[m[1] == "P"])
                i = m.end()
                continue
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append("[^\n\r]" if c == "." and not inside else c)
        i += 1
    return "".join(out)


_CATEGORY = {"L": (r"[^\W\d_]", r"[\W\d_]"), "Lu": ("[A-Z\u00c0-\u00de]", "[^A-Z\u00c0-\u00de]"), "Ll": ("[a-z\u00df-\u00ff]", "[^a-z\u00df-\u00ff]"), "N": (r"\d", r"\D"), "Nd": (r"\d", r"\D"), "Z": (r"\s", r"\S"), "P": (r"[!-/:-@\[-`{-~]", r"[^!-/:-@\[-`{-~]")}


def _regex_test(value: Any, pattern: Any, full: bool) -> bool:
    if not isinstance(value, str) or not isinstance(pattern, str):
        return False
    try:
        return bool(patterns.apply("fullmatch" if full else "search", iregexp(pattern), value))
    except (re.error, patterns.PatternError):
        return False


register("length", lambda v: len(v) if isinstance(v, str | list | dict) else NOTHING, 1)
register("count", lambda nodes: len(nodes), 1, nodes=True)
register("match", lambda v, p: _regex_test(v, p, True), 2)
register("search", lambda v, p: _regex_test(v, p, False), 2)
register("value", lambda nodes: nodes[0] if len(nodes) == 1 else NOTHING, 1, nodes=True)


def _children(m: Match) -> Iterator[Match]:
    if isinstance(m.value, dict):
        for k, v in list(m.value.items()):
            yield Match(v, m.value, k, m)
    elif isinstance(m.value, list):
        for i, v in enumerate(list(m.value)):
            yield Match(v, m.value, i, m)


def _descend(m: Match, depth: int = 0) -> Iterator[Match]:
    if depth > MAX_DEPTH:
        raise PathError("the document is nested too deeply")
    yield m
    for c in _children(m):
        yield from _descend(c, depth + 1)


def _pick(m: Match, s: Any, dialect: str, root: Match) -> Iterator[Match]:
    v = m.value
    if isinstance(s, Name):
        if isinstance(v, dict) and s.name in v:
            yield Match(v[s.name], v, s.name, m)
    elif isinstance(s, Wild):
        yield from _children(m)
    elif isinstance(s, Index):
        if isinstance(v, list):
            i = s.index + len(v) if s.index < 0 else s.index
            if 0 <= i < len(v):
                yield Match(v[i], v, i, m)
    elif isinstance(s, Slice):
        if isinstance(v, list) and s.step != 0:
            for i in range(*slice(s.start, s.stop, s.step).indices(len(v))):
                yield Match(v[i], v, i, m)
    else:
        for c in _children(m):
            if test(s.test, c, root, dialect):
                yield c


def select(path: Path, root: Any, current: Match | None = None, dialect: str = "classic") -> list[Match]:
    """All matches in document order; ``current`` is what ``@`` stands for."""
    base = root if isinstance(root, Match) else Match(root)
    found = [current if path.root == "@" and current is not None else base]
    for seg in path.segments:
        if isinstance(seg, Parent):
            ups, seen = [], set()
            for m in found:
                if m.up is not None and id(m.up.value) not in seen:
                    seen.add(id(m.up.value))
                    ups.append(m.up)
            found = ups
            continue
        out: list[Match] = []
        for m in found:
            for node in _descend(m) if seg.deep else (m,):
                for s in seg.selectors:
                    out.extend(_pick(node, s, dialect, base))
        found = out
    return found


def _value(x: Any, m: Match, root: Match, dialect: str) -> Any:
    if isinstance(x, Lit):
        return x.value
    if isinstance(x, Query):
        got = select(x.path, root, m, dialect)
        return got[0].value if len(got) == 1 or (got and dialect != "rfc9535") else NOTHING
    if isinstance(x, Call):
        f = FUNCTIONS[x.name]
        args = []
        for a in x.args:
            if f.nodes and isinstance(a, Query):
                args.append([n.value for n in select(a.path, root, m, dialect)])
            else:
                args.append(_value(a, m, root, dialect))
        return f.run(*args)
    return x


def test(x: Any, m: Match, root: Match, dialect: str) -> bool:
    if isinstance(x, And):
        return all(test(i, m, root, dialect) for i in x.items)
    if isinstance(x, Or):
        return any(test(i, m, root, dialect) for i in x.items)
    if isinstance(x, Not):
        return not test(x.item, m, root, dialect)
    if isinstance(x, Query):
        return bool(select(x.path, root, m, dialect))
    if isinstance(x, Call):
        got = _value(x, m, root, dialect)
        return got is not NOTHING and bool(got)
    if isinstance(x, Lit):
        return bool(x.value)
    if x.op == "=~":
        v, r = _value(x.left, m, root, dialect), x.right
        if not isinstance(v, str):
            return False
        pattern, flags = (r.pattern, r.flags) if isinstance(r, Regex) else (str(_value(r, m, root, dialect)), "")
        try:
            return bool(patterns.apply("search", pattern, v, flags=flags))
        except patterns.PatternError as e:
            raise PathError(str(e)) from None
    left, right = x.left, x.right
    if dialect != "rfc9535":  # any pair of matched values may satisfy the comparison
        lefts = [n.value for n in select(left.path, root, m, dialect)] if isinstance(left, Query) else [_value(left, m, root, dialect)]
        rights = [n.value for n in select(right.path, root, m, dialect)] if isinstance(right, Query) else [_value(right, m, root, dialect)]
        return any(_classic(x.op, a, b) for a in lefts for b in rights)
    return _standard(x.op, _value(left, m, root, dialect), _value(right, m, root, dialect))


def _number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _same(a: Any, b: Any) -> bool:
    if _number(a) and _number(b):
        return a == b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and a == b


def _standard(op: str, a: Any, b: Any) -> bool:
    equal = a is b if a is NOTHING or b is NOTHING else _same(a, b)
    if op in ("==", "!="):
        return equal == (op == "==")
    if _number(a) and _number(b) or isinstance(a, str) and isinstance(b, str):
        less = a < b
        return {"<": less, "<=": less or equal, ">": not less and not equal, ">=": not less}[op]
    return op in ("<=", ">=") and equal


_DATE = re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$")


def _date(v: Any) -> datetime | None:
    if isinstance(v, str) and _DATE.match(v):
        try:
            return datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
        except ValueError:
            return None
    return None


def _classic(op: str, a: Any, b: Any) -> bool:
    if op in ("===", "!=="):
        same = _same(a, b) and (_number(a) == _number(b))
        return same == (op == "===")
    if (x := _date(a)) and (y := _date(b)):
        a, b = x, y
    elif _number(a) != _number(b) and isinstance(a if isinstance(a, str) else b, str) and not isinstance(a, dict | list) and not isinstance(b, dict | list):
        a, b = _text(a), _text(b)  # a string meets another kind: compare as text
    if op in ("==", "!="):
        equal = a == b if isinstance(a, datetime) else _same(a, b)
        return equal == (op == "==")
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or isinstance(a, dict | list) or isinstance(b, dict | list):
        return False
    try:
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    except TypeError:
        return False


def _text(v: Any) -> Any:
    return v if v is None else "true" if v is True else "false" if v is False else str(v)


@dataclass
class Options:
    dialect: str = "classic"
    error_when_no_match: bool = False
    functions: dict = field(default_factory=dict)


def query(text: str, root: Any, options: Options | None = None) -> list[Match]:
    """Parse and evaluate; the entry point for callers outside the engine."""
    options = options or Options()
    for name, run in options.functions.items():
        if name not in FUNCTIONS:
            register(name, run)
    found = select(parse(text, options.dialect), root, None, options.dialect)
    if options.error_when_no_match and not found:
        raise PathError(f"no match for {text}")
    return found
