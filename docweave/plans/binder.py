"""Binding: paths and values against a schema, to columns.

A scope says what ``$`` and ``@`` are.  In row mode ``$`` is the table (``$[*].x`` ranges over rows, for aggregates
only) and ``@`` the row; in document mode both are the row.  Everything is decided from the schema, so pruning and
pushdown see plain column references.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import count
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, native
from ..functions.coerce import Failure
from ..functions.native import Unsupported, Val, kind_of
from . import jsonpath as jp
from . import values


_NUMBER = count()


@dataclass(frozen=True)
class Scope:
    schema: T.StructType
    rows: bool = True  # whether $ is the table
    current: Val | None = None  # what @ is, if not the row
    aggregates: dict | None = None  # collects aggregates over rows: name -> column
    dialect: str = "classic"

    def at(self, current: Val) -> Scope:
        return replace(self, current=current)


def missing() -> Val:
    return Val(F.lit(None), "null", F.lit(False))


def field(scope: Scope, name: str) -> Val:
    if name not in scope.schema.names:
        return missing()
    return native.column(name, scope.schema[name].dataType)


def _element(v: Val) -> T.DataType:
    return v.dtype.elementType


def step(v: Val, segment: Any, scope: Scope) -> Val:
    """One segment below a value."""
    if isinstance(segment, jp.Parent):
        raise Unsupported("the parent step")
    if v.lit is None and v.literal or (v.kind == "null" and v.dtype is None):
        return missing()
    if segment.deep:
        return _deep(v, segment, scope)
    if len(segment.selectors) > 1:
        parts = [step(v, jp.Segment((s,)), scope) for s in segment.selectors]
        parts = [p for p in parts if not (p.kind == "null" and p.dtype is None)]
        return _gather([p if p.many else Val(F.array(p.col), "array", None, many=True, dtype=T.ArrayType(p.dtype)) for p in parts], drop_null=True)
    s = segment.selectors[0]
    if v.many:
        t = _element(v)
        inner = lambda x: step(Val(x, kind_of(t), dtype=t), segment, scope)
        probe = inner(F.lit(None).cast(t))
        if probe.kind == "null" and probe.dtype is None:
            return missing()
        if probe.many:
            return Val(F.flatten(F.transform(v.col, lambda x: inner(x).col)), "array", v.ok, many=True, dtype=probe.dtype)
        out = F.transform(v.col, lambda x: inner(x).col)
        if isinstance(s, jp.Index):
            out = F.filter(out, lambda x: x.isNotNull())
        return Val(out, "array", v.ok, many=True, dtype=T.ArrayType(probe.dtype))
    if isinstance(s, jp.Name):
        if isinstance(v.dtype, T.StructType):
            if s.name not in v.dtype.names:
                return missing()
            t = v.dtype[s.name].dataType
            return Val(v.col.getField(s.name), kind_of(t), v.ok, dtype=t)
        if isinstance(v.dtype, T.MapType):
            got = F.try_element_at(v.col, F.lit(s.name))
            return Val(got, kind_of(v.dtype.valueType), native.both(v.ok, F.coalesce(F.map_contains_key(v.col, s.name), F.lit(False))), dtype=v.dtype.valueType)
        return missing()
    if isinstance(v.dtype, T.StructType) and isinstance(s, jp.Wild):
        return _gather([Val(F.array(v.col.getField(f.name)), "array", v.ok, many=True, dtype=T.ArrayType(f.dataType)) for f in v.dtype])
    if not isinstance(v.dtype, T.ArrayType):
        return missing()
    t = v.dtype.elementType
    if isinstance(s, jp.Index):
        if s.index < 0:
            got, there = F.try_element_at(v.col, F.lit(s.index)), F.size(v.col) >= -s.index
        else:
            got, there = F.get(v.col, F.lit(s.index)), F.size(v.col) > s.index
        return Val(got, kind_of(t), native.both(v.ok, F.coalesce(there, F.lit(False))), dtype=t)
    if isinstance(s, jp.Wild):
        return Val(v.col, "array", native.both(v.ok, F.coalesce(F.size(v.col) > 0, F.lit(False))), many=True, dtype=v.dtype)
    if isinstance(s, jp.Slice):
        return Val(_slice(v.col, s), "array", v.ok, many=True, dtype=v.dtype)
    kept = F.filter(v.col, lambda x: predicate(s.test, scope.at(Val(x, kind_of(t), dtype=t))))
    return Val(kept, "array", native.both(v.ok, F.coalesce(F.size(kept) > 0, F.lit(False))), many=True, dtype=v.dtype)


def _slice(arr: Column, s: jp.Slice) -> Column:
    k, n = s.step or 1, F.size(arr)
    edge = lambda x, low: F.greatest(n + x, F.lit(0)) if x < 0 else F.least(F.lit(x), n) if low else F.least(F.lit(x), n)
    if k > 0:
        a = edge(s.start, True) if s.start is not None else F.lit(0)
        b = edge(s.stop, False) if s.stop is not None else n
        cut = F.slice(arr, a + 1, F.greatest(b - a, F.lit(0)))
        return cut if k == 1 else F.filter(cut, lambda x, i: i % k == 0)
    a = (F.lit(s.start) if s.start >= 0 else n + s.start) if s.start is not None else n - 1
    b = (F.lit(s.stop) if s.stop >= 0 else n + s.stop) if s.stop is not None else F.lit(-1)
    a = F.least(a, n - 1)
    picked = F.filter(F.transform(arr, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: (p["i"] <= a) & (p["i"] > b) & ((a - p["i"]) % -k == 0))
    return F.reverse(F.transform(picked, lambda p: p["x"]))


def _gather(parts: list[Val], drop_null: bool = False) -> Val:
    if not parts:
        return missing()
    kinds = {p.dtype.elementType.simpleString() for p in parts}
    if len(kinds) > 1:
        if not all(isinstance(p.dtype.elementType, T.NumericType) for p in parts):
            raise Unsupported("matches of different kinds")
        parts = [replace(p, col=p.col.cast("array<double>"), dtype=T.ArrayType(T.DoubleType())) for p in parts]
    col = parts[0].col if len(parts) == 1 else F.concat(*[F.coalesce(p.col, F.array().cast(p.dtype)) for p in parts])
    return Val(F.filter(col, lambda x: x.isNotNull()) if drop_null else col, "array", None, many=True, dtype=parts[0].dtype)


def _deep(v: Val, segment: jp.Segment, scope: Scope) -> Val:
    """All descendants that the selectors pick, found in the schema."""
    found: list[Val] = []
    one = jp.Segment(segment.selectors)

    def walk(x: Val) -> None:
        t = _element(x) if x.many else x.dtype
        try:
            got = step(x, one, scope)
        except Unsupported:
            got = missing()
        if not (got.kind == "null" and got.dtype is None):
            found.append(got if got.many else Val(F.array(got.col), "array", None, many=True, dtype=T.ArrayType(got.dtype)))
        if isinstance(t, T.StructType):
            for f in t:
                walk(step(x, jp.Segment((jp.Name(f.name),)), scope))
        elif isinstance(t, T.ArrayType):
            walk(step(x, jp.Segment((jp.Wild(),)), scope))

    walk(v)
    return _gather(found)


def bind_path(path: jp.Path, scope: Scope) -> Val:
    segments = path.segments
    if path.root == "@" and scope.current is not None:
        v = scope.current
        for s in segments:
            v = step(v, s, scope)
        return v
    if path.root == "$" and scope.rows:
        if not segments or segments[0].deep or len(segments[0].selectors) > 1 or not isinstance(segments[0].selectors[0], jp.Wild | jp.Filter):
            raise Unsupported(f"{path} over a table")
        picked = segments[0].selectors[0]
        inner = _row(segments[1:], replace(scope, rows=False, current=None))
        if isinstance(picked, jp.Filter):
            test = predicate(picked.test, replace(scope, rows=False, current=None))
            inner = replace(inner, col=F.when(test, inner.col), ok=native.both(inner.ok, test))
        return replace(inner, rows=True)
    return _row(segments, scope)


def _row(segments: tuple, scope: Scope) -> Val:
    if not segments:
        return Val(F.struct(*[F.col(f"`{n}`") for n in scope.schema.names]), "object", dtype=scope.schema)
    first = segments[0]
    if isinstance(first, jp.Segment) and not first.deep and len(first.selectors) == 1 and isinstance(first.selectors[0], jp.Name):
        v = field(scope, first.selectors[0].name)
        rest = segments[1:]
    else:
        v, rest = Val(F.struct(*[F.col(f"`{n}`") for n in scope.schema.names]), "object", dtype=scope.schema), segments
    for s in rest:
        v = step(v, s, scope)
    return v


def plain(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Both sides as columns that compare without a coercion, so that a scan can take the filter over; else None."""
    if a.kind == b.kind and a.kind in ("number", "text", "bool"):
        return a.col, b.col
    for x, y, turned in ((a, b, False), (b, a, True)):
        if x.kind == "date" and isinstance(y.lit, str):
            try:
                moment = F.lit(dates.parse(y.lit)).cast(x.dtype if x.dtype is not None else "timestamp")
            except Failure:
                return None
            return (moment, x.col) if turned else (x.col, moment)
    return None


def predicate(test: Any, scope: Scope, nullable: bool = False) -> Column:
    """A filter as a column that is never null; with ``nullable`` null stands for false, as a table's filter takes it,
    and comparisons stay plain enough to be pushed down."""
    if isinstance(test, jp.And):
        out = predicate(test.items[0], scope, nullable)
        for i in test.items[1:]:
            out = out & predicate(i, scope, nullable)
        return out
    if isinstance(test, jp.Or):
        out = predicate(test.items[0], scope, nullable)
        for i in test.items[1:]:
            out = out | predicate(i, scope, nullable)
        return out
    if isinstance(test, jp.Not):
        return ~predicate(test.item, scope)
    if isinstance(test, jp.Query):
        v = bind_path(test.path, replace(scope, rows=False))
        if v.many:
            return F.coalesce(F.size(v.col) > 0, F.lit(False))
        if v.kind == "null" and v.dtype is None:
            return F.lit(False)
        return v.col.isNotNull() if v.ok is None else F.coalesce(v.ok, F.lit(False))
    if isinstance(test, jp.Call):
        return native.flag(operand(test, scope))
    if isinstance(test, jp.Lit):
        return F.lit(bool(test.value))
    a, b = operand(test.left, scope), operand(test.right, scope) if not isinstance(test.right, jp.Regex) else None
    if test.op == "=~":
        pattern = test.right.pattern if isinstance(test.right, jp.Regex) else str(test.right.value)
        flags = "".join(f for f in (test.right.flags if isinstance(test.right, jp.Regex) else "") if f in "imsx")
        return F.coalesce(native.text(a).col.rlike((f"(?{flags})" if flags else "") + pattern), F.lit(False)) if a.kind == "text" else F.lit(False)
    there = [v.ok for v in (a, b) if v.ok is not None]
    sides = None if there else plain(a, b)
    if sides:
        x, y = sides
        if test.op in ("==", "===", "!=", "!=="):
            same = x.eqNullSafe(y)
            return same if test.op[0] == "=" else ~same
        if a.kind == "bool":
            return F.lit(False)
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[test.op]
        return out if nullable else F.coalesce(out, F.lit(False))
    if test.op in ("==", "===", "!=", "!=="):
        if a.kind in ("number", "bool") and b.kind in ("number", "bool") and a.kind != b.kind or (len(test.op) == 3 and a.kind != b.kind):
            out = F.lit(False)
        else:
            out = F.coalesce(a.col == b.col, F.lit(False)) if a.kind == b.kind and "null" not in (a.kind, b.kind) else native.loose(a, b)
        out = ~out if test.op[0] == "!" else out
    else:
        ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        out = native.compare(a, b, ops[test.op])
    for t in there:
        out = out & F.coalesce(t, F.lit(False))
    return out


def operand(x: Any, scope: Scope) -> Val:
    if isinstance(x, jp.Lit):
        return native.literal(x.value)
    if isinstance(x, jp.Query):
        return bind_path(x.path, replace(scope, rows=False))
    args = [operand(a, scope) for a in x.args]
    if x.name == "length":
        return native.REGISTRY["length"](*args)
    if x.name == "count":
        return native.REGISTRY["count"](*args)
    if x.name in ("match", "search"):
        pattern = jp.iregexp(str(args[1].lit))
        return Val(F.coalesce(native.text(args[0]).col.rlike(f"^(?:{pattern})$" if x.name == "match" else pattern), F.lit(False)), "bool")
    if x.name == "value":
        v = args[0]
        return Val(F.get(v.col, F.lit(0)), kind_of(_element(v)), F.size(v.col) == 1, dtype=_element(v)) if v.many else v
    raise Unsupported(f"{x.name} in a filter")


def bind(node: Any, scope: Scope) -> Val:
    """A value as a column."""
    if isinstance(node, values.Literal):
        return native.literal(node.value)
    if isinstance(node, values.PathValue):
        return bind_path(jp.parse(node.text, scope.dialect), scope)
    if isinstance(node, values.Template):
        parts = [(k, bind(v, scope)) for k, v in node.items]
        if node.kind == "array":
            return Val(F.array(*[v.col for _, v in parts]), "array")
        return Val(F.struct(*[v.col.alias(k) for k, v in parts]), "object")
    run = native.REGISTRY.get(node.name)
    if run is None:
        raise Unsupported(f"{node.name} in the native tier")
    args = [_key(node, i, a, scope) for i, a in enumerate(node.args)]
    if any(a.rows for a in args):
        return _aggregate(node, args, scope)
    return run(*args)


def _key(node: values.Call, i: int, a: Any, scope: Scope) -> Val:
    """Arguments that name a property stay text, even where they are written as paths."""
    if isinstance(a, values.PathValue) and ((node.name == "sortby" and i == 1) or (node.name == "resolve" and i in (1, 3))):
        return native.literal(a.text)
    return bind(a, scope)


def _aggregate(node: values.Call, args: list[Val], scope: Scope) -> Val:
    if scope.aggregates is None:
        raise Unsupported("an aggregate over the table in this place")
    if node.name in ("sum", "avg", "count", "min", "max", "median") and len(args) > 1:
        raise Unsupported("an aggregate of several paths over the table")
    agg = native.row_aggregate(node.name, args)
    if agg is None:
        raise Unsupported(f"{node.name} over the table")
    kept = scope.aggregates
    name = f"agg_{next(_NUMBER)}_"
    kept[name] = agg
    kind = "text" if node.name.endswith("date") else "number"
    return Val(F.col(name), kind, F.col(name).isNotNull() if node.name in ("min", "max", "minifs", "maxifs", "mindate", "maxdate", "avgdate") else None)


def suggest(schema: T.DataType, prefix: str = "$") -> list[str]:
    """Paths that continue ``prefix`` in a schema, for completion; arrays are shown with ``[*]``."""
    out: list[str] = []

    def walk(t: T.DataType, path: str) -> None:
        if path != "$":
            out.append(path)
        if isinstance(t, T.StructType):
            for f in t:
                walk(f.dataType, jp.render(jp.Segment((jp.Name(f.name),))).join([path, ""]))
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, path + "[*]")

    walk(schema, "$")
    return [p for p in out if p.startswith(prefix)]
