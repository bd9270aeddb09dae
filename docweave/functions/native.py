"""Value functions as Spark columns: the native tier.

A compiled value is a :class:`Val`: a column, a column that says whether it could be computed (None: always), its
kind, and its literal where it is one.  Kinds are number, text, bool, date and any; arrays of matches have ``many``.
Numbers are doubles throughout.  Nothing here throws under ANSI mode: failures are a false ``ok``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dates
from .coerce import Criteria


class Unsupported(Exception):
    """What the native tier cannot express; the dynamic tier can."""


@dataclass(frozen=True)
class Val:
    col: Column
    kind: str = "any"
    ok: Column | None = None
    lit: Any = ...
    many: bool = False  # an array of matches
    dtype: T.DataType | None = None
    rows: bool = False  # over all rows of the table: only aggregates take it

    @property
    def literal(self) -> bool:
        return self.lit is not ...


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "date" if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType) else "array" if isinstance(t, T.ArrayType) else "object" if isinstance(t, T.StructType | T.MapType) else "null" if isinstance(t, T.NullType) else "any"


def numbers(a: Val) -> Column:
    """The elements of an array as doubles, null as 0."""
    t = a.dtype.elementType
    return F.transform(a.col, lambda x: F.coalesce(raw_double(Val(x, kind_of(t))), F.lit(0.0)))


def literal(v: Any) -> Val:
    kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "text" if isinstance(v, str) else "null" if v is None else "array" if isinstance(v, list) else "object"
    if isinstance(v, list):
        col = F.array(*[literal(x).col for x in v])
    elif isinstance(v, dict):
        col = F.struct(*[literal(x).col.alias(k) for k, x in v.items()])
    else:
        col = F.lit(v)
    return Val(col, kind, lit=v)


def both(*oks: Column | None) -> Column | None:
    found = None
    for o in oks:
        if o is not None:
            found = o if found is None else found & o
    return found


def column(name: str, t: T.DataType) -> Val:
    return Val(F.col(f"`{name}`"), kind_of(t), dtype=t)


# ---- coercions ------------------------------------------------------------------------------------------------------
def raw_double(v: Val) -> Column:
    """The number, or null where it is none (null itself too)."""
    if v.kind == "number":
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "text":
        return F.regexp_replace(v.col, ",", "").try_cast("double")
    return F.lit(None).cast("double")


def double(v: Val) -> Val:
    """A number with null as 0; text that is no number is not ok."""
    if v.many:
        return Val(F.aggregate(numbers(v), F.lit(0.0), lambda a, x: a + x), "number", both(v.ok, v.col.isNotNull()))
    if v.kind in ("array", "object", "date"):
        raise Unsupported(f"a {v.kind} is no number")
    x = raw_double(v)
    ok = None if v.kind in ("number", "bool", "null") else v.col.isNull() | x.isNotNull()
    return Val(F.coalesce(x, F.lit(0.0)), "number", both(v.ok, ok))


def text(v: Val) -> Val:
    """Text with null as ''; whole numbers without a fraction."""
    if v.kind == "text":
        return replace(v, col=F.coalesce(v.col, F.lit("")), many=False)
    if v.kind == "number":
        if isinstance(v.dtype, T.IntegralType) or (v.literal and isinstance(v.lit, int)):
            c = v.col.cast("string")
        else:
            d = v.col.cast("double")
            c = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))
        return Val(F.coalesce(c, F.lit("")), "text", v.ok)
    if v.kind in ("array", "object"):
        return Val(F.coalesce(F.to_json(v.col), F.lit("")), "text", v.ok)
    if v.kind == "date":
        return Val(F.coalesce(show_date(v.col.cast("timestamp")), F.lit("")), "text", v.ok)
    return Val(F.coalesce(v.col.cast("string"), F.lit("")), "text", v.ok)


def flag(v: Val) -> Column:
    """Truthiness: true, or text 'true' in any case."""
    if v.kind == "bool":
        c = F.coalesce(v.col, F.lit(False))
    elif v.kind == "text":
        c = F.coalesce(F.lower(v.col) == "true", F.lit(False))
    else:
        c = F.lit(False)
    return c if v.ok is None else c & v.ok


def parse_date(v: Val) -> Val:
    """A timestamp (session zone UTC); null or unreadable text is not ok."""
    if v.kind == "date":
        return Val(v.col.cast("timestamp"), "date", both(v.ok, v.col.isNotNull()))
    c = v.col.cast("string")
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy"]
    t = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms], c.try_cast("timestamp"))
    return Val(t, "date", both(v.ok, t.isNotNull()))


def show_date(t: Column) -> Column:
    return F.when(t == F.date_trunc("day", t), F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def loose(a: Val, b: Val) -> Column:
    """Equality by value across numbers and text; null equals null; never null itself."""
    if "null" in (a.kind, b.kind):
        return a.col.isNull() if b.kind == "null" else b.col.isNull()
    if a.kind in ("array", "object") or b.kind in ("array", "object"):
        return a.col.eqNullSafe(b.col) if a.kind == b.kind else a.col.isNull() & b.col.isNull()
    if a.kind == b.kind and a.kind in ("number", "bool", "date"):
        return a.col.eqNullSafe(b.col)
    if "bool" in (a.kind, b.kind):
        return F.lower(a.col.cast("string")).eqNullSafe(F.lower(b.col.cast("string")))
    x, y = raw_double(a), raw_double(b)
    same_text = _plain(a).eqNullSafe(_plain(b))
    if a.literal and b.kind == "text" or b.literal and a.kind == "text":  # one side is known: decide its form now
        known = a if a.literal else b
        if isinstance(known.lit, str) and not re.fullmatch(r"\s*[+-]?[\d,]*\.?\d+([eE][+-]?\d+)?\s*", known.lit):
            return same_text
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(same_text)


def _plain(v: Val) -> Column:
    return v.col if v.kind == "text" else F.when(v.col.isNotNull(), text(v).col)


def compare(a: Val, b: Val, test: Callable[[Column, Column], Column]) -> Column:
    """A comparison by number if both are, else by text; incomparable is false."""
    if a.kind == b.kind and a.kind in ("number", "date"):
        return F.coalesce(test(a.col, b.col), F.lit(False))
    if a.kind in ("array", "object", "null") or b.kind in ("array", "object", "null"):
        return F.lit(False)
    if "date" in (a.kind, b.kind):
        x, y = parse_date(a), parse_date(b)
        return F.coalesce(test(x.col, y.col), F.lit(False))
    x, y = raw_double(a), raw_double(b)
    by_text = test(_plain(a), _plain(b))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(by_text), F.lit(False))


def criteria(v: Val, raw: Any) -> Column:
    """A spreadsheet criterion, read now; never null."""
    c = Criteria(raw)
    if c.empty:
        return F.lit(False)
    t = text(v).col
    if c.pattern is not None:
        java = "(?is)^" + "".join({"*": ".*", "?": "."}.get(p, re.escape(p[-1])) for p in re.findall(r"~[*?~]|.", c.operand, re.S)) + "$"
        return t.rlike(java) if c.op == "=" else ~t.rlike(java)
    test = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[c.op]
    low = c.operand.replace("~", "").lower() if "~" in c.operand else c.operand.lower()
    by_text = test(F.lower(t), F.lit(low))
    if c.value is None or v.kind not in ("number", "text", "bool"):
        return by_text
    x = raw_double(v)
    if v.kind == "number":
        return F.coalesce(test(x, F.lit(float(c.value))), by_text)
    return F.when(x.isNotNull(), test(x, F.lit(float(c.value)))).otherwise(by_text)


# ---- the functions --------------------------------------------------------------------------------------------------
REGISTRY: dict[str, Callable[..., Val]] = {}


def function(*names: str):
    def put(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def _num(name: str, f: Callable[..., Column], check: Callable[..., Column] | None = None) -> None:
    def run(*args: Val) -> Val:
        xs = [double(a) for a in args]
        cols = [x.col for x in xs]
        return Val(f(*cols), "number", both(*[x.ok for x in xs], check(*cols) if check else None))

    function(name)(run)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


_num("abs", F.abs)
_num("ceiling", lambda x: F.ceil(x).cast("double"))
_num("floor", lambda x: F.floor(x).cast("double"))
_num("sign", lambda x: F.signum(x))
_num("sqrt", lambda x: F.sqrt(x), lambda x: x >= 0)
_num("pow", lambda x, y: F.pow(x, y), lambda x, y: _finite(F.pow(x, y)))
_num("subtract", lambda x, y: x - y)
_num("divide", lambda x, y: F.try_divide(x, y), lambda x, y: y != 0)
_num("modulo", lambda x, y: F.when(y != 0, x % F.when(y != 0, y)), lambda x, y: y != 0)
_num("clamp", lambda x, lo, hi: F.least(F.greatest(x, lo), hi), lambda x, lo, hi: lo <= hi)


def half_away(x: Column, digits: int) -> Column:
    """Half away from zero on the shortest decimal text of the double."""
    return F.round(x, digits)


@function("round")
def _round(a: Val, digits: Val | None = None) -> Val:
    d = 0 if digits is None else digits.lit
    if not isinstance(d, int):
        raise Unsupported("digits are a literal")
    x = double(a)
    return Val(half_away(x.col, d), "number", both(x.ok, F.lit(0 <= d <= 15)))


@function("multiply")
def _multiply(*args: Val) -> Val:
    out, ok = F.lit(1.0), None
    for a in args:
        if a.many:
            out = out * F.aggregate(numbers(a), F.lit(1.0), lambda m, x: m * x)
        else:
            x = double(a)
            out, ok = out * x.col, both(ok, x.ok)
    return Val(out, "number", ok)


@function("calculate")
def _calculate(a: Val) -> Val:
    from .calculate import calculate

    if not a.literal:
        raise Unsupported("calculate over data")
    return literal(calculate(str(a.lit)))


# aggregates over arguments and arrays of matches
def _parts(args: tuple[Val, ...]) -> tuple[Column, Column | None]:
    """All numbers of the arguments as one array, null as 0."""
    arrays, ok = [], None
    for a in args:
        if a.many or a.kind == "array":
            arrays.append(numbers(a))
            ok = both(ok, a.col.isNotNull())
        else:
            x = double(a)
            arrays.append(F.array(x.col))
            ok = both(ok, x.ok)
    return (arrays[0] if len(arrays) == 1 else F.concat(*arrays)), ok


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


@function("sum")
def _sum(*args: Val) -> Val:
    if not any(a.many or a.kind == "array" for a in args):
        xs = [double(a) for a in args]
        out = xs[0].col
        for x in xs[1:]:
            out = out + x.col
        return Val(out, "number", both(*[x.ok for x in xs]))
    xs, ok = _parts(args)
    return Val(_total(xs), "number", ok)


@function("avg")
def _avg(*args: Val) -> Val:
    xs, ok = _parts(args)
    return Val(F.when(F.size(xs) > 0, _total(xs) / F.greatest(F.size(xs), F.lit(1))).otherwise(0.0), "number", ok)


@function("count")
def _count(*args: Val) -> Val:
    out = F.lit(0)
    for a in args:
        out = out + (F.coalesce(F.size(a.col), F.lit(0)) if a.many or a.kind == "array" else F.lit(1))
    return Val(out.cast("double"), "number")


@function("min")
def _min(*args: Val) -> Val:
    xs, ok = _parts(args)
    return Val(F.array_min(xs), "number", both(ok, F.size(xs) > 0))


@function("max")
def _max(*args: Val) -> Val:
    xs, ok = _parts(args)
    return Val(F.array_max(xs), "number", both(ok, F.size(xs) > 0))


@function("median")
def _median(*args: Val) -> Val:
    xs, ok = _parts(args)
    s, n = F.array_sort(xs), F.size(xs)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return Val(F.coalesce(middle, F.lit(0.0)), "number", ok)


# predicates
@function("equals")
def _equals(a: Val, b: Val) -> Val:
    return Val(loose(a, b), "bool")


@function("notequals")
def _notequals(a: Val, b: Val) -> Val:
    return Val(~loose(a, b), "bool")


for _name, _test in (("greaterthan", lambda a, b: a > b), ("greaterorequal", lambda a, b: a >= b), ("lessthan", lambda a, b: a < b), ("lessorequal", lambda a, b: a <= b)):
    function(_name)(lambda a, b, _test=_test: Val(compare(a, b, _test), "bool"))


@function("between")
def _between(v: Val, lo: Val, hi: Val) -> Val:
    return Val(compare(v, lo, lambda a, b: a >= b) & compare(v, hi, lambda a, b: a <= b), "bool")


@function("and")
def _and(*args: Val) -> Val:
    out = F.lit(True)
    for a in args:
        out = out & flag(a)
    return Val(out, "bool")


@function("or")
def _or(*args: Val) -> Val:
    out = F.lit(False)
    for a in args:
        out = out | flag(a)
    return Val(out, "bool")


@function("not")
def _not(a: Val) -> Val:
    return Val(~flag(a), "bool")


@function("exists")
def _exists(a: Val) -> Val:
    if a.many:
        return Val(F.coalesce(F.size(a.col) > 0, F.lit(False)), "bool")
    return Val(F.lit(True) if a.ok is None else a.ok, "bool")


@function("isnull")
def _isnull(a: Val) -> Val:
    return Val(a.col.isNull() if a.ok is None else a.col.isNull() | ~a.ok, "bool")


for _name, _kind in (("isstring", "text"), ("isnumber", "number"), ("isboolean", "bool"), ("isarray", "array"), ("isobject", "object")):
    function(_name)(lambda a, _kind=_kind: Val(a.col.isNotNull() if ("array" if a.many else "text" if a.kind == "date" else a.kind) == _kind else F.lit(False), "bool"))


def _has(v: Val, o: Val) -> Column:
    return F.exists(o.col, lambda x: loose(v, Val(x, kind_of(o.dtype.elementType))))


@function("in")
def _in(v: Val, *options: Val) -> Val:
    out = F.lit(False)
    for o in options:
        if o.literal and isinstance(o.lit, list):
            for x in o.lit:
                out = out | loose(v, literal(x))
        elif o.many or o.kind == "array":
            out = out | _has(v, o)
        else:
            out = out | loose(v, o)
    return Val(out, "bool")


@function("matches")
def _matches(v: Val, pattern: Val) -> Val:
    if not pattern.literal:
        raise Unsupported("patterns are literals")
    return Val(F.coalesce(_plain(v).rlike(str(pattern.lit)), F.lit(False)), "bool")


def unify(a: Val, b: Val) -> tuple[Column, Column, str]:
    """Two branches as columns of one kind: text where they differ."""
    if a.kind == b.kind or b.kind == "null":
        if a.kind == "number":
            return a.col.cast("double"), b.col.cast("double"), "number"
        return a.col, b.col, a.kind
    if a.kind == "null":
        return a.col, b.col, b.kind
    return _plain(a), _plain(b), "text"


@function("if")
def _if(c: Val, a: Val, b: Val) -> Val:
    x, y, kind = unify(a, b)
    yes = flag(c)
    ok = None if a.ok is None and b.ok is None else F.when(yes, F.lit(True) if a.ok is None else a.ok).otherwise(F.lit(True) if b.ok is None else b.ok)
    return Val(F.when(yes, x).otherwise(y), kind, ok)


@function("coalesce")
def _coalesce(*args: Val) -> Val:
    out = args[-1]
    last = args[-1]
    kept = None
    for a in reversed(args):
        c = F.nullif(a.col, F.lit("")) if a.kind == "text" and not (a is last and a.literal) else a.col
        c = c if a.ok is None else F.when(a.ok, c)
        if kept is None:
            kept = replace(a, col=c, ok=None, lit=...)
        else:
            x, y, kind = unify(replace(a, col=c, ok=None, lit=...), kept)
            kept = Val(F.coalesce(x, y), kind)
    return replace(kept, ok=None if out.literal else kept.col.isNotNull())


@function("fetch")
def _fetch(a: Val, default: Val | None = None) -> Val:
    if default is None or a.ok is None:
        return a
    x, y, kind = unify(a, default)
    return Val(F.when(a.ok, x).otherwise(y), kind)


@function("promote")
def _promote(a: Val, name: Val | None = None) -> Val:
    return Val(F.struct(a.col.alias(str(name.lit) if name else "value")), "object", a.ok)


@function("toarray")
def _toarray(a: Val) -> Val:
    if a.kind == "array" or a.many:
        return replace(a, col=F.coalesce(a.col, F.array().cast(a.dtype) if a.dtype else F.array()), kind="array", many=False)
    return Val(F.filter(F.array(a.col), lambda x: x.isNotNull()), "array", None, dtype=T.ArrayType(a.dtype) if a.dtype else None)


@function("partial")
def _partial(a: Val, index: Val | None = None) -> Val:
    i = int(index.lit) if index is not None and index.literal and isinstance(index.lit, int | float) else 0
    if not a.many:
        return a if i == 0 else replace(a, ok=F.lit(False))
    t = a.dtype.elementType
    return Val(F.get(a.col, F.lit(i)), kind_of(t), both(a.ok, F.size(a.col) > i), dtype=t)


@function("last")
def _last(a: Val) -> Val:
    if not a.many:
        return a
    t = a.dtype.elementType
    return Val(F.try_element_at(a.col, F.lit(-1)), kind_of(t), F.size(a.col) > 0, dtype=t)


@function("distinct")
def _distinct(a: Val) -> Val:
    return replace(a, col=F.array_distinct(a.col), kind="array", many=False)


@function("sort")
def _sort(a: Val, direction: Val | None = None) -> Val:
    """Numbers by value, other kinds by text; equal keys keep their order."""
    down = direction is not None and str(direction.lit).lower() == "desc"
    number = isinstance(a.dtype.elementType, T.NumericType)
    key = lambda x: (x.cast("double") if number else F.coalesce(x.cast("string"), F.lit("")))
    return replace(a, col=_stable(a.col, key, down), kind="array", many=False)


def _stable(arr: Column, key: Callable[[Column], Column], down: bool, missing: Callable[[Column], Column] | None = None) -> Column:
    packed = F.transform(arr, lambda x, i: F.struct(F.lit(0).alias("m") if missing is None else missing(x).cast("int").alias("m"), key(x).alias("k"), i.alias("i"), x.alias("x")))

    def order(p: Column, q: Column) -> Column:
        less, more = (q["k"] < p["k"], p["k"] < q["k"]) if down else (p["k"] < q["k"], q["k"] < p["k"])
        return F.when(p["m"] != q["m"], p["m"] - q["m"]).when(less, -1).when(more, 1).otherwise(p["i"] - q["i"])

    return F.transform(F.array_sort(packed, order), lambda p: p["x"])


@function("sortby")
def _sortby(a: Val, key: Val, direction: Val | None = None) -> Val:
    t: T.DataType = a.dtype.elementType
    names = str(key.lit).removeprefix("@.").split(".")
    for n in names:
        t = t[n].dataType
    number = isinstance(t, T.NumericType)

    def get(x: Column) -> Column:
        for n in names:
            x = x.getField(n)
        return x

    k = lambda x: (get(x).cast("double") if number else F.coalesce(get(x).cast("string"), F.lit("")))
    down = direction is not None and str(direction.lit).lower() == "desc"
    return replace(a, col=_stable(a.col, k, down, lambda x: get(x).isNull()), kind="array", many=False)


@function("resolve")
def _resolve(coll: Val, key: Val, wanted: Val, field: Val | None = None) -> Val:
    t = coll.dtype.elementType
    name = str(key.lit).removeprefix("@.")
    hits = F.filter(coll.col, lambda x: loose(Val(x.getField(name), kind_of(t[name].dataType)), wanted))
    first = F.get(hits, F.lit(0))
    if field is None:
        return Val(first, "object", first.isNotNull(), dtype=t)
    f = str(field.lit).removeprefix("@.")
    return Val(first.getField(f), kind_of(t[f].dataType), first.isNotNull(), dtype=t[f].dataType)


# conditional aggregates over arrays of matches
def _zip(arrays: list[Val]) -> Column:
    return F.arrays_zip(*[a.col.alias(f"a{i}") for i, a in enumerate(arrays)])


def _pick(target: Val, pairs: tuple[Val, ...], shortest: bool = True) -> Column:
    """Numbers of the target whose rows meet all criteria."""
    arrays = [target, *pairs[0::2]]
    n = F.least(*[F.size(a.col) for a in arrays]) if len(arrays) > 1 else F.size(target.col)
    tests = [(i, c.lit) for i, c in enumerate(pairs[1::2])]
    rows = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)

    def at(a: Val, i: Column) -> Val:
        return Val(F.get(a.col, i), kind_of(a.dtype.elementType))

    def holds(i: Column) -> Column:
        out = raw_double(at(target, i)).isNotNull()
        for k, raw in tests:
            out = out & criteria(at(arrays[k + 1], i), raw)
        return out

    return F.transform(F.filter(rows, holds), lambda i: raw_double(at(target, i)))


@function("sumif")
def _sumif(r: Val, c: Val, target: Val | None = None) -> Val:
    return Val(_total(_pick(target or r, (r, c))), "number")


@function("averageif")
def _averageif(r: Val, c: Val, target: Val | None = None) -> Val:
    xs = _pick(target or r, (r, c))
    return Val(F.coalesce(F.try_divide(_total(xs), F.size(xs)), F.lit(0.0)), "number")


@function("countif")
def _countif(r: Val, c: Val) -> Val:
    t = r.dtype.elementType
    return Val(F.size(F.filter(r.col, lambda x: criteria(Val(x, kind_of(t)), c.lit))).cast("double"), "number")


@function("countifs")
def _countifs(*pairs: Val) -> Val:
    arrays = pairs[0::2]
    n = F.least(*[F.size(a.col) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0].col)

    def holds(i: Column) -> Column:
        out = i < n
        for a, c in zip(arrays, pairs[1::2], strict=True):
            out = out & criteria(Val(F.get(a.col, i), kind_of(a.dtype.elementType)), c.lit)
        return out

    return Val(F.size(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), holds)).cast("double"), "number")


@function("sumifs")
def _sumifs(target: Val, *pairs: Val) -> Val:
    return Val(_total(_pick(target, pairs)), "number")


@function("averageifs")
def _averageifs(target: Val, *pairs: Val) -> Val:
    xs = _pick(target, pairs)
    return Val(F.coalesce(F.try_divide(_total(xs), F.size(xs)), F.lit(0.0)), "number")


@function("minifs")
def _minifs(target: Val, *pairs: Val) -> Val:
    xs = _pick(target, pairs)
    return Val(F.array_min(xs), "number", F.size(xs) > 0)


@function("maxifs")
def _maxifs(target: Val, *pairs: Val) -> Val:
    xs = _pick(target, pairs)
    return Val(F.array_max(xs), "number", F.size(xs) > 0)


# text
def _text1(name: str, f: Callable[[Column], Column], kind: str = "text") -> None:
    function(name)(lambda a: Val(f(text(a).col), kind, a.ok))


_text1("toupper", F.upper)
_text1("tolower", F.lower)
_text1("trim", lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
_text1("trimstart", lambda s: F.regexp_replace(s, r"(?U)^\s+", ""))
_text1("trimend", lambda s: F.regexp_replace(s, r"(?U)\s+$", ""))


def _texts(a: Val) -> Column:
    t = a.dtype.elementType
    return F.transform(a.col, lambda x: text(Val(x, kind_of(t), dtype=t)).col)


@function("concat")
def _concat(*args: Val) -> Val:
    parts = [F.array_join(_texts(a), "") if a.many or a.kind == "array" else text(a).col for a in args]
    return Val(F.concat(*parts) if parts else F.lit(""), "text", both(*[a.ok for a in args]))


@function("length")
def _length(a: Val) -> Val:
    c = F.size(a.col) if a.kind == "array" or a.many else F.length(text(a).col)
    return Val(c.cast("double"), "number", a.ok)


@function("substring")
def _substring(a: Val, start: Val, length: Val | None = None) -> Val:
    i = F.greatest(double(start).col.cast("int"), F.lit(0)) + 1
    n = F.greatest(double(length).col.cast("int"), F.lit(0)) if length is not None else F.lit(2**31 - 1)
    return Val(F.substring(text(a).col, i, n), "text", both(a.ok, start.ok, length.ok if length else None))


@function("right")
def _right(a: Val, n: Val) -> Val:
    k = double(n).col.cast("int")
    return Val(F.when(k > 0, F.right(text(a).col, k)).otherwise(""), "text", both(a.ok, n.ok))


def _search(name: str, f: Callable[[Column, Column], Column], kind: str = "bool") -> None:
    function(name)(lambda a, b: Val(f(F.lower(text(a).col), F.lower(text(b).col)), kind, both(a.ok, b.ok)))


_search("startswith", lambda a, b: F.startswith(a, b))
_search("endswith", lambda a, b: F.endswith(a, b))
_search("contains", lambda a, b: F.contains(a, b))
_search("indexof", lambda a, b: (F.position(b, a) - 1).cast("double"), "number")


@function("replace")
def _replace(a: Val, old: Val, new: Val) -> Val:
    return Val(F.replace(text(a).col, text(old).col, text(new).col), "text", both(a.ok, old.ok, new.ok))


@function("split")
def _split(a: Val, by: Val) -> Val:
    if not by.literal:
        raise Unsupported("delimiters are literals")
    s, d = text(a).col, str(by.lit)
    c = F.split(s, re.escape(d)) if d else F.split(s, "(?!^)(?=.)")
    return Val(c, "array", a.ok, dtype=T.ArrayType(T.StringType()))


@function("join")
def _join(a: Val, sep: Val) -> Val:
    return Val(F.array_join(_texts(a), str(sep.lit)), "text", a.ok)


def _pad(name: str, f: Callable) -> None:
    def run(a: Val, n: Val, fill: Val | None = None) -> Val:
        s, k = text(a).col, double(n).col.cast("int")
        return Val(F.when(F.length(s) >= k, s).otherwise(f(s, k, F.lit((str(fill.lit) if fill else " ")[:1] or " "))), "text", both(a.ok, n.ok))

    function(name)(run)


_pad("padleft", lambda s, k, c: F.lpad(s, k, c))
_pad("padright", lambda s, k, c: F.rpad(s, k, c))


@function("tofixed")
def _tofixed(a: Val, digits: Val, sep: Val | None = None) -> Val:
    d, x = int(digits.lit), raw_double(a)
    c = fixed(x, d)
    return Val(F.replace(c, F.lit("."), F.lit(str(sep.lit))) if sep else c, "text", both(a.ok, x.isNotNull() & F.lit(0 <= d <= 15)))


def fixed(x: Column, d: int, group: bool = False) -> Column:
    return F.format_string(f"%{',' if group else ''}.{d}f", half_away(x, d))


@function("format")
def _format(template: Val, *args: Val) -> Val:
    """A composite template, compiled to a concatenation."""
    if not template.literal:
        raise Unsupported("templates are literals")
    parts: list[Column] = []
    for m in re.finditer(r"(\{\{|\}\})|\{(\d+)(?:,(-?\d+))?(?::([^}]*))?\}|([^{}]+)", str(template.lit)):
        if m[1]:
            parts.append(F.lit(m[1][0]))
        elif m[5] is not None:
            parts.append(F.lit(m[5]))
        else:
            a, spec = args[int(m[2])], m[4] or ""
            f = re.fullmatch(r"([FfNnPp])(\d*)", spec)
            c = text(a).col
            if f and a.kind == "number":
                d = int(f[2] or 2)
                x = a.col.cast("double")
                c = F.concat(fixed(x * 100, d, True), F.lit(" %")) if f[1] in "Pp" else fixed(x, d, f[1] in "Nn")
            elif (f := re.fullmatch(r"[Dd](\d*)", spec)) and a.kind == "number":
                c = F.format_string(f"%0{f[1] or 1}d", a.col.cast("long"))
            elif spec and a.kind == "number":
                raise Unsupported(f"format {spec}")
            if m[3]:
                w = int(m[3])
                c = F.when(F.length(c) >= abs(w), c).otherwise(F.lpad(c, w, " ") if w > 0 else F.rpad(c, -w, " "))
            parts.append(c)
    return Val(F.concat(*parts) if parts else F.lit(""), "text", both(*[a.ok for a in args]))


@function("tostring")
def _tostring(a: Val) -> Val:
    return text(a)


@function("isempty")
def _isempty(a: Val) -> Val:
    c = a.col.isNull() | ((F.size(a.col) == 0) if a.kind == "array" or a.many else (a.col == "") if a.kind == "text" else F.lit(False))
    return Val(c, "bool", a.ok)


@function("regexreplace")
def _regexreplace(a: Val, pattern: Val, to: Val) -> Val:
    if not (pattern.literal and to.literal):
        raise Unsupported("patterns are literals")
    return Val(F.regexp_replace(text(a).col, F.lit(str(pattern.lit)), F.lit(str(to.lit))), "text", a.ok)


@function("regexextract")
def _regexextract(a: Val, pattern: Val, group: Val | None = None) -> Val:
    if not pattern.literal or (group is not None and not isinstance(group.lit, int)):
        raise Unsupported("patterns and groups are literals")
    g = 0 if group is None else group.lit
    groups = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", str(pattern.lit))).groups
    if g > groups:
        return Val(F.lit(""), "text", F.lit(False))
    return Val(F.regexp_extract(text(a).col, str(pattern.lit), g), "text", a.ok)


@function("newguid")
def _newguid() -> Val:
    return Val(F.expr("uuid()"), "text")


@function("datetime")
def _datetime(pattern: Val | None = None) -> Val:
    return Val(F.date_format(F.current_timestamp(), dates.java_pattern(str(pattern.lit) if pattern else "yyyy-MM-dd'T'HH:mm:ss.fff'Z'")), "text")


# dates
def _micros(v: Val) -> Column:
    return F.unix_micros(v.col)


@function("datecompare")
def _datecompare(a: Val, b: Val) -> Val:
    x, y = parse_date(a), parse_date(b)
    return Val(F.signum((_micros(x) - _micros(y)).cast("double")), "number", both(x.ok, y.ok))


@function("isdatebetween")
def _isdatebetween(a: Val, lo: Val, hi: Val) -> Val:
    x, y, z = parse_date(a), parse_date(lo), parse_date(hi)
    return Val((x.col >= y.col) & (x.col <= z.col), "bool", both(x.ok, y.ok, z.ok))


def _months(d: Column, n: Column) -> Column:
    """The timestamp n months on, the day clamped, the time of day kept."""
    day = F.to_date(d)
    return F.timestamp_micros(F.unix_micros(F.add_months(day, n).cast("timestamp")) + F.unix_micros(d) - F.unix_micros(day.cast("timestamp")))


@function("datediff")
def _datediff(a: Val, b: Val, unit: Val | None = None) -> Val:
    x, y = parse_date(a), parse_date(b)
    kind, size = dates.unit("day" if unit is None else unit.lit)
    if kind != "month":
        per = size * 1_000_000 if kind == "second" else size
        d = _micros(y) - _micros(x)
        return Val((F.signum(d.cast("double")) * F.floor(F.abs(d) / F.lit(per))).cast("double"), "number", both(x.ok, y.ok))
    lo, hi = F.least(x.col, y.col), F.greatest(x.col, y.col)
    n = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    n = n - F.when((n > 0) & (_months(lo, n) > hi), 1).otherwise(0)
    return Val((F.floor(n / size) * F.when(y.col < x.col, -1).otherwise(1)).cast("double"), "number", both(x.ok, y.ok))


@function("dateadd")
def _dateadd(a: Val, n: Val, unit: Val | None = None) -> Val:
    x, k = parse_date(a), double(n)
    kind, size = dates.unit("day" if unit is None else unit.lit)
    if kind == "month":
        c = _months(x.col, k.col.cast("int") * size)
    else:
        c = F.timestamp_micros((_micros(x) + k.col * (size * 1_000_000 if kind == "second" else size)).cast("long"))
    return Val(show_date(c), "text", both(x.ok, k.ok))


_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofyear": F.dayofyear,
    "dayofweek": lambda t: F.weekday(t) + 1, "weekday": lambda t: F.weekday(t) + 1, "week": F.weekofyear, "weekofyear": F.weekofyear, "isoweek": F.weekofyear,
    "daysinmonth": lambda t: F.dayofmonth(F.last_day(t)), "millisecond": lambda t: F.pmod(F.unix_millis(t), F.lit(1000)),
}


@function("datepart")
def _datepart(a: Val, part: Val) -> Val:
    x = parse_date(a)
    w = str(part.lit).strip().lower()
    w = w[:-1] if w.endswith("s") else w
    if w not in _PARTS:
        return Val(F.lit(None).cast("double"), "number", F.lit(False))
    return Val(_PARTS[w](x.col).cast("double"), "number", x.ok)


@function("formatdate")
def _formatdate(a: Val, pattern: Val) -> Val:
    x = parse_date(a)
    return Val(F.date_format(x.col, dates.java_pattern(str(pattern.lit))), "text", x.ok)


@function("parsedate")
def _parsedate(a: Val, pattern: Val | None = None) -> Val:
    if pattern is None:
        x = parse_date(a)
    else:
        t = F.try_to_timestamp(text(a).col, F.lit(dates.java_pattern(str(pattern.lit))))
        x = Val(t, "date", both(a.ok, t.isNotNull()))
    return Val(show_date(x.col), "text", x.ok)


@function("startofmonth")
def _startofmonth(a: Val) -> Val:
    x = parse_date(a)
    return Val(F.date_format(F.trunc(x.col, "MM"), "yyyy-MM-dd"), "text", x.ok)


@function("endofmonth")
def _endofmonth(a: Val) -> Val:
    x = parse_date(a)
    return Val(F.date_format(F.last_day(x.col), "yyyy-MM-dd"), "text", x.ok)


@function("daycountfraction")
def _daycountfraction(a: Val, b: Val, rule: Val) -> Val:
    x, y = parse_date(a), parse_date(b)
    r = str(rule.lit).strip().upper().replace("/", "").replace("ACT", "A")
    if r in ("A360", "A365"):
        c = (_micros(y) - _micros(x)) / 86_400_000_000 / int(r[1:])
    elif r in ("30E360", "30360E"):
        day = lambda t: F.least(F.dayofmonth(t), F.lit(30))
        c = ((F.year(y.col) - F.year(x.col)) * 360 + (F.month(y.col) - F.month(x.col)) * 30 + day(y.col) - day(x.col)) / 360
    else:
        return Val(F.lit(None).cast("double"), "number", F.lit(False))
    return Val(c.cast("double"), "number", both(x.ok, y.ok))


def _each_date(a: Val) -> Column:
    t = a.dtype.elementType
    return F.transform(a.col, lambda x: parse_date(Val(x, kind_of(t))).col)


def _dates(args: tuple[Val, ...]) -> tuple[Column, Column | None]:
    arrays, ok = [], None
    for a in args:
        if a.many or a.kind == "array":
            arrays.append(_each_date(a))
        else:
            arrays.append(F.array(parse_date(a).col))
    all_ = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return all_, both(ok, ~F.exists(all_, lambda x: x.isNull()) & (F.size(all_) > 0))


@function("mindate")
def _mindate(*args: Val) -> Val:
    xs, ok = _dates(args)
    return Val(show_date(F.array_min(xs)), "text", ok)


@function("maxdate")
def _maxdate(*args: Val) -> Val:
    xs, ok = _dates(args)
    return Val(show_date(F.array_max(xs)), "text", ok)


@function("avgdate")
def _avgdate(*args: Val) -> Val:
    xs, ok = _dates(args)
    total = F.aggregate(xs, F.lit(0).cast("decimal(30,0)"), lambda a, x: (a + F.unix_micros(x)).cast("decimal(30,0)"))
    return Val(show_date(F.timestamp_micros((total / F.greatest(F.size(xs), F.lit(1))).cast("long"))), "text", ok)


# ---- aggregates over all rows ---------------------------------------------------------------------------------------
def _zero(v: Val) -> Column:
    return F.coalesce(raw_double(v), F.lit(0.0))


def row_aggregate(name: str, args: list[Val]) -> Column | None:
    """The aggregate over rows, or None where ``name`` is none."""
    a = args[0]
    if name == "sum":
        return F.coalesce(F.sum(_zero(a)), F.lit(0.0))
    if name == "avg":  # null counts as 0 and is counted
        return F.coalesce(F.sum(_zero(a)) / F.count(F.lit(1)), F.lit(0.0))
    if name == "count":
        return F.count(F.lit(1)).cast("double")
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(_zero(a))
    if name == "median":
        return F.coalesce(F.median(_zero(a)), F.lit(0.0))
    if name in ("mindate", "maxdate"):
        return show_date((F.min if name == "mindate" else F.max)(parse_date(a).col))
    if name == "avgdate":
        return show_date(F.timestamp_micros(F.avg(F.unix_micros(parse_date(a).col)).cast("long")))
    if name in ("countif", "countifs"):
        return F.count_if(_all(args[0::2], args[1::2])).cast("double")
    if name in ("sumif", "averageif"):
        target, test = args[2] if len(args) > 2 else a, criteria(a, args[1].lit)
    elif name in ("sumifs", "averageifs", "minifs", "maxifs"):
        target, test = a, _all(args[1::2], args[2::2])
    else:
        return None
    x = F.when(test, raw_double(target))
    f = {"sum": F.sum, "ave": F.avg, "min": F.min, "max": F.max}[name[:3]](x)
    return f if name[:3] in ("min", "max") else F.coalesce(f, F.lit(0.0))


def _all(ranges: list[Val], tests: list[Val]) -> Column:
    out = F.lit(True)
    for r, c in zip(ranges, tests, strict=True):
        out = out & criteria(r, c.lit)
    return out


ROW_AGGREGATES = {"sum", "avg", "count", "min", "max", "median", "mindate", "maxdate", "avgdate", "countif", "countifs", "sumif", "averageif", "sumifs", "averageifs", "minifs", "maxifs"}
