"""Scripts over a whole table: the rows are the elements of the array ``$``.

Each command becomes DataFrame operations: writes one projection, filters a ``filter``, ``resolve`` a join, ``merge``
and ``compare`` outer joins on keys, decision tables a ``when`` chain, aggregates an aggregation.  Other tables are
named ``$name``; results that are no rows (aggregates, differences) go to ``outputs`` under the name of their path
``$name``.  Order-dependent commands (slices, sorts, last) ask for an explicit order key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import native
from ..functions.native import Unsupported, Val
from ..plans import jsonpath as jp
from ..plans import values
from ..plans.binder import Scope, bind, bind_path, predicate
from ..runtime import materialize

_TABLE = re.compile(r"^\$([A-Za-z_]\w*)(.*)$")


@dataclass
class Result:
    rows: DataFrame
    outputs: dict[str, DataFrame] = field(default_factory=dict)


class Collection:
    def __init__(self, df: DataFrame, order: str | list[str] | None = None, tables: dict[str, DataFrame] | None = None, dialect: str = "classic"):
        self.df = df
        self.dialect = dialect
        self.order = [order] if isinstance(order, str) else list(order or [])
        self.sorted: list[tuple[Column, bool]] | None = None  # since a sortby: keys, and whether each goes down
        self.tables = dict(tables or {})
        self.outputs: dict[str, DataFrame] = {}
        self.extra: set[str] = set()  # columns of aggregates that a command has joined to the rows

    def run(self, script: list[dict]) -> Result:
        i = 0
        while i < len(script):
            c = script[i]
            name = str(c.get("command", "")).lower()
            run = getattr(self, "_" + name, None)
            if run is None:
                raise Unsupported(f"{c.get('command')} over a table")
            if name == "put" and _TABLE.match(str(c.get("path"))):  # neighbouring outputs share one aggregation
                same = [c]
                while i + 1 < len(script) and script[i + 1].get("command") == c["command"] and script[i + 1].get("path") == c["path"] and script[i + 1].get("groupBy") == c.get("groupBy"):
                    i += 1
                    same.append(script[i])
                self._output(same)
            else:
                run(c)
            if self.extra:
                self.df = self.df.drop(*self.extra)
                self.extra = set()
            i += 1
        return Result(self.df, self.outputs)

    # ---- scopes and paths
    def scope(self, **more: Any) -> Scope:
        return Scope(self.df.schema, **{"dialect": self.dialect, **more})

    def need_order(self) -> list[Column]:
        if not self.order:
            raise Unsupported("this command asks for an order key")
        return [F.col(o) for o in self.order]

    def target(self, path: str) -> tuple[Column | None, tuple]:
        """(row condition, segments below the row) of a path."""
        p = jp.parse(path, self.dialect)
        if p.root == "@":
            return None, p.segments
        if not p.segments or not isinstance(p.segments[0], jp.Segment):
            return None, ()
        one = p.segments[0].selectors[0]
        if p.segments[0].deep or len(p.segments[0].selectors) > 1 or not isinstance(one, jp.Wild | jp.Filter):
            raise Unsupported(f"{path} over a table")
        return predicate(one.test, self.scope(rows=False)) if isinstance(one, jp.Filter) else None, p.segments[1:]

    @staticmethod
    def name_of(segments: tuple) -> str:
        if len(segments) != 1 or not isinstance(segments[0], jp.Segment) or segments[0].deep or not isinstance(segments[0].selectors[0], jp.Name):
            raise Unsupported("a property of the row is asked for")
        return segments[0].selectors[0].name

    def table(self, path: str) -> DataFrame:
        m = _TABLE.match(path)
        if path in ("$", "$[*]"):
            return self.df
        if not m or m[1] not in self.tables:
            raise Unsupported(f"no table {path}")
        out = self.tables[m[1]]
        if m[2] not in ("", "[*]"):
            one = jp.parse("$" + m[2]).segments[0].selectors[0]
            if not isinstance(one, jp.Filter):
                raise Unsupported(path)
            out = out.filter(predicate(one.test, Scope(out.schema, rows=False), nullable=True))
        return out

    # ---- writes
    def write(self, mode: str, segments: tuple, value: Val, condition: Column | None) -> None:
        """Adds, sets or puts a property of the row or of a struct or of the elements of an array in it."""
        head = self.name_of(segments[:1])
        there = head in self.df.columns
        if len(segments) == 1:
            guard = condition
            if value.ok is not None:
                guard = value.ok if guard is None else guard & value.ok
            if not there:
                if mode == "set":
                    return
                self.df = self.df.withColumn(head, value.col if guard is None else F.when(guard, value.col))
                return
            old = self.df.schema[head].dataType
            if mode == "add":
                if not isinstance(old, T.ArrayType):
                    return
                grown = F.array_append(F.col(head), value.col.cast(old.elementType))
                self.df = self.df.withColumn(head, grown if guard is None else F.when(guard, grown).otherwise(F.col(head)))
                return
            new = value.col if guard is None else F.when(guard, value.col).otherwise(self._fit(F.col(head), old, value))
            self.df = self.df.withColumn(head, new)
            return
        if not there:
            if mode == "set":
                return
            col = value.col
            for s in reversed(segments[1:]):
                col = F.struct(col.alias(self.name_of((s,))))
            guard = native.both(condition, value.ok)
            self.df = self.df.withColumn(head, col if guard is None else F.when(guard, col))
            return
        if value.ok is not None:
            condition = value.ok if condition is None else condition & value.ok
        new = _deep_write(F.col(head), self.df.schema[head].dataType, segments[1:], value.col, mode)
        self.df = self.df.withColumn(head, new if condition is None else F.when(condition, new).otherwise(F.col(head)))

    @staticmethod
    def _fit(col: Column, old: T.DataType, value: Val) -> Column:
        if value.kind == "text" and not isinstance(old, T.StringType):
            return col.cast("string")
        return col.cast("double") if value.kind == "number" and isinstance(old, T.NumericType) else col

    def value(self, raw: Any, scope: Scope | None = None) -> Val:
        """A value for each row; aggregates over the table inside it are computed once and joined as one row."""
        aggregates: dict[str, Column] = {}
        got = bind(values.parse_value(raw, native.REGISTRY.__contains__), scope or self.scope(aggregates=aggregates))
        if aggregates:
            one = self.df.agg(*[c.alias(n) for n, c in aggregates.items()])
            self.df = self.df.crossJoin(F.broadcast(one))  # exactly one row
            self.extra = self.extra | set(aggregates)
        return got

    def _change(self, mode: str, c: dict) -> None:
        path = c["path"]
        if path == "$" and mode == "put":
            self._whole(c["value"])
            return
        condition, segments = self.target(path)
        if c.get("property") is not None:
            segments = (*segments, jp.Segment((jp.Name(c["property"]),)))
        inner = segments[:-1] and any(isinstance(s, jp.Segment) and isinstance(s.selectors[0], jp.Wild | jp.Filter) for s in segments)
        if inner:
            self._elements(mode, segments, c["value"], condition)
        else:
            self.write(mode, segments, self.value(c["value"]), condition)

    def _elements(self, mode: str, segments: tuple, raw: Any, condition: Column | None) -> None:
        """A property of each element of an array in the row; ``@`` is the element."""
        head, pick, leaf = self.name_of(segments[:1]), segments[1].selectors[0], self.name_of(segments[2:])
        t = self.df.schema[head].dataType
        if not isinstance(t, T.ArrayType) or len(segments) != 3:
            raise Unsupported("one array level")
        scope = self.scope()
        node = values.parse_value(raw, native.REGISTRY.__contains__)

        def each(x: Column) -> Column:
            at = scope.at(Val(x, native.kind_of(t.elementType), dtype=t.elementType))
            v = bind(node, at)
            if mode == "set" and leaf not in t.elementType.names or mode == "add" and leaf in t.elementType.names:
                return x
            new = x.withField(leaf, v.col)
            guard = native.both(v.ok, predicate(pick.test, at) if isinstance(pick, jp.Filter) else None)
            return new if guard is None else F.when(guard, new).otherwise(x.withField(leaf, x.getField(leaf) if leaf in t.elementType.names else F.lit(None).cast(_type_of(v))))

        new = F.transform(F.col(head), each)
        self.df = self.df.withColumn(head, new if condition is None else F.when(condition, new).otherwise(F.col(head)))

    def _add(self, c: dict) -> None:
        self._change("add", c)

    def _set(self, c: dict) -> None:
        self._change("set", c)

    def _put(self, c: dict) -> None:
        self._change("put", c)

    def _remove(self, c: dict) -> None:
        condition, segments = self.target(c["path"])
        if not segments:
            self.df = self.df.filter(~condition) if condition is not None else self.df.limit(0)
        elif segments[0].deep:
            self.df = self.df.select(*[_drop_deep(F.col(f.name), f.dataType, self.name_of((jp.Segment(segments[0].selectors),))).alias(f.name) for f in self.df.schema if f.name != segments[0].selectors[0].name])
        elif condition is not None:
            self.write("set", segments, Val(F.lit(None), "null"), condition)
        elif len(segments) == 1:
            self.df = self.df.drop(*[s.name for s in segments[0].selectors])
        elif len(segments) == 2 and isinstance(segments[1].selectors[0], jp.Filter):
            head = self.name_of(segments[:1])
            t = self.df.schema[head].dataType
            self.df = self.df.withColumn(head, F.filter(F.col(head), lambda x: ~predicate(segments[1].selectors[0].test, self.scope().at(Val(x, native.kind_of(t.elementType), dtype=t.elementType)))))
        else:
            head, rest = self.name_of(segments[:1]), segments[1:]
            t = self.df.schema[head].dataType
            if isinstance(t, T.ArrayType) and isinstance(rest[0].selectors[0], jp.Wild):
                self.df = self.df.withColumn(head, F.transform(F.col(head), lambda x: x.dropFields(".".join(self.name_of((s,)) for s in rest[1:]))))
            else:
                self.df = self.df.withColumn(head, F.col(head).dropFields(".".join(self.name_of((s,)) for s in rest)))

    def _rename(self, c: dict) -> None:
        _, segments = self.target(c["path"])
        old, new = self.name_of(segments), c["name"]
        if old in self.df.columns:
            self.df = self.df.select(*[F.col(f"`{n}`").alias(new if n == old else n) for n in self.df.columns if n == old or n != new])

    def _setproperties(self, c: dict) -> None:
        condition, segments = self.target(c["path"])
        if segments:
            raise Unsupported("setProperties below the row")
        chosen = c.get("properties") or self.df.columns
        node = values.parse_value(c["value"], native.REGISTRY.__contains__)
        out = []
        for f in self.df.schema:
            if f.name in chosen:
                v = bind(node, self.scope().at(native.column(f.name, f.dataType)))
                guard = native.both(v.ok, condition)
                out.append((v.col if guard is None else F.when(guard, v.col).otherwise(self._fit(F.col(f.name), f.dataType, v))).alias(f.name))
            else:
                out.append(F.col(f"`{f.name}`"))
        self.df = self.df.select(*out)

    def _transfer(self, c: dict, move: bool) -> None:
        condition, source = self.target(c["fromPath"])
        _, to = self.target(c["toPath"])
        v = bind_path(jp.Path("@", source), self.scope())
        if c.get("destinationAsArray"):
            v = Val(F.array(v.col), "array", v.ok, dtype=T.ArrayType(v.dtype))
        name = self.name_of(to[:1])
        grown = len(to) == 1 and name in self.df.columns and isinstance(self.df.schema[name].dataType, T.ArrayType) and v.kind != "array"
        self.write("add" if grown else "put", to, v, condition)
        if move:
            self._remove({"path": c["fromPath"]})

    def _copy(self, c: dict) -> None:
        self._transfer(c, False)

    def _move(self, c: dict) -> None:
        self._transfer(c, True)

    # ---- control
    def _foreach(self, c: dict) -> None:
        if c["path"] != "$":
            raise Unsupported("forEach over the table is path $")
        for inner in c.get("commands") or []:
            getattr(self, "_" + str(inner["command"]).lower())(inner)

    _with = _foreach

    def _ifelse(self, c: dict) -> None:
        """Both branches are computed, each written column is chosen by the condition."""
        test = native.flag(self.value(c["condition"]))
        self.df = _choose(self.df.withColumn("if_", test), c, self)

    def _decisiontable(self, c: dict) -> None:
        """Few rules: one chain of conditions by priority; every output is one column."""
        condition, segments = self.target(c.get("path", "$[*]"))
        if segments:
            raise Unsupported("decision tables over rows")
        t = c["decisionTable"]
        inputs = {i["name"]: self.value(i["path"]) for i in t.get("inputs") or []}
        rules = [(r.get("priority", 0), i, r) for i, r in enumerate(t.get("rules") or [])]
        strategy = t.get("strategy") or {}
        mode = str(strategy.get("mode", "firstMatch")).lower()
        how = str(strategy.get("conflictResolution", "priority")).lower()
        rules.sort(key=lambda r: (-(len(r[2].get("conditions") or {}) * 100 - r[0]), r[1]) if mode == "bestmatch" else (r[0], r[1]))
        holds = [_rule(r, inputs) for _, _, r in rules]
        names = list(dict.fromkeys([o["name"] for o in t.get("outputs") or []] + [k for _, _, r in rules for k in r.get("results") or {}] + list(t.get("defaultResults") or {})))
        paths = {o["name"]: o.get("path") or str(t.get("outputPathTemplate", "@.{name}")).replace("{name}", o["name"]) for o in t.get("outputs") or []}
        writes = []
        for name in names:
            hits = [(h, r["results"][name]) for h, (_, _, r) in zip(holds, rules, strict=True) if name in (r.get("results") or {})]
            default = (t.get("defaultResults") or {}).get(name)
            any_rule = F.lit(False)
            for h in holds:
                any_rule = any_rule | h
            if mode in ("firstmatch", "bestmatch"):
                chain: list[tuple[Column, Any]] = [(h, (r.get("results") or {}).get(name, ...)) for h, (_, _, r) in zip(holds, rules, strict=True)]
            elif how == "merge" and all(isinstance(v, list) for _, v in hits) and hits:
                col = F.concat(*[F.when(h, F.array(*map(F.lit, v))).otherwise(F.array().cast(T.ArrayType(T.StringType() if isinstance(v[0], str) else T.DoubleType()))) for h, v in hits])
                writes.append((name, Val(F.when(any_rule, col).otherwise(native.literal(default).col) if default is not None else F.when(any_rule, col), "array")))
                continue
            elif how == "merge" and all(isinstance(v, int | float) and not isinstance(v, bool) for _, v in hits) and hits:
                col = F.greatest(*[F.when(h, F.lit(float(v))) for h, v in hits], F.lit(None).cast("double"))
                writes.append((name, Val(F.when(any_rule, col).otherwise(F.lit(default)), "number")))
                continue
            else:
                chain = list(reversed(hits)) if how in ("lastwins", "merge") else hits
            vals = [self.value(v) if v is not ... else Val(F.lit(None), "null") for _, v in chain]
            kinds = {v.kind for v in vals if v.kind != "null"} | ({native.literal(default).kind} if default is not None else set())
            cast = (lambda v: v.col) if len(kinds) <= 1 else (lambda v: native.text(v).col if v.kind != "null" else v.col)
            out = None
            for (h, _), v in zip(chain, vals, strict=True):
                out = F.when(h, cast(v)) if out is None else out.when(h, cast(v))
            last = cast(self.value(default)) if default is not None else F.lit(None)
            if mode == "allmatches" and out is not None:
                out = out.when(any_rule, F.lit(None))
            writes.append((name, Val(last if out is None else out.otherwise(last), next(iter(kinds)) if len(kinds) == 1 else "text")))
        for name, v in writes:
            self.write("put", jp.parse(paths.get(name, f"@.{name}")).segments, v, condition)

    # ---- joins
    def _resolve(self, c: dict) -> None:
        """A left join for each setting; targets keep one row each."""
        condition, segments = self.target(c["path"])
        if segments or condition is not None:
            raise Unsupported("resolve over rows")
        for s in c["resolveSettings"]:
            refs = self.table(s["referencesCollectionPath"])
            self.df = self._lookup(refs, s)

    def _lookup(self, refs: DataFrame, s: dict) -> DataFrame:
        keys = s["resolveKeys"]
        left, right, conditions = self.df, refs, []
        mine, theirs = self.scope(rows=False), Scope(refs.schema, rows=False)
        lk, rk, rk_whole, rk_many, bound = [], [], [], [], []
        overlap = False
        for i, k in enumerate(keys):
            a, b = (bind_path(jp.Path("@", jp.parse(p if p[:1] in "@$" else "@." + p).segments), sc) for p, sc in ((k["keyPath"], mine), (k["referenceKeyPath"], theirs)))
            overlap |= a.many or b.many
            bound.append(a)
            rk_whole.append((F.array_distinct(b.col) if b.many else b.col).alias(f"r{i}_"))
            rk_many.append(b.many)
            lk.append((F.explode(F.array_distinct(a.col)) if a.many else a.col).alias(f"l{i}_"))
            rk.append((F.explode(F.array_distinct(b.col)) if b.many else b.col).alias(f"r{i}_"))
            conditions.append(F.col(f"l{i}_") == F.col(f"r{i}_"))
        specs = s["values"]
        picked = []
        for i, v in enumerate(specs):
            got = bind(values.parse_value(v.get("value", "@"), native.REGISTRY.__contains__), theirs)
            picked.append(got.col.alias(f"v{i}_"))
        order = F.struct(*[F.col(o) for o in s.get("order") or []]) if s.get("order") else None
        on = conditions[0]
        for x in conditions[1:]:
            on = on & x
        # the references are grouped by their key first, so each target meets one row and keeps its own
        packed = right.select(*rk, F.struct(*([order.alias("o_")] if order is not None else []), *picked).alias("p_"))
        behaviours = [str(v.get("resolveTypeBehavior", "DependingOnResult")).lower() for v in specs]
        # only an array needs all matches; else the first and their number are enough, however many share a key
        gathered = F.array_sort(F.collect_list("p_")) if "alwaysasarray" in behaviours else F.array_repeat(F.min("p_"), F.least(F.count("p_"), F.lit(2)).cast("int"))
        if overlap:
            # a row's keys stand for it: rows with equal keys have equal matches, and only the keys travel
            sides = [F.array_sort(F.array_distinct(a.col)) if a.many else a.col for a in bound]
            row = F.struct(*[F.xxhash64(F.lit(n), *[x.cast("array<string>") if a.many else x for x, a in zip(sides, bound, strict=True)]) for n in (1, 2)])
            keyed = left.withColumn("row_", row)
            exploded = keyed.groupBy("row_").agg(*[F.first(x).alias(f"s{i}_") for i, x in enumerate(sides)])
            for i, a in enumerate(bound):
                exploded = exploded.withColumn(f"l{i}_", F.explode(f"s{i}_") if a.many else F.col(f"s{i}_"))
            # a reference that meets a row by several keys is one match: it is known by a number of its own
            numbered = right.withColumn("ref_", F.monotonically_increasing_id())
            parts = numbered.select("ref_", F.struct(*([order.alias("o_")] if order is not None else []), *picked).alias("p_"), *rk_whole)
            for i, many in enumerate(rk_many):
                parts = parts.withColumn(f"r{i}_", F.explode(f"r{i}_")) if many else parts
            hits = exploded.join(parts, on).groupBy("row_", "ref_").agg(F.first("p_").alias("p_")).groupBy("row_").agg(gathered.alias("hits_"))
            joined = keyed.join(hits, "row_", "left").drop("row_")
        else:
            grouped = packed.groupBy(*[f"r{i}_" for i in range(len(keys))]).agg(gathered.alias("hits_"))
            joined = left.select("*", *lk).join(grouped, on, "left").drop(*[f"l{i}_" for i in range(len(keys))], *[f"r{i}_" for i in range(len(keys))])
        out = joined
        for i, (v, how) in enumerate(zip(specs, behaviours, strict=True)):
            found = _field(F.coalesce(F.col("hits_"), F.array().cast(joined.schema["hits_"].dataType)), f"v{i}_")
            name = self.name_of(jp.parse(v["targetPath"] if v["targetPath"][:1] in "@$" else "@." + v["targetPath"]).segments)
            if how == "alwaysasarray":
                col = found
            elif how == "alwaysasobject":
                col = F.when(F.size(found) <= 1, F.get(found, F.lit(0)))
            else:  # a column has one type: the first match; ask for AlwaysAsArray where there can be more
                col = F.get(found, F.lit(0))
            if name in left.columns and how != "alwaysasarray":
                col = F.when(F.size(found) > 0, col).otherwise(F.col(name))
            out = out.withColumn(name, col)
        return out.drop("hits_")

    def _merge(self, c: dict) -> None:
        """Rows of another table into ``$``: by keys an outer join, without keys an append."""
        source = self.table(c.get("path") or c.get("fromPath"))
        settings = c.get("settings") or {}
        strategy = str(settings.get("strategy", "fullMerge")).lower()
        own = next(iter(settings.get("arraySettings") or []), {})
        keys = [self.name_of(jp.parse(k if k[:1] in "@$" else "@." + k).segments) for k in own.get("keyPaths") or (settings.get("matchSettings") or {}).get("keyPaths") or []]
        mode = str(c.get("arrayMergeMode") or "").lower()
        if mode == "replace":
            self.df = source
        elif keys:
            names = list(dict.fromkeys([*self.df.columns, *source.columns]))
            rest = [n for n in names if n not in keys]
            s = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.struct(*[F.col(n) for n in source.columns if n not in keys] or [F.lit(1).alias("x_")]).alias("s_"), F.lit(True).alias("in_s_"))
            on = None
            for k in keys:
                x = self.df[k].eqNullSafe(s[f"s_{k}"])
                on = x if on is None else on & x
            t = self.df.withColumn("in_t_", F.lit(True))
            j = t.join(s, on, "left" if strategy == "onlyvalues" else "full")
            out = [F.coalesce(F.col(k), F.col(f"s_{k}")).alias(k) for k in keys]
            for n in rest:
                mine, theirs = n in self.df.columns, n in source.columns
                if not theirs:
                    out.append(F.col(n))
                elif not mine:
                    if strategy != "onlyvalues":
                        out.append(F.col("s_").getField(n).alias(n))
                elif strategy == "onlystructure":
                    out.append(F.when(F.col("in_t_"), F.col(n)).otherwise(F.col("s_").getField(n)).alias(n))
                else:
                    out.append(F.when(F.col("in_s_"), F.col("s_").getField(n)).otherwise(F.col(n)).alias(n))
            picked = {n: i for i, n in enumerate([*keys, *[n for n in rest if n in self.df.columns or strategy != "onlyvalues"]])}
            self.df = j.select(*[out[i] for i in picked.values()])
        elif own.get("uniqueItemsWithoutKeys") or mode == "mergebykey":
            # only incoming duplicates go: EXCEPT DISTINCT is null-safe and also drops the source's own
            both = self.df.limit(0).unionByName(source, allowMissingColumns=True)
            self.df = self.df.unionByName(both.subtract(self.df))
        else:
            self.df = self.df.unionByName(source, allowMissingColumns=True)

    def _compare(self, c: dict) -> None:
        """Differences of two tables by key, as rows of ``outputs``; of two properties of the row, as a property."""
        first, second = c["firstPath"], c["secondPath"]
        settings = c.get("settings") or {}
        own = next(iter(settings.get("arraySettings") or []), {})
        if not own:
            a, b = (bind(values.parse_value(p), self.scope(rows=False)) for p in (first, second))
            x, y = native.raw_double(a), native.raw_double(b)
            equal = native.loose(a, b) | F.coalesce(F.abs(x - y) <= 1e-10, F.lit(False))
            gt, lt = native.compare(a, b, lambda p, q: p > q), native.compare(a, b, lambda p, q: p < q)
            out = F.when(equal, "equal").when(gt, "greater").when(lt, "less").otherwise("different")
            self.write("put", jp.parse(c["resultPath"]).segments, Val(out, "text"), None)
            return
        keys = [self.name_of(jp.parse(k if k[:1] in "@$" else "@." + k).segments) for k in own["keyPaths"]]
        self.outputs[_TABLE.match(c["resultPath"])[1]] = compare_tables(self.table(first), self.table(second), keys, settings.get("resultTypes"))

    # ---- outputs and whole-table values
    def _output(self, commands: list[dict]) -> None:
        name = _TABLE.match(commands[0]["path"])[1]
        aggregates: dict[str, Column] = {}
        scope = self.scope(aggregates=aggregates)
        out = []
        for c in commands:
            v = bind(values.parse_value(c["value"], native.REGISTRY.__contains__), scope)
            out.append((v.col if v.ok is None else F.when(v.ok, v.col)).alias(c.get("property") or "value"))
        groups = commands[0].get("groupBy") or []
        grouped = self.df.groupBy(*groups) if groups else self.df
        self.outputs[name] = grouped.agg(*[a.alias(n) for n, a in aggregates.items()]).select(*groups, *out)

    def _whole(self, raw: Any) -> None:
        """``put $``: a slice, sortby, sort, distinct, last or schema shaping of the table."""
        node = values.parse_value(raw, lambda n: True)
        if isinstance(node, values.PathValue):
            self.df = self._slice(node.text)
            return
        if not isinstance(node, values.Call):
            raise Unsupported("a value for the whole table")
        texts = [getattr(a, "value", getattr(a, "text", None)) for a in node.args]
        if node.name == "distinct":
            self.df = self._slice(texts[0]).dropDuplicates()
        elif node.name in ("sortby", "sort"):
            down = len(texts) > 2 and str(texts[2]).lower() == "desc"
            self.df = self._slice(texts[0])
            self.sorted = self.sort_keys(str(texts[1]), down)
            self.df = self.df.orderBy(*self.ordering())
        elif node.name == "last":
            self.df = self.df.orderBy(*self.ordering(back=True)).limit(1)
        elif node.name == "partial":
            i = int(texts[1]) if len(texts) > 1 and isinstance(texts[1], int | float) else 0
            self.df = self._slice(f"$[{i}:{i + 1}]")
        elif node.name in ("filterbyschema", "orderbyschema"):
            shape = texts[0] if isinstance(texts[0], dict) else None
            if shape is None:
                raise Unsupported("a literal schema")
            names = [n for n in (shape.get("items") or shape).get("properties") or {} if n in self.df.columns]
            rest = [] if node.name == "filterbyschema" else [n for n in self.df.columns if n not in names]
            self.df = self.df.select(*names, *rest)
        else:
            raise Unsupported(f"{node.name} of the table")

    def ordering(self, back: bool = False) -> list[Column]:
        """The order of the table: that of the last sortby, else of the order key; from the end with ``back``."""
        keys = [(o, False) for o in self.need_order()] if self.sorted is None else self.sorted
        return [k.desc() if down != back else k.asc() for k, down in keys]

    def sort_keys(self, key: str, down: bool) -> list[tuple[Column, bool]]:
        """Missing keys last in both directions; the order key keeps equal ones stable."""
        name = key.removeprefix("@.")
        v = bind_path(jp.parse("@." + name), self.scope(rows=False))
        k = v.col if v.kind in ("number", "date") else native.text(v).col
        return [(v.col.isNull(), False), (k, down), *[(F.col(o), False) for o in self.order]]

    def _slice(self, path: str) -> DataFrame:
        p = jp.parse(path)
        if not p.segments or isinstance(p.segments[0].selectors[0], jp.Wild):
            return self.df
        s = p.segments[0].selectors[0]
        if isinstance(s, jp.Filter):
            return self.df.filter(predicate(s.test, self.scope(rows=False), nullable=True))
        if isinstance(s, jp.Index):
            s = jp.Slice(s.index, s.index + 1 or None, None)
        if not isinstance(s, jp.Slice):
            raise Unsupported(path)
        step = 1 if s.step is None else s.step
        if step == 0:
            return self.df.limit(0)
        order = self.ordering()
        if step < 0 or (s.stop is not None and s.stop < 0) or ((s.start or 0) < 0 and (s.stop is not None or step != 1)):
            return self._counted(s, order, step)
        start, stop = s.start or 0, s.stop
        if start >= 0 and stop is not None and stop >= 0 and step == 1:
            return self.df.orderBy(*order).offset(start).limit(max(0, stop - start)) if start else self.df.orderBy(*order).limit(stop)
        if start < 0 and stop is None and step == 1:
            return self.df.orderBy(*self.ordering(back=True)).limit(-start)
        ranked = ranks(self.df, order, "i_")
        keep = F.lit(True)
        if start > 0:
            keep = keep & (F.col("i_") >= start)
        if stop is not None:
            keep = keep & (F.col("i_") < stop)
        return ranked.filter(keep & ((F.col("i_") - start) % step == 0)).drop("i_")

    def _counted(self, s: jp.Slice, order: list[Column], step: int) -> DataFrame:
        """A slice that counts from the end, or goes back: bounds as in a list, from the number of rows."""
        ranked = ranks(self.df, order, "i_")
        n = ranked.count()
        place = lambda x: x + n if x < 0 else x
        if step > 0:
            low, high = min(max(place(s.start or 0), 0), n), n if s.stop is None else min(max(place(s.stop), 0), n)
            return ranked.filter((F.col("i_") >= low) & (F.col("i_") < high) & ((F.col("i_") - low) % step == 0)).drop("i_")
        high = n - 1 if s.start is None else min(max(place(s.start), -1), n - 1)
        low = -1 if s.stop is None else min(max(place(s.stop), -1), n - 1)
        back = ranked.filter((F.col("i_") <= high) & (F.col("i_") > low) & ((F.lit(high) - F.col("i_")) % -step == 0))
        return back.orderBy(F.col("i_").desc()).drop("i_")

    def _flatten(self, c: dict) -> None:
        s = c.get("flattenSettings") or {}
        self.df = flatten_structs(self.df, s.get("delimiter", "."))

    def _restore(self, c: dict) -> None:
        s = c.get("restoreSettings") or {}
        self.df = restore_structs(self.df, s.get("delimiter", "."))

    def _tocsv(self, c: dict) -> None:
        self.outputs["csv"] = csv_lines(self.df, c.get("csvSettings") or {})


def _field(arr: Column, name: str) -> Column:
    return F.transform(arr, lambda p: p[name])


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based positions in the order, without bringing all rows to one task: range partitions, their sizes, offsets."""
    # written once: both readers below must see the same partitions
    parts = materialize(df.repartitionByRange(*order).withColumn("p_", F.spark_partition_id()), "ranks")
    local = parts.withColumn("r_", F.row_number().over(W.partitionBy("p_").orderBy(*order)))
    sizes = parts.groupBy("p_").agg(F.count("*").alias("n_"))
    before = sizes.select("p_", (F.sum("n_").over(W.orderBy("p_")) - F.col("n_")).alias("b_"))  # a row for each partition
    return local.join(before, "p_").withColumn(name, F.col("r_") + F.col("b_") - 1).drop("p_", "r_", "b_")


def _type_of(v: Val) -> T.DataType:
    if v.dtype is not None:
        return v.dtype
    return {"number": T.DoubleType(), "bool": T.BooleanType()}.get(v.kind, T.StringType())


def _deep_write(col: Column, t: T.DataType, segments: tuple, value: Column, mode: str) -> Column:
    """The struct with a nested property written."""
    if not isinstance(t, T.StructType):
        return col
    name = Collection.name_of(segments[:1])
    if len(segments) == 1:
        if (mode == "set" and name not in t.names) or (mode == "add" and name in t.names):
            return col
        return col.withField(name, value)
    if name not in t.names:
        if mode == "set":
            return col
        inner = value
        for s in reversed(segments[1:]):
            inner = F.struct(inner.alias(Collection.name_of((s,))))
        return col.withField(name, inner)
    return col.withField(name, _deep_write(col.getField(name), t[name].dataType, segments[1:], value, mode))


def _drop_deep(col: Column, t: T.DataType, name: str) -> Column:
    if isinstance(t, T.StructType):
        kept = [_drop_deep(col.getField(f.name), f.dataType, name).alias(f.name) for f in t if f.name != name]
        return F.when(col.isNotNull(), F.struct(*kept)) if kept else col
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return F.transform(col, lambda x: _drop_deep(x, t.elementType, name))
    return col


def _choose(named: DataFrame, c: dict, owner: Collection) -> DataFrame:
    """One projection: each branch's commands run with ``if_`` or its negation as their row condition."""
    out = named
    for script, test in ((c.get("ifScript"), F.col("if_")), (c.get("elseScript"), ~F.col("if_"))):
        for inner in script or []:
            name = str(inner["command"]).lower()
            owner.df = out
            if name in ("add", "set", "put"):
                condition, segments = owner.target(inner["path"])
                if inner.get("property") is not None:
                    segments = (*segments, jp.Segment((jp.Name(inner["property"]),)))
                owner.write(name, segments, owner.value(inner["value"]), test if condition is None else condition & test)
            elif name in ("copy", "move"):
                _, source = owner.target(inner["fromPath"])
                _, to = owner.target(inner["toPath"])
                owner.write("put", to, bind_path(jp.Path("@", source), owner.scope()), test)
                if name == "move":
                    owner.write("set", source, Val(F.lit(None), "null"), test)
            elif name == "remove":
                _, segments = owner.target(inner["path"])
                owner.write("set", segments, Val(F.lit(None), "null"), test)
            else:
                raise Unsupported(f"{name} inside ifElse over a table")
            out = owner.df
    return out.drop("if_")


def _rule(rule: dict, inputs: dict[str, Val]) -> Column:
    out = F.lit(True)
    for name, wanted in (rule.get("conditions") or {}).items():
        if name not in inputs:
            return F.lit(False)
        v = inputs[name]
        test = condition(v, wanted)
        out = out & (test if v.ok is None else test & v.ok)
    return out


_CONDITION = re.compile(r"\s*(<=|>=|!=|=|<|>)\s*(.*)$", re.S)


def condition(v: Val, wanted: Any) -> Column:
    """A decision table's condition as a column that is never null."""
    if isinstance(wanted, list):
        out = F.lit(False)
        for w in wanted:
            out = out | condition(v, w)
        return out
    if not isinstance(wanted, str):
        return native.loose(v, native.literal(wanted))
    any_ = F.lit(False)
    for part in wanted.split("||"):
        all_ = F.lit(True)
        for p in part.split("&&"):
            m = _CONDITION.match(p)
            op, operand = (m[1], m[2].strip()) if m else ("=", p.strip())
            operand = operand[1:-1] if len(operand) > 1 and operand[0] == operand[-1] == "'" else operand
            lit = native.literal(None if operand == "null" else float(operand) if v.kind == "number" and re.fullmatch(r"-?\d+(\.\d+)?", operand) else operand)
            if op in ("=", "!="):
                same = native.loose(v, lit)
                all_ = all_ & (same if op == "=" else ~same)
            else:
                all_ = all_ & native.compare(v, lit, {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op])
        any_ = any_ | all_
    return any_


def compare_tables(first: DataFrame, second: DataFrame, keys: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Differences by key: one row per missing key and per differing property (full outer join, then a stack)."""
    common = [n for n in first.columns if n in second.columns and n not in keys]
    a = first.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*common).alias("a_"), F.lit(True).alias("in_a"))
    b = second.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*common).alias("b_"), F.lit(True).alias("in_b"))
    on = None
    for k in keys:
        x = F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        on = x if on is None else on & x
    j = a.join(b, on, "full")
    rec = lambda kind, sub, prop, x, y: F.struct(F.lit(kind).alias("differenceType"), F.lit(sub).alias("differenceSubType"), F.lit(prop).alias("property"), x.alias("firstValue"), y.alias("secondValue"))
    null = F.lit(None).cast("string")
    parts = [F.when(F.col("in_b").isNull(), rec("arrayDifference", "missingInSecond", None, null, null)), F.when(F.col("in_a").isNull(), rec("arrayDifference", "missingInFirst", None, null, null))]
    for n in common:
        x, y = F.col("a_").getField(n), F.col("b_").getField(n)
        close = F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= 1e-10, F.lit(False)) if isinstance(first.schema[n].dataType, T.NumericType) and isinstance(second.schema[n].dataType, T.NumericType) else F.lit(False)
        differs = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~(x.eqNullSafe(y) | close)
        parts.append(F.when(differs, rec("valueDifference", "notEquals", n, x.cast("string"), y.cast("string"))))
    rows = j.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], F.explode(F.filter(F.array(*parts), lambda r: r.isNotNull())).alias("d_"))
    out = rows.select(*keys, "d_.*")
    return out.filter(F.col("differenceType").isin([f"{k}Difference" if not k.endswith("Difference") else k for k in kinds])) if kinds else out


def structural_changes(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, path, before, after): both tables as (path, value) rows; mutate, add, remove, and rename where a
    removed and an added property of one row hold the same value."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rest = [n for n in df.columns if n not in keys]
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(n).cast("string").alias(name)) for n in rest])).alias("p")).select(*keys, "p.path", f"p.{name}", F.lit(True).alias(f"has_{name}"))

    j = long(first, "before").join(long(second, "after"), [*keys, "path"], "full")
    kind = F.when(F.col("has_before").isNull(), "add").when(F.col("has_after").isNull(), "remove").when(~F.col("before").eqNullSafe(F.col("after")), "mutate")
    changes = j.select(*keys, "path", "before", "after", kind.alias("kind")).filter("kind is not null")
    nth = lambda v: F.row_number().over(W.partitionBy(*keys, "kind", v).orderBy("path"))
    gone = changes.filter("kind = 'remove' and before is not null").withColumn("n", nth("before"))
    new = changes.filter("kind = 'add' and after is not null").withColumn("n", nth("after")).select(*keys, F.col("path").alias("to"), F.col("after").alias("value"), "n")
    pairs = gone.join(new, [*keys, "n"]).filter(F.col("before") == F.col("value")).select(*keys, "path", "to", "before")
    renames = pairs.select(*keys, F.concat("path", F.lit(" -> "), "to").alias("path"), F.col("before"), F.col("before").alias("after"), F.lit("rename").alias("kind"))
    used = pairs.select(*keys, F.col("path")).unionByName(pairs.select(*keys, F.col("to").alias("path")))
    return changes.join(used.distinct(), [*keys, "path"], "left_anti").select(*keys, "path", "before", "after", "kind").unionByName(renames)


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every leaf of nested structs as a column named by its path; arrays stay."""
    out: list[Column] = []

    def walk(col: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t:
                walk(col.getField(f.name), f.dataType, f"{name}{sep}{f.name}")
        else:
            out.append(col.alias(name))

    for f in df.schema:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def restore_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs from columns named by paths."""
    tree: dict = {}
    for n in df.columns:
        node = tree
        *way, leaf = n.split(sep)
        for p in way:
            node = node.setdefault(p, {})
        node[leaf] = n

    def build(node: Any, name: str) -> Column:
        if isinstance(node, str):
            return F.col(f"`{node}`").alias(name)
        return F.struct(*[build(v, k) for k, v in node.items()]).alias(name)

    return df.select(*[build(v, k) for k, v in tree.items()])


def csv_lines(df: DataFrame, s: dict) -> DataFrame:
    """One line of CSV text per row, columns in ordinal order; quoting and null and boolean forms by the settings."""
    sep, quote_all, esc = s.get("delimiter", ","), s.get("quoteAllFields", False), s.get("escapeQuoteChar", '"')
    flags = str(s.get("booleanFormat", "true,false")).split(",")
    names = sorted(n for n in df.columns if not n.startswith("_") and "Metadata" not in n and (s.get("includeTypeColumns") or not n.endswith(s.get("typeColumnSuffix", "_type"))))
    cells = []
    for n in names:
        v = native.column(n, df.schema[n].dataType)
        if v.kind == "bool":
            t = F.when(v.col, flags[0]).otherwise(flags[-1])
        elif v.kind == "text":
            low, x = F.lower(v.col), native.raw_double(v)
            t = F.when(low == "true", flags[0]).when(low == "false", flags[-1]).when(x.isNotNull(), native.text(Val(x, "number")).col).otherwise(v.col)
        else:
            t = native.text(v).col
        t = F.when(v.col.isNull(), F.lit(s.get("nullValueRepresentation", ""))).otherwise(t)
        quoted = F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit(esc + '"')), F.lit('"'))
        cells.append(quoted if quote_all else F.when(t.rlike('["\\r\\n]|' + re.escape(sep)), quoted).otherwise(t))
    return df.select(F.concat_ws(sep, *cells).alias("line"))
