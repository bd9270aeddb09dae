"""The front door: scripts over DataFrames of documents, and the multi-format runner.

``Engine().documents(df, script)`` runs a script over one document per row (the dynamic tier, Arrow batches);
``Engine().rows(df, script, key)`` takes the table itself as the array ``$`` (the native tier: plain DataFrame
operations, see ``operators.collection``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dynamic
from .operators import interpreter
from .runtime import ship_package
from .sources import formats, scripts

TRACE = "array<struct<command:string,path:string,outcome:string,matched:int,detail:string>>"
_TRACE = pa.list_(pa.struct([("command", pa.string()), ("path", pa.string()), ("outcome", pa.string()), ("matched", pa.int32()), ("detail", pa.string())]))


class Engine:
    """A set of commands and functions, and the dialect of its paths."""

    def __init__(self, dialect: str = "classic"):
        self.dialect = dialect
        self.functions: dict[str, Callable] = dict(dynamic.REGISTRY)
        self.commands: dict[str, Callable] = {}

    def function(self, name: str, run: Callable) -> Engine:
        """Register ``run(context, *arguments)`` as a function of scripts."""
        self.functions[name.lower()] = run
        return self

    def command(self, name: str, run: Callable) -> Engine:
        """Register ``run(state, command)`` as a command; it returns how many nodes it changed."""
        self.commands[name.lower()] = run
        return self

    def without(self, *packs: str) -> Engine:
        """Leave whole packs of functions out: math, text, date."""
        for n, p in dynamic.PACKS.items():
            if p in packs:
                self.functions.pop(n, None)
        return self

    def validate(self, script: str | list) -> list[str]:
        return scripts.validate(scripts.parse(script), set(interpreter.COMMANDS) | set(self.commands), set(self.functions))

    def run(self, script: str | list, document: Any) -> tuple[Any, bool, list[interpreter.Trace]]:
        """One document in this process."""
        out, ok, state = interpreter.run(scripts.parse(script), document, self.dialect, self.functions, self.commands)
        return out, ok, state.trace

    def compile(self, script: str | list, source: str = "json", target: str | None = None) -> Callable[[str], tuple[str | None, bool, list]]:
        """text -> (text, ok, trace); a top-level ``convert`` ends a section and changes the format."""
        sections = split(scripts.parse(script), source)
        dialect, functions, commands = self.dialect, self.functions, self.commands
        parsed: dict = {}

        def work(text: str | None) -> tuple[str | None, bool, list]:
            if text is None:
                return None, False, []
            trace: list[interpreter.Trace] = []
            ok, at = True, source
            for section in sections:
                try:
                    if section["format"] != at:
                        text = formats.convert(text, at, section["format"], section["settings"])
                        at = section["format"]
                    if section["script"]:
                        named = formats.ADAPTERS[at].named
                        tree = formats.ADAPTERS[at].read(text, formats.Settings.read(section["settings"]))
                        root, body = next(iter(tree.items())) if named else (None, tree)
                        body, good, state = interpreter.run(section["script"], body, dialect, functions, commands, parsed)
                        trace += state.trace
                        ok &= good  # a failure in one section does not stop the next
                        text = formats.write_xml(body, formats.Settings.read(section["settings"]), root) if named else formats.write(body, at)
                except formats.FormatError as e:
                    trace.append(interpreter.Trace("convert", "", "failure", 0, str(e)))
                    ok = False
            if target and target != at and text is not None:
                try:
                    text = formats.convert(text, at, target)
                except formats.FormatError as e:
                    trace.append(interpreter.Trace("convert", "", "failure", 0, str(e)))
                    ok = False
            return text, ok, trace

        return work

    def documents(self, df: DataFrame, script: str | list, column: str = "doc", source: str = "json", target: str | None = None) -> DataFrame:
        """``df`` with the column's documents transformed, and new columns ok and trace.  Row-local: no shuffle, and
        streams pass as well as tables.  A null document stays null with ok false."""
        work = self.compile(script, source, target)
        ship_package(df.sparkSession)
        at = df.columns.index(column)
        schema = T.StructType([*[T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in df.schema], *T.StructType.fromDDL(f"ok boolean, trace {TRACE}")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [work(v) for v in batch.column(at).to_pylist()]
                texts, oks, traces = zip(*done, strict=True) if done else ((), (), ())
                arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
                rows = [[t.__dict__ for t in tr] for tr in traces]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(oks, pa.bool_()), pa.array(rows, _TRACE)], [*batch.schema.names, "ok", "trace"])

        return df.mapInArrow(run, schema)

    def transform(self, df: DataFrame, script: str | list, json_fallback: bool = False) -> DataFrame:
        """Each row is a document of the table's schema: columns in, columns out (native tier).  What the schema cannot
        decide raises Unsupported, or with ``json_fallback`` runs over the rows as JSON: (doc, ok, trace)."""
        from .functions.native import Unsupported
        from .operators import document

        try:
            return document.transform(df, script)
        except Unsupported:
            if not json_fallback:
                raise
            text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
            return self.documents(df.select(text.alias("doc")), script)

    def rows(self, df: DataFrame, script: str | list, order: str | list[str] | None = None, tables: dict[str, DataFrame] | None = None):
        """The table as the array ``$``; see :class:`docweave.operators.collection.Collection`."""
        from .operators.collection import Collection

        return Collection(df, order, tables, self.dialect).run(scripts.parse(script))


def split(script: list[dict], source: str) -> list[dict]:
    """Sections between top-level ``convert`` commands: format, settings and script of each."""
    out = [{"format": source, "settings": {}, "script": []}]
    for c in script:
        if str(c.get("command", "")).lower() == "convert":
            out.append({"format": str(c["to"]).lower(), "settings": c.get("settings") or {}, "script": []})
        else:
            out[-1]["script"].append(c)
    return out


class Script:
    """A script built call by call."""

    def __init__(self) -> None:
        self.commands: list[dict] = []

    def _add(self, command_: str, **keys: Any) -> Script:
        self.commands.append({"command": command_, **{k: v.commands if isinstance(v, Script) else v for k, v in keys.items() if v is not None}})
        return self

    def add(self, path: str, value: Any, property: str | None = None) -> Script:
        return self._add("add", path=path, value=value, property=property)

    def set(self, path: str, value: Any, property: str | None = None) -> Script:
        return self._add("set", path=path, value=value, property=property)

    def put(self, path: str, value: Any, property: str | None = None) -> Script:
        return self._add("put", path=path, value=value, property=property)

    def remove(self, path: str) -> Script:
        return self._add("remove", path=path)

    def rename(self, path: str, name: str) -> Script:
        return self._add("rename", path=path, name=name)

    def copy(self, source: str, to: str) -> Script:
        return self._add("copy", fromPath=source, toPath=to)

    def move(self, source: str, to: str) -> Script:
        return self._add("move", fromPath=source, toPath=to)

    def compare(self, first: str, second: str, result: str, settings: dict | None = None) -> Script:
        return self._add("compare", firstPath=first, secondPath=second, resultPath=result, settings=settings)

    def merge(self, source: str, target: str, settings: dict | None = None, array_mode: str | None = None) -> Script:
        return self._add("merge", path=source, targetPath=target, settings=settings, arrayMergeMode=array_mode)

    def if_else(self, condition: Any, then: Script, otherwise: Script | None = None) -> Script:
        return self._add("ifElse", condition=condition, ifScript=then, elseScript=otherwise)


def read_documents(spark, path: str, column: str = "doc") -> DataFrame:
    """One whole file per row, by Spark's reader: (path, doc)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias(column))
