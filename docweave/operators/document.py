"""Document mode, native tier: each row is a document whose schema is known; ``$`` is the row.

Writes, lookups and loops over arrays inside the row become one projection after another, which Catalyst collapses;
nothing is shuffled.  What the schema cannot decide raises Unsupported: use the dynamic tier for those scripts.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.native import Unsupported
from ..plans import jsonpath as jp
from ..plans.binder import Scope
from .collection import Collection

LOCAL = {"add", "set", "put", "remove", "rename", "copy", "move", "setproperties", "ifelse", "decisiontable", "compare"}


class Document(Collection):
    """The same commands with ``$`` as the row: only row-local ones."""

    def scope(self, **more: Any) -> Scope:
        more.pop("aggregates", None)
        return replace(Scope(self.df.schema, rows=False), **{k: v for k, v in more.items() if k != "rows"})

    def target(self, path: str) -> tuple[Column | None, tuple]:
        p = jp.parse(path)
        return None, p.segments

    def _change(self, mode: str, c: dict) -> None:
        if c["path"] == "$":
            raise Unsupported("the root cannot be written")
        super()._change(mode, c)


def transform(df: DataFrame, script: list[dict]) -> DataFrame:
    """``df`` after a script of row-local commands; works on streams too."""
    from ..sources import scripts

    script = scripts.parse(script)
    if wrong := [c["command"] for c in script if str(c["command"]).lower() not in LOCAL]:
        raise Unsupported(f"not row-local: {wrong}")
    return Document(df).run(script).rows
