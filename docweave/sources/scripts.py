"""Scripts as text in three notations, and back to JSON."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from typing import Any

from . import formats

NESTED = {"commands", "ifscript", "elsescript"}


def parse(text: str | list) -> list[dict]:
    """A script as a list of command objects; the notation is detected."""
    if isinstance(text, list):
        return text
    kind = formats.detect(text)
    if kind == "xml":
        return parse_xml(text)
    tree = formats.parse_json(text) if kind == "json" else formats.parse_yaml(text)
    tree = [tree] if isinstance(tree, dict) else tree or []
    return [_yaml_command(c) for c in tree] if kind == "yaml" else tree


def _yaml_command(c: Any) -> dict:
    """``- set: {path: ..}`` as well as ``- command: set``."""
    if isinstance(c, dict) and "command" not in c and len(c) == 1:
        name, body = next(iter(c.items()))
        c = {"command": name, **(body if isinstance(body, dict) else {"path": body})}
    return {k: [_yaml_command(x) for x in v] if k.lower() in NESTED and isinstance(v, list) else v for k, v in c.items()}


def parse_xml(text: str) -> list[dict]:
    """``<script><set path="..." value="..."/></script>``; child elements are properties."""
    try:
        root = ET.fromstring(text.lstrip("\ufeff"))
    except ET.ParseError as e:
        raise formats.FormatError(f"not a script: {e}") from None
    return [_xml_command(e) for e in root]


def _literal(s: str) -> Any:
    return formats._scalar(s) if s in ("true", "false") or s[:1] in "-0123456789" else s


def _xml_command(e: ET.Element) -> dict:
    c: dict[str, Any] = {"command": e.tag.lower(), **{k: v if k.lower() in ("path", "property", "name") else _literal(v) for k, v in e.attrib.items()}}
    for k in e:
        if k.tag.lower() in NESTED:
            c[k.tag] = [_xml_command(x) for x in k]
        elif k.tag.lower() not in ("title", "description") or e.tag.lower() == "value":
            c[k.tag] = _xml_value(k)
    return c


def _xml_value(e: ET.Element) -> Any:
    kids = list(e)
    if not kids:
        return _literal(e.text or "") if not e.attrib else {**{k: _literal(v) for k, v in e.attrib.items()}}
    if len({k.tag for k in kids}) == 1 and (len(kids) > 1 or kids[0].tag == "item"):
        return [_xml_value(k) for k in kids]
    return {**{k: _literal(v) for k, v in e.attrib.items()}, **{k.tag: _xml_value(k) for k in kids}}


def serialize(script: list[dict], pretty: bool = True) -> str:
    return formats.write_json(script, pretty)


def validate(script: list[dict], commands: set[str], functions: set[str]) -> list[str]:
    """What is wrong with a script before it runs: unknown commands and functions, missing keys, bad paths."""
    from ..plans import jsonpath, values

    need = {"add": ["path", "value"], "set": ["path", "value"], "put": ["path", "value"], "remove": ["path"], "rename": ["path", "name"], "setproperties": ["path", "value"], "copy": ["fromPath", "toPath"], "move": ["fromPath", "toPath"], "ifelse": ["condition"], "foreach": ["path", "commands"], "while": ["condition", "commands", "maxIterations"], "with": ["path", "commands"], "compare": ["firstPath", "secondPath", "resultPath"], "decisiontable": ["decisionTable"], "resolve": ["path", "resolveSettings"], "convert": ["to"], "convertvalue": ["path", "to"]}
    out = []
    for i, c in enumerate(script):
        name = str(c.get("command", "")).lower()
        if name not in commands:
            out.append(f"{i}: unknown command {c.get('command')!r}")
        out += [f"{i}: {name} asks for {k}" for k in need.get(name, []) if k not in c]
        for k, v in c.items():
            if k.lower().endswith("path") and isinstance(v, str) and not v.startswith("="):
                try:
                    jsonpath.parse(v, "extended")
                except jsonpath.PathError as e:
                    out.append(f"{i}: {e}")
            elif k.lower() in NESTED:
                out += [f"{i}.{x}" for x in validate(v or [], commands, functions)]
            elif k in ("value", "condition"):
                try:
                    out += [f"{i}: unknown function {n.name}" for n in values.walk(values.parse_value(v)) if isinstance(n, values.Call) and n.name not in functions]
                except values.ValueError_ as e:
                    out.append(f"{i}: {e}")
    return out
