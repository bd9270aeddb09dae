"""Documents as text: JSON, XML and YAML to and from plain trees, and conversion between them.

Conversion goes through one neutral tree: objects, arrays and typed scalars, with attributes, text and namespaces as
marked keys.  XML arrays are a wrapper with ``item`` children (or repeated siblings on request).
"""

from __future__ import annotations

import functools
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, fields
from typing import Any
from xml.sax.saxutils import escape, quoteattr

try:
    import yaml
except ImportError:  # an optional dependency: only YAML documents need it
    yaml = None

XSI = "http://www.w3.org/2001/XMLSchema-instance"


#: Settings with a choice of values.
_CHOICES = {"array_handling": ("Wrapped", "Repeated"), "null_representation": ("Empty", "XsiNil"), "name_sanitization": ("Sanitize", "Error", "Escape")}


class FormatError(ValueError):
    """Text that is not of its format, an unknown format, or a tree that a format cannot hold."""


@dataclass
class Settings:
    text_property: str = "#text"
    attribute_prefix: str = "@"
    namespace_prefix: str = "xmlns:"
    infer_types: bool = False
    cdata_as_text: bool = False
    array_item_name: str = "item"
    array_handling: str = "Wrapped"  # or Repeated
    null_representation: str = "Empty"  # or XsiNil
    name_sanitization: str = "Sanitize"  # or Error, Escape
    value_only: bool = True
    root_name: str = "root"
    flatten_anchors: bool = True

    @classmethod
    def read(cls, raw: dict | Settings | None) -> Settings:
        """Settings as scripts of any notation spell them: flags may be text, choices are in any case.  What is no
        setting, or no value of one, leaves the default."""
        if isinstance(raw, Settings):
            return raw
        given = {k.lower().replace("_", ""): v for k, v in (raw or {}).items()}
        out: dict[str, Any] = {}
        for f in fields(cls):
            v = given.get(f.name.replace("_", ""))
            if isinstance(f.default, bool):
                v = {"true": True, "false": False}.get(str(v).strip().lower())
            elif f.name in _CHOICES:
                v = {c.lower(): c for c in _CHOICES[f.name]}.get(str(v).strip().lower())
            elif not isinstance(v, str):
                v = None
            if v is not None:
                out[f.name] = v
        return cls(**out)


def detect(text: str) -> str:
    """json, xml or yaml, by the first character that is no blank, byte order mark, comment or document mark."""
    for line in text.lstrip("\ufeff").splitlines():
        s = line.strip()
        if s and not s.startswith(("#", "---")):
            return "xml" if s[0] == "<" else "json" if s[0] in "[{" else "yaml"
    return "yaml"


def _scalar(s: str | None) -> Any:
    """Typed scalar of an untyped text."""
    if s is None or s == "":
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"-?(0|[1-9]\d*)", s) and len(s) < 19:
        return int(s)
    if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)([eE][+-]?\d+)?", s):
        return float(s)
    return s


# ---- JSON -----------------------------------------------------------------------------------------------------------
def _strip_comments(text: str) -> str:
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)


def parse_json(text: str) -> Any:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            return json.loads(_strip_comments(text))
        except json.JSONDecodeError as e:
            raise FormatError(f"not JSON: {e}") from None


def write_json(v: Any, pretty: bool = False) -> str:
    return json.dumps(v, ensure_ascii=False, indent=2) if pretty else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


# ---- YAML -----------------------------------------------------------------------------------------------------------
def _need_yaml() -> None:
    if yaml is None:
        raise FormatError("YAML needs the yaml package")


@functools.cache
def _plain_loader():
    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """YAML 1.2 core scalars: no yes/no booleans, no dates."""

    Loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("tag:yaml.org,2002:bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
        ("tag:yaml.org,2002:int", r"[-+]?[0-9]+", "-+0123456789"),
        ("tag:yaml.org,2002:float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?", "-+.0123456789"),
        ("tag:yaml.org,2002:null", r"null|Null|NULL|~|", ["n", "N", "~", ""]),
        ("tag:yaml.org,2002:merge", r"<<", "<"),
    ):
        Loader.add_implicit_resolver(tag, re.compile(f"^(?:{pattern})$"), list(first))
    return Loader


@functools.cache
def _plain_dumper():
    class Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
        """No anchors: a part that stands in two places is written twice."""

        def ignore_aliases(self, data: Any) -> bool:
            return True

    return Dumper


def parse_yaml(text: str) -> Any:
    _need_yaml()
    try:
        docs = list(yaml.load_all(text, Loader=_plain_loader()))  # noqa: S506 - a SafeLoader
    except yaml.YAMLError as e:
        raise FormatError(f"not YAML: {e}") from None
    tidy = [_string_keys(d) for d in docs]
    return tidy[0] if len(tidy) == 1 else tidy if tidy else None


def _string_keys(v: Any) -> Any:
    if isinstance(v, dict):
        return {k if isinstance(k, str) else write_json(k): _string_keys(x) for k, x in v.items()}
    return [_string_keys(x) for x in v] if isinstance(v, list) else v


def write_yaml(v: Any) -> str:
    _need_yaml()
    return yaml.dump(v, Dumper=_plain_dumper(), sort_keys=False, allow_unicode=True, default_flow_style=False)


# ---- XML ------------------------------------------------------------------------------------------------------------
def parse_xml(text: str, s: Settings | None = None) -> Any:
    """The tree below the root element."""
    return next(iter(xml_tree(text, s or Settings()).values()))


def xml_tree(text: str, s: Settings) -> dict:
    """{root name: tree}"""
    if "<!DOCTYPE" in text:
        raise FormatError("document type declarations are not read")
    try:
        parser = ET.XMLPullParser(["start-ns", "start", "end"])
        parser.feed(text.lstrip("\ufeff"))
        parser.close()
        scopes: dict[Any, list] = {}
        pending: list = []
        root = None
        names: dict[str, str] = {}
        for event, what in parser.read_events():
            if event == "start-ns":
                pending.append(what)
                names[what[1]] = what[0]
            elif event == "start":
                root = what if root is None else root
                if pending:
                    scopes[what] = pending
                    pending = []
    except ET.ParseError as e:
        raise FormatError(f"not XML: {e}") from None
    if root is None:
        raise FormatError("not XML: no element")
    return {_local(root.tag, names): _element(root, s, names, scopes)}


def _local(tag: str, names: dict[str, str]) -> str:
    m = re.match(r"\{(.*?)\}(.*)", tag)
    if not m:
        return tag
    return f"{names[m[1]]}:{m[2]}" if names.get(m[1]) else m[2]


def _element(e: ET.Element, s: Settings, names: dict, scopes: dict) -> Any:
    nil = e.attrib.get(f"{{{XSI}}}nil") == "true"
    marks: dict[str, Any] = {(s.namespace_prefix + p if p else s.namespace_prefix.rstrip(":")): uri for p, uri in scopes.get(e, []) if uri != XSI}
    marks |= {s.attribute_prefix + _local(k, names): v for k, v in e.attrib.items() if k != f"{{{XSI}}}nil"}
    kids = list(e)
    inner = e.text or ""
    if not kids:
        if nil:
            return marks or None
        value = _scalar(inner) if s.infer_types else inner
        value = None if value in ("", None) else value
        return marks | {s.text_property: value} if marks and value is not None else marks or value
    tails = [inner, *[k.tail or "" for k in kids]]
    if any(t.strip() for t in tails):  # mixed content keeps its order
        parts: list[Any] = [inner] if inner.strip() else []
        for k in kids:
            parts.append({_local(k.tag, names): _element(k, s, names, scopes)})
            if (k.tail or "").strip():
                parts.append(k.tail)
        return marks | {"#mixed": parts}
    labels = [_local(k.tag, names) for k in kids]
    if not marks and len(set(labels)) == 1 and (len(kids) > 1 or labels[0] == s.array_item_name):
        if s.array_handling == "Wrapped" or labels[0] == s.array_item_name:
            return [_element(k, s, names, scopes) for k in kids]
    out: dict[str, Any] = dict(marks)
    for label, k in zip(labels, kids, strict=True):
        v = _element(k, s, names, scopes)
        if labels.count(label) > 1:
            out.setdefault(label, []).append(v)
        else:
            out[label] = v
    return out


def _name(n: str, s: Settings) -> str:
    if re.fullmatch(r"[A-Za-z_][\w.:-]*", n) and not n.lower().startswith("xml"):
        return n
    if s.name_sanitization == "Error":
        raise FormatError(f"{n!r} is no XML name")
    if s.name_sanitization == "Escape":
        out = re.sub(r"[^\w.-]", lambda m: f"_x{ord(m[0]):04X}_", n)
        return f"_x{ord(out[0]):04X}_{out[1:]}" if out[:1].isdigit() or out[:1] in ".-" else out or "_"
    out = re.sub(r"[^\w.-]", "_", n)
    return out if re.match(r"[A-Za-z_]", out) and not out.lower().startswith("xml") else f"_{out}"


def _text(v: Any) -> str:
    return "true" if v is True else "false" if v is False else repr(v) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)


def write_xml(v: Any, s: Settings | None = None, root: str | None = None, pretty: bool = False) -> str:
    s = s or Settings()
    out: list[str] = []
    _write(v, _name(root or s.root_name, s), s, out, True)
    text = "".join(out)
    if pretty:
        e = ET.fromstring(text)
        ET.indent(e)
        return ET.tostring(e, encoding="unicode")
    return text


def _write(v: Any, name: str, s: Settings, out: list[str], top: bool = False) -> None:
    if v is None:
        nil = f' xmlns:xsi="{XSI}" xsi:nil="true"' if s.null_representation == "XsiNil" else ""
        out.append(f"<{name}{nil}/>")
    elif isinstance(v, list):
        if s.array_handling == "Repeated" and not top:
            for x in v:
                _write(x, name, s, out)
            return
        out.append(f"<{name}>" if v else f"<{name}/>")
        for x in v:
            _write(x, s.array_item_name, s, out)
        if v:
            out.append(f"</{name}>")
    elif isinstance(v, dict):
        attrs, kids, text = [], [], None
        for k, x in v.items():
            bare = s.namespace_prefix.rstrip(":")
            if (k.startswith(s.namespace_prefix) or k == bare) and isinstance(x, str):
                attrs.append(f" {k}={quoteattr(x)}")
            elif k.startswith(s.attribute_prefix) and not isinstance(x, dict | list):
                attrs.append(f" {_name(k[len(s.attribute_prefix) :], s)}={quoteattr('' if x is None else _text(x))}")
            elif k == s.text_property and not isinstance(x, dict | list):
                text = x
            else:
                kids.append((k, x))
        if not kids and text is None:
            out.append(f"<{name}{''.join(attrs)}/>")
            return
        out.append(f"<{name}{''.join(attrs)}>")
        if text is not None:
            out.append(escape(_text(text)))
        for k, x in kids:
            if k == "#mixed" and isinstance(x, list):
                for part in x:
                    if isinstance(part, dict):
                        for kk, vv in part.items():
                            _write(vv, _name(kk, s), s, out)
                    else:
                        out.append(escape(_text(part)))
            else:
                _write(x, _name(k, s), s, out)
        out.append(f"</{name}>")
    else:
        t = escape(_text(v))
        out.append(f"<{name}>{t}</{name}>" if t else f"<{name}/>")


# ---- registry -------------------------------------------------------------------------------------------------------
class Adapter:
    """A format: text to the neutral tree and back.  ``named``: the text names its own root."""

    def __init__(self, read, write, named: bool = False):
        self.read, self.write, self.named = read, write, named


ADAPTERS: dict[str, Adapter] = {
    "json": Adapter(lambda t, s: parse_json(t), lambda v, s: write_json(v)),
    "yaml": Adapter(lambda t, s: parse_yaml(t), lambda v, s: write_yaml(v)),
    "xml": Adapter(xml_tree, lambda v, s: write_xml(v, s), named=True),
}


def register(name: str, adapter: Adapter) -> None:
    ADAPTERS[name.lower()] = adapter


def _adapter(name: str) -> Adapter:
    found = ADAPTERS.get({"yml": "yaml"}.get(name.lower(), name.lower()))
    if found is None:
        raise FormatError(f"unknown format {name!r}")
    return found


def parse(text: str, name: str, settings: Any = None) -> Any:
    a, s = _adapter(name), Settings.read(settings)
    tree = a.read(text, s)
    return next(iter(tree.values())) if a.named else tree


def write(v: Any, name: str, settings: Any = None) -> str:
    return _adapter(name).write(v, Settings.read(settings))


def convert(text: str, source: str, target: str, settings: Any = None) -> str:
    """Text of one format as text of another; a root name survives where both ends can hold it."""
    a, b, s = _adapter(source), _adapter(target), Settings.read(settings)
    tree = a.read(text, s)
    if b.named:
        one = isinstance(tree, dict) and len(tree) == 1 and not next(iter(tree)).startswith((s.attribute_prefix, "#"))
        if a.named or (one and not s.value_only):
            root, inner = next(iter(tree.items()))
            return write_xml(inner, s, root)
        return write_xml(tree, s)
    if a.named and s.value_only is False:
        return b.write(tree, s)
    return b.write(next(iter(tree.values())) if a.named and s.value_only and not isinstance(next(iter(tree.values())), str | None) else tree, s)
