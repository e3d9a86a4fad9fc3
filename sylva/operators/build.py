"""New nodes as XML text for ``mutate``: names are checked, content is escaped."""

from __future__ import annotations

import re

from sylva.sources.shred import NCNAME, QNAME


class InvalidCharacterError(ValueError):
    pass


def _name(s: str, pattern: str = QNAME) -> str:
    if not re.fullmatch(pattern, s):
        raise InvalidCharacterError(f"not a name: {s!r}")
    return s


def text(data: str) -> str:
    return data.replace("&", "&amp;").replace("<", "&lt;").replace("]]>", "]]&gt;")


def element(name: str, attributes: dict[str, str] | None = None, *children: str, ns_uri: str | None = None) -> str:
    """``children``: XML as the functions of this module give it."""
    pairs = dict(attributes or {})
    if ns_uri is not None:
        pairs[f"xmlns:{name.split(':')[0]}" if ":" in name else "xmlns"] = ns_uri
    body = "".join(children)
    head = _name(name) + "".join(f' {_name(k)}="' + v.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;") + '"' for k, v in pairs.items())
    return f"<{head}>{body}</{name}>" if body else f"<{head}/>"


def comment(data: str) -> str:
    if "--" in data or data.endswith("-"):
        raise InvalidCharacterError("-- in a comment")
    return f"<!--{data}-->"


def cdata(data: str) -> str:
    if "]]>" in data:
        raise InvalidCharacterError("]]> in a marked section")
    return f"<![CDATA[{data}]]>"


def instruction(target: str, data: str = "") -> str:
    if "?>" in data or target.lower() == "xml":
        raise InvalidCharacterError("not an instruction")
    return f"<?{_name(target, NCNAME)}{' ' * bool(data)}{data}?>"


def reference(name: str) -> str:
    return f"&{_name(name, NCNAME)};"


def document(root: str, doctype: str | None = None, version: str = "1.0", encoding: str = "utf-8") -> str:
    return f'<?xml version="{version}" encoding="{encoding}"?>' + (f"<!DOCTYPE {_name(doctype)}>" if doctype else "") + root
