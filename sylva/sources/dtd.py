"""Document type declarations: text to rows, content models to regular expressions, rows back to text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NAME = r"[^\W\d][\w.:-]*"
_LITERAL = r"\"[^\"]*\"|'[^']*'"
#: Words of declared content, attribute types and default kinds.
CONTENT_WORDS = ("EMPTY", "ANY")
SGML_WORDS = ("CDATA", "RCDATA", "ANYELEMENT")
ATTRIBUTE_TYPES = ("CDATA", "ID", "IDREF", "IDREFS", "ENTITY", "ENTITIES", "NMTOKEN", "NMTOKENS", "NOTATION")
DEFAULT_KINDS = ("#REQUIRED", "#IMPLIED", "#FIXED")
SGML_DEFAULTS = ("#CURRENT", "#CONREF")


class DtdError(ValueError):
    pass


@dataclass
class Dtd:
    """Declarations of one document type, as lists of dicts that become the ``dtd_*`` tables."""

    name: str | None = None
    public_id: str | None = None
    system_id: str | None = None
    elements: list[dict] = field(default_factory=list)
    attrs: list[dict] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)
    notations: list[dict] = field(default_factory=list)

    def element(self, name: str) -> dict | None:
        return next((e for e in self.elements if e["name"] == name), None)

    def attribute(self, element: str, name: str) -> dict | None:
        """The element's own declaration wins over one for ``*``."""
        found = [a for a in self.attrs if a["attr"] == name and a["elem"] in (element, "*")]
        return min(found, key=lambda a: a["elem"] == "*", default=None)

    def entity(self, name: str, parameter: bool = False) -> dict | None:
        return next((e for e in self.entities if e["name"] == name and e["parameter"] == parameter), None)

    def notation(self, name: str) -> dict | None:
        return next((n for n in self.notations if n["name"] == name), None)

    def define_element(self, name: str, model: str = "ANY") -> None:
        if self.element(name):
            raise DtdError(f"element {name} is declared twice")
        self.elements.append({"name": name, "model": model, "model_re": model_regex(model), "omit_start": False, "omit_end": False, "including": [], "excluding": []})

    def define_attribute(self, element: str, name: str, kind: str = "CDATA", default_kind: str = "#IMPLIED", value: str | None = None, enum: list[str] | None = None) -> None:
        if not any(a["elem"] == element and a["attr"] == name for a in self.attrs):  # the first declaration binds
            self.attrs.append({"elem": element, "attr": name, "type": kind, "default_kind": default_kind, "value": value, "enum": enum or []})

    def define_entity(self, name: str, literal: str | None = None, public_id: str | None = None, system_id: str | None = None, notation: str | None = None, parameter: bool = False) -> None:
        if not self.entity(name, parameter):
            self.entities.append({"name": name, "parameter": parameter, "literal": literal, "public_id": public_id, "system_id": system_id, "notation": notation})

    def define_notation(self, name: str, public_id: str | None = None, system_id: str | None = None) -> None:
        self.notations.append({"name": name, "public_id": public_id, "system_id": system_id})

    def defaults(self, element: str) -> list[tuple[str, str]]:
        return [(a["attr"], a["value"]) for a in self.attrs if a["elem"] in (element, "*") and a["value"] is not None]

    def to_text(self) -> str:
        """Declarations as text; parsing it again gives the same rows."""
        q = lambda s: f'"{s}"' if '"' not in s else f"'{s}'"
        where = lambda d: (f" PUBLIC {q(d['public_id'])}" + (f" {q(d['system_id'])}" if d["system_id"] is not None else "") if d["public_id"] is not None else f" SYSTEM {q(d['system_id'])}" if d["system_id"] is not None else "")
        lines = [f"<!ENTITY {'% ' * e['parameter']}{e['name']}" + (f" {q(e['literal'])}" if e["literal"] is not None else where(e)) + (f" NDATA {e['notation']}" if e["notation"] else "") + ">" for e in self.entities]
        lines += [f"<!NOTATION {n['name']}{where(n)}>" for n in self.notations]
        lines += [f"<!ELEMENT {e['name']} {e['model']}>" for e in self.elements]
        for a in self.attrs:
            kind = f"({'|'.join(a['enum'])})" if a["type"] == "ENUM" else a["type"] + (f" ({'|'.join(a['enum'])})" if a["enum"] else "")
            default = " ".join(x for x in (a["default_kind"], q(a["value"]) if a["value"] is not None else None) if x)
            lines.append(f"<!ATTLIST {a['elem']} {a['attr']} {kind} {default}>")
        head = f"<!DOCTYPE {self.name or 'doc'}" + where({"public_id": self.public_id, "system_id": self.system_id})
        return head + (" [\n" + "\n".join(lines) + "\n]" if lines else "") + ">"


def model_tokens(model: str) -> list[str]:
    return re.findall(rf"#PCDATA|{NAME}|[(),|&]|[?*+]|\{{\d*,?\d*\}}|\S", model)


def model_regex(model: str) -> str:
    """An anchored pattern over the child names, each followed by a blank; text is not a child here.

    ``a , b`` is a sequence, ``a | b`` a choice, ``a & b`` either order; ``? * +`` and ``{m,n}`` repeat.
    """
    if model.strip() == "EMPTY":
        return "^$"
    if model.strip() in ("ANY", "CDATA", "RCDATA", "ANYELEMENT"):
        return "^.*$"
    tokens, at = model_tokens(model), 0

    def repetition(made: str) -> str:
        nonlocal at
        if at < len(tokens) and re.fullmatch(r"[?*+]|\{\d*,?\d*\}", tokens[at]):
            made, at = made + tokens[at].replace("{,", "{0,"), at + 1
        return made

    def item() -> str:
        nonlocal at
        if at >= len(tokens):
            raise DtdError(f"content model ends early: {model}")
        if tokens[at] == "(":
            return group()
        name, at = tokens[at], at + 1
        if name == "#PCDATA":
            return repetition("(?:)")
        if not re.fullmatch(NAME, name):
            raise DtdError(f"bad token {name} in content model")
        return repetition(f"(?:{re.escape(name)} )")

    def group() -> str:
        nonlocal at
        at += 1
        parts, sep = [item()], None
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] not in ",|&" or sep not in (None, tokens[at]):
                raise DtdError(f"mixed or missing connectors in content model: {model}")
            sep, at = tokens[at], at + 1
            parts.append(item())
        if at >= len(tokens):
            raise DtdError(f"unclosed group in content model: {model}")
        at += 1
        if sep == "|":
            made = "|".join(parts)
        elif sep == "&":
            from itertools import permutations

            if len(parts) > 6:
                raise DtdError("an & group takes 6 members at most")
            made = "|".join("".join(p) for p in permutations(parts))
        else:
            made = "".join(parts)
        return repetition(f"(?:{made})")

    out = group() if tokens and tokens[0] == "(" else item()
    if at != len(tokens):
        raise DtdError(f"text after content model: {model}")
    return f"^{out}$"


def model_names(model: str) -> set[str]:
    """The element names that a content model uses, at any depth."""
    return {t for t in model_tokens(model) if re.fullmatch(NAME, t)} - {*CONTENT_WORDS, *SGML_WORDS}


def _names(text: str) -> list[str]:
    return re.findall(NAME, text)


def _unquote(s: str) -> str:
    return s[1:-1]


def parse_doctype(text: str, option=lambda name: False) -> Dtd:
    """``<!DOCTYPE ...>`` to rows."""
    m = re.match(rf"<!DOCTYPE\s+({NAME})(?:\s+SYSTEM\s+({_LITERAL})|\s+PUBLIC\s+({_LITERAL})(?:\s+({_LITERAL}))?)?((?:\s+(?:{_LITERAL}))*)\s*(?:NDATA\s+(\w+)\s*)?(?:\[(.*)\]\s*)?>$", text, re.S)
    if not m:
        raise DtdError("malformed DOCTYPE")
    if m[5].strip() and not option("multiPath"):
        raise DtdError("more than one system identifier")
    if m[6] and not option("schemaType"):
        raise DtdError("a schema type needs the option schemaType")
    dtd = Dtd(m[1], _unquote(m[3]) if m[3] else None, _unquote(m[2] or m[4]) if m[2] or m[4] else None)
    if m[7]:
        parse_subset(m[7], dtd, option)
    return dtd


def expand_parameters(s: str, dtd: Dtd, option, depth: int = 0) -> str:
    if depth > (option("MAXENTITYDEPTH") or 16):
        raise DtdError("parameter entities are nested too deeply")

    def one(m: re.Match) -> str:
        found = dtd.entity(m[1], True)
        if not found or found["literal"] is None:
            raise DtdError(f"undefined parameter entity {m[1]}")
        return expand_parameters(found["literal"], dtd, option, depth + 1)

    out = re.sub(rf"%({NAME});", one, s)
    if len(out) > (option("MAXEXPANSION") or 1 << 20):
        raise DtdError("parameter entities expand too far")
    return out


def parse_subset(s: str, dtd: Dtd, option=lambda name: False) -> Dtd:
    at = 0
    while at < len(s):
        if s[at].isspace():
            at += 1
        elif s.startswith("<!--", at):
            end = s.find("-->", at)
            if end < 0:
                raise DtdError("unclosed comment")
            at = end + 3
        elif s.startswith("<?", at):
            end = s.find("?>", at)
            if end < 0:
                raise DtdError("unclosed processing instruction")
            at = end + 2
        elif m := re.compile(rf"%({NAME});").match(s, at):
            parse_subset(expand_parameters(m[0], dtd, option), dtd, option)
            at = m.end()
        elif m := re.compile(rf"<!(\w+)((?:{_LITERAL}|--.*?--|[^\"'>])*)>", re.S).match(s, at):
            _declare(m[1], m[2], dtd, option)
            at = m.end()
        else:
            raise DtdError(f"unexpected text in declarations: {s[at:at + 20]!r}")
    return dtd


def _declare(kind: str, body: str, dtd: Dtd, option) -> None:
    if option("fragComment"):
        body = re.sub(r"--.*?--", " ", body, flags=re.S)
    if kind == "ENTITY":
        m = re.fullmatch(rf"\s+(%\s+)?({NAME})\s+(?:({_LITERAL})|(?:SYSTEM\s+({_LITERAL})|PUBLIC\s+({_LITERAL})\s+({_LITERAL}))(?:\s+NDATA\s+({NAME}))?)\s*", body)
        if not m:
            raise DtdError("malformed ENTITY declaration")
        literal = expand_parameters(_unquote(m[3]), dtd, option) if m[3] else None
        dtd.define_entity(m[2], literal, _unquote(m[5]) if m[5] else None, _unquote(m[4] or m[6]) if m[4] or m[6] else None, m[7], bool(m[1]))
        return
    body = expand_parameters(body, dtd, option)
    if kind == "NOTATION":
        m = re.fullmatch(rf"\s+({NAME})\s+(?:SYSTEM\s+({_LITERAL})|PUBLIC\s+({_LITERAL})(?:\s+({_LITERAL}))?)\s*", body)
        if not m:
            raise DtdError("malformed NOTATION declaration")
        dtd.define_notation(m[1], _unquote(m[3]) if m[3] else None, _unquote(m[2] or m[4]) if m[2] or m[4] else None)
    elif kind == "ELEMENT":
        m = re.fullmatch(rf"\s+({NAME}|\([^)]*\))\s+(?:([-Oo])\s+([-Oo])\s+)?(EMPTY|ANY|CDATA|RCDATA|ANYELEMENT|#PCDATA|\(.*?\)(?:[?*+]|\{{\d*,?\d*\}})?)((?:\s*[-+]\s*\([^)]*\))*)\s*", body, re.S)
        if not m:
            raise DtdError("malformed ELEMENT declaration")
        for given, needs in ((m[1][0] == "(", "groupDcl"), (m[2], "oflag"), (m[4] in SGML_WORDS, "sgmlWord"), (m[5].strip(), "mixin"), ("{" in m[4], "repBrace")):
            if given and not option(needs):
                raise DtdError(f"this ELEMENT declaration needs the option {needs}")
        for name in _names(m[1]):
            dtd.define_element(name, " ".join(m[4].split()))
            dtd.elements[-1] |= {
                "omit_start": (m[2] or "-") in "Oo", "omit_end": (m[3] or "-") in "Oo",
                "including": [n for g in re.findall(r"\+\s*\(([^)]*)\)", m[5]) for n in _names(g)], "excluding": [n for g in re.findall(r"-\s*\(([^)]*)\)", m[5]) for n in _names(g)],
            }
    elif kind == "ATTLIST":
        m = re.match(rf"\s+({NAME}|\*|\([^)]*\))", body)
        if not m:
            raise DtdError("malformed ATTLIST declaration")
        if m[1] == "*" and not option("globalAttribute") or m[1][0] == "(" and not option("groupDcl"):
            raise DtdError("this ATTLIST declaration needs the option globalAttribute or groupDcl")
        names, at = ["*"] if m[1] == "*" else _names(m[1]), m.end()
        one = re.compile(rf"\s+({NAME}|#ANY)\s+(?:(NOTATION\s*)?\(([^)]*)\)|([A-Za-z]\w*))\s+(?:(#FIXED)\s+({_LITERAL})|(#\w+)|({_LITERAL}))")
        while body[at:].strip():
            a = one.match(body, at)
            if not a:
                raise DtdError("malformed ATTLIST declaration")
            if a[1] == "#ANY" and not option("anyAttribute") or a[4] and a[4] not in ATTRIBUTE_TYPES and not option("xsdType") or a[7] and a[7] not in DEFAULT_KINDS and not (a[7] in SGML_DEFAULTS and option("sgmlWord")):
                raise DtdError(f"attribute {a[1]}: its type or default is unknown without an option")
            value = a[6] or a[8]
            for name in names:
                dtd.define_attribute(name, a[1], "NOTATION" if a[2] else "ENUM" if a[3] is not None else a[4], a[5] or a[7] or "", _unquote(value) if value else None, [x.strip() for x in re.split(r"[|,]", a[3])] if a[3] is not None else [])
            at = a.end()
    else:
        raise DtdError(f"unknown declaration {kind}")
