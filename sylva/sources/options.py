"""Options of the shredder and of the serializer."""

from __future__ import annotations

from dataclasses import dataclass, field

# Option names and defaults.
BASE_OPTIONS = {
    "utgard": False, "MAXEXPANSION": 1 << 20, "MAXENTITYDEPTH": 16, "charEntities": True, "extEntities": True, "netEntities": True, "entityDirs": None,
    "extSchema": True, "noC0": True, "noC1": False, "noPrivateUse": False, "langChecking": False, "saxAttribute": False, "attributeCast": False,
    "useDTD": False, "valElemNames": False, "valModels": False, "valAttributeNames": False, "valAttributeTypes": False, "expatBreaks": False, "nsUsage": None,
}
EXTENSION_OPTIONS = (
    "elementFold", "entityFold", "attributeFold", "idFold", "groupDcl", "oflag", "sgmlWord", "mixin", "repBrace", "globalAttribute", "anyAttribute", "xsdType",
    "fragComment", "htmlNames", "unicodeNames", "schemaType", "multiPath", "piAttribute", "simultaneous", "suspend", "olist", "emptyEnd", "omitEnd", "omitAtEOF",
    "restart", "restartName", "unQuotedAttribute", "curlyQuote", "booleanAttribute", "booleanIsName", "bangAttribute", "backslash", "MSType", "emComment", "specialFloat",
    "keywordFold", "nestComment", "noAttributeNorm",
)
UNFINISHED_OPTIONS = (
    "notationFold", "xsdFold", "uNormHandler", "wsDef", "mixel", "xsdPlural", "multiSDATA", "setDcl", "entEncoding", "piAttlist", "multiTag",
    "suspendDcl", "olistDcl", "trojanDcl", "unordered", "endTagId", "levelCount", "qgi", "elementAbbr", "lineTag", "attributeAbbr",
    "bangAttributeType", "piEscape", "poundComment", "extraDcl", "IDSuffix", "NAMESPACEID", "STACKID", "TYPEID", "COMPOUNDID", "COID", "STARTID",
    "SUSPENDID", "RESUMEID", "ENDID", "BOUNDARYID",
)


@dataclass(frozen=True)
class ShredOptions:
    """How documents become rows.

    ``mode`` is ``xml`` (well-formedness is checked) or ``html`` (tag soup: the rules of
    ``shred`` repair it).  ``on_error``: ``permissive`` gives an error row and no nodes for
    the document, ``failfast`` raises.  ``fragment`` allows any number of top nodes,
    ``open_prefixes`` prefixes that it does not declare (their uri stays null).
    ``keep_space``: whether white-space-only text is kept.  ``resolved`` maps system
    identifiers to the text of external entities, as ``resolve_entities`` reads them on the driver.  ``extra`` holds the options
    of ``BASE_OPTIONS`` and ``EXTENSION_OPTIONS``.  ``references``: the only names whose references are replaced, all others
    (numbers too) stay as written; by default all are replaced.
    """

    mode: str = "xml"
    on_error: str = "permissive"
    fragment: bool = False
    open_prefixes: bool = False
    keep_space: bool = True
    max_depth: int = 10_000
    references: frozenset[str] | None = None
    resolved: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in ("xml", "html") or self.on_error not in ("permissive", "failfast"):
            raise ValueError("mode is xml or html, on_error is permissive or failfast")
        for k in self.extra:
            if k in UNFINISHED_OPTIONS:
                raise NotImplementedError(f"option {k} has no defined meaning yet")
            if k not in BASE_OPTIONS and k not in EXTENSION_OPTIONS:
                raise KeyError(f"no such option: {k}")

    def get(self, name: str):
        return self.extra.get(name, BASE_OPTIONS.get(name, False))


def resolve_entities(system_ids: list[str], dirs: list[str], net: bool = False) -> dict[str, str]:
    """Texts of external entities found in permitted folders; never outside them, and nothing from the net unless a caller maps it."""
    from pathlib import Path

    out = {}
    for name in system_ids:
        if "://" in name and not name.startswith("file://"):
            continue
        for d in map(Path, dirs):
            path = (d / name.removeprefix("file://").lstrip("/")).resolve()
            if path.is_relative_to(d.resolve()) and path.is_file():
                out[name] = path.read_text()
                break
    return out


# Serializer options and defaults.
FORMAT_DEFAULTS = {
    "depth": 0, "newl": "\n", "indent": "  ", "addindent": None, "stripTextNodes": False, "wrapTextAt": 0, "dropWS": False, "breakBB": True, "breakAB": False,
    "breakAttributes": False, "breakBText": False, "breakBE": False, "breakAE": False, "tagInfos": {}, "canonical": False, "IgnoreComments": False,
    "TrimTextNodes": False, "PrefixRewrite": False, "QNameAware": None, "encoding": "utf-8", "includeXmlDcl": True, "standalone": None, "includeDoctype": True,
    "useEmpty": True, "emptySpace": True, "quoteChar": '"', "sortAttributes": False, "normAttributes": False, "useCDATA": True, "escapeGT": False, "ASCII": False,
    "charBase": 16, "hexUpperCase": True, "charPad": 4, "htmlChars": True, "forPI": "?&gt;", "forCOM": "-&#x2d;", "forMSC": "]]&gt;", "translateTable": {},
}


def format_options(**given) -> dict:
    """All serializer options; unknown names and values of another type are refused."""
    out = dict(FORMAT_DEFAULTS)
    for k, v in given.items():
        if k not in out:
            raise KeyError(f"no such option: {k}")
        if out[k] is not None and v is not None and not isinstance(v, type(out[k])):
            raise TypeError(f"option {k} takes {type(out[k]).__name__}")
        out[k] = v
    return out


def canonical_options() -> dict:
    """Sorted, normalized attributes, no empty tags, no marked sections, no comments or declaration."""
    return format_options(canonical=True, sortAttributes=True, normAttributes=True, useEmpty=False, useCDATA=False, includeXmlDcl=False, includeDoctype=False, newl="", indent="", breakBB=False)
