"""Documents to rows: one pass, interval labels, attributes nested in their element's row.

A row of ``nodes`` is a node of the tree below the document: ``pre`` is its pre-order
rank from 0, ``last`` the largest ``pre`` of its subtree, ``anc`` the ranks of its
ancestors (root first), ``path`` its 1-based child numbers from the root.  Attributes
are an array of structs in document order, so that lookups need no join.

Html mode repairs tag soup by fixed rules: names are folded to lower case; elements of
``VOID`` have no content; the content of ``RAW`` is text; a start tag closes what
``CLOSES`` says, up to the nearest container; an end tag closes everything inside its
element and is ignored when none is open; unknown references stay text.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.sources.dtd import DtdError, parse_doctype
from sylva.sources.options import ShredOptions

ERROR, ELEMENT, TEXT, PI, COMMENT = -1, 1, 3, 7, 8
XML_NS, XMLNS_NS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

# Elements of the html repair rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"tbody", "thead"}, "thead": {"tbody"}}
CONTAINERS = {"p": frozenset("html body div article section li td th blockquote form fieldset main aside header footer nav table button".split()), "li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset("table tbody thead tfoot".split()), "td": frozenset("tr table".split()), "th": frozenset("tr table".split()), "option": frozenset("select datalist".split()), "body": frozenset(["html"]), "tbody": frozenset(["table"]), "thead": frozenset(["table"])}

_START = "A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
NCNAME = rf"[{_START}][{_START}0-9.\-·̀-ͯ‿-⁀]*"
QNAME = rf"{NCNAME}(?::{NCNAME})?"
_ATTR = re.compile(rf"\s+({QNAME})\s*=\s*(?:\"([^<\"]*)\"|'([^<']*)')")
_TAG = re.compile(rf"<({QNAME})((?:\s+{QNAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*(/?)>")
_END = re.compile(rf"</({QNAME})\s*>")
_LOOSE_TAG = re.compile(r"<([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_LOOSE_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_LOOSE_END = re.compile(r"</([A-Za-z][^\s/>]*)[^>]*>")
_REF = re.compile(rf"&(?:#([0-9]+)|#x([0-9A-Fa-f]+)|({NCNAME}));")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_DECL = re.compile(r"<\?xml\s+version\s*=\s*(?:\"(1\.[0-9]+)\"|'(1\.[0-9]+)')(?:\s+encoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._-]*)[\"'])?(?:\s+standalone\s*=\s*[\"'](yes|no)[\"'])?\s*\?>")
_QUOTES = {'"': '"', "'": "'"}
_CURLY = _QUOTES | {"“": "”", "‘": "’", "«": "»", "„": "”", "‹": "›"}
_BACKSLASH = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([abfnrtv\\]))")

ATTRS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("prefix", T.StringType()), ("local", T.StringType()), ("ns_uri", T.StringType()), ("value", T.StringType()), ("specified", T.BooleanType()))]))
NODE_FIELDS = [
    ("pre", T.IntegerType()), ("last", T.IntegerType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("ord", T.IntegerType()), ("ord_e", T.IntegerType()), ("n_children", T.IntegerType()),
    ("node_type", T.ByteType()), ("name", T.StringType()), ("prefix", T.StringType()), ("local", T.StringType()), ("ns_uri", T.StringType()), ("data", T.StringType()), ("in_cdata", T.BooleanType()),
    ("path", T.ArrayType(T.IntegerType())), ("anc", T.ArrayType(T.IntegerType())), ("attrs", ATTRS), ("tag_path", T.StringType()),
]
_COLUMNS = [n for n, _ in NODE_FIELDS]
_LAST, _N_CHILDREN, _PATH, _TAG_PATH = (_COLUMNS.index(n) for n in ("last", "n_children", "path", "tag_path"))
NODES = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, t) for n, t in NODE_FIELDS]])


class ShredError(ValueError):
    def __init__(self, message: str, offset: int = 0, kind: str = "syntax"):
        super().__init__(message)
        self.offset, self.kind = offset, kind


_FOLDS = {"FOLD": str.casefold, "LOWER": str.lower, "UPPER": str.upper}


def folder(how):
    """Case handling by name: NONE, FOLD, LOWER or UPPER."""
    return _FOLDS.get(str(how).upper(), str) if how else str


def unicode_name(name: str) -> str | None:
    """A character by its name with underscores; words may be cut to four letters or more."""
    try:
        return unicodedata.lookup(name.replace("_", " "))
    except KeyError:
        words = name.upper().split("_")
        for cp in range(0x20, 0x3000):
            have = unicodedata.name(chr(cp), "").replace("-", " ").split(" ")
            if len(have) == len(words) and all(h.startswith(w) and (h == w or len(w) >= 4) for h, w in zip(have, words, strict=True)):
                return chr(cp)
    return None


class _Open:
    __slots__ = ("anc", "elems", "ns", "path", "pre", "raw", "tag", "tag_path", "total")

    def __init__(self, pre, tag, raw, ns, path, anc, tag_path):
        self.pre, self.tag, self.raw, self.ns, self.path, self.anc, self.tag_path, self.total, self.elems = pre, tag, raw, ns, path, anc, tag_path, 0, 0


class Shredder:
    """Shreds one document at a time into lists of column values; ``rows`` holds them until they are taken."""

    def __init__(self, options: ShredOptions | None = None):
        self.options = options or ShredOptions()
        self.html = self.options.mode == "html"
        get = self.options.get
        self.fold_element = folder(get("elementFold") or ("LOWER" if self.html else None))
        self.fold_attribute = folder(get("attributeFold") or ("LOWER" if self.html else None))
        self.fold_entity = folder(get("entityFold"))
        self.omit_end, self.backslash, self.em_comment = get("omitEnd"), get("backslash"), get("emComment")
        self.html_names = self.html or get("htmlNames")
        self.quotes = _CURLY if get("curlyQuote") else _QUOTES
        self.extended = any(get(x) for x in ("unQuotedAttribute", "curlyQuote", "booleanAttribute", "bangAttribute"))
        self.no_norm = get("noAttributeNorm")
        self.as_written = not (self.no_norm or self.backslash or get("attributeFold"))
        self.handlers = None

    # -- one document ------------------------------------------------------

    def shred(self, text: str) -> dict[str, list]:
        self.s, self.at, self.dtd, self.declaration = text, 0, None, {}
        self.rows: list[list] = []
        self.stack: list[_Open] = [_Open(-1, None, None, {"xml": XML_NS}, (), (), "")]
        self.text: list[str] = []
        self.roots, self.spliced, self.bang = 0, 0, {}
        self.entity_ends: list[tuple[int, str]] = []
        if bad := _ILLEGAL.search(text) if self.options.get("noC0") and not self.html else None:
            raise ShredError(f"illegal character U+{ord(bad[0]):04X}", bad.start())
        if self.options.get("noC1") and (bad := re.search("[\x80-\x9f]", text)):
            raise ShredError("C1 control", bad.start())
        if self.options.get("noPrivateUse") and (bad := re.search("[-]", text)):
            raise ShredError("private-use character", bad.start())
        if not self.html and text.startswith("<?xml") and text[5:6].isspace():
            m = _DECL.match(text)
            if not m:
                raise ShredError("malformed XML declaration")
            self.declaration = {"version": m[1] or m[2], "encoding": m[3], "standalone": m[4]}
            self.at = m.end()
        self._content()
        self._flush()
        if len(self.stack) > 1:
            if not (self.html or self.options.get("omitAtEOF")):
                raise ShredError(f"element {self.stack[-1].raw} is not closed", len(self.s))
            while len(self.stack) > 1:
                self._pop()
        if not self.roots and not self.options.fragment and not self.html:
            raise ShredError("no document element", len(self.s))
        return self._columns()

    def _columns(self) -> dict[str, list]:
        return dict(zip(_COLUMNS, map(list, zip(*self.rows, strict=True)), strict=True)) if self.rows else {n: [] for n in _COLUMNS}

    def _content(self) -> None:
        s = self.s
        while self.at < len(self.s):
            s, at = self.s, self.at
            while self.entity_ends and at >= self.entity_ends[-1][0]:
                self.entity_ends.pop()
            lt = s.find("<", at)
            if lt != at:
                end = len(s) if lt < 0 else lt
                if self.entity_ends:
                    end = min(end, self.entity_ends[-1][0])
                self._characters(s[at:end], at)
                continue
            if not self.html and not self.extended and (m := _TAG.match(s, at)):
                self.at = m.end()
                given = m[2]
                ready = self.as_written and given.isprintable() and "&" not in given  # no value is changed
                self._start(m[1], [(k, one or other) for k, one, other in _ATTR.findall(given)] if given else (), bool(m[3]), at, ready)
            elif not self.html and (m := _END.match(s, at)):
                self.at = m.end()
                self._end(m[1], at)
            elif s.startswith("<!--", at):
                self._comment(at)
            elif s.startswith("<![", at):
                self._section(at)
            elif s.startswith("<?", at):
                self._pi(at)
            elif s.startswith("<!DOCTYPE", at) or self.html and s[at : at + 9].upper() == "<!DOCTYPE":
                self._doctype(at)
            elif self.em_comment and s.startswith("<!—", at):
                end = s.find("—>", at + 3)
                if end < 0:
                    raise ShredError("unclosed comment", at)
                self._leaf(COMMENT, s[at + 3 : end], at)
                self.at = end + 2
            elif self.html:
                self._loose(at)
            else:
                self._special(at)

    # -- pieces --------------------------------------------------------------

    def _characters(self, raw: str, at: int) -> None:
        self.at = at + len(raw)
        if "]]>" in raw and not self.html:
            raise ShredError("]]> in text", at + raw.find("]]>"))
        if self.backslash:
            raw = _BACKSLASH.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if not m[4] else {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}[m[4]], raw)
        raw = raw.replace("\r\n", "\n").replace("\r", "\n") if "\r" in raw else raw
        amp = raw.find("&")
        if amp < 0:
            self.text.append(raw)
            return
        done = 0
        while amp >= 0:
            m = _REF.match(raw, amp)
            if not m:
                if not self.html:
                    raise ShredError("malformed reference", at + amp)
                amp = raw.find("&", amp + 1)
                continue
            self.text.append(raw[done:amp])
            done = m.end()
            value, markup = self._reference(m, at + amp)
            if markup:  # replacement text with markup of its own is read in place
                if any(name == m[3] for _, name in self.entity_ends):
                    raise ShredError(f"entity {m[3]} refers to itself", at + amp, "entity")
                if len(self.entity_ends) >= self.options.get("MAXENTITYDEPTH"):
                    raise ShredError("entities are nested too deeply", at + amp, "entity")
                self.spliced += len(value)
                if self.spliced > self.options.get("MAXEXPANSION"):
                    raise ShredError("entities expand too far", at + amp, "entity")
                rest = raw[done:] + self.s[self.at :]
                moved = len(value) + len(rest) - (len(self.s) - at - amp)
                self.entity_ends = [(e + moved, n) for e, n in self.entity_ends]
                self.s, self.at = self.s[: at + amp] + value + rest, at + amp
                self.entity_ends.append((at + amp + len(value), m[3]))
                return
            self.text.append(value)
            amp = raw.find("&", done)
        self.text.append(raw[done:])

    def _reference(self, m: re.Match, at: int) -> tuple[str, bool]:
        if self.options.references is not None and m[3] not in self.options.references:
            return m[0], False
        if m[1] or m[2]:
            cp = int(m[1]) if m[1] else int(m[2], 16)
            c = chr(cp) if cp < 0x110000 else "\0"
            if _ILLEGAL.match(c):
                if self.html:
                    return "�", False
                raise ShredError(f"illegal character reference {m[0]}", at)
            return c, False
        name = self.fold_entity(m[3])
        if name in PREDEFINED:
            return PREDEFINED[name], False
        if self.dtd and (e := self.dtd.entity(name)):
            if e["literal"] is None and self._permitted(e):
                found = re.sub(r"^<\?xml[^>]*\?>", "", self.options.resolved[e["system_id"]])
                return found, "<" in found or "&" in found
            if e["literal"] is None:
                raise ShredError(f"external entity {name} is not read", at, "entity")
            return self._literal(e["literal"], at), "<" in e["literal"] or "&" in e["literal"]
        if self.html_names and (c := html5.get(name + ";")):
            return c, False
        if self.options.get("unicodeNames") and (c := unicode_name(name)):
            return c, False
        if self.html:
            return m[0], False
        raise ShredError(f"undefined entity {name}", at, "entity")

    def _permitted(self, e: dict) -> bool:
        """External text is used if it was resolved beforehand and no option forbids it."""
        where = e["system_id"] or ""
        return where in self.options.resolved and not e["notation"] and self.options.get("extEntities") and ("://" not in where or where.startswith("file://") or self.options.get("netEntities"))

    def _literal(self, s: str, at: int) -> str:
        """Character references are replaced when an entity is declared."""

        def character(m: re.Match) -> str:
            cp = int(m[1]) if m[1] else int(m[2], 16)
            if cp >= 0x110000 or _ILLEGAL.match(chr(cp)):
                raise ShredError(f"illegal character reference {m[0]}", at, "entity")
            return chr(cp)

        return re.sub(r"&#(?:([0-9]+)|x([0-9A-Fa-f]+));", character, s)

    def _value(self, raw: str, at: int, depth: int = 0, norm: bool = True) -> str:
        """An attribute value: references are replaced, white space becomes blanks (unless ``norm`` is false)."""
        if not depth and "&" not in raw and raw.isprintable():
            return raw
        if depth > self.options.get("MAXENTITYDEPTH"):
            raise ShredError("entities are nested too deeply", at, "entity")
        raw = re.sub(r"\r\n|[\t\r\n]", " ", raw) if norm else raw
        if "&" not in raw:
            return raw
        out, done = [], 0
        for m in re.finditer("&", raw):
            if m.start() < done:
                continue
            r = _REF.match(raw, m.start())
            if not r:
                if not self.html:
                    raise ShredError("malformed reference in an attribute", at)
                continue
            value, markup = self._reference(r, at)
            if markup and "<" in value:
                raise ShredError("markup in an attribute", at, "entity")
            out += [raw[done : m.start()], self._value(value, at, depth + 1, norm) if markup else value]
            done = r.end()
        return "".join(out) + raw[done:]

    def _comment(self, at: int) -> None:
        end = self._comment_end(at) if self.options.get("nestComment") else self.s.find("-->", at + 4)
        if end < 0:
            if not self.html:
                raise ShredError("unclosed comment", at)
            end = len(self.s)
        data = self.s[at + 4 : end]
        plain = re.sub("<!--|-->", "", data) if self.options.get("nestComment") else data
        if not self.html and ("--" in plain or plain.endswith("-")):
            raise ShredError("-- in a comment", at)
        self._leaf(COMMENT, data, at)
        self.at = end + 3

    def _comment_end(self, at: int) -> int:
        """Where the comment ends when comments nest, -1 without an end."""
        depth = 0
        for m in re.compile("<!--|-->").finditer(self.s, at):
            depth += 1 if m[0] == "<!--" else -1
            if not depth:
                return m.start()
        return -1

    def _section(self, at: int) -> None:
        fold = self.options.get("keywordFold")
        m = re.compile(r"<!\[\s*(\w+)\s*\[" if self.options.get("MSType") else r"<!\[(CDATA)\[", re.I if fold else 0).match(self.s, at)
        kind = (m[1].upper() if fold else m[1]) if m else None
        end = self.s.find("]]>", at)
        if self.html and not m:
            self.at = self.s.find(">", at) + 1 or len(self.s)
            return
        if not m or end < 0 or kind not in ("CDATA", "RCDATA", "IGNORE", "INCLUDE", "TEMP"):
            raise ShredError("malformed marked section", at)
        if len(self.stack) == 1 and not self.options.fragment and not self.html:
            raise ShredError("text outside the document element", at)
        if kind in ("INCLUDE", "TEMP", "RCDATA"):
            self._characters(self.s[m.end() : end], m.end())
        elif kind == "CDATA":
            self._flush()
            self._emit(TEXT, "#text", self.s[m.end() : end], in_cdata=True)
        self.at = end + 3

    def _pi(self, at: int) -> None:
        end = self.s.find(">" if self.html else "?>", at)
        m = re.compile(rf"<\?({NCNAME})(?:\s+(.*?))?$", re.S).match(self.s[at:end]) if end >= 0 else None
        if self.html:
            self._leaf(COMMENT, self.s[at + 1 : end if end >= 0 else len(self.s)], at)
            self.at = end + 1 or len(self.s)
            return
        if not m or m[1].lower() == "xml":
            raise ShredError("malformed processing instruction", at)
        attrs = []
        if self.options.get("piAttribute"):
            attrs = [(a[1], a[2] if a[2] is not None else a[3]) for a in _ATTR.finditer(" " + (m[2] or ""))]
        self._leaf(PI, m[2] or "", at, m[1], attrs)
        self.at = end + 2

    def _doctype(self, at: int) -> None:
        s, k, depth, quote = self.s, at + 9, 0, None
        while k < len(s):
            c = s[k]
            if quote:
                quote = None if c == quote else quote
            elif s.startswith("<!--", k) and (end := s.find("-->", k)) >= 0:
                k = end + 2
            elif c in "\"'":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
            elif c == ">" and depth == 0:
                break
            k += 1
        self.at = k + 1
        if self.html:
            return
        if self.roots or self.dtd or k >= len(s):
            raise ShredError("misplaced or unclosed DOCTYPE", at)
        try:
            self.dtd = parse_doctype(s[at : k + 1], self.options.get)
        except DtdError as e:
            raise ShredError(str(e), at, "declaration") from None

    def _special(self, at: int) -> None:
        """What only the extension options allow."""
        s, get = self.s, self.options.get
        if get("emptyEnd") and s.startswith("</>", at):
            self.at = at + 3
            self._end(self.stack[-1].raw, at)
            return
        if get("restart") and (m := re.compile(rf"<\|({QNAME})?>").match(s, at)) and (not m[1] or get("restartName")):
            name = m[1] or self.stack[-1].raw
            self.at = m.end()
            self._end(name, at)
            self._start(name, [], False, at)
            return
        if get("suspend") and (m := re.compile(rf"<([-+])({QNAME})>").match(s, at)):
            self.at = m.end()
            (self._end if m[1] == "-" else lambda n, a: self._start(n, [], False, a))(m[2], at)
            return
        if get("simultaneous") and (m := re.compile(rf"<(/?)({QNAME}(?:\|{QNAME})+|(?:{QNAME})?\|)((?:\s+{QNAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*)\s*>").match(s, at)):
            self.at = m.end()
            names = [n for n in m[2].split("|") if n]
            for n in reversed(names) if m[1] else names:
                self._end(n, at) if m[1] else self._start(n, [(a[1], a[2] if a[2] is not None else a[3]) for a in _ATTR.finditer(m[3])], False, at)
            return
        m = re.compile(rf"<({QNAME})").match(s, at)
        if not m or not self.extended:
            raise ShredError("malformed tag", at)
        k, attrs = m.end(), []
        while True:
            e = re.compile(r"\s*(/?)>").match(s, k)
            if e:
                self.at = e.end()
                self._start(m[1], attrs, bool(e[1]), at)
                return
            sign = re.compile(rf"\s+([-+])({QNAME})(?=[\s/>])").match(s, k)
            if sign and get("booleanAttribute"):
                attrs.append((sign[2], (sign[2] if get("booleanIsName") else "1") if sign[1] == "+" else "0"))
                k = sign.end()
                continue
            a = re.compile(rf"\s+({QNAME})\s*(!?)=\s*").match(s, k)
            if not a or a[2] and not get("bangAttribute"):
                raise ShredError("malformed attribute", k)
            opener = s[a.end() : a.end() + 1]
            if opener in self.quotes:
                end = s.find(self.quotes[opener], a.end() + 1)
                if end < 0 or "<" in s[a.end() + 1 : end]:
                    raise ShredError("malformed attribute value", k)
                value, k = s[a.end() + 1 : end], end + 1
            elif get("unQuotedAttribute") and (u := re.compile(r"[^\s\"'=<>`]+?(?=\s|/?>)").match(s, a.end())):
                value, k = u[0], u.end()
            else:
                raise ShredError("attribute value is not quoted", k)
            if a[2]:
                self.bang[(m[1], a[1])] = value
            attrs.append((a[1], value))

    def _loose(self, at: int) -> None:
        s = self.s
        if m := _LOOSE_END.match(s, at):
            self.at = m.end()
            name = self.fold_element(m[1])
            if any(o.tag == name for o in self.stack):
                self._flush()
                while self.stack[-1].tag != name:
                    self._pop()
                self._pop()
            return
        m = _LOOSE_TAG.match(s, at)
        if not m:
            self.text.append("<")
            self.at = at + 1
            return
        self.at = m.end()
        name, body = self.fold_element(m[1]), m[2]
        if len(self.stack) > 1:
            for shut, inside in ((({"p"} if name in BLOCKS else set()), CONTAINERS["p"]), (CLOSES.get(name, set()), CONTAINERS.get(name, frozenset()))):
                if not shut:
                    continue
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag in shut:
                        self._flush()
                        while len(self.stack) > k:
                            self._pop()
                        break
                    if self.stack[k].tag in inside:
                        break
        attrs = [(a[1], next((x for x in (a[2], a[3], a[4]) if x is not None), "")) for a in _LOOSE_ATTR.finditer(body.rstrip().rstrip("/"))]
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(self.fold_attribute(k), v)
        self._start(name, list(seen.items()), name in VOID or body.endswith("/") and name not in RAW and name not in BLOCKS, at)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(s, self.at)
            stop = end.start() if end else len(s)
            if stop > self.at:
                self.text.append(s[self.at : stop] if name in ("script", "style", "xmp") else _REF.sub(lambda r: self._reference(r, self.at)[0], s[self.at : stop]))
            self.at = stop

    # -- nodes ---------------------------------------------------------------

    def _emit(self, kind: int, name: str, data: str | None, in_cdata: bool = False, prefix=None, local=None, ns_uri=None, attrs=()) -> int:
        up, pre = self.stack[-1], len(self.rows)
        place = up.total
        up.total = place + 1
        self.rows.append([
            pre, pre, up.pre if up.pre >= 0 else None, len(up.path) + 1, place, up.elems if kind == ELEMENT else None, 0, kind, name, prefix, local, ns_uri, data, in_cdata,
            (*up.path, place + 1), up.anc, attrs, up.tag_path + "/" + name,
        ])
        if kind == ELEMENT:
            up.elems += 1
        return pre

    def _flush(self) -> None:
        if self.text:
            data = "".join(self.text)
            self.text = []
            if len(self.stack) == 1 and not self.options.fragment:
                if data.strip() and not self.html:
                    raise ShredError("text outside the document element", self.at)
                if not data.strip() or not self.html:
                    return
            if data and (self.options.keep_space or data.strip()):
                self._emit(TEXT, "#text", data)

    def _leaf(self, kind: int, data: str, at: int, name: str | None = None, attrs=()) -> None:
        self._flush()
        if len(self.stack) > 1 or self.options.fragment:
            self._emit(kind, name or ("#comment" if kind == COMMENT else "#pi"), data, attrs=[(k, None, k, None, self._value(v, at), True) for k, v in attrs])

    def _start(self, raw: str, given: list[tuple[str, str]], empty: bool, at: int, ready: bool = False) -> None:
        self._flush()
        name = self.fold_element(raw)
        if self.omit_end and self.dtd and len(self.stack) > 1:
            while len(self.stack) > 1 and (d := self.dtd.element(self.stack[-1].tag)) and d["omit_end"] and not re.search(rf"(?<![\w.:-]){re.escape(name)}(?![\w.:-])|ANY", d["model"]):
                self._pop()
        if len(self.stack) == 1:
            self.roots += 1
            if self.roots > 1 and not self.options.fragment and not self.html:
                raise ShredError("more than one document element", at)
        if len(self.stack) > self.options.max_depth:
            raise ShredError("elements are nested too deeply", at)
        up = self.stack[-1]
        if ready:
            pairs = given
        elif self.no_norm:  # only what is declared is normalized
            declared = {a["attr"] for a in self.dtd.attrs if a["elem"] in (name, "*")} if self.dtd else ()
            pairs = [(k, self._value(v, at, norm=k in declared)) for k, v in ((self.fold_attribute(k), v) for k, v in given)]
        else:
            pairs = [(self.fold_attribute(k), self._value(v, at)) for k, v in given]
        have, extra = {k for k, _ in pairs}, []
        if len(have) < len(pairs):
            raise ShredError(f"attribute given twice on {raw}", at)
        if self.dtd:
            extra = [(k, v) for k, v in self.dtd.defaults(name) if k not in have]
        if self.bang:
            extra += [(k, v) for (e, k), v in self.bang.items() if e == raw and k not in have]
        ns = up.ns
        plain = not extra and "xmlns" not in have and ":" not in "".join(have)
        for k, v in () if plain else [*pairs, *extra]:
            if k == "xmlns" or k.startswith("xmlns:"):
                prefix = k[6:]
                if not self.html and (prefix and not v or prefix in ("xml", "xmlns")):
                    raise ShredError(f"prefix {prefix} can not be declared so", at, "namespace")
                ns = {**ns, prefix: v}
        prefix, local = name.split(":", 1) if ":" in name else (None, name)
        if prefix is not None and prefix not in ns and not self.html and not self.options.open_prefixes:
            raise ShredError(f"undeclared prefix {prefix}", at, "namespace")
        attrs = [(k, None, k, None, v, True) for k, v in pairs] if plain else []
        for k, v, given_here in () if plain else [*[(k, v, True) for k, v in pairs], *[(k, v, False) for k, v in extra]]:
            p, n = k.split(":", 1) if ":" in k else (None, k)
            uri = XMLNS_NS if k == "xmlns" or p == "xmlns" else ns.get(p) if p else None
            if p and uri is None and not self.html and not self.options.open_prefixes:
                raise ShredError(f"undeclared prefix {p}", at, "namespace")
            attrs.append((k, p, n, uri, v, given_here))
        pre = self._emit(ELEMENT, name, None, prefix=prefix, local=local, ns_uri=ns.get(prefix or "") or None, attrs=attrs)
        row = self.rows[pre]
        me = _Open(pre, name, raw, ns, row[_PATH], (*up.anc, pre), row[_TAG_PATH])
        self.stack.append(me)
        if empty:
            self._pop()

    def _end(self, raw: str, at: int) -> None:
        self._flush()
        name, get = self.fold_element(raw), self.options.get
        if self.stack[-1].tag != name:
            open_ = [k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == name]
            if not open_:
                raise ShredError(f"end tag {raw} without start", at)
            if get("olist"):  # what is open inside is closed here and opened again
                inner = self.stack[open_[0] + 1 :]
                while len(self.stack) > open_[0]:
                    self._pop()
                for o in inner:
                    self._start(o.raw, [], False, at)
                return
            if not (get("omitEnd") and all((d := self.dtd and self.dtd.element(o.tag)) and d["omit_end"] or not self.dtd for o in self.stack[open_[0] + 1 :])):
                raise ShredError(f"end tag {raw} does not match {self.stack[-1].raw}", at)
            while self.stack[-1].tag != name:
                self._pop()
        self._pop()

    def _pop(self) -> None:
        o = self.stack.pop()
        row = self.rows[o.pre]
        row[_LAST], row[_N_CHILDREN] = len(self.rows) - 1, o.total


def line_of(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


_ARROW = pa.schema([
    ("doc_id", pa.int64()), *[(n, pa.int32()) for n in ("pre", "last", "parent", "depth", "ord", "ord_e", "n_children")], ("node_type", pa.int8()),
    *[(n, pa.string()) for n in ("name", "prefix", "local", "ns_uri", "data")], ("in_cdata", pa.bool_()), ("path", pa.list_(pa.int32())), ("anc", pa.list_(pa.int32())),
    ("attrs", pa.list_(pa.struct([("name", pa.string()), ("prefix", pa.string()), ("local", pa.string()), ("ns_uri", pa.string()), ("value", pa.string()), ("specified", pa.bool_())]))), ("tag_path", pa.string()),
])


def _nested(rows: list, kind: pa.ListType) -> pa.ListArray:
    """Rows of tuples as a list array, built from its flat values."""
    offsets, flat, inner = pa.array([0, *accumulate(map(len, rows))], pa.int32()), list(chain.from_iterable(rows)), kind.value_type
    if pa.types.is_struct(inner):
        fields = list(inner)
        parts = zip(*flat, strict=True) if flat else [()] * len(fields)
        values = pa.StructArray.from_arrays([pa.array(p, f.type) for p, f in zip(parts, fields, strict=True)], fields=fields)
    else:
        values = pa.array(flat, inner)
    return pa.ListArray.from_arrays(offsets, values, type=kind)


def node_batch(cols: dict[str, list], ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[_nested(cols[f.name], f.type) if pa.types.is_list(f.type) else pa.array(cols[f.name], f.type) for f in list(_ARROW)[1:]]], schema=_ARROW)


def _shred_batches(options: ShredOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # rows hold no cycles, and there are millions to go through in vain
        try:
            shredder = Shredder(options)
            for batch in batches:
                cols, ids = {n: [] for n, _ in NODE_FIELDS}, []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        got = shredder.shred(text or "") if text is not None else None
                    except (ShredError, ValueError, RecursionError) as e:
                        if options.on_error == "failfast":
                            raise
                        offset = getattr(e, "offset", 0)
                        got = {n: [None] for n, _ in NODE_FIELDS} | {"node_type": [ERROR], "name": [getattr(e, "kind", "syntax")], "data": [str(e)], "pre": [offset], "last": [line_of(text, offset)], "attrs": [[]], "path": [[]], "anc": [[]]}
                    if got:
                        for n in cols:
                            cols[n] += got[n]
                        ids += [doc_id] * len(got["pre"])
                    if len(ids) > 20_000:
                        yield node_batch(cols, ids)
                        cols, ids = {n: [] for n, _ in NODE_FIELDS}, []
                if ids:
                    yield node_batch(cols, ids)
        finally:
            if collects:
                gc.enable()

    return run


def shred(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: ShredOptions | None = None) -> DataFrame:
    """Rows of nodes; a document that fails is one row of ``node_type`` -1 (``name``: kind, ``data``: message, ``pre``: offset, ``last``: line)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_shred_batches(options or ShredOptions()), NODES)
