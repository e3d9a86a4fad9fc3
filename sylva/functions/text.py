"""Scalar functions on strings: white space, case, Unicode forms, names, escapes.

Everything is a Column expression, but for what Spark has no function for: Unicode
normalization, full case folding and named references are Arrow-batched.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import codepoint2name, html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sylva.sources.shred import NCNAME, QNAME

# The white-space definitions.
_XML, _WHATWG, _CPP = " \t\n\r", " \t\n\r\f", " \t\n\r\f\v"
_UNICODE = _CPP + "\x85\xa0                　"
SPACES = {
    "XML": _XML, "WHATWG": _WHATWG, "CPP": _CPP, "UNICODE_ALL": _UNICODE,
    "JAVASCRIPT": _UNICODE.replace("\x85", "﻿"), "PY_ISSPACE": _UNICODE,
    "AGGRESSIVE": _UNICODE + "\x1c\x1d\x1e\x1f᠎​‌‍⁠﻿⠀ㅤ",
}


def _class(kind: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES[kind]) + "]"


def is_space(s: Column, kind: str = "XML") -> Column:
    """Non-empty and nothing but white space; null counts as no."""
    return F.coalesce(F.regexp_like(s, F.lit(f"^{_class(kind)}+\\z")), F.lit(False))


def has_space(s: Column, kind: str = "XML") -> Column:
    return F.coalesce(F.regexp_like(s, F.lit(_class(kind))), F.lit(False))


def strip(s: Column, kind: str = "XML") -> Column:
    return F.trim(s, F.lit(SPACES[kind]))


def lstrip(s: Column, kind: str = "XML") -> Column:
    return F.ltrim(s, F.lit(SPACES[kind]))


def rstrip(s: Column, kind: str = "XML") -> Column:
    return F.rtrim(s, F.lit(SPACES[kind]))


def replace_space(s: Column, kind: str = "XML") -> Column:
    """Every white-space character becomes a blank."""
    return F.translate(s, SPACES[kind], " " * len(SPACES[kind]))


def normalize_space(s: Column, kind: str = "XML") -> Column:
    """Runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(s, _class(kind) + "+", " "))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def normalize_case(s: Column, how: str = "NONE") -> Column:
    return {"NONE": lambda x: x, "LOWER": F.lower, "UPPER": F.upper, "FOLD": casefold}[how](s)


def compare_case(a: Column, b: Column, how: str = "NONE") -> Column:
    """-1, 0 or 1."""
    x, y = normalize_case(a, how), normalize_case(b, how)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def unicode_form(s: Column, form: str) -> Column:
    """NFC, NFD, NFKC, NFKD or NONE."""
    if form == "NONE":
        return s

    @F.pandas_udf(StringType())
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return normal(s)


def normalize(s: Column, form: str = "NONE", case: str = "NONE", spaces: str = "XML") -> Column:
    """Unicode form, then case, then white space."""
    return normalize_space(normalize_case(unicode_form(s, form), case), spaces)


# -- names -----------------------------------------------------------------


def _java(pattern: str) -> str:
    """Characters beyond ASCII as Java escapes, so that a pattern survives any encoding."""
    return "".join(c if ord(c) < 128 else f"\\x{{{ord(c):x}}}" for c in pattern)


def _whole(pattern: str):
    def test(s: Column) -> Column:
        return F.coalesce(F.regexp_like(s, F.lit(f"^(?:{_java(pattern)})\\z")), F.lit(False))

    return test


is_ncname = _whole(NCNAME)
is_xml_name = _whole(NCNAME.replace("[", "[:", 1).replace("0-9", ":0-9", 1))
is_qname = _whole(QNAME)
is_qqname = _whole(f"{NCNAME}(?::{NCNAME})*")
is_pname = _whole(f"{NCNAME}:{NCNAME}")
is_nmtoken = _whole("[:" + NCNAME[1 : NCNAME.index("]")] + "0-9.\\-·̀-ͯ‿-⁀]+")
is_xml_number = _whole("[0-9]+")
is_xml_chars = _whole("[\t\n\r\x20-퟿-�\U00010000-\U0010ffff]+".replace("퟿", "퟿"))
is_namespace_uri = _whole(r"[A-Za-z][A-Za-z0-9_+.-]*://.*|##any")
NAME_TESTS = {"XML": is_xml_name, "HTML": is_xml_name, "WHATWG": _whole("[^\\x00-\\x20\"'>/=\\x7f-\\x9f]+"), "ASCII": _whole("[A-Za-z_][A-Za-z_0-9.:-]*"), "PYTHON": _whole(r"[\p{L}_][\p{L}\p{N}\p{M}_]*")}


def prefix_part(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(":")), F.substring_index(s, ":", 1)).otherwise("")


def local_part(s: Column) -> Column:
    return F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, "^[^:]*:", "")).otherwise(s)


def drop_illegal(s: Column) -> Column:
    """Without the C0 controls and non-characters that XML has no place for."""
    return F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")


# -- escapes -----------------------------------------------------------------


def escape_text(s: Column, escape_gt: bool = False) -> Column:
    out = F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;")) if escape_gt else F.replace(out, F.lit("]]>"), F.lit("]]&gt;"))


def escape_attribute(s: Column, quote: str = '"', add_quotes: bool = False) -> Column:
    out = F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(quote), F.lit("&quot;" if quote == '"' else "&apos;"))
    return F.concat(F.lit(quote), out, F.lit(quote)) if add_quotes else out


def escape_cdata(s: Column, close: str = "]]&gt;") -> Column:
    return F.replace(s, F.lit("]]>"), F.lit(close))


def escape_comment(s: Column, dashes: str = "-&#x2d;") -> Column:
    return F.replace(s, F.lit("--"), F.lit(dashes))


def escape_pi(s: Column, close: str = "?&gt;") -> Column:
    return F.replace(s, F.lit("?>"), F.lit(close))


def char_reference(cp: int, base: int = 16, pad: int = 4, upper: bool = True, names: bool = True) -> str:
    if names and cp in codepoint2name:
        return f"&{codepoint2name[cp]};"
    if base == 10:
        return f"&#{cp:0{pad}d};"
    return f"&#X{cp:0{pad}X};" if upper else f"&#x{cp:0{pad}x};"


def escape_ascii(s: Column, base: int = 16, pad: int = 4, upper: bool = True, names: bool = True) -> Column:
    """Text escapes, and a named or numeric reference for everything beyond ASCII."""

    @F.pandas_udf(StringType())
    def ascii_only(x: pd.Series) -> pd.Series:
        return x.map(lambda v: re.sub(r"[^\x00-\x7f]", lambda m: char_reference(ord(m[0]), base, pad, upper, names), v), na_action="ignore")

    return ascii_only(escape_text(s))


def unescape(s: Column, unknown: str = "raise") -> Column:
    """Named and numeric references to characters; ``unknown``: raise or keep those of no character."""

    @F.pandas_udf(StringType())
    def plain(x: pd.Series) -> pd.Series:
        def one(m: re.Match) -> str:
            if m[1] or m[2]:
                cp = int(m[1]) if m[1] else int(m[2], 16)
                if cp <= 0x10FFFF and not 0xD800 <= cp < 0xE000:
                    return chr(cp)
                if unknown == "raise":
                    raise ValueError(f"no character has the number {cp}")
                return m[0]
            found = html5.get(m[3] + ";")
            if found is None and unknown == "raise":
                raise ValueError(f"unknown entity {m[3]}")
            return m[0] if found is None else found

        return x.map(lambda v: re.sub(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|(\w+));", one, v), na_action="ignore")

    return plain(s)


def slashify(s: Column, how: str = "UNICODE") -> Column:
    r"""Characters beyond ASCII as backslash escapes: HEX2 ``\xFF``, UNICODE ``ÿ``/``\U0001F600``, BRACE ``\x{FF}``."""

    @F.pandas_udf(StringType())
    def slashed(x: pd.Series) -> pd.Series:
        def one(m: re.Match) -> str:
            n = ord(m[0])
            if how == "BRACE":
                return f"\\x{{{n:X}}}"
            if how == "HEX2" and n < 256:
                return f"\\x{n:02X}"
            return f"\\u{n:04X}" if n < 65536 else f"\\U{n:08X}"

        return x.map(lambda v: re.sub(r"[^\x00-\x7f]", one, v), na_action="ignore")

    return slashed(s)


def escape_blocks(s: Column, blocks: list[tuple[int, int]], above: int | None = None, base: int = 16, pad: int = 4, names: bool = True) -> Column:
    """References for the characters of some code-point ranges (scripts), and for all above a threshold."""
    parts = [f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in blocks] + ([f"{re.escape(chr(above + 1))}-\U0010ffff"] if above is not None else [])
    pattern = "[" + "".join(parts) + "]" if parts else "(?!)"

    @F.pandas_udf(StringType())
    def escaped(x: pd.Series) -> pd.Series:
        return x.map(lambda v: re.sub(pattern, lambda m: char_reference(ord(m[0]), base, pad, True, names), v), na_action="ignore")

    return escaped(s)


def char_of(cp: Column) -> Column:
    """The character of a code point (``chr`` of Spark is modulo 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("int")), 8, "0")), "UTF-32")


def parse_int(s: Column, base: int = 10) -> Column:
    """Digits of base 2, 8, 10 or 16, with sign and prefix."""
    body = F.regexp_replace(F.lower(s), "^([+-]?)0[xob]", "$1")
    return F.conv(F.regexp_replace(body, "^[+]", ""), base, -10).cast("long")


def parse_float(s: Column, special: bool = True) -> Column:
    plain = F.when(F.regexp_like(s, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")), s.try_cast("double"))
    return F.when(F.lit(special) & s.isin("INF", "+INF"), float("inf")).when(F.lit(special) & (s == "-INF"), float("-inf")).when(F.lit(special) & (s == "NaN"), float("nan")).otherwise(plain)


# -- edits of character data: offsets are strict ---------------------------------


def _checked(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit("offset out of range")).cast("string"))


def substring_data(s: Column, offset: int, count: int) -> Column:
    return _checked(F.length(s) > offset + count, F.substring(s, offset + 1, count))


def insert_data(s: Column, offset: int, new: str) -> Column:
    return _checked(F.length(s) >= offset, F.concat(F.substring(s, 1, offset), F.lit(new), F.substr(s, F.lit(offset + 1))))


def delete_data(s: Column, offset: int, count: int) -> Column:
    return _checked(F.length(s) > offset + count, F.concat(F.substring(s, 1, offset), F.substr(s, F.lit(offset + count + 1))))


def replace_data(s: Column, offset: int, count: int, new: str) -> Column:
    return _checked(F.length(s) > offset + count, F.concat(F.substring(s, 1, offset), F.lit(new), F.substr(s, F.lit(offset + count + 1))))


def append_data(s: Column, new: str) -> Column:
    return F.concat(s, F.lit(new))


# -- token sets ----------------------------------------------------------------


def tokens(s: Column) -> Column:
    """Distinct white-space separated tokens, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(s, F.lit("")), r"[ \t\n\r\f]+"), lambda t: t != ""))


def add_token(s: Column, token: str) -> Column:
    return F.array_join(F.array_union(tokens(s), F.array(F.lit(token))), " ")


def remove_token(s: Column, token: str) -> Column:
    return F.array_join(F.array_remove(tokens(s), token), " ")


def replace_token(s: Column, token: str, new: str) -> Column:
    return F.array_join(F.array_distinct(F.transform(tokens(s), lambda t: F.when(t == token, F.lit(new)).otherwise(t))), " ")


def toggle_token(s: Column, token: str) -> Column:
    return F.when(F.array_contains(tokens(s), token), remove_token(s, token)).otherwise(add_token(s, token))
