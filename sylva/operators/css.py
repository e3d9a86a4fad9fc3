"""CSS selectors: text to a small syntax tree, the tree to a chain of structural joins.

Simple tests become filters over node columns, attributes being nested; combinators
become joins from right to left, as semi-joins, so nothing has to be made distinct:
the subject is filtered by the existence of what its left part demands.  Results are
sets in document order when sorted by (doc_id, pre).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import casefold, tokens
from sylva.operators.attrs import attribute, inherited
from sylva.operators.positions import of_type_positions

_IDENT = r"(?:--|-?(?:[A-Za-z_]|[^\x00-\x7f]|\\.))(?:[\w-]|[^\x00-\x7f]|\\.)*"
_STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
_ATTR = re.compile(rf"\[\s*((?:{_IDENT}\|)?{_IDENT}(?::{_IDENT})?)\s*(?:([~|^$*]?=)\s*({_STRING}|{_IDENT}|[^\s\]\"']+)\s*([iIfFsS])?\s*)?\]")


class SelectorError(ValueError):
    pass


@dataclass
class Simple:
    """``kind``: tag, id, class, attr or a pseudo-class; ``arg`` as the kind needs."""

    kind: str
    arg: object = None


@dataclass
class Compound:
    tests: list[Simple] = field(default_factory=list)


@dataclass
class Complex:
    """Compounds and the combinators between them: ' ', '>', '+' or '~'."""

    parts: list[Compound]
    combinators: list[str]
    leading: str | None = None


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _unquote(s: str) -> str:
    return _unescape(s[1:-1] if s[:1] in "\"'" and s[:1] else s)


def parse_nth(s: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    s = s.strip().lower().replace(" ", "")
    if s in ("odd", "even"):
        return 2, int(s == "odd")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", s):
        return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", s):
        return 0, int(s)
    raise SelectorError(f"bad position {s}")


class _Parser:
    def __init__(self, text: str):
        self.s, self.at = text, 0

    def list(self, closing: bool = False, relative: bool = False) -> list[Complex]:
        out = [self.complex(closing, relative)]
        while self.take(","):
            out.append(self.complex(closing, relative))
        return out

    def space(self) -> bool:
        m = re.compile(r"\s*").match(self.s, self.at)
        self.at = m.end()
        return bool(m[0])

    def take(self, c: str) -> bool:
        self.space()
        if self.s.startswith(c, self.at):
            self.at += len(c)
            return True
        return False

    def complex(self, closing: bool, relative: bool) -> Complex:
        self.space()
        leading = None
        if relative:
            m = re.compile(r"[>+~]").match(self.s, self.at)
            leading = m[0] if m else " "
            self.at = m.end() if m else self.at
            self.space()
        parts, combinators = [self.compound()], []
        while True:
            had = self.space()
            if self.at >= len(self.s) or self.s[self.at] == "," or closing and self.s[self.at] == ")":
                return Complex(parts, combinators, leading)
            m = re.compile(r"[>+~]").match(self.s, self.at)
            if m:
                self.at = m.end()
                self.space()
                combinators.append(m[0])
            elif had:
                combinators.append(" ")
            else:
                raise SelectorError(f"unexpected {self.s[self.at:]!r}")
            parts.append(self.compound())

    def compound(self) -> Compound:
        out, start = Compound(), self.at
        if m := re.compile(rf"\*|{_IDENT}(?:\|(?:\*|{_IDENT}))?").match(self.s, self.at):
            self.at = m.end()
            out.tests.append(Simple("tag", _unescape(m[0]).replace("|", ":")))
        while self.at < len(self.s):
            if m := re.compile(rf"([#.])({_IDENT}|[\w-]+)").match(self.s, self.at):
                out.tests.append(Simple("id" if m[1] == "#" else "class", _unescape(m[2])))
                self.at = m.end()
            elif m := _ATTR.match(self.s, self.at):
                out.tests.append(Simple("attr", (_unescape(m[1]).replace("|", ":"), m[2], _unquote(m[3]) if m[3] else None, (m[4] or "").lower())))
                self.at = m.end()
            elif m := re.compile(r"::?([A-Za-z-]+)(\()?").match(self.s, self.at):
                self.at = m.end()
                out.tests.append(self.pseudo(m[1].lower(), bool(m[2])))
            else:
                break
        if self.at == start:
            raise SelectorError(f"selector expected at {self.s[self.at:]!r}")
        return out

    def pseudo(self, name: str, called: bool) -> Simple:
        if name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "root", "empty") and not called:
            return Simple(name)
        if not called:
            raise SelectorError(f"unsupported pseudo-class {name}")
        if name in ("not", "is", "where", "matches", "has"):
            arg = self.list(closing=True, relative=name == "has")
            if not self.take(")"):
                raise SelectorError("unclosed parenthesis")
            return Simple("is" if name in ("where", "matches") else name, arg)
        end = self.s.find(")", self.at)
        if end < 0:
            raise SelectorError("unclosed parenthesis")
        arg, self.at = self.s[self.at : end].strip(), end + 1
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            return Simple(name, parse_nth(arg))
        if name == "lang":
            return Simple("lang", _unquote(arg))
        raise SelectorError(f"unsupported pseudo-class {name}")


def parse(selector: str) -> list[Complex]:
    p = _Parser(selector.strip())
    out = p.list()
    p.space()
    if p.at < len(p.s):
        raise SelectorError(f"unexpected {p.s[p.at:]!r}")
    return out


_OF_TYPE = {"first-of-type", "last-of-type", "only-of-type", "nth-of-type", "nth-last-of-type", "last-child", "only-child", "nth-last-child"}


def _walk(selectors: list[Complex]):
    for c in selectors:
        for part in c.parts:
            for t in part.tests:
                yield t
                if isinstance(t.arg, list):
                    yield from _walk(t.arg)


def _nth(place: Column, ab: tuple[int, int]) -> Column:
    a, b = ab
    return place == b if a == 0 else ((place - b) % a == 0) & ((place - b) / a >= 0)


def _attr_test(arg) -> Column:
    name, op, want, flag = arg
    value = attribute(name)
    if op is None:
        return F.coalesce(value.isNotNull(), F.lit(False))
    if flag == "i":
        value, want = F.lower(value), want.lower()
    elif flag == "f":
        value, want = casefold(value), want.casefold()
    w = F.lit(want)
    if op != "=" and op != "|=" and want == "":
        return F.lit(False)
    hit = {
        "=": lambda: value == w, "~=": lambda: F.array_contains(tokens(value), want) if not re.search(r"\s", want) else F.lit(False),
        "|=": lambda: (value == w) | F.startswith(value, F.lit(want + "-")), "^=": lambda: F.startswith(value, w), "$=": lambda: F.endswith(value, w), "*=": lambda: F.contains(value, w),
    }[op]()
    return F.coalesce(hit, F.lit(False))


_PLACES = {"first-child": ("n_child", (0, 1)), "last-child": ("n_last_child", (0, 1)), "first-of-type": ("n_of_type", (0, 1)), "last-of-type": ("n_last_of_type", (0, 1))}
_NTH = {"nth-child": "n_child", "nth-last-child": "n_last_child", "nth-of-type": "n_of_type", "nth-last-of-type": "n_last_of_type"}


def _filter_of(t: Simple, id_attr: str) -> Column | None:
    """A test that needs no join; None when it does."""
    if t.kind == "tag":
        if t.arg == "*":
            return F.lit(True)
        return (F.col("local") == t.arg[2:]) if t.arg.startswith("*:") else (F.col("name") == t.arg)
    if t.kind == "id":
        return F.coalesce(attribute(id_attr) == t.arg, F.lit(False))
    if t.kind == "class":
        return F.array_contains(tokens(attribute("class")), t.arg)
    if t.kind == "attr":
        return _attr_test(t.arg)
    if t.kind in _PLACES:
        return _nth(F.col(_PLACES[t.kind][0]), _PLACES[t.kind][1])
    if t.kind in _NTH:
        return _nth(F.col(_NTH[t.kind]), t.arg)
    if t.kind == "only-child":
        return (F.col("n_child") == 1) & (F.col("n_last_child") == 1)
    if t.kind == "only-of-type":
        return (F.col("n_of_type") == 1) & (F.col("n_last_of_type") == 1)
    if t.kind == "root":
        return F.col("depth") == 1
    return None


class _Compiler:
    """``pool``: all elements with the positions that the selector needs."""

    def __init__(self, forest: DataFrame, selectors: list[Complex], id_attr: str):
        kinds = {t.kind for t in _walk(selectors)}
        self.forest, self.id_attr = forest, id_attr
        if kinds & _OF_TYPE:
            self.pool = of_type_positions(forest)
        else:
            self.pool = forest.filter("node_type = 1").withColumn("n_child", F.col("ord_e") + 1)

    def compound(self, rows: DataFrame, c: Compound) -> DataFrame:
        later = []
        for t in c.tests:
            f = _filter_of(t, self.id_attr)
            if f is None:
                later.append(t)
            else:
                rows = rows.filter(f)
        for t in later:
            rows = self.joined(rows, t)
        return rows

    def joined(self, rows: DataFrame, t: Simple) -> DataFrame:
        key = ["doc_id", "pre"]
        if t.kind == "empty":  # comments and instructions do not count
            full = self.forest.filter(F.col("node_type").isin(1, 3)).select("doc_id", F.col("parent").alias("pre")).filter("pre is not null")
            return rows.join(full, key, "left_anti")
        if t.kind == "lang":
            lang = inherited(self.forest, rows, "xml:lang").join(inherited(self.forest, rows, "lang").withColumnRenamed("value", "_l"), key)
            v = F.lower(F.coalesce("value", "_l"))
            want = t.arg.lower()
            return rows.join(lang.filter((v == want) | F.startswith(v, F.lit(want + "-"))).select(key), key, "left_semi")
        if t.kind in ("is", "not"):
            simple = [self.inline(c) for c in t.arg]
            if all(s is not None for s in simple):
                hit = simple[0]
                for s in simple[1:]:
                    hit = hit | s
                return rows.filter(~hit if t.kind == "not" else hit)
            return rows.join(self.any_of(t.arg).select(key), key, "left_anti" if t.kind == "not" else "left_semi")
        if t.kind == "has":
            out = None
            for c in t.arg:
                anchors = self.reaching(c)
                out = anchors if out is None else out.unionByName(anchors)
            return rows.join(out, key, "left_semi")
        raise SelectorError(f"unsupported test {t.kind}")

    def inline(self, c: Complex) -> Column | None:
        """A one-compound selector as a filter, if it needs no join."""
        if len(c.parts) > 1:
            return None
        out = F.lit(True)
        for t in c.parts[0].tests:
            f = _filter_of(t, self.id_attr)
            if f is None:
                return None
            out = out & f
        return out

    def left_exists(self, rows: DataFrame, left: DataFrame, combinator: str) -> DataFrame:
        """Rows that have a left neighbour of the kind the combinator says."""
        if combinator == ">":
            return rows.join(left.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi")
        if combinator == "+":
            return rows.join(left.select("doc_id", "parent", (F.col("ord_e") + 1).alias("ord_e")), ["doc_id", "parent", "ord_e"], "left_semi")
        if combinator == "~":  # the first such sibling decides
            first = left.filter("parent is not null").groupBy("doc_id", "parent").agg(F.min("ord_e").alias("_f"))
            return rows.join(first, ["doc_id", "parent"]).filter("ord_e > _f").drop("_f")
        hits = rows.select("doc_id", "pre", F.explode("anc").alias("_a")).join(left.select("doc_id", F.col("pre").alias("_a")), ["doc_id", "_a"], "left_semi").select("doc_id", "pre")
        return rows.join(hits, ["doc_id", "pre"], "left_semi")

    def complex(self, c: Complex) -> DataFrame:
        rows = self.compound(self.pool, c.parts[0])
        for combinator, part in zip(c.combinators, c.parts[1:], strict=True):
            rows = self.left_exists(self.compound(self.pool, part), rows, combinator)
        return rows

    def reaching(self, c: Complex) -> DataFrame:
        """(doc_id, pre) of elements from which the relative selector reaches something."""
        rows = self.compound(self.pool, c.parts[-1])
        steps = [c.leading or " ", *c.combinators]
        for k in range(len(c.parts) - 1, -1, -1):
            up = self.sources(rows, steps[k])
            rows = self.compound(self.pool.join(up, ["doc_id", "pre"], "left_semi"), c.parts[k - 1]) if k else up
        return rows

    def sources(self, rows: DataFrame, combinator: str) -> DataFrame:
        if combinator == ">":
            return rows.select("doc_id", F.col("parent").alias("pre")).filter("pre is not null")
        if combinator == " ":
            return rows.select("doc_id", F.explode("anc").alias("pre"))
        pool = self.pool.select("doc_id", "parent", "ord_e", "pre")
        if combinator == "+":
            return pool.join(rows.select("doc_id", "parent", (F.col("ord_e") - 1).alias("ord_e")), ["doc_id", "parent", "ord_e"], "left_semi").select("doc_id", "pre")
        last = rows.filter("parent is not null").groupBy("doc_id", "parent").agg(F.max("ord_e").alias("_m"))
        return pool.join(last, ["doc_id", "parent"]).filter("ord_e < _m").select("doc_id", "pre")

    def any_of(self, selectors: list[Complex]) -> DataFrame:
        out = self.complex(selectors[0])
        for c in selectors[1:]:
            out = out.unionByName(self.complex(c))
        return out.dropDuplicates(["doc_id", "pre"]) if len(selectors) > 1 else out


def path_shortcut(c: Complex) -> Column | None:
    """A chain of plain tags with child combinators as one pattern over the stored tag path: no join at all."""
    if any(x != ">" for x in c.combinators) or not all(len(p.tests) == 1 and p.tests[0].kind == "tag" and ":" not in p.tests[0].arg for p in c.parts):
        return None
    chain = "/".join("[^/]+" if p.tests[0].arg == "*" else re.escape(p.tests[0].arg) for p in c.parts)
    return F.regexp_like(F.col("tag_path"), F.lit(f"/{chain}$"))


def select(forest: DataFrame, selector: str, id_attr: str = "id") -> DataFrame:
    """The elements that a selector list matches, once each, with the columns of ``forest``."""
    tree = parse(selector)
    if len(tree) == 1 and len(tree[0].parts) > 1 and (shortcut := path_shortcut(tree[0])) is not None:
        return forest.filter("node_type = 1").filter(shortcut)
    compiler = _Compiler(forest, tree, id_attr)
    return compiler.any_of(tree).select(*forest.columns)


def select_first(forest: DataFrame, selector: str) -> DataFrame:
    """The first match of every document."""
    first = select(forest, selector).groupBy("doc_id").agg(F.min("pre").alias("pre"))
    return forest.join(first, ["doc_id", "pre"], "left_semi")


def matches(forest: DataFrame, ctx: DataFrame, selector: str) -> DataFrame:
    """Context nodes that match."""
    return ctx.join(select(forest, selector).select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")


def closest(forest: DataFrame, ctx: DataFrame, selector: str) -> DataFrame:
    """(doc_id, from_pre, pre): the nearest ancestor-or-self that matches."""
    hit = select(forest, selector).select("doc_id", F.col("pre").alias("_a"))
    up = ctx.select("doc_id", F.col("pre").alias("from_pre"), F.explode(F.concat("anc", F.array("pre"))).alias("_a"))
    return up.join(hit, ["doc_id", "_a"]).groupBy("doc_id", "from_pre").agg(F.max("_a").alias("pre"))
