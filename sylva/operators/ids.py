"""The ID index: which attribute identifies an element, and the table of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import normalize_case


@dataclass(frozen=True)
class IdChoice:
    """An attribute that holds ids: any part may be ``*``.  ``make`` may compute the id from the element's row instead."""

    elem: str = "*"
    attr: str = "id"
    elem_ns: str = "*"
    attr_ns: str = "*"
    make: object = None


def id_value(choices: list[IdChoice], declared_ids: list[tuple[str, str]] = (), fold: str = "NONE") -> Column:
    """xml:id first, then declared ID attributes, then the choices in order; trimmed and folded."""
    def pick(test) -> Column:
        return F.get(F.filter("attrs", test), F.lit(0))["value"]

    def named(n: str):
        return lambda a: a["name"] == n

    def local(n: str, uri: str):
        return lambda a: (a["local"] == n) & ((a["ns_uri"] == uri) if uri != "*" else F.lit(True))

    found = [pick(named("xml:id"))]
    for elem, attr in declared_ids:
        here = F.lit(True) if elem == "*" else F.col("name") == elem
        found.append(F.when(here, pick(named(attr))))
    for c in choices:
        here = F.lit(True)
        if c.elem != "*":
            here = here & ((F.col("name") == c.elem) | (F.col("local") == c.elem))
        if c.elem_ns != "*":
            here = here & (F.col("ns_uri") == c.elem_ns)
        value = c.make(F) if c.make else F.coalesce(pick(named(c.attr)), pick(local(c.attr, c.attr_ns)))
        found.append(F.when(here, value))
    return F.nullif(F.trim(normalize_case(F.coalesce(*found), fold)), F.lit(""))


def candidates(forest: DataFrame, choices: list[IdChoice] | None = None, declared_ids: list[tuple[str, str]] = (), fold: str = "NONE") -> DataFrame:
    rows = forest.filter("node_type = 1").select("doc_id", "pre", id_value(choices if choices is not None else [IdChoice()], declared_ids, fold).alias("id"))
    return rows.filter("id is not null")


def build_index(forest: DataFrame, choices: list[IdChoice] | None = None, declared_ids: list[tuple[str, str]] = (), fold: str = "NONE") -> DataFrame:
    """(doc_id, id, pre, uses): the last element wins, ``uses`` above 1 shows a duplicate."""
    return candidates(forest, choices, declared_ids, fold).groupBy("doc_id", "id").agg(F.max("pre").alias("pre"), F.count(F.lit(1)).alias("uses"))


def by_id(forest: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes for (doc_id, id) pairs."""
    return forest.join(index.join(wanted.select("doc_id", "id"), ["doc_id", "id"]).select("doc_id", "pre", "id"), ["doc_id", "pre"])


def id_paths(forest: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, pre, path_text): the id of the nearest ancestor-or-self that has one, then the child numbers below it."""
    own = index.select("doc_id", F.col("pre").alias("_a"), "id")
    up = forest.select("doc_id", "pre", "path", F.explode(F.concat("anc", F.array("pre"))).alias("_a"))
    # the anchor's depth is its place among the ancestors: the path below starts after it
    near = up.join(own, ["doc_id", "_a"]).groupBy("doc_id", "pre").agg(F.max(F.struct("_a", "id")).alias("k"))
    depth = forest.select(F.col("doc_id").alias("_dd"), F.col("pre").alias("_p"), F.col("depth").alias("_dp"))
    joined = forest.filter("node_type > 0").select("doc_id", "pre", "path").join(near, ["doc_id", "pre"], "left").join(depth, (F.col("_p") == F.col("k._a")) & (F.col("_dd") == F.col("doc_id")), "left")
    below = F.expr("slice(path, coalesce(_dp, 0) + 1, size(path))").cast("array<string>")
    return joined.select("doc_id", "pre", F.when(F.col("k").isNull(), F.array_join(F.col("path").cast("array<string>"), "/")).otherwise(F.array_join(F.concat(F.array(F.col("k.id")), below), "/")).alias("path_text"))


def idref_edges(forest: DataFrame, index: DataFrame, attr: str = "idref") -> DataFrame:
    """(doc_id, from_pre, to_pre) for every token of an IDREF(S) attribute that an id answers."""
    from sylva.functions.text import tokens
    from sylva.operators.attrs import attribute

    refs = forest.filter("node_type = 1").select("doc_id", F.col("pre").alias("from_pre"), F.explode(tokens(attribute(attr))).alias("id"))
    return refs.join(index, ["doc_id", "id"]).select("doc_id", "from_pre", F.col("pre").alias("to_pre"))
