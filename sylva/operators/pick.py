"""The pick mini-language of node brackets: positions, slices, names, attributes, axes, schemes.

    pick(forest, ctx, 3)            the child at a place (negative: from the end)
    pick(forest, ctx, slice(1, 4))  children of a slice
    pick(forest, ctx, "p")          child elements of a name;  ("p", 2), ("p", 1, 3): of those, a place or slice
    "*" elements, "**" descendant elements, "#text" and other node kinds, "/" the root, ".." the parent
    "@name"                         the attribute: (doc_id, from_pre, value)
    "scheme:data"                   a registered handler, called with (forest, ctx, data)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import axes
from sylva.operators.attrs import attribute
from sylva.operators.positions import slice_children

_SCHEMES: dict[str, Callable[[DataFrame, DataFrame, str], DataFrame]] = {}


def register_scheme(name: str, handler: Callable[[DataFrame, DataFrame, str], DataFrame]) -> None:
    if not name.isidentifier():
        raise ValueError(f"not a scheme name: {name}")
    _SCHEMES[name] = handler


def _placed(rows: DataFrame, at: tuple) -> DataFrame:
    """Of the nodes reached from each context node, those at a place or in a slice."""
    order = Window.partitionBy("doc_id", "from_pre").orderBy("pre")
    whole = Window.partitionBy("doc_id", "from_pre")
    n = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    place = lambda v: F.lit(v) if v >= 0 else F.col("_n") + v
    if len(at) == 1:
        hit = F.col("_i") == place(at[0])
    else:
        start, stop, step = (*at, None, None)[:3]
        low = place(start) if start is not None else F.lit(0)
        hit = (F.col("_i") >= low) & (F.col("_i") < (place(stop) if stop is not None else F.col("_n"))) & ((F.col("_i") - low) % (step or 1) == 0)
    return n.filter(hit).drop("_i", "_n")


def pick(forest: DataFrame, ctx: DataFrame, what) -> DataFrame:
    if isinstance(what, int):
        return slice_children(forest, ctx, what, what + 1 if what != -1 else None)
    if isinstance(what, slice):
        return slice_children(forest, ctx, what.start, what.stop, what.step or 1)
    if isinstance(what, tuple):
        return _placed(pick(forest, ctx, what[0]), what[1:])
    if what == "/":
        return axes.root(forest, ctx)
    if what == "..":
        return axes.parent(forest, ctx)
    if what == "**":
        return axes.descendants(forest, ctx, F.col("node_type") == 1)
    if what == "*":
        return axes.children(forest, ctx, F.col("node_type") == 1)
    if what.startswith("@"):
        return ctx.select("doc_id", F.col("pre").alias("from_pre"), attribute(what[1:]).alias("value")).filter("value is not null")
    if what.startswith("#"):
        kinds = {"#text": F.col("node_type") == 3, "#cdata": axes.is_type("cdata"), "#pi": F.col("node_type") == 7, "#comment": F.col("node_type") == 8}
        if what not in kinds:
            raise KeyError(f"no such kind of node: {what}")
        return axes.children(forest, ctx, kinds[what])
    if ":" in what and what.split(":", 1)[0] in _SCHEMES:
        scheme, data = what.split(":", 1)
        return _SCHEMES[scheme](forest, ctx, data)
    return axes.children(forest, ctx, axes.name_is(what))
