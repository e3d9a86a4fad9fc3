"""Positions among siblings and aggregates over subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _kept(only_elements: bool, of_name: str | None, skip_blank: bool) -> Column:
    keep = F.lit(True)
    if only_elements:
        keep = keep & (F.col("node_type") == 1)
    if of_name is not None:
        keep = keep & (F.col("name") == of_name)
    if skip_blank:
        keep = keep & ~((F.col("node_type") == 3) & (F.trim("data", F.lit(" \t\n\r")) == ""))
    return keep


def child_index(forest: DataFrame, only_elements: bool = False, of_name: str | None = None, skip_blank: bool = False, coalesce_text: bool = False, reverse: bool = False) -> DataFrame:
    """``forest`` with ``child_index``: from 0, or from the end with -1 as the last; ``coalesce_text`` counts adjacent texts once.

    Nodes that the options leave out have null.
    """
    keep = _kept(only_elements, of_name, skip_blank)
    order = Window.partitionBy("doc_id", "parent").orderBy(F.col("ord").desc() if reverse else F.col("ord"))
    if coalesce_text:
        keep = keep & ~F.coalesce((F.col("node_type") == 3) & (F.lag("node_type").over(order) == 3), F.lit(False))
    rows = forest.withColumn("_k", keep)
    before = F.count_if("_k").over(order.rowsBetween(Window.unboundedPreceding, -1))
    index = F.when(F.col("_k"), -1 - before if reverse else before)
    return rows.withColumn("child_index", index).drop("_k")


def of_type_positions(forest: DataFrame) -> DataFrame:
    """Elements with 1-based places: ``n_child``, ``n_last_child``, ``n_of_type``, ``n_last_of_type``; two windows over one shuffle."""
    e = forest.filter("node_type = 1")
    siblings = Window.partitionBy("doc_id", "parent")
    ordered = Window.partitionBy("doc_id", "parent", "name").orderBy("ord")
    backwards = Window.partitionBy("doc_id", "parent", "name").orderBy(F.col("ord").desc())
    return e.withColumn("n_child", F.col("ord_e") + 1).withColumn("n_last_child", F.count(F.lit(1)).over(siblings) - F.col("ord_e")).withColumn("n_of_type", F.row_number().over(ordered)).withColumn("n_last_of_type", F.row_number().over(backwards))


def text_content(forest: DataFrame, ctx: DataFrame, include_comments: bool = False) -> DataFrame:
    """(doc_id, pre, text) of context nodes: the data of all text below, in order; '' without any."""
    data = forest.filter(F.col("node_type").isin(3, 7, 8) if include_comments else F.col("node_type") == 3)
    below = data.select("doc_id", F.explode(F.concat("anc", F.array("pre"))).alias("pre"), F.col("pre").alias("_p"), "data")
    joined = ctx.select("doc_id", "pre").join(below, ["doc_id", "pre"], "left")
    return joined.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "data")))), lambda x: x["data"]), "").alias("text"))


def text_offsets(forest: DataFrame) -> DataFrame:
    """Texts with ``start`` and ``end``: offsets in the document's text content."""
    order = Window.partitionBy("doc_id").orderBy("pre")
    end = F.sum(F.length("data")).over(order)
    return forest.filter("node_type = 3").withColumn("end", end).withColumn("start", F.col("end") - F.length("data"))


def child_counts(forest: DataFrame) -> DataFrame:
    return forest.filter("parent is not null").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node_type") == 1).alias("n_elements"), F.count_if(F.col("node_type") == 3).alias("n_texts"))


def slice_children(forest: DataFrame, ctx: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Children by a Python slice, negative ends counted from the last."""
    from sylva.operators.axes import children

    n = ctx.select(F.col("doc_id"), F.col("pre").alias("from_pre"), F.col("n_children").alias("_n"))
    rows = children(forest, ctx).join(n, ["doc_id", "from_pre"])
    at = lambda v, dft: F.lit(dft) if v is None else F.lit(v) if v >= 0 else F.col("_n") + v
    low, high = at(start, 0), F.col("_n") if stop is None else at(stop, 0)
    return rows.filter((F.col("ord") >= low) & (F.col("ord") < high) & ((F.col("ord") - low) % step == 0)).drop("_n")


def validate(forest: DataFrame) -> DataFrame:
    """(check, violations) over a node table; all zero for a sound one."""
    n = forest.filter("node_type > 0")
    up = n.select("doc_id", F.col("pre").alias("_p"), F.col("last").alias("_l"), F.col("depth").alias("_dp"), F.col("n_children").alias("_n"))
    joined = n.join(up, (n["doc_id"] == up["doc_id"]) & (n["parent"] == up["_p"]), "left").drop(up["doc_id"])
    simple = joined.agg(
        F.count_if(F.col("last") < F.col("pre")).alias("last_before_pre"),
        F.count_if(F.col("parent").isNotNull() & F.col("_p").isNull()).alias("orphan"),
        F.count_if((F.col("pre") <= F.col("_p")) | (F.col("last") > F.col("_l"))).alias("outside_parent"),
        F.count_if(F.col("depth") != F.col("_dp") + 1).alias("depth"),
        F.count_if(F.size("anc") != F.col("depth") - 1).alias("ancestors"),
        F.count_if((F.col("node_type") != 1) & (F.col("n_children") > 0)).alias("leaf_with_children"),
    )
    counts = n.filter("parent is not null").groupBy("doc_id", "parent").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("ord").alias("d"), F.max("ord").alias("m"))
    order = counts.agg(F.count_if((F.col("c") != F.col("d")) | (F.col("m") != F.col("c") - 1)).alias("sibling_order"))
    names = [*simple.columns, *order.columns]
    one = simple.crossJoin(order)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("check"), F.col(x).cast("long").alias("violations")) for x in names])).alias("r")).select("r.*")


def profile(forest: DataFrame, how: str = "cube") -> DataFrame:
    """Node counts by document and name, with all totals (cube), or the totals of a rollup."""
    n = forest.filter("node_type > 0")
    return (n.cube("node_type", "name") if how == "cube" else n.rollup("doc_id", "name")).agg(F.count(F.lit(1)).alias("n"))
