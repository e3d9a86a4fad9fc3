"""Axes as joins.

``forest`` is a node table; ``ctx`` holds context nodes (rows of it, perhaps filtered).
Each axis returns the nodes reached, with ``from_pre``: the context node they were
reached from, so a node reached from two contexts is there twice (bag semantics).
``test`` is a Column over node columns; it filters the nodes reached and never prunes.

No axis numbers or sorts a document: neighbours in document order differ by one in
``pre``, neighbours among siblings by one in ``ord``, and containment is an equi-join
through the exploded ancestor array (or, on request, a range join per document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEEP = ("doc_id", "pre", "last", "parent", "ord", "ord_e", "anc", "node_type", "depth")


def elements(forest: DataFrame) -> DataFrame:
    return forest.filter("node_type = 1")


def nodes(forest: DataFrame) -> DataFrame:
    """Without error rows."""
    return forest.filter("node_type > 0")


def errors(forest: DataFrame) -> DataFrame:
    return forest.filter("node_type < 0").select("doc_id", F.col("pre").alias("offset"), F.col("last").alias("line"), F.col("name").alias("kind"), F.col("data").alias("message"))


def _context(ctx: DataFrame, *more: str) -> DataFrame:
    return ctx.select(F.col("doc_id").alias("_d"), F.col("pre").alias("from_pre"), *[F.col(c).alias(f"_{c}") for c in more])


def _tested(found: DataFrame, forest: DataFrame, test: Column | None) -> DataFrame:
    out = found if test is None else found.filter(test)
    return out.select("from_pre", *forest.columns)


def parent(forest: DataFrame, ctx: DataFrame, test: Column | None = None) -> DataFrame:
    c = _context(ctx, "parent")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_parent"))), forest, test)


def children(forest: DataFrame, ctx: DataFrame, test: Column | None = None) -> DataFrame:
    c = _context(ctx)
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("from_pre"))), forest, test)


def first_child(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    return children(forest, ctx, F.col("ord") == 0)


def last_child(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    c = _context(ctx, "n_children")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("from_pre")) & (F.col("ord") == F.col("_n_children") - 1)), forest, None)


def descendants(forest: DataFrame, ctx: DataFrame, test: Column | None = None, include_self: bool = False, strategy: str = "ancestors") -> DataFrame:
    """``strategy``: ``ancestors`` explodes ancestor arrays to an equi-join, ``range`` compares interval labels within a document."""
    c = _context(ctx, "last")
    rows = forest if test is None else forest.filter(test)
    if strategy == "range":
        low = F.col("pre") >= F.col("from_pre") if include_self else F.col("pre") > F.col("from_pre")
        found = rows.join(c, (F.col("doc_id") == F.col("_d")) & low & (F.col("pre") <= F.col("_last")))
    else:
        up = F.concat("anc", F.array("pre")) if include_self else F.col("anc")
        found = rows.withColumn("_a", F.explode(up)).join(c, (F.col("doc_id") == F.col("_d")) & (F.col("_a") == F.col("from_pre")))
    return found.select("from_pre", *forest.columns)


def descendant_attributes(forest: DataFrame, ctx: DataFrame, test: Column | None = None, include_self: bool = False) -> DataFrame:
    """The attributes of the descendant elements, in document order by (pre, aord)."""
    found = descendants(forest, ctx, test, include_self).filter("node_type = 1")
    return found.select("from_pre", "doc_id", "pre", F.posexplode("attrs").alias("aord", "a")).select("from_pre", "doc_id", "pre", "aord", "a.*")


def ancestors(forest: DataFrame, ctx: DataFrame, test: Column | None = None, include_self: bool = False) -> DataFrame:
    up = F.concat("anc", F.array("pre")) if include_self else F.col("anc")
    c = ctx.select(F.col("doc_id").alias("_d"), F.col("pre").alias("from_pre"), F.explode(up).alias("_a"))
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_a"))), forest, test)


def root(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    c = _context(ctx)
    return _tested(forest.filter("pre = 0").join(c, F.col("doc_id") == F.col("_d")), forest, None)


def sibling(forest: DataFrame, ctx: DataFrame, step: int = 1, elements_only: bool = False) -> DataFrame:
    """The sibling ``step`` places on; among elements only if asked for (then the context nodes are elements)."""
    at = "ord_e" if elements_only else "ord"
    c = _context(ctx, "parent", at)
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_parent")) & (F.col(at) == F.col(f"_{at}") + step)), forest, None)


def next_sibling(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    return sibling(forest, ctx, 1)


def previous_sibling(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    return sibling(forest, ctx, -1)


def following_siblings(forest: DataFrame, ctx: DataFrame, test: Column | None = None) -> DataFrame:
    c = _context(ctx, "parent", "ord")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_parent")) & (F.col("ord") > F.col("_ord"))), forest, test)


def preceding_siblings(forest: DataFrame, ctx: DataFrame, test: Column | None = None) -> DataFrame:
    c = _context(ctx, "parent", "ord")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_parent")) & (F.col("ord") < F.col("_ord"))), forest, test)


def neighbour(forest: DataFrame, ctx: DataFrame, step: int = 1) -> DataFrame:
    """The node ``step`` places on in document order; the previous one may be the parent, the next one the first child."""
    c = _context(ctx)
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("from_pre") + step)), forest, None)


def following(forest: DataFrame, ctx: DataFrame, test: Column | None = None, xpath: bool = False) -> DataFrame:
    """All later nodes of the document; ``xpath`` leaves out descendants."""
    c = _context(ctx, "last")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") > (F.col("_last") if xpath else F.col("from_pre")))), forest, test)


def preceding(forest: DataFrame, ctx: DataFrame, test: Column | None = None, xpath: bool = False) -> DataFrame:
    """All earlier nodes of the document; ``xpath`` leaves out ancestors."""
    c = _context(ctx)
    found = forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") < F.col("from_pre")))
    return _tested(found.filter(F.col("last") < F.col("from_pre")) if xpath else found, forest, test)


def leftmost(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    """The deepest first descendant, the node itself when it has no children."""
    leaf = descendants(forest.filter("n_children = 0"), ctx, include_self=True).groupBy("doc_id", "from_pre").agg(F.min("pre").alias("_p"))
    c = leaf.select(F.col("doc_id").alias("_d"), "from_pre", "_p")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p"))), forest, None)


def rightmost(forest: DataFrame, ctx: DataFrame) -> DataFrame:
    """The deepest last descendant, the node itself when it has no children."""
    c = _context(ctx, "last")
    return _tested(forest.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_last"))), forest, None)


def contains(ancestor: DataFrame, node: DataFrame) -> DataFrame:
    """Pairs (doc_id, a_pre, d_pre) of a context node and a node below it."""
    a = ancestor.select("doc_id", F.col("pre").alias("a_pre"))
    d = node.select("doc_id", F.col("pre").alias("d_pre"), F.explode("anc").alias("a_pre"))
    return d.join(a, ["doc_id", "a_pre"]).select("doc_id", "a_pre", "d_pre")


def having(ctx: DataFrame, reached: DataFrame, positive: bool = True) -> DataFrame:
    """Context nodes from which some (or no) node was reached: a semi or anti join."""
    return ctx.join(reached.select("doc_id", F.col("from_pre").alias("pre")).distinct(), ["doc_id", "pre"], "left_semi" if positive else "left_anti")


def distinct_nodes(found: DataFrame) -> DataFrame:
    """A bag of nodes as a set."""
    return found.drop("from_pre").dropDuplicates(["doc_id", "pre"])


def repeat(found: DataFrame, n: int) -> DataFrame:
    """Every node of a bag ``n`` times."""
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_n") if n > 0 else found.limit(0)


def compare_position(a_doc: Column, a_pre: Column, b_doc: Column, b_pre: Column) -> Column:
    """-1, 0 or 1 within a document, null between documents."""
    return F.when(a_doc == b_doc, F.signum(a_pre - b_pre).cast("int"))


def name_filter(names: list[str], exclude: bool = False) -> Column:
    return ~F.col("name").isin(names) if exclude else F.col("name").isin(names)


def name_is(name: str, ns_uri: str | None = None) -> Column:
    """``*``, ``#text``, a name, or a local name in a namespace (``##any`` for every one)."""
    if name == "*":
        hit = F.col("node_type") == 1
    elif ns_uri is None:
        hit = (F.col("name") == name) if name.startswith("#") else (F.col("node_type") == 1) & (F.col("name") == name)
    else:
        hit = (F.col("node_type") == 1) & (F.col("local") == name)
    if ns_uri not in (None, "##any"):
        hit = hit & (F.col("ns_uri") == ns_uri)
    return hit


def by_tag(forest: DataFrame, ctx: DataFrame, name: str, ns_uri: str | None = None) -> DataFrame:
    """Self-or-descendant elements of a name."""
    return descendants(forest, ctx, name_is(name, ns_uri), include_self=True)


def by_class(forest: DataFrame, ctx: DataFrame, token: str, attr: str = "class") -> DataFrame:
    from sylva.functions.text import tokens
    from sylva.operators.attrs import attribute

    return descendants(forest, ctx, (F.col("node_type") == 1) & F.array_contains(tokens(attribute(attr)), token), include_self=True)


def by_path(forest: DataFrame, steps: list[int]) -> DataFrame:
    """The node at 1-based child numbers below the document element, one per document."""
    return forest.filter(F.col("path") == F.array(F.lit(1), *[F.lit(s) for s in steps]))


def node_path(typed: bool = False, attribute: str | None = None) -> Column:
    """The child-number path from the root step on, as text: ``1/2``; ``typed``: ``1(r)/2(p)``; with an attribute's name as the last step ``1/2/@n``."""
    steps = F.col("path").cast("array<string>")
    if typed:
        steps = F.zip_with(steps, F.slice(F.split("tag_path", "/"), 2, F.size("path")), lambda n, name: F.concat(n, F.lit("("), name, F.lit(")")))
    if attribute is not None:
        steps = F.concat(steps, F.array(F.lit(f"@{attribute}")))
    return F.array_join(steps, "/")


def paths_without_blanks(forest: DataFrame) -> DataFrame:
    """(doc_id, pre, path_text) with child numbers that leave out white-space-only texts (those have the number of what follows)."""
    before = Window.partitionBy("doc_id", "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = nodes(forest).select("doc_id", "pre", "anc", (F.count_if(~is_blank_text()).over(before) + 1).alias("_n"))
    up = own.select("doc_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("_a")).join(own.select("doc_id", F.col("pre").alias("_a"), "_n"), ["doc_id", "_a"])
    steps = F.transform(F.sort_array(F.collect_list(F.struct("_a", "_n"))), lambda x: x["_n"].cast("string"))
    return up.groupBy("doc_id", "pre").agg(F.array_join(steps, "/").alias("path_text"))


def is_type(kind: str) -> Column:
    codes = {"element": 1, "attribute": 2, "text": 3, "cdata": 4, "entref": 5, "pi": 7, "comment": 8, "document": 9, "doctype": 10, "fragment": 11, "notation": 12}
    if kind == "cdata":
        return (F.col("node_type") == 3) & F.col("in_cdata")
    if kind == "characterdata":
        return F.col("node_type").isin(3, 7, 8)
    return F.col("node_type") == codes[kind]


def is_blank_text() -> Column:
    return (F.col("node_type") == 3) & F.coalesce(F.trim("data", F.lit(" \t\n\r")) == "", F.lit(False))


def blank_in_element_content(forest: DataFrame) -> DataFrame:
    """White-space-only text under a parent that has child elements."""
    with_elements = elements(forest).select("doc_id", "parent").filter("parent is not null").distinct()
    return forest.filter(is_blank_text()).join(with_elements, ["doc_id", "parent"], "left_semi")


def is_first_child() -> Column:
    return (F.col("ord") == 0) & F.col("parent").isNotNull()


def last_children(forest: DataFrame) -> DataFrame:
    up = forest.select("doc_id", F.col("pre").alias("parent"), (F.col("n_children") - 1).alias("ord"))
    return forest.join(up, ["doc_id", "parent", "ord"], "left_semi")


def is_connected() -> Column:
    return F.col("parent").isNotNull() | (F.col("depth") == 1)
