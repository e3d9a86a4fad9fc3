"""``NodeFrame``: a node table and a set of context nodes, with the operators as methods.

    pages = NodeFrame.read_html(df, "page_id", "html")
    pages.css("nav li > a").attribute("href")

Methods that reach nodes give a ``NodeFrame`` of distinct nodes (``.nodes`` is the
DataFrame, ``.bag`` the nodes with where they were reached from); methods that read
values give DataFrames with doc_id and pre.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators import attrs, axes, css, ids, mutate, pick, positions
from sylva.plans import serialize
from sylva.sources.options import ShredOptions
from sylva.sources.shred import shred


class NodeFrame:
    def __init__(self, forest: DataFrame, nodes: DataFrame | None = None, bag: DataFrame | None = None):
        self.forest = axes.nodes(forest)
        self.nodes = nodes if nodes is not None else self.forest.filter("pre = 0")
        self.bag = bag

    @classmethod
    def read(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: ShredOptions | None = None) -> NodeFrame:
        return cls(shred(docs, doc_id, text, options))

    @classmethod
    def read_html(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> NodeFrame:
        return cls.read(docs, doc_id, text, ShredOptions(mode="html"))

    def _at(self, bag: DataFrame) -> NodeFrame:
        return NodeFrame(self.forest, axes.distinct_nodes(bag), bag)

    # axes
    def parent(self) -> NodeFrame:
        return self._at(axes.parent(self.forest, self.nodes))

    def children(self, test: Column | None = None) -> NodeFrame:
        return self._at(axes.children(self.forest, self.nodes, test))

    def descendants(self, test: Column | None = None, include_self: bool = False) -> NodeFrame:
        return self._at(axes.descendants(self.forest, self.nodes, test, include_self))

    def ancestors(self, test: Column | None = None, include_self: bool = False) -> NodeFrame:
        return self._at(axes.ancestors(self.forest, self.nodes, test, include_self))

    def root(self) -> NodeFrame:
        return self._at(axes.root(self.forest, self.nodes))

    def next_sibling(self) -> NodeFrame:
        return self._at(axes.next_sibling(self.forest, self.nodes))

    def previous_sibling(self) -> NodeFrame:
        return self._at(axes.previous_sibling(self.forest, self.nodes))

    def next_element(self) -> NodeFrame:
        return self._at(axes.sibling(self.forest, axes.elements(self.nodes), 1, elements_only=True))

    def previous_element(self) -> NodeFrame:
        return self._at(axes.sibling(self.forest, axes.elements(self.nodes), -1, elements_only=True))

    def following_siblings(self, test: Column | None = None) -> NodeFrame:
        return self._at(axes.following_siblings(self.forest, self.nodes, test))

    def preceding_siblings(self, test: Column | None = None) -> NodeFrame:
        return self._at(axes.preceding_siblings(self.forest, self.nodes, test))

    def following(self, test: Column | None = None, xpath: bool = False) -> NodeFrame:
        return self._at(axes.following(self.forest, self.nodes, test, xpath))

    def preceding(self, test: Column | None = None, xpath: bool = False) -> NodeFrame:
        return self._at(axes.preceding(self.forest, self.nodes, test, xpath))

    def next(self) -> NodeFrame:
        return self._at(axes.neighbour(self.forest, self.nodes, 1))

    def previous(self) -> NodeFrame:
        return self._at(axes.neighbour(self.forest, self.nodes, -1))

    def leftmost(self) -> NodeFrame:
        return self._at(axes.leftmost(self.forest, self.nodes))

    def rightmost(self) -> NodeFrame:
        return self._at(axes.rightmost(self.forest, self.nodes))

    def first_child(self) -> NodeFrame:
        return self._at(axes.first_child(self.forest, self.nodes))

    def last_child(self) -> NodeFrame:
        return self._at(axes.last_child(self.forest, self.nodes))

    # selections
    def filter(self, test: Column | str) -> NodeFrame:
        return NodeFrame(self.forest, self.nodes.filter(test))

    def css(self, selector: str) -> NodeFrame:
        """Matches below the context nodes."""
        below = axes.descendants(self.forest, self.nodes, include_self=True).select("doc_id", "pre").distinct()
        found = css.select(self.forest, selector)
        return NodeFrame(self.forest, found.join(below, ["doc_id", "pre"], "left_semi"))

    def matches(self, selector: str) -> NodeFrame:
        return NodeFrame(self.forest, css.matches(self.forest, self.nodes, selector))

    def closest(self, selector: str) -> DataFrame:
        return css.closest(self.forest, self.nodes, selector)

    def by_tag(self, name: str, ns_uri: str | None = None) -> NodeFrame:
        return self._at(axes.by_tag(self.forest, self.nodes, name, ns_uri))

    def by_class(self, token: str, attr: str = "class") -> NodeFrame:
        return self._at(axes.by_class(self.forest, self.nodes, token, attr))

    def by_id(self, wanted: DataFrame, choices: list[ids.IdChoice] | None = None) -> NodeFrame:
        return NodeFrame(self.forest, ids.by_id(self.forest, ids.build_index(self.forest, choices), wanted).drop("id"))

    def find(self, name: str) -> NodeFrame:
        """The first child element of a name, of each context node."""
        hit = axes.children(self.forest, self.nodes, axes.name_is(name) | (F.col("local") == name))
        first = hit.groupBy("doc_id", "from_pre").agg(F.min("pre").alias("pre"))
        return self._at(hit.join(first, ["doc_id", "from_pre", "pre"], "left_semi"))

    def find_all(self, name: str) -> NodeFrame:
        return self.children(axes.name_is(name) | (F.col("local") == name))

    def __getitem__(self, what) -> NodeFrame | DataFrame:
        found = pick.pick(self.forest, self.nodes, what)
        return found if "value" in found.columns else self._at(found)

    def __add__(self, other: NodeFrame) -> DataFrame:
        """The nodes of both, as a bag."""
        return self.nodes.unionByName(other.nodes)

    def __mul__(self, n: int) -> DataFrame:
        return axes.repeat(self.nodes, n)

    # values
    def attribute(self, name: str, ns_uri: str | None = None, cast_as: str | None = None, default=None) -> DataFrame:
        return self.nodes.select("doc_id", "pre", attrs.attribute(name, ns_uri, cast_as, default).alias("value"))

    def inherited(self, name: str, default: str | None = None) -> DataFrame:
        return attrs.inherited(self.forest, self.nodes, name, default=default)

    def stacked(self, name: str, sep: str = "/") -> DataFrame:
        return attrs.stacked(self.forest, self.nodes, name, sep)

    def base_uri(self) -> DataFrame:
        return self.inherited("xml:base")

    def text_content(self) -> DataFrame:
        return positions.text_content(self.forest, self.nodes)

    def text(self) -> DataFrame:
        """The text before the first child element, as element-tree libraries have it; null without any."""
        first = axes.first_child(self.forest, self.nodes).filter("node_type = 3").select("doc_id", F.col("from_pre").alias("pre"), F.col("data").alias("value"))
        return self.nodes.select("doc_id", "pre").join(first, ["doc_id", "pre"], "left")

    def tail(self) -> DataFrame:
        """The text right after each node; null without any."""
        after = axes.next_sibling(self.forest, self.nodes).filter("node_type = 3").select("doc_id", F.col("from_pre").alias("pre"), F.col("data").alias("value"))
        return self.nodes.select("doc_id", "pre").join(after, ["doc_id", "pre"], "left")

    def xml(self, inner: bool = False, **options) -> DataFrame:
        return serialize.to_xml(self.forest, self.nodes, inner, **options)

    def canonical(self) -> DataFrame:
        return serialize.to_canonical(self.forest, self.nodes)

    def json(self) -> DataFrame:
        return serialize.to_json_text(self.forest, self.nodes)

    def events(self, attributes: str = "PAIRS") -> DataFrame:
        return serialize.events(self.forest, attributes)

    def paths(self) -> DataFrame:
        return self.nodes.select("doc_id", "pre", axes.node_path().alias("value"))

    def with_user_data(self, table: DataFrame, key: str) -> DataFrame:
        """Context nodes with ``value`` of a side table (doc_id, pre, key, value)."""
        side = table.filter(F.col("key") == key).select("doc_id", "pre", "value")
        return self.nodes.join(side, ["doc_id", "pre"], "left")

    # edits give a frame over the new table, at its roots
    def remove(self) -> NodeFrame:
        return NodeFrame(mutate.remove(self.forest, self.nodes))

    def insert(self, xml: str, where: str | int = "last") -> NodeFrame:
        return NodeFrame(mutate.insert(self.forest, self.nodes, xml, where))

    def replace(self, xml: str) -> NodeFrame:
        return NodeFrame(mutate.replace(self.forest, self.nodes, xml))

    def set_text(self, value: str) -> NodeFrame:
        return NodeFrame(mutate.set_content(self.forest, self.nodes, text=value))

    def set_inner(self, xml: str) -> NodeFrame:
        return NodeFrame(mutate.set_content(self.forest, self.nodes, xml=xml))

    # synonyms
    getparent, getchildren, getnext, getprevious, getroot = parent, children, next_sibling, previous_sibling, root
    parents, query_selector_all = ancestors, css
    next_siblings, previous_siblings, next_nodes, previous_nodes = following_siblings, preceding_siblings, following, preceding
    iter_text, tostring, append, remove_node = text_content, xml, insert, remove
