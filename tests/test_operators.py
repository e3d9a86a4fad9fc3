"""Axes, attributes, ids, selectors, edits and serializers on small trees, against golden values and each other."""

import random
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F
from test_shred import SMALL

from sylva.operators import attrs, axes, css, ids, mutate, overlap, pick, positions
from sylva.plans import serialize
from sylva.sources import readers
from sylva.sources.dtd import Dtd
from sylva.sources.jsonx import shred_json
from sylva.sources.options import ShredOptions, canonical_options, format_options
from sylva.sources.shred import shred
from sylva.sources.xsd import XsdError, load_xsd


def forest_of(spark, *texts, **options):
    return shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), options=ShredOptions(**options))


def xml_of(forest):
    return [r["xml"] for r in serialize.to_xml(forest, emptySpace=False).orderBy("doc_id").collect()]


def pres(df):
    return sorted((r["from_pre"], r["pre"]) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    return forest_of(spark, SMALL).cache()


@pytest.fixture(scope="module")
def paras(spark):
    return forest_of(spark, "<article>" + "".join(f'<para class="important" n="{i}">aardvark</para>' for i in range(10)) + "</article>").cache()


@pytest.fixture(scope="module")
def random_forest(spark):
    rng = random.Random(1)

    def node(depth):
        kids = "".join(node(depth + 1) if rng.random() < 0.7 else rng.choice(["text", "<!--c-->", "<?p d?>", "a &amp; b"]) for _ in range(rng.randrange(4))) if depth < 5 else ""
        name = rng.choice("abc")
        return f'<{name} x="{rng.randrange(3)}" y="{rng.choice(["u v", "v", "w-1", ""])}">{kids}</{name}>'

    texts = [node(0) for _ in range(12)]
    return texts, forest_of(spark, *texts).cache()


def test_small_axes(small):
    at = lambda name: small.filter(F.col("name") == name)
    name = lambda df: [r["name"] for r in df.orderBy("pre").collect()]
    assert name(axes.first_child(small, at("html"))) == ["child0"] and name(axes.last_child(small, at("html"))) == ["child2"]
    assert name(axes.previous_sibling(small, at("child2"))) == ["child1"]
    assert name(axes.sibling(small, at("child0"), 2)) == ["child2"]
    assert name(axes.leftmost(small, at("html"))) == ["#text"] and name(axes.rightmost(small, at("html"))) == ["child2"]
    assert name(axes.leftmost(small, at("child2"))) == ["child2"]
    assert name(axes.neighbour(small, at("child2"), -1)) == ["grandchild"] and name(axes.neighbour(small, at("child0"), 1)) == ["#text"]
    assert name(axes.by_path(small, [1, 1])) == ["#text"]
    assert name(axes.parent(small, at("grandchild"))) == ["child1"] and name(axes.root(small, at("grandchild"))) == ["html"]
    assert axes.contains(at("html"), at("child1")).count() == 1 and axes.contains(at("child1"), at("html")).count() == 0


def test_ten_paras(paras):
    at = lambda n: paras.filter(attrs.attribute("n") == str(n))
    assert axes.descendants(paras, paras.filter("pre = 0")).count() == 20
    assert axes.preceding_siblings(paras, at(8)).count() == 8 and axes.following_siblings(paras, at(7)).count() == 2
    assert positions.slice_children(paras, paras.filter("pre = 0"), 3, 7).count() == 4 and positions.slice_children(paras, paras.filter("pre = 0"), 3, 8, 2).count() == 3
    assert at(5).select(serialize.start_tag().alias("t")).first()["t"] == '<para class="important" n="5">'
    a, b = at(5).first(), at(8).first()
    row = paras.limit(1).select(*[axes.compare_position(F.lit(0), F.lit(x["pre"]), F.lit(0), F.lit(y["pre"])) for x, y in ((a, b), (a, a), (b, a))]).first()
    assert list(row) == [-1, 0, 1]
    kinds = {r["kind"]: r["n"] for r in serialize.events(paras, "EVENTS").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"START": 11, "END": 11, "CHAR": 10, "ATTRIBUTE": 20}


def test_axes_agree(random_forest):
    _, f = random_forest
    e = axes.elements(f)
    key = ["doc_id", "from_pre", "pre"]
    down, by_range = axes.descendants(f, e).select(key), axes.descendants(f, e, strategy="range").select(key)
    assert down.exceptAll(by_range).count() == by_range.exceptAll(down).count() == 0
    up = axes.ancestors(f, axes.nodes(f)).select("doc_id", F.col("pre").alias("from_pre"), F.col("from_pre").alias("pre"))
    assert up.exceptAll(down).count() == down.exceptAll(up).count() == 0
    both = axes.following(f, f).count() + axes.preceding(f, f).count()
    n = [r["count"] for r in f.groupBy("doc_id").count().collect()]
    assert both == sum(x * (x - 1) for x in n)
    part = axes.following(f, f, xpath=True).count() + axes.preceding(f, f, xpath=True).count()
    assert both - part == 2 * axes.descendants(f, f).count()
    assert positions.validate(f).agg(F.sum("violations")).first()[0] == 0


def test_against_minidom(random_forest):
    texts, f = random_forest
    counts = {(r["doc_id"], r["name"]): r["n"] for r in axes.elements(f).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n")).collect()}
    content = {r["doc_id"]: r["text"] for r in positions.text_content(f, f.filter("pre = 0")).collect()}

    def text(n):
        return n.data if n.nodeType == n.TEXT_NODE else "".join(text(c) for c in n.childNodes) if n.nodeType == n.ELEMENT_NODE else ""

    for i, t in enumerate(texts):
        dom = xml.dom.minidom.parseString(t)
        assert content[i] == text(dom.documentElement)
        for name in "abc":
            assert counts.get((i, name), 0) == len(dom.getElementsByTagName(name))


def test_round_trips(random_forest):
    texts, f = random_forest
    again = shred(serialize.to_xml(f), text="xml")
    assert f.exceptAll(again).count() == 0
    from_json = shred_json(serialize.to_json_text(f), text="json")
    cols = [c for c in f.columns if c not in ("name", "tag_path")]
    assert f.select(cols).exceptAll(from_json.select(cols)).count() == 0
    assert mutate.renumber(mutate.keyed(f)).exceptAll(f).count() == 0


def test_json_shapes(spark):
    d = spark.createDataFrame([(1, '[{"~":"a","x":1,"y":true},"t",[{"~":"#cdata"},"c"],[{"~":"#comment"},"k"],[{"~":"b"}],2.5]'), (2, "[]"), (3, '[{"~":"#document"},[{"~":"r"}]]'), (4, "{"), (5, None)], "doc_id long, text string")
    f = shred_json(d)
    assert sorted(r["doc_id"] for r in axes.errors(f).collect()) == [2, 4]
    one = f.filter("doc_id = 1").orderBy("pre").collect()
    assert [r["name"] for r in one] == ["a", "#text", "#text", "#comment", "b", "#text"] and [r["data"] for r in one][-1] == "2.5"
    assert [(a["name"], a["value"]) for a in one[0]["attrs"]] == [("x", "1"), ("y", "true")]
    assert xml_of(f.filter("doc_id = 3")) == ["<r/>"]


def test_errors_are_rows(spark):
    f = forest_of(spark, "<a/>", "<a>\n<b></a>", None)
    assert [(r["doc_id"], r["line"], r["kind"]) for r in axes.errors(f).collect()] == [(1, 2, "syntax")]
    with pytest.raises(Exception):
        forest_of(spark, "<a>", on_error="failfast").collect()


def test_attributes(spark, small):
    c = small.filter("name = 'child0'")
    row = c.select(
        attrs.attribute("id"), attrs.attribute("nope", default="d"), attrs.has_attribute("class"), attrs.has_attributes(), attrs.attribute_at(0)["name"], attrs.attribute_at(-1)["name"], attrs.index_of("class"), attrs.index_of("q"), attrs.attribute_map()["id"]
    ).first()
    assert list(row) == ["html_id_17", "d", True, True, "an_attribute.name", "id", 1, -1, "html_id_17"]
    stack = "<html><child2>" + "".join(f'<deeper id="idval_{k}">' for k in range(5)) + "</deeper>" * 5 + "</child2></html>"
    f = forest_of(spark, stack, '<a xml:id="q"><b n="7" m="x"/></a>')
    deepest = f.filter("doc_id = 0 and last = pre")
    assert attrs.stacked(f, deepest, "id").first()["value"] == "/idval_0/idval_1/idval_2/idval_3/idval_4"
    assert attrs.inherited(f, deepest, "id").first()["value"] == "idval_4"
    assert attrs.inherited(f, deepest, "none", default="dft").first()["value"] == "dft"
    assert f.filter("name = 'a'").select(attrs.attribute("id")).first()[0] == "q"
    assert list(f.filter("name = 'b'").select(attrs.attribute("n", cast_as="int"), attrs.attribute("m", cast_as="int", default=0)).first()) == [7, 0]
    edited = attrs.set_attribute(attrs.set_attribute(f, F.col("name") == "b", "n", "8"), F.col("name") == "b", "z", "9")
    assert xml_of(attrs.remove_attribute(edited, F.col("name") == "b", "m"))[1] == '<a xml:id="q"><b n="8" z="9"/></a>'
    ns = forest_of(spark, '<a xmlns="d" xmlns:p="u" xmlns:q="u"><b xmlns:p="v"/></a>')
    b = ns.filter("name = 'b'")
    assert attrs.lookup_namespace(ns, b, "p").first()["uri"] == "v" and attrs.lookup_namespace(ns, b).first()["uri"] == "d"
    assert attrs.lookup_prefix(ns, b, "u").first()["prefix"] == "q"
    assert axes.by_tag(ns, ns.filter("pre = 0"), "b", "d").count() == 1


def test_ids(spark):
    body = "<html><idDiv>" + "".join(f'<p {"xml:id" if k < 5 else "id"}="idVal_{k}">hello.</p>' for k in range(10)) + '</idDiv><q id="dup"/><q id=" dup "/></html>'
    f = forest_of(spark, body)
    index = ids.build_index(f)
    assert index.count() == 11 and index.filter("id = 'dup'").first()["uses"] == 2
    found = ids.by_id(f, index, spark.createDataFrame([(0, "idVal_3"), (0, "dup"), (0, "none")], "doc_id long, id string"))
    assert {(r["id"], r["name"]) for r in found.collect()} == {("idVal_3", "p"), ("dup", "q")}
    assert found.filter("id = 'dup'").first()["pre"] == f.agg(F.max("pre")).first()[0]
    paths = {r["pre"]: r["path_text"] for r in ids.id_paths(f, index).collect()}
    assert paths[0] == "1" and paths[3] == "idVal_0/1" and paths[1] == "1/1"
    g = forest_of(spark, '<r><x id="a"/><y idref="a b"/></r>')
    assert [(r["from_pre"], r["to_pre"]) for r in ids.idref_edges(g, ids.build_index(g)).collect()] == [(2, 1)]


CSS = '<html lang="en"><body><p class="a b" id="one">x<i/></p><p class="b" title="foo-bar">y</p><div><p title="foo"/><q/><p/><!--c--></div><ul lang="fr-CA"><li/><li><b/></li><li/></ul></body></html>'


@pytest.mark.parametrize("selector,want", [
    ("p", [2, 5, 8, 10]), ("*", [0, 1, 2, 4, 5, 7, 8, 9, 10, 12, 13, 14, 15, 16]), ("#one", [2]), (".b", [2, 5]), ("p.a.b#one", [2]), ("[title]", [5, 8]), ("[title=foo]", [8]), ("[title|=foo]", [5, 8]), ("[title^=foo]", [5, 8]), ("[title$=bar]", [5]),
    ("[title*='o-b']", [5]), ("[class~=a]", [2]), ("[title='FOO' i]", [8]), ("body > p", [2, 5]), ("div p", [8, 10]), ("p + p", [5]), ("p ~ div", [7]), ("p + q", [9]), ("p:first-child", [2, 8]), ("li:last-child", [16]), ("li:nth-child(2)", [14]), ("li:nth-child(odd)", [13, 16]),
    ("li:nth-last-child(1)", [16]), ("p:only-of-type", []), ("q:only-of-type", [9]), ("i:only-child", [4]), ("p:nth-of-type(2)", [5, 10]), ("p:last-of-type", [5, 10]), ("p:nth-last-of-type(2)", [2, 8]), (":root", [0]), ("div > :empty", [8, 9, 10]),
    ("li:lang(fr)", [13, 14, 16]), ("p:lang(en)", [2, 5, 8, 10]), ("p:not(.b)", [8, 10]), (":is(q, b)", [9, 15]), ("li:has(b)", [14]), ("p:has(+ p)", [2]), ("body:has(> div)", [1]), ("div:has(q ~ p)", [7]), ("p, q", [2, 5, 8, 9, 10]), ("html > body > p > i", [4]), ("body p:not(div p)", [2, 5]),
])
def test_selectors(spark, selector, want):
    f = forest_of(spark, CSS)
    assert sorted(r["pre"] for r in css.select(f, selector).collect()) == want


@pytest.mark.parametrize("bad", ["", "p >", "> p", "[a", "p:nope", "p:not(", "p..a", "li:nth-child(x)"])
def test_bad_selectors(bad):
    with pytest.raises(css.SelectorError):
        css.parse(bad)


def test_selector_entry_points(spark):
    f = forest_of(spark, CSS)
    assert css.select_first(f, "p").first()["pre"] == 2
    assert css.matches(f, f.filter("name = 'p'"), ".b").count() == 2
    assert [(r["from_pre"], r["pre"]) for r in css.closest(f, f.filter("name = 'b'"), "ul, body").collect()] == [(15, 12)]


def test_pick(spark):
    f = forest_of(spark, CSS)
    body = f.filter("name = 'body'")
    got = lambda what, ctx=body: sorted(r["pre"] for r in pick.pick(f, ctx, what).collect())
    assert got(0) == [2] and got(-1) == [12] and got(slice(1, 3)) == [5, 7] and got("p") == [2, 5] and got(("p", 1)) == [5] and got(("p", -1)) == [5] and got("*") == [2, 5, 7, 12]
    assert got("/") == [0] and got("..") == [0] and got("#comment", f.filter("name = 'div'")) == [11] and got("#text", f.filter("pre = 2")) == [3] and len(got("**")) == 12
    assert [r["value"] for r in pick.pick(f, f.filter("pre = 2"), "@class").collect()] == ["a b"]
    pick.register_scheme("css", lambda forest, ctx, data: axes.descendants(forest, ctx).join(css.select(forest, data).select("doc_id", "pre"), ["doc_id", "pre"], "left_semi"))
    assert got("css:li") == [13, 14, 16]
    with pytest.raises(KeyError):
        pick.pick(f, body, "#nope")


def test_positions(spark):
    f = forest_of(spark, "<r>" + "".join("<thing/>text" for _ in range(10)) + "</r>")
    mid = f.filter("ord = 10 and parent = 0")
    assert axes.preceding_siblings(f, mid).count() == 10 and axes.following_siblings(f, mid).count() == 9
    at = lambda **o: {r["pre"]: r["child_index"] for r in positions.child_index(f, **o).filter("parent = 0").collect()}
    assert at()[11] == 10 and at(only_elements=True)[11] == 5 and at(reverse=True)[20] == -1 and at(of_name="thing", reverse=True)[19] == -1
    g = forest_of(spark, "<r>a<![CDATA[b]]>c<x/>d</r>")
    assert [r["child_index"] for r in positions.child_index(g, coalesce_text=True).filter("name = 'x'").collect()] == [1]
    assert {r["n_texts"] for r in positions.child_counts(g).collect()} == {4}
    assert [(r["start"], r["end"]) for r in positions.text_offsets(g).orderBy("pre").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert axes.last_children(g).count() == 1 and g.filter(axes.is_first_child()).count() == 1
    h = forest_of(spark, "<r> <x/> </r>", "<r> </r>")
    assert axes.blank_in_element_content(h).count() == 2 and h.filter(axes.is_blank_text()).count() == 3


def test_edits(spark):
    f = forest_of(spark, '<a><b n="2">x</b><c/><b n="1">y<i/>z</b></a>').cache()
    at = lambda n: f.filter(F.col("name") == n)
    assert xml_of(mutate.remove(f, at("c"))) == ['<a><b n="2">x</b><b n="1">y<i/>z</b></a>']
    for where, want in (("before", '<b n="2">x</b><n/>t<c/>'), ("after", '<b n="2">x</b><c/><n/>t'), ("first", '<c><n/>t</c>'), ("last", '<c><n/>t</c>')):
        done = mutate.insert(f, at("c"), "<n/>t", where)
        assert want in xml_of(done)[0] and positions.validate(done).agg(F.sum("violations")).first()[0] == 0
    assert xml_of(mutate.insert(f, at("a"), "<n/>", 1))[0].startswith('<a><b n="2">x</b><n/><c/>')
    assert xml_of(mutate.insert(f, at("a"), "<n/>", -1))[0].startswith('<a><b n="2">x</b><c/><n/>')
    assert xml_of(mutate.replace(f, at("c"), "<n>q</n>r")) == ['<a><b n="2">x</b><n>q</n>r<b n="1">y<i/>z</b></a>']
    assert xml_of(mutate.set_content(f, at("b"), text="<&")) == ['<a><b n="2">&lt;&amp;</b><c/><b n="1">&lt;&amp;</b></a>']
    assert xml_of(mutate.set_content(f, at("b"), xml="<k/>")) == ['<a><b n="2"><k/></b><c/><b n="1"><k/></b></a>']
    assert xml_of(mutate.sort_children(f, at("a"), attrs.attribute("n"))) == ['<a><c/><b n="1">y<i/>z</b><b n="2">x</b></a>']
    renamed = mutate.rename(f, F.col("name") == "b", "bb")
    assert xml_of(renamed) == ['<a><bb n="2">x</bb><c/><bb n="1">y<i/>z</bb></a>'] and renamed.filter("tag_path = '/a/bb/i'").count() == 1
    assert xml_of(mutate.clone(f, at("b"), F.col("pre") + 100)) == ['<b n="2">x</b>', '<b n="1">y<i/>z</b>']
    assert xml_of(mutate.split_text(f, f.filter("data = 'x'"), 0, "<s/>"))[0].startswith('<a><b n="2"><s/>x</b>')
    merged = mutate.normalize(mutate.remove(f, at("i")))
    assert merged.filter("node_type = 3").count() == 2 and "yz" in xml_of(merged)[0]
    secs = {r["pre"]: r["section"] for r in mutate.containerize(forest_of(spark, "<d><p/><h1/><p/><h2/><p/></d>")).collect()}
    assert secs == {0: None, 1: None, 2: 2, 3: 2, 4: 4, 5: 4}


def test_moves_sections_and_scopes(spark):
    f = forest_of(spark, "<a><b><i/></b><c/></a>", "<z/>").cache()
    moves = spark.createDataFrame([(0, 1, 1, 0)], "doc_id long, pre int, to_doc long, to_pre int")
    assert sorted(xml_of(mutate.move(f, moves))) == ["<a><c/></a>", "<z><b><i/></b></z>"]
    both = spark.createDataFrame([(0, 1, 1, 0), (0, 2, 0, 3)], "doc_id long, pre int, to_doc long, to_pre int")
    assert sorted(xml_of(mutate.move(f, both))) == ["<a><c><i/></c></a>", "<z><b/></z>"]
    with pytest.raises(Exception, match="moved subtree"):
        mutate.move(f, spark.createDataFrame([(0, 1, 0, 2)], "doc_id long, pre int, to_doc long, to_pre int")).collect()
    g = forest_of(spark, "<d><p/><h1/>t<h2/><q/><h3/><h2/><div><h1/><p/></div><h1/></d>")
    assert xml_of(mutate.sections(g)) == ["<d><p/><section><h1/>t<section><h2/><q/><section><h3/></section></section><section><h2/><div><section><h1/><p/></section></div></section></section><section><h1/></section></d>"]
    h = forest_of(spark, "<r xmlns:p='u'><c xmlns:p='v'/></r>").cache()
    uris = lambda done: {r["ns_uri"] for r in done.filter("name = 'p:x'").collect()}
    assert uris(mutate.insert(h, h.filter("name = 'c'"), "<p:x p:k='1'/>", "last")) == {"v"} and uris(mutate.replace(h, h.filter("name = 'c'"), "<p:x/>")) == {"u"}
    with pytest.raises(Exception, match="undeclared prefix"):
        mutate.insert(h, h.filter("name = 'c'"), "<w:x/>").collect()
    with pytest.raises(Exception, match="beyond the text"):
        mutate.split_text(g, g.filter("data = 't'"), 5, "<s/>").collect()
    renamed = attrs.rename_attribute(forest_of(spark, "<r a='1' b='2' c='3'/>"), F.lit(True), "a", "b").first()["attrs"]
    assert [(x["name"], x["value"]) for x in renamed] == [("b", "1"), ("c", "3")]
    k = forest_of(spark, "<r> <x/> <y> <z/></y></r>")
    assert {r["path_text"] for r in axes.paths_without_blanks(k).join(k.filter("node_type = 1"), ["doc_id", "pre"]).collect()} == {"1", "1/1", "1/2", "1/2/1"}


def test_equality_and_canonical_form(spark):
    f = forest_of(spark, '<r><a x="1" y="2">t</a><a y="2" x="1">t</a><a y="2">t</a></r>')
    assert len({r["hash"] for r in serialize.tree_hash(f, f.filter("name = 'a'")).collect()}) == 2
    assert serialize.to_canonical(forest_of(spark, '<r b=" 1  2 " a="3"><!--c--><![CDATA[<x>]]><e/></r>')).first()["xml"] == '<r a="3" b="1 2">&lt;x><e></e></r>'
    with pytest.raises(KeyError):
        format_options(nope=1)
    with pytest.raises(TypeError):
        format_options(indent=1)
    assert canonical_options()["sortAttributes"]


def test_serializer_options(spark):
    f = forest_of(spark, "<r a='1'><b/>é&amp;x<i>q</i></r>")
    xml = lambda **o: serialize.to_xml(f, **o).first()["xml"]
    assert xml(emptySpace=False) == '<r a="1"><b/>é&amp;x<i>q</i></r>' and xml() == '<r a="1"><b />é&amp;x<i>q</i></r>' and xml(useEmpty=False) == '<r a="1"><b></b>é&amp;x<i>q</i></r>'
    assert xml(quoteChar="'", emptySpace=False).startswith("<r a='1'>") and "&eacute;" in xml(ASCII=True) and "&#X00E9;" in xml(ASCII=True, htmlChars=False)
    assert xml(pretty=True, tagInfos={"i": "inline"}) == '<r a="1">\n  <b />é&amp;x<i>q</i></r>'
    inner = serialize.to_xml(f, f.filter("pre = 0"), inner=True, emptySpace=False).first()["xml"]
    assert inner == "<b/>é&amp;x<i>q</i>" and serialize.to_xml(f, f.filter("name = 'b'"), inner=True).first()["xml"] == ""


def test_overlap(spark):
    d = spark.createDataFrame([(1, "<t><s>one <q>two</s> three</q> <p>a<-p>b<+p>c</p></t>"), (2, "<a></b>"), (3, "<a><-a><-a></a>")], "doc_id long, text string")
    s = overlap.spans(d)
    assert sorted((r["name"], r["part"], r["start"], r["end"]) for r in s.filter("doc_id = 1").collect()) == [("p", 0, 14, 15), ("p", 1, 16, 17), ("q", 0, 4, 13), ("s", 0, 0, 7), ("t", 0, 0, 17)]
    assert s.filter("error is not null").count() == 2
    for grain in (4096, 3):
        assert [tuple(r) for r in overlap.overlapping(s.filter("name = 's'"), s.filter("name = 'q'"), True, grain).collect()] == [(1, 1, 2, 4, 7)]
    assert overlap.overlapping(s.filter("name = 't'"), s.filter("name = 'q'"), True).count() == 0


def test_schema_checks(spark):
    dtd = Dtd("r")
    dtd.define_element("r", "(a, b*)")
    dtd.define_element("a", "EMPTY")
    dtd.define_attribute("a", "k", "int", "", "7")
    dtd.define_attribute("*", "id", "ID")
    t = readers.schema_tables(spark, dtd)
    f = forest_of(spark, "<r><a/><b/></r>", "<r><b q='1'/></r>", "<r><a k='x' id='9'>t</a></r>")
    assert sorted((r["doc_id"], r["name"]) for r in readers.check_models(f, t["dtd_elements"]).collect()) == [(1, "r"), (2, "a")]
    assert sorted((r["doc_id"], r["kind"], r["name"]) for r in readers.undeclared(f, t["dtd_elements"], t["dtd_attrs"]).collect()) == [(0, "element", "b"), (1, "attribute", "q"), (1, "element", "b")]
    assert [(a["name"], a["value"], a["specified"]) for r in attrs.apply_defaults(f, t["dtd_attrs"]).filter("doc_id = 0 and name = 'a'").collect() for a in r["attrs"]] == [("k", "7", False)]
    from sylva.functions.types import typed_attributes

    assert {(r["name"], r["type_name"], r["violated_facet"]) for r in typed_attributes(attrs.exploded(f), t["dtd_attrs"]).collect()} == {("k", "int", "pybase"), ("id", "ID", "pattern"), ("q", "CDATA", None)}
    rows = readers.declarations(spark.createDataFrame([(1, dtd.to_text() + "<r/>"), (2, "<!DOCTYPE x [<!NOPE>]><x/>"), (3, "<x/>")], "doc_id long, text string"), options=ShredOptions(extra={"xsdType": True, "globalAttribute": True}))
    assert sorted((r["doc_id"], r["kind"]) for r in rows.collect()) == [(1, "attribute"), (1, "attribute"), (1, "element"), (1, "element"), (2, "error")]


def test_xsd():
    x = load_xsd("""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="size1"><xs:restriction base="xs:int"><xs:maxInclusive value="10"/></xs:restriction></xs:simpleType>
<xs:complexType name="T"><xs:sequence><xs:element name="b" type="xs:string" maxOccurs="unbounded"/><xs:choice minOccurs="0"><xs:element name="c"/><xs:element name="d"/></xs:choice></xs:sequence><xs:attribute name="n" type="size1" use="required"/></xs:complexType>
<xs:complexType name="U"><xs:complexContent><xs:extension base="T"><xs:sequence><xs:element name="z"/></xs:sequence><xs:attribute name="m" default="q"/></xs:extension></xs:complexContent></xs:complexType>
<xs:element name="a" type="T"/><xs:element name="u" type="U"/></xs:schema>""")
    assert {e["name"]: e["model"] for e in x.dtd.elements} == {"a": "(b+, (c | d)?)", "u": "((b+, (c | d)?), (z))"}
    assert [(a["elem"], a["attr"], a["default_kind"], a["value"]) for a in x.dtd.attrs] == [("a", "n", "#REQUIRED", None), ("u", "n", "#REQUIRED", None), ("u", "m", "#IMPLIED", "q")]
    with pytest.raises(XsdError):
        load_xsd("<a/>")


def test_readers(spark, tmp_path):
    for name, data in {"a.xml": "﻿<a>é</a>".encode("utf-8"), "b.xml": "<b>é</b>".encode("utf-16"), "c.xml": '<?xml version="1.0" encoding="ISO-8859-1"?><c>é</c>'.encode("latin-1")}.items():
        (tmp_path / name).write_bytes(data)
    f = readers.read_xml(spark, str(tmp_path / "*.xml"))
    assert sorted((r["name"], r["data"]) for r in f.filter("node_type = 3").collect()) == [("#text", "é")] * 3 and f.filter("node_type < 0").count() == 0
    readers.save_forest(f, str(tmp_path / "forest"))
    assert readers.load_forest(spark, str(tmp_path / "forest")).exceptAll(f).count() == 0
    (tmp_path / "names.txt").write_text("bull\t8226\nbull\t1\nx\t0x41\n")
    assert {tuple(r) for r in readers.names_from_pairs(spark, str(tmp_path / "names.txt")).collect()} == {("bull", 8226), ("x", 65)}
    (tmp_path / "names.ent").write_text('<!ENTITY a "&#65;"><!ENTITY b "&#x42;">')
    assert {tuple(r) for r in readers.names_from_declarations(spark, str(tmp_path / "names.ent")).collect()} == {("a", 65), ("b", 66)}
    (tmp_path / "x.taginfo").write_text("# c\np, block\ni, inline\n")
    assert {tuple(r) for r in readers.read_taginfo(spark, str(tmp_path / "x.taginfo")).collect()} == {("p", "block"), ("i", "inline")}
    props = readers.document_properties(spark.createDataFrame([(1, '<?xml version="1.0" encoding="utf-8" standalone="yes"?><!DOCTYPE a PUBLIC "p" "s" []><a/>')], "doc_id long, text string")).first()
    assert tuple(props) == (1, "1.0", "utf-8", "yes", "a", "p", "s")
