"""The method surface, constructors and external entities."""

import pytest
from pyspark.sql import functions as F

from sylva.frame import NodeFrame
from sylva.functions import text
from sylva.operators import build
from sylva.sources.options import ShredOptions, resolve_entities
from sylva.sources.shred import ShredError, Shredder

DOC = '<r xml:base="u"><a id="1">x<b/>y</a><a id="2"><c/></a>z</r>'


def got(frame):
    return sorted(r["pre"] for r in frame.nodes.collect())


@pytest.fixture(scope="module")
def frame(spark):
    return NodeFrame.read(spark.createDataFrame([(1, DOC)], "doc_id long, text string"))


def test_methods(frame):
    a = frame.children(F.col("name") == "a")
    assert got(a) == [1, 5] and got(a.parent()) == [0] and got(a.next_sibling()) == [5, 7] and got(a.next_element()) == [5] and got(a.previous_element()) == [1] and got(a.next()) == [2, 6]
    assert got(frame.css("a > b")) == [3] and got(a.css("c")) == [6] and got(frame.by_tag("a")) == [1, 5] and got(frame.find("a")) == [1] and got(frame.find_all("a")) == [1, 5]
    assert got(frame["a", 1]) == [5] and got(frame[-1]) == [7] and [r["value"] for r in a["@id"].collect()] == ["1", "2"]
    assert got(a.descendants()) == [2, 3, 4, 6] and got(a.leftmost()) == [2, 6] and got(a.rightmost()) == [4, 6] and got(frame.css("c").ancestors()) == [0, 5] and got(a.getparent()) == [0]
    value = lambda df: {r["pre"]: r["value"] for r in df.collect()}
    assert value(a.text()) == {1: "x", 5: None} and value(a.tail()) == {1: None, 5: "z"} and value(frame.css("b").tail()) == {3: "y"} and value(a.base_uri()) == {1: "u", 5: "u"}
    assert {r["text"] for r in a.text_content().collect()} == {"xy", ""} and {r["xml"] for r in a.xml(emptySpace=False).collect()} == {'<a id="1">x<b/>y</a>', '<a id="2"><c/></a>'}
    assert (a + a).count() == 4 and (a * 3).count() == 6 and [r["pre"] for r in frame.css("c").closest("a").collect()] == [5]


def test_edits_through_the_frame(frame):
    new = frame.css("c").insert(build.element("d", {"k": '<"&'}, build.text("t<"), build.comment("c")))
    assert [r["xml"] for r in new.css("c").xml().collect()] == ['<c><d k="&lt;&quot;&amp;">t&lt;<!--c--></d></c>']
    assert [r["text"] for r in frame.css("a").set_text("q").text_content().collect()] == ["qqz"]
    assert frame.css("a").remove().forest.count() == 2


def test_constructors():
    assert build.document(build.element("p:a", ns_uri="u"), "a") == '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE a><p:a xmlns:p="u"/>'
    assert build.cdata("<") + build.instruction("t", "d") + build.reference("x") == "<![CDATA[<]]><?t d?>&x;"
    for bad in (lambda: build.element("1a"), lambda: build.element("a", {"b c": ""}), lambda: build.comment("a--b"), lambda: build.cdata("]]>"), lambda: build.instruction("xml")):
        with pytest.raises(build.InvalidCharacterError):
            bad()


def test_external_entities(tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "e.xml").write_text("<i>in</i>")
    (tmp_path / "secret.xml").write_text("no")
    found = resolve_entities(["e.xml", "../secret.xml", "http://x/y"], [str(tmp_path / "ok")])
    assert found == {"e.xml": "<i>in</i>"}
    doc = '<!DOCTYPE a [<!ENTITY e SYSTEM "e.xml">]><a>&e;</a>'
    assert Shredder(ShredOptions(resolved=found)).shred(doc)["name"] == ["a", "i", "#text"]
    for options in (ShredOptions(), ShredOptions(resolved=found, extra={"extEntities": False})):
        with pytest.raises(ShredError):
            Shredder(options).shred(doc)


def test_script_escapes(spark):
    row = spark.range(1).select(text.escape_blocks(F.lit("aéжz"), [(0x400, 0x4FF)], names=False), text.escape_blocks(F.lit("aéж"), [], above=0x7F)).first()
    assert list(row) == ["aé&#X0436;z", "a&eacute;&#X0436;"]
