"""The shredder: golden trees, well-formedness, extension options, html repair."""

import pytest

from sylva.sources.dtd import DtdError, model_names, model_regex, parse_doctype
from sylva.sources.options import ShredOptions
from sylva.sources.shred import ShredError, Shredder

SMALL = '<html><child0 an_attribute.name="this is an attribute value" class="class1 class2" id="html_id_17">Some text content.</child0><child1><grandchild/></child1><child2/></html>'


def tree(text, **options):
    return Shredder(ShredOptions(**options)).shred(text)


def test_small_document():
    c = tree(SMALL)
    assert c["last"] == [5, 2, 2, 4, 4, 5]
    assert c["parent"] == [None, 0, 1, 0, 3, 0]
    assert c["depth"] == [1, 2, 3, 2, 3, 2]
    assert c["ord"] == [0, 0, 0, 1, 0, 2]
    assert c["node_type"] == [1, 1, 3, 1, 1, 1]
    assert c["name"] == ["html", "child0", "#text", "child1", "grandchild", "child2"]
    assert c["path"][2] == (1, 1, 1) and c["anc"][4] == (0, 3) and c["tag_path"][4] == "/html/child1/grandchild"


@pytest.mark.parametrize("fan,depth", [(5, 2), (3, 3)])
def test_full_tree(fan, depth):
    def node(k):
        return f"<para{k}>" + ("x" if k > depth else "".join(node(k + 1) for _ in range(fan))) + f"</para{k}>"

    c = tree("<r>" + "".join(node(1) for _ in range(fan)) + "</r>")
    elements = sum(fan**k for k in range(depth + 2))
    assert c["node_type"].count(1) == elements and c["node_type"].count(3) == fan ** (depth + 1)


BAD = [
    '<?xml version="1.0" encoding="utf-8" id="x"?><a/>', '<?xml version="1.0"? ><a/>', '<?XML version="1.0"?><a/>', '<?xml version="x"?><a/>', "<a/><b/>", "", "text", "<a>x</b>", "<a><b></a></b>", "<-p/>", "<foo:>x</foo:>", "<p:q/>",
    '<p a="1" a="2"/>', "<p b></p>", "<p b=c></p>", '<p "c"></p>', '<p ="c"></p>', '<p a="1"b="2"/>', "<p>&nope;</p>", "<p>&#bull;</p>", "<p>&#0;</p>", "<p>&#x1;</p>", "<p>&#-1;</p>", "<p> < </p>", "<p> & </p>", '<p a="<"/>',
    "<p><![CDATA[ x </p>", "<p>]]></p>", "<p><![X[ y ]]></p>", "<p><?xml x?></p>", "<p><? x ?></p>", "<p><!-- a -- b --></p>", "<p><!-- a ---></p>", "<q:p/>", '<p xmlns:q=""/>', '<p xmlns:xml="u"/>', '<!DOCTYPE r [<!NOPE a "b">]><r/>',
    '<!DOCTYPE r SYSTEM "a" PUBLIC "b"><r/>', "<!DOCTYPE r [<!ELEMENT>]><r/>", "<r/><!DOCTYPE r>", '<!DOCTYPE r [<!ENTITY a "&b;"><!ENTITY b "&a;">]><r>&a;</r>', "<a>\x01</a>", "<a/>junk", "<a",
]


@pytest.mark.parametrize("text", BAD)
def test_not_well_formed(text):
    with pytest.raises(ShredError):
        tree(text)


OPTIONS = [
    ("<doc><p>Ok.</></doc>", "emptyEnd"), ("<doc><p>Ok.<|>right<|>ok.</p></doc>", "restart"), ("<doc><p>Ok.<-p>no<+p>yes</p></doc>", "suspend"), ("<doc><p>a <i>b </p> c</i></doc>", "olist"), ("<doc><p|q>x</p|q></doc>", "simultaneous"),
    ("<doc><p id=foo>x</p></doc>", "unQuotedAttribute"), ("<doc><p id=“foo”>x</p></doc>", "curlyQuote"), ("<doc><p +a id='1' -b>x</p></doc>", "booleanAttribute"), ('<doc><p id!="foo">x</p></doc>', "bangAttribute"), ("<doc>&bull;</doc>", "htmlNames"),
    ("<doc>&LEFT_POINTING_DOUBLE_ANGLE_QUOTATION_MARK;</doc>", "unicodeNames"), ("<doc><!—c—></doc>", "emComment"), ("<doc><p>x", "omitAtEOF"), ("<doc><p>x</doc>", "omitEnd"), ("<doc><![IGNORE[x]]></doc>", "MSType"),
    ("<!DOCTYPE X [<!ATTLIST * id ID #IMPLIED>]><X/>", "globalAttribute"), ("<!DOCTYPE X [<!ATTLIST f #ANY CDATA #IMPLIED>]><X/>", "anyAttribute"), ("<!DOCTYPE X [<!ATTLIST f x float #IMPLIED>]><X/>", "xsdType"),
    ("<!DOCTYPE X [<!ELEMENT (x|y) ANY>]><X/>", "groupDcl"), ("<!DOCTYPE X [<!ELEMENT p - O ANY>]><X/>", "oflag"), ("<!DOCTYPE X [<!ELEMENT p RCDATA>]><X/>", "sgmlWord"), ("<!DOCTYPE X [<!ELEMENT x ANY -(p|q) +(i)>]><X/>", "mixin"),
    ("<!DOCTYPE X [<!ELEMENT p (x|y{3,9}){1,}>]><X/>", "repBrace"), ("<!DOCTYPE X [<!ELEMENT p -- c -- ANY>]><X/>", "fragComment"), ('<!DOCTYPE X SYSTEM "a" "b"><X/>', "multiPath"),
]


@pytest.mark.parametrize("text,option", OPTIONS, ids=[o for _, o in OPTIONS])
def test_option_allows(text, option):
    with pytest.raises(ShredError):
        tree(text)
    assert tree(text, extra={option: True})["name"]


def test_what_options_mean():
    assert tree("<d><P>x</p></d>", extra={"elementFold": "LOWER"})["name"] == ["d", "p", "#text"]
    assert [a[4] for a in tree("<d +x/>", extra={"booleanAttribute": True, "booleanIsName": True})["attrs"][0]] == ["x"]
    assert [a[4] for a in tree("<d +x -y/>", extra={"booleanAttribute": True})["attrs"][0]] == ["1", "0"]
    c = tree('<d><p a!="v"/><p/></d>', extra={"bangAttribute": True})
    assert c["attrs"][2] == [("a", None, "a", None, "v", False)]
    assert tree(r"<d>\x41•\n</d>", extra={"backslash": True})["data"][1] == "A•\n"
    with pytest.raises(KeyError):
        ShredOptions(extra={"nope": True})
    with pytest.raises(NotImplementedError):
        ShredOptions(extra={"STACKID": True})


def test_entities_defaults_namespaces():
    c = tree('<!DOCTYPE a [<!ENTITY b "<i>x&c;</i>"><!ENTITY c "cc"><!ATTLIST a q CDATA "dd">]><a r="&c;">1&b;2&#65;</a>')
    assert c["name"] == ["a", "#text", "i", "#text", "#text"] and c["data"] == [None, "1", None, "xcc", "2A"]
    assert [(a[0], a[4], a[5]) for a in c["attrs"][0]] == [("r", "cc", True), ("q", "dd", False)]
    c = tree('<a xmlns="d" xmlns:p="u"><p:b p:x="1" y="2"/><c xmlns=""/></a>')
    assert c["ns_uri"] == ["d", "u", None] and [a[3] for a in c["attrs"][1]] == ["u", None]
    deep = "".join(f'<!ENTITY e{k} "&e{k + 1};&e{k + 1};">' for k in range(30))
    with pytest.raises(ShredError):
        tree(f'<!DOCTYPE a [{deep}<!ENTITY e30 "x">]><a>&e0;</a>')


def test_html_repair():
    c = tree("<P>one<p>two<b>bold<br>x<ul><li>a<li>b</ul></b></p>&nosuch; &amp;<script>if (a<b) '</p>'</script>", mode="html")
    assert [n for n in c["name"] if n[0] != "#"] == ["p", "p", "b", "br", "ul", "li", "li", "script"]
    assert "if (a<b) '</p>'" in c["data"] and "&nosuch; &" in c["data"]
    assert tree("", mode="html")["name"] == [] and tree("</p>x<", mode="html")["data"] == ["x<"]


def test_stress_depth_width_and_length():
    n = 2000
    c = tree("<a>" * n + "</a>" * n)
    assert max(c["depth"]) == n and c["last"][0] == n - 1
    c = tree("<r>" + "<c/>" * 20000 + "</r>")
    assert c["n_children"][0] == 20000
    name = "n" * 65536
    assert tree(f'<{name} {name}="{name}"/>')["attrs"][0][0][4] == name
    with pytest.raises(ShredError):
        tree("<a>" * 30 + "</a>" * 30, max_depth=20)


def test_declarations():
    d = parse_doctype('<!DOCTYPE a PUBLIC "p" "s" [<!ENTITY % m "b|c"><!ELEMENT a (%m;)*><!ELEMENT b EMPTY><!NOTATION n SYSTEM "v"><!ENTITY x SYSTEM "f" NDATA n><!ATTLIST a k (u|v) "u" l ID #REQUIRED>]>')
    assert (d.name, d.public_id, d.system_id) == ("a", "p", "s")
    assert d.element("a")["model"] == "(b|c)*" and d.attribute("a", "k")["enum"] == ["u", "v"] and d.entity("x")["notation"] == "n" and d.defaults("a") == [("k", "u")]
    again = parse_doctype(d.to_text())
    assert (again.elements, again.attrs, again.notations) == (d.elements, d.attrs, d.notations)
    with pytest.raises(DtdError):
        parse_doctype("<!DOCTYPE a [<!ELEMENT a (b,c|d)>]>")


@pytest.mark.parametrize("model,good,bad", [
    ("(b, c?)", ["b ", "b c "], ["", "c ", "b c c "]), ("(b | c)+", ["b ", "c b "], [""]), ("(b & c)", ["b c ", "c b "], ["b "]), ("EMPTY", [""], ["b "]), ("ANY", ["", "x y "], []),
    ("(#PCDATA | i)*", ["", "i i "], ["b "]), ("(b{2,3}, (c, d)*)", ["b b ", "b b b c d c d "], ["b ", "b b c "]),
])
def test_models(model, good, bad):
    import re

    assert all(re.search(model_regex(model), g) for g in good) and not any(re.search(model_regex(model), b) for b in bad)


def test_model_names():
    assert model_names("(a, (b | c)*, (#PCDATA))") == {"a", "b", "c"}


def test_nested_comments_keywords_and_spaces():
    get = lambda text, **extra: Shredder(ShredOptions(extra=extra)).shred(text)
    assert get("<r><!-- a <!-- b --> c --></r>", nestComment=True)["data"] == [None, " a <!-- b --> c "]
    for text in ("<r><!-- a <!-- b --> c</r>", "<r><!-- a -- b --></r>"):
        with pytest.raises(ShredError):
            get(text, nestComment=True)
    assert get("<r><![cdata[<]]></r>", keywordFold="UPPER")["data"] == [None, "<"]
    with pytest.raises(ShredError):
        get("<r><![cdata[<]]></r>")
    doc = '<!DOCTYPE r [<!ATTLIST r a CDATA #IMPLIED>]><r a="x\ty" b="x\ty"/>'
    assert [a[4] for a in get(doc, noAttributeNorm=True)["attrs"][0]] == ["x y", "x\ty"] and [a[4] for a in get(doc)["attrs"][0]] == ["x y", "x y"]
    with pytest.raises(ShredError, match="illegal character"):
        get('<!DOCTYPE r [<!ENTITY e "&#1114112;">]><r>&e;</r>')
