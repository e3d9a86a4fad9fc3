"""Scalar functions against golden values."""

import datetime

import pytest
from pyspark.sql import functions as F

from sylva.functions import dates, text, types


@pytest.fixture(scope="module")
def one(spark):
    return lambda *columns: list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


@pytest.mark.parametrize("kind,n", [("XML", 4), ("WHATWG", 5), ("CPP", 6), ("UNICODE_ALL", 25), ("PY_ISSPACE", 25), ("JAVASCRIPT", 25), ("AGGRESSIVE", 37)])
def test_spaces(one, kind, n):
    assert len(set(text.SPACES[kind])) == n == len(text.SPACES[kind])
    w = " \t\n\rabc \t\n\r"
    got = one(
        text.is_space(L(text.SPACES[kind] * 3), kind), text.is_space(L(""), kind), text.is_space(L("•"), kind), text.is_space(L(None).cast("string"), kind), text.has_space(L("abc\t"), kind),
        text.lstrip(L(w), kind), text.rstrip(L(w), kind), text.strip(L(w), kind), text.replace_space(L(w), kind), text.normalize_space(L(" \t\n\rab\t\r  c \t\n\r"), kind),
    )
    assert got == [True, False, False, False, True, "abc \t\n\r", " \t\n\rabc", "abc", "    abc    ", "ab c"]


def test_case_and_forms(one):
    assert one(text.normalize_case(L("aBß"), "FOLD"), text.compare_case(L("XYZ"), L("xyz")), text.compare_case(L("xyz0"), L("XYZ1"), "LOWER"), text.compare_case(L("xyz"), L("XYY"), "FOLD")) == ["abss", -1, -1, 1]
    composed, apart = "\u00e9", "e\u0301"
    assert one(text.unicode_form(L(apart), "NFC"), text.unicode_form(L("\ufb03"), "NFKC"), text.unicode_form(L(composed), "NFD"), text.normalize(L(" \t\n\rab\t\r  c \t\n\r"), "NONE", "UPPER", "WHATWG")) == [composed, "ffi", apart, "AB C"]


def test_names(one):
    good = [text.is_xml_chars(L("aArd7.")), text.is_xml_name(L("Rainbow.1")), text.is_xml_name(L("a:b")), text.is_qname(L("tei:lb")), text.is_qqname(L("tei:lb:c")), text.is_pname(L("svg:g")), text.is_nmtoken(L("-foo-")), text.is_xml_number(L("09")), text.is_ncname(L("é\U00010400"))]
    bad = [text.is_xml_chars(L("a\x04")), text.is_xml_chars(L("")), text.is_xml_name(L("Rain•bow'1")), text.is_xml_name(L("-Rain")), text.is_xml_name(L("1Rain")), text.is_qname(L(" z ")), text.is_qname(L("a:b:c")), text.is_qqname(L("a:b:-c")), text.is_pname(L("g")), text.is_nmtoken(L("-f#o-")), text.is_xml_number(L("a9")), text.is_ncname(L("a:b"))]
    assert one(*good) == [True] * len(good) and one(*bad) == [False] * len(bad)
    assert one(*[t(L("abc_1")) for t in text.NAME_TESTS.values()]) == [True] * 5
    assert one(text.prefix_part(L("a:b")), text.local_part(L("a:b")), text.prefix_part(L("b")), text.local_part(L("b"))) == ["a", "b", "", "b"]


def test_escapes(one):
    assert one(
        text.escape_attribute(L('Alfred <"E"> Neuman.')), text.escape_text(L("abc<tag> AT&T xyz")), text.escape_text(L("abc ]]> zz")), text.escape_text(L("abc >>> zz"), True), text.escape_cdata(L("T]]>, right?"), "•"),
        text.escape_comment(L("are -- well?>")), text.escape_pi(L("have this?>"), ""), text.escape_ascii(L("abc•xyz.➎."), 16, 6), text.escape_ascii(L("abc•xyz.➎."), 16, 4, False, False), text.escape_ascii(L("abc•xyz.➎."), 10, 6, True, False),
        text.unescape(L("a&#65;-&bull;-&lt;.&#x2022;")), text.unescape(L("&zerg;"), "keep"), text.drop_illegal(L("abc\x05d\x1ee\x02f")), text.slashify(L("a•😀")), text.char_of(L(0x1F600)), text.char_of(L(0x2022)),
    ) == [
        "Alfred &lt;&quot;E&quot;> Neuman.", "abc&lt;tag> AT&amp;T xyz", "abc ]]&gt; zz", "abc &gt;&gt;&gt; zz", "T•, right?", "are -&#x2d; well?>", "have this", "abc&bull;xyz.&#X00278E;.", "abc&#x2022;xyz.&#x278e;.", "abc&#008226;xyz.&#010126;.",
        "aA-•-<.•", "&zerg;", "abcdef", "a\\u2022\\U0001F600", "😀", "•",
    ]
    with pytest.raises(Exception):
        one(text.unescape(L("&zerg;")))


def test_edits_and_tokens(one):
    assert one(text.substring_data(L("abcdef"), 1, 3), text.insert_data(L("abc"), 1, "X"), text.delete_data(L("abcdef"), 1, 2), text.replace_data(L("abcdef"), 1, 2, "XY"), text.append_data(L("a"), "b")) == ["bcd", "aXbc", "adef", "aXYdef", "ab"]
    with pytest.raises(Exception):
        one(text.substring_data(L("abc"), 1, 2))
    assert one(text.add_token(L("a b"), "c"), text.add_token(L("a b"), "a"), text.remove_token(L("a b a"), "a"), text.replace_token(L("a b"), "b", "a"), text.toggle_token(L("a b"), "b"), text.toggle_token(L("a"), "b")) == ["a b c", "a b", "b", "a", "a", "a b"]
    assert one(text.parse_int(L("0xBEEF"), 16), text.parse_int(L("-101"), 2), text.parse_int(L("+17"), 8), text.parse_float(L("1.5e3")), text.parse_float(L("-INF")), text.parse_float(L("x"))) == [48879, -5, 15, 1500.0, float("-inf"), None]


# Golden values of the facet checks.
GOOD = [
    ("true", "boolean"), ("0", "boolean"), ("127", "byte"), ("-128", "byte"), ("32767", "short"), ("999999", "int"), ("-999999", "long"), ("-999999", "nonPositiveInteger"), ("999999", "positiveInteger"), ("+000000000000000009999", "unsignedShort"),
    ("18446744073709551615", "unsignedLong"), ("-3.141592653589793238462643383", "decimal"), ("9876.54321", "double"), ("---31", "gDay"), ("--01Z", "gMonth"), ("--12-31", "gMonthDay"), ("2024", "gYear"), ("2024-01", "gYearMonth"), ("2024-02-29", "date"),
    ("2024-02-29T11:59:59.214Z", "dateTime"), ("11:59:60", "time"), ("P1Y2M3DT4H3.1415S", "duration"), ("EN-UK", "language"), ("a   b", "normalizedString"), ("aard%VARK", "string"), ("https://example.com/x", "anyURI"), ("Sub-Para_3", "Name"), ("xyzzy", "NCName"),
    ("foo:xyzzy", "QName"), ("blockquote", "NMTOKEN"), ("a b c", "NMTOKENS"), ("0aFF", "hexBinary"), ("aGk=", "base64Binary"), ("12", "NUMBER"), ("a b", "NAMES"), ("x1", "STARTID"),
]
WRONG = [
    ("Q", "boolean", "pattern"), ("abc", "byte", "pybase"), ("128", "byte", "maxInclusive"), ("-129", "byte", "minInclusive"), ("9999999999999", "int", "maxInclusive"), ("9" * 60, "long", "maxInclusive"), ("-" + "9" * 60, "long", "minInclusive"),
    ("99", "nonPositiveInteger", "pattern"), ("0", "positiveInteger", "pattern"), ("-1", "unsignedInt", "pattern"), ("256", "unsignedByte", "maxInclusive"), ("18446744073709551616", "unsignedLong", "maxInclusive"), ("-3.14159xyz", "decimal", "pybase"),
    ("0xBEEF", "float", "pybase"), ("31", "gDay", "pattern"), ("---32", "gDay", "pattern"), ("-1", "gMonth", "pybase"), ("--12-41", "gMonthDay", "pybase"), ("024", "gYear", "pattern"), ("2024-00", "gYearMonth", "pybase"), ("2024-02-57", "date", "pattern"),
    ("2023-02-29", "date", "pybase"), ("11:59:61", "time", "pybase"), ("", "duration", "pybase"), ("12", "language", "pattern"), ("-Sub", "Name", "pattern"), ("xy:zzy", "NCName", "pattern"), ("a b", "NMTOKEN", "pattern"), ("a b %", "IDREFS", "pattern"), ("0aF", "hexBinary", "pattern"),
]


def test_facets(one):
    assert one(*[types.facet_check(L(v), t) for v, t in GOOD]) == [None] * len(GOOD)
    assert one(*[types.facet_check(L(v), t) for v, t, _ in WRONG]) == [f for _, _, f in WRONG]
    assert one(types.facet_check(L(None).cast("string"), "int")) == ["pybase"]
    with pytest.raises(TypeError):
        types.facet_check(L("1"), "notAType")


def test_derived_types_and_casts(one):
    t = types.XsdType("short2", "string", min_length=2, max_length=3, enumeration=("ab", "abc", "abcd"))
    assert one(*[types.facet_check(L(v), t) for v in ("a", "abcd", "ab", "xy")]) == ["minLength", "maxLength", None, "enumeration"]
    d = types.XsdType("money", "decimal", lexical=r"[0-9.]+", fraction_digits=2, total_digits=4)
    assert one(*[types.facet_check(L(v), d) for v in ("12.34", "12.345", "123.45", "1.50")]) == [None, "totalDigits", "totalDigits", None]
    assert one(types.cast_as(L(" 12 "), "int"), types.cast_as(L("x"), "int", 5), types.cast_as(L("1"), "boolean"), types.cast_as(L("INF"), "double"), types.cast_as(L("a  b"), "NMTOKENS"), types.cast_as(L("6869"), "hexBinary")) == [12, 5, True, float("inf"), ["a", "b"], bytearray(b"hi")]


@pytest.mark.parametrize("s", ["2024-11-13T18:05:59.312Z", "2024-11-13", "18:05:59.312Z", "1999", "1999-10", "--08-31", "--08", "---01", "--08-31+05:30", "-0044-03-15", "11:59:60", "24:00:00"])
def test_fragments_print_as_they_were(one, s):
    assert one(dates.to_text(dates.parse_fragment(L(s)))) == [s]


def test_fragments(one):
    f = dates.parse_fragment(L("2024-11-13T18:05:59.312Z"))
    assert one(f["year"], f["month"], f["day"], f["hour"], f["minute"], F.floor(f["second"]), dates.microsecond(f), f["zone_min"], dates.includes_date(f), dates.includes_time(f)) == [2024, 11, 13, 18, 5, 59, 312000, 0, True, True]
    t = dates.parse_fragment(L("15:02:59Z"))
    assert one(t["year"], dates.includes_date(t), dates.includes_time(t)) == [None, False, True]
    assert one(*[dates.parse_fragment(L(s)) for s in ("2023-02-29", "2024-13-01", "25:00:00", "x", "24:00:01")]) == [None] * 5
    assert one(dates.to_utc(dates.parse_fragment(L("2024-02-29T23:00:00-02:00"))), dates.to_utc(dates.parse_fragment(L("2024-02-29T24:00:00Z"))), dates.to_date(dates.parse_fragment(L("2024-02-29")))) == [datetime.datetime(2024, 3, 1, 1), datetime.datetime(2024, 3, 1), datetime.date(2024, 2, 29)]
    assert one(dates.to_text(dates.from_timestamp(L(datetime.datetime(2001, 2, 3, 4, 5, 6))))) == ["2001-02-03T04:05:06Z"]
    assert one(dates.same(dates.parse_fragment(L("--08")), dates.parse_fragment(L("--08"))), dates.parse_zone(L("+14:30")), dates.parse_zone(L("-05:30"))) == [True, None, -330]


def test_durations(one):
    assert one(*[dates.duration_text(dates.parse_duration(L(s))) for s in ("P1Y2M3DT4H3.1415S", "-P1D", "PT0S", "P", "PT", "P1")]) == ["P1Y2M3DT4H3.1415S", "-P1D", "PT0S", None, None, None]
    assert one(dates.add_duration(L(datetime.datetime(2024, 1, 31)), dates.parse_duration(L("P1M1DT1H")))) == [datetime.datetime(2024, 3, 1, 1)]


def test_references_beyond_the_last_character(spark):
    """A number that no character has stays as it is, or is an error of its own kind."""
    df = spark.createDataFrame([("a &#1114112; &#xD800; &#65; &lt;",)], "s string")
    assert df.select(text.unescape(df.s, "keep").alias("t")).first()["t"] == "a &#1114112; &#xD800; A <"
