"""XSD datatypes: a registry, and facet checks compiled to one expression per type.

``facet_check(value, type)`` is null for a good value, else the first violated facet in
the order pybase, pattern, lengths, bounds, enumeration, digits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import _java, normalize_space, replace_space
from sylva.sources.shred import NCNAME, QNAME

_NAME = NCNAME.replace("[", "[:", 1).replace("0-9", ":0-9", 1)
_NMTOKEN = "[:" + NCNAME[1 : NCNAME.index("]")] + "0-9.\\-·̀-ͯ‿-⁀]+"
_ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_MONTH, _DAY = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_YEAR = "-?([1-9][0-9]{3,}|0[0-9]{3})"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?|24:00:00(\.0+)?)"
_INT = "[+-]?[0-9]+"


@dataclass(frozen=True)
class XsdType:
    """``base``: the type it restricts; ``lexical``: what casts at all (pybase); ``pattern``: the pattern facet."""

    name: str
    base: str | None = None
    spark: str = "string"
    lexical: str | None = None
    pattern: str | None = None
    low: str | None = None
    high: str | None = None
    space: str = "collapse"
    variety: str = "atom"
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    enumeration: tuple = field(default=())
    fraction_digits: int | None = None
    total_digits: int | None = None


_DATE_LIKE = r"[0-9TZ:+.-]+"
# Names, bases and bounds of the built-in types.
_ALL = [
    XsdType("string", space="preserve"), XsdType("normalizedString", "string", space="replace"), XsdType("token", "normalizedString"),
    XsdType("language", "token", pattern="[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"), XsdType("NMTOKEN", "token", pattern=_NMTOKEN), XsdType("NMTOKENS", "NMTOKEN", "array<string>", variety="list", pattern=_NMTOKEN),
    XsdType("Name", "token", pattern=_NAME), XsdType("NCName", "Name", pattern=NCNAME), XsdType("ID", "NCName", pattern=NCNAME), XsdType("IDREF", "NCName", pattern=NCNAME),
    XsdType("IDREFS", "IDREF", "array<string>", variety="list", pattern=NCNAME), XsdType("ENTITY", "NCName", pattern=NCNAME), XsdType("ENTITIES", "ENTITY", "array<string>", variety="list", pattern=NCNAME),
    XsdType("QName", "string", pattern=QNAME), XsdType("NOTATION", "string", pattern=QNAME),
    XsdType("boolean", None, "boolean", pattern="true|false|1|0"),
    XsdType("decimal", None, "decimal(38,18)", lexical=r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"),
    XsdType("float", "decimal", "float", lexical=r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN"), XsdType("double", "decimal", "double", lexical=r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN"),
    XsdType("integer", "decimal", "decimal(38,0)", lexical=_INT, fraction_digits=0),
    XsdType("nonPositiveInteger", "integer", "decimal(38,0)", lexical=_INT, pattern="-[0-9]+|[+]?0+", high="0", fraction_digits=0),
    XsdType("negativeInteger", "nonPositiveInteger", "decimal(38,0)", lexical=_INT, pattern="-0*[1-9][0-9]*", high="-1", fraction_digits=0),
    XsdType("nonNegativeInteger", "integer", "decimal(38,0)", lexical=_INT, pattern="[+]?[0-9]+|-0+", low="0", fraction_digits=0),
    XsdType("positiveInteger", "nonNegativeInteger", "decimal(38,0)", lexical=_INT, pattern="[+]?0*[1-9][0-9]*", low="1", fraction_digits=0),
    XsdType("long", "integer", "bigint", lexical=_INT, low="-9223372036854775808", high="9223372036854775807", fraction_digits=0),
    XsdType("int", "long", "int", lexical=_INT, low="-2147483648", high="2147483647", fraction_digits=0),
    XsdType("short", "int", "smallint", lexical=_INT, low="-32768", high="32767", fraction_digits=0), XsdType("byte", "short", "tinyint", lexical=_INT, low="-128", high="127", fraction_digits=0),
    XsdType("unsignedLong", "nonNegativeInteger", "decimal(20,0)", lexical=_INT, pattern="[+]?[0-9]+|-0+", low="0", high="18446744073709551615", fraction_digits=0),
    XsdType("unsignedInt", "unsignedLong", "bigint", lexical=_INT, pattern="[+]?[0-9]+|-0+", low="0", high="4294967295", fraction_digits=0),
    XsdType("unsignedShort", "unsignedInt", "int", lexical=_INT, pattern="[+]?[0-9]+|-0+", low="0", high="65535", fraction_digits=0),
    XsdType("unsignedByte", "unsignedShort", "smallint", lexical=_INT, pattern="[+]?[0-9]+|-0+", low="0", high="255", fraction_digits=0),
    XsdType("duration", None, "string", lexical=r"-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?"),
    XsdType("date", None, "date", lexical=_DATE_LIKE, pattern=f"{_YEAR}-{_MONTH}-{_DAY}{_ZONE}"), XsdType("time", None, "string", lexical=_TIME + _ZONE),
    XsdType("dateTime", None, "timestamp", lexical=_DATE_LIKE, pattern=f"{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}"),
    XsdType("gYearMonth", None, "string", lexical=f"{_YEAR}-{_MONTH}{_ZONE}"), XsdType("gYear", None, "string", lexical=r"-?[0-9]+" + _ZONE, pattern=_YEAR + _ZONE), XsdType("gMonthDay", None, "string", lexical=f"--{_MONTH}-{_DAY}{_ZONE}"),
    XsdType("gDay", None, "string", lexical=r"-*[0-9]{1,2}" + _ZONE, pattern=f"---{_DAY}{_ZONE}"), XsdType("gMonth", None, "string", lexical=r"(--)?[0-9]{1,2}" + _ZONE, pattern=f"--{_MONTH}{_ZONE}"),
    XsdType("hexBinary", "string", "binary", pattern="([0-9A-Fa-f]{2})*"), XsdType("base64Binary", "string", "binary", pattern="(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){2,3}={1,2})?"),
    XsdType("anyURI", "string"), XsdType("CDATA", "string", space="preserve"),
]
REGISTRY: dict[str, XsdType] = {t.name: t for t in _ALL}
# Attribute types beyond XSD, and identifier types of overlapping markup.
SGML_TYPES = {"NAME": "NCName", "NUMBER": "nonNegativeInteger", "NUTOKEN": "NMTOKEN"}
OVERLAP_ID_TYPES = ("STACKID", "TYPEID", "COMPOUNDID", "COID", "STARTID", "SUSPENDID", "RESUMEID", "ENDID", "BOUNDARYID")


def register(t: XsdType) -> XsdType:
    """Adds a derived type; its base must be known."""
    if t.base is not None and t.base not in REGISTRY:
        raise KeyError(f"unknown base type {t.base}")
    REGISTRY[t.name] = t
    return t


def with_sgml_types() -> dict[str, XsdType]:
    """The registry with NAME(S), NUMBER(S), NUTOKEN(S) and the overlap identifiers."""
    out = dict(REGISTRY)
    for name, base in SGML_TYPES.items():
        b = REGISTRY[base]
        out[name] = XsdType(name, base, b.spark, b.lexical, b.pattern)
        out[name + "S"] = XsdType(name + "S", base, "array<string>", b.lexical, b.pattern, variety="list")
    return out | {n: XsdType(n, "NCName", pattern=NCNAME) for n in OVERLAP_ID_TYPES}


def spaced(value: Column, t: XsdType) -> Column:
    """White space as the type wants it."""
    return {"preserve": lambda v: v, "replace": replace_space, "collapse": normalize_space}[t.space](value)


def _like(v: Column, pattern: str) -> Column:
    return F.regexp_like(v, F.lit(f"^(?:{_java(pattern)})\\z"))


def facet_check(value: Column, type_name: str | XsdType) -> Column:
    """The first violated facet, or null."""
    t = type_name if isinstance(type_name, XsdType) else with_sgml_types().get(type_name)
    if t is None:
        raise TypeError(f"unknown type {type_name}")
    if t.variety == "list":
        item = XsdType(t.name, t.base, "string", t.lexical, t.pattern, t.low, t.high)
        return F.try_element_at(F.filter(F.transform(F.split(normalize_space(value), " "), lambda v: facet_check(v, item)), lambda x: x.isNotNull()), F.lit(1))
    v = spaced(value, t)
    tests: list[tuple[str, Column]] = [("pybase", value.isNull())]
    if t.lexical:
        tests.append(("pybase", ~_like(v, t.lexical)))
    if t.pattern:
        tests.append(("pattern", ~_like(v, t.pattern)))
    for facet, bound, bad in (("length", t.length, lambda n: F.length(v) != n), ("minLength", t.min_length, lambda n: F.length(v) < n), ("maxLength", t.max_length, lambda n: F.length(v) > n)):
        if bound is not None:
            tests.append((facet, bad(bound)))
    if t.low is not None or t.high is not None:
        # numbers beyond 38 digits are beyond every bound: their sign decides
        number, long_ = v.try_cast("decimal(38,0)"), F.length(F.regexp_replace(v, "^[+-]?0*", "")) > 38
        if t.low is not None:
            tests.append(("minInclusive", F.coalesce(number < F.lit(t.low).cast("decimal(38,0)"), F.lit(False)) | (long_ & F.startswith(v, F.lit("-")))))
        if t.high is not None:
            tests.append(("maxInclusive", F.coalesce(number > F.lit(t.high).cast("decimal(38,0)"), F.lit(False)) | (long_ & ~F.startswith(v, F.lit("-")))))
    if t.name in ("date", "dateTime"):
        tests.append(("pybase", F.substring(F.regexp_replace(v, "^-", ""), 1, 10).try_cast("date").isNull()))
    if t.enumeration:
        tests.append(("enumeration", ~v.isin(*t.enumeration)))
    if t.total_digits is not None:
        tests.append(("totalDigits", F.length(F.regexp_replace(F.regexp_replace(v, "[^0-9]", ""), "^0+", "")) > t.total_digits))
    if t.fraction_digits is not None:
        tests.append(("fractionDigits", F.length(F.regexp_replace(F.regexp_extract(v, r"\.([0-9]*)", 1), "0+$", "")) > t.fraction_digits))
    return reduce(lambda rest, x: F.when(x[1], F.lit(x[0])).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def is_ok(value: Column, type_name: str | XsdType) -> Column:
    return facet_check(value, type_name).isNull()


def cast_as(value: Column, type_name: str, default=None) -> Column:
    """The value as the type's Spark type; null (or ``default``) for a bad one."""
    t = with_sgml_types()[type_name]
    v = spaced(value, t)
    if t.variety == "list":
        out = F.split(v, " ")
    elif t.name == "boolean":
        out = v.isin("true", "1")
    elif t.name == "hexBinary":
        out = F.unhex(v)
    elif t.name == "base64Binary":
        out = F.unbase64(v)
    elif t.spark in ("float", "double"):
        out = F.replace(v, F.lit("INF"), F.lit("Infinity")).try_cast(t.spark)
    else:
        out = v.try_cast(t.spark)
    got = F.when(is_ok(value, type_name), out)
    return got if default is None else F.coalesce(got, F.lit(default))


def typed_attributes(attrs: DataFrame, declared: DataFrame) -> DataFrame:
    """``attrs`` (exploded, with ``elem`` and ``name``) with its declared type and first violated facet; the element's own declaration wins over ``*``."""
    own = attrs.join(declared.select(F.col("elem").alias("elem"), F.col("attr").alias("name"), F.col("type").alias("own_type")), ["elem", "name"], "left")
    both = own.join(declared.filter("elem = '*'").select(F.col("attr").alias("name"), F.col("type").alias("any_type")), "name", "left")
    typed = both.withColumn("type_name", F.coalesce("own_type", "any_type", F.lit("CDATA"))).drop("own_type", "any_type")
    check = reduce(lambda rest, n: F.when(F.col("type_name") == n, facet_check(F.col("value"), n)).otherwise(rest), with_sgml_types(), F.lit(None).cast("string"))
    return typed.withColumn("violated_facet", check)
