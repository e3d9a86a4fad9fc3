"""Attributes: expressions over the nested array, and lookups along the ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(forest: DataFrame) -> DataFrame:
    """The attribute table: doc_id, pre, elem, aord and the attribute's fields."""
    return forest.filter("node_type = 1").select("doc_id", "pre", F.col("name").alias("elem"), F.posexplode("attrs").alias("aord", "a")).select("doc_id", "pre", "elem", "aord", "a.*")


def attribute_node(name: str, ns_uri: str | None = None, attrs: str = "attrs") -> Column:
    """The struct of an attribute: an exact name wins, else the first of that local name; with a namespace local name and uri must fit."""
    a = F.col(attrs)
    if ns_uri is not None:
        return F.get(F.filter(a, lambda x: (x["local"] == name) & ((x["ns_uri"] == ns_uri) if ns_uri != "##any" else F.lit(True))), F.lit(0))
    return F.coalesce(F.get(F.filter(a, lambda x: x["name"] == name), F.lit(0)), F.get(F.filter(a, lambda x: x["local"] == name), F.lit(0)))


def attribute(name: str, ns_uri: str | None = None, cast_as: str | None = None, default=None, attrs: str = "attrs") -> Column:
    value = attribute_node(name, ns_uri, attrs)["value"]
    if cast_as is not None:
        from sylva.functions.types import cast_as as cast

        return cast(value, cast_as, default)
    return value if default is None else F.coalesce(value, F.lit(default))


def has_attribute(name: str, ns_uri: str | None = None) -> Column:
    return F.coalesce(attribute_node(name, ns_uri).isNotNull(), F.lit(False))


def has_attributes() -> Column:
    return F.size("attrs") > 0


def attribute_at(index: int) -> Column:
    """The attribute at a place, from the end for a negative one."""
    return F.get("attrs", F.lit(index) if index >= 0 else F.size("attrs") + index)


def index_of(name: str) -> Column:
    """The place of an attribute, -1 without it."""
    return (F.array_position(F.transform("attrs", lambda x: x["name"]), name) - 1).cast("int")


def attribute_map(attrs: str = "attrs") -> Column:
    return F.map_from_entries(F.transform(F.col(attrs), lambda x: F.struct(x["name"], x["value"])))


def inherited(forest: DataFrame, ctx: DataFrame, name: str, ns_uri: str | None = None, default: str | None = None) -> DataFrame:
    """ctx rows (doc_id, pre) with ``value``: that of the nearest ancestor-or-self that has the attribute.

    Only elements that carry the attribute join; the nearest is an aggregate, so there is no sort.
    """
    carriers = forest.filter("node_type = 1").select("doc_id", F.col("pre").alias("_a"), attribute(name, ns_uri).alias("_v")).filter("_v is not null")
    up = ctx.select("doc_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("_a"))
    near = up.join(carriers, ["doc_id", "_a"]).groupBy("doc_id", "pre").agg(F.max_by("_v", "_a").alias("_v"))
    return ctx.select("doc_id", "pre").join(near, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("_v", F.lit(default)).alias("value"))


def stacked(forest: DataFrame, ctx: DataFrame, name: str, sep: str = "/") -> DataFrame:
    """ctx rows with ``value``: the attribute of all ancestors-or-self below the root, outermost first, '' where absent, each after ``sep``."""
    carriers = forest.filter("node_type = 1").select("doc_id", F.col("pre").alias("_a"), attribute(name).alias("_v")).filter("_v is not null")
    up = ctx.select("doc_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("_a")).filter("_a > 0")
    parts = up.join(carriers, ["doc_id", "_a"], "left").groupBy("doc_id", "pre").agg(F.sort_array(F.collect_list(F.struct("_a", F.coalesce("_v", F.lit("")).alias("v")))).alias("s"))
    return parts.select("doc_id", "pre", F.array_join(F.transform("s", lambda x: x["v"]), sep).alias("value"))


def lookup_namespace(forest: DataFrame, ctx: DataFrame, prefix: str = "") -> DataFrame:
    """ctx rows with ``uri``: the nearest declaration of a prefix ('' for the default namespace)."""
    return inherited(forest, ctx, f"xmlns:{prefix}" if prefix else "xmlns").select("doc_id", "pre", F.nullif("value", F.lit("")).alias("uri")) if prefix != "xml" else ctx.select("doc_id", "pre", F.lit("http://www.w3.org/XML/1998/namespace").alias("uri"))


def lookup_prefix(forest: DataFrame, ctx: DataFrame, uri: str) -> DataFrame:
    """ctx rows with ``prefix``: the first prefix in scope, by declaration order, that stands for a uri."""
    declared = exploded(forest).filter((F.col("prefix") == "xmlns") | (F.col("name") == "xmlns")).select("doc_id", F.col("pre").alias("_a"), "aord", F.when(F.col("name") == "xmlns", "").otherwise(F.col("local")).alias("prefix"), "value")
    up = ctx.select("doc_id", "pre", F.explode(F.concat("anc", F.array("pre"))).alias("_a"))
    in_scope = up.join(declared, ["doc_id", "_a"]).groupBy("doc_id", "pre", "prefix").agg(F.max_by("value", "_a").alias("value"), F.min(F.struct("_a", "aord")).alias("at")).filter(F.col("value") == uri)
    return ctx.select("doc_id", "pre").join(in_scope.groupBy("doc_id", "pre").agg(F.min_by("prefix", "at").alias("prefix")), ["doc_id", "pre"], "left")


# -- edits: rows in, rows out ------------------------------------------------------


def set_attribute(forest: DataFrame, where: Column, name: str, value: Column | str, ns_uri: str | None = None) -> DataFrame:
    """Replaces in place or appends."""
    v = F.lit(value) if isinstance(value, str) else value
    prefix, local = name.split(":", 1) if ":" in name else (None, name)
    new = F.struct(F.lit(name).alias("name"), F.lit(prefix).cast("string").alias("prefix"), F.lit(local).alias("local"), F.lit(ns_uri).cast("string").alias("ns_uri"), v.alias("value"), F.lit(True).alias("specified"))
    have = F.exists("attrs", lambda x: x["name"] == name)
    replaced = F.transform("attrs", lambda x: F.when(x["name"] == name, new).otherwise(x))
    return forest.withColumn("attrs", F.when(where & (F.col("node_type") == 1), F.when(have, replaced).otherwise(F.concat("attrs", F.array(new)))).otherwise(F.col("attrs")))


def rename_attribute(forest: DataFrame, where: Column, name: str, new: str, ns_uri: str | None = None) -> DataFrame:
    """Another name (and namespace) in place; an attribute that had the new name gives way."""
    prefix, local = new.split(":", 1) if ":" in new else (None, new)
    hit = where & F.exists("attrs", lambda x: x["name"] == name)
    rest = F.filter("attrs", lambda x: (x["name"] != new) | F.lit(name == new))
    named = lambda x: F.struct(F.lit(new).alias("name"), F.lit(prefix).cast("string").alias("prefix"), F.lit(local).alias("local"), F.lit(ns_uri).cast("string").alias("ns_uri"), x["value"].alias("value"), x["specified"].alias("specified"))
    return forest.withColumn("attrs", F.when(hit, F.transform(rest, lambda x: F.when(x["name"] == name, named(x)).otherwise(x))).otherwise(F.col("attrs")))


def remove_attribute(forest: DataFrame, where: Column, name: str, ns_uri: str | None = None) -> DataFrame:
    """Silent where it is absent; with a namespace ``name`` is the local name."""

    def stays(x: Column) -> Column:
        return x["name"] != name if ns_uri is None else ~((x["local"] == name) & x["ns_uri"].eqNullSafe(ns_uri))

    return forest.withColumn("attrs", F.when(where, F.filter("attrs", stays)).otherwise(F.col("attrs")))


def clear_attributes(forest: DataFrame, where: Column) -> DataFrame:
    return forest.withColumn("attrs", F.when(where, F.slice("attrs", 1, 0)).otherwise(F.col("attrs")))


def apply_defaults(forest: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared default values for absent attributes, ``specified`` false; ``declared`` as of a schema's ``dtd_attrs``."""
    d = declared.filter("value is not null").groupBy("elem").agg(F.sort_array(F.collect_list(F.struct(F.col("attr").alias("n"), F.col("value").alias("v")))).alias("_dft"))
    some = forest.join(d.withColumnRenamed("elem", "_e"), (F.col("name") == F.col("_e")) & (F.col("node_type") == 1), "left")
    add = F.transform(
        F.filter(F.coalesce("_dft", F.array().cast("array<struct<n:string,v:string>>")), lambda x: ~F.exists("attrs", lambda a: a["name"] == x["n"])),
        lambda x: F.struct(x["n"].alias("name"), F.lit(None).cast("string").alias("prefix"), x["n"].alias("local"), F.lit(None).cast("string").alias("ns_uri"), x["v"].alias("value"), F.lit(False).alias("specified")),
    )
    return some.withColumn("attrs", F.concat("attrs", add)).select(*forest.columns)
