"""Scans and sinks: files of documents, declarations, schemas, name tables, node tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.sources.dtd import Dtd, DtdError, parse_doctype
from sylva.sources.options import ShredOptions
from sylva.sources.shred import NODES, shred


def sniff_encoding(content: Column) -> Column:
    """The encoding of a document's bytes: byte-order mark, else the pattern of the first bytes, else the declaration, else UTF-8."""
    head = F.hex(F.substring(content, 1, 4))
    declared = F.upper(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"^<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", 1))
    return (
        F.when(F.startswith(head, F.lit("EFBBBF")), "UTF-8").when(head == "0000FEFF", "UTF-32BE").when(head == "FFFE0000", "UTF-32LE")
        .when(F.startswith(head, F.lit("FEFF")) | F.startswith(head, F.lit("003C")), "UTF-16BE").when(F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("3C00")), "UTF-16LE")
        .when(head == "4C6FA794", "IBM037").when(declared.isin("ISO-8859-1", "US-ASCII", "UTF-16", "WINDOWS-1252"), declared).otherwise("UTF-8")
    )


def decode_bytes(content: Column) -> Column:
    """Bytes to text, without the byte-order mark."""
    enc = sniff_encoding(content)
    out = F.decode(content, "UTF-8")
    for name in ("UTF-16BE", "UTF-16LE", "UTF-32BE", "UTF-32LE", "ISO-8859-1", "US-ASCII", "UTF-16", "IBM037", "WINDOWS-1252"):
        out = F.when(enc == name, F.decode(content, "UTF-32" if name.startswith("UTF-32") else name)).otherwise(out)
    return F.regexp_replace(out, r"^\x{feff}", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one row per file, read by Spark's own file source."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", decode_bytes(F.col("content")).alias("text"))


def read_xml(spark: SparkSession, path: str, options: ShredOptions | None = None) -> DataFrame:
    return shred(read_documents(spark, path), options=options)


def document_properties(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, encoding, standalone, doctype_name, public_id, system_id), from the prolog, by expressions."""
    decl = F.regexp_extract(text, r"^<\?xml\s([^>]*?)\?>", 1)
    pseudo = lambda n: F.nullif(F.regexp_extract(decl, rf"(?:^|\s){n}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    doctype = F.regexp_extract(text, r"<!DOCTYPE\s+([^>\[]*)", 1)
    return docs.select(
        F.col(doc_id).alias("doc_id"), pseudo("version").alias("version"), pseudo("encoding").alias("encoding"), pseudo("standalone").alias("standalone"),
        F.nullif(F.regexp_extract(doctype, r"^(\S+)", 1), F.lit("")).alias("doctype_name"),
        F.nullif(F.regexp_extract(doctype, r"PUBLIC\s+[\"']([^\"']*)[\"']", 1), F.lit("")).alias("public_id"),
        F.nullif(F.regexp_extract(doctype, r"(?:SYSTEM|PUBLIC\s+(?:\"[^\"]*\"|'[^']*'))\s+[\"']([^\"']*)[\"']", 1), F.lit("")).alias("system_id"),
    )


_DECLARATIONS = "doc_id long, kind string, name string, model string, model_re string, elem string, attr string, type string, default_kind string, value string, enum array<string>, parameter boolean, literal string, public_id string, system_id string, notation string, message string"


def declarations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: ShredOptions | None = None) -> DataFrame:
    """Element, attribute, entity and notation declarations of internal subsets, one row each (``kind``); bad ones are rows of kind error."""
    opts = options or ShredOptions()
    names = [f.split()[0] for f in _DECLARATIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, s in zip(pdf["doc_id"], pdf["dcl"], strict=True):
                if not s:
                    continue
                try:
                    dtd = parse_doctype(s, opts.get)
                except DtdError as e:
                    rows.append({"doc_id": d, "kind": "error", "message": str(e)})
                    continue
                rows += [{"doc_id": d, "kind": k} | x for k, xs in (("element", dtd.elements), ("attribute", dtd.attrs), ("entity", dtd.entities), ("notation", dtd.notations)) for x in xs]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    dcl = F.regexp_extract(text, r"(<!DOCTYPE\s[^>\[]*(?:\[(?:\"[^\"]*\"|'[^']*'|<!--[\s\S]*?-->|[^\]\"'])*\]\s*)?>)", 1)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), dcl.alias("dcl")).mapInPandas(run, _DECLARATIONS)


def schema_tables(spark: SparkSession, dtd: Dtd) -> dict[str, DataFrame]:
    """A schema's declarations as small tables."""
    return {
        "dtd_elements": spark.createDataFrame([(e["name"], e["model"], e["model_re"]) for e in dtd.elements], "name string, model string, model_re string"),
        "dtd_attrs": spark.createDataFrame([(a["elem"], a["attr"], a["type"], a["default_kind"], a["value"], a["enum"]) for a in dtd.attrs], "elem string, attr string, type string, default_kind string, value string, enum array<string>"),
        "dtd_entities": spark.createDataFrame([(e["name"], e["parameter"], e["literal"], e["public_id"], e["system_id"], e["notation"]) for e in dtd.entities], "name string, parameter boolean, literal string, public_id string, system_id string, notation string"),
        "dtd_notations": spark.createDataFrame([(n["name"], n["public_id"], n["system_id"]) for n in dtd.notations], "name string, public_id string, system_id string"),
    }


def check_models(forest: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, pre, name, model, children) of elements whose child elements break their content model."""
    kids = forest.filter("node_type = 1 and parent is not null").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: F.concat(x["name"], F.lit(" "))), "").alias("children"))
    e = forest.filter("node_type = 1").select("doc_id", "pre", "name", "n_children").join(declared.select("name", "model", "model_re"), "name")
    joined = e.join(kids, ["doc_id", "pre"], "left").withColumn("children", F.coalesce("children", F.lit("")))
    broken = ~F.regexp(F.col("children"), F.col("model_re")) | ((F.col("model") == "EMPTY") & (F.col("n_children") > 0))
    return joined.filter(broken).select("doc_id", "pre", "name", "model", "children")


def undeclared(forest: DataFrame, elements: DataFrame | None = None, attrs: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, kind, name) of elements and attributes without a declaration."""
    out = None
    if elements is not None:
        out = forest.filter("node_type = 1").join(elements.select("name"), "name", "left_anti").select("doc_id", "pre", F.lit("element").alias("kind"), "name")
    if attrs is not None:
        from sylva.operators.attrs import exploded

        have = attrs.select("elem", F.col("attr").alias("name"))
        everywhere = have.filter("elem = '*'").select("name")
        rest = exploded(forest).join(have, ["elem", "name"], "left_anti").join(everywhere, "name", "left_anti").select("doc_id", "pre", F.lit("attribute").alias("kind"), "name")
        out = rest if out is None else out.unionByName(rest)
    return out


# -- name tables -------------------------------------------------------------------


def html_names(spark: SparkSession) -> DataFrame:
    """(name, cp) of the HTML character names."""
    return spark.createDataFrame(sorted(name2codepoint.items()), "name string, cp int")


def names_from_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines ``name<sep>code point``, decimal or 0x; the first of a name wins."""
    rows = spark.read.text(path).select(F.trim(F.substring_index("value", sep, 1)).alias("name"), F.trim(F.substring_index("value", sep, -1)).alias("n"), F.monotonically_increasing_id().alias("at"))
    cp = F.when(F.startswith(F.lower("n"), F.lit("0x")), F.conv(F.substring("n", 3, 8), 16, 10)).otherwise(F.col("n")).try_cast("int")
    return rows.withColumn("cp", cp).filter("cp is not null").groupBy("name").agg(F.min_by("cp", "at").alias("cp"))


def names_from_declarations(spark: SparkSession, path: str) -> DataFrame:
    """``<!ENTITY name "&#..;">`` declarations of a file; the first of a name wins."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"<!ENTITY\s+[\w.-]+\s+[\"']&#[xX]?[0-9A-Fa-f]+;[\"']"), F.lit(0))).alias("at", "d"))
    hexa, dec = F.regexp_extract("d", r"&#[xX]([0-9A-Fa-f]+);", 1), F.regexp_extract("d", r"&#([0-9]+);", 1)
    rows = each.select("at", F.regexp_extract("d", r"<!ENTITY\s+([\w.-]+)", 1).alias("name"), F.coalesce(F.conv(F.nullif(hexa, F.lit("")), 16, 10), F.nullif(dec, F.lit(""))).cast("int").alias("cp"))
    return rows.groupBy("name").agg(F.min_by("cp", "at").alias("cp"))


def save_names(names: DataFrame, path: str, sep: str = "\t") -> None:
    names.select("name", "cp").write.mode("overwrite").option("sep", sep).csv(path)


def read_taginfo(spark: SparkSession, path: str) -> DataFrame:
    """(tag, display) lines of a CSV, comments left out."""
    rows = spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema("tag string, display string").csv(path)
    return rows.filter("tag is not null and tag <> ''")


def save_forest(forest: DataFrame, path: str, buckets: int | None = None, table: str | None = None) -> None:
    """A node table as Parquet; bucketed by document when saved as a table, so that later joins need no exchange."""
    if table:
        forest.write.mode("overwrite").option("path", path).bucketBy(buckets or 64, "doc_id").sortBy("doc_id", "pre").saveAsTable(table)
    else:
        forest.repartition(F.col("doc_id")).sortWithinPartitions("doc_id", "pre").write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)
