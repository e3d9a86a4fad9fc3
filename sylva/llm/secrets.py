"""Secret scans over an incremental blob ledger.

A *version* is one text at one path (commit, revision, document).  Versions are
content-addressed by SHA-256; the ledger records which (blob, rule, rule version)
pairs were scanned and what each rule version found.  A scan takes one text of every
blob that still misses a pair, runs only the missing rules on it, appends to the ledger,
and joins the findings of the rules that are asked for, and of no other versions, back
to all paths.

Shuffles: (path, blob) pairs to choose one text per blob; the chosen texts once,
dealt by (blob, path), so that a blob held by a third of all paths is no hot key;
findings, which are few, back to paths.  A text itself is never grouped.

Defined results: a null text counts as empty and has no findings; a null path is
kept and reported like any other; repeated rows are reported once each; an empty
table gives an empty table; other columns are not read.  Very long texts are
scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.blobs import slices
from sylva.llm.common import materialize, replaced, scratch


@dataclass(frozen=True)
class Rule:
    """``needs``: lower-case strings of which a text must hold one to be searched; ``least``: of ``group``'s length."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed.  The first three are the base.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, ("password", "passwd", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0, ("private key",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.A, 0, 0, ("eyj",)),
)
BASE = ("assign", "access", "hex")
UNIT = 8 << 20
FINDING = "blob string, rule string, kind string, start int, end int"


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, str, int, int]]:
    """(rule, kind, start, end) in code points: per rule the leftmost non-overlapping matches; short ones are dropped, not retried."""
    low, out = text.lower(), []
    for r in rules:
        if r.needs and not any(x in low for x in r.needs):
            continue
        out += [(r.name, r.kind, m.start(), m.end()) for m in re.compile(r.pattern, r.flags).finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return out


def _scanner(rules: tuple[Rule, ...]):
    """(blob, text, todo) to findings, a few megabytes of text at a time."""
    known = {r.name: r for r in rules}
    schema = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, UNIT):
                blobs, texts, todo = (c.to_pylist() for c in part.columns)
                rows = [(blob, *x) for blob, text, names in zip(blobs, texts, todo, strict=True) for x in find(text, tuple(known[n] for n in names))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return scan


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger; empty before the first scan.  A folder that is there must be readable."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scan_versions(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path``, ``blob`` and ``found`` (array of (start, kind rank, kind, end), sorted) for every row of ``versions``.

    ``ledger`` names the folder of the ledger, in a store that all executors share; without one a
    fresh ledger is made in the session's scratch folder.
    """
    spark = versions.sparkSession
    ledger = ledger or f"{scratch(spark)}/ledger"
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialize(texts.select("path", "blob"), "paths")

    names = [r.name for r in rules]
    seen = _ledger(spark, f"{ledger}/scanned", "blob string, done array<string>").groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("done"))
    todo = (
        paths.groupBy("blob").agg(F.min("path").alias("path"))
        .join(seen, "blob", "left")
        .select("blob", "path", F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    todo = materialize(todo, "todo")
    chosen = texts.join(todo.withColumnRenamed("path", "rep").withColumnRenamed("blob", "b").hint("shuffle_hash"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("rep")))
    chosen.select("blob", "text", "todo").mapInArrow(_scanner(rules), FINDING).write.mode("append").option("compression", "zstd").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("todo").alias("done")).write.mode("append").parquet(f"{ledger}/scanned")

    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    found = (
        _ledger(spark, f"{ledger}/findings", FINDING)
        .filter(F.col("rule").isin(*names))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    )
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("found"))


def spans_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op4."""

    def base(x):
        return x["kind"].isin(*BASE)

    def n(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_versions(docs).select(
        F.col("path").alias("doc_id"), *[n(k) for k in BASE],
        F.sha2(spans_text(F.filter("found", base)), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced; documents without findings keep their text byte for byte.

    Texts and findings meet by doc_id and content hash; overlapping findings are replaced as one.
    """
    hits = scan_versions(docs).filter(F.size("found") > 0).select(F.col("path").alias("__sylva_p"), F.col("blob").alias("__sylva_b"), F.col("found").alias("__sylva_f")).distinct()

    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    wide = docs.withColumn("__sylva_key", key).join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__sylva_p")) & (F.col("__sylva_key") == F.col("__sylva_b")), "left")
    clean = F.when(F.col("__sylva_f").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__sylva_f"), lambda y: F.lit(mark)))
    out = wide.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__sylva_f").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
