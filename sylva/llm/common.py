"""Shared helpers: scratch tables, distributed ranks, packed exchanges."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 20240601

#: The white space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the session; a local one only for a local master that names none.

    Results read from it, so it stays until the driver ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    _made.append((spark, f"{base.rstrip('/')}/sylva-{uuid.uuid4().hex}"))
    return _made[-1][1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _sweep() -> None:
    """Deletes the scratch folders of a driver that ends before its session does."""
    for spark, folder in _made:
        try:
            _delete(spark, folder)
        except Exception:  # the session is gone: what is left is named sylva-*
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialize`` wrote and nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 2)[0]
        if "/sylva-" in folder:
            with contextlib.suppress(Exception):
                _delete(df.sparkSession, folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but white space; without words or text an empty array."""
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(blanks, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero, merge) -> Column:
    """Exclusive running ``merge`` (associative) of an array: element k merges the elements before it.

    In blocks of the cube root of the size, so that n elements take about n ** (4 / 3) steps.
    """

    def of(x: Column) -> Column:
        n = F.size(x)

        def in_blocks(step: Column) -> Column:
            cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: F.slice(x, b * step + 1, step))

            def with_sums(blocks: Column) -> Column:
                whole = F.transform(blocks, lambda y: F.aggregate(y, zero, merge))
                within = lambda y, lead: F.transform(y, lambda _, j: F.aggregate(F.slice(y, 1, j), lead, merge))
                return let(whole, lambda sums: F.flatten(F.transform(blocks, lambda y, b: let(F.aggregate(F.slice(sums, 1, b), zero, merge), lambda lead: within(y, lead)))))

            return let(cut, with_sums)

        return F.when(n > 0, let(F.ceil(F.cbrt(n)).cast("int"), in_blocks)).otherwise(F.slice(x, 1, 0))

    return let(values, of)


#: Code points to a block of a text that is read at many places.
BLOCK = 4096


def in_blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points, for ``piece``."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks: it costs its own length and two blocks, wherever it lies."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        head = F.substr(F.get(blocks, i), a - i * BLOCK + 1, b - a)
        tail = F.substr(F.get(blocks, j), F.lit(1), b - j * BLOCK)
        return F.when(b <= a, "").when(i == j, head).otherwise(F.concat(head, F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), tail))

    return let(F.struct(start.cast("int").alias("a"), end.cast("int").alias("b")), of)


def replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with ``spans`` (sorted, with start and end in code points) replaced by ``mark(span)``; overlapping ones together, by the mark of the first."""

    def of(x: Column) -> Column:
        found, blocks = x["s"], in_blocks(x["t"])

        def leaders(before: Column) -> Column:
            pairs = F.transform(found, lambda y, k: F.struct(y.alias("y"), F.get(before, k).alias("reach")))
            return F.filter(pairs, lambda p: p["y"]["start"] >= p["reach"])

        def joined(lead: Column, cut: Column, last: Column) -> Column:
            parts = F.transform(lead, lambda p: F.concat(piece(cut, p["reach"], p["y"]["start"]), mark(p["y"])))
            return F.concat(F.array_join(parts, ""), piece(cut, last, F.length(x["t"])))

        ends = F.transform(found, lambda y: y["end"])
        return let(F.struct(let(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), leaders).alias("lead"), blocks.alias("cut"), F.array_max(ends).alias("last")), lambda z: joined(z["lead"], z["cut"], z["last"]))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("t"), spans.alias("s")), of)).otherwise(text)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, per_bucket: int = 200_000, totals: dict[str, str] | None = None) -> DataFrame:
    """Adds ``rank``: gapless from 0 within ``group``, in a pseudo-random but repeatable order of ``order``.

    No group is sorted in one task: a hash of ``order`` deals its rows to buckets, a window numbers
    each bucket, and bucket counts (one row per bucket) give the offsets.  ``totals`` maps new
    columns to long columns whose exclusive running sum is wanted in the same order.
    ``df`` is read twice, so it should be a materialized table; group columns must not be null.
    """
    totals = totals or {}
    key = F.xxhash64(*[F.col(c) for c in order], F.lit(SEED))
    wide = df.withColumn("_k", key)
    n = df.count()
    buckets = max(1, -(-n // per_bucket))
    wide = wide.withColumn("_b", F.pmod(F.shiftrightunsigned("_k", 20), F.lit(buckets)))
    counts = wide.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{k}") for k, v in totals.items()])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in totals])
    within = Window.partitionBy(*group, "_b").orderBy("_k", *order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    local = wide.withColumn("_r", F.row_number().over(within) - 1)
    for k, v in totals.items():
        local = local.withColumn(f"_l_{k}", F.coalesce(F.sum(v).over(upto), F.lit(0)))
    out = local.join(offsets, [*group, "_b"]).withColumn(rank, (F.col("_o") + F.col("_r")).cast("long"))
    for k in totals:
        out = out.withColumn(k, (F.col(f"_o_{k}") + F.col(f"_l_{k}")).cast("long"))
    return out.drop("_k", "_b", "_o", "_r", *[f"_o_{k}" for k in totals], *[f"_l_{k}" for k in totals])
