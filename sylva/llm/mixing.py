"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 1, 2, 3, repeating.  They share the
words of the corpus by weight; a target stops at ``cap`` times its source's words
and the excess is shared again by weight, which is a water level: target = min(cap *
size, level * weight).  Every document of a source should then be taken
target/size times; the fraction of that is rounded by pivotal steps: two documents
trade word mass, one way or the other at random so that expectations hold, until
one of them is taken or left.  The words taken from a source are kept by every step and
the last document is decided by a draw, so they miss the target by less than one
document, and every document is taken target/size times on average, at every size.

The reduction tree: documents of a source are dealt to chunks of ``CHUNK`` by a
hash; each chunk leaves one undecided document, these are dealt to chunks again,
until one per source is left and is decided by a draw.  A source with a third of
all rows is thus many tasks, and each level shrinks 4096-fold.

Defined results: null or empty text has size 0 and is never short of words (taken
0); rows that agree in doc_id, source and text are one item: its copies are taken in whole
numbers and only one of them is left to the rounding;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import SEED, materialize, words_of

CHUNK = 4096
CAP = 3
WEIGHTS = (1, 2, 3)
ITEM = "source_no int, doc_id long, text_hash long, size long, copies_of long, whole long, p double, chunks int, draw long"


def source_table(sized: DataFrame) -> DataFrame:
    """(source, source_no, source_size, n): sources numbered in code-point order, null last, without sorting them in one task."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    dealt = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("o"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    numbered = dealt.withColumn("r", F.row_number().over(inside) - 1).join(offsets, "part")
    return numbered.select("source", (F.col("o") + F.col("r")).cast("int").alias("source_no"), "source_size", "n")


def targets(sources: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` and ``target``; only sums over sources come to the driver, once per round of resharing."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = materialize(sources.withColumn("weight", weight), "weighted")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        held, rest, n = table.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == stopped or not rest:
            break
        level, stopped = (total - (held or 0)) / rest, n
    return table.withColumn("target", F.least(F.col("source_size") * float(cap), F.lit(level) * F.col("weight")))


def trade(weight: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Pivotal steps over one chunk, in place; the index left undecided, or -1."""
    eps, held = 1e-9, -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] < eps or p[j] > 1 - eps:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = weight[held], weight[j]
        up = min((1 - p[held]) * a, p[j] * b)
        down = min(p[held] * a, (1 - p[j]) * b)
        mass = up if draws[j] * (up + down) < down else -down
        p[held] += mass / a
        p[j] -= mass / b
        for k in (held, j):
            if p[k] < eps or p[k] > 1 - eps:
                p[k] = round(p[k])
        open_ = [k for k in (held, j) if 0 < p[k] < 1]
        held = open_[0] if open_ else -1
    return held


def _round(level: int, seed: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # from long to short, so that neighbours are of like size and what stays undecided is short
        pdf = pdf.sort_values(["size", "draw", "doc_id", "text_hash"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        p = pdf["p"].to_numpy(copy=True)
        held = trade(pdf["size"].to_numpy(dtype=float), p, rng)
        if held >= 0 and pdf["chunks"].iloc[0] <= 1:  # the root of a source's tree: a draw decides
            p[held] = float(rng.random() < p[held])
        pdf["p"] = p
        return pdf

    return run


def take(docs: DataFrame, seed: int = SEED, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_no, doc_id, text_hash, size, copies_of, source_size, target, times): one row per item."""
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    items = materialize(sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("copies_of")), "items")
    weighed = items.select("source", (F.col("size") * F.col("copies_of")).alias("size"))
    plan = materialize(targets(source_table(weighed), cap, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = items.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source_no", "doc_id", "text_hash", "size", "copies_of",
        F.floor(rate * F.col("copies_of") + 1e-9).alias("whole"),
        F.when(F.col("size") > 0, F.greatest(rate * F.col("copies_of") - F.floor(rate * F.col("copies_of") + 1e-9), F.lit(0.0))).otherwise(0.0).alias("p"),
        F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"),
        F.xxhash64("doc_id", "text_hash", F.lit(seed)).alias("draw"),
    )
    most = plan.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(most, 2), CHUNK) - 1e-9))
    done, open_ = [], start
    for level in range(levels):
        chunk = F.pmod(F.xxhash64("draw", F.lit(level)), F.col("chunks")).cast("int")
        after = materialize(open_.withColumn("chunk", chunk).groupBy("source_no", "chunk").applyInPandas(_round(level, seed), ITEM + ", chunk int").drop("chunk"), f"level{level}")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(after.filter(~undecided))
        open_ = after.filter(undecided).withColumn("chunks", F.ceil(F.col("chunks") / CHUNK).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = (F.col("whole") + F.col("p").cast("int")).cast("long")
    return out.join(plan.select("source_no", "source", "source_size", "target"), "source_no").select("doc_id", "source", "text_hash", "size", "copies_of", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Of rows that agree in doc_id, source and text, which take a share of their copies together, the one
    of least content stands for all; its copies are unfolded a thousand at a time over many tasks.
    """
    got = take(docs, seed).filter("times > 0").select(F.col("doc_id").alias("__sylva_d"), F.col("source").alias("__sylva_s"), F.col("text_hash").alias("__sylva_h"), F.col("times").alias("__sylva_t"), F.col("copies_of").alias("__sylva_n"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col("doc_id").eqNullSafe(F.col("__sylva_d")) & F.col("source").eqNullSafe(F.col("__sylva_s")) & (F.col("__sylva_x") == F.col("__sylva_h"))
    joined = docs.withColumn("__sylva_x", F.xxhash64("text")).join(got.hint("shuffle_hash"), same)
    single = joined.filter("__sylva_n = 1").withColumn("__sylva_c", F.explode(F.sequence(F.lit(1), F.col("__sylva_t").cast("int")))).select(*cols)
    content = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    again = joined.filter("__sylva_n > 1").select(F.struct(*cols).alias("__sylva_r"), content.alias("__sylva_c"), "__sylva_d", "__sylva_s", "__sylva_h", "__sylva_t")
    one = again.groupBy("__sylva_d", "__sylva_s", "__sylva_h", "__sylva_t").agg(F.min_by("__sylva_r", "__sylva_c").alias("__sylva_r"))
    last = F.floor((F.col("__sylva_t") - 1) / 1000).cast("int")
    blocks = one.withColumn("__sylva_b", F.explode(F.sequence(F.lit(0), last))).repartition(F.col("__sylva_h"), F.col("__sylva_b"))
    size = F.least(F.lit(1000), F.col("__sylva_t") - 1000 * F.col("__sylva_b")).cast("int")
    more = blocks.withColumn("__sylva_c", F.explode(F.sequence(F.lit(1), size))).select("__sylva_r.*")
    return single.unionByName(more)


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op2: of an item's rows, the first ones take what does not divide."""
    rows = take(docs).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies_of").cast("int"))))
    times = F.floor(F.col("times") / F.col("copies_of")) + F.when(F.col("_c") <= F.pmod(F.col("times"), F.col("copies_of")), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), "source", times.cast("int").alias("times"))
