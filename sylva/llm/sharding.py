"""Sharding by a hypergeometric communication matrix (law ``rows``).

A uniform shuffle with exact shard sizes, in four steps: (1) shard sizes are fixed,
at most one row apart; (2) for every input partition the numbers of its rows that go
to each shard are drawn from the multivariate hypergeometric law given what the
shards still lack, so the matrix is distributed exactly as under a uniform
permutation of all rows; (3) rows are permuted within their partition and dealt by
the matrix, exchanged, and (4) permuted again within their shard, which gives slots.

Only DataFrame functions touch rows.  The driver sees one count per input partition
and returns one short array per partition.  Slots are numbered in hash buckets with
offsets, so no shard is sorted in one task.

Defined results: null text has size 1 and checksum 0; null ids and repeated rows
take slots like any others; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import SEED, materialize, ranked

SHARDS = 8


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; inversion outwards from the mode, so about sqrt(n) steps."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low

    def logc(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    here = math.exp(logc(good, mode) + logc(bad, n - mode) - logc(good + bad, n))
    u = rng.random() - here
    if u < 0:
        return mode
    left = right = mode
    below = above = here
    while left > low or right < high:
        if right < high:
            above *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= above
            if u < 0:
                return right
        if left > low:
            below *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= below
            if u < 0:
                return left
    return mode


def matrix(counts: list[int], shards: int = SHARDS, seed: int = SEED) -> list[list[int]]:
    """Row p: how many rows of partition p go to each shard.  Columns sum to the shard sizes."""
    rng, total = random.Random(seed), sum(counts)
    lack = [total // shards + (k < total % shards) for k in range(shards)]
    out = []
    for c in counts:
        row, n, rest = [], c, sum(lack)
        for k in range(shards):
            rest -= lack[k]
            got = hypergeometric(rng, lack[k], rest, n)
            row.append(got)
            n -= got
        lack = [a - b for a, b in zip(lack, row, strict=True)]
        out.append(row)
    return out


def assign(rows: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` to a narrow table.  ``key`` columns, with the row's place, seed the permutations."""
    placed = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())  # one row per input partition
    spark = rows.sparkSession
    cells = [(p, [sum(row[: k + 1]) for k in range(shards)]) for (p, _), row in zip(counts, matrix([n for _, n in counts], shards, seed), strict=True)]
    plan = spark.createDataFrame(cells, "_part int, _upto array<long>")
    first = Window.partitionBy("_part").orderBy(F.xxhash64(*key, F.lit(seed)), "_at")
    dealt = placed.withColumn("_r", F.row_number().over(first) - 1).join(plan, "_part")
    dealt = dealt.withColumn("shard", F.size(F.filter("_upto", lambda x: x <= F.col("_r")))).drop("_upto", "_r", "_part")
    return ranked(materialize(dealt, "dealt"), ["shard"], [*key, "_at"], "slot").drop("_at")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op6."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    return assign(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
