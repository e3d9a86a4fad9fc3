"""Packing into fixed-length sequences by cutting-stock column generation.

A document (its token ids and an end id) is cut into whole sequences and one rest.
Short rests of one length are bundled; bundles and longer rests are grouped by length into
classes of ``GRAIN`` tokens.  The histogram by length and class, a few hundred counts, is
all the driver sees.  A linear program
over patterns (how many rests of each class share a sequence) is solved by column
generation: an unbounded-knapsack dynamic program prices columns against the duals.
The solution is rounded down, what is left is packed first-fit decreasing, and the
patterns are assigned to documents by rank: rests of a class are numbered by a
distributed rank and each pattern owns a range of ranks.

Tokens are made once; pieces carry their checksums, so no text is shuffled.

Defined results: a null or empty text is the end id alone; repeated rows are packed
once each; an empty table gives an empty table; other columns are not read; very
long texts are cut into as many whole sequences as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.blobs import slices
from sylva.llm.common import materialize, ranked

LENGTH = 2048
GRAIN = 8
#: Rests of at most ``SHORT`` tokens are bundled, those of one length together, to at most ``BUNDLE`` tokens.
SHORT, BUNDLE = 128, 256
#: How far from the least sum the linear program may end.
GAP = 1e-4
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
UNIT = 4 << 20
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str, special_strings: bool = True):
    """Text to ids, as ``tokenizers`` gives them for this byte-level file without added tokens at the ends.

    Ranks come from the file itself, since the byte-pair merges of ``tiktoken`` take a quarter of
    the time.  A string of one of the file's added tokens in a text is that token's id, or, without
    ``special_strings``, ordinary text.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    made = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return (lambda text: made.encode(text, allowed_special="all")) if special_strings else made.encode_ordinary


def _pieces(vocabulary: str, length: int, end_id: int, special_strings: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    cell = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "e" not in cell:
            cell["e"] = encoder(vocabulary, special_strings)
        encode = cell["e"]
        for batch in batches:
            for part in slices(batch, 1, UNIT):
                out = []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = encode(text)
                    ids.append(end_id)
                    raw, n = memoryview(np.array(ids, dtype="<u4").tobytes()), len(ids)
                    out += [(doc_id, a, min(length, n - a), zlib.crc32(raw[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, special_strings: bool = True) -> DataFrame:
    """Whole sequences and one rest per document, with checksums of their ids."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), length, end_id, special_strings), PIECE)


def _knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value, by a dynamic program over the room; ``sizes`` ascend."""
    at = np.flatnonzero(value > 0)
    size, val = sizes[at], value[at]
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), side="right").tolist()
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fits[c]:
            got = val[: fits[c]] + best[c - size[: fits[c]]]
            j = got.argmax()
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[at[pick[c]]] += 1
            c -= size[pick[c]]
    return float(best[room]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; demands are met exactly.  ``sizes`` ascend.

    Revised simplex on ``min sum x, A x = demand``; starts from one pattern per class.  Duals over
    the worth of the best pattern are feasible and bound the least sum from below, as the volume
    does; it ends within ``gap`` of that bound, however many columns this takes.
    """
    m = len(sizes)
    if not m:
        return []
    per = room // sizes
    basis = np.diag(per).astype(float)
    inverse, x, bound = np.diag(1.0 / per), demand / per, float(sizes @ demand) / room
    while True:
        worth, column = _knapsack(inverse.sum(axis=0), sizes, room)
        bound = max(bound, x.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-7 or x.sum() <= bound * (1 + gap):
            break
        d = inverse @ column
        ok = d > 1e-10
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / d[ok]
        r = int(ratio.argmin())
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        basis[:, r] = column
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
    times = np.floor(x + 1e-7).astype(int)
    left = demand.astype(int) - (basis @ times).round().astype(int)
    for k in np.flatnonzero((basis[left < 0] > 0).any(axis=0)):  # rounding noise only
        while times[k] > 0 and (left[basis[:, k] > 0] < 0).any():
            times[k] -= 1
            left += basis[:, k].round().astype(int)
    out = [(basis[:, k].round().astype(int), int(times[k])) for k in range(m) if times[k] > 0]
    return out + _first_fit(sizes, left, room)


def _first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing for the few rests that rounding leaves: less than one sequence per pattern."""
    left, out = left.copy(), []
    while left.sum():
        pattern, space = np.zeros(len(sizes), dtype=int), room
        for i in range(len(sizes) - 1, -1, -1):
            n = min(left[i], space // sizes[i])
            pattern[i] = n
            space -= n * sizes[i]
        times = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        left -= pattern * times
        out.append((pattern, times))
    return out


def bundles(histogram: dict[int, int], grain: int = GRAIN, short: int = SHORT, most: int = BUNDLE) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict[int, int]]:
    """Units of packing from a histogram by key (the length of a short rest, ``-class`` of a longer one).

    Gives per key (key, rests to a unit, full units, their class and first rank, the last unit's class and
    rank), and the number of units of every class.
    """
    demand: dict[int, int] = {}

    def units(cls: int, n: int) -> tuple[int, int]:
        demand[cls] = demand.get(cls, 0) + n
        return cls, demand[cls] - n

    out = []
    for key, n in sorted(histogram.items()):
        if key < 0:
            out.append((key, 1, n, *units(-key, n), 0, 0))
            continue
        per = most // key
        full, rest = divmod(n, per)
        whole = units(-(-per * key // grain), full) if full else (0, 0)
        out.append((key, per, full, *whole, *(units(-(-rest * key // grain), 1) if rest else (0, 0))))
    return out, demand


def pack(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``."""
    cut = materialize(cut, "pieces")
    cols = cut.columns
    whole = ranked(cut.filter(F.col("length") == length), [], cols, "sequence_id").select(*cols, "sequence_id", F.lit(0).cast("long").alias("offset"))
    key = F.when(F.col("length") <= min(SHORT, length // 2), F.col("length")).otherwise(-F.ceil(F.col("length") / grain)).cast("int")
    rests = materialize(cut.filter(F.col("length") < length).withColumn("key", key), "rests")
    histogram = {r[0]: r[1] for r in rests.groupBy("key").count().collect()}  # at most SHORT + length / grain rows
    n_whole = cut.filter(F.col("length") == length).count()
    units, demand = bundles(histogram, grain, most=min(BUNDLE, length))
    sizes = np.array(sorted(demand), dtype=int)
    slots, used, first = {int(s): [] for s in sizes}, np.zeros(len(sizes), dtype=int), n_whole
    for pattern, times in solve(sizes, np.array([demand[int(s)] for s in sizes], dtype=float), length // grain):
        at = 0
        for i in np.flatnonzero(pattern):
            slots[int(sizes[i])].append((int(used[i]), int(pattern[i]), first, at))
            used[i] += pattern[i] * times
            at += int(pattern[i])
        first += times
    spark = cut.sparkSession
    plan = spark.createDataFrame([(k, v) for k, v in slots.items()], "cls int, slots array<struct<from:long,per:long,first:long,at:long>>")
    table = spark.createDataFrame(units, "key int, per long, full long, cls1 int, first1 long, cls2 int, first2 long")
    unit = F.floor(F.col("r") / F.col("per"))
    spot = F.element_at("slots", F.size(F.filter("slots", lambda s: s["from"] <= F.col("u"))))
    named = ranked(rests, ["key"], cols, "r").join(F.broadcast(table), "key").select(  # a row a key, a row a class
        *cols,
        F.when(unit < F.col("full"), F.col("cls1")).otherwise(F.col("cls2")).alias("cls"),
        F.when(unit < F.col("full"), F.col("first1") + unit).otherwise(F.col("first2")).alias("u"),
        F.pmod(F.col("r"), F.col("per")).alias("in_unit"),
    )
    placed = named.join(F.broadcast(plan), "cls").withColumn("s", spot).select(
        *cols,
        (F.col("s.first") + F.floor((F.col("u") - F.col("s.from")) / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + F.pmod(F.col("u") - F.col("s.from"), F.col("s.per"))).alias("at"), "in_unit",
    )
    before = Window.partitionBy("sequence_id").orderBy("at", "in_unit").rowsBetween(Window.unboundedPreceding, -1)
    rest = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*cols, "sequence_id", "offset")
    return whole.unionByName(rest)


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op8."""
    return pack(pieces(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
