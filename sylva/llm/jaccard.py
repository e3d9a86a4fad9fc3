"""N-gram Jaccard self-join by a size-aware heavy-light scheme.

A document's set is its distinct word shingles (fingerprints of 48 bits).  Two sets
link when ``100 * intersection >= 80 * union``.  The join is exact on fingerprints:

1. Documents with the same set are one class.  Senders drop equal sets before they send.
2. Every sender deals its distinct shingles by hash, with counts, as packed integers.  A
   shingle of a single class cannot be in any intersection and is dropped; the others
   return to their documents with their counts.  A set of which fewer than 80 % is
   shared has no partner and is finished.
3. Light sets (of at most ``x`` shingles) enumerate the subsets of the fixed sizes that
   a partner must share; heavy sets, and light ones near the boundary, put the tokens of their prefix
   (rarest first) into inverted lists.  ``x`` is the size at which subsets below it and
   list entries above it cost least in total.
4. Sets that share a key and are of compatible size form candidate families.  Each
   bucket of keys keeps a star per family, not its pairs.
5. Families are verified exactly.  A task holds one block, or one pair of blocks, of a
   family; a pair already connected there is not compared again.  Verified links are
   stars, and their components are the answer.

Hot keys: equal sets collapse to one class; a sender joins its own sets of one key and
sends one row for them, so a list is as long as there are senders at most; and a family beyond ``BLOCK`` sets is compared in pairs of blocks over many tasks.

Defined results: null or blank text has an empty set, no links and its own id as
component; repeated rows and equal ids are linked to themselves only by their sets;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.blobs import chunks, mix64, pack, text_units, unpack
from sylva.llm.common import materialize, shuffle_partitions
from sylva.llm.components import components, stars

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
BITS = 48
UNIT = 8 << 20
BLOCK = 1000
#: Keys that a sender holds at once.
KEYS = 1 << 20
#: What making one subset costs, in list entries.
SUBSET = 4.0

_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_PLACES = mix64(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection at which sets of sizes a and b link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of ``data``: a polynomial over a random byte table, by prefix sums."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        powers = np.full(len(data) + 1, np.uint64(_BASE))
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * powers[:-1], dtype=np.uint64, out=total[1:])
        inverse = np.full(len(data) + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)
    return start, mix64(h)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, fingerprint) of the distinct shingles of some texts, sorted by owner and fingerprint."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, w = word_hashes(data)
    owner = np.searchsorted(ends, start, side="right").astype(np.uint64)
    if not len(w):
        return owner, w
    n_words = np.bincount(owner.astype(np.int64), minlength=len(texts))
    keys = []
    with np.errstate(over="ignore"):
        if len(w) >= WORDS:
            h = sum((w[k : len(w) - WORDS + 1 + k] * _PLACES[k] for k in range(1, WORDS)), w[: len(w) - WORDS + 1] * _PLACES[0])
            inside = owner[: len(w) - WORDS + 1] == owner[WORDS - 1 :]
            keys.append(owner[: len(w) - WORDS + 1][inside] << np.uint64(BITS) | mix64(h[inside]) >> np.uint64(64 - BITS))
        first = np.cumsum(n_words) - n_words
        for k in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
            h = np.array([sum(int(w[first[k] + j]) * int(_PLACES[j]) for j in range(n_words[k])) + int(n_words[k]) & (1 << 64) - 1], dtype=np.uint64)
            keys.append(np.uint64(k) << np.uint64(BITS) | mix64(h) >> np.uint64(64 - BITS))
    both = np.unique(np.concatenate(keys))
    return both >> np.uint64(BITS), both & np.uint64((1 << BITS) - 1)


def _send(buckets: int):
    """Per unit of text: one row for each bucket of shingles, and one with the unit's documents (bucket below 0)."""
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("extra", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = 0
        for whole in batches:
            for ids, known, texts in text_units(whole, UNIT):
                n = len(texts)
                size, cls = np.zeros(n, np.int64), np.zeros(n, np.uint64)
                tokens, owners = [], []
                for a, b in chunks(texts):
                    who, token = shingle_sets(texts[a:b])
                    at, first, counts = np.unique(who, return_index=True, return_counts=True)
                    if len(at):
                        at = at.astype(np.int64) + a
                        size[at] = counts
                        with np.errstate(over="ignore"):
                            cls[at] = mix64(np.add.reduceat(mix64(token + np.uint64(7)), first) + counts.astype(np.uint64))
                    tokens.append(token)
                    owners.append(who.astype(np.uint32) + np.uint32(a))
                token, owner = np.concatenate(tokens), np.concatenate(owners)
                del tokens, owners, texts
                _, rep = np.unique(cls, return_index=True)
                chosen = np.zeros(n, bool)
                chosen[rep] = True
                keep = chosen[owner]
                token, owner = token[keep], owner[keep]
                order = np.argsort(token, kind="stable")
                token, owner = token[order], owner[order]
                # a shingle of several documents here is sent once, with its count; its other owners wait with the documents
                new = np.diff(token, prepend=~token[:1]) != 0
                first = np.flatnonzero(new)
                extra, count = pack(token[~new], owner[~new]), np.diff(first, append=len(token)).astype(np.uint32)
                token, owner = token[first], owner[first]
                serial += 1
                batch, names, blobs = TaskContext.get().partitionId() << 24 | serial, [], []
                edges = np.searchsorted(token, np.array([(k << BITS) // buckets for k in range(buckets + 1)], dtype=np.uint64))
                for k in range(buckets):
                    if edges[k] < edges[k + 1]:
                        names.append(k)
                        blobs.append(pack(token[edges[k] : edges[k + 1]], owner[edges[k] : edges[k + 1]], count[edges[k] : edges[k + 1]]))
                names.append(-1 - batch % buckets)
                blobs.append(pack(np.arange(n, dtype=np.uint32), ids, known, size, cls, chosen.astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([batch] * len(names), pa.int64()), pa.array(blobs, pa.binary()), pa.array([None] * (len(names) - 1) + [extra], pa.binary())], schema=schema)

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket of shingles: those of two classes or more go back to their batches with their counts; document rows pass."""
    if pdf["bucket"].iloc[0] < 0:
        return pd.DataFrame({"batch": pdf["batch"], "docs": True, "blob": pdf["blob"], "extra": pdf["extra"]})
    parts = [unpack(b) for b in pdf["blob"]]
    token, owner, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    source = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p[0]) for p in parts])
    del parts
    order = np.argsort(token, kind="stable")
    token, owner, source, n = token[order], owner[order], source[order], n[order].astype(np.int64)
    new = np.flatnonzero(np.diff(token, prepend=token[0] + np.uint64(1)))
    count = np.repeat(np.add.reduceat(n, new), np.diff(new, append=len(token)))
    many = count > 1
    token, owner, source, count = token[many], owner[many], source[many], np.minimum(count[many], (1 << 32) - 1).astype(np.uint32)
    order = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[order], np.arange(len(pdf) + 1))
    batches, rows = pdf["batch"].to_numpy(), []
    for k in range(len(pdf)):
        o = order[edges[k] : edges[k + 1]]
        if len(o):
            rows.append((batches[k], False, pack(token[o], owner[o], count[o]), None))
    return pd.DataFrame(rows, columns=["batch", "docs", "blob", "extra"])


def _documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per batch: every document with its class; for a class that may have partners, its shared shingles, rarest first."""
    out = []
    _, ids, known, size, cls, chosen = unpack(pdf[pdf["docs"]]["blob"].iloc[0])
    parts = [unpack(b) for b in pdf[~pdf["docs"]]["blob"]]
    tokens: list = [None] * len(ids)
    if parts:
        token, owner, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
        more, whose = unpack(pdf[pdf["docs"]]["extra"].iloc[0])
        order = np.argsort(token)
        token, owner, count = token[order], owner[order], count[order]
        token, owner, count = np.concatenate([token, more]), np.concatenate([owner, whose]), np.concatenate([count, count[np.searchsorted(token, more)]])
        order = np.lexsort((token, count, owner))
        token, owner, count = token[order], owner[order], count[order]
        at, first, n = np.unique(owner, return_index=True, return_counts=True)
        for k, a, m in zip(at, first, n, strict=True):
            if chosen[k] and m * DENOMINATOR >= NUMERATOR * size[k]:
                tokens[k] = (token[a : a + m].tobytes(), float(count[a : a + m].mean()))
    for k in range(len(ids)):
        blob, mean = tokens[k] or (None, None)
        out.append((int(ids[k]) if known[k] else None, int(size[k]), int(cls[k].view(np.int64)), blob, mean))
    frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "cls", "tokens", "mean_list"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def prefix_length(size: int) -> int:
    """Of two linked sets in one order of tokens, the prefixes of this length meet."""
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def subset_sizes(size: int, largest: int) -> list[int]:
    """The overlaps that a partner of at most ``largest`` can need."""
    partners = range(-(-NUMERATOR * size // DENOMINATOR), min(largest, size * DENOMINATOR // NUMERATOR) + 1)
    return sorted({c for b in partners if (c := least_overlap(size, b)) <= min(size, b)})


def subsets(size: int) -> int:
    """How many subsets a light set of ``size`` enumerates."""
    return sum(comb(size, c) for c in subset_sizes(size, size * DENOMINATOR // NUMERATOR))


def worth_trying(longest: float) -> int:
    """The largest size at which subsets could cost no more than lists of ``longest`` entries: their number grows faster than any list."""
    size = 1
    while SUBSET * subsets(size + 1) <= prefix_length(size + 1) * longest:
        size += 1
    return size


def light_boundary(costs: list[tuple[int, int, float]]) -> int:
    """From (size, sets, mean list length): the boundary of least total cost, subsets up to it and list entries beyond it."""
    best, least, cost = 0, 0.0, 0.0
    for size, n, mean in sorted(costs):
        cost += n * (SUBSET * subsets(size) - prefix_length(size) * max(mean, 1.0))
        if cost < least:
            best, least = size, cost
    return best


def runs_of(key: np.ndarray, cls: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Sorts size intervals by key and size and joins those of one key whose sizes are compatible.

    Gives the sorted arrays, the edges between neighbours of a run and the first entry of each run.
    """
    order = np.lexsort((cls, high, low, key))
    key, cls, low, high = key[order], cls[order], low[order], high[order]
    if not len(key):
        return key, cls, low, high, np.zeros(0, bool), np.zeros(0, np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(high + group * (1 << 32)) - group * (1 << 32)  # the running maximum within a key
    link = ~new[1:] & (reach[:-1] * DENOMINATOR >= low[1:] * NUMERATOR)
    return key, cls, low, high, link, np.flatnonzero(np.concatenate([[True], ~link]))


def _keys(largest: int, buckets: int):
    """Keys of sets as rows (bucket, key, cls, low, high): one per key and run of sizes of a sender; and the sender's own edges (cls, other)."""
    columns = ["k", "key", "cls", "low", "high", "other"]

    def rows(keys: list[np.ndarray], cls: list[int], sizes: list[int]) -> Iterator[pd.DataFrame]:
        n = [len(k) for k in keys]
        size = np.repeat(np.array(sizes, np.int64), n)
        key, cls_, low, high, link, first = runs_of(np.concatenate(keys).view(np.int64), np.repeat(np.array(cls, np.int64), n), size, size)
        star = stars(cls_[:-1][link], cls_[1:][link])
        out = pd.DataFrame({"key": key[first], "cls": cls_[first], "low": low[first], "high": np.maximum.reduceat(high, first) if len(first) else high, "other": 0})
        out["k"] = (mix64(out["key"].to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        yield out[columns]
        yield pd.DataFrame({"k": -1 - star["a"] % buckets, "key": 0, "cls": star["a"], "low": 0, "high": 0, "other": star["b"]})[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = -(-NUMERATOR * (largest + 1) // DENOMINATOR)
        for pdf in batches:
            keys, cls, sizes, n = [], [], [], 0
            for c, size, blob in zip(pdf["cls"], pdf["n_shingles"], pdf["tokens"], strict=True):
                token, own = np.frombuffer(blob, np.uint64), [np.zeros(0, np.uint64)]
                if size > largest or size >= near:
                    own.append(token[: max(0, prefix_length(size) - (size - len(token)))])
                if size <= largest:
                    some = sorted(int(t) for t in token)
                    chosen = [hash((k, *s)) & (1 << 63) - 1 for k in subset_sizes(size, largest) for s in combinations(some, k)]
                    own.append(mix64(np.array(chosen, dtype=np.uint64)) | np.uint64(1 << 63))
                keys.append(np.concatenate(own))
                cls.append(c)
                sizes.append(size)
                n += len(keys[-1])
                if n > KEYS:
                    yield from rows(keys, cls, sizes)
                    keys, cls, sizes, n = [], [], [], 0
            if keys:
                yield from rows(keys, cls, sizes)

    return run


def _families(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket of keys: runs of one key and compatible sizes are joined; edges of the senders pass."""
    if pdf["k"].iloc[0] < 0:
        return stars(pdf["cls"].to_numpy(), pdf["other"].to_numpy())
    _, cls, _, _, link, _ = runs_of(*(pdf[c].to_numpy() for c in ("key", "cls", "low", "high")))
    return stars(cls[:-1][link], cls[1:][link])


def verified(cls: np.ndarray, size: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly the sets of one family (or block pair) that are connected by true links."""
    m = len(cls)
    which, inv, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    often = count[inv] > 1
    inv, owner = inv[often], owner[often]
    order = np.lexsort((inv, count[inv], owner))
    inv, owner = inv[order], owner[order]
    edges = np.searchsorted(owner, np.arange(m + 1))
    sets = [inv[edges[k] : edges[k + 1]] for k in range(m)]
    prefix = [s[: max(0, prefix_length(int(size[k])) - (int(size[k]) - len(s)))] for k, s in enumerate(sets)]
    by_size = np.argsort(size, kind="stable")
    place = np.empty(m, np.int64)
    place[by_size] = np.arange(m)
    tok = np.concatenate(prefix)
    who = np.repeat(np.arange(m), [len(p) for p in prefix])
    order = np.lexsort((place[who], tok))
    tok, who = tok[order], who[order]
    lists = np.searchsorted(tok, np.arange(len(which) + 1))
    label, mark, links = np.arange(m), np.zeros(len(which), bool), []
    for i in by_size:
        if not len(prefix[i]):
            continue
        found = np.concatenate([who[lists[t] : lists[t + 1]] for t in prefix[i]])
        found = found[(place[found] < place[i]) & (size[found] * DENOMINATOR >= size[i] * NUMERATOR) & (label[found] != label[i])]
        if not len(found):
            continue
        found, meet = np.unique(found, return_counts=True)
        mark[sets[i]] = True
        for j in found[np.argsort(-meet, kind="stable")]:
            if label[i] != label[j] and int(mark[sets[j]].sum()) >= least_overlap(int(size[i]), int(size[j])):
                links.append((int(cls[i]), int(cls[j])))
                label[label == label[i]] = label[j]
        mark[sets[i]] = False
    return links


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    links = []
    for _, some in pdf.groupby(["family", "x", "y"], sort=False):
        if len(some) > 1:
            links += verified(some["cls"].to_numpy(), some["n_shingles"].to_numpy(), [np.frombuffer(b, np.uint64) for b in some["tokens"]])
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def join(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id) for every row of ``docs``; ``cls`` is equal for equal sets."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = 2 * parts
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_send(buckets), "bucket int, batch long, blob binary, extra binary")
    back = sent.groupBy("bucket").applyInPandas(_shared, "batch long, docs boolean, blob binary, extra binary")
    rows = materialize(back.groupBy("batch").applyInPandas(_documents, "doc_id long, n_shingles long, cls long, tokens binary, mean_list double"), "documents")

    open_ = rows.filter("tokens is not null")
    longest = open_.agg(F.max("mean_list")).first()[0] or 0.0
    costs = open_.filter(F.col("n_shingles") <= worth_trying(longest)).groupBy("n_shingles").agg(F.count(F.lit(1)), F.avg("mean_list")).collect()  # a row a size, some dozens at most
    largest = light_boundary([tuple(r) for r in costs])
    sets = materialize(open_.dropDuplicates(["cls"]).select("cls", "n_shingles", "tokens"), "sets")
    keys = sets.repartition(parts, "cls").mapInPandas(_keys(largest, buckets), "k long, key long, cls long, low long, high long, other long")
    near = keys.groupBy("k").applyInPandas(_families, "a long, b long")
    family = components(near)

    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = family.join(sizes, "root").select(F.col("node").alias("cls"), F.col("root").alias("family"), blocks.alias("nb")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("cls", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    work = sets.join(pairs, "cls")
    links = work.groupBy(F.pmod(F.xxhash64("family", "x", "y"), F.lit(buckets)).alias("k")).applyInPandas(_verify, "a long, b long")
    linked = components(materialize(links, "links"))

    classes = rows.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    joined = classes.join(linked, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    joined = materialize(joined, "classes")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    named = joined.join(least, "root").select(F.col("cls").alias("c"), "least")
    linked_rows = rows.filter("n_shingles > 0").join(named, F.col("cls") == F.col("c")).select("doc_id", "n_shingles", "cls", F.col("least").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of least id (nulls last, equal ids by hash of the text); of rows equal in id and text one.

    Ids may be null or shared by different texts, so rows are told apart by id and text.
    """
    key, cols = F.xxhash64("doc_id", "text", F.isnull("doc_id"), F.isnull("text")), docs.columns
    groups = join(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("k"), "component_id").distinct()
    ids = docs.select(key.alias("k2"), F.col("doc_id").cast("long").alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("k"))
    first = groups.join(ids, F.col("k") == F.col("k2")).groupBy("component_id").agg(F.min_by("k", order).alias("__sylva_f")).select("__sylva_f")
    # collapsed by each sender before the shuffle, so that a row that is repeated often gathers nowhere
    content = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    whole = docs.select(key.alias("__sylva_k"), content.alias("__sylva_c"), F.struct(*[f"`{c}`" for c in cols]).alias("__sylva_r"))
    one = whole.groupBy("__sylva_k").agg(F.min_by("__sylva_r", "__sylva_c").alias("__sylva_r"))
    return one.join(first.hint("shuffle_hash"), F.col("__sylva_k") == F.col("__sylva_f")).select("__sylva_r.*")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op5."""
    return join(docs).select("doc_id", "n_shingles", "component_id")
