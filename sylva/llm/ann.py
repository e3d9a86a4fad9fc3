"""Approximate nearest neighbours over robust-pruned directed graphs.

Vectors are dealt to shards by a hash of their id.  A shard's graph is built by insertion
in growing batches: a greedy beam search from the entry point proposes neighbours, relaxed
distance pruning keeps the diverse ones (a candidate is dropped when a kept neighbour is
``ALPHA`` times closer to it than the node is), and reverse edges are pruned the same way.
Queries are searched in every shard with a beam; the best of all shards are merged.

Shard size.  Every query visits every shard, so with shards of one size the work would
grow with the square of the table.  Shards hold as many vectors as there are queries
(``SHARD`` at least, ``SHARD_BYTES`` at most): searching a shard then costs about what building it
costs, and both stay in proportion to the table.  The beam grows with the cube root of the shard.

Numbers.  Graphs are built and searched on float32 copies that are centred and scaled by
shard, so vectors of any finite size have finite distances; the scores that are returned
and compared are computed in double precision on the original vectors.

Equal vectors are one node with all their ids, so a vector that a third of all rows
hold neither crowds the graph nor loses ties.

Defined results: rows whose vector is null, empty, zero or holds null or non-finite
components, or whose id is null, take no part; vectors of different length never
compare; a row is never its own neighbour, but rows that repeat its id, with the same vector
or another, are candidates like any others, and each of them is a query of its own; with
fewer than k candidates all are returned; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import materialize, shuffle_partitions

SHARD, SHARD_BYTES, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, QUERY_BLOCK = 2000, 256 << 20, 28, 56, 80, 1.2, 500
INDEX = "dim int, shard int, n int, kind string, vectors binary, graph binary, ids binary, starts binary"


def beam_search(v: np.ndarray, norm: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``beam`` nearest nodes met (index, squared distance), nearest first; -1 where there are fewer."""
    m, n = len(q), len(v)
    own = np.einsum("ij,ij->i", q, q)
    ids = np.full((m, beam), -1)
    far = np.full((m, beam), np.inf, np.float32)
    ids[:, 0] = entry
    far[:, 0] = own - 2 * (q @ v[entry]) + norm[entry]
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    rows = np.arange(m)
    while len(rows):
        open_ = ~done[rows] & (ids[rows] >= 0)
        some = open_.any(axis=1)
        rows, open_ = rows[some], open_[some]
        if not len(rows):
            break
        turn = np.cumsum(open_, axis=1)
        pick = open_ & (turn <= width)
        done[rows] |= pick
        r, c = np.nonzero(pick)
        near = graph[ids[rows[r], c]]
        who, near = np.repeat(r, near.shape[1]), near.reshape(-1)
        fresh = near >= 0
        who, near = who[fresh], near[fresh]
        key = np.sort(who * n + near)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        who, near = key // n, key % n
        fresh = ~seen[rows[who], near]
        who, near = who[fresh], near[fresh]
        seen[rows[who], near] = True
        d = own[rows[who]] - 2 * np.einsum("ij,ij->i", q[rows[who]], v[near]) + norm[near]
        count = np.bincount(who, minlength=len(rows))
        wide = int(count.max()) if len(count) else 0
        if not wide:
            continue
        place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        new_ids, new_far = np.full((len(rows), wide), -1), np.full((len(rows), wide), np.inf, np.float32)
        new_ids[who, place], new_far[who, place] = near, d
        all_ids, all_far = np.hstack([ids[rows], new_ids]), np.hstack([far[rows], new_far])
        all_done = np.hstack([done[rows], np.zeros((len(rows), wide), bool)])
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[rows], far[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_far, all_done))
    return ids, far


def robust_prune(v: np.ndarray, norm: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of ``nodes`` out of ``cand`` (rows padded with -1), by relaxed distance pruning."""
    bad = (cand < 0) | (cand == nodes[:, None])
    safe = np.where(bad, 0, cand)
    x = v[safe]
    to = norm[nodes][:, None] - 2 * np.einsum("ijk,ik->ij", x, v[nodes]) + norm[safe]
    to[bad] = np.inf
    order = np.argsort(to, axis=1, kind="stable")
    safe, to, x = np.take_along_axis(safe, order, 1), np.take_along_axis(to, order, 1), np.take_along_axis(x, order[:, :, None], 1)
    twin = np.zeros_like(bad)
    out = np.full((len(nodes), degree), -1)
    alive = np.isfinite(to) & ~twin
    between = norm[safe][:, :, None] + norm[safe][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = safe[some, first[some]]
        drop = alpha * alpha * between[rows, first] <= np.maximum(to, 0)
        same = safe == safe[rows, first][:, None]
        alive &= ~((drop | same) & some[:, None])
    return out


def build_graph(v: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours padded with -1, entry point)."""
    n = len(v)
    norm = np.einsum("ij,ij->i", v, v)
    graph = np.full((n, degree), -1)
    entry = int((((v - v.mean(axis=0)) ** 2).sum(axis=1)).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        found, _ = beam_search(v, norm, graph, entry, v[new], beam)
        graph[new] = robust_prune(v, norm, new, found, degree, alpha)
        a, b = np.repeat(new, degree), graph[new].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        by = np.lexsort((a, b))
        a, b = a[by], b[by]
        who, first, count = np.unique(b, return_index=True, return_counts=True)
        wide = int(count.max()) if len(count) else 0
        back = np.full((len(who), wide), -1)
        back[np.repeat(np.arange(len(who)), count), np.arange(len(b)) - np.repeat(first, count)] = a
        used = (graph[who] >= 0).sum(axis=1)
        room = used + count <= degree
        for k in np.flatnonzero(room):
            graph[who[k], used[k] : used[k] + count[k]] = back[k, : count[k]]
        full = np.flatnonzero(~room)
        for part in np.array_split(full, max(1, len(full) * (degree + wide) ** 2 // 4_000_000)):
            if len(part):
                graph[who[part]] = robust_prune(v, norm, who[part], np.hstack([graph[who[part]], back[part]]), degree, alpha)
        at += size
        size = min(2 * size, 128)
    return graph, entry


def normal(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and scale of a shard."""
    size = float(np.abs(v).max())
    centre = (v / size).mean(axis=0) * size
    return centre, float(np.abs(v / size - centre / size).max()) * size or size


def scaled(v: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    """float32 copies; a vector that is very far off is drawn in along its line, which keeps the order of what is near to it."""
    with np.errstate(over="ignore"):
        x = v / scale - centre / scale
        far = np.minimum(1.0, 1e12 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300))
        return np.ascontiguousarray((x * far).astype(np.float32))


def _build(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    v = np.stack(pdf["embedding"].to_numpy())
    _, first, inverse = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
    nodes = np.ascontiguousarray(v[first])
    order = np.argsort(inverse, kind="stable")
    ids = pdf["vec_id"].to_numpy(np.int64)[order]
    starts = np.searchsorted(inverse[order], np.arange(len(nodes) + 1)).astype(np.int64)
    wide = nodes.astype(np.float64)
    graph, entry = build_graph(scaled(wide, *normal(wide))) if len(nodes) > 1 else (np.full((1, 1), -1), 0)
    head = np.full((1, graph.shape[1]), entry)
    row = (int(key[0]), int(key[1]), len(nodes), v.dtype.str, nodes.tobytes(), np.vstack([head, graph]).astype(np.int32).tobytes(), ids.tobytes(), starts.tobytes())
    return pd.DataFrame([row], columns=["dim", "shard", "n", "kind", "vectors", "graph", "ids", "starts"])


def _search(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                v = np.frombuffer(row.vectors, np.dtype(row.kind)).reshape(row.n, row.dim).astype(np.float64)
                graph = np.frombuffer(row.graph, np.int32).reshape(row.n + 1, -1)
                ids, starts = np.frombuffer(row.ids, np.int64), np.frombuffer(row.starts, np.int64)
                own = np.array([q["vec_id"] for q in row.queries], np.int64)
                q = np.stack([np.asarray(q["embedding"]) for q in row.queries]).astype(np.float64)
                frame = normal(v)
                near = scaled(v, *frame)
                width = min(round(beam * max(1.0, row.n / SHARD) ** (1 / 3)), row.n)
                found, _ = beam_search(near, np.einsum("ij,ij->i", near, near), graph[1:], int(graph[0, 0]), scaled(q, *frame), width)
                out = []
                for i in range(len(own)):
                    some = found[i][found[i] >= 0]
                    exact = np.sqrt(((v[some] - q[i]) ** 2).sum(axis=1))
                    got, limit, itself = [], np.inf, True
                    for j in np.argsort(exact, kind="stable"):
                        node, d = some[j], exact[j]
                        if d > limit:
                            break
                        held = ids[starts[node] : starts[node + 1]]
                        if itself and not d:  # the query's own row, once
                            at = np.flatnonzero(held == own[i])[:1]
                            itself, held = not len(at), np.delete(held, at)
                        got += [(float(d), int(x)) for x in held[:k]]
                        if len(got) >= k:
                            limit = sorted(got)[k - 1][0]
                    out += [(int(own[i]), row.queries[i]["q"], x, d) for d, x in sorted(got)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & nonzero).withColumn("dim", F.size("embedding"))


def build_index(vectors: DataFrame, asked: int = 0) -> DataFrame:
    """One row per shard: its vectors, graph and ids.  ``vectors`` as from ``usable``; ``asked`` queries are expected."""
    most = F.greatest(F.lit(SHARD), F.least(F.lit(asked), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim") + 4 * DEGREE + 16))))
    counts = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    dealt = vectors.join(F.broadcast(counts), "dim") if counts.count() <= 1000 else vectors.join(counts, "dim")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInPandas(_build, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries``.  Every query block meets every shard of its dimension once."""
    named = queries.groupBy("vec_id", "dim", "embedding").agg(F.count(F.lit(1)).alias("rows")).withColumn("q", F.xxhash64("vec_id", "embedding"))
    named = materialize(named, "asked")
    blocks = max(1, -(-named.count() // QUERY_BLOCK))
    asked = named.groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "q", "embedding")).alias("queries"))
    places = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.join(places, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last", "block").repartition(max(shuffle_partitions(index.sparkSession), 8), "dim", "shard")
    pairs = index.join(asked, ["dim", "shard"])
    found = pairs.mapInPandas(_search(k, beam), "query_id long, q long, vec_id long, score double")
    best = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    again = named.filter("rows > 1").select(F.col("vec_id").alias("v2"), F.col("q").alias("q2"), F.explode(F.sequence(F.lit(2), F.col("rows"))))
    more = ranks.join(again, (F.col("query_id") == F.col("v2")) & (F.col("q") == F.col("q2")))
    return ranks.select("query_id", "rank", "vec_id", "score").unionByName(more.select("query_id", "rank", "vec_id", "score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The result of query op10: the rows whose id is divisible by 100 against all rows."""
    rows = usable(embeddings)
    queries = rows.filter("vec_id % 100 = 0")
    index = materialize(build_index(rows, queries.count()), "index")
    return search(index, queries)
