"""URL filter: suffix rules first, gradient-boosted trees on lexical features for the rest.

Rules (host suffix and path prefix) decide the urls they fit; the longest wins.  The
urls that rules decide are the labelled urls: boosted trees with logistic loss are
trained on a bounded sample of them (``SAMPLE`` rows, drawn by hash) and judge the
urls that no rule fits.  Features: lengths, depth, digit ratio, entropy, parameter
counts and statistics of host suffixes and first path segments (share of blocked among
all labelled urls, counted over the whole table, shrunk towards the overall share).

The trained trees are compiled into one SQL expression, so scoring is a projection.

Defined results: a null url or one without ``://`` has an empty host and path, meets
no rule and is judged on its features; with no labelled url of both kinds everything
undecided is allowed; repeated rows and null ids are judged alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import SEED, let, materialize

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "entropy", "n_params", "query_length", "n_hyphens", "has_fragment", "https", "suffix1_blocked", "suffix2_blocked", "segment_blocked", "place_blocked")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text like ``net/``."""
    found = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars):
        n = F.size(chars)
        parts = F.transform(F.array_distinct(chars), lambda c: let(F.size(F.filter(chars, lambda x: x == c)) / n, lambda p: p * F.log2(p)))
        return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)

    return let(F.split(text, ""), of)


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, both suffixes and every lexical feature."""
    u = F.coalesce(F.col(url), F.lit(""))
    a = pages.select("page_id", u.alias("u"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    return a.select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path")).alias("rule"),
        F.substring_index("host", ".", -1).alias("suffix1"), F.substring_index("host", ".", -2).alias("suffix2"),
        F.regexp_extract("path", "^/[^/]*/?", 0).alias("segment"), F.concat(F.substring_index("host", ".", -2), F.regexp_extract("path", "^/[^/]*/?", 0)).alias("place"),
        F.length("u").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"), F.size(F.split("host", "[.]")).cast("double").alias("host_labels"),
        (F.regexp_count("u", F.lit("[0-9]")) / F.greatest(F.length("u"), F.lit(1))).alias("digit_ratio"), F.regexp_count("host", F.lit("[0-9]")).cast("double").alias("host_digits"),
        entropy(F.col("u")).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"), F.length(query).cast("double").alias("query_length"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("n_hyphens"), F.contains("u", F.lit("#")).cast("double").alias("has_fragment"), F.startswith("u", F.lit("https:")).cast("double").alias("https"),
    )


def with_suffix_statistics(rows: DataFrame, shrink: float = 20.0) -> DataFrame:
    """Adds the shrunk share of blocked labelled urls per host suffix, over all rows; a labelled row's own label is left out of its share."""
    labelled = rows.filter("rule is not null").withColumn("y", verdict_of(F.col("rule")).eqNullSafe("block").cast("double"))
    share = labelled.agg(F.avg("y")).first()[0] or 0.0
    own = F.when(F.col("rule").isNotNull(), verdict_of(F.col("rule")).eqNullSafe("block").cast("double"))
    for s in ("suffix1", "suffix2", "segment", "place"):
        stats = labelled.groupBy(F.col(s).alias("_s")).agg(F.sum("y").alias("_y"), F.count("y").alias("_n"))
        others = (F.col("_y") - F.coalesce(own, F.lit(0.0)) + shrink * share) / (F.col("_n") - F.when(own.isNull(), 0).otherwise(1) + shrink)
        rows = rows.join(stats, F.col(s) == F.col("_s"), "left").withColumn(f"{s}_blocked", F.coalesce(others, F.lit(share))).drop("_s", "_y", "_n")
    return rows


def verdict_of(rule: Column, rules=RULES) -> Column:
    pairs = [x for v, h, p in rules for x in (F.lit(h + p), F.lit(v))]
    return F.element_at(F.create_map(*pairs), rule)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 1.0) -> tuple[float, list]:
    """Second-order boosting on feature histograms.  A tree is (feature, cut, left, right) or a leaf value; left: x <= cut."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start, score = float(np.log(share / (1 - share))), np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-rate * gs / (hs + l2))
        if not left or len(rows) < 20:
            return leaf, rows, [(rows, leaf)]
        best = (1e-6, -1, -1)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.bincount(binned[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
            hl = np.bincount(binned[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
            gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return leaf, rows, [(rows, leaf)]
        _, j, k = best
        go = binned[rows, j] <= k
        a, _, la = grow(rows[go], g, h, left - 1)
        b, _, lb = grow(rows[~go], g, h, left - 1)
        return (j, float(cuts[j][k]), a, b), rows, la + lb

    forest, everything = [], np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree, _, leaves = grow(everything, p - y, p * (1 - p), depth)
        for rows, value in leaves:
            score[rows] += value
        forest.append(tree)
    return start, forest


def compiled(model: tuple[float, list]) -> Column:
    """The log-odds of ``block`` as one expression over the feature columns."""

    def of(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        j, cut, a, b = tree
        return F.when(F.col(FEATURES[j]) <= cut, of(a)).otherwise(of(b))

    score = F.lit(model[0])
    for tree in model[1]:
        score = score + of(tree)
    return score


def sample(rows: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``bound`` different labelled urls, drawn by a hash of the url's id, host and path; repeated rows are one."""
    labelled = materialize(rows.filter("rule is not null").select("page_id", "host", "path", *FEATURES, verdict_of(F.col("rule")).alias("v")).distinct(), "labelled")
    n = labelled.count()
    if n > bound:
        labelled = labelled.filter(F.pmod(F.xxhash64("page_id", "host", "path", *FEATURES, F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    pdf = labelled.toPandas().sort_values(["page_id", *FEATURES])
    return pdf[list(FEATURES)].to_numpy(dtype=float), (pdf["v"] == "block").to_numpy(dtype=float)


def judge(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score`` (log-odds of block)."""
    rows = materialize(with_suffix_statistics(materialize(with_features(pages), "features")), "urls")
    x, y = sample(rows)
    score = compiled(fit(x, y)) if len(set(y)) == 2 else F.lit(-1.0)
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.withColumn("score", score).select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule")), learned).alias("verdict"), "score")


def digest(pages: DataFrame) -> DataFrame:
    """The result of query op7."""
    return judge(pages)
