"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import ann, jaccard, mixing, packing, pii, quality, repeats, secrets, sharding, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_repeats, op4_secrets, op5_ngram_join, op6_sharding, op7_url_filter, op8_packing, op9_quality, op10_neighbours)}
ORACLE_SQL: dict[str, str] = {}

_SPACE = r"\x20\x09-\x0D"
_NAMES = "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL["op9_quality"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains({list(quality.STOP_WORDS)!r}, lower(rtrim(x, '.,;:!?'))))) AS n_stop, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_alpha
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), f AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'words' END,
    CASE WHEN n_repeat_words / greatest(n_words, 1) > 0.5 THEN 'repeated_words' END,
    CASE WHEN word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 15.0 THEN 'word_length' END,
    CASE WHEN n_symbols / greatest(n_words, 1) > 0.3 THEN 'symbols' END,
    CASE WHEN n_stop / greatest(n_words, 1) < 0.02 THEN 'stop_words' END,
    CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'repeated_lines' END,
    CASE WHEN n_alpha / greatest(word_chars, 1) < 0.6 THEN 'alphabetic' END], lambda x: x IS NOT NULL) AS failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules
FROM f"""

ORACLE_SQL["op5_ngram_join"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_NAMES.upper()}', '{_NAMES}'), '[^{_SPACE}]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.root FROM reach JOIN e ON reach.node = e.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.root AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id"""


def _secret_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule with their offsets: the gaps between matches give the starts."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs, string_split_regex(t, '{quoted}') AS gs FROM d WHERE regexp_matches(t, '{quoted}'))))
  WHERE length(v) >= {least}"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = rf"""({"|".join(_either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = " UNION ALL ".join((
    _secret_kind(1, "assign", _ASSIGN, 2, 6), _secret_kind(2, "access", "AKIA[A-Z0-9]+", 0, 20), _secret_kind(3, "hex", "[0-9a-f]+", 0, 24),
    _secret_kind(4, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), _secret_kind(5, "jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
))

ORACLE_SQL["op4_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_KINDS}), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (rank <= 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""
