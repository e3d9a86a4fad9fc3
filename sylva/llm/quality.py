"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``(name, column, low, high)``; a document passes when each
measured column lies within its bounds.  All measures are built-in expressions,
so the whole table is one projection without exchange and without user functions.

Defined results: a null or empty text has no words and fails ``words``; columns
other than ``text`` are carried unread, null or not; repeated rows are judged
alike; an empty table gives an empty table.  ``judge`` adds one column, ``q``, and
takes the place of an input column of that name; ``keep_good`` adds none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import let, words_of


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The thresholds.  Ratios are per word or per line that has a word.
RULES: tuple[Rule, ...] = (
    Rule("words", "n_words", low=50),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("alphabetic", "alpha_ratio", low=0.6),
)

#: Frequent function words of the four languages.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "a", "de", "la", "le", "et", "les", "des", "un", "en", "que", "el", "los", "y", "der", "die", "das", "und", "zu", "den", "von", "mit", "est", "du", "se", "del", "ein", "ist")

SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that is found twice or more.

    Windows are compared by hash first; those whose hash repeats are compared by their words.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        hashed = F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
        return let(hashed, lambda s: exact(w, twins(s, "h")))

    def twins(s: Column, field: str) -> Column:
        return F.filter(
            s, lambda x, j: F.coalesce(F.get(s, j - 1)[field] == x[field], F.lit(False)) | F.coalesce(F.get(s, j + 1)[field] == x[field], F.lit(False))
        )

    def exact(w: Column, some: Column) -> Column:
        named = F.sort_array(F.transform(some, lambda x: F.struct(F.concat_ws(" ", F.get(w, x["i"]), F.get(w, x["i"] + 1), F.get(w, x["i"] + 2)).alias("g"), x["i"].alias("i"))))
        return let(named, lambda s: F.size(F.array_distinct(F.flatten(F.transform(twins(s, "g"), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    return let(words, windows)


def measures(text: Column) -> Column:
    """One struct of all measures of a text."""
    whole = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.length(F.regexp_replace(whole, r"[^\p{L}]+", "")).cast("long").alias("n_alpha"),
        )
        return counts

    return let(words_of(text), of)


def with_ratios(m: Column) -> Column:
    """The counts of ``measures`` and the ratios that the rules bound, as one struct."""
    words = F.greatest(m["n_words"], F.lit(1))
    return F.struct(
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        (m["n_repeat_words"] / words).alias("repeat_ratio"),
        (m["word_chars"] / words).alias("mean_word"),
        (m["n_symbols"] / words).alias("symbol_ratio"),
        (m["n_stop"] / words).alias("stop_ratio"),
        (m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1))).alias("dup_line_ratio"),
        (m["n_alpha"] / F.greatest(m["word_chars"], F.lit(1))).alias("alpha_ratio"),
    )


def passes(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over a struct of measures."""
    good = F.lit(True)
    for r in rules:
        if r.low is not None:
            good = good & (q[r.measure] >= r.low)
        if r.high is not None:
            good = good & (q[r.measure] <= r.high)
    return good


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``q``: the measures, ``failed`` (names of broken rules) and ``kept``."""

    def verdict(q: Column) -> Column:
        failed = F.filter(F.array(*[F.when(~passes(q, (r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(q.alias("m"), failed.alias("failed"), passes(q, rules).alias("kept"))

    return docs.withColumn("q", let(let(measures(F.col(text)), with_ratios), verdict))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Only the documents that break no rule.  One filter whose measures are bound once, so nothing is measured per rule."""
    return docs.filter(let(let(measures(F.col(text)), with_ratios), lambda q: passes(q, rules)))


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op9."""
    m = F.col("q.m")
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return judge(docs).select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & F.col("q.kept")).alias("kept"),
        F.array_join("q.failed", ",").alias("failed_rules"),
    )
