"""Overlapping markup as intervals of text.

``spans`` reads markup whose elements need not nest: ``<-x>`` suspends and ``<+x>``
resumes an element, end tags may come in any order.  An element is one or more
intervals of the text content, and questions of overlap are interval joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.sources.shred import QNAME

SPANS = "doc_id long, span int, name string, part int, start int, end int, error string"
_TAG = re.compile(rf"<(/|-|\+)?({QNAME})((?:\s+[^<>]*)?)(/?)>")


def parse_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(span, name, part, start, end) with offsets in the text without tags; raises ValueError."""
    open_: list[dict] = []
    out, at, done, n = [], 0, 0, 0

    def close(e: dict, k: int) -> None:
        out.append((e["id"], e["name"], e["part"], e["start"], k))
        e["part"], e["start"] = e["part"] + 1, None

    for m in _TAG.finditer(text):
        at += m.start() - done
        done = m.end()
        mark, name = m[1], m[2]
        live = [e for e in open_ if e["name"] == name]
        if mark is None:
            e = {"id": n, "name": name, "part": 0, "start": at}
            n += 1
            open_.append(e)
            if m[4]:
                close(e, at)
                open_.remove(e)
        elif not live:
            raise ValueError(f"{name} is not open")
        elif mark == "/":
            if live[-1]["start"] is not None:
                close(live[-1], at)
            open_.remove(live[-1])
        elif mark == "-":
            if live[-1]["start"] is None:
                raise ValueError(f"{name} is suspended already")
            close(live[-1], at)
        else:
            if live[-1]["start"] is not None:
                raise ValueError(f"{name} is not suspended")
            live[-1]["start"] = at
    if open_:
        raise ValueError(f"{open_[-1]['name']} is not closed")
    return sorted(out)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            try:
                rows += [(d, *x, None) for x in parse_spans(t or "")]
            except ValueError as e:
                rows.append((d, None, None, None, None, None, str(e)))
        frame = pd.DataFrame(rows, columns=["doc_id", "span", "name", "part", "start", "end", "error"])
        yield frame.astype({c: "Int32" for c in ("span", "part", "start", "end")})


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(_batches, SPANS)


def overlapping(a: DataFrame, b: DataFrame, proper: bool = False, grain: int = 4096) -> DataFrame:
    """(doc_id, a_span, b_span, start, end) of intervals that meet; ``proper``: neither contains the other.

    Intervals are dealt to grains of text, so a long document is not one group; a pair that
    shares several grains is found in the grain where the overlap starts.
    """
    side = lambda df, p: df.filter("error is null and end > start").select("doc_id", F.col("span").alias(f"{p}_span"), F.col("start").alias(f"{p}_s"), F.col("end").alias(f"{p}_e"), F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor((F.col("end") - 1) / grain))).alias("grain"))
    both = side(a, "a").join(side(b, "b"), ["doc_id", "grain"]).filter("a_s < b_e and b_s < a_e")
    start, end = F.greatest("a_s", "b_s"), F.least("a_e", "b_e")
    both = both.filter(F.floor(start / grain) == F.col("grain"))
    if proper:
        both = both.filter("(a_s < b_s and a_e < b_e) or (b_s < a_s and b_e < a_e)")
    return both.select("doc_id", "a_span", "b_span", start.alias("start"), end.alias("end"))


def of_nodes(forest: DataFrame) -> DataFrame:
    """Elements of a node table as spans of their document's text content."""
    from sylva.operators.positions import text_offsets

    texts = text_offsets(forest).select("doc_id", F.explode("anc").alias("span"), "start", "end")
    ends = texts.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ends.join(forest.select("doc_id", F.col("pre").alias("span"), "name"), ["doc_id", "span"]).select("doc_id", "span", "name", F.lit(0).alias("part"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(None).cast("string").alias("error"))
