"""Structured Streaming: documents as they arrive, event-time windows, one growing document.

Shredding is stateless per document, so a stream of documents is a stream of nodes.  A
document that arrives in pieces keeps its stack of open tags as state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sylva.sources.options import ShredOptions
from sylva.sources.shred import QNAME, shred

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", options: ShredOptions | None = None, per_trigger: int = 16) -> DataFrame:
    """Nodes of the documents in Parquet files as they appear."""
    return shred(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder), options=options)


def write_forest(nodes: DataFrame, path: str, checkpoint: str):
    """A sink that is idempotent per batch: each batch replaces its own partition."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return nodes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


_TAG = re.compile(rf"<(/?)({QNAME})([^<>]*?)(/?)>")


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, stack, count = state.get if state.exists else ("", "", 0)
    open_ = stack.split("/") if stack else []
    for pdf in batches:
        for piece in pdf.sort_values("seq")["piece"]:
            rest += piece
            done = 0
            for m in _TAG.finditer(rest):
                done = m.end()
                if m[1]:
                    if open_ and open_[-1] == m[2]:
                        open_.pop()
                elif not m[4]:
                    open_.append(m[2])
                    count += 1
                else:
                    count += 1
            cut = rest.rfind("<", done)
            rest = rest[cut:] if cut >= 0 else ""
    state.update((rest, "/".join(open_), count))
    yield pd.DataFrame([(key[0], count, "/".join(open_))], columns=["doc_id", "elements", "open_path"])


def open_tags(pieces: DataFrame) -> DataFrame:
    """(doc_id, elements, open_path) of documents that arrive in pieces (doc_id, seq, piece), as far as they have come."""
    return pieces.groupBy("doc_id").applyInPandasWithState(_advance, "doc_id long, elements int, open_path string", "rest string, stack string, n int", "update", GroupStateTimeout.NoTimeout)
