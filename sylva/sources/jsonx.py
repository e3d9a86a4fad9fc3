"""The JSON isomorph: ``[{"~": name, attribute: value, ..}, child, ..]`` to node rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.sources.options import ShredOptions
from sylva.sources.shred import COMMENT, ERROR, NODE_FIELDS, NODES, PI, TEXT, ShredError, Shredder, node_batch

#: Reserved node names, and prefixes of reserved keys.
RESERVED = ("#text", "#cdata", "#pi", "#document", "#comment", "#entref")
KEY_PREFIXES = ("!", "#")


def node_name(node) -> str:
    """The name of a JSON node; scalars are text."""
    if not isinstance(node, list):
        return "#text"
    if not node or not isinstance(node[0], dict) or not isinstance(node[0].get("~"), str):
        raise ShredError("a node is an array that starts with an object with the key ~", kind="json")
    return node[0]["~"]


def _scalar(v) -> str:
    return "true" if v is True else "false" if v is False else "" if v is None else v if isinstance(v, str) else json.dumps(v)


def check(node, deep: bool = True) -> None:
    """Raises for what is not a node."""
    name = node_name(node)
    if name == "#text" and not isinstance(node, list):
        if isinstance(node, dict):
            raise ShredError("an object is no node", kind="json")
        return
    if any(isinstance(v, (list, dict)) for v in node[0].values()):
        raise ShredError("attribute values are scalars", kind="json")
    if deep:
        for c in node[1:]:
            check(c)


class JsonShredder(Shredder):
    def shred(self, text: str) -> dict[str, list]:
        try:
            top = json.loads(text)
        except json.JSONDecodeError as e:
            raise ShredError(f"malformed JSON: {e.msg}", e.pos, "json") from None
        super().shred("<x/>")  # fresh state
        self.rows = []
        self.stack[0].total = self.stack[0].elems = 0
        self.roots, self.text = 0, []
        check(top)
        if node_name(top) == "#document":
            for c in top[1:]:
                if node_name(c) not in ("#comment", "#pi", "#text"):
                    self._node(c)
        else:
            self._node(top)
        self._flush()
        return self._columns()

    def _node(self, node) -> None:
        name = node_name(node)
        inner = "".join(_scalar(c) for c in node[1:] if not isinstance(c, list)) if isinstance(node, list) else _scalar(node)
        if name == "#text":
            self.text.append(inner)
        elif name == "#cdata":
            self._flush()
            self._emit(TEXT, "#text", inner, in_cdata=True)
        elif name == "#comment":
            self._leaf(COMMENT, inner, 0)
        elif name == "#pi":
            self._leaf(PI, inner, 0, _scalar(node[0].get("target", node[0].get("!target", node[0].get("#target", "pi")))))
        elif name == "#entref":
            self.text.append("&" + inner + ";")
        else:
            pairs = [(k, _scalar(v)) for k, v in node[0].items() if k != "~" and k[:1] not in KEY_PREFIXES]
            self._start(name, [(k, v.replace("&", "&amp;").replace("<", "&lt;").replace("\n", "&#10;").replace("\t", "&#9;").replace("\r", "&#13;")) for k, v in pairs], False, 0)
            for c in node[1:]:
                self._node(c)
            self._end(name, 0)


def _batches(options: ShredOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = JsonShredder(options)
        for batch in batches:
            cols, ids = {n: [] for n, _ in NODE_FIELDS}, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    got = shredder.shred(text)
                except (ShredError, RecursionError) as e:
                    if options.on_error == "failfast":
                        raise
                    got = {n: [None] for n, _ in NODE_FIELDS} | {"node_type": [ERROR], "name": [getattr(e, "kind", "json")], "data": [str(e)], "pre": [getattr(e, "offset", 0)], "last": [1], "attrs": [[]], "path": [[]], "anc": [[]]}
                for n in cols:
                    cols[n] += got[n]
                ids += [doc_id] * len(got["pre"])
            yield node_batch(cols, ids)

    return run


def shred_json(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: ShredOptions | None = None) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_batches(options or ShredOptions()), NODES)
