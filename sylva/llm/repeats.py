"""Suffix-array dedup: maximal repeats from a common-prefix interval tree.

A byte goes when it lies in a string of ``LEAST`` bytes that also starts earlier
(smaller doc_id, or the same document further left).  A suffix array over all bytes
would need a row per byte, so suffixes are sampled so that nothing is missed:

1. Anchors.  Of the ``GRAM``-byte grams in any ``LEAST``-byte window the least by hash
   is an anchor, so equal windows have equal anchors at equal places.  About one byte
   in 35 starts an anchor.
2. Each sender deals its distinct grams by hash, with counts, as packed integers; a gram
   that occurs once cannot lie in a repeat.  The others return to their texts, which
   send each anchor's context, the bytes that a window through it can reach.  Equal contexts of one
   sender travel once; the later ones are repeats already.
3. Per gram, the contexts are sorted as suffixes from the anchor (an enhanced suffix
   array with common-prefix lengths).  A stack scan yields the common-prefix
   intervals; in each, left extensions are tested for diversity: members are split by
   their common left context, and every part in which left and right context make
   ``LEAST`` bytes is a maximal repeat through the anchor with all its occurrences.
   All but its earliest occurrence go.
4. A gram of more than ``HOT`` occurrences would be one large task.  Its windows are
   fingerprinted (64 bits) at the sender instead, which keeps the earliest of each and
   marks the rest; the earliest over all senders is an aggregate over fingerprints.
5. Spans return to the texts, are united and cut.

Texts travel compressed, ``UNIT`` bytes to a row, and are kept once in a scratch table.

Defined results: a null text is empty (nothing removed); a null id sorts last; rows
that share an id are not earlier than each other; texts shorter than ``LEAST`` bytes
keep everything; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.blobs import chunks, mix64, pack, text_units, unpack
from sylva.llm.common import materialize, shuffle_partitions

LEAST = 100
GRAM = 32
REACH = LEAST - GRAM
UNIT = 8 << 20
#: Contexts that are compared at once.
ANCHORS = 1 << 16
#: Occurrences from which on a gram's windows are compared by fingerprint instead of its contexts in one place.
HOT = 50_000
BITS = 48
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM``-byte gram of ``data``, by doubling."""
    h, size, factor = _TABLE[data], 1, 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * np.uint64(factor) + h[size:]
            factor, size = factor * factor & (1 << 64) - 1, 2 * size
    return mix64(h)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram fingerprint, owner, position) of every anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < LEAST:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    h = gram_hashes(data)
    shift = np.uint64(max(24, int(len(data)).bit_length()))
    low = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes wins
    span, width = low, 1
    while 2 * width <= REACH + 1:
        span, width = np.minimum(span[:-width], span[width:]), 2 * width
    rest = REACH + 1 - width
    span = np.minimum(span[:-rest], span[rest:]) if rest else span
    start = np.arange(len(span))
    owner = np.searchsorted(ends, start, side="right")
    at = span[start + LEAST <= ends[owner]] & ((np.uint64(1) << shift) - np.uint64(1))
    at = np.unique(at[np.flatnonzero(np.diff(at, prepend=np.uint64(1 << 63)))]).astype(np.int64)
    who = np.searchsorted(ends, at, side="right")
    return mix64(h[at]) >> np.uint64(64 - BITS), who.astype(np.uint32), (at - (ends[who] - np.array([len(t) for t in texts])[who])).astype(np.uint32)


def unit_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of any number of texts, a few megabytes at a time."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))]
    for a, b in chunks(texts):
        gram, who, at = anchors(texts[a:b])
        parts.append((gram, who + np.uint32(a), at))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _shrink(texts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def _texts(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    import zstandard

    whole, at, out = zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(lengths.sum()) or 1), 0, []
    for n in lengths:
        out.append(whole[at : at + int(n)])
        at += int(n)
    return out


def _send(buckets: int):
    """Per unit of text: its texts (bucket -1), and one row of anchor grams for each bucket: a gram once, with its count."""

    schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("blob", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = 0
        for batch in batches:
            for ids, known, texts in text_units(batch, UNIT):
                serial += 1
                unit = TaskContext.get().partitionId() << 24 | serial
                gram, count = np.unique(unit_anchors(texts)[0], return_counts=True)
                edges = np.searchsorted(gram, np.array([(k << BITS) // buckets for k in range(buckets + 1)], dtype=np.uint64))
                rows = [(-1, unit, pack(np.arange(len(texts), dtype=np.uint32), ids, known, np.array([len(t) for t in texts], np.int64)), _shrink(texts))]
                rows += [(k, unit, pack(gram[edges[k] : edges[k + 1]], count[edges[k] : edges[k + 1]].astype(np.uint32)), None) for k in range(buckets) if edges[k] < edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _frequent(pdf: pd.DataFrame, bound: int) -> pd.DataFrame:
    """Per bucket: grams that occur twice or more, and whether they are hot, back to the units that have them."""
    parts = [unpack(b) for b in pdf["blob"]]
    gram, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(gram, kind="stable")
    gram, n, source = gram[order], n[order].astype(np.int64), source[order]
    new = np.flatnonzero(np.diff(gram, prepend=gram[0] + np.uint64(1)))
    total = np.repeat(np.add.reduceat(n, new), np.diff(new, append=len(gram)))
    many = total > 1
    gram, source, hot = gram[many], source[many], (total[many] > bound).astype(np.uint8)
    order = np.argsort(source, kind="stable")
    edges, units, rows = np.searchsorted(source[order], np.arange(len(parts) + 1)), pdf["unit"].to_numpy(), []
    for k in range(len(parts)):
        o = order[edges[k] : edges[k + 1]]
        if len(o):
            rows.append((units[k], pack(gram[o], hot[o])))
    return pd.DataFrame(rows, columns=["unit", "blob"])


def window_hashes(text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bytes left of the anchor, fingerprint) of every window of ``LEAST`` bytes through the anchor of a context."""
    base, n = 0xD1342543DE82EF95, REACH + LEAST
    powers = [1]
    for _ in range(n):
        powers.append(powers[-1] * base & (1 << 64) - 1)
    inverse = pow(base, -1, 1 << 64)
    who, before, found = [], [], []
    with np.errstate(over="ignore"):
        for a in range(0, len(text), 10_000):
            some = text[a : a + 10_000]
            total = np.zeros((len(some), n + 1), np.uint64)
            np.cumsum(_TABLE[some] * np.array(powers[:-1], np.uint64), axis=1, out=total[:, 1:])
            for l in range(REACH + 1):
                ok = np.flatnonzero((left[a : a + 10_000] >= l) & (right[a : a + 10_000] >= LEAST - l))
                first = REACH - l
                h = (total[ok, first + LEAST] - total[ok, first]) * np.uint64(pow(inverse, first, 1 << 64))
                who.append(ok + a)
                before.append(np.full(len(ok), l))
                found.append(mix64(h))
    return np.concatenate(who), np.concatenate(before), np.concatenate(found)


def later_windows(mark: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows by fingerprint and place, each place once, and which of them have an earlier equal window."""
    order = np.lexsort((start, row, doc, mark))
    m, r, s = mark[order], row[order], start[order]
    order = order[np.concatenate([[True], (m[1:] != m[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])])[: len(m)]]
    m, d, r = mark[order], doc[order], row[order]
    new = np.diff(m, prepend=m[:1] + np.uint64(1)) != 0 if len(m) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    previous = np.concatenate([[False], (r[1:] == r[:-1]) & ~new[1:]]) if len(m) else np.zeros(0, bool)
    return order, ~new & ((d[lead] < d) | previous)


def _contexts(buckets: int, every: bool = False):
    """Per unit: the contexts of its frequent anchors by bucket, windows of hot ones by bucket (from ``buckets`` on), and spans that repeat within the unit (bucket -1).

    ``every`` sends equal contexts of the unit too.
    """

    def run(corpus: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(corpus) and len(back):
            unit = int(corpus["unit"].iloc[0])
            _, ids, known, lengths = unpack(corpus["blob"].iloc[0])
            texts = _texts(corpus["texts"].iloc[0], lengths)
            gram, who, at = unit_anchors(texts)  # again: that costs less than to keep and send places
            whole = np.frombuffer(b"\0" * REACH + b"".join(texts) + b"\0" * LEAST, np.uint8)
            del texts
            begin = np.cumsum(lengths) - lengths
            parts = [unpack(b) for b in back["blob"]]
            often, burns = (np.concatenate([p[k] for p in parts]) for k in range(2))
            order = np.argsort(often)
            often, burns = often[order], burns[order]
            spot = np.minimum(np.searchsorted(often, gram), len(often) - 1)
            there = often[spot] == gram
            gram, who, at, hot = gram[there], who[there], at[there], burns[spot[there]]
            doc = np.where(known, ids, np.iinfo(np.int64).max)
            order = np.lexsort((at, who, doc[who], gram))
            gram, who, at, hot = gram[order], who[order].astype(np.int64), at[order].astype(np.int64), hot[order] > 0
            left, right = np.minimum(at, REACH), np.minimum(lengths[who] - at, LEAST)
            spans, windows_of = [], []
            edges = np.searchsorted(gram, np.array([(k << BITS) // buckets for k in range(buckets + 1)], dtype=np.uint64))
            windows = np.lib.stride_tricks.sliding_window_view(whole, REACH + LEAST)
            place = np.arange(REACH + LEAST)
            def same(at_: np.ndarray):
                """Contexts of some anchors, and which of them have an equal one further left or in a smaller id (of equal ids only in the same row)."""
                text = windows[begin[who[at_]] + at[at_]].copy()
                text[(place < REACH - left[at_][:, None]) | (place >= REACH + right[at_][:, None])] = 0
                seen = np.hstack([gram[at_].astype(">u8").view(np.uint8).reshape(-1, 8), text, left[at_].astype(np.uint8)[:, None], right[at_].astype(np.uint8)[:, None]])
                _, first, back = np.unique(np.ascontiguousarray(seen).view(f"V{seen.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
                lead, w = at_[first[back]], who[at_]
                return text, (lead != at_) & ((doc[w] != doc[who[lead]]) | (w == who[lead])) & (not every)

            def mark_gone(at_: np.ndarray) -> None:
                spans.append((who[at_], (at - left)[at_], (at + right)[at_]))

            for k in range(buckets):
                s = np.arange(edges[k], edges[k + 1])
                while len(s) > ANCHORS:  # many anchors of few contexts, as in long runs of one character
                    blocks = [(part, same(part)[1]) for part in np.array_split(s, -(-len(s) // ANCHORS))]
                    for part, earlier in blocks:
                        mark_gone(part[earlier])
                    was, s = len(s), np.concatenate([part[~earlier] for part, earlier in blocks])
                    if 2 * len(s) > was:
                        break
                if not len(s):
                    continue
                text, earlier = same(s)
                mark_gone(s[earlier])
                kept, text = s[~earlier], text[~earlier]
                burning = np.flatnonzero(hot[kept])
                if len(burning):
                    of, before, mark = window_hashes(text[burning], left[kept][burning], right[kept][burning])
                    windows_of.append((mark, who[kept][burning][of], at[kept][burning][of] - before))
                cold = np.flatnonzero(~hot[kept])
                if not len(cold):
                    continue
                keep = kept[cold]
                w = who[keep]
                rows.append((k, unit, pack(gram[keep], w.astype(np.uint32), at[keep].astype(np.uint32), ids[w], known[w], left[keep].astype(np.uint8), right[keep].astype(np.uint8)), _shrink([text[cold].tobytes()])))
            if windows_of:
                mark, w, start = (np.concatenate(x) for x in zip(*windows_of, strict=True))
                order, gone = later_windows(mark, doc[w], w, start)
                spans.append((w[order[gone]], start[order[gone]], start[order[gone]] + LEAST))
                o = order[~gone]
                mark, w, start = mark[o], w[o], start[o]
                edges = np.searchsorted(mark, np.array([min((k << 64) // buckets, (1 << 64) - 1) for k in range(buckets)], dtype=np.uint64)).tolist() + [len(mark)]
                for k in range(buckets):
                    t = slice(edges[k], edges[k + 1])
                    if edges[k] < edges[k + 1]:
                        rows.append((buckets + k, unit, pack(mark[t], w[t].astype(np.uint32), start[t].astype(np.uint32), ids[w[t]], known[w[t]]), None))
            spans = [np.concatenate(x) for x in zip(*spans, strict=True)]
            if len(spans[0]):
                rows.append((-1, unit, pack(*[x.astype(np.uint32) for x in spans]), None))
        return pd.DataFrame(rows, columns=["bucket", "unit", "blob", "texts"])

    return run


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of bytes, at most ``most``."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, most)


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan of common-prefix lengths: (depth, parent's depth, first, last) of every interval, children first.

    ``lcp[k]`` belongs to entries k and k + 1.
    """
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*lcp, 0]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            above = max(depth, stack[-1][0] if stack else 0)
            yield d, above, first, k
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class Contexts:
    """The contexts of one bucket as an enhanced suffix array over anchors."""

    def __init__(self, gram, text, left, right, doc, row, at):
        # suffixes from the anchor, within a gram; the available lengths break ties
        key = np.hstack([gram.astype(">u8").view(np.uint8).reshape(-1, 8), text[:, REACH:], right[:, None]])
        order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").reshape(-1), kind="stable")
        self.gram, self.text, self.left, self.right, self.doc, self.row, self.at = (x[order] for x in (gram, text, left.astype(np.int64), right.astype(np.int64), doc, row, at))
        self.order = order
        self.back = np.ascontiguousarray(self.text[:, :REACH][:, ::-1])
        self.rank = np.empty(len(order), np.int64)
        by = np.lexsort((self.at, self.row, self.doc))
        self.rank[by] = np.arange(len(order))
        same = self.gram[1:] == self.gram[:-1]
        self.lcp = np.where(same, _common(self.text[1:, REACH:], self.text[:-1, REACH:], np.minimum(self.right[1:], self.right[:-1])), 0)

    def earlier(self, a, b):
        """Whether a is earlier than b."""
        return (self.doc[a] < self.doc[b]) | ((self.row[a] == self.row[b]) & (self.at[a] < self.at[b]))

    def _scan(self) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Maximal repeats of two neighbours as rows (first member, left, right), and those of more members.

        Most intervals have two members: how far those agree to the left is computed for all neighbours at once.
        """
        pairs, larger = [], []
        if len(self.gram):
            agree = _common(self.back[1:], self.back[:-1], np.minimum(self.left[1:], self.left[:-1]))
            start = np.flatnonzero(np.diff(self.gram, prepend=~self.gram[0]))
            size = np.diff(start, append=len(self.gram))
            two = start[size == 2]
            pairs = [np.stack([two, agree[two], self.lcp[two]], axis=1)]
            some, flat = [], agree.tolist()
            for first, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for depth, _, a, b in lcp_intervals(self.lcp[first : first + n - 1].tolist()):
                    if b - a == 1:
                        some.append((first + a, flat[first + a], depth))
                    else:
                        larger += self._extended(np.arange(first + a, first + b + 1), depth)
            if some:
                pairs.append(np.array(some))
        both = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        return both[both[:, 1] + both[:, 2] >= LEAST], larger

    def repeats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left, right, members) of maximal repeats of ``LEAST`` bytes or more, members earliest first.

        The members of a repeat are all its occurrences; left and right are its lengths around the anchor.
        """
        pairs, larger = self._scan()
        for i, l, r in pairs.tolist():
            yield l, r, np.array([i, i + 1] if self.rank[i] < self.rank[i + 1] else [i + 1, i])
        yield from larger

    def _extended(self, members: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """The maximal repeats of one interval: its members split by their common left context."""
        need = LEAST - depth
        if need > REACH:
            return
        back, left = self.back[members], self.left[members]
        if len(members) > 2:
            key = np.hstack([back, self.left[members].astype(np.uint8)[:, None]])
            o = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").reshape(-1), kind="stable")
            members, back, left = members[o], back[o], left[o]
        ext = _common(back[1:], back[:-1], np.minimum(left[1:], left[:-1]))
        for l, _, a, b in lcp_intervals((ext + 1).tolist()):  # + 1: that nothing is common is an interval too
            if l - 1 >= need:
                part = members[a : b + 1]
                yield l - 1, depth, part[np.argsort(self.rank[part])]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, start, end): every occurrence of a repeat but the earliest."""
        pairs, larger = self._scan()
        i, l, r = pairs.T
        lead = np.where(self.rank[i] < self.rank[i + 1], i, i + 1) if len(i) else i
        late = 2 * i + 1 - lead
        ok = self.earlier(lead, late)
        who, before, after = [late[ok]], [l[ok]], [r[ok]]
        for l, r, part in larger:
            late = self.earlier(part[0], part[1:])
            if not late.all():  # equal ids: only what is earlier in the same row counts
                for k in np.flatnonzero(~late):
                    late[k] = self.earlier(part[: k + 1], part[k + 1]).any()
            part = part[1:][late]
            who.append(part)
            before.append(np.full(len(part), l))
            after.append(np.full(len(part), r))
        who = np.concatenate(who)
        return self.order[who], self.at[who] - np.concatenate(before), self.at[who] + np.concatenate(after)


def _received(pdf: pd.DataFrame):
    """The contexts of a bucket whose gram is there twice, as an enhanced suffix array; with the sender of each."""
    import zstandard

    cols, texts = [], []
    for blob, text in zip(pdf["blob"], pdf["texts"], strict=True):
        cols.append(unpack(blob))
        n = len(cols[-1][0])
        texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, n * (REACH + LEAST))), np.uint8).reshape(n, REACH + LEAST))
    gram, who, at, ids, known, left, right = (np.concatenate([c[k] for c in cols]) for k in range(7))
    source = np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols])
    text = np.concatenate(texts)
    del cols, texts
    _, inverse, count = np.unique(gram, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    gram, who, at, ids, known, left, right, source, text = (x[some] for x in (gram, who, at, ids, known, left, right, source, text))
    doc = np.where(known == 1, ids, np.iinfo(np.int64).max)
    return Contexts(gram, text, left, right, doc, source.astype(np.int64) << 32 | who.astype(np.int64), at.astype(np.int64)), source, who


def _match(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per bucket of contexts or windows: repeat spans for their units; spans found at the sender pass."""
        if pdf["bucket"].iloc[0] < 0:
            return pdf[["unit", "blob"]]
        if pdf["bucket"].iloc[0] >= buckets:
            parts = [unpack(b) for b in pdf["blob"]]
            mark, who, at, ids, known = (np.concatenate([p[k] for p in parts]) for k in range(5))
            source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            at = at.astype(np.int64)
            order, gone = later_windows(mark, np.where(known == 1, ids, np.iinfo(np.int64).max), source.astype(np.int64) << 32 | who.astype(np.int64), at)
            member = order[gone]
            start, end = at[member], at[member] + LEAST
        else:
            contexts, source, who = _received(pdf)
            member, start, end = contexts.spans()
        order = np.lexsort((end, start, who[member], source[member]))
        member, start, end = member[order], start[order], end[order]
        units, rows = pdf["unit"].to_numpy(), []
        edges = np.searchsorted(source[member], np.arange(len(units) + 1))
        for k in range(len(units)):
            s = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                rows.append((units[k], pack(who[member[s]].astype(np.uint32), start[s].astype(np.uint32), end[s].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["unit", "blob"])

    return run


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    contexts, _, _ = _received(pdf)
    rows = []
    for l, r, part in contexts.repeats():
        rows.append((int(l + r), [{"doc_id": int(contexts.doc[k]), "start": int(contexts.at[k] - l)} for k in part]))
    return pd.DataFrame(rows, columns=["length", "occurrences"])


def united(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(with_text: bool):
    def run(corpus: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, unit in corpus.iterrows():
            _, ids, known, lengths = unpack(unit["blob"])
            texts = _texts(unit["texts"], lengths)
            spans: dict[int, list[tuple[int, int]]] = {}
            if len(back):
                parts = [unpack(b) for b in back["blob"]]
                who, start, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
                order = np.argsort(who, kind="stable")
                who, start, end = who[order], start[order], end[order]
                at, first, n = np.unique(who, return_index=True, return_counts=True)
                spans = {int(w): united(start[f : f + c], end[f : f + c]) for w, f, c in zip(at, first, n, strict=True)}
            for k, text in enumerate(texts):
                runs, kept, at = spans.get(k, []), [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                row = (int(ids[k]) if known[k] else None, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
        frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def _exchanged(docs: DataFrame, hot: int, every: bool) -> tuple[DataFrame, DataFrame, int]:
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    wide = "bucket int, unit long, blob binary, texts binary"
    sent = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_send(buckets), wide), "units")
    corpus = sent.filter("bucket < 0").select("unit", "blob", "texts")
    frequent = lambda pdf: _frequent(pdf, hot)
    back = sent.filter("bucket >= 0").select("bucket", "unit", "blob").groupBy("bucket").applyInPandas(frequent, "unit long, blob binary")
    return corpus, corpus.groupBy("unit").cogroup(back.groupBy("unit")).applyInPandas(_contexts(buckets, every), wide), buckets


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(length, occurrences): every maximal repeat around an anchor, within its reach, with all occurrences, earliest first.

    A repeat that runs over several anchors is there once for each.
    """
    _, contexts, _ = _exchanged(docs, 1 << 62, True)
    return contexts.filter("bucket >= 0").groupBy("bucket").applyInPandas(_groups, "length int, occurrences array<struct<doc_id:long,start:long>>")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: sizes, removed runs, the digest of what is kept and, on request, its bytes (``kept``)."""
    corpus, contexts, buckets = _exchanged(docs, HOT, False)
    deal = F.when(F.col("bucket") < 0, -1 - F.pmod(F.col("unit"), F.lit(buckets))).otherwise(F.col("bucket"))
    spans = contexts.withColumn("deal", deal).groupBy("deal").applyInPandas(_match(buckets), "unit long, blob binary")
    return corpus.groupBy("unit").cogroup(spans.groupBy("unit")).applyInPandas(_cut(with_text), RESULT + (", kept binary" if with_text else ""))


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op3."""
    return dedup(docs)
