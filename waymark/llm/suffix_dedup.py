"""Operator 10, suffix-array dedup: bytes covered by a LENGTH-byte string that also starts earlier go.

One Burrows-Wheeler transform over a whole corpus can't be shared among machines, so the corpus
is first cut down, without loss, to small texts in which all equal windows meet:

1. Each window of LENGTH bytes points to one anchor, the GRAM-byte piece in it of least hash (the
   leftmost of equals). Equal windows hold equal anchors at equal places.
2. Anchors are dealt by hash, each with a hash of its context: all bytes that windows around it
   can reach. Within equal anchors, a context that also occurs earlier is covered by it whole; each
   task settles that among its own before it sends first occurrences on.
   What is left are first occurrences of differing contexts. Every window holds its anchor and
   half of what it reaches beyond it on one side or the other, so contexts whose halves (32-bit
   hashes) no other context of the anchor has are left out: the edges of repeats remain.
3. These contexts are dealt by anchor. Each task sorts the suffixes of its contexts, derives the
   Burrows-Wheeler transform, and extends all intervals backward breadth-first: level l finds
   every place where neighbouring suffixes share exactly l bytes, and the work stops at LENGTH.
   Suffixes that no level parted share a window; all but the earliest are covered.
   An anchor with more than HOT differing contexts (or occurrences, where a first count already
   tells it) goes another exact way, so that none gathers in one task: its windows, by hash, each
   keep the earliest start, aggregated map-side.
4. What is covered is merged by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import groups_for, join_checked, mixed, numbered, save, steps, tidy, utf8

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # a window begins at most so far before its anchor
#: An anchor with more differing contexts than this takes the way by window hashes.
HOT = 32_768
#: Hot anchors told to the tasks beforehand are so many at most.
HOT_LIST = 1_000_000
#: Bits of an anchor's hash and of its place that choose it; of equal ones the leftmost, whatever else a step holds.
PLACE_BITS = np.uint64(32)
#: Bytes of documents for a group of anchors, and of contexts for a group of suffixes.
ANCHOR_GROUP, SUFFIX_GROUP = 16 << 20, 1 << 20
#: Anchors that a task gathers before it sends them on.
GATHER = 1 << 19

_U = np.uint64


def _table() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


BYTE = _table()


def gram_values(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of data[i : i + gram] for each i; gram is a power of two."""
    value, size = BYTE[data], 1
    while size < gram:
        value = value[:-size] * _U(0x9E3779B97F4A7C15 + 2 * size) + value[size:]
        value ^= value >> _U(29)
        size *= 2
    return mixed(value)


def window_values(grams: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hash of the `length` bytes at each start, from the grams that tile them (the last may overlap)."""
    total = np.zeros(len(starts), np.uint64)
    for k in [*range(0, length - gram, gram), length - gram]:
        total = mixed(total * _U(0xD1342543DE82EF95) + grams[starts + k])
    return total


def anchor_places(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their rows, and the hash of the gram at every place."""
    n, reach = len(data), length - gram
    grams = gram_values(data, gram)
    bits = PLACE_BITS
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= reach + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n - length + 1], least[reach + 1 - size : reach + 1 - size + n - length + 1])
    places = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: n - length + 1] == row[length - 1 :]
    seen = np.zeros(n, bool)
    seen[places[inside]] = True
    at = np.flatnonzero(seen)
    return at, row[at], grams


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, place in the row, anchor hash, context hash and the hashes of both halves (32 bits each, 0: none) of every anchor."""
    none = np.zeros(0, np.int64)
    n, reach = len(data), length - gram
    if n < length:
        return none, none, *[none.astype(np.uint64)] * 3
    at, row, grams = anchor_places(data, offsets, length, gram)
    begin, end = offsets[row], offsets[row + 1]
    low, high = np.maximum(at - reach, begin), np.minimum(at + length, end)
    context = np.zeros(len(at), np.uint64)
    whole = (low == at - reach) & (high == at + length)
    context[whole] = window_values(grams, low[whole], reach + length, gram)
    for i in np.flatnonzero(~whole):  # only at both ends of a document
        piece = data[low[i] : high[i]].tobytes() + bytes([at[i] - low[i]])
        context[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")
    half = reach // 2
    sides = []
    for start, stop in ((at - half, at + gram), (at, at + gram + half)):
        side = np.zeros(len(at), np.uint64)
        there = (start >= begin) & (stop <= end)
        side[there] = window_values(grams, start[there], gram + half, gram) >> _U(32) | _U(1)
        sides.append(side)
    return row, at - begin, grams[at], context, sides[0] << _U(32) | sides[1]


# --- from documents to anchors, and from anchors to what is covered ------------

PACKED = "key long, kind int, doc binary, at binary, hash binary, context binary, halves binary"
#: Kinds of packed rows: covered as a whole; to compare by suffixes; by window hashes; and, before step 2, to be met by anchor.
COVERED, EDGE, HOT_EDGE, MEET = 0, 1, 2, 3


def _packed(key: np.ndarray, kind: int, doc: np.ndarray, at: np.ndarray, value: np.ndarray, context: np.ndarray, halves: np.ndarray) -> dict[str, list]:
    """A row for each key with the arrays' parts as bytes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1)) if len(key) else np.zeros(1, int)
    parts = [a[order] if len(a) else a for a in (doc.astype(np.int64), at.astype(np.int64), value, context, halves)]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return {
        "key": [int(key[a]) for a, _ in spans],
        "kind": [kind] * len(spans),
        **{name: [p[a:b].tobytes() for a, b in spans] for name, p in zip(("doc", "at", "hash", "context", "halves"), parts, strict=True)},
    }


def _record(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
    kinds = (("doc", np.int64), ("at", np.int64), ("hash", np.uint64), ("context", np.uint64), ("halves", np.uint64))
    return tuple(np.frombuffer(b"".join(group[name]), kind) for name, kind in kinds)


def _gathered(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, place, anchor hash, context and halves of about GATHER anchors at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    many = 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for low, high, data, offsets in steps(*utf8(batch.column(1))):
            row, *found = anchors(data, offsets, length, gram)
            held.append((ids[low:high][row], *found))
            many += len(row)
            if many >= GATHER:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, many = [], 0
    if many:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _first(doc: np.ndarray, at: np.ndarray, value: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor and context (as one hash), document and place, and which of the ordered are the first of their anchor and context."""
    both = mixed(value ^ mixed(context))
    rising = len(doc) < 2 or bool((doc[1:] >= doc[:-1]).all())  # places within a document rise anyway
    order = np.argsort(both, kind="stable") if rising else np.lexsort((at, doc, both))
    both = both[order]
    return order, np.append(True, both[1:] != both[:-1])[: len(order)]


def _send_anchors(groups: int, length: int, gram: int, hot: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, at, value, context, halves in _gathered(batches, length, gram):
            order, first = _first(doc, at, value, context)
            later, first = order[~first], order[first]
            is_hot = np.isin(value[first], hot)
            ways = ((MEET, first[~is_hot]), (COVERED, later), (HOT_EDGE, first[is_hot]))
            for kind, own in ways:
                if not len(own):
                    continue
                key = value[own] if kind == MEET else mixed(doc[own].view(np.uint64))
                more = [x[own] for x in (value, context, halves)]
                more = more if kind == MEET else [more[0][: len(own) * (kind == HOT_EDGE)], more[1][:0], more[2][:0]]
                yield _record(_packed((key % _U(groups)).astype(np.int64), kind, doc[own], at[own], *more))

    return send


def hot_anchors(docs: DataFrame, length: int, gram: int, hot: int) -> np.ndarray:
    """Anchors that more than `hot` times are seen beside something else by tasks that hold them twice at once, HOT_LIST at most.

    They only choose a way; the result is the same whatever they are. A neighbourhood of three grams stands for the context.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> pa.RecordBatch:
            value, around = (np.concatenate(x) for x in zip(*held, strict=True))
            _, one = np.unique(mixed(value ^ around), return_index=True)
            found, times = np.unique(value[one], return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], names=["anchor", "times"])

        for batch in batches:
            for _, _, data, offsets in steps(*utf8(batch.column(0))):
                if len(data) < length:
                    continue
                at, _, grams = anchor_places(data, offsets, length, gram)
                held.append((grams[at], grams[np.maximum(at - gram, 0)] ^ mixed(grams[np.minimum(at + gram, len(grams) - 1)])))
                many += len(at)
                if many >= GATHER:
                    yield flush()
                    held, many = [], 0
        if many:
            yield flush()

    counted = docs.select("t").mapInArrow(tidy(count), "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times"))
    return np.array([r["anchor"] for r in counted.where(F.col("times") > hot).orderBy(F.desc("times"), "anchor").limit(HOT_LIST).collect()], np.int64).view(np.uint64)


def _shared(anchor: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether another entry of the same anchor has the same half (0 is none)."""
    order = np.lexsort((half, anchor))
    a, h = anchor[order], half[order]
    same = (a[1:] == a[:-1]) & (h[1:] == h[:-1]) & (h[1:] > 0)
    out = np.zeros(len(anchor), bool)
    out[order] = np.append(False, same) | np.append(same, False)
    return out


def _meet_anchors(doc_groups: int, hot: int):
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        packed = _unpacked(group[group["kind"] == MEET])
        order = np.lexsort((packed[1], packed[0], packed[3], packed[2]))
        doc, at, value, context, halves = (x[order] for x in packed)
        new = np.append(True, value[1:] != value[:-1])[: len(value)]
        first = new.copy()
        first[1:] |= context[1:] != context[:-1]
        anchor = np.cumsum(new) - 1
        edge = np.zeros(len(doc), bool)
        edge[first] = _shared(anchor[first], halves[first] >> _U(32)) | _shared(anchor[first], halves[first] & _U(0xFFFFFFFF))
        edges_of = np.bincount(anchor[edge], minlength=int(new.sum()))[anchor]
        ways = [(COVERED, doc[~first], at[~first], value[:0])]
        ways += [(kind, doc[own], at[own], value[own]) for kind, own in ((EDGE, edge & (edges_of <= hot)), (HOT_EDGE, edge & (edges_of > hot)))]
        for kind in (COVERED, HOT_EDGE):  # what the senders settled
            d, a, v, *_ = _unpacked(group[group["kind"] == kind])
            ways.append((kind, d, a, v))
        out = []
        for kind, d, a, v in ways:
            key = (mixed(d.view(np.uint64)) % _U(doc_groups)).astype(np.int64)
            out.append(pd.DataFrame(_packed(key, kind, d, a, v, value[:0], value[:0])))
        return pd.concat(out)

    return meet


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [low, high), as maximal runs."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    return low[new], high[np.append(new[1:], True)]


def _by_document(reach: int, length: int):
    def gather(group: pd.DataFrame) -> pd.DataFrame:
        """For each document its covered runs (not yet cut at its end) and its edges."""
        rows: dict[int, list] = {}
        for kind in (COVERED, EDGE, HOT_EDGE):
            part = group[group["kind"] == kind]
            doc, at, value, *_ = _unpacked(part)
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            value = value[order] if kind else value
            edges = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1, append=doc[-1:] + 1)) if len(doc) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                row = rows.setdefault(int(doc[a]), [b"", b"", b"", b"", b""])
                if kind == COVERED:
                    low, high = merged(np.maximum(at[a:b] - reach, 0), at[a:b] + length)
                    row[0], row[1] = low.tobytes(), high.tobytes()
                else:
                    row[2] += at[a:b].astype(np.uint32).tobytes()
                    row[3] += (value[a:b] >> _U(32)).astype(np.uint32).tobytes()
                    row[4] += bytes([kind]) * (b - a)
        names = ["low", "high", "edge", "anchor", "how"]
        return pd.DataFrame({"n": list(rows), **{c: [r[i] for r in rows.values()] for i, c in enumerate(names)}}).astype({"n": "int64"})

    return gather


# --- suffixes of contexts --------------------------------------------------------


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of `text` (uint8; 0 ends a piece, pieces end in ends[i] for place i), pieces' ends in order."""
    n = len(text)
    places = np.arange(n)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << _U(8)) | np.where(places + k <= ends, padded[k : n + k], 0)
    longest, known = int((ends - places).max()) + 1, 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])).astype(np.uint64)
        if rank[order[-1]] == n - 1:
            return order
        if known >= longest:  # equal suffixes: by place, as if their ends grew
            return np.argsort((rank << _U(32)) | places.astype(np.uint64))
        beyond = np.minimum(places + known, n - 1)
        key = (rank << _U(32)) | np.where(places + known <= ends, rank[beyond] + _U(1), _U(0))
        known *= 2


def parted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix, in order, shares fewer than `length` bytes with the one before it.

    From the Burrows-Wheeler transform alone: between q and the last place before it of the same
    sign, a boundary of level l makes one of level l + 1 where q's sign, put in front, leads.
    Breadth-first by level, each boundary is found once, at its exact common prefix. Within a run
    of one sign, that last place is the neighbour, so only new boundaries are followed; for the
    first place of a run, boundaries are counted by run.
    """
    first = text[order]
    found = np.append(True, first[1:] != first[:-1]) | (first == 0)  # level 0
    before = text[order - 1]
    by_sign = np.argsort(before, kind="stable")
    leads = np.empty(len(text), np.int64)  # where the sign before, put in front, leads
    leads[by_sign] = np.arange(len(text))
    heads = np.append(True, before[1:] != before[:-1])
    run, starts = np.cumsum(heads) - 1, np.flatnonzero(heads)
    signs = before[starts]
    runs_by_sign = np.argsort(signs, kind="stable")
    last = np.full(len(starts), -1)
    same = signs[runs_by_sign[1:]] == signs[runs_by_sign[:-1]]
    last[runs_by_sign[1:][same]] = runs_by_sign[:-1][same]
    open_runs = np.flatnonzero((signs != 0) & (last >= 0) & ~found[leads[starts]])
    counts, new = np.zeros(len(starts), np.int64), np.flatnonzero(found)
    for _ in range(length - 1):
        counts += np.bincount(run[new], minlength=len(starts))
        so_far = np.append(0, np.cumsum(counts))
        hit = (so_far[open_runs] > so_far[last[open_runs] + 1]) | found[starts[open_runs]]
        within = new[~heads[new] & (before[new] != 0)]
        new = np.concatenate([leads[within], leads[starts[open_runs[hit]]]])
        new = new[~found[new]]
        if not len(new):
            break
        found[new] = True
        open_runs = open_runs[~hit]
    return found


def later_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of windows within the pieces that also start earlier.

    Piece i holds bytes of doc[i] from start[i] on.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8) + np.uint8(1)  # no UTF-8 text has byte 255
    closing = np.cumsum(sizes + 1) - 1
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    ends = closing[piece]
    order = suffix_order(text, ends)
    groups = np.cumsum(parted(text, order, length)) - 1
    usable = ends[order] - order >= length
    order, groups = order[usable], groups[usable]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, number = np.unique(doc, return_inverse=True)
    of = piece[order]
    at = start[of] + order - (closing[of] - sizes[of])
    value = (number[of].astype(np.int64) << 33) | at
    edges = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    least = np.minimum.reduceat(value, edges)
    later = np.unique(value[value > np.repeat(least, np.diff(np.append(edges, len(value))))])
    return names[later >> 33], later & ((1 << 33) - 1)


CONTEXTS = "key long, doc long, start long, body binary"


def _send_contexts(groups: int, reach: int, length: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out: list[tuple] = []
            for i, (n, edge, anchor, how) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                body = data[offsets[i] : offsets[i + 1]]
                chosen = np.frombuffer(how, np.uint8) == EDGE
                at, value = np.frombuffer(edge, np.uint32)[chosen], np.frombuffer(anchor, np.uint32)[chosen]
                for a, k in zip(at.tolist(), (value % groups).tolist(), strict=True):
                    low = max(a - reach, 0)
                    out.append((k, n, low, body[low : a + length].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True))], names=["key", "doc", "start", "body"])

    return send


RUNS = "n long, low binary, high binary"


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Windows, sorted by document and start, as runs for each document."""
    edges = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1, append=doc[-1:] + 1)) if len(doc) else np.zeros(1, int)
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        low, high = merged(start[a:b], start[a:b] + length)
        rows.append((int(doc[a]), low.tobytes(), high.tobytes()))
    return pd.DataFrame(rows, columns=["n", "low", "high"]).astype({"n": "int64"})


def _meet_contexts(length: int):
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _runs(*later_windows(group["body"].tolist(), group["doc"].to_numpy(), group["start"].to_numpy(), length), length)

    return meet


def _send_windows(reach: int, length: int, gram: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, (n, edge, how) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 4)), strict=True)):
                body = data[offsets[i] : offsets[i + 1]]
                at = np.frombuffer(edge, np.uint32)[np.frombuffer(how, np.uint8) == HOT_EDGE].astype(np.int64)
                starts = np.unique((at[:, None] - np.arange(reach + 1)[None]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(body) - length)]
                if len(starts):
                    values = window_values(gram_values(body, gram), starts, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(starts), n)), pa.array(starts)], names=["window", "n", "start"])

    return send


def _hot_runs(edges: DataFrame, reach: int, length: int, gram: int) -> DataFrame:
    """Runs of hot anchors' windows that also start earlier, by window hash; counts combine map-side, and AQE splits what is skewed."""
    windows = edges.mapInArrow(tidy(_send_windows(reach, length, gram)), "window long, n long, start long")
    firsts = windows.groupBy("window").agg(F.min(F.struct("n", "start")).alias("first"))
    later = windows.join(firsts, "window").where(F.struct("n", "start") > F.col("first"))

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        start = np.unique(group["start"].to_numpy())
        return _runs(np.full(len(start), group["n"].iloc[0]), start, length)

    return later.select("n", "start").groupBy("n").applyInPandas(tidy(runs), RUNS)


# --- the operator ------------------------------------------------------------------


OUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """For each document: key, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left, binary).

    Bytes are those of the text in UTF-8; matches never cross documents. Each byte in a string of
    `length` bytes that also starts earlier (smaller key, or same document and earlier start) is
    removed; strings are judged on the input. Null text counts as empty; texts shorter than
    `length` stay whole, and texts of any length are read whole. Equal keys are ordered by text; null
    keys come last; keys may be of any type. Of equal rows all but one are earlier strings again.
    Only key and text are read, so other columns cannot clash; no rows in, no rows out.
    """
    reach = length - gram
    docs = numbered(df.select(df[key].alias("k"), df[text].alias("t")), "n", "k", ["t"])
    total = docs.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)).alias("b")).first()["b"]
    groups = groups_for(total, ANCHOR_GROUP)
    often = hot_anchors(docs, length, gram, hot)
    sent = docs.select("n", "t").mapInArrow(tidy(_send_anchors(groups, length, gram, often)), PACKED)
    met = sent.groupBy("key").applyInPandas(tidy(_meet_anchors(groups, hot)), PACKED)
    known = save(met.groupBy("key").applyInPandas(tidy(_by_document(reach, length)), "n long, low binary, high binary, edge binary, anchor binary, how binary"))
    sizes = "octet_length(low) + octet_length(high) + octet_length(edge) + octet_length(anchor) + octet_length(how) + 40"
    edged = known.where("octet_length(how) > 0").select("n", "edge", "anchor", "how", F.lit(b"").alias("low"), F.lit(b"").alias("high"))
    edges = join_checked(docs.select("n", "t"), edged, "n", "inner", sizes).select("n", "t", "edge", "anchor", "how")
    count = edged.agg(F.coalesce(F.sum(F.octet_length("how").cast("long")), F.lit(0)).alias("c")).first()["c"]
    suffix_groups = groups_for(count * (reach + length), SUFFIX_GROUP)
    contexts = edges.mapInArrow(tidy(_send_contexts(suffix_groups, reach, length)), CONTEXTS)
    runs = contexts.groupBy("key").applyInPandas(tidy(_meet_contexts(length)), RUNS)
    if not edged.where(F.instr(F.hex("how"), f"{HOT_EDGE:02X}") > 0).isEmpty():
        runs = runs.unionByName(_hot_runs(edges, reach, length, gram))
    runs = runs.unionByName(known.where("octet_length(low) > 0").select("n", "low", "high"))
    covered = save(runs.groupBy("n").agg(F.collect_list(F.struct("low", "high")).alias("runs")).select("n", F.expr("reduce(runs, cast('' as binary), (a, x) -> concat(a, x.low))").alias("low"), F.expr("reduce(runs, cast('' as binary), (a, x) -> concat(a, x.high))").alias("high")))
    all_ = join_checked(docs, covered, "n", "left", "octet_length(low) + octet_length(high) + 40")
    kind = docs.schema["k"].dataType.simpleString()
    return all_.select("k", "t", "low", "high").mapInArrow(tidy(_cut), f"`{key}` {kind}, {OUT}")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 512):
            part = batch.slice(first, 512)
            data, offsets = utf8(part.column(1))
            out = []
            for i, (low, high) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                body = data[offsets[i] : offsets[i + 1]]
                if not low:
                    out.append((len(body), 0, 0, body.tobytes()))
                    continue
                a, b = merged(np.frombuffer(low, np.int64), np.minimum(np.frombuffer(high, np.int64), len(body)))
                change = np.zeros(len(body) + 1, np.int32)
                change[a] += 1
                change[b] -= 1
                out.append((len(body), int((b - a).sum()), len(a), body[np.cumsum(change[:-1]) == 0].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*out, strict=True))], names=["k", *(x.split()[0] for x in OUT.split(", "))])
