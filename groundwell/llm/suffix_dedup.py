"""Removal of repeated byte strings of a fixed length, exact over the whole corpus, by a suffix sort.

A difference-cover sort of all byte suffixes of a corpus moves some tens of bytes for each byte of
text and level. So the suffixes are first dealt by content, such that equal strings of ``length``
bytes meet in one part, and each part is sorted in memory (``difference_cover``: sampled triples,
recursion on their names, merge of the remaining suffixes); then adjacent prefixes are compared,
byte by byte.

1. Every start of a string has an anchor: the place of the smallest hash of ``GRAM`` bytes among the
   ``REACH`` places from it. It depends on the string's own bytes, so equal strings have anchors at
   equal offsets, and equal ``length - REACH + 1`` bytes from there: the right context, by which
   starts are dealt. About one place in 65 is an anchor; no row is made for a single start.
2. Anchors whose right context occurs once are dropped. Equal contexts (all bytes of the strings that
   share the anchor) are one context; all starts of a context that occurs twice repeat.
3. The distinct contexts of each right context are sorted together, and starts whose strings equal
   an adjacent one repeat.

A right context with more than ``PART_CONTEXTS`` distinct contexts is no part of its own: its starts are
dealt by longer strings, the ``BLOCK`` starts of one block by the bytes that they share. Blocks whose
shared bytes occur once are dropped; for others the bytes around the shared ones decide, by partial
aggregation, so that a passage in a third of all texts is no hot task and no part grows with the data.

Contexts and shared bytes are equal if 128 bits of hash are; all else is compared by bytes.

Defined cases: null text counts as empty; texts below ``length`` bytes keep all bytes; equal texts
remove each other wholly, repeated rows included; a null id is a document like any other; an empty
table gives an empty result; very long texts are read whole, anchors are found in one pass over each;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .difference_cover import equal_prefixes, suffix_order
from .scratch import Scratch

REACH = 128
GRAM = 16
#: Distinct contexts that are sorted in one part.
PART_CONTEXTS = 4096
#: Bytes of contexts that are sorted at a time, unless one part has more.
PART_BYTES = 1 << 21
#: Starts that share one block of a crowded right context.
BLOCK = 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = wh.mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
#: Bits of a place in a slice; the bits above are the hash.
_PLACE = _U(31)


class Prints:
    """Hashes of any byte range of a buffer, from running polynomial sums. They select; they never decide."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        steps = np.full(n, _BASE, _U)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        self._down = np.multiply.accumulate(steps)
        self._sum = np.zeros(n, _U)
        np.cumsum(_BYTES[data] * up[:-1], out=self._sum[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return wh.mix((self._sum[end] - self._sum[begin]) * self._down[begin] + (end - begin).astype(_U))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, prints: Prints):
    """(row, place, first start, last start) of each anchor with its run of starts."""
    n = len(data)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    valid = np.arange(n) + length <= bounds[1:][row] if n else np.zeros(0, bool)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    places = np.arange(n - GRAM + 1)
    code = (prints.of(places, places + GRAM) >> _PLACE << _PLACE) | places.astype(_U)
    span = 1
    while span < REACH:
        step = min(span, REACH - span)
        code = np.minimum(code[:-step], code[step:])
        span += step
    where = np.flatnonzero(valid)
    place = (code[where] & ((_U(1) << _PLACE) - _U(1))).astype(np.int64)
    new = np.ones(len(where), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[where[1:]] != row[where[:-1]])
    first = np.flatnonzero(new)
    final = np.concatenate([first[1:], [len(where)]]) - 1
    return row[where[first]], place[first], where[first], where[final]


def _find_anchors(length: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for at, end, data, bounds in wh.slices(batch.column(1)):
                prints = Prints(data)
                row, place, low, high = anchors(data, bounds, length, prints)
                if not len(row):
                    continue
                right = prints.of(place, place + (length - REACH + 1))
                raw = memoryview(data)
                of = xxhash.xxh3_64_intdigest
                whole = np.array([of(raw[a : b + length], p - a) for a, b, p in zip(low.tolist(), high.tolist(), place.tolist(), strict=True)], np.uint64)
                base = bounds[row]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, end - at).take(pa.array(row)), *(pa.array((x - base).astype(np.int32)) for x in (low, high, place)), pa.array(right.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["doc", "low", "high", "place", "right", "whole"],
                )

    return run


def _read_contexts(length: int):
    """The bytes of the listed contexts of each text."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                out += [(r["right"], r["crowded"], doc, r["low"], r["high"], r["place"], raw[r["low"] : r["high"] + length]) for r in runs]
            kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            names = ["right", "crowded", "doc", "low", "high", "place", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def repeated_starts(contexts: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of the starts whose string of ``length`` bytes another start has too, in order.

    contexts: bytes, and the number of starts in them.
    """
    sizes = np.array([len(raw) + 1 for raw, _ in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(raw for raw, _ in contexts) + b"\0", np.uint8)
    chars = data.astype(np.int64) + 2
    chars[begin + sizes - 1] = 1  # below every byte
    starts = np.zeros(len(data), bool)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    count = np.array([n for _, n in contexts], np.int64)
    starts[np.arange(len(data)) - begin[owner] < count[owner]] = True
    order = suffix_order(chars)
    found = np.sort(equal_prefixes(data, order[starts[order]], length))
    return owner[found], found - begin[owner[found]]


def _sort_parts(length: int):
    """Runs (doc, low, high) of starts that repeat, of contexts that arrive ordered by their right context."""

    def runs(held: list[tuple]):
        held = list({row[1:3]: row for row in held}.values())  # copies of a text give a context twice
        owner, start = repeated_starts([(row[4], row[3] - row[2] + 1) for row in held], length)
        if not len(owner):
            return None
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        final = np.concatenate([first[1:], [len(owner)]]) - 1
        base = np.array([row[2] for row in held], np.int64)[owner]
        low, high = ((base + start)[at].astype(np.int32) for at in (first, final))
        return pa.RecordBatch.from_arrays([pa.array([held[k][1] for k in owner[first].tolist()], pa.binary()), pa.array(low), pa.array(high)], names=["doc", "low", "high"])

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        held, size = [], 0
        for _, part in groupby(rows, key=lambda row: row[0]):
            part = list(part)
            if size > PART_BYTES:
                found = runs(held)
                if found is not None:
                    yield found
                held, size = [], 0
            held += part
            size += sum(len(row[4]) for row in part)
        found = runs(held) if held else None
        if found is not None:
            yield found

    return run


def _deal_blocks(length: int):
    """Blocks of BLOCK starts: hash of the bytes that all their strings share, and the bytes around those."""
    core = length - BLOCK + 1

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "doc", "top", "least", "most", "around")}
            for doc, low, high, place, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for block in range((place - high) // BLOCK, (place - low) // BLOCK + 1):
                    at = place - block * BLOCK  # the block's last start: all its strings hold core bytes from here
                    head = raw[max(0, at - BLOCK + 1 - low) : at - low]
                    tail = raw[at - low + core : at - low + length]
                    out["key"].append(xxhash.xxh3_128_digest(raw[at - low : at - low + core], block))
                    out["doc"].append(doc)
                    out["top"].append(at)
                    out["least"].append(max(0, at - high))
                    out["most"].append(min(BLOCK - 1, at - low))
                    out["around"].append(head.rjust(BLOCK - 1, b"\0") + tail.ljust(BLOCK - 1, b"\0"))
            kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"] + length) for r in ranges.as_py() or ()):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                out["kept"].append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(out["kept"][-1]))
                out["n_spans"].append(len(spans))
                out["spans"].append([{"begin": a, "end": b} for a, b in spans])
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["id", *out])

    return run


def _crowded_starts(scratch: Scratch, contexts: DataFrame, length: int) -> DataFrame:
    """(doc, low, high) of the starts that repeat, of contexts with crowded right contexts."""
    blocks = scratch.settle(contexts.select("doc", "low", "high", "place", "bytes").mapInArrow(_deal_blocks(length), "key binary, doc binary, top int, least int, most int, around binary"), batch_rows=500)
    tag = F.xxhash64("doc", "top", "least", "most")
    shared = blocks.groupBy("key").agg(F.min(tag).alias("a"), F.max(tag).alias("b")).where("a < b").select("key")
    left = blocks.join(shared, "key").select("key", "doc", "top", "around", F.explode(F.sequence("least", "most")).alias("e"))
    left = left.select("key", "e", F.expr(f"substring(around, {BLOCK} - e, {BLOCK - 1})").alias("piece"), "doc", (F.col("top") - F.col("e")).alias("low"))
    left = scratch.settle(left)
    tag = F.xxhash64("doc", "low")
    again = left.groupBy("key", "e", "piece").agg(F.min(tag).alias("a"), F.max(tag).alias("b")).where("a < b").drop("a", "b")
    return scratch.settle(left.join(again, ["key", "e", "piece"]).select("doc", "low", F.col("low").alias("high")).distinct())


def remove_repeats(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) for each row; kept: the bytes left, spans: the removed runs."""
    if length < REACH + GRAM:
        raise ValueError(f"strings need {REACH + GRAM} bytes at least")
    scratch = Scratch(docs.sparkSession, "repeats")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("doc", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    long_texts = texts.where(F.octet_length("text") >= length)
    found = scratch.settle(long_texts.select("doc", "text").mapInArrow(_find_anchors(length), "doc binary, low int, high int, place int, right long, whole long"), batch_rows=2000)
    tag = F.xxhash64("doc", "low")
    rights = found.groupBy("right").agg(F.min(tag).alias("a"), F.max(tag).alias("b"), (F.min("whole") != F.max("whole")).alias("mixed"))
    rights = scratch.settle(rights.where("a < b").select("right", "mixed"))
    shared = scratch.settle(found.join(rights, "right"))
    scratch.drop(found, rights)
    mixed = shared.where("mixed")
    contexts = mixed.groupBy("right", "whole").agg(F.min(F.struct("doc", "low", "high", "place")).alias("who"), F.min(tag).alias("a"), F.max(tag).alias("b"))
    contexts = scratch.settle(contexts.select("right", "whole", "who", (F.col("a") < F.col("b")).alias("many")))
    plain = shared.where("not mixed").select("doc", "low", "high")
    ranges = plain.unionByName(mixed.join(contexts.where("many").select("right", "whole"), ["right", "whole"]).select("doc", "low", "high"))
    crowds = contexts.groupBy("right").count().select("right", (F.col("count") > PART_CONTEXTS).alias("crowded"))
    runs = contexts.join(crowds, "right").groupBy("who.doc").agg(F.collect_list(F.struct("right", "crowded", "who.low", "who.high", "who.place")).alias("runs"))
    runs = scratch.settle(runs)
    read = long_texts.select("doc", "text").join(runs, "doc").select("doc", "text", "runs")
    read = scratch.settle(read.mapInArrow(_read_contexts(length), "right long, crowded boolean, doc binary, low int, high int, place int, bytes binary"), batch_rows=500)
    scratch.drop(runs)
    dealt = read.where("not crowded").select("right", "doc", "low", "high", "bytes").repartition("right").sortWithinPartitions("right")
    sorted_out = scratch.settle(dealt.mapInArrow(_sort_parts(length), "doc binary, low int, high int"))
    crowded = read.where("crowded")
    if not crowded.isEmpty():
        sorted_out = sorted_out.unionByName(_crowded_starts(scratch, crowded, length))
    copies = long_texts.groupBy("doc").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1")
    # Texts with copies go as a whole; without this, a text in a third of all rows were one hot key.
    copies = scratch.settle(copies)
    ranges = ranges.unionByName(sorted_out).join(copies.select("doc"), "doc", "left_anti").unionByName(copies.select("doc", F.lit(0).alias("low"), (F.col("size") - length).cast("int").alias("high")))
    per_doc = scratch.settle(ranges.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
    scratch.drop(shared, contexts, read)
    out = texts.join(per_doc, "doc", "left").select("id", "text", "ranges")
    return out.mapInArrow(_cut(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin:long,end:long>>").withColumnRenamed("id", id_col)
