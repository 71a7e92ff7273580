"""Removal of repeated byte strings by two-stage suffix sorting.

A byte is removed if it lies in a string of ``width`` bytes that starts at two places or more, in any documents.

1. Windows of ``width`` bytes that are equal have the same smallest ``gram``-byte hash (winnowing). Neighbouring windows
   with the same smallest hash, some 170 in natural text and at most ``width - gram + 1``, form a context; every
   repeated window is found among the contexts of one hash. Only hashes are shuffled for this.
2. Contexts of one hash that are all equal are repeated as a whole. Contexts that differ form a block. The suffixes at
   its windows are sorted in two stages: only suffixes smaller than their successors are sorted directly; scanning the
   buckets of first bytes in ascending order places every other suffix behind its successor. Neighbours in this order
   whose common prefix reaches ``width`` show the windows that occur at two places.
3. A hash with more than ``limit`` different contexts would make too large a block; there the windows themselves are
   hashed and counted, which spreads one passage over all tasks. The result is the same.

Texts are UTF-8 bytes; null texts are empty; texts shorter than ``width`` lose nothing. Equal rows are separate
documents. Columns other than doc_id and text are ignored. Substrings are compared for equality by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telvane.llm.common import BYTE, Scratch, checked_broadcast, inverse_powers, mix, null_safe, powers, text_parts

KEY = ["doc_id", "text_hash"]
#: Bytes of a text that are hashed at once; longer texts are hashed in overlapping pieces.
PIECE = 1 << 21


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make substring hashes independent of their place."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(n), out=total[1:])
    return total, inverse_powers(n + 1)


def substring(total: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * inverse[start])


def extreme(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each run of ``size`` neighbours, at the run's first place."""
    span = 1
    while 2 * span <= size:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, place, bytes, smallest hash, own hash of every context, and whether the smallest hash occurs in it twice.

    Only contexts of the last kind can hold a window twice by themselves (periodic texts).
    """
    n, reach = len(data), width - gram
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    total, inverse = rolling(data)
    place = np.arange(n - gram + 1)
    grams = substring(total, inverse, place, place + gram)
    smallest = extreme(grams, reach + 1, np.minimum)  # at window starts
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place = np.flatnonzero(np.arange(len(smallest)) + width <= ends[: len(smallest)])  # windows inside a text
    value = smallest[place]
    if not len(place):
        return anchors(data[:0], offsets, width, gram)
    begins = np.r_[True, (value[1:] != value[:-1]) | (np.diff(place) != 1)]
    run = np.flatnonzero(begins)
    begins |= (np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))) % (reach + 1) == 0
    run = np.flatnonzero(begins)
    at, size = place[run], np.diff(np.append(run, len(place))) - 1 + width
    text = np.searchsorted(offsets, at, "right") - 1
    context = mix(substring(total, inverse, at, at + size) + size.astype(np.uint64) * np.uint64(0x9E3779B1))
    # places that are smallest in some window, by value; the first two of a context's value from its start on
    around = np.zeros(len(grams) + reach, np.uint64)
    around[reach : reach + len(smallest)] = smallest
    low = np.flatnonzero(extreme(around, reach + 1, np.maximum)[: len(grams)] >= grams)
    values, rank = np.unique(grams[low], return_inverse=True)
    keys = np.sort(rank * np.int64(n) + low)
    second = np.searchsorted(keys, np.searchsorted(values, value[run]) * np.int64(n) + at) + 1
    own_keys = keys[np.minimum(second, len(keys) - 1)]
    again = (second < len(keys)) & (own_keys <= np.searchsorted(values, value[run]) * np.int64(n) + at + size - gram)
    return text, at - offsets[text], size, value[run], context, again


def piece_anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """As ``anchors``; one long text is handled in pieces that share all but one byte of a window."""
    if len(data) <= 2 * PIECE or len(offsets) != 2:
        return anchors(data, offsets, width, gram)
    found = []
    for low in range(0, len(data), PIECE):
        high = min(len(data), low + PIECE + width - 1)
        part = anchors(data[low:high], np.array([0, high - low]), width, gram)
        found.append([part[0], part[1] + low, *part[2:]])
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int, whole: np.ndarray) -> np.ndarray:
    """The wanted suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    ``whole``: hashes of the first ``depth`` bytes; suffixes that agree in them need no sorting.
    """
    n = len(data)
    step = np.ones(n, np.int8)  # sign of the change to the next byte; the last suffix is larger than the empty one
    step[:-1] = np.sign(data[:-1].astype(np.int16) - data[1:].astype(np.int16))
    at = np.where(step != 0, np.arange(n), n)
    larger = step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # than the successor: induced
    # each induced suffix needs its successors up to the next one that is sorted directly
    stop = np.minimum.accumulate(np.where(larger, n, np.arange(n))[::-1])[::-1]
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.flatnonzero(wanted), 1)
    np.add.at(edge, np.minimum(stop[wanted], n) + 1, -1)
    needed = np.cumsum(edge)[:n] > 0

    direct = np.flatnonzero(needed & ~larger)
    padded = np.r_[data, np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded, (n + 9, 8), (1, 1)).copy().view(">u8")[:, 0].astype(np.uint64)
    order = np.lexsort((words[direct + 8], words[direct]))
    direct = direct[order]
    same = (words[direct[1:]] == words[direct[:-1]]) & (words[direct[1:] + 8] == words[direct[:-1] + 8])
    runs = np.flatnonzero(np.r_[True, ~same]) if len(direct) else np.zeros(0, np.int64)
    hashes = whole[direct]
    mixed = (np.minimum.reduceat(hashes, runs) != np.maximum.reduceat(hashes, runs)) if len(direct) else runs > 0
    raw, ends = data.tobytes(), np.append(runs, len(direct))
    for k in np.flatnonzero(mixed).tolist():
        a, b = ends[k], ends[k + 1]
        direct[a:b] = sorted(direct[a:b].tolist(), key=lambda i: raw[i + 16 : i + depth])

    first = data.astype(np.int64)
    bounds = np.searchsorted(first[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = larger & needed

    def place(sorted_suffixes: np.ndarray) -> None:
        ahead = sorted_suffixes[sorted_suffixes > 0] - 1
        ahead = ahead[induced[ahead]]
        if len(ahead):
            heads = first[ahead]
            order = np.argsort(heads, kind="stable")
            ahead, heads = ahead[order], heads[order]
            for part in np.split(ahead, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
                waiting[first[part[0]]].append(part)

    out = []
    place(np.array([n], np.int64))
    for c in range(256):
        while waiting[c]:  # suffixes placed behind successors of the same bucket come in turn
            ready = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(ready)
            place(ready)
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            place(own)
    out = np.concatenate(out) if out else np.zeros(0, np.int64)
    return out[wanted[out]]


def repeated_windows(contexts: list[bytes], copies: np.ndarray, where: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context the starts of its windows that occur at two places; ``where`` numbers its first byte's place."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    place = np.arange(len(data))
    wanted = place - offsets[owner] + width <= sizes[owner]
    total, inverse = rolling(data)
    whole = substring(total, inverse, place, np.minimum(place + width, len(data)))
    order = suffix_order(data, wanted, width, whole)
    flags = np.zeros(len(data), bool)
    if len(order):
        equal = whole[order[1:]] == whole[order[:-1]]  # the common prefix reaches width
        runs = np.flatnonzero(np.r_[True, ~equal])
        spot = where[owner[order]] + (order - offsets[owner[order]]).astype(np.uint64)
        twice = (np.minimum.reduceat(spot, runs) != np.maximum.reduceat(spot, runs)) | (np.maximum.reduceat(copies[owner[order]], runs) > 1)
        flags[order] = np.repeat(twice, np.diff(np.append(runs, len(order))))
    return [np.flatnonzero(flags[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def spans_of(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of window starts as byte ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + width).tolist()))


SPANS = "array<struct<first int, past int>>"


def find_anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_parts(batch.column("text")):
                text, place, size, h, c, again = piece_anchors(data, offsets, width, gram)
                take = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(place.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(again.astype(bool))],
                    names=[*KEY, "place", "size", "h", "c", "again"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, place long, size int, h long, c long, again boolean")


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of contexts; wanted: doc_id, text_hash, list of (h, c, copies, place, size)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spot, items in zip(batch.column("text").to_pylist(), batch.column("spot").to_pylist(), batch.column("items").to_pylist()):
                raw = (text or "").encode()
                for x in items:
                    out.append((x["h"], x["c"], x["copies"], (spot + x["place"] + 2**63) % 2**64 - 2**63, raw[x["place"] : x["place"] + x["size"]]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["h", "c", "copies", "spot", "bytes"])

    rows = null_safe(docs, wanted, KEY).select("text", F.xxhash64(*KEY).alias("spot"), "items")
    return rows.mapInArrow(run, "h long, c long, copies long, spot long, bytes binary")


def block_spans(contexts: DataFrame, width: int, size: int) -> DataFrame:
    """(h, c, spans): repeated ranges of each context; all contexts of a hash are in one block."""

    def run(table):
        table = table.sort_by("h")
        h, c, copies = (table.column(x).to_numpy() for x in ("h", "c", "copies"))
        where, parts = table.column("spot").to_numpy().view(np.uint64), table.column("bytes").to_pylist()
        out, a = [], 0
        ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1
        weight = np.cumsum([len(x) for x in parts])
        while a < len(h):
            fit = ends[(ends > a) & (weight[ends - 1] - (weight[a - 1] if a else 0) <= size)]
            b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
            for k, starts in enumerate(repeated_windows(parts[a:b], copies[a:b], where[a:b], width), a):
                if len(starts):
                    out.append((h[k], c[k], [{"first": x, "past": y} for x, y in spans_of(starts, width)]))
            a = b
        spans = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.table([pa.array(v, t) for v, t in zip(columns, [pa.int64(), pa.int64(), spans])], names=["h", "c", "spans"])

    return contexts.groupBy("block").applyInArrow(run, f"h long, c long, spans {SPANS}")


def counted_spans(contexts: DataFrame, width: int) -> DataFrame:
    """As ``block_spans``, by counting hashed windows, for hashes with very many contexts."""

    def hashed(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = np.frombuffer(row.column("bytes")[0].as_py(), np.uint8)
                start = np.arange(len(data) - width + 1)
                total, inverse = rolling(data)
                windows = substring(total, inverse, start, start + width)
                spot = row.column("spot").to_numpy().view(np.uint64)[0] + start.astype(np.uint64)
                same = [row.column(x).take(pa.array(np.zeros(len(start), np.int64))) for x in ("h", "c", "copies")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(start.astype(np.int32)), pa.array(windows.view(np.int64)), pa.array(spot.view(np.int64))], names=["h", "c", "copies", "start", "win", "spot"])

    def joined(batches):
        spans = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for batch in batches:
            found = [[{"first": x, "past": y} for x, y in spans_of(np.sort(np.array(s)), width)] for s in batch.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(found, spans)], names=["h", "c", "spans"])

    windows = contexts.select("h", "c", "copies", "spot", "bytes").mapInArrow(hashed, "h long, c long, copies long, start int, win long, spot long")
    twice = windows.groupBy("win").agg(F.min("spot").alias("low"), F.max("spot").alias("high"), F.max("copies").alias("most")).where("low != high or most > 1").select("win")
    starts = windows.join(twice, "win", "left_semi").groupBy("h", "c").agg(F.collect_list("start").alias("starts"))  # at most one context's windows
    return starts.mapInArrow(joined, f"h long, c long, spans {SPANS}")


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; spans: doc_id, text_hash, list of byte ranges or null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw = (text or "").encode()
                kept, at, removed, n = hashlib.sha256(), 0, 0, 0
                past = -1
                for a, b in sorted((x["first"], x["past"]) for x in ranges or []):
                    if a > past:
                        if past >= 0:
                            removed += past - at
                            n += 1
                            kept.update(raw[past:a])
                        else:
                            kept.update(raw[:a])
                        at = a
                    past = max(past, b)
                if past >= 0:
                    removed += past - at
                    n += 1
                    kept.update(raw[past:])
                else:
                    kept.update(raw)
                rows.append((len(raw), removed, n, kept.hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(v, t) for v, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = null_safe(docs, spans, KEY, "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 400, gram: int = 64, limit: int = 4_000, block: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = scratch.settle(find_anchors(docs, width, gram), "anchors")
    heads = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("again").alias("again")).where("n > 1 or again")
    shared = scratch.settle(found.drop("again").join(heads.select("h", ((F.col("low") != F.col("high")) | F.col("again")).alias("mixed")), "h"), "shared")
    scratch.drop(found)

    contexts = shared.where("mixed").groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "place", "size")).alias("first"),
    )
    contexts = scratch.settle(contexts, "contexts")
    many = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") > limit).select("h", F.lit(True).alias("many"))
    many = checked_broadcast(scratch.settle(many, "many"))
    items = contexts.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("h", "c", "copies", "first.place", "first.size")).alias("items")
    )
    items = checked_broadcast(scratch.settle(items, "items"), weight=32 + 40 * F.size("items"))
    cut = scratch.settle(cut_contexts(docs, items).join(many, "h", "left"), "cut")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (2 * block)))
    few = cut.where("many is null").withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
    spans = block_spans(few, width, block).unionAll(counted_spans(cut.where("many"), width))

    whole = shared.where("not mixed").select(*KEY, F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("past"))
    partly = shared.where("mixed").join(spans, ["h", "c"]).select(*KEY, F.col("place").alias("begin"), F.explode("spans").alias("x"))
    partly = partly.select(*KEY, (F.col("begin") + F.col("x.first")).alias("first"), (F.col("begin") + F.col("x.past")).alias("past"))
    # a text's ranges follow its length; equal rows have equal ranges
    ranges = whole.unionAll(partly).groupBy(*KEY).agg(F.collect_set(F.struct("first", "past")).alias("ranges"))
    ranges = checked_broadcast(scratch.settle(ranges, "ranges"), weight=32 + 20 * F.size("ranges"))
    return cut_out(docs, ranges)
