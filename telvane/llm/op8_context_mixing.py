"""Language-model scores by online logistic context mixing.

Bytes are written in Huffman codes of the training bytes, one for each byte before, and predicted bit by bit. Several predictors each look up
their context (the last 2 and 4 bytes, or the bytes of the current word so far, with the code bits so far, hashed to a slot) in a table of bit counts gathered
from all training texts. Their log odds are mixed with weights that are chosen by a gate (code bits so far, and how
often the word so far was seen) and updated after every stride of bits along the gradient of the coding cost; an
adaptive table, updated likewise, then refines the probability by what actually followed similar ones. The log10 probabilities of all bits of a
text add up to its score.

Weights and the refining table start from fitted values and adapt from a text's first bit to its last, in strides of
``STRIDE`` bits that grow, with a rate that falls, behind its first ``EARLY`` bits. The fit is one logistic regression
per gate, by Newton steps on counts of all training bits by gate and log odds (in ``LEVELS`` levels each), each bit
without its own share in the tables, so that weights suit texts that the tables have not seen. Many texts
advance side by side; a text beyond ``PART`` bytes is read in pieces that hand on their state, so a text of any length
is scored in bounded memory.

The table of bit counts grows with the training texts: it has at least ``PER_TOKEN`` / 2 slots for every distinct
training token, a power of two up to 2 ** ``MOST_BITS``, which bounds what is broadcast (32 MB). Slots are not checked
for their context; beyond the bound more contexts share a slot.

The base score is a smoothed unigram model: words in lower case and one end token per text. Frequent tokens' counts go
to all tasks (at most ``FREQUENT`` of them); the rest is joined by a shuffle.

Null and empty texts have one token, the end, and score 0. Rows that share a doc_id are separate; a null doc_id counts
as the id ''. Without training rows N and all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telvane.llm.common import BYTE, SPACE, Scratch, Words, inverse_powers, list_array, mix, powers, ship, shipped, text_parts

ORDERS = (2, 4, "word")
#: Slots of the table: for a distinct token, least and most as powers of two; ranges in which tables are merged.
PER_TOKEN, LEAST_BITS, MOST_BITS, RANGES = 32, 16, 23, 64
PART, FREQUENT = 1 << 20, 500_000
#: Bits between a text's first updates, bits after which strides grow, texts that advance together and their bytes, bytes whose features are worked out at once.
STRIDE, EARLY, LANES, TOGETHER, PIECE = 32, 1 << 13, 512, 1 << 21, 1 << 17
#: Bytes before a byte that its contexts can hold.
REACH = 32
#: Log odds are kept in steps of 1/16; gate sets; steps of the refining table.
STEP, GATES, STEPS = 16.0, 32, 24
#: Levels of log odds in the fit, and its Newton steps.
LEVELS, NEWTON = 32, 12
RATE, REFINE_RATE = 0.02, 0.02
END = 0x5DEECE66D


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


#: A slot's counts of either bit up to 15, in four bits each, as columns; how often the slot was seen in four classes.
FEW = np.stack([np.arange(256) >> 4, np.arange(256) & 15])


def classes(n: np.ndarray) -> np.ndarray:
    return np.where((FEW == 15).any(axis=0), 3, np.minimum(3, np.ceil(np.log2(n + 1) / 2))).astype(np.uint8)


SEEN = classes(FEW.sum(axis=0))
#: The same without one bit 0 or 1, and the change of the log odds by that, by bit and counts.
SEEN_BEFORE = classes(np.maximum(FEW.sum(axis=0) - 1, 0))
LESS = np.where((FEW > 0) & (FEW < 15), np.round(STEP * np.log((FEW + 0.4) / np.maximum(FEW - 0.6, 0.4))), 0) * np.array([[1], [-1]])
LESS = LESS.astype(np.int16).ravel()


class Code:
    """Huffman codes of bytes, one for each byte before: the length by (byte before, byte), and at each depth the inner node and the bit."""

    def __init__(self, counts: np.ndarray):
        length, node, bit, depth = [], [], [], []
        for before, row in enumerate(counts.reshape(256, 256).tolist()):
            heap = [(32 * n + 1, b) for b, n in enumerate(row)]
            heapq.heapify(heap)
            up: dict[int, tuple[int, int]] = {}
            at = 256
            while len(heap) > 1:
                (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
                up[a], up[b] = (at, 0), (at, 1)
                heapq.heappush(heap, (n + m, at))
                at += 1
            for b in range(256):
                path, at = [], b
                while at in up:
                    path.append(up[at])
                    at = up[at][0]
                length.append(len(path))
                node += [256 * before + n - 256 for n, _ in reversed(path)]
                bit += [x for _, x in reversed(path)]
                depth += range(len(path))
        self.length = np.array(length, np.int32)
        self.first = np.r_[0, np.cumsum(self.length)][:-1].astype(np.int32)
        self.node = np.array(node, np.uint32) * np.uint32(0x85EBCA6B)
        self.control = (np.minimum(depth, 7) * 8).astype(np.uint8) | np.array(bit, np.uint8)  # depth, two bits for the gate, the bit


def pairs(data: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Each byte and the one before it in its text (0 at its start) as one number."""
    out = data.astype(np.int32)
    out[1:] += np.where(since[1:] > 0, data[:-1].astype(np.int32) << 8, 0)
    return out


def contexts(data: np.ndarray, since: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each context of each byte; ``since``: bytes before it in its text, up to REACH."""
    n, out = len(data), []
    h = np.full(n, 0x811C9DC5, np.uint32)
    near = np.flatnonzero(since < 4)
    for k in range(1, 5):
        back = np.zeros(n, np.uint32)
        back[k:] = data[:-k] if k < n else 0
        back[near[since[near] < k]] = 256
        h ^= back
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            out.append(h * np.uint32(0x9E3779B1))
    # the current word: the hashed bytes since the last blank, as a difference of prefix sums; at most REACH of them
    if not n:
        return [*out, h]
    place = np.arange(n)
    first = SPACE.take(data)
    first[1:] = first[:-1]
    first |= since == 0
    first[0] = True
    begin = place * first
    np.maximum.accumulate(begin, out=begin)
    np.maximum(begin, place - REACH, out=begin)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(BYTE.take(data), powers(n), out=total[1:])
    np.cumsum(total, out=total)
    word = total[:-1] - total.take(begin)
    word *= inverse_powers(n).take(begin)
    place -= begin
    word += place.view(np.uint64)
    out.append((mix(word) >> np.uint64(32)).astype(np.uint32))
    return out


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    at = context + node
    at *= np.uint32(0xC2B2AE35)
    at >>= np.uint32(32 - bits)
    return at


def table_bits(distinct: int) -> int:
    """The slots of the table, as a power of two, for so many distinct training tokens."""
    return min(MOST_BITS, max(LEAST_BITS, int(PER_TOKEN * distinct).bit_length()))


class Bits:
    """The code bits of a run of bytes: how many each byte has, where they begin, and each one's byte, hashed inner node and control."""

    def __init__(self, code: Code, data: np.ndarray):
        """``data``: numbers of ``pairs``."""
        self.length = code.length.take(data)
        self.start = np.r_[0, np.cumsum(self.length, dtype=np.int64)]
        self.owner = np.zeros(self.start[-1], np.int64)  # a byte has one bit at least
        self.owner[self.start[1:-1]] = 1
        np.cumsum(self.owner, out=self.owner)
        at = runs(code.first.take(data), self.length, self.start)
        self.node, self.control = code.node.take(at), code.control.take(at)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Each bit's value of its byte."""
        return values.take(self.owner)


def runs(first: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of so many numbers each, laid end to end; ``start``: where each run begins, and their end."""
    out = np.ones(start[-1], np.int64)
    if len(first):
        out[0] = first[0]
        out[start[1:-1]] = first[1:] - first[:-1] - length[:-1] + 1
    return np.cumsum(out, out=out)


def alike(context: list[np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of bytes that stand for all bytes with the same contexts and pair, and each byte's number among them.

    Each byte looks at the last one of its hash and stands for itself if that one differs.
    """
    n = len(pair)
    size = max(1, n.bit_length())
    wide = np.uint64(32)
    one, two = (context[0].astype(np.uint64) << wide) | pair.astype(np.uint64), (context[1].astype(np.uint64) << wide) | context[2]
    spot = context[2] * np.uint32(0x85EBCA6B)
    spot += context[1]
    spot *= np.uint32(0x9E3779B1)
    spot += pair.astype(np.uint32)
    spot *= np.uint32(0xC2B2AE35)
    spot >>= np.uint32(32 - size)
    spot = spot.astype(np.int64)
    seat, place = np.zeros(1 << size, np.int64), np.arange(n)
    seat[spot] = place
    other = seat.take(spot)
    same = one.take(other) == one
    same &= two.take(other) == two
    other = np.where(same, other, place)
    stands = other == place
    number = np.cumsum(stands)
    number -= 1
    return np.flatnonzero(stands), number.take(other)


def distinct_bits(code: Code, data: np.ndarray, since: np.ndarray, skip: int) -> tuple[Bits, list[np.ndarray], np.ndarray]:
    """Bits and contexts of bytes that stand for all bytes behind the first ``skip``, and each one's number among them."""
    pair, found = pairs(data, since)[skip:], [h[skip:] for h in contexts(data, since)]
    own, number = alike(found, pair)
    return Bits(code, pair[own]), [h[own] for h in found], number


def since_start(offsets: np.ndarray) -> np.ndarray:
    """Bytes before each byte in its text, up to REACH."""
    out, sizes = np.full(offsets[-1], REACH, np.uint8), np.diff(offsets)
    for k in range(REACH):
        out[offsets[:-1][sizes > k] + k] = k
    return out


def gather_statistics(docs: DataFrame) -> DataFrame:
    """(kind, key, n) partial counts of a task: tokens by hash (kind 0) and pairs of neighbouring bytes (kind 1)."""

    def run(batches):
        keys, counts, seen, ends = [], [], np.zeros(1 << 16, np.int64), 0

        def merge():
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            return k[at], np.add.reduceat(c, at)

        for batch in batches:
            ends += batch.num_rows
            for _, _, data, offsets in text_parts(batch.column("text")):
                seen += np.bincount(pairs(data, since_start(offsets)), minlength=1 << 16)
                k, c = np.unique(Words(data, offsets).hash, return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > 3_000_000:
                    k, c = merge()
                    keys, counts = [k], [c]
        keys.append(np.array([END], np.uint64))
        counts.append(np.array([ends]))
        k, c = merge()
        for a in range(0, len(k), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k[part]), np.int32)), pa.array(k[part].view(np.int64)), pa.array(c[part].astype(np.int64))], names=["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(1 << 16, np.int32)), pa.array(np.arange(1 << 16)), pa.array(seen)], names=["kind", "key", "n"])

    return docs.mapInArrow(run, "kind int, key long, n long").where("n > 0")


def gather_table(docs: DataFrame, code: Code, size: int) -> DataFrame:
    """(part, log_odds, few): the merged table of 2 ** size slots in ranges of slots, as bytes; see ``FEW``."""
    shared = ship(docs.sparkSession, code)
    span = (1 << size) // RANGES

    def count(batches):
        code, counts = shipped(shared), np.zeros(2 << size, np.int32)
        for batch in batches:
            for _, _, data, offsets in text_parts(batch.column("text"), 1 << 20):
                since = since_start(offsets)
                for a in range(0, len(data), PIECE):
                    low = max(0, a - REACH)
                    piece, early = data[low : a + PIECE], since[low : a + PIECE]
                    bits, found, number = distinct_bits(code, piece, early, a - low)
                    times, bit = bits.spread(np.bincount(number).astype(np.int32)), bits.control & 1
                    for h in found:
                        at = slots(bits.spread(h), bits.node, size)
                        at <<= np.uint32(1)
                        at |= bit
                        np.add.at(counts, at.astype(np.int64), times)
        both = counts.reshape(-1, 2)
        used = np.flatnonzero(both.any(axis=1))
        for r in range(RANGES):
            own = used[np.searchsorted(used, r * span) : np.searchsorted(used, (r + 1) * span)]
            if len(own):
                blob = np.concatenate([np.diff(own, prepend=r * span), both[own, 0], both[own, 1]]).astype(np.int32).tobytes()
                columns = [pa.array([r]), pa.array([len(blob)]), pa.array([pa.compress(blob, "zstd", asbytes=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "size", "counts"])

    def merge(key, batches):
        total = np.zeros((span, 2), np.int64)
        for batch in batches:
            for length, blob in zip(batch.column("size").to_pylist(), batch.column("counts")):
                step, n0, n1 = np.frombuffer(pa.decompress(blob.as_py(), length, "zstd"), np.int32).reshape(3, -1)
                own = np.cumsum(step)
                total[own, 0] += n0
                total[own, 1] += n1
        n0, n1 = total.T
        odds = np.clip(np.round(STEP * np.log((n1 + 0.4) / (n0 + 0.4))), -127, 127).astype(np.int8)
        few = (np.minimum(n0, 15) << 4 | np.minimum(n1, 15)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([odds.tobytes()], pa.binary()), pa.array([few.tobytes()], pa.binary())], names=["part", "log_odds", "few"])

    rows = docs.mapInArrow(count, "part long, size long, counts binary")
    return rows.groupBy("part").applyInArrow(merge_in(merge), "part long, log_odds binary, few binary")


def merge_in(merge):
    """A grouped function over a whole group's table; a group has one row per counting task, of bounded size."""

    def run(key, table):
        return pa.Table.from_batches(list(merge(key, table.to_batches())))

    return run


@dataclass
class Model:
    """Code, log odds of all slots, their small counts, and the state at a text's start.

    The state: weights by predictor and gate, refining table.
    """

    code: Code
    odds: np.ndarray
    few: np.ndarray
    state: np.ndarray

    @property
    def size(self) -> int:
        return len(self.odds).bit_length() - 1

    @cached_property
    def word(self) -> np.ndarray:
        """Log odds and class of a slot, the latter for its place in a control, in two bytes: one look-up gives both."""
        return np.stack([self.odds.view(np.uint8), (SEEN << 1).astype(np.uint8).take(self.few)], 1).view(np.uint16)[:, 0]

    def without_own(self) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and classes of a slot without one bit, by slot and that bit."""
        few = self.few.astype(np.int16)
        odds = [np.clip(self.odds + LESS[few + 256 * bit], -127, 127).astype(np.int8) for bit in (0, 1)]
        return np.stack(odds, 1).ravel(), np.repeat(SEEN_BEFORE[few], 2)

    def piece_features(self, data: np.ndarray, since: np.ndarray, skip: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, Bits, np.ndarray]:
        """As ``features``, of ``distinct_bits``."""
        bits, found, number = distinct_bits(self.code, data, since, skip)
        packed = np.empty((len(bits.control), 4), np.int8)
        for k, h in enumerate(found):
            at = slots(bits.spread(h), bits.node, self.size)
            if own:
                at <<= np.uint32(1)
                at |= bits.control & 1
            if own or k < len(found) - 1:
                packed[:, k] = own[0].take(at) if own else self.odds.take(at)
        if own:
            seen = own[1].take(at) << np.uint8(1)
        else:
            both = self.word.take(at).view(np.int8).reshape(-1, 2)
            packed[:, k], seen = both[:, 0], both[:, 1].view(np.uint8)
        packed[:, 3] = (bits.control | seen).view(np.int8)
        return packed.view(np.int32)[:, 0], bits, number

    def features(self, data: np.ndarray, since: np.ndarray, skip: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each bit after the first ``skip`` bytes the log odds and its control in four bytes; and the bits' starts.

        ``own``: from ``without_own``, if the bits are in the table and each is to be left out of its own features.
        """
        pieces, starts = [(max(0, a - REACH), a) for a in range(skip, len(data), PIECE)], np.zeros(len(data) - skip + 1, np.int32)
        for low, a in pieces:
            self.code.length.take(pairs(data[low : a + PIECE], since[low : a + PIECE])[a - low :], out=starts[a - skip + 1 : a - skip + 1 + PIECE], mode="clip")
        np.cumsum(starts, out=starts)
        out = np.empty(starts[-1], np.int32)
        for low, a in pieces:
            packed, bits, number = self.piece_features(data[low : a + PIECE], since[low : a + PIECE], a - low, own)
            start = starts[a - skip : a - skip + PIECE + 1].astype(np.int64)
            own_bits = out[start[0] : start[-1]]
            packed.take(runs(bits.start.take(number), bits.length.take(number), start - start[0]), out=own_bits, mode="clip")
        return out, starts


def first_state() -> np.ndarray:
    """The state before any training: even weights in all gates, and a table that repeats its input."""
    curve = 1 / (1 + np.exp((STEPS / 2 - 0.5 - np.arange(STEPS)) / 2))
    return np.r_[np.repeat([0.2, 0.3, 0.6], GATES), curve]


def stride_at(t: int) -> int:
    """Bits until the next update behind a text's first t bits."""
    return STRIDE * min(32, 1 << max(0, (t // EARLY).bit_length() - 1))


def mix_texts(packed: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each text's bits, and the state after the last bit of the shortest text that has bits.

    Texts of similar length advance side by side, a stride at a time, with the weights of the stride's beginning.
    ``before``: bits of the text that came in earlier pieces.
    """
    out, end = np.zeros(len(first)), state
    order = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
    for a in range(0, len(order), LANES):
        lanes = order[a : a + LANES]
        out[lanes], end = mix_lanes(packed, first[lanes], length[lanes], state, before)
    return out, end


def mix_lanes(packed: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    n, inputs = len(first), len(ORDERS)
    weights = np.zeros((n * GATES, 4), np.float32)  # by lane and gate: a weight for each log odds of a packed bit, none for its control
    for k in range(inputs):
        weights[:, k] = np.tile((state[k * GATES : (k + 1) * GATES] / STEP).astype(np.float32), n)
    table = np.tile(state[inputs * GATES :].astype(np.float32), n)
    lane, cell = np.arange(n)[:, None] * GATES, np.arange(n)[:, None] * STEPS
    total, t, last, ends = np.zeros(n), 0, int(length.max(initial=0)), (-length).tolist()
    room, windows = len(packed) - int(first.max(initial=0)), {}
    while t < last:
        stride = stride_at(before + t)
        m = bisect.bisect_left(ends, -t)  # lanes with more than t bits
        full = bisect.bisect_right(ends, -(t + stride))  # lanes with bits for the whole stride
        if t + stride <= room:
            if stride not in windows:
                windows[stride] = np.lib.stride_tricks.sliding_window_view(packed, stride)
            rows = windows[stride][first[:m] + t]
        else:
            rows = packed.take(first[:m, None] + np.arange(t, t + stride), mode="clip")
        control = rows.view(np.uint32) >> np.uint32(24)
        bit = (control & np.uint32(1)).astype(np.float32)
        control >>= np.uint32(1)
        gate = (control + lane[:m]).ravel()
        odds = rows.view(np.int8).reshape(-1, 4).astype(np.float32)
        part = weights.take(gate, axis=0, mode="clip")
        part *= odds
        z = part[:, 0] + part[:, 1]
        for k in range(2, inputs):
            z += part[:, k]
        z = z.reshape(m, stride)
        z.clip(-12, 12, out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        z *= 2
        z += STEPS / 2
        z.clip(0, STEPS - 1, out=z)
        spot = z.astype(np.int64)
        spot += cell[:m]
        miss = table.take(spot, mode="clip")
        np.subtract(bit, miss, out=miss)
        off = np.subtract(bit, p, out=p)
        chance = off * np.float32(0.75)
        chance += np.float32(0.25) * miss
        np.abs(chance, out=chance)
        np.subtract(1, chance, out=chance)  # the probability given to the bit that came
        if full < m:
            beyond = np.arange(t, t + stride) >= length[full:m, None]
            off[full:][beyond], miss[full:][beyond], chance[full:][beyond] = 0, 0, 1
        product = chance.reshape(-1, STRIDE).astype(np.float64)
        while (half := product.shape[1] // 2) > 0:
            product = product[:, :half] * product[:, half:]
        total[:m] += np.log(product).reshape(m, -1).sum(axis=1)
        rate, flat, slope = STRIDE / stride, off.ravel(), np.empty(m * stride)
        for k in range(inputs):
            change = np.bincount(gate, np.multiply(odds[:, k], flat, out=slope), minlength=m * GATES)
            change *= np.float32(RATE * rate / STEP**2)
            weights[: m * GATES, k] += change
        table[: m * STEPS] += REFINE_RATE * rate * np.bincount(spot.ravel(), miss.ravel(), minlength=m * STEPS)  # REFINE_RATE * STRIDE < 1
        t += stride
    end = np.concatenate([STEP * weights[-GATES:, k] for k in range(inputs)] + [table[-STEPS:]]).astype(float)
    return total, end


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of each text: many with about PART bytes together, or one of any length, as text_parts gives them."""
    n, state, before = len(offsets) - 1, model.state, 0
    since, out = since_start(offsets), np.zeros(n)
    step = PART if n == 1 else max(1, len(data))
    for a in range(0, len(data), step):
        b, low = min(a + step, len(data)), max(0, a - REACH)
        features, starts = model.features(data[low:b], since[low:b], a - low)
        bounds = starts[offsets.clip(a, b) - a].astype(np.int64)
        found, end = mix_texts(features, bounds[:-1], np.diff(bounds), state, before)
        out += found
        if n == 1:
            state, before = end, before + int(bounds[-1])
    return out


def cells(packed: np.ndarray) -> np.ndarray:
    """The cell of each bit in the fit: gate, bit, and the level of each predictor's log odds."""
    v = packed.view(np.uint32) ^ np.uint32(0x808080)
    at = (v >> np.uint32(24)) & np.uint32(2 * GATES - 1)
    for k in range(len(ORDERS)):
        at *= np.uint32(LEVELS)
        at |= (v >> np.uint32(8 * k + 3)) & np.uint32(LEVELS - 1)
    return at


def fit_gate(cell: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A gate's weights by Newton steps over its cells, and for each refining step the bits and the ones that fell into it."""
    levels = np.stack([(cell // LEVELS ** (len(ORDERS) - 1 - k)) % LEVELS for k in range(len(ORDERS))])
    x = ((levels * 8 + 3.5) - 128) / STEP
    y, w, n = (cell // LEVELS ** len(ORDERS)) & 1, start.copy(), n.astype(float)

    def cost(w):
        return (n * np.logaddexp(0, (1 - 2 * y) * (w @ x))).sum() + 0.5 * ((w - start) ** 2).sum()

    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        slope = x @ (n * (y - p)) - (w - start)
        move = np.linalg.solve((x * (n * p * (1 - p))) @ x.T + np.eye(len(w)), slope)
        size, now = 1.0, cost(w)
        while size > 1e-3 and cost(w + size * move) > now:
            size /= 2
        w = w + size * move
    step = np.clip(np.clip(w @ x, -12, 12) * 2 + STEPS / 2, 0, STEPS - 1).astype(np.int64)
    return w, np.bincount(step, n, STEPS), np.bincount(step, n * y, STEPS)


def fit_state(docs: DataFrame, model: Model) -> np.ndarray:
    """The state at a text's start, from one pass over all training texts."""
    shared, start, inputs = ship(docs.sparkSession, model), model.state, len(ORDERS)

    def count(batches):
        model, total = shipped(shared), np.zeros(2 * GATES * LEVELS ** len(ORDERS), np.int64)
        own = model.without_own()
        for batch in batches:
            for _, _, data, offsets in text_parts(batch.column("text"), 1 << 20):
                since = since_start(offsets)
                for a in range(0, len(data), PIECE):
                    low = max(0, a - REACH)
                    packed, bits, number = model.piece_features(data[low : a + PIECE], since[low : a + PIECE], a - low, own)
                    np.add.at(total, cells(packed).astype(np.int64), bits.spread(np.bincount(number)))
        used = np.flatnonzero(total)
        for a in range(0, len(used), 1 << 17):
            part = used[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part // (2 * LEVELS**inputs)), pa.array(part), pa.array(total[part])], names=["gate", "cell", "n"])

    def fit(key, table):
        gate = key[0].as_py()
        w, n, ones = fit_gate(table.column("cell").to_numpy(), table.column("n").to_numpy(), start[gate : inputs * GATES : GATES])
        return pa.table({"gate": pa.array([gate]), "w": pa.array([w.tolist()]), "n": pa.array([n.tolist()]), "ones": pa.array([ones.tolist()])})

    found = docs.mapInArrow(count, "gate long, cell long, n long").groupBy("gate", "cell").agg(F.sum("n").alias("n"))  # at most 65,536 cells in a gate
    rows = found.groupBy("gate").applyInArrow(fit, "gate long, w array<double>, n array<double>, ones array<double>").collect()  # at most GATES rows
    state, n, ones = start.copy(), np.full(STEPS, 2.0), 2 * start[inputs * GATES :]
    for r in rows:
        state[r["gate"] : inputs * GATES : GATES] = r["w"]
        n, ones = n + r["n"], ones + r["ones"]
    state[inputs * GATES :] = ones / n
    return state


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, bytes and offsets of runs of rows: texts of similar length, TOGETHER bytes of them, or one beyond PART bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    a = 0
    while a < len(order):
        before = ends[a - 1] if a else 0
        b = a + 1 if sizes[order[a]] > PART else max(a + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        rows = batch.take(pa.array(order[a:b]))
        for i, j, data, offsets in text_parts(rows.column("text"), max(TOGETHER, int(ends[b - 1] - before))):
            yield rows.column("doc_id").slice(i, j - i), data, offsets
        a = b


def learn(training: DataFrame, pair_counts: np.ndarray, size: int) -> Model:
    code = Code(pair_counts)
    odds, few = np.zeros(1 << size, np.int8), np.zeros(1 << size, np.uint8)
    span = len(odds) // RANGES
    for r in gather_table(training, code, size).toLocalIterator():  # RANGES rows of fixed size
        odds[r["part"] * span : (r["part"] + 1) * span] = np.frombuffer(r["log_odds"], np.int8)
        few[r["part"] * span : (r["part"] + 1) * span] = np.frombuffer(r["few"], np.uint8)
    model = Model(code, odds, few, first_state())
    model.state = fit_state(training.select("text"), model)
    return model


def frequent_tokens(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of all tokens counted at least so often that FREQUENT of them remain, and that count."""
    by_power = vocabulary.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for r in by_power:
        total += r["n"]
        if total > FREQUENT:
            break
        least = 1 << r["power"]
    def pack(batches):
        for batch in batches:
            blob = np.concatenate([batch.column(c).to_numpy() for c in ("key", "n")]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    parts = [np.frombuffer(r["blob"], np.int64).reshape(2, -1) for r in vocabulary.where(F.col("n") >= least).mapInArrow(pack, "blob binary").collect()]
    keys, counts = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order], least


class Lookup:
    """Places in sorted 64-bit hashes, by their first bits and a few steps on."""

    def __init__(self, keys: np.ndarray):
        size = max(1, len(keys).bit_length())
        self.keys, self.shift = np.append(keys, np.iinfo(np.int64).max), 64 - size
        self.first = np.searchsorted(keys, np.arange(-(1 << (size - 1)), 1 << (size - 1)) << self.shift).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Place of the first key that is not smaller; the number of keys at most."""
        at = self.first.take((hashes >> self.shift) + len(self.first) // 2).astype(np.int64)
        left = np.flatnonzero(self.keys.take(at) < hashes)
        while len(left):
            at[left] += 1
            left = left[self.keys.take(at[left]) < hashes[left]]
        return at


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out(F.col("doc_id")))
    statistics = scratch.settle(gather_statistics(training.select("text")).groupBy("kind", "key").agg(F.sum("n").alias("n")), "statistics")
    vocabulary = statistics.where("kind = 0").select("key", "n")
    all_tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    pair_counts = np.zeros(1 << 16, np.int64)
    for r in statistics.where("kind = 1").collect():  # at most 65,536 rows
        pair_counts[r["key"]] = r["n"]
    keys, counts, least = frequent_tokens(vocabulary)
    below = all_tokens + 0.5 * (distinct + 1)
    shared = ship(spark, (learn(training, pair_counts, table_bits(distinct)), keys, counts))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model, keys, counts = shipped(shared)
        logs, find = np.log10((counts + 0.5) / below), Lookup(keys)
        for batch in batches:
            for ids, data, offsets in by_length(batch):
                words = Words(data, offsets)
                bounds = words.bounds + np.arange(len(offsets))
                hashes = np.insert(words.hash, words.bounds[1:], np.uint64(END)).view(np.int64)
                at = np.minimum(find(hashes), max(0, len(keys) - 1))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                part = np.r_[0.0, np.cumsum(np.where(hit, logs[at] if len(keys) else 0.0, 0.0))]
                known = np.r_[0, np.cumsum(hit)]
                rare = [hashes[a:b][~hit[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
                total = score_texts(model, data, offsets)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.diff(bounds)), pa.array(known[bounds[1:]] - known[bounds[:-1]]),
                    pa.array(part[bounds[1:]] - part[bounds[:-1]]), pa.array(total / np.log(10)), pa.array(np.diff(offsets)), list_array(rare, pa.int64()),
                ], names=["doc_id", "n_tokens", "known", "part", "score", "n_bytes", "rare"])

    scored = docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, part double, score double, n_bytes long, rare array<long>")
    scored = scratch.settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = vocabulary.where(F.col("n") < least)
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    n = F.coalesce("n", F.lit(0))
    rare = rare.join(rest, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((n + 0.5) / F.lit(float(below)))).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    out = scored.drop("rare").join(rare, "row", "left")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.col("n_bytes") / F.lit(float(np.log10(2)))).alias("bits_per_byte"),
    )
