"""Phrase collocations mined from stripes.

A stripe is a prefix with an associative counter of the words that follow it. Texts are split into pieces, and every
batch of words is turned into stripes in the task that reads it; stripes of one prefix are then merged elementwise.
The merged stripe yields everything at once: the counts of the phrases that extend the prefix by one word, the
prefix's own count (the sum over its counter, where ``OTHER`` collects ends of pieces and followers that cannot
matter), and the largest extension, which decides whether a longer phrase subsumes the prefix.

Prefixes grow level by level, as no phrase is more frequent than its parts: the words of at least ``least``
occurrences (level 0) are the prefixes of level 1, the pairs found there those of level 2, and so on up to
``longest``. A bitmap of the ids kept on the level before lets tasks skip the rest; it has no misses, and what it lets
through by chance is dropped when counts are exact. Its size is bounded, so beyond some 8 million ids it only skips
less.

A prefix may hold a large share of all words. One with more than 1/4096 of them, so at most 4,096 of a level, is cut
by its followers' hashes into segments of that share; each segment merges alone, and the parts' sums are added.
Merging streams through rows in prefix order and holds one segment.

For every candidate, cuts after each word are compared by exact decimals. Every language counts for itself (null and
``und`` are one); ids of words hold the language. Words and phrases are told apart by 64-bit hashes. Null and empty
texts have no words; equal rows are separate documents; columns other than text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telvane.llm.common import BYTE, LOWER, Scratch, checked_broadcast, mix, powers, text_parts

BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
BLANK = np.isin(np.arange(256), [9, 32])
#: The follower that stands for ends of pieces and for followers that cannot matter.
OTHER = 0
#: Words that are turned into stripes at once; share of all words above which a prefix is cut; largest bitmap.
BATCH, SHARE, BITS = 1 << 20, 4096, 1 << 27
STEP = np.uint64(0xA0761D6478BD642F)


def phrase_id(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The id of a phrase from that of its words but the last, and that of the last word; never ``OTHER``."""
    h = mix(prefix * STEP + mix(word))
    return np.where(h == OTHER, np.uint64(1), h)


class Tokens:
    """Words of texts laid end to end: id, first and last byte, and the piece each lies in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        n = len(data)
        stop = BREAK[data]
        solid = ~(stop | BLANK[data])
        inner = offsets[:-1][offsets[:-1] < n]
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        before[inner] = True
        self.start = np.flatnonzero(solid & before)
        after = np.ones(n, bool)
        after[:-1] = before[1:] | ~solid[1:]
        self.end = np.flatnonzero(solid & after) + 1
        text = np.searchsorted(offsets, self.start, "right") - 1
        # Pieces are numbered by the breaks and texts before them.
        self.piece = np.cumsum(stop, dtype=np.int64)[self.start] + text if n else np.zeros(0, np.int64)
        self.id = np.zeros(0, np.uint64)
        if len(self.start):
            first = self.start[0]
            lengths = np.diff(np.append(self.start, n))
            place = np.arange(n - first) - np.repeat(self.start - first, lengths)
            value = BYTE[LOWER[data[first:]]] * powers(int(lengths.max()))[place]
            value[~solid[first:]] = 0
            self.id = phrase_id(mix(np.add.reduceat(value, self.start - first)), langs[text])


def hash_text(text: str) -> np.uint64:
    data = np.frombuffer(text.encode(), np.uint8)
    return mix(np.array([(BYTE[data] * powers(len(data))).sum() + np.uint64(len(data))], np.uint64))[0]


def tokens_of(batches) -> Iterator[tuple[list[str], list[tuple[np.ndarray, Tokens, np.ndarray]]]]:
    """Language names, and parts (bytes, words, language of each word) of about ``BATCH`` words together."""
    names: dict[str, int] = {}
    parts, held = [], 0
    for batch in batches:
        coded = pc.fill_null(batch.column("lang").cast(pa.string()), "und").dictionary_encode()
        own, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        place = np.array([names.setdefault(x, len(names)) for x in own], np.int64)
        hashed = np.array([hash_text(x) for x in own], np.uint64)
        for i, j, data, offsets in text_parts(batch.column("text")):
            words = Tokens(data, offsets, hashed[codes[i:j]])
            text = np.searchsorted(offsets, words.start, "right") - 1
            parts.append((data, words, place[codes[i:j]][text]))
            held += len(words.id)
            if held >= BATCH:
                yield list(names), parts
                parts, held = [], 0
    if held:
        yield list(names), parts


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, id, word, f) of all words: the stripes of the empty prefix, each cut down to single followers."""

    def run(batches):
        for names, parts in tokens_of(batches):
            out = [[], [], [], []]
            for data, words, lang in parts:
                ids, first, f = np.unique(words.id, return_index=True, return_counts=True)
                text = LOWER[data].tobytes()
                out[0] += [names[x] for x in lang[first].tolist()]
                out[1].append(ids)
                out[2] += [text[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
                out[3].append(f)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), longs(np.concatenate(out[1])), pa.array(out[2], pa.string()), longs(np.concatenate(out[3]))],
                names=["lang", "id", "word", "f"],
            )

    rows = docs.mapInArrow(run, "lang string, id long, word string, f long")
    return rows.groupBy("lang", "id", "word").agg(F.sum("f").alias("f"))


def bitmap(ids: DataFrame, count: int) -> np.ndarray:
    """Which of 2**k slots hold an id: 16 slots an id, at most ``BITS``. Only its 64-bit words reach the driver."""
    k = int(np.clip(np.ceil(np.log2(max(1, count))) + 4, 10, np.log2(BITS)))
    slot = F.shiftrightunsigned("id", 64 - k)
    words = ids.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(id, {64 - k}) & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (k - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def segments(prefix: np.ndarray, follower: np.ndarray, large: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The segment of each entry: the top bits of the follower's hash, as many as a large prefix needs, else 0."""
    at = np.searchsorted(large, prefix)
    at[at == len(large)] = 0
    if not len(large):
        return np.zeros(len(prefix), np.int64)
    deep = np.where(large[at] == prefix, depth[at], 0)
    return np.where(deep > 0, mix(follower) >> (np.uint64(64) - np.maximum(deep, 1).astype(np.uint64)), 0).astype(np.int64)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins; equal combinations are neighbours."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return np.flatnonzero(new)


def lists(bounds: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    at = pa.array(bounds.astype(np.int32))
    return [pa.ListArray.from_arrays(at, longs(c)) for c in columns]


def stripes(docs: DataFrame, level: int, prefixes, words, large: np.ndarray, depth: np.ndarray) -> DataFrame:
    """Stripes of prefixes of ``level`` words, one per prefix, segment and batch of words.

    ``prefixes``, ``words``: broadcast bitmaps of the ids of phrases of ``level`` words and of single words kept so far.
    A follower counts for itself only if it and the phrase of ``level`` words that it ends are kept as well. ``tail`` is
    the prefix without its first word.
    """

    def run(batches):
        kept, single = prefixes.value, words.value
        for _, parts in tokens_of(batches):
            found = [], [], []
            for _, tokens, _ in parts:
                ids, n = tokens.id, len(tokens.id) - level + 1
                if n < 1:
                    continue
                phrase, tail = ids, np.zeros(len(ids), np.uint64)
                for i in range(1, level):  # the phrases that start at each word
                    tail = phrase[1:]
                    phrase = phrase_id(phrase[:-1], ids[i:])
                start = np.flatnonzero((tokens.piece[:n] == tokens.piece[level - 1 :]) & holds(kept, phrase))
                after = np.minimum(start + level, len(ids) - 1)
                good = (start + level < len(ids)) & (tokens.piece[start] == tokens.piece[after])
                good &= holds(single, ids[after]) & holds(kept, phrase[np.minimum(start + 1, n - 1)])
                for to, x in zip(found, (phrase[start], np.where(good, ids[after], np.uint64(OTHER)), tail[start])):
                    to.append(x)
            if not found[0]:
                continue
            prefix, follower, tail = (np.concatenate(x) for x in found)
            _, first, f = np.unique(phrase_id(prefix, follower), return_index=True, return_counts=True)
            prefix, follower, tail = prefix[first], follower[first], tail[first]
            segment = segments(prefix, follower, large, depth)
            order = np.lexsort((segment, prefix))
            prefix, segment, follower, tail, f = (x[order] for x in (prefix, segment, follower, tail, f))
            first = starts(prefix, segment)
            yield pa.RecordBatch.from_arrays(
                [longs(x[first]) for x in (prefix, segment, tail)] + lists(np.append(first, len(f)), follower, f), names=["prefix", "segment", "tail", "followers", "counts"]
            )

    return docs.mapInArrow(run, "prefix long, segment long, tail long, followers array<long>, counts array<long>")


def merge_stripes(rows: DataFrame, level: int, least: int) -> DataFrame:
    """Per prefix and segment: its count, its largest extension, and its followers of at least ``least``.

    ``ids`` are the extended phrases, ``tails`` those without their first word.
    """

    def flat(batch):
        followers = batch.column("followers")
        at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(followers).to_numpy(zero_copy_only=False))
        whole = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("prefix", "segment", "tail")]
        return [*whole, followers.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False)]

    def emit(prefix, segment, tail, follower, f):
        first = starts(prefix, segment)
        keep = (f >= least) & (follower != OTHER)
        upto = np.r_[0, np.cumsum(keep)][np.append(first, len(f))]
        heads, ends, rests = (x[keep].view(np.uint64) for x in (prefix, follower, tail))
        extended = lists(upto, follower[keep], f[keep], phrase_id(heads, ends), ends if level == 1 else phrase_id(rests, ends))
        counts = np.add.reduceat(f, first), np.maximum.reduceat(np.where(follower == OTHER, 0, f), first)
        return pa.RecordBatch.from_arrays([longs(x) for x in (prefix[first], *counts)] + extended, names=["prefix", "total", "best", "followers", "counts", "ids", "tails"])

    def run(batches):
        held = None
        for batch in batches:
            parts = flat(batch)
            if held is not None:
                parts = [np.concatenate(x) for x in zip(held, parts)]
            prefix, segment, tail, follower, f = parts
            if not len(f):
                continue
            order = np.lexsort((follower, segment, prefix))
            parts = [x[order] for x in parts]
            first = starts(parts[0], parts[1], parts[3])
            prefix, segment, tail, follower = (x[first] for x in parts[:4])
            f = np.add.reduceat(parts[4], first)
            # The last segment may go on in the next batch.
            last = starts(prefix, segment)[-1]
            held = [x[last:] for x in (prefix, segment, tail, follower, f)]
            if last:
                yield emit(*(x[:last] for x in (prefix, segment, tail, follower, f)))
        if held is not None:
            yield emit(*held)

    ordered = rows.repartition("prefix", "segment").sortWithinPartitions("prefix", "segment")
    return ordered.mapInArrow(run, "prefix long, total long, best long, followers array<long>, counts array<long>, ids array<long>, tails array<long>")


def large_prefixes(counted: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with more than 1/SHARE of all words, in order, and how often each is to be halved: at most SHARE rows."""
    rows = counted.where(F.col("f") > max(1, words // SHARE)).select("id", "f").toArrow()
    ids, f = rows["id"].to_numpy().view(np.uint64), rows["f"].to_numpy()
    order = np.argsort(ids)
    return ids[order], np.ceil(np.log2(f[order] * (SHARE / max(1, words)))).astype(np.int64).clip(1, 12)


def cut_scores(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) of each cut, exact to 38 digits."""
    one = f"bigint((cast({a} as decimal(18,0)) * {a} * 1000000) div (cast(l as decimal(18,0)) * r))"
    return F.expr(f"zip_with({left}, {right}, (l, r) -> {one})")


def mine_phrases(docs: DataFrame, longest: int = 3, least: int = 10, subsumed: int = 50) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of 2 to ``longest`` words with a >= ``least`` occurrences.

    l and r are those of the lowest-scoring cut. Phrases inside one of a word more with at least ``subsumed`` percent
    of their occurrences are left out; longer phrases need no look, as they are no more frequent.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = scratch.settle(count_words(docs), "words")
    sizes = scratch.settle(counted.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    none = F.array().cast("array<long>")
    phrases = scratch.settle(
        counted.where(F.col("f") >= least).select("id", "lang", F.col("word").alias("phrase"), "f", none.alias("lefts"), none.alias("rights")), "phrases"
    )
    scratch.drop(counted)
    words, out = None, []
    for level in range(1, longest):
        bits = spark.sparkContext.broadcast(bitmap(phrases, phrases.count()))
        words = words or bits
        merged = scratch.settle(merge_stripes(stripes(docs, level, bits, words, *large_prefixes(phrases, total)), level, least).where(F.col("total") > 0), "stripes")
        heads = merged.groupBy(F.col("prefix").alias("id")).agg(F.sum("total").alias("total"), F.max("best").alias("best"))
        whole = scratch.settle(phrases.join(heads, "id"), "prefixes")
        longer = merged.where(F.size("ids") > 0).select(F.col("prefix").alias("head"), F.inline(F.arrays_zip("ids", "tails", "counts")).alias("id", "tail", "f"))
        head = whole.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("start"), F.concat("lefts", F.array("total")).alias("lefts"))
        tail = whole.select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("end"), F.concat(F.array("total"), "rights").alias("rights"))
        longer = longer.join(head, "head").join(tail, "tail").select("id", "tail", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "f", "lefts", "rights")
        longer = scratch.settle(longer, "phrases")
        if level > 1:
            before = longer.groupBy(F.col("tail").alias("id")).agg(F.max("f").alias("before"))
            most = F.greatest(F.when(F.col("best") >= least, F.col("best")), F.col("before"))
            out.append(whole.join(before, "id", "left").where(most.isNull() | (100 * most < subsumed * F.col("f"))).select(*phrases.columns))
        phrases = longer.drop("tail")
        scratch.drop(merged)
    out.append(phrases)
    found = reduce(DataFrame.unionAll, out).withColumn("scores", cut_scores("f", "lefts", "rights"))
    at = F.array_position("scores", F.array_min("scores")).cast("int")
    found = found.join(checked_broadcast(sizes, F.lit(32) + F.octet_length("lang")), "lang").select(
        "lang", "phrase", (F.size("lefts") + 1).alias("words"), F.col("f").alias("a"), F.element_at("lefts", at).alias("l"), F.element_at("rights", at).alias("r"),
        "n", F.array_min("scores").alias("score"),
    )
    return found


def first_of_each(found: DataFrame, limit: int = 2000) -> DataFrame:
    """The first rows of each language by falling score and a, then phrase. Salted rounds leave no language to one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= limit)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))  # 64 x limit rows at most
    return ranked.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
