"""Language identification by language-bitmask n-gram filters.

Learning counts n-grams of bytes (letters in lower case, everything else a blank) per language over all labelled
training rows. An n-gram belongs to each language whose share of it is at least ``ratio`` of the largest share, if that
is at least ``least``; so a language has at most ``1/least`` n-grams at any corpus size, which bounds the model.

A bit-sliced Bloom filter keeps them: position i holds a mask with one bit per language. A look-up ANDs the masks at
``hashes`` positions and returns all languages that contain the n-gram. A text's n-grams are counted per language by
these bits, corrected for false positives: with a share f of language l's bits set, f**hashes of foreign n-grams
pass, so the share of own n-grams is (hits - f**hashes) / (1 - f**hashes). The largest corrected share decides; ties go
to the language with more training text, then by name. Languages beyond 64 use further mask words.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned. Rows without
a language teach nothing; rows without a doc_id count as doc_id ''. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from telvane.llm.common import mix, ship, shipped, text_parts

GRAM = 4
#: Blank for all ASCII bytes but letters.
FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def held_out(key: Column, parts: int = 3, part: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all texts, each text set between blanks, and the bounds of each text's codes."""
    n, texts = len(data), len(offsets) - 1
    padded = np.full(n + 2 * texts, 32, np.uint8)
    shift = np.repeat(2 * np.arange(texts) + 1, np.diff(offsets))
    padded[np.arange(n) + shift] = FOLD[data]
    bounds = offsets + 2 * np.arange(texts + 1)
    if len(padded) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
    m = len(padded) - GRAM + 1
    codes = np.zeros(m, np.uint32)
    for i in range(GRAM):
        codes = (codes << np.uint32(8)) | padded[i : i + m]
    # within one text, with a letter in the middle, so that runs of blanks carry no vote
    text = np.repeat(np.arange(texts), np.diff(bounds))
    good = (text[:m] == text[GRAM - 1 :]) & ((padded[1 : m + 1] != 32) | (padded[2 : m + 2] != 32))
    return codes[good], np.r_[0, np.cumsum(good)][np.minimum(bounds, m)]


def lower(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(batch.column("text"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) partial counts of each task; rows: lang, text."""

    def merge(keys, counts):
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return [keys[at]], [np.add.reduceat(counts, at)]

    def run(batches):
        names: dict[str, int] = {}
        keys, counts = [], []
        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.uint64)
            for i, j, data, offsets in text_parts(lower(batch)):
                codes, bounds = grams(data, offsets)
                own = np.repeat(langs[i:j], np.diff(bounds))
                k, c = np.unique((own << np.uint64(32)) | codes.astype(np.uint64), return_counts=True)
                keys.append(k)
                counts.append(c)
            if keys and sum(map(len, keys)) > 4_000_000:
                keys, counts = merge(keys, counts)
        if keys:
            (k,), (c,) = merge(keys, counts)
            listed = pa.array(list(names), pa.string())
            for a in range(0, len(k), 1 << 18):
                part = k[a : a + (1 << 18)]
                lang = listed.take(pa.array((part >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c[a : a + (1 << 18)].astype(np.int64))], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long")


@dataclass
class LanguageModel:
    """Languages by falling training size, masks of each filter position, and the false-positive rate of each language."""

    languages: list[str]
    masks: np.ndarray
    passing: np.ndarray
    hashes: int


def places(codes: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    h = mix(codes.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(hashes)]


def learn(rows: DataFrame, ratio: float = 0.5, least: float = 2e-6, hashes: int = 3, per_gram: int = 16) -> LanguageModel:
    """The model of labelled rows (lang, text)."""
    counts = gram_counts(rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    counts = counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")).persist()
    totals = sorted(((r["n"], r["lang"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    languages = [lang for _, lang in totals]
    size = F.create_map(*[F.lit(x) for n, lang in totals for x in (lang, float(n))]) if totals else F.lit(None)
    if totals:
        shares = counts.withColumn("share", F.col("n") / size[F.col("lang")])
        by_gram = shares.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("all")).where(F.col("best") >= least)
        held = by_gram.select("gram", F.explode("all").alias("x"), "best").where(F.col("x.share") >= ratio * F.col("best")).select("gram", F.col("x.lang").alias("lang")).toPandas()
    else:
        held = None
    counts.unpersist()
    words = max(1, -(-len(languages) // 64))
    positions = 1024
    while held is not None and positions < per_gram * max(1, held["gram"].nunique()):
        positions *= 2
    masks = np.zeros((positions, words), np.uint64)
    if held is not None:
        codes = held["gram"].to_numpy(np.int64)
        number = held["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
        bit = np.uint64(1) << (number % 64).astype(np.uint64)
        for at in places(codes, positions, hashes):
            np.bitwise_or.at(masks, (at, number // 64), bit)
    fill = np.array([np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64))) / positions for i in range(len(languages))])
    return LanguageModel(languages, masks, fill**hashes, hashes)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def classify(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    codes, bounds = grams(data, offsets)
    n = np.diff(bounds)
    share = np.zeros((len(n), len(model.languages)))
    for word in range(model.masks.shape[1]):
        masks = model.masks[:, word]
        found = None
        for at in places(codes, len(masks), model.hashes):
            found = masks[at] if found is None else found & masks[at]
        for i in range(64 * word, min(64 * word + 64, len(model.languages))):
            hits = np.r_[0, np.cumsum((found >> np.uint64(i % 64)) & np.uint64(1))]
            hits = (hits[bounds[1:]] - hits[bounds[:-1]]) / np.maximum(n, 1)
            share[:, i] = np.clip((hits - model.passing[i]) / max(1e-9, 1 - model.passing[i]), 0, 1)
    letters = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    letters = np.r_[0, np.cumsum(letters)]
    letters = letters[offsets[1:]] > letters[offsets[:-1]]
    names, score = [], np.zeros(len(n))
    for i in range(len(n)):
        if not model.languages or not (letters[i] or has_letter(data[offsets[i] : offsets[i + 1]].tobytes())):
            names.append("und")
        else:
            best = int(np.argmax(share[i]))
            names.append(model.languages[best])
            score[i] = share[i, best]
    return names, score


def identify(docs: DataFrame, model: LanguageModel, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score (names after ``prefix``); columns of those names are replaced."""
    shared = ship(docs.sparkSession, model)
    added = [f"{prefix}lang_pred", f"{prefix}score"]
    docs = docs.drop(*added)
    schema = StructType(docs.schema.fields + [StructField(added[0], StringType()), StructField(added[1], DoubleType())])

    def run(batches):
        model = shipped(shared)
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in text_parts(lower(batch)):
                a, b = classify(model, data, offsets)
                names += a
                scores.append(b)
            extra = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            yield pa.RecordBatch.from_arrays(batch.columns + extra, names=batch.schema.names + added)

    return docs.mapInArrow(run, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is known: not ``und``, and at least ``least`` of the n-grams are the language's own."""
    model = learn(docs)
    return identify(docs, model, "__").where((F.col("__lang_pred") != "und") & (F.col("__score") >= least)).select(*docs.columns)
