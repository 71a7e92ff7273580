"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is measured: letters per word, symbols per thousand words, repeated lines per thousand lines, and words in
repeated five-word windows per thousand words. A sketch counts values per bucket: exact below 32, then 16 buckets per
power of two, so a quantile is off by at most a sixteenth. Sketches merge by adding counts: they are gathered per
(language, source), and added up to languages and to the whole corpus for groups below ``least`` documents.

A text is kept if it passes the base rule and each measure stays below q75 + 3 max(q75 - q25, slack) of its group;
letters per word also above q25 - 3 max(q75 - q25, slack). Texts that fail the base rule are not sketched.

Null and empty texts have no words and fail the base rule. A null language or source is a group of its own. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from telvane.llm.common import BYTE, Scratch, Words, checked_broadcast, mix, null_safe, powers, text_parts

SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Measure, slack of its threshold, whether low values are odd too.
MEASURES = [("word_length", 100, True), ("symbols", 50, False), ("dup_lines", 100, False), ("repeats", 50, False)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def line_counts(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of each text."""
    texts, n = len(offsets) - 1, len(data)
    if not n:
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    begins = np.zeros(n, bool)
    begins[1:] = data[:-1] == 10
    begins[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(begins)
    lengths = np.diff(np.append(start, n))
    value = BYTE[data] * powers(int(lengths.max()))[np.arange(n) - np.repeat(start, lengths)]
    value[data == 10] = 0
    h = mix(np.add.reduceat(value, start))
    has_word = np.add.reduceat(solid.astype(np.int64), start) > 0
    text = np.searchsorted(offsets, start, "right") - 1
    h, text = h[has_word], text[has_word]
    order = np.lexsort((h, text))
    h, t = h[order], text[order]
    again = np.r_[False, (h[1:] == h[:-1]) & (t[1:] == t[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(t, minlength=texts), np.bincount(t[again], minlength=texts)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    docs = docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    names = docs.columns[:-1]
    schema = StructType(docs.schema.fields[:-1] + [StructField(c, LongType()) for c in COUNTS])

    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in text_parts(batch.column("text")):
                words = Words(data, offsets, lower=False)
                hashes, inside = words.shingles(5)
                covered = np.zeros(len(words.hash) + 1, np.int64)
                if len(hashes):
                    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))[: len(hashes)]
                    twice = np.flatnonzero(inside)[repeated((hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))[inside])]
                    np.add.at(covered, twice, 1)
                    np.subtract.at(covered, twice + 5, 1)
                lines, again = line_counts(data, offsets, words.solid)
                parts.append([
                    np.diff(words.bounds), per_text(words.solid & ((data & 0xC0) != 0x80), offsets), per_text(SYMBOL[data], offsets),
                    again, per_text(np.cumsum(covered)[:-1] > 0, words.bounds), lines,
                ])
            counts = [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) if parts else pa.array([], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + counts, names=names + COUNTS)

    return docs.mapInArrow(run, schema)


def per_thousand(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """The bucket of a value of 0 or more; numbers rise with values."""
    power = F.length(F.bin(v)) - 1
    return F.when(v < 32, v).otherwise(16 * (power - 5) + F.floor(v / F.pow(F.lit(2.0), power - 4)).cast("long") + 16)


def bucket_value(b: Column) -> Column:
    """The smallest value of a bucket."""
    power = F.floor((b - 32) / 16) + 5
    return F.when(b < 32, b).otherwise(((F.pmod(b - 32, F.lit(16)) + 16) * F.pow(F.lit(2.0), power - 4))).cast("long")


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q25 and q75 of each group and measure, and the group's documents; one pass over at most a few hundred buckets each."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(by))
    value = bucket_value(F.col("bucket"))
    pick = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * i, value)).alias(f"q{25 * i}") for i in (1, 3)]
    return ranked.groupBy(*keys, "measure").agg(F.first("total").alias("docs"), *pick)


def limits(q: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Thresholds of each group in one row."""
    columns = []
    for name, slack, two_sided in MEASURES:
        own = F.col("measure") == name
        spread = 3 * F.greatest(F.col("q75") - F.col("q25"), F.lit(slack))
        columns.append(F.max(F.when(own, F.col("q75") + spread)).alias(f"{name}_high{suffix}"))
        if two_sided:
            columns.append(F.max(F.when(own, F.col("q25") - spread)).alias(f"{name}_low{suffix}"))
    return q.groupBy(*keys).agg(*columns)


def judge(docs: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source)."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.settle(
        measure(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("word_length", F.when(F.col("n_words") > 0, F.floor(100 * F.col("word_chars") / F.col("n_words"))).otherwise(0).cast("long"))
        .withColumn("symbols", per_thousand("n_symbols", "n_words"))
        .withColumn("dup_lines", per_thousand("n_dup_lines", "n_lines"))
        .withColumn("repeats", per_thousand("n_repeat_words", "n_words")),
        "rows",
    )
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m, _, _ in MEASURES])).alias("x")
    sketch = rows.where("not base_failed").select("lang", "source", values).select("lang", "source", "x.measure", bucket(F.col("x.value")).alias("bucket"))
    sketch = scratch.settle(sketch.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")), "sketch")
    own = checked_broadcast(scratch.settle(limits(quartiles(sketch, ["lang", "source"]).where(F.col("docs") >= least), ["lang", "source"], ""), "own"), weight=F.lit(128))
    wide = checked_broadcast(scratch.settle(limits(quartiles(sketch, ["lang"]).where(F.col("docs") >= least), ["lang"], "_lang"), "wide"), weight=F.lit(128))
    whole = limits(quartiles(sketch.withColumn("all", F.lit(1)), ["all"]), [], "_all")  # one row
    judged = null_safe(null_safe(rows, own, ["lang", "source"], "left"), wide, ["lang"], "left").join(F.broadcast(whole), how="left")
    good = ~F.col("base_failed")
    for name, _, two_sided in MEASURES:
        limit = lambda side: F.coalesce(f"{name}_{side}", f"{name}_{side}_lang", f"{name}_{side}_all")
        good = good & F.coalesce(F.col(name) <= limit("high"), F.lit(True))
        if two_sided:
            good = good & F.coalesce(F.col(name) >= limit("low"), F.lit(True))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", good.alias("kept"))
