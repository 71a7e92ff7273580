"""Removal of lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z in lower case. ``LineRuns`` holds, for the documents
seen so far, in how many of them each key occurs:

* Each batch of documents becomes one run of level 0: its keys' hashes and counts, in hash order. Before that, the
  batch is merge-anti-joined with the runs of settled keys (those known to have reached ``at_least``), so that what is
  common is neither counted nor stored again.
* ``fan`` runs of a level are compacted into one run of the next level: counts of equal hashes are added. Keys that
  reach ``at_least`` go to a settled run instead.
* In the end all runs are merged once more; keys with ``at_least`` documents or more are repeated, exactly.

A batch only ever meets hashes: 16 bytes and a count for each distinct line of a document. The texts are joined with
the places of their repeated lines, one row per distinct text that has any.

Null and empty texts have one empty line. Equal rows are separate documents. A key counts once per document. Keys
below ``shortest`` code points are never removed (blank lines have an empty key). A text that loses all its lines is
empty. Keys are compared by 128 bits of hashes. Columns other than doc_id and text are ignored. Only DataFrame
operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.llm.common import Scratch, checked_broadcast

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashes(value: Column, first: str = "h1", second: str = "h2") -> list[Column]:
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(1), value).alias(second)]


def count_lines(docs: DataFrame, shortest: int = 1, by: list[Column] = ()) -> DataFrame:
    """(h1, h2, n): in how many rows each key occurs; also per value of ``by``."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    rows = docs.select(*by, F.explode(keys).alias("key")).where(F.char_length("key") >= shortest)
    names = rows.columns[:-1]
    return rows.select(*names, *hashes(F.col("key"))).groupBy(*names, *KEY).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Counted line hashes of all batches added so far."""

    def __init__(self, spark: SparkSession, at_least: int = 10, shortest: int = 1, fan: int = 2):
        self.at_least, self.shortest, self.fan = at_least, shortest, fan
        self.scratch = Scratch(spark, "lines")
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        self.add_counts(count_lines(docs, self.shortest))

    def add_counts(self, counts: DataFrame) -> None:
        """One batch's (h1, h2, n) becomes a run, less what is settled; rows of a run are in order within each part."""
        if self.settled:
            counts = counts.join(reduce(DataFrame.unionAll, self.settled).select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self.scratch.settle(counts.sortWithinPartitions(*KEY), "run"))
        level = 0
        while len(self.levels[level]) >= self.fan:
            self.compact(level)
            level += 1

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def compact(self, level: int) -> None:
        """The runs of a level become one of the next; keys that reached the threshold go to a settled run beside it."""
        rows = self.merged(self.levels[level]).withColumn("full", F.col("n") >= self.at_least)
        both = self.scratch.settle(rows.sortWithinPartitions("full", *KEY), "run", "full")
        self.settled.append(both.where("full").select(*KEY, "n"))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(both.where("not full").select(*KEY, "n"))
        self.levels[level] = []

    def repeated(self) -> DataFrame:
        """(h1, h2) of all keys in at least ``at_least`` documents so far, written out."""
        runs = [r for level in self.levels for r in level] + self.settled
        return self.scratch.settle(self.merged(runs).where(F.col("n") >= self.at_least).select(*KEY), "repeated")


def remove_lines(docs: DataFrame, repeated: DataFrame, shortest: int = 1) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped of every row; ``repeated``: (h1, h2) of keys to remove."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = F.transform(lines_of(F.col("text")), line_key)
    at = rows.select(*hashes(F.col("text"), "t1", "t2"), F.posexplode(keys).alias("at", "key")).where(F.char_length("key") >= shortest)
    at = at.select("t1", "t2", "at", *hashes(F.col("key")))
    # Equal texts have equal places: one of each is kept.
    gone = at.join(checked_broadcast(repeated), KEY, "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("gone"))
    gone = scratch.settle(gone, "gone")
    small = checked_broadcast(gone, F.lit(32) + 4 * F.size("gone"))
    # lines is read twice, so it stays a column of its own and is not split again for every place.
    joined = rows.select("*", *hashes(F.col("text"), "t1", "t2")).join(small, ["t1", "t2"], "left").select("doc_id", "text", "gone", lines_of(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, at_least: int = 10, shortest: int = 1, batches: int = 4, fan: int = 2) -> DataFrame:
    """``docs`` (doc_id, text) without the lines found in ``at_least`` documents; added to the runs in ``batches`` parts.

    The table is read once for all batches: its lines are counted per batch, and each batch reads its own folder.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    counted = count_lines(docs, shortest, [batch])
    counts = scratch.settle(counted, "counts", "batch")
    runs = LineRuns(docs.sparkSession, at_least, shortest, fan)
    for i in range(batches):
        runs.add_counts(counts.where(F.col("batch") == i).select(*KEY, "n"))
    scratch.drop(counts)
    return remove_lines(docs, runs.repeated(), shortest)
