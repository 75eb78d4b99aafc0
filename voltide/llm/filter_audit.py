"""Interaction of filters, audited by an incremental stream with retractions.

The files of a table are processed as available-now micro-batches. Each document becomes a bit mask of the filters that it fails, and
counters by part and mask say all about any order of the filters. Whether a document repeats an earlier one depends on all
others: a keyed state holds, for each text, the smallest id seen so far and the counters of its documents. Every document is counted
as a repetition but for those that hold the smallest id; when a smaller id arrives, what was counted for the former holder is retracted.

A micro-batch writes its part of the state and of the counters into folders of its own, which a repetition overwrites, so every file
counts exactly once whatever is lost on the way.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.session import materialise, scratch_path

#: Filters in the order of their bits. The last one is the repetition of a text, which a mask gets from the state.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Micro-batches of the table, and micro-batches after which the state is written anew in one piece.
BATCHES, COMPACT = 4, 8

WORD = r"[^\x20\x09-\x0D]+"
_KEYS = ("part", "good", "toxic", "mask")
STATE = "text_key binary, id {id}, part string, good boolean, toxic boolean, mask int, n long"
COUNTS = "part string, good boolean, toxic boolean, mask int, n long"


def content_mask(text: Column) -> Column:
    """Bits of the filters that need nothing but the text, which must not be null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }
    return sum((F.when(failed[name], 1 << k).otherwise(0) for k, name in enumerate(FILTERS) if name in failed), F.lit(0)).cast("int")


def described(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A slim row per document: ``text_key`` (256 bits), ``id``, ``part`` and ``mask``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col), F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), F.col(id_col).alias("id"), part.alias("part"), content_mask(text).alias("mask"))


def least_holders(rows: DataFrame) -> DataFrame:
    """Of rows ``text_key, id, part, good, toxic, mask, n`` those with the smallest id of their text, equal ones added up."""
    least = rows.groupBy("text_key").agg(F.min("id").alias("id"))
    return rows.join(least, ["text_key", "id"]).groupBy("text_key", "id", *_KEYS).agg(F.sum("n").alias("n"))


class RetractingCounters:
    """State and counters of ``described`` rows below ``path``, a folder per micro-batch. ``labels`` (``_of, good, toxic``) has one row per id."""

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame, id_type: str, compact: int = COMPACT):
        self.spark, self.path, self.labels, self.compact = spark, path, labels, compact
        self.schemas = {"state": STATE.format(id=id_type), "base": STATE.format(id=id_type), "counts": COUNTS}

    def _read(self, kind: str, batches: range) -> DataFrame:
        return self.spark.read.schema(self.schemas[kind]).parquet(*[f"{self.path}/{kind}/batch={k}" for k in batches])

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.select(*T.StructType.fromDDL(self.schemas[kind]).names).write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def _before(self, batch: int) -> DataFrame:
        """The holders of each text before a batch, with those they have replaced since the state was last written in one piece."""
        start = (batch - 1) // self.compact * self.compact
        logs = self._read("state", range(start, batch))
        return logs.union(self._read("base", range(start, start + 1))) if start else logs

    def add(self, rows: DataFrame, batch: int) -> None:
        """Counts ``described`` rows. All is derived from earlier batches, so a repeated batch writes the same again."""
        known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
        rows = rows.join(self.labels, rows["id"] == self.labels["_of"], "left").select("text_key", "id", "part", "mask", *known, F.lit(1).cast("long").alias("n"))
        rows = materialise(rows, f"audited-{batch}")
        named = F.col("id").isNotNull()
        # A text held by a third of all rows costs a few rows per task: all its rows are counted as repetitions where they are read.
        every = rows.withColumn("mask", F.when(named, F.col("mask").bitwiseOR(REPEATED)).otherwise(F.col("mask")).cast("int"))
        holders = materialise(least_holders(rows.where(named)), f"holders-{batch}")
        if batch == 0:
            new, retracted = holders, holders.limit(0)
        else:
            state = self._before(batch)
            if batch % self.compact == 0:
                self._write(least_holders(state), "base", batch)
                state = self._read("base", range(batch, batch + 1))
            arrived = holders.select("text_key", F.col("id").alias("_new")).distinct()
            former = materialise(least_holders(state.join(arrived.select("text_key"), "text_key", "left_semi")), f"former-{batch}")
            old = former.select("text_key", F.col("id").alias("_old")).distinct()
            new = holders.join(old, "text_key", "left").where(F.col("_old").isNull() | (F.col("id") <= F.col("_old"))).drop("_old")
            retracted = former.join(arrived, "text_key").where(F.col("_new") < F.col("id")).drop("_new")
        self._write(new, "state", batch)
        total = every.select(*_KEYS, "n")
        for moved in (*_moved(self._read("state", range(batch, batch + 1)), 1), *_moved(retracted, -1)):
            total = total.unionByName(moved.select(*_KEYS, "n"))
        self._write(total.groupBy(*_KEYS).agg(F.sum("n").alias("n")), "counts", batch)

    def counters(self) -> DataFrame:
        """``part, good, toxic, mask, n`` over all batches, the zeros left out."""
        self._write(self.spark.createDataFrame([], COUNTS), "counts", -1)  # so that there is one to read
        counts = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts")
        return counts.groupBy(*_KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def _moved(holders: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """Counters that make holders of their text out of repetitions (1), or the other way round (-1)."""
    n = F.col("n")
    return holders.withColumn("n", n * sign), holders.withColumn("n", n * -sign).withColumn("mask", F.col("mask").bitwiseOR(REPEATED).cast("int"))


def stream_counters(
    spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    files_per_batch: int | None = None, compact: int = COMPACT, folder: str | None = None,
) -> DataFrame:
    """``part, good, toxic, mask, n`` of the documents in the Parquet table at ``path``, each file once, in micro-batches.

    Without ``files_per_batch`` the files are dealt into ``BATCHES`` micro-batches, so the state is joined as often for any size of
    table. State, counters and the stream's checkpoint lie in ``folder``, a fresh one below the shared folder of the session if none is
    given; a run that was interrupted goes on from there.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    # A stream takes a folder or a pattern, not the path of a file.
    pattern = f"{path[:-1]}[{path[-1]}]" if [f.rpartition("/")[2] for f in files] == [path.rpartition("/")[2]] else path
    folder = folder or scratch_path(spark, "filter-audit")
    counting = RetractingCounters(spark, folder, labels, dict(table.dtypes)[id_col], compact)

    def merge(docs: DataFrame, batch: int) -> None:
        rows = described(docs, id_col, text_col, part_col)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        # Read by the session of the caller, for that of a stream plans without adaptive execution.
        counting.add(spark.read.schema(rows.schema).parquet(f"{folder}/rows/batch={batch}"), batch)

    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch or max(1, -(-len(files) // BATCHES))).parquet(pattern)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return counting.counters()


def interactions(counters: DataFrame) -> DataFrame:
    """The audit from ``part, good, toxic, mask, n``: a row per part, order of the filters and step; see ``filter_audit``."""
    n, bits = F.col("n"), range(len(FILTERS))
    by_mask = counters.groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )
    steps = [
        {"filter_order": "".join(FILTERS[k] for k in order), "step": step + 1, "before": sum(1 << k for k in order[:step]), "bit": 1 << order[step]}
        for order in permutations(bits) for step in bits
    ]
    kinds = "array<struct<filter_order: string, step: int, before: int, bit: int>>"
    each = by_mask.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kinds)))
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    orders = len(list(permutations(bits)))

    def total(condition: Column, value: str | Column = "n") -> Column:
        return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long")

    # In an equal share of all orders each filter that a document fails is the first of those.
    share = n * F.expr(f"{orders} div bit_count(mask)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails).alias("kept"), total(~earlier & fails).alias("removed"), total(earlier & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(~earlier & fails, "good").alias("good_lost"),
        total(~earlier & fails, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def filter_audit(
    spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    files_per_batch: int | None = None, compact: int = COMPACT, folder: str | None = None,
) -> DataFrame:
    """Per part, each of the 120 orders of the five filters and each step 1 to 5: ``part, filter_order, step`` and seven counts (long).

    ``kept`` after the step, ``removed`` in it, ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing no other),
    ``good_lost`` and ``toxic_lost`` (removed here and labelled so), ``shapley`` (removed by the step's filter, summed over all orders).

    ``labels`` (``doc_id, quality, toxic``) may repeat an id: it is good, or toxic, if one of its rows says so; null ids label nothing.
    Null texts and parts count as empty. A document repeats another if that has the same text (by a 256-bit digest) and a smaller id, so
    of rows with equal id and text none repeats the other, and rows without id neither repeat nor are repeated. An empty table gives an
    empty result. Other columns don't matter. Memory follows the longest text.
    """
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False))) for c in ("quality", "toxic"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(good.alias("good"), toxic.alias("toxic"))
    known = materialise(known, "known-labels")
    return interactions(stream_counters(spark, path, known, id_col, text_col, part_col, files_per_batch, compact, folder))
