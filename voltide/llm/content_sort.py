"""Exact deduplication by content sort.

Sampled splitters deal the rows out by the bytes of their text, the rows of a partition are sorted by those bytes, and each text is
compared in full with its neighbour. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.session import materialise

#: Characters of a text that take part in a splitter. Longer common beginnings are told apart by a hash of the whole text, so what
#: the driver samples stays small however long the texts are.
SPLITTER_CHARS = 16
#: A content with fewer rows than this is never spread over several sort runs.
LEAST_HOT = 100


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256`` (and ``row`` with all its columns if ``carry``).

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest (or ``smallest``) id
    stays. A null id loses against every other; of rows that also share their id exactly one is kept. An empty table gives an empty
    result. Input columns of any name are possible, for they travel inside ``row``.

    A content that holds more than a quarter of an average partition is cut in slices by a hash of the id. Each slice is sorted like
    the others; one full comparison of the slices' first rows then joins them. There are at most 8 slices for each shuffle
    partition, which bounds what is broadcast.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = {"largest": True, "smallest": False}[keep]
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *([F.struct("*").alias("_row")] if carry else [])
    ).withColumn("_hash", F.xxhash64("_text"))

    slice_rows = max(LEAST_HOT, -(-docs.count() // (4 * partitions)))
    hot = (
        rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
        .select("_hash", F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))
    )
    ranged = (
        rows.join(F.broadcast(hot), "_hash", "left")
        .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_slices")).cast("int"), F.lit(0)))
        .withColumn("_start", F.substring("_text", 1, SPLITTER_CHARS))
        .repartitionByRange(partitions, "_start", "_hash", "_slice")
    )
    # The sort runs: (start, hash, slice) is how the rows were dealt out, so no window below moves a row again.
    order = F.desc_nulls_last("_id") if largest else F.asc_nulls_last("_id")
    sorted_run = Window.partitionBy("_start", "_hash", "_slice").orderBy("_text", order)
    equal_run = Window.partitionBy("_start", "_hash", "_slice", "_text").orderBy(order)
    whole = equal_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        ranged.withColumn("_first", ~F.lag("_text").over(sorted_run).eqNullSafe(F.col("_text")))
        .withColumn("_head", F.first("_id").over(whole))
        .withColumn("_size", F.count(F.lit(1)).over(whole))
        .select(
            "_id", "_hash", "_slice", "_slices", "_first", "_head", "_size", F.sha2("_text", 256).alias("_sha"),
            F.when(F.col("_first") & F.col("_slices").isNotNull(), F.col("_text")).alias("_slice_text"),
            *([F.when(F.col("_first"), F.col("_row")).alias("_row")] if carry else []),
        )
    )
    runs = materialise(runs, "content-runs")

    # First rows of the slices of one content, compared in full; at most 8 of them for each shuffle partition.
    best = F.max("_head") if largest else F.min("_head")
    heads = runs.where(F.col("_slice_text").isNotNull()).select("_hash", "_slice", "_slice_text", "_head", "_size")
    joined = heads.groupBy("_hash", "_slice_text").agg(best.alias("_keep"), F.sum("_size").alias("_total"), F.collect_list("_slice").alias("_of"))
    places = Window.partitionBy("_hash", "_sha")
    seams = (
        joined.select("_hash", F.sha2("_slice_text", 256).alias("_sha"), "_keep", "_total", F.explode("_of").alias("_slice"))
        # With all ids null, every slice's first row is the best; only that of the lowest slice stays.
        .withColumn("_lowest", F.min("_slice").over(places))
    )
    out = runs.join(F.broadcast(seams), ["_hash", "_slice", "_sha"], "left")
    alone = F.col("_total").isNull()
    kept = F.col("_first") & (alone | (F.col("_id") == F.col("_keep")) | (F.col("_keep").isNull() & (F.col("_slice") == F.col("_lowest"))))
    return out.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_head")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_total", "_size").alias("group_size"), F.coalesce(kept, F.lit(False)).alias("kept"), F.col("_sha").alias("text_sha256"),
        *([F.col("_row").alias("row")] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return content_classes(docs, id_col, text_col, keep, carry=True).where("kept").select("row.*")
