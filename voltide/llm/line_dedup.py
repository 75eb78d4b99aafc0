"""Removal of lines that many documents share.

The normalised lines are exploded and hashed, the distinct documents of each hash are counted, and lines over the threshold go. What
travels is the hash and the place of a line, never its text: each document gets the places it loses and is put together again from the
others, in order. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.session import materialise

#: What is stripped from both ends of a line, as are the letters that are lower-cased (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased; letters of other alphabets stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per place that loses its line: ``id, text_key, place`` (from 0; rows with equal id and text count once).

    ``text_key`` is ``xxhash64`` of the text. A document is an id, or a text where the id is null; see ``dedup_lines``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("place", "_line"))
    keyed = placed.withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    lines = materialise(keyed.select("id", "text_key", "place", F.unhex(F.md5("_key")).alias("hash")), "lines")

    # Documents without id are told apart by their text, and lose against all that have one.
    nameless = F.when(F.col("id").isNull(), F.col("text_key")).alias("nameless")
    holders = lines.select("hash", "id", nameless).distinct()
    shared = holders.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("_best"), F.max("nameless").alias("_nameless"))
    # Written first: with plain shuffles on both sides of the join, Spark can split the rows of a hot line.
    shared = materialise(shared.where(F.col("n") >= min_docs).select("hash", "_best", "_nameless"), "shared-lines")
    keeps = F.coalesce(F.col("id") == F.col("_best"), F.lit(False)) | (F.col("_best").isNull() & (F.col("text_key") == F.col("_nameless")))
    return lines.join(shared, "hash").where(~keeps).select("id", "text_key", "place")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_dropped`` (long), ``kept_text`` (and ``row`` with all its columns if ``carry``).

    Texts are split at line feeds; a null or empty text is one empty line. Lines are equal if their keys are (``line_key``; compared by
    128-bit digests). Lines with a key of ``min_chars`` code points or more that ``min_docs`` documents or more hold go, but for those in
    the document with the largest id, where all of them stay. Other lines stay, joined by line feeds.

    Rows that share their id are one document here: they count once, and all of them keep their lines or none. Rows without id are one
    document per distinct text and keep a line only if no document with an id holds it, and then the one with the largest hash does.
    Repeated rows each get their row; an empty table gives an empty result; input columns of any name are possible, for they travel in
    ``row``. A line however common costs one row per task in the count, and its rows of the join can be split. Memory follows the longest text.
    """
    gone = repeated_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("id", "text_key").agg(F.collect_set("place").alias("_gone"))
    gone = materialise(gone.withColumnRenamed("id", "_of").withColumnRenamed("text_key", "_of_text"), "dropped-places")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"), *([F.struct("*").alias("_row")] if carry else []))
    both = rows.join(gone, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_text")), "left")
    # A column of its own: inside the lambda the text would be split once for each line.
    split = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))  # by a hash set, in order
    whole = F.array_join(F.transform(places, lambda k: F.get("_lines", k)), "\n")
    return split.select(
        F.col("_id").alias(id_col), (F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(whole).alias("kept_text"), *([F.col("_row").alias("row")] if carry else []),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the texts that are left, all its other columns as they were."""
    clean = dedup_lines(docs, id_col, text_col, carry=True, **options)
    return clean.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
