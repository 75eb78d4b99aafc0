"""Mixing sources to target weights by weighted fair queueing.

Every source sends its shuffled documents one after the other, pass after pass. A document's virtual finish time is what its source
has sent with it, divided by the source's target. Documents of all sources in the order of that time are the mix; where the mix has
the words of its total budget, at virtual time 1, it is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that one window of the running sum sees, about.
RUN_ROWS = 1024


def word_count(text: Column) -> Column:
    """Words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id: Column, text: Column, seed: int) -> Column:
    """60 bits of a digest of seed and id, or of the text of a row without id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    The sources in the order of their code points, null last, get ``weights`` in turn and share ``share`` times all sizes. No target
    is above ``most`` times its source's size; what it gives up goes to the others by weight. Sorted by how soon they reach that
    limit, the sources at their limit come first, so one running sum finds the common level of the others.
    """
    everything = Window.orderBy(F.asc_nulls_last("source"))
    soonest = Window.orderBy("_level", F.asc_nulls_last("source"))
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    rest = soonest.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_weight", F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))])
        .withColumn("_most", F.col("source_size") * F.lit(float(most)))
        .withColumn("_level", F.col("_most") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    )
    leveled = ranked.withColumn("_share", (F.col("_budget") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    leveled = leveled.withColumn("_rank", F.when(F.col("_share") <= F.col("_level"), F.row_number().over(soonest)))
    return leveled.withColumn("_common", F.min_by("_share", "_rank").over(all_rows)).select(
        "source", "source_size", F.coalesce(F.least(F.col("_most"), F.col("_weight") * F.col("_common")), F.col("_most")).alias("target")
    )


def fair_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5, most: int = 2, seed: int = 17, carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id, size, source_size, target, taken, copies`` (and ``row`` with all its columns if ``carry``).

    ``copies`` lists what the mix takes of the document, ``(finish, words)`` for each pass, ``finish`` being the virtual time. The
    copy that reaches virtual time 1 is cut there, so a source's words are its target, rounded down, and all words together are the
    total budget. A null text has no words and is never taken; a null source is a source of its own. Equal rows are documents of
    their own. An empty table gives an empty result. ``share`` must not exceed ``most``.

    The running sum of a source, however large, is cut in runs by the leading bits of the shuffled key: sums per run, a running sum
    over those, and windows of about ``RUN_ROWS`` rows. Of the text only its size goes through the shuffle unless ``carry``.
    """
    runs = max(1, docs.count() // RUN_ROWS)
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("_size"),
        shuffle_key(F.col(id_col), F.col(text_col), seed).alias("_key"), *([F.struct("*").alias("_row")] if carry else []),
    ).withColumn("_run", F.floor(F.col("_key") / F.lit(2.0**60) * runs)).withColumn("_of", _source_key())
    per_run = rows.groupBy("source", "_of", "_run").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("_of").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_run.select("_of", "_run", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    targets = source_targets(per_run.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    placed = starts.join(targets.withColumn("_of", _source_key()).drop("source"), "_of")
    # Joined first: join and window share one shuffle of the rows.
    inside = Window.partitionBy("_of", "_run").orderBy("_key", F.asc_nulls_last("_id"), "_size").rowsBetween(Window.unboundedPreceding, 0)
    sent = rows.join(placed, ["_of", "_run"]).withColumn("_sent", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))

    def copy(k: int) -> Column:
        start = F.col("_sent") + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor("target") - start)).cast("long")
        return F.struct(((start + F.col("_size")) / F.col("target")).alias("finish"), words.alias("words"))

    copies = F.filter(F.array(*[F.when(F.col("target") > 0, copy(k)) for k in range(most)]), lambda x: x["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return sent.withColumn("copies", copies).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), "copies",
        *([F.col("_row").alias("row")] if carry else []),
    )


def _source_key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def in_mix_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``fair_mix`` range-sorted over all partitions by their first virtual finish time; documents not taken come last, by id."""
    return mixed.withColumn("_finish", F.get("copies", F.lit(0))["finish"]).orderBy(F.asc_nulls_last("_finish"), id_col).drop("_finish")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken, a cut copy with the words taken, in the order of the mix."""
    mixed = fair_mix(docs, id_col, text_col, carry=True, **options)
    out = mixed.select("row", "size", F.explode("copies").alias("_copy")).orderBy("_copy.finish")
    cut = F.col("_copy.words") < F.col("size")
    row = F.col("row")
    text = F.when(cut, first_words(row[text_col], F.col("_copy.words"))).otherwise(row[text_col])
    changed = {text_col: text} | ({"n_chars": F.when(cut, F.length(text).cast("long")).otherwise(row["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, row[c]).alias(c) for c in docs.columns])
