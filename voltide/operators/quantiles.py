"""Approximate and exact quantiles per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.session import materialise

SORTED = 100_000  # values of one bin that are merged and sorted together
PARTS = 4096  # of a larger bin


def approx_quantiles(df: DataFrame, by: Sequence[str], value: str, names: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One mergeable sketch per group; ``names`` maps output column to probability."""
    cut = F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in names.values()]), accuracy)
    sketch = df.groupBy(*by).agg(cut.alias("_q"))
    return sketch.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles, long form ``(by, feature, prob, quantile)``.

    ``percentile`` would hold every value of a group in one task. Here values are counted in bins that keep their order,
    combined before the shuffle. Bins that hold a wanted rank are cut between their ends, in another pass over ``df``, while
    one has more than ``SORTED`` values that are not all equal; then the values of these bins are merged and sorted. The bins
    decide how much is sorted, never the result. Wanted bins are written, so every pass sees the same.
    """
    keys = [*by, "feature"]
    stacked = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    values = (
        df.select(*by, stacked.alias("_v"))
        .select(*by, "_v.feature", "_v.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("_rounded", _rounded(F.col("value")))
    )
    size = [F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")]
    counts = values.groupBy(*keys, "_rounded").agg(*size)
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))).withColumn("_start", F.lit(0).cast("long"))
    bins = materialise(_holding_ranks(counts, keys, "_rounded", probs), "quantile_bins")
    while (bins.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.col("_n")))).first()[0] or 0) > SORTED:
        outer = [*keys, "_rounded", "_total", "_start", "_from", "_to"]
        length = F.col("_to") - F.col("_from")
        part = F.floor(F.when(length > 0, (F.col("value") - F.col("_from")) / length * PARTS).otherwise(0.0))
        held = _held(values, bins, keys).withColumnsRenamed({"_low": "_from", "_high": "_to"})
        counts = held.groupBy(*outer, part.alias("_part")).agg(*size)
        inner = _holding_ranks(counts, outer, "_part", probs).drop("_from", "_to", "_part")
        bins = materialise(inner, "quantile_bins")
    inside = Window.partitionBy(*keys, "_start").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("prob") * (F.col("_total") - 1)
    last = F.col("_start") + F.col("_cum") - 1
    first = F.col("_start") + F.col("_cum") - F.col("_n")
    picked = (
        _held(values, bins, keys)
        .groupBy(*keys, "_total", "_start", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cum", F.sum("_n").over(inside))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_frac", position - F.floor(position))
        .withColumn("_vlo", F.when(F.floor(position).between(first, last), F.col("value")))
        .withColumn("_vhi", F.when(F.ceil(position).between(first, last), F.col("value")))
        .where(F.col("_vlo").isNotNull() | F.col("_vhi").isNotNull())
    )
    ends = picked.groupBy(*keys, "prob", "_frac").agg(F.max("_vlo").alias("_vlo"), F.max("_vhi").alias("_vhi"))
    return ends.select(
        *keys, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("quantile")
    )


def _rounded(v: Column) -> Column:
    """``v`` to 12 significant bits, 2,048 steps from each power of two to the next. Rounding to the nearest keeps the order."""
    scaled = v * F.lit(2.0**41 + 1)
    return F.when(F.abs(v) < F.lit(2.0**900), scaled - (scaled - v)).otherwise(v)


def _holding_ranks(counts: DataFrame, within: Sequence[str], bin: str, probs: Sequence[float]) -> DataFrame:
    """Bins that hold a wanted rank; ``_start`` becomes the number of the group's values before the bin."""
    order = Window.partitionBy(*within).orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)
    ranks = [whole(F.lit(float(p)) * (F.col("_total") - 1)) for p in probs for whole in (F.floor, F.ceil)]
    return counts.withColumn("_start", F.col("_start") + F.sum("_n").over(order) - F.col("_n")).where(
        F.exists(F.array(*ranks), lambda r: r.between(F.col("_start"), F.col("_start") + F.col("_n") - 1))
    )


def _held(values: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values between the ends of a bin."""
    held = F.col("value").between(F.col("_low"), F.col("_high"))
    return values.join(bins.drop("_n"), [*keys, "_rounded"]).where(held)


def spread_quantiles(long: DataFrame, by: Sequence[str], names: dict[str, tuple[str, float]]) -> DataFrame:
    """Long quantiles to one row per group; ``names`` maps output column to (feature, prob)."""
    return long.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("feature") == feature) & (F.col("prob") == F.lit(float(p))), F.col("quantile"))).alias(n)
            for n, (feature, p) in names.items()
        ]
    )
