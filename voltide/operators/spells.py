"""Spells (runs of one regime), transitions between regimes and what precedes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.quantiles import exact_quantiles, spread_quantiles
from voltide.plans.series import Series, over_series, with_running_sum

# features described at a transition (fixed values)
TRIGGER_FEATURES = ("log_return", "vol_60m", "vol_ratio_60_240", "rsi", "volume_spike", "atr_pct", "bb_width")


def regime_change_flag(df: DataFrame, s: Series, regime: str = "regime") -> DataFrame:
    """``changed``: label differs from the previous row; the first row is no change."""

    def build(d, f):
        previous = F.lag(regime, 1).over(f.ordered)
        return d.withColumn("changed", F.coalesce((F.col(regime) != previous).cast("int"), F.lit(0)))

    return over_series(df, s, build, before=1)


def with_spell_id(df: DataFrame, s: Series, regime: str = "regime") -> DataFrame:
    """0-based number of the spell a row is in: changes so far, summed in two levels."""
    return with_running_sum(regime_change_flag(df, s, regime), s, F.col("changed"), "spell_id")


def regime_spells(df: DataFrame, s: Series, regime: str = "regime") -> DataFrame:
    """One row per spell. The group is an aggregate, so a spell of any length combines map-side."""
    return (
        with_spell_id(df.select(*s.keys, s.time, regime), s, regime)
        .groupBy(*s.keys, "spell_id", regime)
        .agg(
            F.min(s.time).alias("spell_start"),
            F.max(s.time).alias("spell_end"),
            F.count(F.lit(1)).alias("duration"),
        )
    )


def spell_stats(spells: DataFrame, by: Sequence[str] = ("symbol", "regime")) -> DataFrame:
    medians = spread_quantiles(exact_quantiles(spells, by, ["duration"], [0.5]), by, {"median_duration": ("duration", 0.5)})
    stats = spells.groupBy(*by).agg(
        F.avg("duration").alias("mean_duration"),
        F.max("duration").alias("max_duration"),
        F.count(F.lit(1)).alias("n_spells"),
    )
    return stats.join(medians, list(by))


def transition_counts(df: DataFrame, s: Series, regime: str = "regime") -> DataFrame:
    def build(d, f):
        return d.withColumn("to_regime", F.lead(regime, 1).over(f.ordered))

    pairs = over_series(df.select(*s.keys, s.time, regime), s, build, after=1)
    return (
        pairs.where(F.col("to_regime").isNotNull())
        .groupBy(*s.keys, F.col(regime).alias("from_regime"), "to_regime")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def transition_matrix(df: DataFrame, s: Series, n_regimes: int = 3) -> DataFrame:
    """Long matrix of P(next | current) with every cell; a regime never left has zeros."""
    counts = transition_counts(df, s)
    cells = F.sequence(F.lit(0), F.lit(n_regimes - 1))
    grid = (
        df.select(*s.keys).distinct()
        .withColumn("from_regime", F.explode(cells))
        .withColumn("to_regime", F.explode(cells))
    )
    filled = grid.join(counts, [*s.keys, "from_regime", "to_regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*s.keys, "from_regime"))
    return filled.withColumn("probability", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def transition_matrix_wide(matrix: DataFrame, keys: Sequence[str] = ("symbol",), n_regimes: int = 3) -> DataFrame:
    wide = matrix.groupBy(*keys, "from_regime").pivot("to_regime", list(range(n_regimes))).agg(F.max("probability"))
    for j in range(n_regimes):
        wide = wide.withColumnRenamed(str(j), f"to_{j}")
    return wide


def transition_triggers(df: DataFrame, s: Series, features: Sequence[str] = TRIGGER_FEATURES) -> DataFrame:
    """Mean features on the bar before a switch, and their relative distance from that regime's mean.

    A switch into the last bar of a series is not counted, as in the definition being followed.
    """
    cols = [c for c in features if c in df.columns]

    def build(d, f):
        return d.withColumns(
            {"to_regime": F.lead("regime", 1).over(f.ordered), "_later": F.lead(s.time, 2).over(f.ordered)}
        )

    narrow = df.select(*s.keys, s.time, "regime", *cols)
    switches = over_series(narrow, s, build, after=2).where(
        (F.col("to_regime") != F.col("regime")) & F.col("_later").isNotNull()
    )
    at = switches.groupBy(*s.keys, F.col("regime").alias("from_regime"), "to_regime").agg(
        F.count(F.lit(1)).alias("n_transitions"), *[F.avg(c).alias(f"{c}_at_transition") for c in cols]
    )
    base = narrow.groupBy(*s.keys, F.col("regime").alias("from_regime")).agg(*[F.avg(c).alias(f"_b_{c}") for c in cols])
    relative = {
        f"{c}_vs_baseline": F.coalesce(
            F.try_divide(F.col(f"{c}_at_transition") - F.col(f"_b_{c}"), F.abs(f"_b_{c}")), F.lit(0.0)
        )
        for c in cols
    }
    return at.join(base, [*s.keys, "from_regime"]).withColumns(relative).drop(*[f"_b_{c}" for c in cols])
