"""GARCH(1,1) conditional variance, likelihood, rolling forecasts and their evaluation.

Parameters live in DataFrames keyed like the series they belong to (``omega, alpha, beta``), so one job
handles every symbol, regime and refit at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.cleaning import finite_or_zero
from voltide.plans.recurrence import linear_recurrence
from voltide.plans.series import Series, over_series, with_row_index

FLOOR = 1e-10
HOURS_PER_YEAR = 8760
METRICS = ("rmse", "mae", "mape_pct", "qlike", "corr")


def unconditional(omega: Column, alpha: Column, beta: Column) -> Column:
    return omega / F.greatest(1 - alpha - beta, F.lit(1e-6))


def moment_params(df: DataFrame, by: Sequence[str], returns: str = "log_return") -> DataFrame:
    """Moment-based parameters used when a fit is impossible."""
    sigma2 = F.var_pop(returns)
    return df.groupBy(*by).agg(sigma2.alias("_s2")).select(
        *by, (F.col("_s2") * 0.05).alias("omega"), F.lit(0.10).alias("alpha"), F.lit(0.85).alias("beta")
    )


def with_previous_return(df: DataFrame, s: Series, returns: str = "log_return") -> DataFrame:
    """``prev_return`` is the return one row earlier in the series, missing returns counting as 0."""

    def build(d, f):
        return d.withColumn("prev_return", F.lag(returns, 1).over(f.ordered))

    return over_series(df.withColumn(returns, finite_or_zero(F.col(returns))), s, build, before=1)


def garch_variance(df: DataFrame, params: DataFrame, s: Series, returns: str = "log_return", out: str = "variance") -> DataFrame:
    """Conditional variance of each series from given parameters; the first row is the unconditional one."""
    rows = with_previous_return(df, s, returns).join(params.select(*s.keys, "omega", "alpha", "beta"), list(s.keys))
    first = F.col("prev_return").isNull()
    a = F.when(first, 1.0).otherwise(F.col("beta"))
    b = F.when(first, 0.0).otherwise(F.col("omega") + F.col("alpha") * F.col("prev_return") * F.col("prev_return"))
    start = unconditional(F.col("omega"), F.col("alpha"), F.col("beta"))
    return linear_recurrence(rows, s, a, b, start, out, FLOOR).drop("prev_return", "omega", "alpha", "beta")


def garch_loglik(df: DataFrame, params: DataFrame, s: Series, returns: str = "log_return") -> DataFrame:
    """Gaussian log-likelihood of given parameters."""
    rows = garch_variance(_narrow(df, s, returns), params, s, returns)
    h, r = F.greatest(F.col("variance"), F.lit(FLOOR)), F.col(returns)
    return rows.groupBy(*s.keys).agg(
        (-0.5 * F.sum(math.log(2 * math.pi) + F.ln(h) + r * r / h)).alias("loglik"), F.count(F.lit(1)).alias("n")
    )


def train_test_split(df: DataFrame, s: Series, train_frac: float = 0.8) -> DataFrame:
    """Row index ``rn``, first out-of-sample index ``train_end`` and ``part`` (train / test)."""
    out = with_row_index(df, s).withColumn("train_end", F.floor(F.col("n_rows") * F.lit(train_frac)))
    return out.withColumn("part", F.when(F.col("rn") < F.col("train_end"), "train").otherwise("test"))


def refit_index(refit_every: int) -> Column:
    """Which refit's parameters are in force: refit k happens after row train_end + k * refit_every."""
    since = F.col("rn") - F.col("train_end") - 1
    return F.greatest(F.floor(since / F.lit(refit_every)), F.lit(0))


def _narrow(df: DataFrame, s: Series, *columns: str) -> DataFrame:
    return df.select(*s.keys, s.time, *columns)


def _one_step(rows: DataFrame, s: Series, start: Column, out: str) -> DataFrame:
    b = F.col("omega") + F.col("alpha") * F.col("prev_return") * F.col("prev_return")
    return linear_recurrence(rows, s, F.col("beta"), b, start, out, FLOOR)


def rolling_forecast_baseline(df: DataFrame, params: DataFrame, s: Series, refit_every: int = 168,
                              train_frac: float = 0.8, returns: str = "log_return") -> DataFrame:
    """One-step out-of-sample variance; starts from the population variance of the training rows.

    ``params(keys, refit, omega, alpha, beta)`` holds every refit; all were fitted before, in parallel.
    """
    rows = with_previous_return(train_test_split(_narrow(df, s, returns), s, train_frac), s, returns)
    train = rows.where(F.col("part") == "train").groupBy(*s.keys).agg(F.var_pop(returns).alias("_h0"))
    test = rows.where(F.col("part") == "test").withColumn("refit", refit_index(refit_every))
    test = test.join(params.select(*s.keys, "refit", "omega", "alpha", "beta"), [*s.keys, "refit"]).join(train, list(s.keys))
    out = _one_step(test, s, F.col("_h0"), "forecast")
    return out.select(*s.keys, s.time, "forecast", F.sqrt("forecast").alias("forecast_vol"),
                      (F.col(returns) * F.col(returns)).alias("realised_var"))


def insample_regime_variance(df: DataFrame, params: DataFrame, s: Series, train_frac: float = 0.8,
                             returns: str = "log_return") -> DataFrame:
    """Training variance where every regime carries its own variance between its bars.

    The shock is the return of the previous bar of the whole series, whatever its regime.
    """
    rows = with_previous_return(train_test_split(_narrow(df, s, returns, "regime"), s, train_frac), s, returns)
    rows = rows.where(F.col("part") == "train")
    rows = rows.join(params.select(*s.keys, "regime", "omega", "alpha", "beta"), [*s.keys, "regime"])
    first = F.col("rn") == 0
    a = F.when(first, 1.0).otherwise(F.col("beta"))
    b = F.when(first, 0.0).otherwise(F.col("omega") + F.col("alpha") * F.col("prev_return") * F.col("prev_return"))
    start = unconditional(F.col("omega"), F.col("alpha"), F.col("beta"))
    out = linear_recurrence(rows, s.by("regime"), a, b, start, "variance", FLOOR)
    return out.select(*s.keys, s.time, "regime", "variance")


def rolling_forecast_regime(df: DataFrame, params: DataFrame, s: Series, refit_every: int = 168, train_frac: float = 0.8,
                            returns: str = "log_return", label_mode: str = "hindsight") -> DataFrame:
    """One-step forecasts with the parameters and the carried variance of the active regime.

    Each regime starts at the unconditional variance of its first fit. ``label_mode='lagged'`` uses the label
    of the previous bar, so no forecast knows the label of the bar it predicts.
    """
    rows = with_previous_return(train_test_split(_narrow(df, s, returns, "regime"), s, train_frac), s, returns)
    if label_mode == "lagged":

        def build(d, f):
            return d.withColumn("regime", F.coalesce(F.lag("regime", 1).over(f.ordered), F.col("regime")))

        rows = over_series(rows, s, build, before=1)
    p = params.select(*s.keys, "regime", "refit", "omega", "alpha", "beta")
    first = p.where(F.col("refit") == 0).select(
        *s.keys, "regime", unconditional(F.col("omega"), F.col("alpha"), F.col("beta")).alias("_h0")
    )
    test = rows.where(F.col("part") == "test").withColumn("refit", refit_index(refit_every))
    test = test.join(p, [*s.keys, "regime", "refit"]).join(first, [*s.keys, "regime"])
    out = _one_step(test, s.by("regime"), F.col("_h0"), "rs_forecast")
    return out.select(*s.keys, s.time, "rs_forecast", F.sqrt("rs_forecast").alias("rs_vol"),
                      (F.col(returns) * F.col(returns)).alias("realised_var"), "regime", F.col(returns))


def multi_step(state: DataFrame, steps: int) -> DataFrame:
    """Variance 1..steps ahead of ``state(.., omega, alpha, beta, last_return, last_variance)``, closed form."""
    persistence = F.col("alpha") + F.col("beta")
    first = F.greatest(
        F.col("omega") + F.col("alpha") * F.col("last_return") * F.col("last_return") + F.col("beta") * F.col("last_variance"),
        F.lit(FLOOR),
    )
    limit = F.try_divide(F.col("omega"), 1 - persistence)
    ahead = state.withColumns({"_h1": first, "_limit": limit, "_p": persistence}).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(steps)))
    )
    k = F.col("step") - 1
    decay = F.pow("_p", k.cast("double"))
    h = F.coalesce(F.col("_limit") + decay * (F.col("_h1") - F.col("_limit")), F.col("_h1") + F.col("omega") * k)
    h = F.greatest(F.when(k == 0, F.col("_h1")).otherwise(h), F.lit(FLOOR))
    out = ahead.withColumn("forecast_variance", h)
    out = out.withColumns(
        {"forecast_vol": F.sqrt("forecast_variance"), "forecast_vol_ann": F.sqrt(F.col("forecast_variance") * HOURS_PER_YEAR)}
    )
    return out.drop("_h1", "_limit", "_p", "omega", "alpha", "beta", "last_return", "last_variance")


def last_state(forecasts: DataFrame, params: DataFrame, s: Series, variance: str = "rs_forecast",
               returns: str = "log_return") -> DataFrame:
    """Newest regime, return and forecast of each series with the newest parameters of that regime."""
    newest = forecasts.groupBy(*s.keys).agg(
        F.max_by("regime", s.time).alias("regime"), F.max_by(returns, s.time).alias("last_return"),
        F.max_by(variance, s.time).alias("last_variance"),
    )
    latest = params.groupBy(*s.keys, "regime").agg(F.max_by(F.struct("omega", "alpha", "beta"), "refit").alias("_p"))
    latest = latest.select(*s.keys, "regime", "_p.omega", "_p.alpha", "_p.beta")
    return newest.join(latest, [*s.keys, "regime"]).withColumnRenamed("regime", "active_regime")


def forecast_ahead(forecasts: DataFrame, params: DataFrame, s: Series, steps: int = 24) -> DataFrame:
    return multi_step(last_state(forecasts, params, s), steps)


def forecast_variance(df: DataFrame, params: DataFrame, s: Series, steps: int, variance: str = "garch_variance",
                      returns: str = "log_return") -> DataFrame:
    """Multi-step variance from the newest bar of every regime, not only the active one."""
    newest = df.groupBy(*s.keys, "regime").agg(
        F.max_by(returns, s.time).alias("last_return"), F.max_by(variance, s.time).alias("last_variance")
    )
    return multi_step(newest.join(params.select(*s.keys, "regime", "omega", "alpha", "beta"), [*s.keys, "regime"]), steps)


def forecast_band(ahead: DataFrame) -> DataFrame:
    return ahead.withColumns({"band_low": F.col("forecast_vol") * 0.9, "band_high": F.col("forecast_vol") * 1.1})


def combine_forecasts(baseline: DataFrame, regime: DataFrame, s: Series) -> DataFrame:
    """Rows both models forecast."""
    return baseline.join(regime.drop("realised_var"), [*s.keys, s.time], "inner")


def forecast_metrics(df: DataFrame, by: Sequence[str], forecast: str, realised: str = "realised_var") -> DataFrame:
    f, rv = F.col(forecast), F.col(realised)
    error = f - rv
    return df.where(f.isNotNull() & rv.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_oos"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(error / F.greatest(rv, F.lit(1e-10)))) * 100).alias("mape_pct"),
        F.avg(F.ln(f) + rv / f).alias("qlike"),
        F.coalesce(F.nanvl(F.corr(f, rv), F.lit(None)), F.lit(0.0)).alias("corr"),
    )


def model_improvement(baseline: DataFrame, regime: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed % gain of the regime model per metric (positive is better) and the winner."""
    by = list(by)
    b = baseline.unpivot(by, list(METRICS), "metric", "baseline")
    r = regime.unpivot(by, list(METRICS), "metric", "regime_switching")
    both = b.join(r, [*by, "metric"])
    direction = F.when(F.col("metric") == "corr", 1.0).otherwise(-1.0)
    gain = F.try_divide(F.col("regime_switching") - F.col("baseline"), F.abs("baseline")) * 100 * direction
    winner = F.when(
        F.when(F.col("metric") == "corr", F.col("baseline") > F.col("regime_switching")).otherwise(
            F.col("baseline") < F.col("regime_switching")
        ), "baseline",
    ).otherwise("regime_switching")
    return both.withColumns({"improvement_pct": gain, "winner": winner})


def garch_regime_summary(df: DataFrame, params: DataFrame, by: Sequence[str] = ("symbol", "regime")) -> DataFrame:
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_return").alias("mean_return"), F.avg("garch_variance").alias("mean_variance")
    )
    out = stats.join(params.select(*by, "omega", "alpha", "beta"), list(by), "left")
    return out.withColumn("persistence", F.col("alpha") + F.col("beta"))


def in_force(params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A refit without a usable fit keeps the parameters of the refit before it."""
    order = Window.partitionBy(*keys).orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    return params.select(
        *keys, "refit", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in ("omega", "alpha", "beta")]
    )
