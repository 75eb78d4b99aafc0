"""Registered queries: every operator over the given tables.

``events`` are hourly or 15-minute bars of five symbols, ``lineitem`` a second, larger tick source. Timestamps
are shown as text, integers as long and doubles rounded to 6 places, so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators import bars as B
from voltide.operators import cleaning as C
from voltide.operators import evaluation as E
from voltide.operators import explain as X
from voltide.operators import features as W
from voltide.operators import garch as G
from voltide.operators import garch_fit as GF
from voltide.operators import hmm
from voltide.operators import ranking as K
from voltide.operators import regime_models as RM
from voltide.operators import regime_rules as R
from voltide.operators import regime_stats as S
from voltide.operators import spells as P
from voltide.operators import summaries as A
from voltide.operators.forest import Forest
from voltide.operators.quantiles import exact_quantiles
from voltide.plans.series import Series
from voltide.session import materialise, scratch_path
from voltide.sources import klines, tables, ticks
from voltide.streaming import live, repair, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOURS = Series(step=3600)
QUARTERS = Series(step=900)
METHODS = HOURS.by("method")


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    def shown(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # the shift keeps values halfway between two roundings from hanging on the last bit
            c = F.round(c.cast("double") + float(f"2.3e-{digits + 2}"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("long")
        return c.alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def query(name: str, digits: int = 6) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        return fn

    return register


# shared inputs ---------------------------------------------------------------------------------
def tick_rows(spark: SparkSession, d: str) -> DataFrame:
    return ticks.read_event_ticks(spark, d)


def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ticks_to_bars(tick_rows(spark, d), 3600)


def quarter_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ticks_to_bars(tick_rows(spark, d), 900)


def quarter_returns(spark: SparkSession, d: str) -> DataFrame:
    return W.add_log_return(quarter_bars(spark, d), QUARTERS)


def hour_returns(spark: SparkSession, d: str) -> DataFrame:
    return W.add_log_return(hour_bars(spark, d), HOURS)


def hour_features(spark: SparkSession, d: str) -> DataFrame:
    return W.hourly_feature_matrix(hour_bars(spark, d), HOURS)


def written_features(spark: SparkSession, d: str) -> DataFrame:
    """Hourly features, written once because several branches of a query read them."""
    return materialise(hour_features(spark, d), "features")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Those with threshold labels."""
    return R.regime_threshold(written_features(spark, d))


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the three rule detectors in one table, keyed (symbol, method)."""
    features = written_features(spark, d)
    return materialise(
        R.stack_methods(
            {
                "threshold": R.regime_threshold(features),
                "multi_indicator": R.regime_multi_indicator(features).drop("score"),
                "breakout": R.regime_breakout(features, HOURS),
                "not_available": None,
            }
        ),
        "methods",
    )


def unit_candles(spark: SparkSession, d: str) -> DataFrame:
    """A candle per line item, some of them invalid: price moved by discount and tax."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("open_time"),
        price.alias("open"),
        (price * (1 + F.col("l_discount"))).alias("high"),
        (price * (1 - F.col("l_tax"))).alias("low"),
        (price * (1 + F.col("l_discount") - 2 * F.col("l_tax"))).alias("close"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("quote_volume"),
        F.col("l_linenumber").cast("long").alias("trades"),
        "l_orderkey", "l_linenumber",
    )


def lineitem_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.ticks_to_bars(ticks.read_lineitem_ticks(spark, d), 86400)


def bar_table(spark: SparkSession, d: str) -> str:
    """Path of a partitioned table of hourly bars."""
    path = scratch_path(spark, "bars")
    tables.write_partitioned(C.calendar_columns(hour_returns(spark, d)), path)
    return path


# sources and sinks -----------------------------------------------------------------------------
@query("scan_kline_csv")
def _(spark, d):
    path = scratch_path(spark, "klines")
    klines.write_kline_csv(klines.bars_to_klines(hour_bars(spark, d), 3600), path)
    return klines.scan_kline_csv(spark, path)


@query("decode_kline_json")
def _(spark, d):
    return klines.decode_kline_json(klines.klines_to_json(klines.bars_to_klines(hour_bars(spark, d), 3600)))


@query("scan_parquet_bars")
def _(spark, d):
    table = tables.scan_bars(spark, bar_table(spark, d), start="2024-01-05", end="2024-01-20")
    return A.date_range(table)


@query("write_partitioned")
def _(spark, d):
    return spark.read.parquet(bar_table(spark, d))


@query("append_bars")
def _(spark, d):
    bars = C.calendar_columns(hour_returns(spark, d))
    path = scratch_path(spark, "append")
    tables.append_bars(bars.where(F.col("day") < 15), path)
    tables.append_bars(bars.where(F.col("day") >= 15), path)
    tables.append_bars(bars.where(F.col("day") > 31), path)
    return tables.partition_rows(spark, path)


@query("consolidate")
def _(spark, d):
    bars = C.calendar_columns(hour_returns(spark, d))
    path, clean = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    tables.append_bars(bars, path)
    again = bars.where(F.col("day") < 10).withColumn("log_return", F.lit(None).cast("double"))
    tables.append_bars(again, path)
    tables.consolidate(spark, path, clean, HOURS, ["num_trades", "price_close"])
    return spark.read.parquet(clean).select("symbol", "timestamp", "price_close", "log_return", "year", "month")


@query("write_report_csv")
def _(spark, d):
    path = scratch_path(spark, "report")
    tables.write_report_csv(R.regime_distribution(labelled(spark, d)), path)
    return spark.read.schema("symbol string, regime long, n long, pct double").csv(path, header=True)


# projections, filters, cleaning ----------------------------------------------------------------
@query("epoch_to_timestamp")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    unit = F.col("event_id") % 3
    epoch = F.when(unit == 0, F.unix_seconds("ts")).when(unit == 1, F.unix_millis("ts")).otherwise(F.unix_micros("ts"))
    out = ev.select("event_id", C.epoch_to_timestamp(epoch).alias("t"))
    return out.select("event_id", F.unix_micros("t").alias("micros"))


@query("valid_candles")
def _(spark, d):
    c = unit_candles(spark, d)
    strict = C.valid_candles(c).withColumn("mode", F.lit("strict"))
    loose = C.valid_candles(c, strict=False).withColumn("mode", F.lit("loose"))
    return strict.union(loose).groupBy("mode", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("dedup_bars")
def _(spark, d):
    c = unit_candles(spark, d).select("symbol", "open_time", "open", "close", "volume", "l_orderkey", "l_linenumber")
    return C.dedup_bars(c, ["symbol", "open_time"], ["l_orderkey", "l_linenumber", "open", "close", "volume"])


@query("calendar_columns")
def _(spark, d):
    return C.calendar_columns(hour_bars(spark, d)).select("symbol", "timestamp", "year", "month", "day", "hour")


@query("canonical_bars")
def _(spark, d):
    return C.canonical_bars(klines.bars_to_klines(hour_bars(spark, d), 3600))


@query("regime_feature_select")
def _(spark, d):
    rows, _missing = C.regime_feature_select(W.hourly_feature_matrix(hour_bars(spark, d), HOURS, complete=False))
    return rows


@query("drop_incomplete")
def _(spark, d):
    return hour_returns(spark, d).dropna().select("symbol", "timestamp", "log_return")


@query("hourly_aliases")
def _(spark, d):
    return hour_features(spark, d).select("symbol", "timestamp", *W.HOURLY_ALIASES)


@query("null_to_zero_matrix")
def _(spark, d):
    cols = ["log_return", "volume_base", "price_close"]
    z = C.standardise(hour_returns(spark, d), cols)
    return z.select("symbol", "timestamp", *[f"z_{c}" for c in cols])


@query("fill_defaults")
def _(spark, d):
    rows = hour_returns(spark, d).withColumn("regime", F.when(F.col("log_return") > 0, 2))
    return C.fill_defaults(rows).select("symbol", "timestamp", "log_return", "regime")


@query("resolve_columns")
def _(spark, d):
    rows = written_features(spark, d)
    picked = [c for c in C.resolve_columns(rows.columns, E.VOL_NAMES, E.LONG_VOL_NAMES, E.CUM_RETURN_NAMES) if c]
    return rows.groupBy("symbol").agg(*[F.avg(c).alias(c) for c in picked])


# joins -----------------------------------------------------------------------------------------
@query("attach_labels")
def _(spark, d):
    rows = labelled(spark, d)
    out = R.attach_labels(hour_returns(spark, d), rows.select("symbol", "timestamp", "regime", "regime_name"))
    return out.select("symbol", "timestamp", "price_close", "regime", "regime_name")


@query("label_rank_map")
def _(spark, d):
    rows = written_features(spark, d).withColumn("cluster", F.pmod(F.hour("timestamp"), F.lit(3)))
    return R.label_rank_map(rows, "cluster", "vol_60m", clusters=4)


# aggregations ----------------------------------------------------------------------------------
@query("ohlcv_bars")
def _(spark, d):
    return B.ohlcv_bars(quarter_bars(spark, d), 3600)


@query("ohlcv_bars_lineitem")
def _(spark, d):
    return lineitem_bars(spark, d)


@query("partition_counts")
def _(spark, d):
    return A.partition_counts(C.calendar_columns(lineitem_bars(spark, d)))


@query("describe_columns")
def _(spark, d):
    return A.describe_columns(hour_returns(spark, d), ["price_close", "volume_base", "log_return"])


@query("date_range")
def _(spark, d):
    return A.date_range(hour_bars(spark, d))


@query("null_report")
def _(spark, d):
    rows = W.hourly_feature_matrix(hour_bars(spark, d), HOURS, complete=False)
    return A.null_report(rows, ["log_return", "vol_24h", "vol_720h", "return_skew_24h", "rsi", "bb_width"])


@query("quality_report")
def _(spark, d):
    return A.quality_report(hour_bars(spark, d), HOURS, min_price=1.0, min_volume=10.0)


@query("regime_distribution")
def _(spark, d):
    return R.regime_distribution(R.regime_threshold(written_features(spark, d)))


@query("vol_quantiles")
def _(spark, d):
    return R.vol_quantiles(written_features(spark, d))


@query("vol_quantiles_exact")
def _(spark, d):
    return R.vol_quantiles_exact(written_features(spark, d), ["vol_60m", "volume_spike", "rsi"])


@query("vol_quantiles_exact_lineitem")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return exact_quantiles(li, ["l_returnflag"], ["l_quantity", "l_extendedprice"], [0.0, 0.05, 0.33, 0.5, 0.67, 0.95, 1.0])


@query("regime_feature_summary")
def _(spark, d):
    return S.regime_feature_summary(R.regime_threshold(written_features(spark, d)))


@query("regime_stats")
def _(spark, d):
    return S.regime_stats(labelled(spark, d), HOURS)


@query("key_findings")
def _(spark, d):
    rows = labelled(spark, d)
    return S.key_findings(S.regime_stats(rows, HOURS), P.transition_matrix(rows, HOURS))


# window features -------------------------------------------------------------------------------
def _feature(name: str, fn: Callable[[DataFrame, Series], DataFrame], digits: int = 6) -> None:
    @query(name, digits)
    def _(spark, d):
        rows = quarter_returns(spark, d)
        out = fn(rows, QUARTERS)
        return out.select("symbol", "timestamp", *[c for c in out.columns if c not in rows.columns])


_feature("realized_volatility", W.realized_volatility)
_feature("volatility_change", W.volatility_change)
_feature("volatility_ratio", lambda df, s: W.volatility_ratio(df, s, [(30, 240), (60, 240)]))
_feature("high_low_range", W.high_low_range)
_feature("cumulative_return", W.cumulative_return)
_feature("bullish_ratio", W.bullish_ratio)
_feature("return_skewness", W.return_skewness)
_feature("price_momentum", W.price_momentum)
_feature("volume_average", W.volume_average)
_feature("volume_spike", W.volume_spike)
_feature("vwap", W.vwap)
_feature("volume_momentum", W.volume_momentum)
_feature("volume_volatility", W.volume_volatility)
_feature("rsi", W.rsi)
_feature("moving_average", W.moving_average)
_feature("bollinger", W.bollinger)
_feature("atr", W.atr)


@query("log_return")
def _(spark, d):
    return hour_returns(spark, d).select("symbol", "timestamp", "price_close", "log_return")


@query("return_autocorrelation")
def _(spark, d):
    return S.return_autocorrelation(R.regime_threshold(written_features(spark, d)), HOURS)


@query("feature_matrix")
def _(spark, d):
    return W.feature_matrix(quarter_returns(spark, d), QUARTERS)


@query("hourly_feature_matrix")
def _(spark, d):
    return hour_features(spark, d)


@query("rolling_band")
def _(spark, d):
    out = W.rolling_band(written_features(spark, d), HOURS, "vol_60m", 240)
    return out.select("symbol", "timestamp", "vol_ma", "vol_std", "vol_lower", "vol_upper")


# spells and transitions ------------------------------------------------------------------------
@query("regime_change_flag")
def _(spark, d):
    out = P.regime_change_flag(R.regime_threshold(written_features(spark, d)), HOURS)
    return out.select("symbol", "timestamp", "regime", "changed")


@query("regime_spells")
def _(spark, d):
    return P.regime_spells(labelled(spark, d), HOURS)


@query("spell_stats")
def _(spark, d):
    return P.spell_stats(P.regime_spells(labelled(spark, d), HOURS))


@query("transition_matrix")
def _(spark, d):
    return P.transition_matrix(labelled(spark, d), HOURS)


@query("transition_matrix_wide")
def _(spark, d):
    return P.transition_matrix_wide(P.transition_matrix(labelled(spark, d), HOURS))


@query("transition_triggers")
def _(spark, d):
    return P.transition_triggers(labelled(spark, d), HOURS)


# limits, samples, ranks ------------------------------------------------------------------------
@query("recent_rows")
def _(spark, d):
    return A.recent_rows(hour_bars(spark, d), 20).select("symbol", "timestamp", "price_close", "volume_base")


@query("sample_rows")
def _(spark, d):
    return A.sample_rows(hour_bars(spark, d), ["symbol", "timestamp", "price_close", "volume_base"], 10)


@query("capped_sample")
def _(spark, d):
    rows = E.capped_sample(written_features(spark, d), ["symbol"], 200, ["symbol", "timestamp"])
    return rows.select("symbol", "timestamp", "log_return", "vol_60m")


@query("stride_downsample")
def _(spark, d):
    return S.stride_downsample(hour_returns(spark, d), HOURS, 100).select("symbol", "timestamp", "price_close")


@query("stack_methods")
def _(spark, d):
    return stacked(spark, d).select("symbol", "method", "timestamp", "regime", "regime_name")


def _comparison(spark, d):
    return E.evaluate_regimes(stacked(spark, d), METHODS)


@query("evaluate_regimes")
def _(spark, d):
    return _comparison(spark, d)


@query("best_method")
def _(spark, d):
    return K.best_method(_comparison(spark, d), ["symbol"])


@query("rank_by_metric")
def _(spark, d):
    out = K.rank_by_metric(_comparison(spark, d), ["symbol"])
    return out.select("symbol", "method", "silhouette_rank", "separation_rank", "davies_bouldin_rank", "avg_rank")


@query("composite_rank")
def _(spark, d):
    return K.composite_rank(_comparison(spark, d), ["symbol"]).select("symbol", "method", "composite_score", "rank")


@query("metric_radar")
def _(spark, d):
    return K.metric_radar(_comparison(spark, d), ["symbol"])


# calendars -------------------------------------------------------------------------------------
@query("backfill_plan")
def _(spark, d):
    return tables.backfill_plan(quarter_bars(spark, d), QUARTERS, page=4)


@query("backfill_merge")
def _(spark, d):
    bars = hour_returns(spark, d)
    history = bars.where(F.dayofmonth("timestamp") < 20)
    fetched = bars.where(F.dayofmonth("timestamp") >= 10)
    return tables.backfill_merge(history, fetched, HOURS).select("symbol", "timestamp", "price_close", "log_return")


# rule detectors --------------------------------------------------------------------------------
def _labels_only(df: DataFrame, *more: str) -> DataFrame:
    return df.select("symbol", "timestamp", "regime", "regime_name", *more)


@query("regime_threshold")
def _(spark, d):
    return _labels_only(R.regime_threshold(written_features(spark, d)))


@query("regime_multi_indicator")
def _(spark, d):
    return _labels_only(R.regime_multi_indicator(written_features(spark, d)), "score")


@query("regime_breakout")
def _(spark, d):
    return _labels_only(R.regime_breakout(written_features(spark, d), HOURS, 240))


@query("sequence_settings")
def _(spark, d):
    return R.sequence_settings(written_features(spark, d))


# evaluation ------------------------------------------------------------------------------------
def _metric(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    @query(name)
    def _(spark, d):
        return fn(labelled(spark, d))


_metric("silhouette_euclidean", E.silhouette_euclidean)
_metric("silhouette_squared", E.silhouette_squared)
_metric("calinski_harabasz", E.calinski_harabasz)
_metric("davies_bouldin", E.davies_bouldin)
_metric("avg_regime_duration", lambda df: E.duration_and_change(df, HOURS).select("symbol", "avg_regime_duration"))
_metric("regime_balance", E.regime_balance)
_metric("volatility_separation", E.volatility_separation)
_metric("transition_frequency", lambda df: E.duration_and_change(df, HOURS).select("symbol", "transition_frequency"))
_metric("within_regime_volatility", E.within_regime_volatility)

# chart tables ----------------------------------------------------------------------------------
_metric("regime_timeline", lambda df: S.regime_timeline(df, HOURS))
_metric("feature_box_stats", lambda df: S.feature_box_stats(df, ["log_return", "vol_60m", "cum_return_60m", "volume_spike", "rsi"]))
_metric("regime_heatmap", lambda df: S.regime_heatmap(S.regime_stats(df, HOURS)))
_metric("duration_histogram", lambda df: S.duration_histogram(P.regime_spells(df, HOURS)))
_metric("return_density", lambda df: S.return_density(df))


# volatility models -----------------------------------------------------------------------------
REFIT = 48  # a month of bars holds few refits at the default 168


def filled_returns(spark: SparkSession, d: str) -> DataFrame:
    return C.fill_defaults(hour_returns(spark, d))


def given_params(rows: DataFrame, by: list[str]) -> DataFrame:
    """Known parameters for every refit, so the recurrences can be checked without a fit."""
    cuts = GF.refit_cuts(rows, HOURS, REFIT).select("symbol", "refit")
    tilt = 0.01 * (F.col("refit") % 3)
    return G.moment_params(rows, by).join(cuts, "symbol").withColumn("alpha", F.col("alpha") + tilt)


def given_regime_forecast(rows: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    params = given_params(rows, ["symbol", "regime"])
    return G.rolling_forecast_regime(rows, params, HOURS, REFIT, **kw), params


def given_baseline_forecast(rows: DataFrame) -> DataFrame:
    return G.rolling_forecast_baseline(rows, given_params(rows, ["symbol"]), HOURS, REFIT)


def first_params(params: DataFrame) -> DataFrame:
    return params.where(F.col("refit") == 0).drop("refit")


@query("garch_variance")
def _(spark, d):
    rows = filled_returns(spark, d)
    out = G.garch_variance(rows, G.moment_params(rows, ["symbol"]), HOURS)
    return out.select("symbol", "timestamp", "log_return", "variance")


@query("garch_loglik")
def _(spark, d):
    rows = filled_returns(spark, d)
    return G.garch_loglik(rows, G.moment_params(rows, ["symbol"]), HOURS)


@query("garch_fit", digits=4)
def _(spark, d):
    return GF.garch_fit(filled_returns(spark, d), HOURS)


@query("garch_scores_given", digits=4)
def _(spark, d):
    """Log-likelihood and gradient (by log omega, alpha, beta) of three given parameter sets on every expanding window."""
    rows = filled_returns(spark, d)
    sets = F.array(*[F.struct(F.lit(k).cast("long").alias("candidate"), *[F.lit(x).alias(c) for c, x in zip(("share", "alpha", "beta"), start)])
                     for k, start in enumerate(GF.STARTS)])
    given = rows.groupBy("symbol").agg(F.var_pop("log_return").alias("s2")).select("symbol", "s2", F.inline(sets))
    candidates = given.select("symbol", "candidate", (F.col("s2") * F.col("share")).alias("omega"), "alpha", "beta")
    scores = GF.scores_at_cuts(rows, HOURS, candidates, GF.refit_cuts(rows, HOURS, REFIT))
    scale = candidates.select("symbol", "candidate", "omega")
    return scores.join(scale, ["symbol", "candidate"]).withColumn("d_log_omega", F.col("d_omega") * F.col("omega")).drop("d_omega", "omega")


@query("train_test_split")
def _(spark, d):
    out = G.train_test_split(hour_returns(spark, d), HOURS)
    return out.select("symbol", "timestamp", "rn", "n_rows", "train_end", "part")


@query("rolling_forecast_given")
def _(spark, d):
    return given_baseline_forecast(labelled(spark, d))


@query("rolling_forecast_baseline", digits=4)
def _(spark, d):
    rows = labelled(spark, d)
    return G.rolling_forecast_baseline(rows, GF.baseline_fits(rows, HOURS, REFIT), HOURS, REFIT)


@query("regime_garch_fit", digits=4)
def _(spark, d):
    return GF.regime_fits(labelled(spark, d), HOURS, REFIT)


@query("insample_regime_variance")
def _(spark, d):
    rows = labelled(spark, d)
    return G.insample_regime_variance(rows, first_params(given_params(rows, ["symbol", "regime"])), HOURS)


@query("rolling_forecast_regime_given")
def _(spark, d):
    return given_regime_forecast(labelled(spark, d))[0].drop("log_return")


@query("rolling_forecast_regime_lagged")
def _(spark, d):
    return given_regime_forecast(labelled(spark, d), label_mode="lagged")[0].drop("log_return")


@query("rolling_forecast_regime", digits=4)
def _(spark, d):
    rows = labelled(spark, d)
    return G.rolling_forecast_regime(rows, GF.regime_fits(rows, HOURS, REFIT), HOURS, REFIT)


@query("forecast_ahead")
def _(spark, d):
    forecasts, params = given_regime_forecast(labelled(spark, d))
    return G.forecast_ahead(forecasts, params, HOURS, 168)


@query("forecast_variance")
def _(spark, d):
    rows = labelled(spark, d)
    params = first_params(given_params(rows, ["symbol", "regime"]))
    return G.forecast_variance(rows.withColumn("garch_variance", F.col("vol_60m") * F.col("vol_60m")), params, HOURS, 24)


@query("forecast_band")
def _(spark, d):
    forecasts, params = given_regime_forecast(labelled(spark, d))
    return G.forecast_band(G.forecast_ahead(forecasts, params, HOURS, 24)).select("symbol", "step", "band_low", "band_high")


@query("forecast_table")
def _(spark, d):
    rows = labelled(spark, d)
    return G.combine_forecasts(given_baseline_forecast(rows), given_regime_forecast(rows)[0].drop("log_return"), HOURS)


@query("combine_forecasts")
def _(spark, d):
    rows = labelled(spark, d)
    both = G.combine_forecasts(given_baseline_forecast(rows), given_regime_forecast(rows)[0], HOURS)
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("rs_forecast") - F.col("forecast")).alias("mean_gap"))


def _both_metrics(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, d)
    baseline = G.forecast_metrics(given_baseline_forecast(rows), ["symbol"], "forecast")
    return baseline, G.forecast_metrics(given_regime_forecast(rows)[0], ["symbol"], "rs_forecast")


@query("forecast_metrics", digits=4)
def _(spark, d):
    baseline, regime = _both_metrics(spark, d)
    return baseline.withColumn("model", F.lit("baseline")).unionByName(regime.withColumn("model", F.lit("regime_switching")))


@query("model_improvement", digits=4)
def _(spark, d):
    return G.model_improvement(*_both_metrics(spark, d), ["symbol"])


@query("forecast_vol_histogram")
def _(spark, d):
    return S.forecast_vol_histogram(given_regime_forecast(labelled(spark, d))[0])


@query("params_table", digits=4)
def _(spark, d):
    fitted = GF.garch_fit(filled_returns(spark, d), HOURS).withColumn("model", F.lit("baseline"))
    path = scratch_path(spark, "params")
    tables.save_params(fitted, path)
    return tables.load_params(spark, path, "baseline")


@query("params_table_given", digits=12)
def _(spark, d):
    path = scratch_path(spark, "params")
    for model in ("baseline", "other"):
        tables.save_params(G.moment_params(filled_returns(spark, d), ["symbol"]).withColumn("model", F.lit(model)), path)
    return tables.load_params(spark, path, "baseline")


# model detectors -------------------------------------------------------------------------------
def model_features(spark: SparkSession, d: str) -> DataFrame:
    return written_features(spark, d)


@query("regime_kmeans")
def _(spark, d):
    return _labels_only(RM.regime_kmeans(model_features(spark, d), HOURS))


@query("kmeans_step_given")
def _(spark, d):
    """One pass over all rows from three given centers."""
    centers = np.array([[-1.0] * 3, [0.0] * 3, [1.0] * 3])
    return RM.kmeans_step(model_features(spark, d), HOURS, ["log_return", "vol_60m", "rsi"], centers)


@query("kmeans_centers", digits=4)
def _(spark, d):
    return RM.kmeans_centers(model_features(spark, d), HOURS)


@query("kmeans_elbow", digits=4)
def _(spark, d):
    return RM.kmeans_elbow(model_features(spark, d), HOURS)


@query("regime_gmm", digits=4)
def _(spark, d):
    rows = RM.regime_gmm(model_features(spark, d), HOURS)
    return _labels_only(rows, "regime_probability", "regime_uncertainty")


@query("gmm_diagnostics", digits=4)
def _(spark, d):
    return RM.gmm_diagnostics(model_features(spark, d), HOURS)


@query("regime_hmm")
def _(spark, d):
    return _labels_only(hmm.regime_hmm(model_features(spark, d), HOURS)[0])


@query("garch_features")
def _(spark, d):
    rows = model_features(spark, d)
    out = RM.garch_features(rows, G.moment_params(rows, ["symbol"]), HOURS)
    return out.select("symbol", "timestamp", *RM.GARCH_FEATURES)


@query("regime_garch")
def _(spark, d):
    rows, _params = RM.regime_garch(model_features(spark, d), HOURS)
    return _labels_only(rows, "garch_variance", "garch_volatility", "global_garch_vol")


@query("garch_regime_summary")
def _(spark, d):
    return G.garch_regime_summary(*RM.regime_garch(model_features(spark, d), HOURS))


@query("sequence_windows")
def _(spark, d):
    out = RM.sequence_windows(model_features(spark, d), HOURS, ["log_return", "rsi"], 168, 24)
    columns = RM.patch_columns(["log_return", "rsi"], 168, 24)
    return out.where(F.col("has_sequence")).select("symbol", "timestamp", *columns)


@query("head_fill")
def _(spark, d):
    rows = labelled(spark, d)
    rows = rows.withColumn("seen", F.when(F.dayofmonth("timestamp") > 8, F.col("regime")))
    return RM.head_fill(rows, HOURS, "seen").select("symbol", "timestamp", "seen")


@query("regime_patch_embedding")
def _(spark, d):
    return _labels_only(RM.regime_patch_embedding(model_features(spark, d), HOURS))


@query("regime_pseudo_label_embedding")
def _(spark, d):
    return _labels_only(RM.regime_pseudo_label_embedding(model_features(spark, d), HOURS))


# explanations ----------------------------------------------------------------------------------
@query("rf_regime_model", digits=4)
def _(spark, d):
    rows, _names = X.training_rows(labelled(spark, d), HOURS)
    return X.accuracy(X.fit_forest(rows), rows)


def given_stumps() -> Forest:
    """Three known trees of one split each, on volatility (feature 1) twice and on RSI (feature 2)."""
    split, low, high = [(1, -0.5), (1, 0.5), (2, 0.0)], [[0.7, 0.2, 0.1], [0.3, 0.6, 0.1], [0.2, 0.5, 0.3]], [[0.1, 0.3, 0.6], [0.05, 0.15, 0.8], [0.5, 0.05, 0.45]]
    feature, threshold = np.full((3, 3), -1, dtype=np.int32), np.zeros((3, 3))
    feature[:, 0], threshold[:, 0] = zip(*split)
    below = np.where(feature < 0, -1, 1).astype(np.int32)
    value = np.stack([np.full((3, 3), 1 / 3), np.array(low), np.array(high)], axis=1)
    return Forest(feature, threshold, below, np.where(below < 0, -1, 2).astype(np.int32), value)


@query("permutation_hits_given")
def _(spark, d):
    """Rows that known trees label as the thresholds do, with each feature shuffled and (feature -1) without."""
    rows, _names = X.training_rows(labelled(spark, d), HOURS, ["log_return", "vol_60m", "rsi"])
    return X.permutation_hits(given_stumps(), rows, ["symbol"], 4)


@query("global_importance", digits=4)
def _(spark, d):
    return X.global_importance(labelled(spark, d), HOURS)


@query("per_regime_importance", digits=4)
def _(spark, d):
    return X.per_regime_importance(labelled(spark, d), HOURS)


@query("shapley_importance", digits=4)
def _(spark, d):
    return X.shapley_importance(labelled(spark, d), HOURS)


# streams ---------------------------------------------------------------------------------------
def _kline_files(spark: SparkSession, bars: DataFrame, path: str) -> None:
    klines.write_kline_csv(klines.bars_to_klines(bars, 3600), path)


def _drop(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write more files for a stream to find."""
    df.write.mode("append").parquet(path)


def _parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("stream_ingest")
def _(spark, d):
    files, table = scratch_path(spark, "drop"), scratch_path(spark, "live")
    _kline_files(spark, hour_bars(spark, d), files)
    live.stream_ingest(klines.read_kline_stream(spark, files), table, scratch_path(spark, "cp"))
    return spark.read.parquet(table).drop("log_return")


@query("stream_dedup")
def _(spark, d):
    first, second = scratch_path(spark, "polls") + "/a", scratch_path(spark, "polls") + "/b"
    bars = hour_bars(spark, d)
    _kline_files(spark, bars, first)
    _kline_files(spark, bars, second)
    both = klines.read_kline_stream(spark, first, 2).union(klines.read_kline_stream(spark, second, 3))
    return live.stream_dedup(both, scratch_path(spark, "deduped"), scratch_path(spark, "cp"))


@query("stream_bars")
def _(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return live.stream_bars(ticks.event_ticks(source), scratch_path(spark, "bars"), scratch_path(spark, "cp"))


@query("stream_log_return")
def _(spark, d):
    bars = hour_bars(spark, d).select("symbol", "timestamp", "price_close", "num_trades")
    files, table = scratch_path(spark, "drop"), scratch_path(spark, "returns")
    _drop(spark, bars.where(F.dayofmonth("timestamp") >= 15), files)
    _drop(spark, bars.where(F.dayofmonth("timestamp") < 15), files)
    stream = _parquet_stream(spark, files, bars.schema)
    returns = live.stream_log_return(stream, table, scratch_path(spark, "cp"), HOURS, ("num_trades", "price_close"))
    return returns.select("symbol", "timestamp", "price_close", "log_return")


@query("stream_threshold_regime")
def _(spark, d):
    rows = model_features(spark, d)
    files, table = scratch_path(spark, "drop"), scratch_path(spark, "labels")
    narrow = rows.select("symbol", "timestamp", "vol_60m")
    _drop(spark, narrow, files)
    thresholds = materialise(R.vol_quantiles(rows), "thresholds")
    stream = live.stream_threshold_regime(_parquet_stream(spark, files, narrow.schema), thresholds)
    runs.run_to_parquet(stream, table, scratch_path(spark, "cp"))
    return _labels_only(spark.read.parquet(table))


@query("late_repair")
def _(spark, d):
    bars = C.calendar_columns(hour_returns(spark, d))
    late = F.pmod(F.col("num_trades") + F.hour("timestamp"), F.lit(3)) == 0
    table, files = scratch_path(spark, "bars"), scratch_path(spark, "late")
    tables.write_partitioned(W.add_log_return(bars.where(~late).drop("log_return"), HOURS), table)
    _drop(spark, bars.where(late).withColumn("log_return", F.lit(None).cast("double")), files)
    stream = _parquet_stream(spark, files, bars.schema)
    merge = repair.late_repair(table, HOURS, ["num_trades", "price_close"])
    runs.start(stream.writeStream.foreachBatch(merge), spark, scratch_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(table).select("symbol", "timestamp", "price_close", "log_return")


@query("hybrid_ingest")
def _(spark, d):
    bars = hour_bars(spark, d)
    table, files, clean = scratch_path(spark, "hybrid"), scratch_path(spark, "drop"), scratch_path(spark, "clean")
    history = C.canonical_bars(klines.bars_to_klines(bars.where(F.dayofmonth("timestamp") < 20), 3600))
    tables.append_bars(W.add_log_return(history.drop("log_return"), HOURS), table)
    _kline_files(spark, bars.where(F.dayofmonth("timestamp") >= 18), files)
    # the stream sink keeps its own file log, so live rows go to their own folder and are merged with the history
    fresh = scratch_path(spark, "live")
    live.stream_ingest(klines.read_kline_stream(spark, files), fresh, scratch_path(spark, "cp"))
    tables.append_bars(spark.read.parquet(fresh), table)
    tables.consolidate(spark, table, clean, HOURS, ["num_trades", "price_close"])
    return spark.read.parquet(clean).select("symbol", "timestamp", "price_close", "log_return")
