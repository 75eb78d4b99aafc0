"""Rolling features per symbol, one at a time or as the two feature matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.functions import prices as p
from voltide.operators.cleaning import calendar_columns
from voltide.functions.rolling import Rolling
from voltide.plans.series import Frames, Series, over_series

MINUTE = (30, 60, 240)
HOURLY = (24, 168, 720)


def add_log_return(df: DataFrame, s: Series) -> DataFrame:
    return over_series(df, s, lambda d, f: d.withColumn("log_return", p.log_return(f)), before=1)


def _rolling(df: DataFrame, s: Series, inputs: Sequence[str], reach: int,
             columns: Callable[[Rolling], dict[str, Column]]) -> DataFrame:
    """Rolling columns over the tracked ``inputs``, from one placement of the rows and one sort."""

    def build(d: DataFrame, f: Frames) -> DataFrame:
        r = p.tracked(f, *inputs)
        asked = columns(r)
        return r.drop(r.prepare(d).withColumns(asked))

    return over_series(df, s, build, before=reach)


def realized_volatility(df: DataFrame, s: Series, windows: Sequence[int] = MINUTE, unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["return"], max(windows) - 1,
                    lambda r: {f"vol_{n}{unit}": p.realized_volatility(r, n) for n in windows})


def volatility_change(df: DataFrame, s: Series, window: int = 30, lag: int = 30, unit: str = "m") -> DataFrame:
    vol = f"vol_{window}{unit}"

    def build(d: DataFrame, f: Frames) -> DataFrame:
        r = p.tracked(f, "return")
        asked = p.realized_volatility(r, window)
        d = r.drop(r.prepare(d).withColumn(vol, asked))
        return d.withColumn(f"vol_change_{window}{unit}", p.volatility_change(f, vol, lag))

    return over_series(df, s, build, before=window - 1 + lag)


def volatility_ratio(df: DataFrame, s: Series, pairs: Sequence[tuple[int, int]], unit: str = "m") -> DataFrame:
    windows = sorted({n for pair in pairs for n in pair})
    out = realized_volatility(df, s, windows, unit)
    return out.withColumns(
        {f"vol_ratio_{a}_{b}": p.guarded_ratio(f"vol_{a}{unit}", f"vol_{b}{unit}") for a, b in pairs}
    )


def high_low_range(df: DataFrame, s: Series, windows: Sequence[int] = (60, 240), unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["range"], max(windows) - 1,
                    lambda r: {f"hl_range_{n}{unit}": p.high_low_range(r, n) for n in windows})


def cumulative_return(df: DataFrame, s: Series, windows: Sequence[int] = MINUTE, unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["return"], max(windows) - 1,
                    lambda r: {f"cum_return_{n}{unit}": p.cumulative_return(r, n) for n in windows})


def bullish_ratio(df: DataFrame, s: Series, windows: Sequence[int] = MINUTE, unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["bullish"], max(windows) - 1,
                    lambda r: {f"bullish_ratio_{n}{unit}": p.bullish_ratio(r, n) for n in windows})


def return_skewness(df: DataFrame, s: Series, windows: Sequence[int] = MINUTE, unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["return"], max(windows) - 1,
                    lambda r: {f"return_skew_{n}{unit}": p.return_skewness(r, n) for n in windows})


def price_momentum(df: DataFrame, s: Series, lags: Sequence[int] = (10, 30, 60), unit: str = "m") -> DataFrame:
    def build(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumns({f"momentum_{n}{unit}": p.price_momentum(f, n) for n in lags})

    return over_series(df, s, build, before=max(lags))


def volume_average(df: DataFrame, s: Series, windows: Sequence[int] = MINUTE, unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["volume"], max(windows) - 1,
                    lambda r: {f"vol_avg_{n}{unit}": p.volume_average(r, n) for n in windows})


def volume_spike(df: DataFrame, s: Series, window: int = 60, unit: str = "m") -> DataFrame:
    out = volume_average(df, s, [window], unit)
    return out.withColumn("volume_spike", p.guarded_ratio("volume_base", f"vol_avg_{window}{unit}"))


def vwap(df: DataFrame, s: Series, windows: Sequence[int] = (60, 240), unit: str = "m") -> DataFrame:
    out = _rolling(df, s, ["paid", "volume"], max(windows) - 1, lambda r: {f"vwap_{n}{unit}": p.vwap(r, n) for n in windows})
    return out.withColumns(
        {f"price_vs_vwap_{n}{unit}": F.try_divide(F.col(p.CLOSE), F.col(f"vwap_{n}{unit}")) for n in windows}
    )


def volume_momentum(df: DataFrame, s: Series, lags: Sequence[int] = (60, 240), unit: str = "m") -> DataFrame:
    def build(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumns({f"volume_momentum_{n}{unit}": p.volume_momentum(f, n) for n in lags})

    return over_series(df, s, build, before=max(lags))


def volume_volatility(df: DataFrame, s: Series, windows: Sequence[int] = (60, 240), unit: str = "m") -> DataFrame:
    return _rolling(df, s, ["volume"], max(windows) - 1,
                    lambda r: {f"volume_vol_{n}{unit}": p.volume_volatility(r, n) for n in windows})


def rsi(df: DataFrame, s: Series, window: int = 14) -> DataFrame:
    out = _rolling(df, s, ["gain", "loss"], window,
                   lambda r: {"_gain": r.mean("gain", window), "_loss": r.mean("loss", window)})
    return out.withColumn("rsi", p.rsi("_gain", "_loss")).drop("_gain", "_loss")


def moving_average(df: DataFrame, s: Series, windows: Sequence[int] = (20, 50)) -> DataFrame:
    out = _rolling(df, s, ["close"], max(windows) - 1, lambda r: {f"ma_{n}": r.mean("close", n) for n in windows})
    return out.withColumns({f"price_vs_ma_{n}": F.try_divide(F.col(p.CLOSE), F.col(f"ma_{n}")) for n in windows})


def bollinger(df: DataFrame, s: Series, window: int = 20, num_std: float = 2.0, width_mult: float = 4.0) -> DataFrame:
    out = _rolling(df, s, ["close"], window - 1,
                   lambda r: {"_mean": r.mean("close", window), "_sigma": r.deviation("close", window)})
    return out.withColumns(
        {
            "bb_width": p.bollinger_width("_mean", "_sigma", width_mult),
            "bb_position": p.bollinger_position("_mean", "_sigma", num_std),
        }
    ).drop("_mean", "_sigma")


def atr(df: DataFrame, s: Series, window: int = 14) -> DataFrame:
    out = _rolling(df, s, ["true_range"], window, lambda r: {"atr": r.mean("true_range", window)})
    return out.withColumn("atr_pct", F.try_divide(F.col("atr"), F.col(p.CLOSE)) * 100)


def rolling_band(df: DataFrame, s: Series, value: str, window: int = 240) -> DataFrame:
    """Rolling mean of ``value`` and the band one sample deviation around it."""

    def build(d: DataFrame, f: Frames) -> DataFrame:
        r = Rolling(f).track("band", F.col(value), powers=2)
        asked = {"vol_ma": r.mean("band", window), "vol_std": r.deviation("band", window)}
        return r.drop(r.prepare(d).withColumns(asked))

    return over_series(df, s, build, before=window - 1).withColumns(
        {"vol_lower": F.col("vol_ma") - F.col("vol_std"), "vol_upper": F.col("vol_ma") + F.col("vol_std")}
    )


def feature_matrix(
    df: DataFrame, s: Series, windows: tuple[int, int, int] = MINUTE, momentum: Sequence[int] = (10, 30, 60)
) -> DataFrame:
    """Bars plus the 41 minute-grain features, from one placement of the rows and one sort."""
    short, mid, long = windows
    pair = (mid, long)

    def build(d: DataFrame, f: Frames) -> DataFrame:
        r = p.tracked(f, "return", "bullish", "range", "volume", "paid", "close", "gain", "loss", "true_range")
        cols: dict[str, Column] = {}
        for n in windows:
            cols[f"vol_{n}m"] = p.realized_volatility(r, n)
            cols[f"cum_return_{n}m"] = p.cumulative_return(r, n)
            cols[f"bullish_ratio_{n}m"] = p.bullish_ratio(r, n)
            cols[f"return_skew_{n}m"] = p.return_skewness(r, n)
            cols[f"vol_avg_{n}m"] = p.volume_average(r, n)
        for n in momentum:
            cols[f"momentum_{n}m"] = p.price_momentum(f, n)
        for n in pair:
            cols[f"hl_range_{n}m"] = p.high_low_range(r, n)
            cols[f"vwap_{n}m"] = p.vwap(r, n)
            cols[f"volume_momentum_{n}m"] = p.volume_momentum(f, n)
            cols[f"volume_vol_{n}m"] = p.volume_volatility(r, n)
        for n in (20, 50):
            cols[f"ma_{n}"] = r.mean("close", n)
        cols |= {"_sigma": r.deviation("close", 20), "_gain": r.mean("gain", 14), "_loss": r.mean("loss", 14),
                 "atr": r.mean("true_range", 14)}
        d = r.drop(r.prepare(d).withColumns(cols))
        return d.withColumn(f"vol_change_{short}m", p.volatility_change(f, f"vol_{short}m", short))

    before = max(long, 2 * short - 1, max(momentum), 50)
    out = over_series(df, s, build, before=before)
    derived = {
        f"vol_ratio_{short}_{long}": p.guarded_ratio(f"vol_{short}m", f"vol_{long}m"),
        f"vol_ratio_{mid}_{long}": p.guarded_ratio(f"vol_{mid}m", f"vol_{long}m"),
        "volume_spike": p.guarded_ratio("volume_base", f"vol_avg_{mid}m"),
        "rsi": p.rsi("_gain", "_loss"),
        "bb_width": p.bollinger_width("ma_20", "_sigma", 4.0),
        "bb_position": p.bollinger_position("ma_20", "_sigma"),
        "atr_pct": F.try_divide(F.col("atr"), F.col(p.CLOSE)) * 100,
    }
    for n in pair:
        derived[f"price_vs_vwap_{n}m"] = F.try_divide(F.col(p.CLOSE), F.col(f"vwap_{n}m"))
    for n in (20, 50):
        derived[f"price_vs_ma_{n}"] = F.try_divide(F.col(p.CLOSE), F.col(f"ma_{n}"))
    return out.withColumns(derived).drop("_sigma", "_gain", "_loss")


# alias column -> hourly column, so both grains share the names the detectors use (fixed values)
HOURLY_ALIASES = {
    "vol_60m": "vol_24h",
    "vol_240m": "vol_168h",
    "vol_ratio_60_240": "vol_ratio_24_168",
    "cum_return_60m": "cum_return_24h",
    "return_skew_60m": "return_skew_24h",
}


def hourly_aliases(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(source) for name, source in HOURLY_ALIASES.items()})


def hourly_feature_matrix(bars: DataFrame, s: Series, complete: bool = True) -> DataFrame:
    """Features of hourly bars at 24/168/720 rows; rows with any NULL are dropped if ``complete``."""

    def build(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumn("log_return", p.log_return(f))
        r = p.tracked(f, "return", "range", "volume", "close", "gain", "loss", "true_range")
        cols: dict[str, Column] = {}
        for n in HOURLY:
            cols[f"vol_{n}h"] = p.realized_volatility(r, n)
            cols[f"cum_return_{n}h"] = p.cumulative_return(r, n)
        for n in HOURLY[:2]:
            cols[f"return_skew_{n}h"] = p.return_skewness(r, n)
            cols[f"vol_avg_{n}h"] = p.volume_average(r, n)
        cols |= {"hl_range_24h": p.high_low_range(r, 24), "atr": r.mean("true_range", 14), "_mean": r.mean("close", 20),
                 "_sigma": r.deviation("close", 20), "_gain": r.mean("gain", 14), "_loss": r.mean("loss", 14)}
        return r.drop(r.prepare(d).withColumns(cols))

    out = over_series(bars, s, build, before=HOURLY[-1])
    if complete:
        # before the derived columns: they are NULL only where one of these is NULL or a divisor is 0
        out = out.dropna().where((F.col("_mean") != 0) & (F.col(p.CLOSE) != 0))
    out = out.withColumns(
        {
            "vol_ratio_24_168": p.guarded_ratio("vol_24h", "vol_168h"),
            "vol_ratio_168_720": p.guarded_ratio("vol_168h", "vol_720h"),
            "volume_spike": p.guarded_ratio("volume_base", "vol_avg_24h"),
            "rsi": p.rsi("_gain", "_loss"),
            "atr_pct": F.try_divide(F.col("atr"), F.col(p.CLOSE)) * 100,
            "bb_width": p.bollinger_width("_mean", "_sigma", 2.0),
        }
    ).drop("_mean", "_sigma", "_gain", "_loss")
    return calendar_columns(hourly_aliases(out), s.time)
