"""Column expressions of the rolling features.

Row counts, not time, define the windows and leading windows may be partial. Divisions use ``try_divide``
because ANSI mode raises on 0. The rolling ones read values tracked by :class:`Rolling`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltide.functions.rolling import Rolling
from voltide.plans.series import Frames

CLOSE, HIGH, LOW, VOLUME, RETURN = "price_close", "price_high", "price_low", "volume_base", "log_return"


def tracked(f: Frames, *names: str) -> Rolling:
    """Track the named inputs of the rolling features."""
    change = F.col(CLOSE) - F.lag(CLOSE, 1).over(f.ordered)
    inputs = {
        "return": (F.col(RETURN), 3),
        "bullish": (F.when(F.col(RETURN) > 0, 1.0).otherwise(0.0), 1),
        "range": (F.try_divide(F.col(HIGH) - F.col(LOW), F.col(CLOSE)), 1),
        "volume": (F.col(VOLUME), 2),
        "paid": (F.col(CLOSE) * F.col(VOLUME), 1),
        "close": (F.col(CLOSE), 2),
        "gain": (F.when(change > 0, change).otherwise(0.0), 1),
        "loss": (F.when(change < 0, -change).otherwise(0.0), 1),
        "true_range": (true_range(f), 1),
    }
    out = Rolling(f)
    for name in names:
        value, powers = inputs[name]
        out.track(name, value, powers)
    return out


# returns ---------------------------------------------------------------------------------------
def log_return(f: Frames, close: str = CLOSE) -> Column:
    return F.ln(F.try_divide(F.col(close), F.lag(close, 1).over(f.ordered)))


def cumulative_return(r: Rolling, n: int) -> Column:
    return r.sum("return", n)


def bullish_ratio(r: Rolling, n: int) -> Column:
    return r.mean("bullish", n)


def return_skewness(r: Rolling, n: int) -> Column:
    return r.skewness("return", n)


def price_momentum(f: Frames, n: int) -> Column:
    earlier = F.lag(CLOSE, n).over(f.ordered)
    return F.coalesce(F.try_divide(F.col(CLOSE), earlier) - 1, F.lit(0.0))


# volatility ------------------------------------------------------------------------------------
def realized_volatility(r: Rolling, n: int) -> Column:
    return r.deviation("return", n)


def volatility_change(f: Frames, vol: str, n: int) -> Column:
    return F.col(vol) - F.lag(vol, n).over(f.ordered)


def guarded_ratio(top: str, bottom: str) -> Column:
    """top / bottom, 1.0 unless bottom is positive."""
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(1.0)


def high_low_range(r: Rolling, n: int) -> Column:
    return r.mean("range", n)


# volume ----------------------------------------------------------------------------------------
def volume_average(r: Rolling, n: int) -> Column:
    return r.mean("volume", n)


def vwap(r: Rolling, n: int) -> Column:
    return F.try_divide(r.sum("paid", n), r.sum("volume", n))


def volume_momentum(f: Frames, n: int) -> Column:
    earlier = F.lag(VOLUME, n).over(f.ordered)
    return F.when(earlier > 0, (F.col(VOLUME) - earlier) / earlier).otherwise(0.0)


def volume_volatility(r: Rolling, n: int) -> Column:
    return r.deviation("volume", n)


# technical -------------------------------------------------------------------------------------
def rsi(gain: str, loss: str) -> Column:
    """Relative strength index of simple means; no losses in the window gives rs = 100."""
    rs = F.when(F.col(loss) > 0, F.try_divide(F.col(gain), F.col(loss))).otherwise(100.0)
    return 100 - 100 / (1 + rs)


def true_range(f: Frames) -> Column:
    previous = F.lag(CLOSE, 1).over(f.ordered)
    return F.greatest(F.col(HIGH) - F.col(LOW), F.abs(F.col(HIGH) - previous), F.abs(F.col(LOW) - previous))


def bollinger_width(mean: str, sigma: str, width_mult: float) -> Column:
    return F.try_divide(F.lit(float(width_mult)) * F.col(sigma), F.col(mean))


def bollinger_position(mean: str, sigma: str, num_std: float = 2.0) -> Column:
    band = F.lit(float(num_std)) * F.col(sigma)
    return F.try_divide(F.col(CLOSE) - (F.col(mean) - band), 2 * band)
