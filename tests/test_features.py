"""Rolling features against pandas, and their edge cases."""

import numpy as np
import pandas as pd
import pytest
from conftest import random_bars

from voltide.functions.rolling import DIRECT, parts_of
from voltide.operators import features as W
from voltide.plans.series import Series

S = Series(step=3600, chunk_rows=64)


def prices(values, volume=1.0):
    return pd.DataFrame({
        "symbol": "X", "timestamp": 1_700_000_000 // 3600 * 3600 + 3600 * np.arange(len(values)), "price_open": values,
        "price_high": values, "price_low": values, "price_close": values, "volume_base": volume, "volume_quote": 1.0, "num_trades": 1,
    })


def matrix(make, pdf):
    out = W.feature_matrix(W.add_log_return(make(pdf), S), S, (5, 20, 60), (2, 5, 10)).toPandas()
    return out.sort_values(["symbol", "timestamp"]).reset_index(drop=True)


def test_against_pandas(make):
    got = matrix(make, random_bars(300, seed=5))
    for _, g in got.groupby("symbol"):
        r, v, c = g["log_return"], g["volume_base"], g["price_close"]
        for n in (5, 20, 60):
            np.testing.assert_allclose(g[f"vol_{n}m"], r.rolling(n, min_periods=2).std(), atol=1e-9)
            np.testing.assert_allclose(g[f"cum_return_{n}m"], r.rolling(n, min_periods=1).sum(), atol=1e-9)
            np.testing.assert_allclose(g[f"vol_avg_{n}m"], v.rolling(n, min_periods=1).mean(), atol=1e-9)
        want = []
        for i in range(len(r)):
            x = r.iloc[max(0, i - 19): i + 1].dropna().to_numpy()
            spread = x.std() if len(x) else 0
            want.append(((x - x.mean()) ** 3).mean() / spread**3 if spread > 1e-15 else np.nan)
        np.testing.assert_allclose(g["return_skew_20m"], want, atol=1e-6)
        np.testing.assert_allclose(g["ma_20"], c.rolling(20, min_periods=1).mean(), rtol=1e-12)


def test_zero_volume_window_is_exactly_zero(make):
    got = matrix(make, random_bars(300, seed=5))
    quiet = got[(got["vol_avg_5m"] == 0)]
    assert len(quiet) > 20 and (quiet["volume_momentum_20m"].notna()).all()
    sums = got.groupby("symbol")["volume_base"].transform(lambda v: v.rolling(20, min_periods=1).sum())
    assert (got.loc[sums == 0, "volume_spike"] == 1.0).all() and got.loc[sums == 0, "vwap_20m"].isna().all()


def test_constant_price(make):
    got = matrix(make, prices(np.full(50, 7.0)))
    assert (got["vol_60m"].iloc[2:] == 0).all() and got["return_skew_20m"].isna().all()
    assert (got["bb_width"].iloc[1:] == 0).all() and got["bb_position"].isna().all()
    np.testing.assert_allclose(got["rsi"], 100 - 100 / 101)
    assert (got["vol_ratio_5_60"] == 1.0).all()


def test_monotone_price_has_no_losses(make):
    got = matrix(make, prices(np.arange(1.0, 51.0)))
    np.testing.assert_allclose(got["rsi"], 100 - 100 / 101)
    assert got["bullish_ratio_5m"].iloc[0] == 0.0 and got["bullish_ratio_5m"].iloc[6] == 1.0
    assert got["momentum_10m"].iloc[9] == 0.0 and got["momentum_10m"].iloc[10] == 10.0


def test_one_row(make):
    got = matrix(make, prices(np.array([5.0]))).iloc[0]
    assert np.isnan(got["log_return"]) and np.isnan(got["vol_5m"]) and got["momentum_2m"] == 0.0 and got["atr"] == 0.0


@pytest.mark.parametrize("spike", [1e8, 1e10])
def test_spike_leaves_no_trace(make, spike):
    """A value far outside every window changes nothing in it."""
    rng = np.random.default_rng(3)
    volume = rng.integers(1, 50, 2000).astype(float)
    volume[50] = spike
    bars = pd.DataFrame({"symbol": "A", "timestamp": 3600 * np.arange(2000), "volume_base": volume, "price_close": 1.0})
    got = W.volume_volatility(make(bars), Series(step=3600), (60,)).orderBy("timestamp").toPandas()["volume_vol_60m"]
    away = range(950, 2000)
    assert np.allclose(got[away], [np.std(volume[i - 59 : i + 1], ddof=1) for i in away], rtol=1e-9)


@pytest.mark.parametrize("known", [[], [14, 20, 24], [20], [7, 168]])
def test_parts_make_up_a_window(known):
    for rows in (33, 50, 60, 100, 168, 240, 720, 1024, 1025, 40_000):
        parts = parts_of(rows, known)
        assert sum(parts) == rows and len(parts) <= 3 * DIRECT and all(p <= DIRECT or p in known or p in (DIRECT**2, DIRECT**3) for p in parts)


def test_plan_depth_is_constant(make):
    """Few window operators whatever the lengths of the windows."""
    rows = make(random_bars(50))
    for out, most in ((W.hourly_feature_matrix(rows, S), 8), (W.feature_matrix(rows.withColumn("log_return", rows.price_close * 0), S), 8)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) <= most
