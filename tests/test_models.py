"""Fitted models: recovery on simulated data, and distributed equals local."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators import garch_fit as GF
from voltide.operators import garch_score as GS
from voltide.operators import hmm as H
from voltide.operators import kmeans as KM
from voltide.operators import regime_models as RM
from voltide.plans.series import Series

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT())])
SMALL = Series(step=3600, chunk_rows=160)
HOUR0 = 1_700_000_000 // 3600 * 3600


def simulate_garch(n, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    h, r = omega / (1 - alpha - beta), np.empty(n)
    for t in range(n):
        r[t] = np.sqrt(h) * rng.normal()
        h = omega + alpha * r[t] ** 2 + beta * h
    return r


def loglik(r, omega, alpha, beta):
    h, total = omega / (1 - alpha - beta), 0.0
    for t in range(len(r)):
        if t:
            h = max(omega + alpha * r[t - 1] ** 2 + beta * h, 1e-10)
        total += -0.5 * (np.log(2 * np.pi) + np.log(h) + r[t] ** 2 / h)
    return total


@pytest.fixture(scope="module")
def returns():
    return {"A": simulate_garch(1500, 0.05, 0.12, 0.82, 1), "B": simulate_garch(900, 0.2, 0.25, 0.6, 2), "C": np.ones(12)}


@pytest.fixture(scope="module")
def return_rows(make, returns):
    return make(pd.concat([pd.DataFrame({"symbol": k, "timestamp": HOUR0 + 3600 * np.arange(len(v)), "log_return": v}) for k, v in returns.items()]))


def test_fit_is_at_least_as_likely_as_the_truth(return_rows, returns):
    fits = {r["symbol"]: r for r in GF.garch_fit(return_rows, Series()).collect()}
    for k, truth in (("A", (0.05, 0.12, 0.82)), ("B", (0.2, 0.25, 0.6))):
        f = fits[k]
        assert f["loglik"] >= loglik(returns[k], *truth) - 0.05
        assert abs(f["loglik"] - loglik(returns[k], f["omega"], f["alpha"], f["beta"])) < 1e-6
        assert f["alpha"] + f["beta"] < 0.9999
    assert (fits["C"]["alpha"], fits["C"]["beta"], fits["C"]["omega"]) == (0.10, 0.85, 0.0)


def test_distributed_fit_equals_local(return_rows):
    local = GF.garch_fit(return_rows, SMALL, rounds=4).toPandas().sort_values("symbol", ignore_index=True)
    split = GF.garch_fit(return_rows, SMALL, local_rows=1000, rounds=4).toPandas().sort_values("symbol", ignore_index=True)
    pd.testing.assert_frame_equal(local, split[local.columns], rtol=1e-9)


def test_windows_are_fitted_as_if_alone(return_rows, returns):
    """Every refit of the expanding window, whole and with blocks apart, against a fit of that window by itself."""
    cuts = GF.refit_cuts(return_rows, SMALL, 48)
    packed = GF.materialise(GF.pack(GF.train_test_split(return_rows, SMALL), SMALL, order="rn"), "packed")
    ends = {(r["symbol"], r["refit"]): r["cut"] for r in cuts.collect()}
    for local_rows in (10**6, 100):
        fits = GF.fit_packed(packed, cuts, ["symbol"], local_rows).collect()
        assert len(fits) == len(ends)
        for f in fits:
            window = returns[f["symbol"]][: ends[f["symbol"], f["refit"]]]
            assert f["n"] == len(window)
            if len(window) < 30:
                assert f["omega"] is None
                continue
            assert abs(f["loglik"] - loglik(window, f["omega"], f["alpha"], f["beta"])) < 1e-6
            counts, best = GF.fit_series(pd.DataFrame({"block": [0], "squares": [window**2], "previous": [np.append(np.nan, window[:-1] ** 2)],
                                                       "rn": [np.arange(len(window))]}), np.array([len(window)]))
            alone = -0.5 * (len(window) * np.log(2 * np.pi) + best[0, 3])
            assert abs(f["loglik"] - alone) < 1e-4


def test_gradient_and_blocks(returns):
    """Gradient by differences of the likelihood; a series cut anywhere gives the same sums."""
    r = returns["B"]
    squares, previous = r**2, np.append(np.nan, r[:-1] ** 2)
    theta = np.array([[0.2, 0.25, 0.6], [0.05, 0.4, 0.01], [1.0, 1e-6, 0.99]])
    whole = GS.block_sums(squares, previous, theta, GS.entering(theta), np.array([0]))[0]
    for k in range(3):
        for c, t in enumerate(theta):
            step = np.eye(3)[k] * 1e-7 * max(t[k], 1e-2)
            slope = (loglik(r, *(t + step)) - loglik(r, *(t - step))) / (2 * step[k])
            assert slope == pytest.approx(-0.5 * whole[1 + k, c], rel=1e-4, abs=1e-2)
    for cut in (1, 2, 450, 899):
        state = GS.block_end(previous[:cut], theta) + GS.passed(GS.entering(theta), theta, GS.block_steps(previous[:cut]))
        both = GS.block_sums(squares[:cut], previous[:cut], theta, GS.entering(theta), np.array([0])) + GS.block_sums(squares[cut:], previous[cut:], theta, state, np.array([0]))
        np.testing.assert_allclose(both[0], whole, rtol=1e-9)


def test_gradient_vanishes_at_the_fit(returns):
    for r in (returns["A"], returns["B"]):
        data = pd.DataFrame({"block": [0], "squares": [r**2], "previous": [np.append(np.nan, r[:-1] ** 2)], "rn": [np.arange(len(r))]})
        _, best = GF.fit_series(data, np.array([len(r)]))
        gain, _ = GS.scoring_steps(best[0, :3], best[0, 3:], 1.0)
        assert gain < GS.TOLERANCE
    noise = np.random.default_rng(5).normal(0, 0.01, 800)
    data = pd.DataFrame({"block": [0], "squares": [noise**2], "previous": [np.append(np.nan, noise[:-1] ** 2)], "rn": [np.arange(800)]})
    assert np.isfinite(GF.fit_series(data, np.array([800]))[1]).all()


def test_refit_cuts_match_the_rolling_loop(return_rows):
    got = GF.refit_cuts(return_rows.where("symbol = 'B'"), Series(), 48).orderBy("refit").collect()
    n, end = 900, 720
    want = [end] + [t for t in range(end, n) if (t - end) % 48 == 0 and t > end]
    assert [r["cut"] for r in got] == want


@pytest.fixture(scope="module")
def hmm_rows(make):
    rng = np.random.default_rng(3)
    move = np.array([[0.95, 0.04, 0.01], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]])
    state, parts = 0, []
    for symbol in ("A", "B"):
        states = []
        for _ in range(700):
            state = rng.choice(3, p=move[state])
            states.append(state)
        states = np.array(states)
        x = np.array([[-3, 0], [0, 3], [4, -2]])[states] + rng.normal(size=(700, 2)) * np.array([0.5, 0.8, 1.2])[states][:, None]
        parts.append(pd.DataFrame({"symbol": symbol, "timestamp": HOUR0 + 3600 * np.arange(700), "x": x[:, 0], "y": x[:, 1], "true": states}))
    return make(pd.concat(parts))


def test_hmm_blocks_equal_whole_series_and_recover_states(hmm_rows):
    start = np.array([[-2.0, 0.0], [0.0, 2.0], [3.0, -1.0]])
    models, paths = [], []
    for s in (Series(step=3600), SMALL):
        blocks = H.pack_rows(hmm_rows, s, ["x", "y"])
        model = H.fit_hmm(blocks, s, start, n_iter=4)
        models.append(model)
        paths.append(H.best_path(blocks, s, model, 2).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True))
    np.testing.assert_allclose(models[0].transition, models[1].transition, rtol=1e-8)
    np.testing.assert_allclose(models[0].covariances, models[1].covariances, rtol=1e-8)
    assert abs(models[0].loglik - models[1].loglik) < 1e-6
    pd.testing.assert_frame_equal(paths[0], paths[1])
    truth = hmm_rows.toPandas().sort_values(["symbol", "timestamp"], ignore_index=True)["true"]
    assert (paths[0]["state"] == truth).mean() > 0.97
    np.testing.assert_allclose(np.diag(models[0].transition), [0.95, 0.9, 0.9], atol=0.05)


def test_kmeans_separates_and_ranks(make):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 3, 300)
    pdf = pd.DataFrame({"symbol": "X", "timestamp": HOUR0 + 3600 * np.arange(300), "true": kind, "vol_60m": kind * 2 + rng.normal(0, 0.1, 300),
                        "rsi": -kind * 5 + rng.normal(0, 0.1, 300), "atr_pct": rng.normal(0, 0.1, 300) + kind})
    out = RM.regime_kmeans(make(pdf), Series(), n_init=3).toPandas()
    assert (out["regime"] == out["true"]).all()


def test_restarts_share_passes(spark):
    """Every fit of a pass against plain Lloyd steps from the same first centers; the best restart of each k wins."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (3, 0), (0, 3), (4, 4))])
    vectors = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], SCHEMA).repartition(3)
    rows = KM.Spread(KM.points(vectors, "features"))
    ks, seeds = [2, 4, 4], [1, 2, 3]
    centers = KM.first_centers(rows, ks, seeds)
    assert [len(c) for c in centers] == ks and all((x == c).all(1).any() for fit in centers for c in fit)
    again = KM.first_centers(KM.Spread(rows.rows.repartition(5)), ks, seeds)
    assert all((a == b).all() for a, b in zip(centers, again))
    for c, sums in zip(centers, KM.nearest_sums(rows, centers)):
        near = ((x[:, None] - c[None]) ** 2).sum(2)
        own = near.argmin(1)
        np.testing.assert_allclose(KM.moved(c, sums), [x[own == k].mean(0) for k in range(len(c))])
        np.testing.assert_allclose([sums[:, -2].sum(), sums[:, -1].sum()], [len(x), near.min(1).sum()])
    two, four = KM.fit_many(vectors, [2, 4], n_init=5)
    assert len(two.centers) == 2 and len(four.centers) == 4 and four.inertia < 100 < two.inertia
    for a, b in zip((two, four), KM.fit_many(vectors, [2, 4], n_init=5, local_rows=10)):
        np.testing.assert_allclose(a.centers, b.centers)
        assert a.inertia == pytest.approx(b.inertia)
    labels = four.transform(vectors).orderBy("id").toPandas()["cluster"].to_numpy()
    assert (labels == ((x[:, None] - four.centers[None]) ** 2).sum(2).argmin(1)).all()
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0])) for i in range(5)], SCHEMA)
    assert KM.fit_many(same, [3], n_init=2)[0].inertia == 0.0


def test_head_fill(make):
    pdf = pd.DataFrame({"symbol": "X", "timestamp": HOUR0 + 3600 * np.arange(4), "v": [None, None, 2.0, 1.0]})
    out = RM.head_fill(make(pdf).withColumn("v", F.nanvl("v", F.lit(None))), Series(), "v").orderBy("timestamp").collect()
    assert [r["v"] for r in out] == [2.0, 2.0, 2.0, 1.0]
