import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltide.operators import evaluation as E
from voltide.operators import quantiles
from voltide.operators import ranking as K
from voltide.operators import regime_rules as R
from voltide.operators import spells as P
from voltide.operators.quantiles import exact_quantiles
from voltide.operators.regime_stats import histogram, return_density
from voltide.plans.series import Series

S = Series(step=3600, chunk_rows=16)


def labels(make, values):
    at = 1_700_000_000 // 3600 * 3600 + 3600 * np.arange(len(values))
    return make(pd.DataFrame({"symbol": "X", "timestamp": at, "regime": values, "log_return": np.arange(len(values), dtype=float)}))


def test_spells_matrix_and_triggers(make):
    df = labels(make, [0, 0, 1, 2, 2, 2, 0])
    spells = P.regime_spells(df, S).orderBy("spell_id").collect()
    assert [(r["regime"], r["duration"]) for r in spells] == [(0, 2), (1, 1), (2, 3), (0, 1)]
    cells = {(r["from_regime"], r["to_regime"]): r["probability"] for r in P.transition_matrix(df, S).collect()}
    assert cells[0, 0] == 0.5 and cells[1, 2] == 1.0 and abs(cells[2, 2] - 2 / 3) < 1e-12 and len(cells) == 9
    switches = {(r["from_regime"], r["to_regime"]) for r in P.transition_triggers(df, S).collect()}
    assert switches == {(0, 1), (1, 2)}  # the switch into the last bar is not counted


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=700), np.full(600, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(len(values)) % 3 == 0, "a", "b"), "x": values}))
    probs = (0.0, 0.1, 0.33, 0.5, 0.67, 0.999, 1.0)
    got = exact_quantiles(df, ["g"], ["x"], probs).toPandas()
    for g, part in df.toPandas().groupby("g"):
        for q in probs:
            value = got[(got["g"] == g) & (got["prob"] == q)]["quantile"].iloc[0]
            assert abs(value - np.quantile(part["x"], q)) < 1e-12


def test_exact_quantiles_send_no_group_to_one_task(spark, capsys):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(["a", "b"], 4000), "x": rng.normal(size=8000)}))
    got = exact_quantiles(df, ["g"], ["x"], (0.25, 0.5))
    got.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out  # one on (g, feature) gave a task all values of a group
    for r in got.collect():
        part = df.where(F.col("g") == r["g"]).toPandas()["x"]
        assert abs(r["quantile"] - np.quantile(part, r["prob"])) < 1e-12


@pytest.mark.parametrize("kind", ["near each other", "near each other and one far", "all sizes", "equal"])
def test_exact_quantiles_cut_large_bins(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "SORTED", 20)
    rng = np.random.default_rng(4)
    near = 1.7e9 + rng.random(900) * 1e-3
    signs = rng.choice([-1.0, 0.0, 1.0], 900)
    values = {
        "near each other": near,
        "near each other and one far": np.append(near, 1.7001e9),
        "all sizes": np.append(signs * 10.0 ** rng.uniform(-320, 305, 900), [-0.0, 5e-324, 1e305, -1e305]),
        "equal": np.append(np.full(900, 0.1), [np.nan, 0.2]),
    }[kind]
    probs = (0.0, 0.001, 0.3, 0.5, 0.77, 1.0)
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], ["x"], probs).collect()}
    kept = np.sort(values[~np.isnan(values)])
    for q in probs:
        at = q * (len(kept) - 1)
        low, high = kept[int(np.floor(at))], kept[int(np.ceil(at))]
        assert got[q] == low + (high - low) * (at - np.floor(at))


def test_silhouette_against_brute_force(make):
    rng = np.random.default_rng(1)
    n = 60
    pdf = pd.DataFrame({"symbol": "X", "timestamp": 3600 * np.arange(n), "regime": rng.integers(0, 3, n),
                        "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[0, "regime"] = 7  # a cluster of one row scores 0
    df = make(pdf)
    x = pdf[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    gap = x[:, None] - x[None]
    for fn, dist, name in ((E.silhouette_euclidean, np.sqrt((gap**2).sum(-1)), "silhouette_score"),
                           (E.silhouette_squared, (gap**2).sum(-1), "silhouette_squared")):
        y, scores = pdf["regime"].to_numpy(), []
        for i in range(n):
            own = (y == y[i]) & (np.arange(n) != i)
            if not own.any():
                scores.append(0.0)
                continue
            a, b = dist[i, own].mean(), min(dist[i, y == c].mean() for c in set(y) - {y[i]})
            scores.append((b - a) / max(a, b))
        assert abs(fn(df, features=["a", "b"]).first()[name] - np.mean(scores)) < 1e-9


def test_label_ranks_follow_mean_volatility(spark):
    df = spark.createDataFrame([("X", 2, 0.1), ("X", 0, 0.9), ("X", 2, 0.2)], "symbol string, raw int, vol double")
    got = {r["raw"]: r["regime"] for r in R.label_rank_map(df, "raw", "vol", clusters=3).collect()}
    assert got == {1: 0, 2: 1, 0: 2}
    assert {r["raw"]: r["regime"] for r in R.label_rank_map(df, "raw", "vol").collect()} == {2: 0, 0: 1}


def test_threshold_of_missing_volatility_is_high(spark):
    df = spark.createDataFrame([("X", float(i)) for i in range(9)] + [("X", None)], "symbol string, vol_60m double")
    assert R.regime_threshold(df).where("vol_60m is null").first()["regime"] == 2


def test_multi_indicator_falls_back(spark):
    df = spark.createDataFrame([("X", float(i)) for i in range(9)], "symbol string, vol_60m double")
    assert R.regime_multi_indicator(df).groupBy("regime").count().count() == 3


def test_capped_sample_is_repeatable_and_near_the_cap(spark):
    df = spark.range(20000).select(F.lit("X").alias("symbol"), "id")
    a, b = (E.capped_sample(df.repartition(n), ["symbol"], 1000, ["id"]).select("id").toPandas()["id"] for n in (3, 7))
    assert set(a) == set(b) and 850 < len(a) < 1150
    assert E.capped_sample(df.limit(500), ["symbol"], 1000, ["id"]).count() == 500


def test_composite_rank_with_missing_and_constant_metrics(spark):
    df = spark.createDataFrame([("a", 0.1, 5.0, None), ("b", 0.3, 5.0, 2.0), ("c", 0.2, 5.0, 4.0)],
                               "method string, silhouette_score double, regime_balance double, davies_bouldin_score double")
    got = {r["method"]: (r["composite_score"], r["rank"]) for r in K.composite_rank(df).collect()}
    assert got["a"] == (0.25, 3) and got["b"][1] == 1 and abs(got["b"][0] - 2.5 / 3) < 1e-12


def test_histogram_and_density(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"symbol": "X", "regime": 0, "log_return": rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    counts, edges = np.histogram(pdf["log_return"], bins=10)
    got = {r["bin"]: r["n"] for r in histogram(df, ["symbol", "regime"], "log_return", F.lit(10)).collect()}
    assert got == {i: c for i, c in enumerate(counts) if c}
    curve = return_density(df, points=400).toPandas().sort_values("x")
    assert abs(np.trapezoid(curve["density"], curve["x"]) - 1) < 1e-3


def test_density_equals_all_kernels(spark):
    """Of repeated, far and missing values, of groups with a null key or without variation."""
    rng = np.random.default_rng(5)
    groups = {"X": np.round(rng.normal(size=300), 2), None: np.append(rng.normal(size=50), 40.0), "one": np.full(4, 2.5), "single": np.array([1.0])}
    rows = [(k, 0, float(x)) for k, g in groups.items() for x in g] + [("X", 0, None), ("empty", 0, None)]
    got = return_density(spark.createDataFrame(rows, "symbol string, regime int, log_return double"), points=200).toPandas()
    assert len(got) == 200 * len(groups)
    for key, x in groups.items():
        curve = got[got["symbol"].isna() if key is None else got["symbol"] == key].sort_values("point")
        if len(set(x)) == 1:
            assert curve["density"].isna().all()
            continue
        span, h = x.max() - x.min(), x.std(ddof=1) * len(x) ** -0.2
        at = np.linspace(x.min() - span / 2, x.max() + span / 2, 200)
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert np.allclose(curve["x"], at) and np.abs(curve["density"] - want).max() < 1e-12
