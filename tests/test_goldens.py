"""Identities between published numbers (fixed values) hold for our formulas."""

import math

from pyspark.sql import functions as F

from voltide.operators import evaluation as E
from voltide.operators import garch as G
from voltide.operators import ranking as K
from voltide.operators.spells import transition_matrix
from voltide.plans.series import Series

# regime, rows, return deviation, volatility mean, volatility deviation
REGIMES = [(0, 12690, 0.0036237056437855497, 0.0035640482696722895, 0.0013293892520083095),
           (1, 197, 0.02324630342636653, 0.006186649827866577, 0.0025267741818584192),
           (2, 3912, 0.006806947986455958, 0.0077564596772833035, 0.002883065408225717)]
# method, silhouette, volatility separation, Davies-Bouldin
METHODS = [("threshold", 0.027209318038226713, 14232.932290897306, 3.0715793152128583),
           ("hmm", 0.07661028480994493, 9496.4324720368, 2.894529791292848),
           ("kmeans", 0.2252085600351645, 7334.206207612977, 1.7779882232233849),
           ("gmm", 0.17015188812374268, 5512.066248056618, 2.1786358495422635),
           ("patchtst", 0.030781664887934046, 597.5012753084309, 5.664669427143912),
           ("garch", 0.25368763193370303, 7933.461272156431, 2.1126778637388957),
           ("informer", 0.0395692107359661, 13997.56203167747, 2.913370788158311)]


def test_balance_and_separation(spark):
    rows = spark.createDataFrame(REGIMES, "regime int, n int, rs double, vm double, vs double").withColumn("symbol", F.lit("X"))
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert abs(E.regime_balance(each).first()["regime_balance"] - 0.5492259974942548) < 1e-12
    groups = rows.withColumn("var", F.col("vs") * F.col("vs"))
    f = E.anova_f(groups, ["symbol"], "n", "vm", "var").first()["volatility_separation"]
    assert abs(f / 7933.461272156431 - 1) < 1e-9


def test_share_weighted_deviation(spark):
    """Returns of two opposite values (and a zero where their number is odd) with the published deviations."""
    rows = spark.createDataFrame([(r, n, sd * math.sqrt((n - 1) / (n - n % 2))) for r, n, sd, *_ in REGIMES], "regime int, n int, a double")
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    sign = F.when((F.col("i") == F.col("n")) & (F.col("n") % 2 == 1), 0).when(F.col("i") % 2 == 0, 1).otherwise(-1)
    each = each.select(F.lit("X").alias("symbol"), "regime", (F.col("a") * sign).alias("log_return"))
    assert each.count() == 16799
    assert abs(E.within_regime_volatility(each).first()["within_regime_volatility"] - 0.004595102501199392) < 1e-12


def test_average_tie_ranks(spark):
    df = spark.createDataFrame(METHODS, "method string, silhouette_score double, volatility_separation double, davies_bouldin_score double")
    ranks = {r["method"]: r["avg_rank"] for r in K.rank_by_metric(df).collect()}
    assert abs(ranks["garch"] - 7 / 3) < 1e-12 and abs(ranks["kmeans"] - 8 / 3) < 1e-12 and min(ranks, key=ranks.get) == "garch"
    assert K.best_method(df).first()["best_method"] == "garch"


def test_multi_step_forecast(spark):
    # first two published steps and the parameters of regime 0
    omega, alpha, beta = 8.437192043035124e-07, 0.17688059602802844, 0.7753333736638849
    h1, h2 = 9.133897740915812e-06, 9.541144230940956e-06
    state = spark.createDataFrame([(0, omega, alpha, beta, 0.0, (h1 - omega) / beta)],
                                  "active_regime int, omega double, alpha double, beta double, last_return double, last_variance double")
    steps = {r["step"]: r for r in G.multi_step(state, 168).collect()}
    assert abs(steps[1]["forecast_variance"] / h1 - 1) < 1e-12 and abs(steps[2]["forecast_variance"] / h2 - 1) < 1e-9
    h = h1
    for i in range(2, 169):
        h = omega + (alpha + beta) * h
        assert abs(steps[i]["forecast_variance"] / h - 1) < 1e-9
    assert abs(steps[1]["forecast_vol_ann"] - 0.28286559389650506) < 1e-12 and abs(steps[168]["forecast_vol"] - 0.004202) < 1e-6


def test_improvement(spark):
    schema = "symbol string, rmse double, mae double, mape_pct double, qlike double, corr double"
    base = spark.createDataFrame([("X", 0.0001224925673914415, 2.8904824864090917e-05, 137196.82742882532, -9.997530300768753, 0.1599)], schema)
    rs = spark.createDataFrame([("X", 0.00010829358413862492, 2.5211499973798605e-05, 118813.45593015592, -10.287668658890263, 0.4649)], schema)
    got = {r["metric"]: r for r in G.model_improvement(base, rs, ["symbol"]).collect()}
    for metric, want in (("rmse", 11.59), ("mae", 12.78), ("mape_pct", 13.40), ("qlike", 2.90)):
        assert abs(got[metric]["improvement_pct"] - want) < 0.006 and got[metric]["winner"] == "regime_switching"


def test_transitions_over_outgoing_bars(spark):
    """12,690 bars of regime 0, the last of the series among them, 165 switches to 1 and 158 to 2."""
    labels = [0, 1] * 165 + [0, 2] * 158 + [0] * (12690 - 165 - 158)
    df = spark.createDataFrame([("X", 3600 * i, r) for i, r in enumerate(labels)], "symbol string, t long, regime int")
    matrix = transition_matrix(df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t"), Series(step=3600)).where("from_regime = 0").collect()
    got = {r["to_regime"]: r["probability"] for r in matrix}
    assert math.isclose(got[1], 0.013003388761919773, rel_tol=1e-12) and math.isclose(got[2], 0.01245172984474742, rel_tol=1e-12)
