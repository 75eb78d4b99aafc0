from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from voltide.operators import explain as X
from voltide.operators import forest as FO

D = 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, D)), 1)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float) + (x[:, 3] > 0.8)
    symbol = np.where(np.arange(700) < 500, "A", "B")
    rn = np.where(np.arange(700) < 500, np.arange(700), np.arange(700) - 500)
    size = np.where(symbol == "A", 500, 200)
    data = [(str(s), int(r), int(n), float(b), v.tolist()) for s, r, n, b, v in zip(symbol, rn, size, label, x)]
    return spark.createDataFrame(data, "symbol string, rn long, n_rows long, label double, x array<double>")


@pytest.fixture(scope="module")
def model(rows):
    return X.fit_forest(rows, trees=7, depth=4)


@pytest.fixture(scope="module")
def forest(spark, model):
    return FO.saved_forest(spark, model)


@pytest.fixture(scope="module")
def table(rows):
    return rows.toPandas()


@pytest.fixture(scope="module")
def x(table):
    return np.stack(table["x"])


def test_saved_forest_predicts_as_the_model(rows, model, forest, x):
    want = model.transform(rows.withColumn("features", array_to_vector("x"))).select(vector_to_array("probability").alias("p")).toPandas()
    assert np.allclose(forest.predict(x), np.stack(want["p"]), atol=1e-12)


def test_changed_predictions_equal_whole_walks(forest, x):
    rng = np.random.default_rng(0)
    paths, base = forest.paths(x), forest.predict(x)
    for j in range(D):
        columns = np.stack([rng.permutation(x[:, j]) for _ in range(3)])
        for column, more in zip(columns, FO.changed_predictions(forest, x, paths, j, columns)):
            other = x.copy()
            other[:, j] = column
            assert np.allclose(base + more / forest.trees, forest.predict(other), atol=1e-12)


def test_shapley_values_add_up(forest, x):
    background = x[::11]
    phi = FO.shapley_values(forest, x, background)
    assert np.abs(phi.sum(axis=2) - (forest.predict(x) - forest.predict(background).mean(axis=0))).max() < 1e-9


def test_shapley_values_equal_all_orders(forest, x):
    some, background = x[:6], x[100:104]
    phi = FO.shapley_values(forest, some, background)
    want = np.zeros_like(phi)
    orders = list(permutations(range(D)))
    for order in orders:
        for b in background:
            at = np.repeat(b[None], len(some), axis=0)
            before = forest.predict(at)
            for j in order:
                at[:, j] = some[:, j]
                after = forest.predict(at)
                want[:, :, j] += after - before
                before = after
    assert np.allclose(phi, want / len(orders) / len(background), atol=1e-9)


def test_a_forest_of_bare_roots_explains_nothing():
    leaf = np.full((2, 1), -1, dtype=np.int32)
    forest = FO.Forest(leaf, np.zeros((2, 1)), leaf, leaf, np.full((2, 1, 3), 1 / 3))
    x = np.ones((4, 2))
    assert np.allclose(forest.predict(x), 1 / 3)
    assert not FO.shapley_values(forest, x, x).any()
    assert not next(FO.changed_predictions(forest, x, forest.paths(x), 1, x[None, :, 1])).any()


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_permutation_hits_equal_brute_force(rows, forest, table, x, block_rows):
    got = {(r.j, r.repeat): (r.hits, r.n) for r in X.permutation_hits(forest, rows, ["symbol"], 2, block_rows).collect()}
    label = table["label"].to_numpy()
    assert got[-1, 0] == ((forest.predict(x).argmax(axis=1) == label).sum(), len(x))
    n, rn = table["n_rows"].to_numpy(), table["rn"].to_numpy()
    at = rn * 1_000_003 % n
    block = at * -(-n // block_rows) // n
    for repeat, prime in enumerate(X.PRIMES[:2]):
        partner = np.empty(len(x), dtype=int)
        for _, places in table.assign(at=at, block=block).groupby(["symbol", "block"]):
            places = places.sort_values("at").index.to_numpy()
            assert len(places) <= block_rows
            partner[places] = places[(np.arange(len(places)) * prime + repeat + 1) % len(places)]
        assert sorted(partner) == list(range(len(x)))
        for j in range(D):
            other = x.copy()
            other[:, j] = x[partner, j]
            assert got[j, repeat] == ((forest.predict(other).argmax(axis=1) == label).sum(), len(x))


def test_importances_find_what_the_label_follows(rows, model):
    out = X.permutation_importance(model, rows, list("abcde"), ["symbol"], 3).toPandas().set_index("feature")
    assert sorted(out["rank"]) == [1, 2, 3, 4, 5]
    assert out.loc["a", "perm_importance"] > out.loc["e", "perm_importance"]
    assert rows.agg(F.count("label")).first()[0] == 700
