import numpy as np
import pytest

from posemill.operators import learning


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("p1", 60), ("p2", 40), ("p3", 20)):
        for _ in range(n):
            a, b = rng.normal(size=2)
            rows.append((g, float(a), float(b), int(a + 0.3 * rng.normal() > 0)))
    rows.append(("p3", None, 1.0, 1))
    return spark.createDataFrame(rows, "g string, a double, b double, y int").cache()


def test_folds_partition_the_groups(table):
    f = learning.folds(table, "g")
    assert [t for _, t in f] == ["p1", "p2", "p3"] and all(t not in tr for tr, t in f)
    assert learning.folds(table.where("g = 'p1'"), "g") == []
    assert learning.fold_table(table, "g").count() == 6


def test_group_weights(table):
    w = {r["g"]: r["w"] for r in learning.group_weights(table, "g", "w").select("g", "w").distinct().collect()}
    assert w["p1"] == 1.0 and w["p3"] == 2.0 and 1 < w["p2"] < 2
    assert learning.group_weights(table.where("g = 'p1'"), "g", "w").first()["w"] == 1.0


def test_grouped_logistic_minimises_its_objective(table):
    m = learning.fit(table, "grouped_logistic_regression", ["a", "b"], "y", "g")
    rows = learning.group_weights(learning.assemble(table, ["a", "b"], "y"), "g", "w").collect()
    x = np.array([[r["a"], r["b"], 1.0] for r in rows])
    y, w = np.array([r["y"] for r in rows]), np.array([r["w"] for r in rows])
    beta = np.append(m.coefficients.toArray(), m.intercept)
    p = 1 / (1 + np.exp(-x @ beta))
    gradient = x.T @ (w * (p - y)) + np.append(beta[:2], 0)
    assert np.abs(gradient).max() < 1e-3


@pytest.mark.parametrize("name", ["logistic_regression", "linear_svc", "random_forest", "gradient_boosting", "neural_network"])
def test_models_learn(table, name):
    m = learning.fit(table, name, ["a", "b"], "y")
    out = learning.predict(m, table, ["a", "b"], "p").collect()
    assert len(out) == 120
    p, y = np.array([r["p"] for r in out]), np.array([r["y"] for r in out])
    if name != "neural_network":
        assert p[y == 1].mean() > p[y == 0].mean()


def test_reduction_importance_selection(spark, table):
    out, _, names = learning.reduce_dimensions(table, table.limit(0), ["a", "b"], 0.4)
    assert names == ["plec_pc1"] and out.count() == 120
    forest = learning.fit(table, "random_forest", ["a", "b"], "y")
    imp = {r["feature"]: r["importance"] for r in learning.importances(spark, forest, ["a", "b"]).collect()}
    assert imp["a"] > imp["b"] and learning.select_features(forest, ["a", "b"], 1) == ["a"]
    con = {r["feature"]: (r["contribution"], r["share"]) for r in learning.tree_contributions(forest, table, ["a", "b"]).collect()}
    assert con["a"][0] > con["b"][0] and sum(c[1] for c in con.values()) == pytest.approx(1)
    lr = learning.fit(table, "logistic_regression", ["a", "b"], "y")
    perm = {r["feature"]: r["importance"] for r in learning.permutation_importance(lr, table, ["a", "b"], "y").collect()}
    assert perm["a"] > 0.2 > abs(perm["b"])


def test_leave_one_out_and_grid(spark, table):
    out = {r["test_group"]: r["auc_roc"] for r in learning.leave_one_out(table, "logistic_regression", ["a", "b"], "y", "g").collect()}
    assert set(out) == {"p1", "p2", "p3"} and min(out.values()) > 0.9
    assert learning.hyper_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    assert learning.stability_selection(table, ["a", "b"], "y", 0.1, repeats=3).where("feature = 'a'").first()["frequency"] == 1.0


def test_boosting_kernel_and_cross_validation(table):
    model = learning.fit_adaboost(table, ["a", "b"], "y", rounds=4)
    out = learning.predict(model, table, ["a", "b"], "p").collect()
    right = sum((r["p"] > 0.5) == (r["y"] == 1) for r in out)
    assert len(out) == 120 and right > 100 and 1 <= len(model.trees) <= 4
    mapped, names = learning.random_fourier(table.dropna("any"), ["a", "b"], 400, gamma=0.5)
    rows = mapped.limit(12).collect()
    x, z = np.array([[r["a"], r["b"]] for r in rows]), np.array([[r[n] for n in names] for r in rows])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.25
    lr = learning.fit_cross_validated(table, ["a", "b"], "y", [0.1, 1.0], 2)
    assert lr.coefficients[0] > abs(lr.coefficients[1])
    reg = {r["feature"]: r["coefficient"] for r in learning.regression(table, ["a", "b"], "y", "lasso", 0.05).collect()}
    assert reg["a"] > 0.1 and abs(reg["b"]) < 0.05


def test_permutation_importance_covers_all_features(spark, data):
    from posemill.plans.learned import FEATURE_COLUMNS, perm_importance

    assert sorted(r["feature"] for r in perm_importance(spark, data).collect()) == sorted(FEATURE_COLUMNS)
