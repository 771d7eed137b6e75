import numpy as np
import pytest

from posemill.operators import metrics, vectors


def frame(spark, scores, labels, group="g"):
    return spark.createDataFrame([(group, f"m{i}", float(s) if s is not None else None, y) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "g string, n string, s double, y int")


def test_areas_of_perfect_and_reversed_scores(spark):
    y = [1] * 5 + [0] * 45
    best = metrics.curve_areas(frame(spark, range(50), y), "s", "y", ["g"]).first()
    worst = metrics.curve_areas(frame(spark, range(50, 0, -1), y), "s", "y", ["g"]).first()
    assert best["auc_roc"] == 1 and best["auc_croc"] == pytest.approx(1) and best["auc_bedroc"] == pytest.approx(1)
    assert worst["auc_roc"] == 0 and worst["auc_bedroc"] == pytest.approx(0, abs=1e-6)


def test_roc_against_pairs_and_symmetry(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 9, 60), rng.integers(0, 2, 60)
    pairs = [(a < b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    up = metrics.curve_areas(frame(spark, s, y.tolist()), "s", "y", ["g"]).first()
    down = metrics.curve_areas(frame(spark, -s, y.tolist()), "s", "y", ["g"]).first()
    assert up["auc_roc"] == pytest.approx(np.mean(pairs)) and down["auc_roc"] == pytest.approx(1 - up["auc_roc"])
    assert 0 <= up["auc_bedroc"] <= 1


def test_one_class_missing_and_empty(spark):
    one = metrics.curve_areas(frame(spark, [1, 2, None], [1, 1, 0]), "s", "y", ["g"]).first()
    assert one["n_actives"] == 2 and one["n_inactives"] == 0 and one["auc_roc"] is None
    assert metrics.curve_areas(frame(spark, [1], [1]).limit(0), "s", "y", ["g"]).count() == 0


def test_enrichment_takes_whole_blocks(spark):
    df = frame(spark, [1, 2, 2, 2, 5, 6, 7, 8, 9, 10], [1, 1, 0, 0, 1, 0, 0, 0, 0, 0])
    r = metrics.enrichment_factor(df, "s", "y", ["g"], 20.0).first()
    assert (r["n_selected"], r["hits"], r["norm_ef"]) == (4, 2, 0.5) and r["ef"] == pytest.approx(0.5 / 0.3)
    assert metrics.enrichment_factor(df, "s", "y", ["g"], 5.0).count() == 0
    assert sorted(x["n"] for x in metrics.actives_in_top(df, "s", "y", "n", ["g"], 2).collect()) == ["m0", "m1"]
    assert metrics.scaffold_enrichment(df, "s", "y", "n", ["g"], 20.0).first()["share"] == pytest.approx(2 / 3)


def test_confusion_without_division_by_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (None, 1)], "y int, p int")
    r = metrics.confusion(df, "p", "y", []).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["tpr"], r["fpr"], r["lr_plus"], r["mk"]) == (2, 0, 1, 0, 1.0, 0.0, None, 1.0)


def test_scalar_distances_against_definitions():
    rng = np.random.default_rng(1)
    x, q = rng.random((6, 5)), rng.random((3, 5))
    got = vectors.scalar_distances(x, q, vectors.SCALAR, variance=np.ones(5))
    for i in range(6):
        for j in range(3):
            a, b = x[i], q[j]
            p, r = a / a.sum(), b / b.sum()
            m = (p + r) / 2
            assert got["cityblock"][i, j] == pytest.approx(np.abs(a - b).sum())
            assert got["canberra"][i, j] == pytest.approx((np.abs(a - b) / (a + b)).sum())
            assert got["braycurtis"][i, j] == pytest.approx(np.abs(a - b).sum() / (a + b).sum())
            assert got["seuclidean"][i, j] == pytest.approx(got["euclidean"][i, j])
            assert got["correlation"][i, j] == pytest.approx(1 - np.corrcoef(a, b)[0, 1])
            assert got["jensenshannon"][i, j] == pytest.approx(np.sqrt(((p * np.log(p / m)).sum() + (r * np.log(r / m)).sum()) / 2))


def test_boolean_distances_of_equal_and_opposite():
    x = np.array([[1, 1, 0, 0]])
    same, other = vectors.boolean_distances(x, x, vectors.BOOLEAN), vectors.boolean_distances(x, 1 - x, vectors.BOOLEAN)
    for m in ("yule", "hamming", "sokalsneath", "Tanimoto", "Dice", "CosineBits", "Sokal", "Asymmetric", "BraunBlanquet", "Tversky", "Kulczynski", "McConnaughey"):
        assert same[m][0, 0] == pytest.approx(0), m
    assert other["Tanimoto"][0, 0] == 1 and other["hamming"][0, 0] == 1


def test_pair_distances_leave_out_broken_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [2.0, 4.0]), (6, [1.0])], "k long, v array<double>")
    out = vectors.pair_distances(df, df.where("k = 1"), "k", "v", ("cosine", "euclidean"))
    assert sorted((r["id"], round(r["cosine"], 6)) for r in out.collect()) == [(1, 0.0), (5, 0.0)]
    assert vectors.pair_distances(df, df.limit(0), "k", "v", ("cosine",)).count() == 0
    size, vectors.BLOCK_BYTES = vectors.BLOCK_BYTES, 1
    try:
        many = vectors.pair_distances(df, df, "k", "v", ("cosine", "euclidean"))
        assert sorted((r["id"], r["query_id"]) for r in many.collect()) == [(1, 1), (1, 5), (5, 1), (5, 5), (6, 6)]
        vectors.BLOCK_BYTES = size
        assert vectors.pair_distances(df, df, "k", "v", vectors.SCALAR + vectors.BOOLEAN).count() == 5
    finally:
        vectors.BLOCK_BYTES = size
    assert vectors.similarity_weights(out, "euclidean").count() == 2
    z = vectors.max_variance_metric(out, ["cosine", "euclidean"], unique_share=0.4)
    assert {r["metric"] for r in z.collect()} <= {"cosine", "euclidean"}
    with pytest.raises(ValueError):
        vectors.pair_distances(df, df, "k", "v", ("nope",))
