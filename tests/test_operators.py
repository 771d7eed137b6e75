import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from posemill.functions import chemistry
from posemill.operators import filters, joins, quantiles, ranking, reduce, residues, scaling, vectors

NAN = float("nan")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture
def poses(spark):
    return spark.createDataFrame(
        [("a", 1, -7.0), ("a", 2, -6.5), ("a", 3, -5.9), ("a", 4, -7.0), ("b", 1, None), ("b", 2, NAN), ("c", 1, -1.0), (None, 1, -3.0)],
        "v string, pose int, score double",
    )


def test_top_window(poses):
    assert rows(filters.top_window(poses, ["v"], "score", 1.0, 100), "v", "pose") == [("a", 1), ("a", 2), ("a", 4), ("c", 1), (None, 1)]
    assert rows(filters.top_window(poses, ["v"], "score", 1.0, 1), "v", "pose") == [("a", 1), ("a", 4), ("c", 1), (None, 1)]
    assert rows(filters.top_window(poses, [], "score", 1.0, None), "v", "pose") == [("a", 1), ("a", 2), ("a", 4)]
    assert filters.top_window(poses.limit(0), ["v"], "score", 1.0, 1).count() == 0


def test_mad_keeps_singletons_and_handles_no_spread(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 9.0)] + [("b", 5.0), ("c", None), ("c", NAN)], "g string, x double")
    kept = filters.without_outliers(df, ["g"], ["x"], 3.5)
    assert sorted(r["g"] for r in kept.collect()) == ["a", "a", "a", "b", "c", "c"]
    assert filters.without_outliers(kept, ["g"], ["x"], 3.5).count() == kept.count()
    assert filters.without_outliers(df.limit(0), ["g"], ["x"], 3.5).count() == 0
    assert filters.mad_mask(df, [], "x", 3.5, logarithm=True).count() == 7


def test_well_scored(poses):
    good, bad = filters.well_scored(poses, ["v"], F.col("score").isNotNull() & ~F.isnan("score"), 0.8)
    assert good.count() == 6 and rows(bad, "v", "ratio") == [("b", 0.0)]


def test_uniform_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0, None, 1), (1, "x", NAN, None, 2)], "a int, b string, c double, d string, `e f` int")
    assert filters.uniform_columns(df) == ["a", "b"] and filters.uniform_columns(df, ("a",)) == ["b"]
    assert filters.uniform_columns(df.limit(0)) == []
    assert filters.select_in_order(df, ["c", "a", "zz"]).columns == ["a", "c"]


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, NAN, "y"), (3, 5.0, "z")], "k int, s double, l string")
    b = spark.createDataFrame([(1, None, 10), (2, NAN, 20), (4, 5.0, 30)], "k int, s double, r int")
    assert rows(joins.natural_join(a, b), "l", "r") == [("x", 10), ("y", 20)]
    assert joins.natural_join(a, b, how="full").count() == 4
    assert joins.natural_join(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        joins.natural_join(a, spark.range(1))
    with pytest.raises(ValueError):
        joins.null_safe_join(a, b, ["k"])
    clash = b.withColumnRenamed("r", "_right_k")
    assert joins.natural_join(a, clash).count() == 2


def test_beside_and_members(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(joins.beside(a, a.agg(F.max("k").alias("m"))), "k", "m") == [(1, 2), (2, 2), (None, 2)]
    assert rows(joins.members(a, a.where("k = 1"), ["k"]), "k") == [(1,)]
    assert rows(joins.members(a, a.where("k = 1"), ["k"], keep=False), "k") == [(2,), (None,)]
    with pytest.raises(ValueError):
        joins.join_all(["k"], a.withColumn("z", F.lit(1)), a.withColumn("z", F.lit(1)))


def test_ranks_with_ties_and_missing(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 2.0), ("g", None), ("g", NAN), (None, 4.0)], "g string, x double")
    got = {m: rows(ranking.add_ranks(df, "x", m, "r", ["g"]), "g", "x", "r") for m in ("min", "dense", "average", "share")}
    pick = lambda m, x: next(r[2] for r in got[m] if r[0] == "g" and r[1] == x)
    assert (pick("min", 1.0), pick("min", 2.0)) == (1, 3) and (pick("dense", 2.0), pick("average", 1.0)) == (2, 1.5)
    assert pick("share", 2.0) == 1.0 and pick("min", None) is None and all(len(v) == 6 for v in got.values())
    assert ranking.add_ranks(df.limit(0), "x", "min", "r").count() == 0


def test_negative_zscore_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", None)], "g string, x double")
    assert rows(ranking.negative_zscore(df, "x", "z", ["g"]), "g", "z") == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0), ("b", None)]


def test_latest_and_two_steps(spark):
    df = spark.createDataFrame([("v1", "m", 1, 5.0, 2.0, 1), ("v1", "m", 1, 4.0, 3.0, 2), ("v2", "m", 1, 9.0, 1.0, None)], "v string, m string, p int, c double, e double, t int")
    new = reduce.latest(df, ["v", "p"], ["t"])
    assert rows(new, "v", "c") == [("v1", 4.0), ("v2", 9.0)]
    best = reduce.best_in_two_steps(df, ["v"], ["m"], "c", "e", ["p", "t"], "fused")
    assert rows(best, "v", "fused") == [("v2", 1.0)]
    assert reduce.latest(df.limit(0), ["v", "p"], ["t"]).count() == 0


def test_minima_and_histogram(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.5), ("a", 9.0), ("b", None)], "g string, x double")
    assert rows(reduce.all_minima(df, ["g"], "x"), "g", "x") == [("a", 1.0), ("a", 1.0)]
    h = {r["g"]: tuple(r)[1:] for r in reduce.energy_histogram(df, ["g"], "x").collect()}
    assert h == {"a": (2, 1, 0, 0, 0, 0), "b": (0,) * 6}
    assert rows(reduce.class_shares(df, ["g"], "x", "s"), "g", "s")[0] == ("a", 0.25)
    assert rows(reduce.type_counts(df, ["g"], "g", ["a", "z"], "n_"), "n_a", "n_z") == [(0, 0), (4, 0)]


def test_moments_of_one_row(spark):
    r = reduce.moments(spark.createDataFrame([("a", 1.0)], "g string, x double"), ["g"], "x").first()
    assert r["stderr"] is None and r["stdev"] == 0 and r["skewness"] is None


def test_scaling_constant_missing_empty(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", None, NAN)], "g string, x double, y double")
    for f in (scaling.minmax, scaling.standardize):
        for by in (None, ["g"]):
            out = f(df, ["x", "y"], by)
            assert out.columns == df.columns and out.where("y = 0").count() == 2 and out.where("x is null and y is null").count() == 1
            assert f(df.limit(0), ["x", "y"], by).count() == 0
    assert rows(scaling.standardize(df, ["x"], ["g"]).where("g = 'a'"), "x") == [(-1.0,), (1.0,)]


def test_discretize(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, None)], "x double")
    assert [r["b"] for r in scaling.discretize(df, "x", [0.0, 1.0], "b").collect()] == [0, 1, 1, 2, 2, None]
    edges = scaling.auto_edges(df, "x")
    assert edges[0] == -1.0 and edges[-1] == pytest.approx(2.0) and scaling.auto_edges(df.limit(0), "x") == []
    assert scaling.fixed_edges(0.0, 1.0, 0.5, centred=True) == [-0.25, 0.25, 0.75, 1.25]


def test_discretize_auto_with_far_values(spark):
    values = [0.0, -0.0, 0.125, 1e6, None, NAN, *[i / 7 for i in range(500)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id int, x double")
    edges = scaling.auto_edges(df, "x")
    assert len(edges) > 50_000  # listed for every row, these would take minutes
    began = time.monotonic()
    out = scaling.discretize_auto(df, "x", "b")
    assert dict(out.dtypes)["b"] == "int"
    got = {r["id"]: r["b"] for r in out.collect()}
    assert time.monotonic() - began < 60
    assert got == {i: None if x is None or x != x else bisect.bisect_right(edges, x) for i, x in enumerate(values)}
    for few in ([1.5], [1.5, 1.5, None], [0.1 * i for i in range(100)], [2.0**52 + i for i in range(5)]):
        small = spark.createDataFrame([(x,) for x in few], "x double")
        own = scaling.auto_edges(small, "x")
        pairs = [(r["x"], r["b"]) for r in scaling.discretize_auto(small, "x", "b").collect()]
        assert all(b == (None if x is None else bisect.bisect_right(own, x)) for x, b in pairs) and len(pairs) == len(few)
    assert scaling.discretize_auto(df.limit(0), "x", "b").count() == 0
    close = scaling.discretize_equal(spark.createDataFrame([(1.0,), (1 + 2**-52,), (2.0,), (0.0,)], "x double"), "x", 1.0, 1 + 2**-52, 10, "b")
    same = [1.0 + 2**-52 * i / 10 for i in range(11)]
    assert [r["b"] for r in close.collect()] == [bisect.bisect_right(same, x) for x in (1.0, 1 + 2**-52, 2.0, 0.0)]


def test_fusion_skips_missing(spark):
    df = spark.createDataFrame([(2.0, 8.0), (None, 4.0), (NAN, None)], "a double, b double")
    out = df.select(*[scaling.fuse(["a", "b"], h).alias(h) for h in ("min", "sum", "geo", "harm")]).collect()
    assert tuple(out[0]) == pytest.approx((2.0, 10.0, 4.0, 3.2)) and tuple(out[1]) == pytest.approx((4.0, 4.0, 2.0, 8.0))
    assert tuple(out[2]) == (None,) * 4


def test_running_totals_over_ranges(spark):
    df = spark.createDataFrame([(g, float(x), x % 3) for g in (None, "a") for x in range(50)], "g string, x double, n int")
    for descending in (False, True):
        out = ranking.running_totals(df, ["g"], "x", {"n": ("s", "t")}, descending, hot_rows=3, parts=7).collect()
        for g in (None, "a"):
            mine = sorted((r for r in out if r["g"] == g), key=lambda r: -r["x"] if descending else r["x"])
            assert [r["s"] for r in mine] == [sum(r["n"] for r in mine[: i + 1]) for i in range(50)] and {r["t"] for r in mine} == {49}
    assert ranking.running_totals(df.limit(0), ["g"], "x", {"n": ("s", "t")}).count() == 0


def test_quantiles_of_large_and_small_groups(spark):
    rng = random.Random(5)
    rows = [("big", round(rng.gauss(0, 3), 1)) for _ in range(301)] + [("two", 1.0), ("two", 4.0), ("none", None), (None, 2.0), ("big", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    for by in (["g"], []):
        plain = sorted(map(str, quantiles.group_quantiles(df, by, "x", want).collect()))
        assert sorted(map(str, [r for r in quantiles.group_quantiles(df, by, "x", want, hot_rows=50).collect()])) == plain
    assert quantiles.group_quantiles(df.limit(0), ["g"], "x", want).count() == 0


def test_reports_and_columns(spark):
    df = spark.createDataFrame([("a", float(i % 3), 1) for i in range(9)] + [("a", 99.0, 1), ("b", 5.0, None), ("c", None, None)], "g string, x double, s int")
    assert [tuple(r) for r in filters.outlier_report(df, ["g"], "x", 3.5, ["g", "x"]).collect()] == [("a", 99.0)]
    shown = filters.outlier_report(df, ["g"], "x", 3.5, ["g", "x"], F.col("s").isNotNull(), 1).collect()
    assert sorted(map(str, shown)) == sorted(["Row(g='a', x=99.0)", "Row(g='b', x=5.0)", "Row(g='c', x=None)"])
    wide = spark.createDataFrame([(1, 2, 4, 0)], "id int, DeltaG_0to1 int, DeltaG_1to2 int, n int")
    assert filters.matching_columns(wide, "^DeltaG_[0-9]to", ("id",)).columns == ["id", "DeltaG_0to1", "DeltaG_1to2"]
    assert filters.ratio_columns(wide, "^DeltaG_", "n").first()["DeltaG_0to1_ratio"] is None
    assert filters.ratio_columns(wide, "^DeltaG_", "DeltaG_0to1").first()["DeltaG_1to2_ratio"] == 2


def test_metric_set_follows_the_data(spark):
    bits = spark.createDataFrame([([1.0, 0.0],), ([0.0, None],)], "v array<double>")
    assert vectors.metrics_for(bits, "v") == vectors.BOOLEAN
    assert vectors.metrics_for(bits.union(spark.createDataFrame([([0.5, 1.0],)], "v array<double>")), "v") == vectors.SCALAR


def test_chunks_maps_and_positions(spark):
    df = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    sizes = {r["c"]: r["count"] for r in filters.weighted_chunks(df, "k", [1, 2, 1], "c").groupBy("c").count().collect()}
    assert abs(sizes[0] - 1000) < 120 and abs(sizes[1] - 2000) < 150 and sum(sizes.values()) == 4000
    atom = "array<struct<x: double, y: double, z: double>>"
    two = spark.createDataFrame([([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], [(1.0, 0.0, 0.0), (0.0, 0.0, 2.0)], [[0, 1], [1, 0]])], f"a {atom}, b {atom}, m array<array<int>>")
    row = two.select(chemistry.rmsd("a", "b").alias("p"), chemistry.symmetric_rmsd("a", "b", "m").alias("q")).first()
    assert row["p"] == pytest.approx((6 / 2) ** 0.5) and row["q"] == pytest.approx((4 / 2) ** 0.5)
    fp = spark.createDataFrame([([0.0, 5.0, 4.0, 5.0],), ([2.0, 5.0, 1.0, 5.0],)], "f array<double>")
    assert [list(r["f"]) for r in residues.minmax_by_position(fp, "f", 2).collect()] == [[0.0, 0.0, 1.0, 0.0], [0.5, 0.0, 0.25, 0.0]]
