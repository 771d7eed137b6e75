import math

import pytest
from pyspark.sql import functions as F

from posemill.functions import names as N
from posemill.functions import units


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_split_name_takes_the_greedy_base(spark):
    parts = N.split_name("x")
    row = spark.createDataFrame([("a_stereo9_b_stereo1_ion2_tau3_pose40",), ("nothing",), (None,)], "x string").select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert tuple(row[0]) == ("a_stereo9_b", 1, 2, 3, 40)
    assert tuple(row[1]) == (None,) * 5 and tuple(row[2]) == (None,) * 5


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (N.structvar_of, "m_stereo1_ion1_tau1_pose3_frm2", "m_stereo1_ion1_tau1"),
        (N.basemolname_of, "m_stereo1_ion1_tau1_pose3_frm2", "m"),
        (N.variant_suffix, "m_stereo1_ion1_tau1_pose3", "stereo1_ion1_tau1"),
        (N.variant_suffix, "m_stereo1_ion1_tau1_stereo2_ion3_tau4_frm1", "stereo2_ion3_tau4"),
        (N.basemolname_of, "m_iso12_noWAT_stereo1_ion1_tau1_WAT_pose1", "m"),
        (lambda c: F.concat_ws("/", N.variant_numbers(c)), "m_stereo01_ion2_tau30_pose1", "01/2/30"),
        (N.variant_suffix, "m", None),
        (N.pose_structvar, "m_stereo1_ion1_tau1_pose3", "m_stereo1_ion1_tau1"),
        (N.pose_structvar, "m_stereo1_ion1_tau1", None),
        (lambda c: N.level_of(c, "pose"), "a_pose1_pose22_frm3", 22),
        (lambda c: N.level_of(c, "frame"), "a_frm3_x", None),
        (lambda c: N.replace_any(c, ["a", "b"], "_"), "cab", "c__"),
        (lambda c: N.substitute_any(c, ["[0-9]+", "x"], ""), "x12y", "y"),
    ],
)
def test_name_parts(spark, make, value, expected):
    assert one(spark, make("x"), value) == expected


def test_conversions_invert(spark):
    df = spark.createDataFrame([(5.0,), (0.0,), (None,)], "k double").withColumn("e", units.ki_to_energy("k")).withColumn("b", units.energy_to_kd("e"))
    rows = df.collect()
    assert rows[0]["b"] == pytest.approx(5.0) and rows[1]["e"] is None and rows[2]["e"] is None
    assert spark.range(1).select(units.kj_to_kcal(F.lit(10.0)).alias("x")).first()["x"] == pytest.approx(2.38846)


def test_shapes_of_a_constant_and_an_empty_column(spark):
    constant = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    empty = constant.limit(0)
    for mode in ("none", "zscore", "minmax", "maxabs", "robust", "uniform", "normal", "l2", "odds", "energy", "energy_tenth", "energy_scaled", 11):
        out = [r["o"] for r in units.inhibition_shape(constant, "v", "o", mode).collect()]
        assert len(out) == 3 and out.count(None) >= 1, mode
        assert units.inhibition_shape(empty, "v", "o", mode).count() == 0
    with pytest.raises(ValueError):
        units.inhibition_shape(constant, "v", "o", "other")


def test_odds_melting_cutoff_reference(spark):
    df = spark.createDataFrame([("a", -10.0), ("b", 90.0), ("c", None)], "n string, v double")
    odds = {r["n"]: r["o"] for r in units.odds_scale(df, "v", "o").collect()}
    assert odds["a"] == 0 and odds["b"] == pytest.approx(100 / (101 - 100)) and odds["c"] is None
    melt = {r["n"]: r["o"] for r in units.melting_to_energy(df, "v", "o").collect()}
    assert melt["a"] == pytest.approx(-(12**0.7)) and melt["b"] == pytest.approx(-12)
    cut = {r["n"]: r["o"] for r in units.active_cutoff(df, "v", "o").collect()}
    assert cut == {"a": 1, "b": 0, "c": None}
    rel = {r["n"]: r["o"] for r in units.relative_to(df, "v", "o", "n", "b", 9.0).collect()}
    assert rel["a"] == pytest.approx(-1) and rel["c"] is None


def test_inhibition_shapes_by_hand(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (40.0,), (100.0,)], "v double")
    rt = 0.5957632602
    want = {
        "zscore": lambda v: -(v - 37.5) / 38.97114317029974, 2: lambda v: -0.8 * v / 100, "maxabs": lambda v: -v / 100, "l2": lambda v: -v / math.sqrt(11700),
        "robust": lambda v: -(v - 25) / (55 - 7.5), "uniform": lambda v: -[0.0, 10.0, 40.0, 100.0].index(v) / 3, 8: lambda v: -1000 * v / (101 - v),
        9: lambda v: rt * math.log(1 / (v + 1) / 100), 10: lambda v: rt * math.log(0.1 / (v + 1) / 100), 11: lambda v: rt * math.log(1 / (0.001 + v * 9.99999 + 1) / 100),
    }
    for mode, f in want.items():
        for r in units.inhibition_shape(df, "v", "o", mode).collect():
            assert r["o"] == pytest.approx(f(r["v"]), rel=1e-9, abs=1e-12), (mode, r["v"])
    kd = {r["v"]: r["o"] for r in units.melting_to_kd(df, "v", "o").collect()}
    assert kd[100.0] == pytest.approx(math.exp(-12 / rt) * 1e6)


def test_probit(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    out = {r["v"]: r["o"] for r in units.inhibition_shape(df, "v", "o", "normal").collect()}
    assert out[50.0] == pytest.approx(0, abs=1e-3) and out[97.0] == pytest.approx(-1.8808, abs=1e-3)
    assert math.isfinite(out[0.0]) and math.isfinite(out[100.0])
