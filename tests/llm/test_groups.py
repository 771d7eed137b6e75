"""Percentiles, cutoffs, top N, components and splits against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from posemill.llm.components import connected_components, linked_groups
from posemill.llm.cutoffs import keep_fraction_cutoffs, kept_records
from posemill.llm.percentiles import log_sketch, merge_sketches, sketch_percentiles
from posemill.llm.splits import assign_splits, closest_subset, split_plan
from posemill.llm.topn import top_n_per_group

NAN, INF = float("nan"), float("inf")


# ---- percentiles


def test_percentiles_keep_their_error_after_merging(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(0, 3, 500), -rng.lognormal(1, 2, 500), np.zeros(40), [1e-300, -1e300]])
    df = spark.createDataFrame([("g", i % 7, float(v)) for i, v in enumerate(values)] + [("g", 0, None), ("g", 1, NAN), (None, 0, 5.0)], "g string, day int, x double")
    merged = merge_sketches(log_sketch(df, ["g", "day"], "x", 0.02), ["g"])
    shares = [0.0, 0.1, 0.4, 0.5, 0.9, 1.0]
    out = sketch_percentiles(merged, ["g"], shares, 0.02).collect()
    ordered = np.sort(values)
    for r in out:
        if r["g"] == "g":
            exact = ordered[int(math.floor(r["share"] * (len(values) - 1)))]
            assert r["n_values"] == len(values) and abs(r["estimate"] - exact) <= 0.02 * abs(exact) * (1 + 1e-9)
    assert len(out) == 2 * len(shares) and all(r["estimate"] == pytest.approx(5.0, rel=0.02) for r in out if r["g"] is None)


def test_percentiles_of_infinities_and_nothing(spark):
    df = spark.createDataFrame([("g", -INF), ("g", 1.0), ("g", INF)], "g string, x double")
    out = {r["share"]: r["estimate"] for r in sketch_percentiles(log_sketch(df, ["g"], "x"), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert out[0.0] == -INF and out[1.0] == INF and out[0.5] == pytest.approx(1.0, rel=0.01)
    assert sketch_percentiles(log_sketch(df.limit(0), ["g"], "x"), ["g"], [0.5]).count() == 0


# ---- cutoffs


def brute_cutoff(scores, share):
    s = sorted(scores)
    return s[max(1, min(len(s), -(-share * len(s) // 1000))) - 1]


def test_cutoffs_against_sorting(spark):
    rng = random.Random(1)
    groups = {
        "ties": [1.0] * 50 + [2.0] * 50 + [3.0], "wild": [rng.gauss(0, 1) for _ in range(300)] + [1e300, -1e300, 1e12], "one": [5.0], "same": [7.0] * 30,
        "fine": [1 + i * 1e-15 for i in range(200)], "inf": [-INF, -INF, 0.0, INF, 2.0], "even": [float(i) for i in range(1000)], "tiny": [5e-324 * i for i in range(9)],
    }
    shares = {g: rng.randint(1, 999) for g in groups}
    rows = [(g, x, "extra") for g, xs in groups.items() for x in xs] + [("even", None, "e"), ("even", NAN, "e"), (None, 1.0, "e"), ("untargeted", 1.0, "e")]
    records = spark.createDataFrame(rows, "g string, s double, cutoff string").withColumnRenamed("cutoff", "_cutoff")
    targets = spark.createDataFrame([*shares.items(), ("absent", 500), (None, 10), ("one", None)], "g string, keep int")
    out = keep_fraction_cutoffs(records, targets, ["g"], "s", "keep")
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        c = brute_cutoff(xs, shares[g])
        assert got[g]["cutoff"] == c and got[g]["n_records"] == len(xs) and got[g]["n_kept"] == sum(x <= c for x in xs), g
    import posemill.llm.cutoffs as C

    limit, C.hot_limit = C.hot_limit, lambda total: 100  # noqa: ARG005
    try:
        split = keep_fraction_cutoffs(records, targets, ["g"], "s", "keep", many_sources=0, shrink_rows=10)
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, out.collect()))
    finally:
        C.hot_limit = limit
    kept = kept_records(records, out, ["g"], "s")
    assert kept.columns == records.columns and kept.count() == sum(r["n_kept"] for r in got.values())


def test_cutoffs_edges(spark):
    records = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, s double")
    for share, want in ((0, 1.0), (1000, 2.0), (5000, 2.0)):
        assert keep_fraction_cutoffs(records, spark.createDataFrame([("a", share)], "g string, k int"), ["g"], "s", "k").first()["cutoff"] == want
    assert keep_fraction_cutoffs(records.limit(0), spark.createDataFrame([("a", 5)], "g string, k int"), ["g"], "s", "k").count() == 0


# ---- top n


def brute_top(rows, n):
    groups = {}
    for g, s, t, p in rows:
        if g is not None and s is not None and not math.isnan(s):
            groups.setdefault(g, []).append((s, t or "", p if p is not None else -(2**62)))
    return sorted((g, *x) for g, xs in groups.items() for x in sorted(xs)[:n])


@pytest.mark.parametrize("hot", [20, 10**9])
def test_top_n_against_sorting(spark, hot):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        for _ in range(rng.choice([1, 2, 5, 6, 40])):
            rows.append((f"g{g}", float(rng.choice([-9, -8.5, -8.5, 1e9, -1e9, rng.random()])), rng.choice(["a_10", "a_1", "a_100", "b", "a", "é", None]), rng.choice([None, -3, 7, 2**40, rng.randrange(9)])))
    rows += [("hot", 1.0, f"name_{i % 50:03d}_{'x' * 30}{i % 3}", i) for i in range(400)]
    rows += [("same", 2.0, "t", 1)] * 20 + [("inf", INF, "t", 1), ("inf", -INF, "t", 2), ("inf", -0.0, "t", 3), ("inf", 0.0, "t", 4)] * 3
    rows += [(None, 1.0, "t", 1), ("none", None, "t", 1), ("none", NAN, "t", 2)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, s double, t string, p long, _k0 int")
    out = top_n_per_group(df, ["g"], "s", ["t", "p"], 5, hot_rows=hot)
    assert out.columns == df.columns
    got = sorted((r["g"], r["s"], r["t"] or "", r["p"] if r["p"] is not None else -(2**62)) for r in out.collect())
    assert got == brute_top(rows, 5)


def test_top_n_edges(spark):
    df = spark.createDataFrame([("a", 1.0, "x")], "g string, s double, t string")
    assert top_n_per_group(df.limit(0), ["g"], "s", ["t"], 5).count() == 0
    assert top_n_per_group(df, ["g"], "s", ["t"], 0).count() == 0
    assert top_n_per_group(df, ["g"], "s", [], 5).count() == 1
    nul = spark.createDataFrame([("a", 1.0, "x\0\0"), ("a", 1.0, "x\0"), ("a", 1.0, "x")], "g string, s double, t string")
    assert top_n_per_group(nul, ["g"], "s", ["t"], 2).count() == 2


# ---- components


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {x: find(x) for x in list(root)}


def test_components_path_star_and_random(spark):
    rng = random.Random(3)
    pairs = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)] + [("hub", f"s{i}") for i in range(60)] + [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)]
    pairs += [("x", "x"), (None, "a"), ("a", None), ("b", "c"), ("c", "b"), ("b", "c")]
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, node int")
    assert {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()} == brute_components(pairs)
    assert {r["node"]: r["root"] for r in connected_components(df, "a", "b", hot_rows=10).collect()} == brute_components(pairs)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_groups_are_named_after_carried_names(spark):
    names = spark.createDataFrame([("b",), ("c",), ("c",), ("z",), (None,)], "name string")
    links = spark.createDataFrame([("a", "c"), ("a", "b"), ("q", "w")], "x string, y string")
    got = {r["name"]: (r["group_name"], r["n_records"]) for r in linked_groups(names, "name", links, "x", "y").collect()}
    assert got == {"b": ("b", 3), "c": ("b", 3), "z": ("z", 1)}


# ---- splits


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.floats(0, 200))
def test_closest_subset_is_the_closest(sizes, target):
    reach = {0}
    for s, m in sizes.items():
        reach = {t + s * k for t in reach for k in range(m + 1)}
    taken = closest_subset(sizes, target)
    total = sum(s * c for s, c in taken.items())
    assert all(c <= sizes[s] for s, c in taken.items())
    goal = min(target, sum(s * m for s, m in sizes.items()))
    assert target <= 0 or abs(total - goal) <= min(abs(t - goal) for t in reach) + 1


def test_large_histograms_stay_exact_and_sizes_take_part_in_proportion():
    sizes = {1: 800_000_000} | dict.fromkeys(range(2, 400), 3)
    total = sum(s * m for s, m in sizes.items())
    for memory in (1 << 29, 1 << 16):
        taken = closest_subset(sizes, total / 10, memory)
        assert all(c <= sizes[s] for s, c in taken.items())
        assert abs(sum(s * c for s, c in taken.items()) - total / 10) <= 1
    taken = closest_subset({1: 800, 2: 50, 10: 10}, 100)
    assert sum(s * c for s, c in taken.items()) == 100 and taken[10] <= 2 and taken[1] >= 70
    # one group of each of many sizes, more than the bitsets could hold
    sizes = dict.fromkeys(range(1, 3000), 1)
    taken = closest_subset(sizes, sum(sizes) / 10, 1 << 20)
    assert abs(sum(s * c for s, c in taken.items()) - sum(sizes) / 10) <= 1 and max(taken.values()) == 1


def test_split_plan_never_uses_a_group_twice():
    plan = split_plan({"none": {1: (100, 0.0), 7: (3, 0.0)}, "all": {2: (9, 2.0)}, "quarter1": {50: (1, 15.0)}}, {"train": 0.8, "validation": 0.1, "test": 0.1})
    for key in {(p[0], p[1]) for p in plan}:
        ranks = [r for p in plan if (p[0], p[1]) == key for r in range(p[3], p[4] + 1)]
        assert len(ranks) == len(set(ranks))


def test_splits_keep_groups_shares_and_balance(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for g in range(400):
        y = int(rng.random() < 0.2)
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((i, None if g == 7 else f"g{g}", None if rng.random() < 0.02 else y, "x"))
            i += 1
    df = spark.createDataFrame(rows, "id long, g string, y int, split string")
    out = {r["id"]: r["split"] for r in assign_splits(df, "id", "g", "y", {"train": 0.7, "validation": 0.1, "test": 0.2}).collect()}
    assert len(out) == len(rows)
    for g in {r[1] for r in rows} - {None}:
        assert len({out[r[0]] for r in rows if r[1] == g}) == 1
    for split, share in (("train", 0.7), ("validation", 0.1), ("test", 0.2)):
        mine = [r for r in rows if out[r[0]] == split]
        assert abs(len(mine) / len(rows) - share) < 0.01
        assert abs(sum(r[2] or 0 for r in mine) / len(mine) - sum(r[2] or 0 for r in rows) / len(rows)) < 0.03
    shares = {"train": 0.7, "validation": 0.1, "test": 0.2}
    parts = {r["id"]: r["split"] for r in assign_splits(df, "id", "g", "y", shares, bucket_groups=20).collect()}
    assert len(parts) == len(rows) and all(abs(sum(v == k for v in parts.values()) / len(rows) - x) < 0.01 for k, x in shares.items())
    assert assign_splits(df.limit(0), "id", "g", "y", {"train": 0.8, "test": 0.2}).count() == 0
