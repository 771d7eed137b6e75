import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from posemill import runtime
from posemill.llm import neighbours
from posemill.llm.neighbours import copies_of, greedy_search, neighbour_graph, neighbour_list, similar_pairs

D = 12
VECTOR = [f"v{i}" for i in range(D)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, D))
    x = centres[rng.integers(0, 8, 1500)] + 0.5 * rng.normal(size=(1500, D))
    x[700:740] = x[:40] + 0.001 * rng.normal(size=(40, D))  # near copies in other groups
    x[800:900] = x[50]  # exact copies, one group
    x[900] = x[60]  # exact copy, another group
    x = x.astype(np.float32)
    group = [f"s{i}" for i in range(1500)]
    for i in range(800, 900):
        group[i] = "hot"
    rows = [(i, group[i], *map(float, x[i]), "e") for i in range(1500)]
    bad = [list(rows[0]) for _ in range(5)]
    for k, (i, value) in enumerate(((2, None), (2, float("nan")), (2, float("inf")), (0, None), (1, None))):
        bad[k][0] = 5000 + k
        bad[k][i] = value
    zero = (6000, "zero", *[0.0] * D, "e")
    schema = "feature_id long, grp string, " + ", ".join(f"{v} float" for v in VECTOR) + ", id string"
    return spark.createDataFrame(rows + [tuple(b) for b in bad] + [zero], schema).cache(), x.astype(np.float64), np.array(group)


def cosine(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize(("block", "sample"), [(12_000, 20_000), (300, 20_000), (60, 300)])
def test_graph_recall_and_pairs(table, block, sample):
    df, x, group = table
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11, block_rows=block, leaf=100, trees=4, sample=sample)
    listed = {}
    for r in neighbour_list(graph, 10).collect():
        listed.setdefault(r["id"], []).append(r["neighbour"])
    s = cosine(x)
    s[group[:, None] == group[None, :]] = -2
    kept = [i for i in range(1500) if not 801 <= i < 900]
    assert sorted(listed) == kept  # every row, one of the exact copies
    recall = []
    for i in kept:
        others = np.array([j for j in kept if j != i])
        best = np.sort(s[i, others])[-10]
        recall.append(np.mean([s[i, j] >= best - 1e-3 for j in listed[i]]))
    assert np.mean(recall) >= 0.9
    pairs = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, "feature_id", "grp", VECTOR, graph, 0.99).collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.99, 1)), strict=True)}
    assert {(int(i), int(j)) for i, j in want} == pairs


def test_search_finds_what_brute_force_finds(table):
    df, x, group = table
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11, block_rows=300, leaf=100)
    found = {}
    for r in greedy_search(graph, df.where("feature_id % 100 = 0"), "feature_id", "grp", VECTOR, 10, beam=64).collect():
        found.setdefault(r["query"], []).append(r["neighbour"])
    s = cosine(x)
    s[group[:, None] == group[None, :]] = -2
    kept = np.array([i for i in range(1500) if not 801 <= i < 900])
    recall = [np.mean([s[i, j] >= np.sort(s[i, kept[kept != i]])[-10] - 1e-3 for j in found[i]]) for i in range(0, 1500, 100)]
    assert np.mean(recall) >= 0.9


def test_copies(table):
    df = table[0]
    got = [(r["representative"], r["member"]) for r in copies_of(df, "feature_id", "grp", VECTOR).collect()]
    assert sorted(got) == [(800, i) for i in range(800, 900)]


def test_empty_and_single(spark, table):
    df = table[0]
    for few in (df.limit(0), df.where("feature_id = 3"), df.where("grp = 'hot'")):
        graph = neighbour_graph(few, "feature_id", "grp", VECTOR)
        assert neighbour_list(graph, 5).count() == 0
        assert similar_pairs(few, "feature_id", "grp", VECTOR, graph, 0.9).count() == 0
        assert greedy_search(graph, few, "feature_id", "grp", VECTOR, 5).count() == 0


@pytest.mark.parametrize("block", [12_000, 700])
def test_tight_group_of_a_third(spark, block):
    """Distinct rows of one group, close together: every one has neighbours, and its pairs are found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, D))
    hot = rng.normal(size=D)
    x[:1000] = hot + 0.01 * rng.normal(size=(1000, D))
    x[1000:1004] = hot + 0.3 * rng.normal(size=(4, D))
    x = x.astype(np.float32)
    group = np.array(["hot" if i < 1000 else f"s{i}" for i in range(3000)])
    rows = [(i, str(group[i]), *map(float, x[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "feature_id long, grp string, " + ", ".join(f"{v} float" for v in VECTOR))
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11, block_rows=block, leaf=100, sample=3000)
    listed = {}
    for r in neighbour_list(graph, 10).collect():
        listed.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(listed.get(i, [])) == 10 for i in range(3000))
    s = cosine(x.astype(np.float64))
    s[group[:, None] == group[None, :]] = -2
    recall = [np.mean([s[i, j] >= np.sort(s[i])[-10] - 1e-3 for j in listed[i]]) for i in range(1000)]
    assert np.mean(recall) >= 0.9
    least = float(np.quantile(s[:1000].max(1), 0.5))
    pairs = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, "feature_id", "grp", VECTOR, graph, least).collect()}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= least, 1)), strict=True) if i < 1000}
    assert len(want & pairs) >= 0.95 * len(want)


def test_only_exact_copies_collapse(spark):
    """Multiples of a vector, and vectors that differ below half precision, are rows and have pairs of their own."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, D)).astype(np.float32)
    x[1], x[2], x[3] = 2 * x[0], x[0] * np.float32(1 + 1e-6), x[0]
    x[4] = x[0] + np.float32(0.001)
    group = ["a"] * 4 + [f"s{i}" for i in range(4, 60)]
    rows = [(i, group[i], *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "feature_id long, grp string, " + ", ".join(f"{v} float" for v in VECTOR))
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11)
    assert {r["id"] for r in neighbour_list(graph, 10).collect()} == set(range(60)) - {3}
    pairs = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, "feature_id", "grp", VECTOR, graph, 0.99).collect()}
    assert {(i, 4) for i in range(4)} <= pairs


def test_descent_runs_until_few_edges_change(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, D))
    hot = rng.normal(size=D)
    x[:1000] = hot + 0.01 * rng.normal(size=(1000, D))
    x[1000:1004] = hot + 0.3 * rng.normal(size=(4, D))
    x = x.astype(np.float32)
    group = np.array(["hot" if i < 1000 else f"s{i}" for i in range(3000)])
    rows = [(i, str(group[i]), *map(float, x[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "feature_id long, grp string, " + ", ".join(f"{v} float" for v in VECTOR))
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11, block_rows=700, leaf=100, sample=3000)
    s = cosine(x.astype(np.float64))
    s[group[:, None] == group[None, :]] = -2
    least = np.sort(s, 1)[:, -10] - 1e-3
    good = [s[r["id"], r["neighbour"]] >= least[r["id"]] for r in neighbour_list(graph, 10).collect() if r["id"] >= 1000]
    assert np.mean(good) >= 0.97


@pytest.mark.parametrize("block", [12_000, 100])
def test_more_neighbours_than_edges(spark, block):
    """A crowd of variants within the cosine, and one vector under many variants: no pair is cut off by the width of the graph."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, D))
    x[:60] = x[0] + 0.01 * rng.normal(size=(60, D))
    x[60:400] = x[60]
    x = x.astype(np.float32)
    rows = [(7 * i, f"s{i}", *map(float, x[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "feature_id long, grp string, " + ", ".join(f"{v} float" for v in VECTOR))
    graph = neighbour_graph(df, "feature_id", "grp", VECTOR, k=11, block_rows=block, leaf=50, sample=2000)
    assert (graph.heavy is not None) == (block == 100)
    pairs = {(r["id_a"], r["id_b"]) for r in similar_pairs(df, "feature_id", "grp", VECTOR, graph, 0.99).collect()}
    want = {(7 * int(i), 7 * int(j)) for i, j in zip(*np.nonzero(np.triu(cosine(x.astype(np.float64)) >= 0.99, 1)), strict=True)}
    assert len(want) > 50_000 and pairs == want


def test_cells_within_reach_hold_every_near_vector():
    from posemill.llm.neighbours import _cells, _fit_tree

    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, D)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = _cells(x, _fit_tree(x, 4, rng), 3, rng)
    at = cells.cell(x)
    assert len(np.unique(at)) == cells.count() == 128
    row, cell = cells.reached(x[:50], 0.5)
    visited = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.linalg.norm(x[:50, None] - x[None], axis=2) <= 0.5
    assert all((int(i), int(at[j])) in visited for i, j in zip(*np.nonzero(near), strict=True))


def test_descent_is_what_finds_the_neighbours(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    names = [f"v{i}" for i in range(24)]
    df = spark.createDataFrame([(100 * i, f"s{i}", *map(float, x[i])) for i in range(4000)], "feature_id long, grp string, " + ", ".join(f"{v} float" for v in names))
    s = cosine(x.astype(np.float64))
    np.fill_diagonal(s, -2)
    least = np.sort(s, 1)[:, -10] - 1e-3
    found = {}
    for rounds in (0, 6):
        graph = neighbour_graph(df, "feature_id", "grp", names, block_rows=1000, leaf=64, trees=2, rounds=rounds)
        found[rounds] = np.mean([s[r["id"] // 100, r["neighbour"] // 100] >= least[r["id"] // 100] for r in neighbour_list(graph, 10).collect()])
    assert found[0] < 0.6 and found[6] > 0.9


def test_largest_of_every_row():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(50, 300)).astype(np.float32)
    s[rng.random(s.shape) < 0.3] = -2
    s[:5, :250], s[5, :] = 0, 1
    for m in (1, 14, 300):
        columns, values = neighbours._top(s, m)
        assert (np.take_along_axis(s, columns, 1) == values).all() and all(len(set(c)) == m for c in columns.tolist())
        assert (np.sort(values, 1) == np.sort(s, 1)[:, -m:]).all()


def test_falling_numbers_of_half_precision():
    half = np.array([-2, -1, -0.5, -6e-8, 0, 6e-8, 0.25, 1], np.float16)
    numbers = neighbours._falling(half)
    assert (np.diff(numbers.astype(np.int64)) < 0).all()
    assert (neighbours._falling(numbers.astype(np.uint16)).astype(np.uint16).view(np.float16) == half).all()


def test_join_in_a_block_meets_what_the_definition_says():
    rng = np.random.default_rng(2)
    n, k = 120, 5
    half = rng.normal(size=(n, 8))
    half = (half / np.linalg.norm(half, axis=1, keepdims=True)).astype(np.float16)
    ids, groups = rng.permutation(n) * 1_000_003 + 2**40, rng.integers(0, 30, n)
    cos = half.astype(np.float32) @ half.astype(np.float32).T
    home = rng.integers(0, 2, n).astype(np.int32)
    near = np.array([rng.choice(np.flatnonzero(groups != g), k, replace=False) for g in groups])
    edges = neighbours._edges(near, np.take_along_axis(cos, near, 1), ids, home)
    edges["new"] = rng.integers(0, 3, near.shape)
    t = neighbours._graph_table(0, ids, groups, half, edges, np.zeros(n, np.int32)).set_column(0, "home", [pa.array(home)])
    spread = neighbours._spread(t, edges, n)
    got = neighbours._local_join(n, n)(spread.filter(pc.equal(spread["block"], 0)))
    found = {(int(i), int(e["id"])): float(e["sim"]) for i, row in zip(got["id"].to_numpy(), neighbours._unpacked(got["edges"], neighbours._EDGE), strict=True) for e in row if e["id"] >= 0}

    weakest, listed, known = edges["sim"].astype(np.float32).min(1), set(), {}
    # rows of the other block come with their edges of the last two rounds that lead here
    sent = [(i, j, new) for i in range(n) for j, new in zip(near[i].tolist(), edges["new"][i].tolist(), strict=True) if home[i] == 0 or (home[j] == 0 and new)]
    here = {i for i in range(n) if home[i] == 0} | {i for i, _, _ in sent}
    for i, j, new in sent:
        if j in here:
            listed.add((i, j))
            for pair in ((i, j), (j, i)):
                known[pair] = max(new, known.get(pair, 0))
    wanted = {}
    for pivot in range(n):
        others = [(b, new) for (a, b), new in known.items() if a == pivot]
        if home[pivot] == 0 and any(new == 2 for _, new in others):
            for a, x in others:
                for b, y in others:
                    if 2 in (x, y) and groups[a] != groups[b] and cos[a, b] > weakest[a] and (a, b) not in listed:
                        wanted[int(ids[a]), int(ids[b])] = cos[a, b]
    assert wanted and found.keys() == wanted.keys() and all(abs(found[p] - wanted[p]) < 0.001 for p in wanted)
    few = neighbours._local_join(2, n)(spread.filter(pc.equal(spread["block"], 0)))
    for i, row in zip(few["id"].to_numpy(), neighbours._unpacked(few["edges"], neighbours._EDGE), strict=True):
        best = sorted((s for (a, _), s in wanted.items() if a == i), reverse=True)[:2]
        assert sorted((float(s) for s in row["sim"] if s > -2), reverse=True) == pytest.approx(best, abs=0.001)


def test_listed_neighbours_begin_with_the_nearest():
    edges = np.zeros((2, 4), neighbours._EDGE)
    edges["id"], edges["sim"] = [[1, 2, 3, -1], [4, 5, 6, 7]], [[-0.5, 0.5, 0.25, -2], [0.5, 1, 0.5, 0.75]]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11]), neighbours._packed(edges)], names=["id", "edges"])
    out = next(neighbours._listed(3, -1.0)(iter([batch])))
    assert list(zip(*(out[c].to_pylist() for c in ("id", "rank", "neighbour")), strict=True)) == [(10, 1, 2), (10, 2, 3), (10, 3, 1), (11, 1, 5), (11, 2, 7), (11, 3, 6)]


def test_wide_plans_are_cut_without_whole_stage_code(spark, monkeypatch):
    cuts, kept, cut = [], spark.conf.get("spark.sql.codegen.wholeStage"), runtime.Scratch.cut
    monkeypatch.setattr(runtime.Scratch, "cut", lambda self, df, files=None, wide=False: (cuts.append(wide), cut(self, df, files, wide))[1])
    rows = spark.createDataFrame([(i, f"g{i}", 1.0, 0.001 * i) for i in range(6)], "id long, g string, x double, y double")
    graph = neighbour_graph(rows, "id", "g", ["x", "y"])
    assert similar_pairs(rows, "id", "g", ["x", "y"], graph, 0.99).count() == 15
    assert sum(cuts) == 3 and spark.conf.get("spark.sql.codegen.wholeStage") == kept  # vectors located, pairs computed again, keys of copies
    seen = []
    monkeypatch.undo()
    write = type(rows.write).parquet
    monkeypatch.setattr(type(rows.write), "parquet", lambda self, *a, **x: (seen.append(spark.conf.get("spark.sql.codegen.wholeStage")), write(self, *a, **x))[1])
    runtime.Scratch(spark, "wide").cut(rows, wide=True)
    runtime.Scratch(spark, "narrow").cut(rows)
    assert seen == ["false", kept]
