"""Distances and similarities between the vectors of a table and a query set, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.operators.joins import beside
from posemill.runtime import Scratch, ship

ship(__name__)

SCALAR = ("braycurtis", "canberra", "cityblock", "correlation", "cosine", "euclidean", "jensenshannon", "minkowski", "seuclidean", "sqeuclidean")
BOOLEAN = (
    "yule", "kulsinski", "hamming", "sokalsneath", "Tanimoto", "Dice", "CosineBits", "Sokal", "Russel", "RogotGoldberg", "AllBit", "Kulczynski",
    "McConnaughey", "Asymmetric", "BraunBlanquet", "Tversky",
)
BLOCK_BYTES = 16 << 20
_CELLS = 1 << 21


def to_bits(vector: Column | str) -> Column:
    """1 where a component is not 0, else 0; null components count as 0."""
    c = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(c, lambda x: F.when(F.coalesce(x != 0, F.lit(False)), 1).otherwise(0))


def scalar_distances(x: np.ndarray, q: np.ndarray, metrics: tuple[str, ...], variance: np.ndarray | None = None, power: float = 2.0) -> dict[str, np.ndarray]:
    """Every metric between rows of x and q as |x| x |q| arrays; 0/0 counts as 0 in sums and is NaN in ratios."""
    out: dict[str, np.ndarray] = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        if {"cosine", "correlation"} & set(metrics):
            def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return 1 - (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])

            if "cosine" in metrics:
                out["cosine"] = angle(x, q)
            if "correlation" in metrics:
                out["correlation"] = angle(x - x.mean(1, keepdims=True), q - q.mean(1, keepdims=True))
        if "jensenshannon" in metrics:
            p, r = x / x.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
            js = np.empty((len(x), len(q)))
            for j, row in enumerate(r):
                m = (p + row) / 2
                kl = lambda a: np.where(a > 0, a * np.log(a / m), np.where(a == 0, 0.0, np.nan)).sum(1)  # noqa: B023, E731
                js[:, j] = np.sqrt(np.maximum((kl(p) + kl(np.broadcast_to(row, p.shape))) / 2, 0))
            out["jensenshannon"] = js
        rest = [m for m in metrics if m not in out]
        for m in rest:
            out[m] = np.empty((len(x), len(q)))
        for j, row in enumerate(q if rest else []):
            d = x - row
            a = np.abs(d)
            for m in rest:
                if m == "cityblock":
                    v = a.sum(1)
                elif m == "braycurtis":
                    v = a.sum(1) / np.abs(x + row).sum(1)
                elif m == "canberra":
                    s = np.abs(x) + np.abs(row)
                    v = np.where(s > 0, a / s, 0).sum(1)
                elif m == "sqeuclidean":
                    v = (d * d).sum(1)
                elif m == "euclidean":
                    v = np.sqrt((d * d).sum(1))
                elif m == "seuclidean":
                    v = np.sqrt((d * d / variance).sum(1))
                elif m == "minkowski":
                    v = (a**power).sum(1) ** (1 / power)
                else:
                    raise ValueError(f"unknown metric {m}")
                out[m][:, j] = v
    return out


def boolean_distances(x: np.ndarray, q: np.ndarray, metrics: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Every metric between bit rows from the counts a (both), b, c (one of them) and d (none); similarities as 1 - s."""
    x, q = (x != 0).astype(np.float64), (q != 0).astype(np.float64)
    n = x.shape[1]
    a = x @ q.T
    nx, nq = x.sum(1)[:, None], q.sum(1)[None, :]
    b, c = nx - a, nq - a
    d = n - a - b - c
    with np.errstate(divide="ignore", invalid="ignore"):
        forms = {
            "yule": lambda: np.where(b * c == 0, 0.0, 2 * b * c / (a * d + b * c)),
            "kulsinski": lambda: (b + c - a + n) / (b + c + n),
            "hamming": lambda: (b + c) / n,
            "sokalsneath": lambda: 2 * (b + c) / (a + 2 * (b + c)),
            "Tanimoto": lambda: 1 - a / (a + b + c),
            "Dice": lambda: 1 - 2 * a / (nx + nq),
            "CosineBits": lambda: 1 - a / np.sqrt(nx * nq),
            "Sokal": lambda: 1 - a / (a + 2 * (b + c)),
            "Russel": lambda: 1 - a / n,
            "RogotGoldberg": lambda: 1 - (a / (nx + nq) + d / (2 * n - nx - nq)),
            "AllBit": lambda: (b + c) / n,
            "Kulczynski": lambda: 1 - (a / nx + a / nq) / 2,
            "McConnaughey": lambda: 1 - (a * (nx + nq) - nx * nq) / (nx * nq),
            "Asymmetric": lambda: 1 - a / np.minimum(nx, nq),
            "BraunBlanquet": lambda: 1 - a / np.maximum(nx, nq),
            "Tversky": lambda: 1 - a / (0.5 * b + 1.0 * c + a),
        }
        return {m: np.broadcast_to(forms[m](), a.shape) for m in metrics}


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query set in blocks of at most BLOCK_BYTES and one vector length, one at a time on the driver."""
    held: dict[int, tuple[list, list]] = {}
    for r in queries.toLocalIterator():
        ids, rows = held.setdefault(len(r[1]), ([], []))
        ids.append(r[0])
        rows.append(r[1])
        if 8 * len(rows) * len(r[1]) >= BLOCK_BYTES:
            yield np.array(ids), np.array(rows, np.float64)
            del held[len(r[1])]
    for ids, rows in held.values():
        yield np.array(ids), np.array(rows, np.float64)


def pair_distances(df: DataFrame, queries: DataFrame, key: str, vector: str, metrics: tuple[str, ...]) -> DataFrame:
    """id, query_id and a column per metric for every row against every row of a stated query set.

    Queries are broadcast in blocks of at most 16 MB, each block meeting the table in one pass of numpy kernels; more queries
    mean more passes. Vectors that are null, empty or have null or NaN components are left out, as are pairs of different length; an
    undefined distance is null. Ids must not be null. An empty query set gives no rows.
    """
    spark = df.sparkSession
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")))
    def ready(t: DataFrame) -> DataFrame:
        return t.where(ok).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    rows, asked = ready(df), ready(queries)
    scalar, boolean = tuple(m for m in metrics if m in SCALAR), tuple(m for m in metrics if m in BOOLEAN)
    if unknown := set(metrics) - set(SCALAR) - set(BOOLEAN):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, query_id {kind}, " + ", ".join(f"`{m}` double" for m in metrics)
    variance = None
    if "seuclidean" in scalar:
        spread = rows.unionByName(asked).select(F.posexplode("v")).groupBy("pos").agg(F.var_samp("col").alias("s")).orderBy("pos")
        variance = np.array([r.s if r.s else np.nan for r in spread.collect()])  # one number per component

    def kernel(held) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:  # noqa: ANN001
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            for b in batches:
                b = b[b["v"].map(len) == q.shape[1]]
                spread = variance if variance is None else variance[: q.shape[1]]
                step = max(1, _CELLS // max(1, q.size))
                for lo in range(0, len(b), step):
                    part = b.iloc[lo : lo + step]
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    found = scalar_distances(x, q, scalar, spread) | boolean_distances(x, q, boolean)
                    out = {"id": np.repeat(part["id"].to_numpy(), len(ids)), "query_id": np.tile(ids, len(part))}
                    yield pd.DataFrame(out | {m: np.where(np.isfinite(found[m]), found[m], np.nan).ravel() for m in metrics})

        return run

    out, held, scratch = spark.createDataFrame([], schema), None, Scratch(spark, "distances")
    for block in _blocks(asked):
        if held is not None:  # more than one block: write what the last one gave before the next is sent
            out = out.unionByName(scratch.cut(rows.mapInPandas(kernel(held), schema)))
            held.unpersist()
        held = spark.sparkContext.broadcast(block)
    if held is not None:
        out = out.unionByName(rows.mapInPandas(kernel(held), schema))
    return out.select("id", "query_id", *[F.nanvl(F.col(f"`{m}`"), F.lit(None)).alias(m) for m in metrics])


def row_normalized(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Distances divided by the Euclidean norm of their row over all queries; 0 where the norm is 0."""
    norms = pairs.groupBy("id").agg(*[F.sqrt(F.sum(F.col(m) * F.col(m))).alias(f"_{m}") for m in metrics])
    both = pairs.join(norms, "id")
    return both.select("id", "query_id", *[F.when(F.col(f"_{m}") > 0, F.col(m) / F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in metrics])


def max_variance_metric(pairs: DataFrame, metrics: list[str], unique_share: float = 0.5, distance: bool = False) -> DataFrame:
    """z-scores of the metric of highest variance among those with more than unique_share distinct values.

    Returns id, query_id, metric, z; negated (a similarity) unless ``distance``. One aggregate row decides. The distinct
    counts are exact. A metric that is undefined for some pair does not qualify; no row where none does.
    """
    normed = row_normalized(pairs, metrics)
    facts = normed.agg(F.count("*").alias("n"), *[x for m in metrics for x in (F.var_pop(m).alias(f"v_{m}"), F.count_distinct(m).alias(f"d_{m}"), F.count(m).alias(f"n_{m}"))]).first()
    good = [m for m in metrics if facts["n"] and facts[f"n_{m}"] == facts["n"] and facts[f"d_{m}"] > unique_share * facts["n"]]
    if not good:
        return normed.select("id", "query_id", F.lit("").alias("metric"), F.lit(0.0).alias("z")).where(F.lit(False))
    best = max(good, key=lambda m: facts[f"v_{m}"])
    stats = normed.agg(F.avg(best).alias("_a"), F.stddev_pop(best).alias("_s"))
    z = F.try_divide(F.col(best) - F.col("_a"), F.col("_s"))
    return beside(normed, stats).select("id", "query_id", F.lit(best).alias("metric"), (z if distance else -z).alias("z"))


def metrics_for(df: DataFrame, vector: str) -> tuple[str, ...]:
    """The boolean metrics if all components of all vectors are 0 or 1, else the scalar ones."""
    other = df.where(F.exists(vector, lambda v: ~F.coalesce((v == 0) | (v == 1), F.lit(True)))).limit(1).count()
    return SCALAR if other else BOOLEAN


def similarity_weights(pairs: DataFrame, metric: str) -> DataFrame:
    """id, weight: 1 - the smallest distance to any query."""
    return pairs.groupBy("id").agg((1 - F.min(metric)).alias("weight"))
