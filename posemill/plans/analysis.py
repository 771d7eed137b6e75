"""Queries of joins, ranks, scales, units, vectors, metrics and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions import chemistry, units
from posemill.operators import joins, metrics, ranking, residues, scaling, vectors
from posemill.functions.names import structvar_of
from posemill.operators.ranking import first_in_group
from posemill.plans.parsing import _MOL2
from posemill.plans.registry import query, rounded
from posemill.plans.views import ENTROPIES, FEATURES, LABELS, POSES, RUNS, entropies, features, labels, poses, runs
from posemill.runtime import table
from posemill.sources.rejects import parse_mol2
from posemill.sources.textfiles import lowest_energies

# ---- joins and sets ---------------------------------------------------------------------------------------------------


@query(f"""WITH {FEATURES}, {POSES} SELECT f.feature_id, p.row_id, f.protein FROM features f JOIN poses p ON f.structvar = p.structvar AND f.pose = p.pose
 AND f.frame = p.frame AND f.protein IS NOT DISTINCT FROM p.protein AND f.basemolname IS NOT DISTINCT FROM p.basemolname""")
def natural_inner(spark: SparkSession, folder: str) -> DataFrame:
    left = features(spark, folder).select("feature_id", "protein", "basemolname", "structvar", "pose", "frame")
    right = poses(spark, folder).select("row_id", "protein", "basemolname", "structvar", "pose", "frame")
    return joins.natural_join(left, right).select("feature_id", "row_id", "protein")


@query(f"""WITH {LABELS}, {RUNS}, {FEATURES}, a AS (SELECT protein, count(*) AS n_features FROM features GROUP BY 1), b AS (SELECT protein, count(*) AS n_runs FROM runs GROUP BY 1)
 SELECT coalesce(a.protein, b.protein) AS protein, n_features, n_runs FROM a FULL JOIN b ON a.protein IS NOT DISTINCT FROM b.protein""")
def natural_outer(spark: SparkSession, folder: str) -> DataFrame:
    a = features(spark, folder).groupBy("protein").agg(F.count("*").alias("n_features"))
    b = runs(spark, folder).groupBy("protein").agg(F.count("*").alias("n_runs"))
    return joins.natural_join(a, b, how="full")


@query(f"""WITH {POSES}, {ENTROPIES}, {FEATURES}, v AS (SELECT structvar, min(score) AS score FROM poses GROUP BY 1), f AS (SELECT structvar, count(*) AS n FROM features GROUP BY 1)
 SELECT structvar, score, confS, n FROM v JOIN entropies USING (structvar) JOIN f USING (structvar)""")
def key_join_nary(spark: SparkSession, folder: str) -> DataFrame:
    v = poses(spark, folder).groupBy("structvar").agg(F.min("score").alias("score"))
    f = features(spark, folder).groupBy("structvar").agg(F.count("*").alias("n"))
    return joins.join_all(["structvar"], v, entropies(spark, folder), f)


@query(f"""WITH {POSES}, {LABELS}, b AS (SELECT protein, basemolname, min(score) AS score FROM poses GROUP BY 1, 2)
 SELECT protein, basemolname, score, is_active FROM b LEFT JOIN labels USING (basemolname)""")
def left_join_labels(spark: SparkSession, folder: str) -> DataFrame:
    best = poses(spark, folder).groupBy("protein", "basemolname").agg(F.min("score").alias("score"))
    return joins.join_all(["basemolname"], best, labels(spark, folder), how="left")


@query(f"WITH {POSES} SELECT row_id, proteinE_bound - (SELECT min(proteinE_bound) FROM poses) AS above FROM poses")
def scalar_beside(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder)
    both = joins.beside(rows, rows.agg(F.min("proteinE_bound").alias("low")))
    return both.select("row_id", (F.col("proteinE_bound") - F.col("low")).alias("above"))


@query(f"WITH {FEATURES}, {RUNS} SELECT protein, 'features' AS origin FROM features UNION ALL SELECT protein, 'runs' AS origin FROM runs")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    a = features(spark, folder).select("protein", F.lit("features").alias("origin"))
    return a.unionByName(runs(spark, folder).select("protein", F.lit("runs").alias("origin")))


@query(f"WITH {FEATURES}, {LABELS} SELECT basemolname FROM features INTERSECT SELECT basemolname FROM labels")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).select("basemolname").intersect(labels(spark, folder).select("basemolname"))


@query(f"WITH {POSES}, {LABELS} SELECT basemolname FROM poses EXCEPT SELECT basemolname FROM labels")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    return poses(spark, folder).select("basemolname").subtract(labels(spark, folder).select("basemolname"))


# ---- ranks ------------------------------------------------------------------------------------------------------------


@query(f"WITH {POSES} SELECT row_id, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY structvar ORDER BY score NULLS LAST) END AS r FROM poses")
def rank_min(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.add_ranks(poses(spark, folder), "score", "min", "r", ["structvar"]).select("row_id", "r")


@query(f"""WITH {RUNS} SELECT run_id, CASE WHEN auc_roc IS NOT NULL THEN dense_rank() OVER (ORDER BY auc_roc DESC NULLS LAST) END AS overall,
 CASE WHEN auc_roc IS NOT NULL THEN dense_rank() OVER (PARTITION BY protein ORDER BY auc_roc DESC NULLS LAST) END AS within FROM runs""")
def rank_dense_desc(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranking.add_ranks(runs(spark, folder), "auc_roc", "dense", "overall", descending=True)
    return ranking.add_ranks(rows, "auc_roc", "dense", "within", ["protein"], descending=True).select("run_id", "overall", "within")


@query(f"""WITH {RUNS}, p AS (SELECT run_id, auc_roc, rank() OVER (ORDER BY auc_roc) AS r, count(*) OVER (PARTITION BY auc_roc) AS t, count(*) OVER () AS n FROM runs WHERE auc_roc IS NOT NULL)
 SELECT run_id, round((r + (t - 1) / 2) / n, 9) AS pct FROM runs LEFT JOIN p USING (run_id)""")
def rank_pct(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.add_ranks(runs(spark, folder), "auc_roc", "share", "pct").select("run_id", rounded("pct", 9))


@query(f"""WITH {RUNS}, a AS (SELECT run_id, rank() OVER (ORDER BY auc_roc) + (count(*) OVER (PARTITION BY auc_roc) - 1) / 2 AS x FROM runs WHERE auc_roc IS NOT NULL),
 b AS (SELECT run_id, rank() OVER (ORDER BY auc_bedroc) + (count(*) OVER (PARTITION BY auc_bedroc) - 1) / 2 AS y FROM runs WHERE auc_bedroc IS NOT NULL)
 SELECT run_id, x - y AS difference FROM runs LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id)""")
def rank_difference(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranking.add_ranks(runs(spark, folder), "auc_roc", "average", "x")
    rows = ranking.add_ranks(rows, "auc_bedroc", "average", "y")
    return rows.select("run_id", (F.col("x") - F.col("y")).alias("difference"))


@query(f"""WITH {RUNS}, z AS (SELECT run_id, auc_roc, avg(auc_roc) OVER (PARTITION BY protein) AS a, stddev_pop(auc_roc) OVER (PARTITION BY protein) AS s FROM runs)
 SELECT run_id, CASE WHEN auc_roc IS NULL THEN NULL WHEN s = 0 THEN 0.0 ELSE round((a - auc_roc) / s, 6) END AS z FROM z""")
def neg_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.negative_zscore(runs(spark, folder), "auc_roc", "z", ["protein"]).select("run_id", rounded("z"))


@query(f"""WITH {RUNS}, g AS (SELECT score_name, HYPER_OUTLIER_MAD_THRESHOLD AS mad, HYPER_KEEP_MAX_DeltaG_POSES AS keep, avg(auc_roc) AS roc, avg(auc_bedroc) AS bedroc FROM runs GROUP BY 1, 2, 3)
 SELECT score_name, mad, keep, round(roc, 8) AS roc, round(bedroc, 8) AS bedroc, dense_rank() OVER (ORDER BY round(bedroc, 8) DESC NULLS LAST, round(roc, 8) DESC NULLS LAST) AS place FROM g""")
def hyper_report(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    keys = ["score_name", F.col("HYPER_OUTLIER_MAD_THRESHOLD").alias("mad"), F.col("HYPER_KEEP_MAX_DeltaG_POSES").alias("keep")]
    g = runs(spark, folder).groupBy(*keys).agg(F.round(F.avg("auc_roc"), 8).alias("roc"), F.round(F.avg("auc_bedroc"), 8).alias("bedroc"))
    order = [F.col("bedroc").desc_nulls_last(), F.col("roc").desc_nulls_last()]  # the grid's combinations only
    return g.withColumn("place", F.dense_rank().over(Window.orderBy(*order)))


# ---- scales -----------------------------------------------------------------------------------------------------------

_COLUMNS = ["nofusion_Eint", "MW", "ring_flexibility"]


def _scale_sql(form: str, by: str = "") -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    m, s = ("min({0}) {1}", "(max({0}) {1} - min({0}) {1})") if form == "minmax" else ("avg({0}) {1}", "stddev_pop({0}) {1}")
    parts = ", ".join(f"{m.format(c, over)} AS m{i}, {s.format(c, over)} AS s{i}" for i, c in enumerate(_COLUMNS))
    cols = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN s{i} = 0 THEN 0.0 ELSE round(({c} - m{i}) / s{i}, 6) END AS {c}" for i, c in enumerate(_COLUMNS))
    return f"WITH {FEATURES}, x AS (SELECT *, {parts} FROM features) SELECT feature_id, {cols} FROM x"


def _scaled(df: DataFrame) -> DataFrame:
    return df.select("feature_id", *[rounded(c) for c in _COLUMNS])


@query(_scale_sql("minmax"))
def minmax_global(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(scaling.minmax(features(spark, folder), _COLUMNS))


@query(_scale_sql("minmax", "protein"))
def minmax_group(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(scaling.minmax(features(spark, folder), _COLUMNS, ["protein"]))


@query(_scale_sql("standard"))
def standardize_global(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(scaling.standardize(features(spark, folder), _COLUMNS))


@query(_scale_sql("standard", "structvar"))
def standardize_group(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(scaling.standardize(features(spark, folder), _COLUMNS, ["structvar"]))


@query(f"""WITH {FEATURES}, a AS (SELECT feature_id, protein, (nofusion_Eint - avg(nofusion_Eint) OVER ()) / stddev_pop(nofusion_Eint) OVER () AS e,
 (MW - avg(MW) OVER ()) / stddev_pop(MW) OVER () AS MW FROM features),
 b AS (SELECT *, avg(e) OVER (PARTITION BY protein) AS m, stddev_pop(e) OVER (PARTITION BY protein) AS s FROM a)
 SELECT feature_id, CASE WHEN s = 0 THEN 0.0 ELSE round((e - m) / s, 6) END AS nofusion_Eint, round(MW, 6) AS MW FROM b WHERE e IS NOT NULL AND MW IS NOT NULL""")
def standardize_composed(spark: SparkSession, folder: str) -> DataFrame:
    out = scaling.standardize_composed(features(spark, folder), ["nofusion_Eint", "MW"], "protein")
    return out.select("feature_id", rounded("nofusion_Eint"), rounded("MW"))


@query(f"WITH {FEATURES} SELECT feature_id, CASE WHEN MW IS NOT NULL THEN CAST(least(greatest(floor((MW - 100) / 50) + 1, 0), 21) AS INT) END AS bin FROM features")
def discretize_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return scaling.discretize(features(spark, folder), "MW", [100.0 + 50 * i for i in range(21)], "bin").select("feature_id", "bin")


@query()
def discretize_auto(spark: SparkSession, folder: str) -> DataFrame:
    return scaling.discretize_auto(features(spark, folder), "nofusion_Eint", "bin").select("feature_id", "bin")


@query(f"""WITH {FEATURES} SELECT feature_id, least(nofusion_Eint, MW, AMW) AS fused_min,
 round(coalesce(nofusion_Eint, 0) + coalesce(MW, 0) + coalesce(AMW, 0), 6) AS fused_sum,
 round(pow(coalesce(MW, 1) * coalesce(AMW, 1), 0.5), 6) AS fused_geo,
 round(1 / ((coalesce(1 / nofusion_Eint, 0) + coalesce(1 / MW, 0) + coalesce(1 / AMW, 0)) / 3), 5) AS fused_harm FROM features""")
def fused_scores(spark: SparkSession, folder: str) -> DataFrame:
    three = ["nofusion_Eint", "MW", "AMW"]
    return features(spark, folder).select(
        "feature_id", scaling.fuse(three, "min").alias("fused_min"), F.round(scaling.fuse(three, "sum"), 6).alias("fused_sum"),
        F.round(scaling.fuse(["MW", "AMW"], "geo"), 6).alias("fused_geo"), F.round(scaling.fuse(three, "harm"), 5).alias("fused_harm"),
    )


@query(f"WITH {FEATURES} SELECT feature_id, round(ln(nofusion_Eint - (SELECT min(nofusion_Eint) FROM features) + 1), 6) AS logged FROM features")
def shifted_log(spark: SparkSession, folder: str) -> DataFrame:
    return scaling.shifted_log(features(spark, folder), "nofusion_Eint", "logged").select("feature_id", rounded("logged"))


# ---- units ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {FEATURES} SELECT feature_id, round(0.5957632602 * ln(MW / 1e6), 6) AS energy, round(exp((0.5957632602 * ln(MW / 1e6)) / 0.5957632602) * 1e6, 4) AS kd,
 round(nofusion_Eint * 0.238846, 6) AS kcal FROM features""")
def ki_and_energy(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).withColumn("e", units.ki_to_energy("MW"))
    return rows.select("feature_id", F.round("e", 6).alias("energy"), F.round(units.energy_to_kd("e"), 4).alias("kd"), F.round(units.kj_to_kcal("nofusion_Eint"), 6).alias("kcal"))


@query(f"""WITH {FEATURES}, s AS (SELECT protein, min(nofusion_Eint) AS lo, max(nofusion_Eint) AS hi FROM features GROUP BY 1),
 t AS (SELECT feature_id, nofusion_Eint + CASE WHEN lo < 0 THEN -lo ELSE 0.0 END AS y, hi + CASE WHEN lo < 0 THEN -lo ELSE 0.0 END AS m FROM features f JOIN s ON f.protein IS NOT DISTINCT FROM s.protein)
 SELECT feature_id, round(y / (CASE WHEN m <= 100 THEN 101.0 ELSE m + 1 END - y), 6) AS odds FROM t""")
def odds_scale(spark: SparkSession, folder: str) -> DataFrame:
    return units.odds_scale(features(spark, folder), "nofusion_Eint", "odds", ["protein"]).select("feature_id", rounded("odds"))


@query(f"WITH {FEATURES}, b AS (SELECT min(MW) AS lo, max(MW) AS hi FROM features) SELECT feature_id, round(-pow(12.0, (MW - lo) / (hi - lo) * 0.3 + 0.7), 6) AS energy FROM features, b")
def melting_to_energy(spark: SparkSession, folder: str) -> DataFrame:
    return units.melting_to_energy(features(spark, folder), "MW", "energy").select("feature_id", rounded("energy"))


@query(f"""WITH {FEATURES}, b AS (SELECT protein, min(nofusion_Eint) AS lo FROM features GROUP BY 1)
 SELECT feature_id, CAST(nofusion_Eint < lo + 0.5957632602 * ln(100) AS INT) AS active FROM features f JOIN b ON f.protein IS NOT DISTINCT FROM b.protein""")
def active_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return units.active_cutoff(features(spark, folder), "nofusion_Eint", "active", ["protein"]).select("feature_id", "active")


@query(f"""WITH {FEATURES}, x AS (SELECT *, avg(MW) OVER () AS a, stddev_pop(MW) OVER () AS s, min(MW) OVER () AS lo, max(MW) OVER () AS hi, max(abs(MW)) OVER () AS ma,
 median(MW) OVER () AS md, quantile_cont(MW, 0.75) OVER () - quantile_cont(MW, 0.25) OVER () AS iqr, sqrt(sum(MW * MW) OVER ()) AS l2,
 rank() OVER (ORDER BY MW) AS r, count(*) OVER (PARTITION BY MW) AS t, count(*) OVER () AS n FROM features)
 SELECT feature_id, MW AS "none", round((a - MW) / s, 6) AS zscore, round((lo - MW) / ((hi - lo) / 0.8), 6) AS minmax, round(-MW / ma, 6) AS maxabs, round((md - MW) / iqr, 6) AS robust,
 round(-MW / l2, 6) AS l2, round((1 - r - (t - 1) / 2) / (n - 1), 6) + 0.0 AS uniform, round(-1000 * MW / (CASE WHEN hi <= 100 THEN 101 ELSE hi + 1 END - MW), 4) AS odds,
 round(0.5957632602 * ln(1 / (MW + 1) / 100), 6) AS energy, round(0.5957632602 * ln(0.1 / (MW + 1) / 100), 6) AS energy_tenth,
 round(0.5957632602 * ln(1 / ((MW - lo) / (hi - lo) * 999.999 + 1.001) / 100), 6) AS energy_scaled FROM x""")
def inhibition_shapes(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).select("feature_id", "MW")
    modes = ["none", "zscore", "minmax", "maxabs", "robust", "l2", "uniform", "odds", "energy", "energy_tenth", "energy_scaled"]
    for m in modes:
        rows = units.inhibition_shape(rows, "MW", m, m)
    return rows.select("feature_id", *[F.col(m) if m == "none" else (F.round(m, 4 if m == "odds" else 6) + F.lit(0.0)).alias(m) for m in modes])


# ---- vectors ----------------------------------------------------------------------------------------------------------

_SCALARS = ("braycurtis", "canberra", "cityblock", "correlation", "cosine", "euclidean", "minkowski", "seuclidean", "sqeuclidean")
_BITS = ("yule", "kulsinski", "hamming", "sokalsneath", "Tanimoto", "Dice", "CosineBits", "Sokal", "Russel", "RogotGoldberg", "AllBit", "Kulczynski", "McConnaughey", "Asymmetric", "BraunBlanquet", "Tversky")
_PAIRS = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as the stated query set those whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings")
    return rows, rows.where("vec_id % 100 = 0")


@query(_PAIRS + """, spread AS (SELECT i, var_samp(v) AS s FROM (SELECT v, i FROM e UNION ALL SELECT v, i FROM e WHERE vec_id % 100 = 0) GROUP BY 1),
 d AS (SELECT a.vec_id AS id, b.vec_id AS query_id, sum(abs(a.v - b.v)) AS l1, sum((a.v - b.v) * (a.v - b.v) / s) AS se, sum(abs(a.v + b.v)) AS p1, sum(CASE WHEN abs(a.v) + abs(b.v) > 0 THEN abs(a.v - b.v) / (abs(a.v) + abs(b.v)) ELSE 0 END) AS can,
 sum((a.v - b.v) * (a.v - b.v)) AS l2, sum(a.v * b.v) AS ab, sum(a.v * a.v) AS aa, sum(b.v * b.v) AS bb, sum(a.v) AS sa, sum(b.v) AS sb, count(*) AS n
 FROM e a JOIN e b ON a.i = b.i AND b.vec_id % 100 = 0 JOIN spread ON spread.i = a.i GROUP BY 1, 2)
 SELECT id, query_id, round(l1 / p1, 5) AS braycurtis, round(can, 5) AS canberra, round(l1, 5) AS cityblock,
 round(1 - (ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)), 5) + 0.0 AS correlation, round(1 - ab / sqrt(aa * bb), 5) + 0.0 AS cosine,
 round(sqrt(l2), 5) AS euclidean, round(sqrt(l2), 5) AS minkowski, round(sqrt(se), 5) AS seuclidean, round(l2, 5) AS sqeuclidean FROM d""")
def scalar_distances(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vectors.pair_distances(*_embeddings(spark, folder), "vec_id", "embedding", _SCALARS)
    return pairs.select("id", "query_id", *[(F.round(m, 5) + F.lit(0.0)).alias(m) for m in _SCALARS])


@query(_PAIRS + """, d AS (SELECT a.vec_id AS id, b.vec_id AS query_id, count(*) FILTER (a.v > 0 AND b.v > 0)::DOUBLE AS a, count(*) FILTER (a.v > 0 AND b.v <= 0)::DOUBLE AS b,
 count(*) FILTER (a.v <= 0 AND b.v > 0)::DOUBLE AS c, count(*) FILTER (a.v <= 0 AND b.v <= 0)::DOUBLE AS d, count(*)::DOUBLE AS n FROM e a JOIN e b ON a.i = b.i AND b.vec_id % 100 = 0 GROUP BY 1, 2)
 SELECT id, query_id, round(CASE WHEN b * c = 0 THEN 0 ELSE 2 * b * c / (a * d + b * c) END, 6) AS yule, round((b + c - a + n) / (b + c + n), 6) AS kulsinski, round((b + c) / n, 6) AS hamming,
 round(2 * (b + c) / (a + 2 * (b + c)), 6) AS sokalsneath, round(1 - a / (a + b + c), 6) AS "Tanimoto", round(1 - 2 * a / (2 * a + b + c), 6) AS "Dice", round(1 - a / sqrt((a + b) * (a + c)), 6) AS "CosineBits",
 round(1 - a / (a + 2 * (b + c)), 6) AS "Sokal", round(1 - a / n, 6) AS "Russel", round(1 - (a / (2 * a + b + c) + d / (2 * n - 2 * a - b - c)), 6) AS "RogotGoldberg", round((b + c) / n, 6) AS "AllBit",
 round(1 - (a / (a + b) + a / (a + c)) / 2, 6) AS "Kulczynski", round(1 - (a * (2 * a + b + c) - (a + b) * (a + c)) / ((a + b) * (a + c)), 6) AS "McConnaughey",
 round(1 - a / least(a + b, a + c), 6) AS "Asymmetric", round(1 - a / greatest(a + b, a + c), 6) AS "BraunBlanquet", round(1 - a / (0.5 * b + c + a), 6) AS "Tversky" FROM d""")
def boolean_distances(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _embeddings(spark, folder)
    bits = F.transform("embedding", lambda v: (v > 0).cast("int"))
    pairs = vectors.pair_distances(rows.withColumn("embedding", bits), asked.withColumn("embedding", bits), "vec_id", "embedding", _BITS)
    return pairs.select("id", "query_id", *[(F.round(m, 6) + F.lit(0.0)).alias(m) for m in _BITS])


@query()
def max_variance_metric(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _embeddings(spark, folder)
    used = vectors.metrics_for(rows, "embedding")
    return vectors.max_variance_metric(vectors.pair_distances(rows, asked, "vec_id", "embedding", used), list(used)).select("id", "query_id", "metric", rounded("z"))


@query(_PAIRS + """, d AS (SELECT a.vec_id AS id, b.vec_id AS q, 1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS c FROM e a JOIN e b ON a.i = b.i AND b.vec_id % 100 = 0 GROUP BY 1, 2)
 SELECT id, round(1 - min(c), 6) AS weight FROM d GROUP BY 1""")
def similarity_weight(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vectors.pair_distances(*_embeddings(spark, folder), "vec_id", "embedding", ("cosine",))
    return vectors.similarity_weights(pairs, "cosine").select("id", rounded("weight"))


@query("SELECT vec_id, list_sum([CASE WHEN x <> 0 THEN 1 ELSE 0 END FOR x IN embedding])::BIGINT AS n_bits FROM embeddings")
def bit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", vectors.to_bits("embedding").alias("bits"))
    return rows.select("vec_id", F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_bits"))


# ---- residues ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {POSES}, m AS (SELECT structvar, frame, coalesce(avg(Eint), 0) AS e, coalesce(avg(proteinE_bound), 0) AS p FROM poses GROUP BY 1, 2),
 f AS (SELECT DISTINCT frame FROM poses), v AS (SELECT DISTINCT structvar FROM poses),
 g AS (SELECT v.structvar, f.frame, coalesce(e, 0) AS e, coalesce(p, 0) AS p FROM v CROSS JOIN f LEFT JOIN m USING (structvar, frame))
 SELECT structvar, string_agg(CAST(CAST(round(e * 1e8) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(p * 1e8) AS BIGINT) AS VARCHAR), ',' ORDER BY frame) AS fingerprint FROM g GROUP BY 1""")
def residue_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    fp = residues.residue_fingerprint(poses(spark, folder), "structvar", "frame", ["Eint", "proteinE_bound"])
    return fp.select("structvar", F.concat_ws(",", F.transform("fingerprint", lambda x: F.round(x * 1e8).cast("long").cast("string"))).alias("fingerprint"))


@query(f"""WITH {POSES}, t AS (SELECT basemolname, frame, 'vdw' AS term, Eint AS v FROM poses UNION ALL SELECT basemolname, frame, 'total', proteinE_bound FROM poses),
 s AS (SELECT basemolname, frame, coalesce(avg(v) FILTER (term = 'vdw'), 0) AS a, coalesce(stddev_pop(v) FILTER (term = 'vdw'), 0) AS b, coalesce(avg(v) FILTER (term = 'total'), 0) AS c,
 coalesce(stddev_pop(v) FILTER (term = 'total'), 0) AS d FROM t GROUP BY 1, 2),
 r AS (SELECT m.basemolname, f.frame, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM (SELECT DISTINCT basemolname FROM poses) m CROSS JOIN (SELECT DISTINCT frame FROM poses) f
 LEFT JOIN s ON s.basemolname IS NOT DISTINCT FROM m.basemolname AND s.frame = f.frame), x AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1, min(d) AS d0, max(d) AS d1 FROM r)
 SELECT basemolname, {", ".join(f"round(sum(({k} - {k}0) / ({k}1 - {k}0)), 5) AS sum_{k}" for k in "abcd")}, count(*)::INTEGER * 4 AS width FROM r, x GROUP BY 1""")
def residue_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of two terms per frame as fingerprints, each statistic scaled on its own, and their sums."""
    rows = poses(spark, folder).select("basemolname", "frame", F.explode(F.array(F.struct(F.lit("vdw").alias("term"), F.col("Eint").alias("v")), F.struct(F.lit("total").alias("term"), F.col("proteinE_bound").alias("v")))).alias("t"))
    stats = residues.residue_statistics(rows.select("basemolname", "frame", "t.*"), "basemolname", "frame", "term", "v")
    fp = residues.statistics_fingerprint(stats, "basemolname", "frame", "term", ("vdw", "total"))
    scaled = residues.minmax_by_position(fp, "fingerprint", 4)
    total = lambda j: F.aggregate(F.filter("fingerprint", lambda x, i: i % 4 == j), F.lit(0.0), lambda s, x: s + x)  # noqa: E731, ARG005
    return scaled.select("basemolname", *[F.round(total(j), 5).alias(f"sum_{k}") for j, k in enumerate("abcd")], F.size("fingerprint").alias("width"))


# ---- metrics ----------------------------------------------------------------------------------------------------------

_BLOCKS = f"""WITH {FEATURES}, r AS (SELECT protein, nofusion_Eint AS s, is_active FROM features WHERE nofusion_Eint IS NOT NULL AND is_active IS NOT NULL),
 k AS (SELECT protein, s, count(*) FILTER (is_active = 1)::DOUBLE AS pos, count(*) FILTER (is_active <> 1)::DOUBLE AS neg FROM r GROUP BY 1, 2),
 b AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY protein) AS p, sum(neg) OVER (PARTITION BY protein) AS n FROM k
 WINDOW w AS (PARTITION BY protein ORDER BY s ROWS UNBOUNDED PRECEDING))"""


@query(_BLOCKS + """, c AS (SELECT *, (1 - exp(-7.0 * cn / n)) / (1 - exp(-7.0)) AS f1, (1 - exp(-7.0 * (cn - neg) / n)) / (1 - exp(-7.0)) AS f0, p + n AS t, cp + cn - pos - neg AS bf, pos + neg AS z FROM b WHERE p > 0 AND n > 0),
 g AS (SELECT protein, max(p) AS p, max(n) AS n, sum(pos * (n - cn + neg / 2) / p / n) AS roc, sum((f1 - f0) * (cp / p + (cp - pos) / p) / 2) AS croc,
 sum(pos * exp(-20.0 * (bf + 1) / t) * (1 - exp(-20.0 * z / t)) / ((1 - exp(-20.0 / t)) * z)) AS w FROM c GROUP BY 1)
 SELECT protein, CAST(p AS BIGINT) AS n_actives, CAST(n AS BIGINT) AS n_inactives, round(roc, 6) AS auc_roc, round(croc, 6) AS auc_croc,
 round(w / p / ((1 / (p + n)) * (1 - exp(-20.0)) / (exp(20.0 / (p + n)) - 1)) * (p / (p + n)) * ((exp(10.0) - exp(-10.0)) / 2)
 / ((exp(10.0) + exp(-10.0)) / 2 - (exp(10.0 - 20.0 * p / (p + n)) + exp(-10.0 + 20.0 * p / (p + n))) / 2) + 1 / (1 - exp(20.0 * (1 - p / (p + n)))), 6) AS auc_bedroc FROM g
 UNION ALL SELECT protein, CAST(max(p) AS BIGINT), CAST(max(n) AS BIGINT), NULL, NULL, NULL FROM b WHERE p = 0 OR n = 0 GROUP BY 1""")
def curve_areas(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.curve_areas(features(spark, folder), "nofusion_Eint", "is_active", ["protein"])
    return out.select("protein", "n_actives", "n_inactives", *[rounded(c) for c in ("auc_roc", "auc_croc", "auc_bedroc")])


@query(_BLOCKS + """ SELECT protein, CAST(cp + cn AS BIGINT) AS n_selected, CAST(cp AS BIGINT) AS hits, round(cp / (cp + cn), 6) AS norm_ef, round(cp / (cp + cn) / (p / (p + n)), 6) AS ef FROM b
 WHERE p > 0 AND floor((p + n) * 0.05) > 0 AND cp + cn >= floor((p + n) * 0.05) AND cp + cn - pos - neg < floor((p + n) * 0.05)""")
def enrichment_factor(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.enrichment_factor(features(spark, folder), "nofusion_Eint", "is_active", ["protein"], 5.0)
    return out.select("protein", "n_selected", "hits", rounded("norm_ef"), rounded("ef"))


@query(_BLOCKS + """, l AS (SELECT protein, s AS lim FROM b WHERE cp + cn >= floor((p + n) * 0.1) AND cp + cn - pos - neg < floor((p + n) * 0.1)),
 a AS (SELECT protein, count(DISTINCT basemolname) AS scaffolds FROM features WHERE is_active = 1 GROUP BY 1),
 q AS (SELECT f.protein, count(DISTINCT basemolname) AS chosen FROM features f JOIN l ON f.protein IS NOT DISTINCT FROM l.protein AND nofusion_Eint <= lim WHERE is_active = 1 GROUP BY 1)
 SELECT z.protein, coalesce(scaffolds, 0) AS scaffolds, round(coalesce(chosen, 0) / nullif(scaffolds, 0), 6) AS share FROM (SELECT DISTINCT protein FROM features) z
 LEFT JOIN a ON a.protein IS NOT DISTINCT FROM z.protein LEFT JOIN q ON z.protein IS NOT DISTINCT FROM q.protein""")
def scaffold_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.scaffold_enrichment(features(spark, folder), "nofusion_Eint", "is_active", "basemolname", ["protein"], 10.0)
    return out.select("protein", "scaffolds", rounded("share"))


@query(_BLOCKS + """, l AS (SELECT protein, s AS lim FROM b WHERE cp + cn >= 20 AND cp + cn - pos - neg < 20)
 SELECT f.protein, basemolname, nofusion_Eint FROM features f JOIN l ON f.protein IS NOT DISTINCT FROM l.protein AND nofusion_Eint <= lim WHERE is_active = 1""")
def actives_in_top(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.actives_in_top(features(spark, folder), "nofusion_Eint", "is_active", "basemolname", ["protein"], 20)


@query(f"""WITH {FEATURES}, c AS (SELECT protein, count(*) FILTER (y = 1 AND q = 1)::DOUBLE AS tp, count(*) FILTER (y <> 1 AND q = 1)::DOUBLE AS fp, count(*) FILTER (y <> 1 AND q <> 1)::DOUBLE AS tn, count(*) FILTER (y = 1 AND q <> 1)::DOUBLE AS fn
 FROM (SELECT protein, is_active AS y, CAST(nofusion_Eint < -45 AS INT) AS q FROM features) WHERE y IS NOT NULL AND q IS NOT NULL GROUP BY 1),
 r AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tn / nullif(tn + fp, 0) AS tnr, fn / nullif(fn + tp, 0) AS fnr, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv FROM c)
 SELECT protein, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(ppv, 6) AS ppv, round(npv, 6) AS npv,
 round((tpr / nullif(fpr, 0)) / nullif(fnr / nullif(tnr, 0), 0), 5) AS dor, round(ppv + npv - 1, 6) AS mk FROM r""")
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).withColumn("predicted", (F.col("nofusion_Eint") < -45).cast("int"))
    out = metrics.confusion(rows, "predicted", "is_active", ["protein"])
    return out.select("protein", "tp", "fp", "tn", "fn", *[rounded(c) for c in ("tpr", "fpr", "ppv", "npv")], rounded("dor", 5), rounded("mk"))


# ---- structures -------------------------------------------------------------------------------------------------------


def _structures(spark: SparkSession, folder: str) -> DataFrame:
    return parse_mol2(table(spark, folder, "mol2_raw"), "record_id", "raw_text")


@query()
def mol2_lowest_energy(spark: SparkSession, folder: str) -> DataFrame:
    return lowest_energies(_structures(spark, folder))


@query()
def atom_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    good = _structures(spark, folder).where("reason is null")
    counts = [c.alias(n) for n, c in (chemistry.bond_type_counts("bonds") | chemistry.named_bond_counts("bonds")).items()]
    return good.select(
        F.col("id").alias("record_id"), F.size("atoms").alias("n_atoms"), chemistry.heavy_atoms("atoms").alias("n_heavy"), chemistry.heteroatoms("atoms").alias("n_hetero"),
        F.round(chemistry.molecular_weight("atoms"), 3).alias("mw"), chemistry.ring_count("atoms", "bonds").alias("n_rings"), *counts,
    )


@query()
def shape_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    good = _structures(spark, folder).where("reason is null")
    out = chemistry.shape_descriptors(good, "id", "atoms")
    return out.select(F.col("id").alias("record_id"), *[rounded(c) for c in chemistry.SHAPE])


@query()
def rotor_groups(spark: SparkSession, folder: str) -> DataFrame:
    good = _structures(spark, folder).where("reason is null")
    out = chemistry.rotor_groups(good, "id", "atoms", "bonds")
    return out.select(F.col("id").alias("record_id"), F.concat_ws(",", F.transform("histogram", lambda x: x.cast("string"))).alias("histogram"))


@query(f"""WITH {_MOL2}, s AS (SELECT record_id, regexp_replace(lower(name), '_pose[0-9]+', '') AS structvar, list_transform(atoms, lambda x: [CAST(string_split(x, ' ')[3] AS DOUBLE), CAST(string_split(x, ' ')[4] AS DOUBLE), CAST(string_split(x, ' ')[5] AS DOUBLE)]) AS p
 FROM mol2 WHERE reason IS NULL), f AS (SELECT structvar, min_by(p, record_id) AS q FROM s GROUP BY 1)
 SELECT record_id, CASE WHEN len(p) = len(q) AND len(p) > 0 THEN round(sqrt(list_sum(list_transform(range(1, len(p) + 1), lambda i: pow(p[i][1] - q[i][1], 2) + pow(p[i][2] - q[i][2], 2) + pow(p[i][3] - q[i][3], 2))) / len(p)), 5) END AS rmsd FROM s JOIN f USING (structvar)""")
def pose_rmsd(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every structure from the first one of its variant, in place."""
    good = _structures(spark, folder).where("reason is null").select("id", structvar_of("molname").alias("structvar"), "atoms")
    first = good.groupBy("structvar").agg(F.min_by("atoms", "id").alias("reference"))
    return good.join(first, "structvar").select(F.col("id").alias("record_id"), F.round(chemistry.rmsd("atoms", "reference"), 5).alias("rmsd"))


# ---- the pipeline -----------------------------------------------------------------------------------------------------


def screening_report(spark: SparkSession, folder: str) -> DataFrame:
    """Names -> poses near the best -> best variant per molecule -> labels -> early enrichment per protein."""
    from posemill.operators.filters import top_window

    near = top_window(poses(spark, folder), ["protein", "structvar"], "score", 1.0, 100)
    order = [F.col(c).asc_nulls_last() for c in ("complexE", "Eint", "pose", "frame")]
    variants = first_in_group(near, ["protein", "structvar"], order)
    best = first_in_group(variants, ["protein", "basemolname"], [F.col("Eint").asc_nulls_last(), F.col("structvar")])
    labelled = best.join(labels(spark, folder), "basemolname")
    out = metrics.curve_areas(labelled, "Eint", "is_active", ["protein"])
    return out.select("protein", "n_actives", "n_inactives", *[rounded(c) for c in ("auc_roc", "auc_croc", "auc_bedroc")])


query()(screening_report)
