"""Queries of names, filters and reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions import names as N
from posemill.operators import filters, ranking, reduce
from posemill.operators.joins import members
from posemill.plans.registry import query, rounded
from posemill.plans.views import ENTROPIES, FEATURES, LABELS, POSES, RUNS, entropies, features, labels, poses, runs
from posemill.functions.keys import clean_name, present
from posemill.runtime import table


@query("""WITH n AS (SELECT row_id, lower(trim(structvar)) || '_pose' || pose AS m FROM scores_df)
SELECT row_id, nullif(regexp_extract(m, '^(.*)_stereo([0-9]+)_ion([0-9]+)_tau([0-9]+)_pose([0-9]+)$', 1), '') AS basemolname,
 CAST(nullif(regexp_extract(m, '_stereo([0-9]+)_ion[0-9]+_tau[0-9]+_pose[0-9]+$', 1), '') AS INT) AS stereoisomer,
 CAST(nullif(regexp_extract(m, '_ion([0-9]+)_tau[0-9]+_pose[0-9]+$', 1), '') AS INT) AS ionstate,
 CAST(nullif(regexp_extract(m, '_tau([0-9]+)_pose[0-9]+$', 1), '') AS INT) AS tautomer,
 CAST(nullif(regexp_extract(m, '_pose([0-9]+)$', 1), '') AS INT) AS pose FROM n""")
def name_decompose(spark: SparkSession, folder: str) -> DataFrame:
    m = F.concat(clean_name("structvar"), F.lit("_pose"), "pose")
    return table(spark, folder, "scores_df").select("row_id", *[c.alias(n) for n, c in N.split_name(m).items()])


@query("""WITH n AS (SELECT row_id, lower(trim(structvar)) || '_pose' || pose || '_frm' || frame AS m FROM scores_df)
SELECT row_id, m AS complex_name, regexp_replace(regexp_replace(m, '_pose[0-9]+', ''), '_frm[0-9]+', '') AS structvar,
 regexp_extract(m, '^(.*)_stereo', 1) AS basemolname, CAST(regexp_extract(m, '_pose([0-9]+)', 1) AS INT) AS pose,
 CAST(regexp_extract(m, '_frm([0-9]+)$', 1) AS INT) AS frame, regexp_extract(m, '^.*_(stereo[0-9]+_ion[0-9]+_tau[0-9]+)', 1) AS suffix FROM n""")
def name_levels(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("complex_name")
    rows = table(spark, folder, "scores_df").select("row_id", N.make_complex_name(clean_name("structvar"), "pose", "frame").alias("complex_name"))
    return rows.select("row_id", m, N.structvar_of(m).alias("structvar"), N.basemolname_of(m).alias("basemolname"), N.level_of(m, "pose").alias("pose"), N.level_of(m, "frame").alias("frame"), N.variant_suffix(m).alias("suffix"))


_WINDOW = f"""WITH {POSES}, m AS (SELECT *, min(score) OVER (PARTITION BY structvar) AS low FROM poses WHERE score IS NOT NULL),
 r AS (SELECT *, rank() OVER (PARTITION BY structvar ORDER BY score) AS rk FROM m WHERE score - low <= 1.0)"""


@query(_WINDOW + " SELECT structvar, pose, frame, score FROM r WHERE rk <= 100")
def top_pose_window(spark: SparkSession, folder: str) -> DataFrame:
    return filters.top_window(poses(spark, folder), ["structvar"], "score", 1.0, 100).select("structvar", "pose", "frame", "score")


@query(f"WITH {POSES} SELECT structvar, pose, frame, score FROM poses WHERE score - (SELECT min(score) FROM poses) <= 5.0")
def top_pose_global(spark: SparkSession, folder: str) -> DataFrame:
    return filters.top_window(poses(spark, folder), [], "score", 5.0, None).select("structvar", "pose", "frame", "score")


@query(_WINDOW + " SELECT structvar, pose, frame, count(*) OVER (PARTITION BY structvar) AS valid_pose_num FROM r WHERE rk <= 100")
def valid_pose_count(spark: SparkSession, folder: str) -> DataFrame:
    return filters.group_size(top_pose_window(spark, folder), ["structvar"], "valid_pose_num").drop("score")


@query(_WINDOW + " SELECT structvar || '_pose' || pose || '_frm1' AS complex_name FROM r WHERE rk <= 100 AND frame = 1")
def top_pose_names(spark: SparkSession, folder: str) -> DataFrame:
    top = top_pose_window(spark, folder).where("frame = 1")
    return top.select(N.make_complex_name("structvar", "pose", F.lit(1)).alias("complex_name"))


def _mad_sql(by: str, value: str, threshold: float, rows: str = "poses", prefix: str = "") -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""{prefix}a AS (SELECT *, median({value}) {over} AS md FROM {rows}),
 {prefix}b AS (SELECT *, abs({value} - md) AS d FROM {prefix}a), {prefix}c AS (SELECT *, median(d) {over} AS mad FROM {prefix}b),
 {prefix}k AS (SELECT * FROM {prefix}c WHERE NOT coalesce(d * 0.6745 > mad * {threshold}, false))"""


@query(f"WITH {POSES}, {_mad_sql('structvar, frame', 'complexE', 3.5)} SELECT row_id, complexE FROM k")
def mad_outliers_group(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_outliers(poses(spark, folder), ["structvar", "frame"], ["complexE"], 3.5).select("row_id", "complexE")


@query(f"WITH {POSES}, {_mad_sql('', 'Eint', 3.5)} SELECT row_id, Eint FROM k")
def mad_outliers_global(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_outliers(poses(spark, folder), [], ["Eint"], 3.5).select("row_id", "Eint")


@query(f"WITH {POSES}, {_mad_sql('structvar', 'complexE', 3.0, prefix='x')}, {_mad_sql('structvar', 'Eint', 3.0, prefix='y')} SELECT row_id FROM xk SEMI JOIN yk USING (row_id)")
def mad_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_outliers(poses(spark, folder), ["structvar"], ["complexE", "Eint"], 3.0).select("row_id")


@query(f"WITH {POSES}, l AS (SELECT *, CASE WHEN ligandE_bound < 0 THEN log10(-ligandE_bound) END AS lg FROM poses), {_mad_sql('protein', 'lg', 3.0, 'l')} SELECT row_id FROM k")
def mad_outliers_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder).withColumn("size", -F.col("ligandE_bound"))
    return filters.without_outliers(rows, ["protein"], ["size"], 3.0, logarithm=True).select("row_id")


_RATIO = f"WITH {POSES}, t AS (SELECT structvar, count(*) AS n_total, count(Eint) AS n_scored, count(Eint) / count(*) AS ratio FROM poses GROUP BY 1)"


@query(_RATIO + " SELECT row_id FROM poses JOIN t USING (structvar) WHERE Eint IS NOT NULL AND ratio > 0.8")
def underscored_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.well_scored(poses(spark, folder), ["structvar"], F.col("Eint").isNotNull(), 0.8)[0].select("row_id")


@query(_RATIO + " SELECT structvar, n_total, n_scored, round(ratio, 6) AS ratio FROM t WHERE ratio <= 0.8")
def rejected_ratio_report(spark: SparkSession, folder: str) -> DataFrame:
    out = filters.well_scored(poses(spark, folder), ["structvar"], F.col("Eint").isNotNull(), 0.8)[1]
    return out.select("structvar", "n_total", "n_scored", rounded("ratio"))


@query(f"SELECT * EXCLUDE (HYPER_RATIO_SCORED_POSES) REPLACE ({', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in ('auc_roc', 'auc_bedroc', 'r_i_docking_score'))}) FROM hyper_opt_df")
def uniform_columns(spark: SparkSession, folder: str) -> DataFrame:
    kept = filters.drop_uniform(table(spark, folder, "hyper_opt_df"))
    return kept.select(*[present(c).alias(c) if t == "double" and c in ("auc_roc", "auc_bedroc", "r_i_docking_score") else F.col(c) for c, t in kept.dtypes])


@query(f"WITH {FEATURES} SELECT feature_id FROM features WHERE protein IS NOT NULL AND is_active IS NOT NULL AND nofusion_Eint IS NOT NULL AND ring_flexibility IS NOT NULL")
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return filters.drop_missing(features(spark, folder), ["protein", "is_active", "nofusion_Eint", "ring_flexibility"]).select("feature_id")


@query(f"WITH {FEATURES} SELECT feature_id, COLUMNS('^(A?MW|bondType_[A-Z]+)$') FROM features")
def regex_columns(spark: SparkSession, folder: str) -> DataFrame:
    return filters.matching_columns(features(spark, folder), "^(A?MW|bondType_[A-Z]+)$", ("feature_id",))


@query(f"WITH {POSES}, {_mad_sql('structvar', 'complexE', 3.5)}, few AS (SELECT structvar, count(Eint) AS n FROM poses GROUP BY 1) SELECT row_id, structvar, complexE FROM c JOIN few USING (structvar) WHERE coalesce(d * 0.6745 > mad * 3.5, false) OR n < 2")
def outlier_report(spark: SparkSession, folder: str) -> DataFrame:
    return filters.outlier_report(poses(spark, folder), ["structvar"], "complexE", 3.5, ["row_id", "structvar", "complexE"], F.col("Eint").isNotNull(), 2)


@query(f"""WITH {POSES}, m AS (SELECT structvar, score - min(score) OVER (PARTITION BY structvar) AS d FROM poses), h AS (SELECT structvar, count(d) AS valid_pose_num,
 {", ".join(f'count(*) FILTER (d >= {k} AND d < {k + 1}) AS k{k}' for k in range(6))} FROM m GROUP BY 1)
 SELECT structvar, {", ".join(f'round(k{k} / nullif(valid_pose_num, 0), 9) AS "DeltaG_{k}to{k + 1}_ratio"' for k in range(6))} FROM h""")
def ratio_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder)
    both = reduce.energy_histogram(rows, ["structvar"], "score").join(rows.groupBy("structvar").agg(F.count("score").alias("valid_pose_num")), "structvar")
    out = filters.ratio_columns(both, "^DeltaG_[0-9]to[0-9]$", "valid_pose_num")
    return out.select("structvar", *[rounded(c, 9) for c in out.columns if c.endswith("_ratio")])


@query(f"WITH {POSES} SELECT DISTINCT protein, basemolname FROM poses")
def distinct_molecules(spark: SparkSession, folder: str) -> DataFrame:
    return poses(spark, folder).select("protein", "basemolname").dropDuplicates()


@query(f"WITH {FEATURES} SELECT feature_id, round(CASE WHEN AMW <> 0 THEN MW / AMW END, 6) AS n_atoms FROM features")
def derived_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).select("feature_id", F.round(F.try_divide("MW", "AMW"), 6).alias("n_atoms"))


@query(f"""WITH {POSES}, p AS (SELECT *, row_number() OVER (PARTITION BY structvar ORDER BY complexE NULLS LAST, structvar, pose, frame) AS r1 FROM poses),
 v AS (SELECT *, row_number() OVER (PARTITION BY basemolname ORDER BY Eint NULLS LAST, structvar, pose, frame) AS r2 FROM p WHERE r1 = 1)
 SELECT basemolname, structvar, pose, frame, complexE, Eint AS nofusion_Eint FROM v WHERE r2 = 1""")
def best_variant_two_level(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce.best_in_two_steps(poses(spark, folder), ["structvar"], ["basemolname"], "complexE", "Eint", ["structvar", "pose", "frame"], "nofusion_Eint")
    return out.select("basemolname", "structvar", "pose", "frame", "complexE", "nofusion_Eint")


@query(f"""WITH {POSES}, v AS (SELECT *, row_number() OVER (PARTITION BY basemolname ORDER BY score, structvar, pose, frame) AS r FROM poses WHERE score IS NOT NULL)
 SELECT basemolname, structvar, pose, frame, score FROM v WHERE r = 1""")
def best_per_molecule(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder).where("score is not null")
    out = ranking.first_in_group(rows, ["basemolname"], [F.col(c) for c in ("score", "structvar", "pose", "frame")])
    return out.select("basemolname", "structvar", "pose", "frame", "score")


@query(f"WITH {POSES} SELECT structvar, min(pose) AS min_pose, min(score) AS min_score, min(ligandE_bound) AS min_ligandE_bound FROM poses GROUP BY 1")
def colwise_min(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.columnwise_min(poses(spark, folder), ["structvar"], ["pose", "score", "ligandE_bound"])


@query(f"WITH {POSES}, m AS (SELECT *, min(score) OVER (PARTITION BY structvar) AS low FROM poses) SELECT row_id, structvar, score FROM m WHERE score = low")
def keep_all_minima(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.all_minima(poses(spark, folder), ["structvar"], "score").select("row_id", "structvar", "score")


@query(f"WITH {POSES} SELECT row_id, min(ligandE_bound) OVER (PARTITION BY structvar) AS min_ligandE_bound FROM poses")
def min_back_join(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.add_group_min(poses(spark, folder), ["structvar"], {"ligandE_bound": "min_ligandE_bound"}).select("row_id", "min_ligandE_bound")


_DELTA = f"""WITH {POSES}, v AS (SELECT protein, structvar, min(complexE) AS c, min(ligandE_bound) AS l FROM poses GROUP BY 1, 2),
 r AS (SELECT protein, min(proteinE_bound) AS p FROM poses GROUP BY 1),
 d AS (SELECT v.protein, structvar, round(c - p - l, 4) AS "DeltaH" FROM v JOIN r ON v.protein IS NOT DISTINCT FROM r.protein)"""


@query(_DELTA + " SELECT * FROM d")
def delta_h(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce.delta_h(poses(spark, folder), "structvar", "complexE", "proteinE_bound", "ligandE_bound", "DeltaH", ["protein"])
    return out.select("protein", "structvar", rounded("DeltaH", 4))


@query(_DELTA.replace("round(c - p - l, 4)", "c - p - l") + f""", {ENTROPIES} SELECT d.protein, d.structvar, round(d."DeltaH" + coalesce(confS, 0), 4) AS score FROM d LEFT JOIN entropies USING (structvar)""")
def delta_h_with_entropy(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce.delta_h(poses(spark, folder), "structvar", "complexE", "proteinE_bound", "ligandE_bound", "DeltaH", ["protein"])
    both = out.join(entropies(spark, folder), "structvar", "left")
    return both.select("protein", "structvar", F.round(F.col("DeltaH") + F.coalesce("confS", F.lit(0.0)), 4).alias("score"))


@query(f"WITH {POSES} SELECT structvar, count(*) AS n_poses, count(Eint) AS n_scored FROM poses GROUP BY 1")
def pose_counts(spark: SparkSession, folder: str) -> DataFrame:
    return filters.scored_ratio(poses(spark, folder), ["structvar"], F.col("Eint").isNotNull()).select("structvar", F.col("n_total").alias("n_poses"), "n_scored")


@query(f"""WITH {POSES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structvar ORDER BY complexE NULLS LAST, pose, frame) AS r FROM poses) WHERE r = 1),
 i AS (SELECT avg(a) AS x, avg(p) AS y FROM (SELECT stddev_samp(complexE) AS a, stddev_samp(proteinE_bound) AS p FROM poses GROUP BY structvar))
 SELECT round(x, 3) AS "mean_stdev_complexE", round(y, 3) AS "mean_stdev_proteinE_bound",
 round((SELECT stddev_samp(complexE) FROM b), 3) AS "stdev_best_complexE", round((SELECT stddev_samp(proteinE_bound) FROM b), 3) AS "stdev_best_proteinE_bound",
 round((SELECT stddev_samp(complexE) FROM poses), 3) AS "stdev_all_complexE", round((SELECT stddev_samp(proteinE_bound) FROM poses), 3) AS "stdev_all_proteinE_bound" FROM i""")
def fluctuations(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder)
    best = ranking.first_in_group(rows, ["structvar"], [F.col("complexE").asc_nulls_last(), F.col("pose"), F.col("frame")])
    out = reduce.fluctuations(rows, ["structvar"], best, ["complexE", "proteinE_bound"])
    return out.select(*[rounded(c, 3) for c in out.columns])


@query(f"""WITH {POSES}, m AS (SELECT structvar, score - min(score) OVER (PARTITION BY structvar) AS d FROM poses) SELECT structvar,
 {", ".join(f'count(*) FILTER (d >= {k} AND d < {k + 1}) AS "DeltaG_{k}to{k + 1}"' for k in range(6))} FROM m GROUP BY 1""")
def energy_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.energy_histogram(poses(spark, folder), ["structvar"], "score")


@query(f"""WITH {FEATURES} SELECT protein, count(DISTINCT CASE WHEN is_active = 1 THEN basemolname END) AS num_of_actives,
 count(DISTINCT CASE WHEN is_active = 0 THEN basemolname END) AS num_of_inactives, min(nofusion_Eint) AS minimum, round(avg(nofusion_Eint), 9) AS mean,
 max(nofusion_Eint) AS max, round(stddev_samp(nofusion_Eint), 4) AS stdev, round(max(nofusion_Eint) - min(nofusion_Eint), 4) AS range,
 round(stddev_pop(nofusion_Eint) / (max(nofusion_Eint) - min(nofusion_Eint)), 6) AS scaled_stdev FROM features GROUP BY 1""")
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce.score_summary(features(spark, folder), "basemolname", "nofusion_Eint", "is_active", ["protein"])
    return out.select("protein", "num_of_actives", "num_of_inactives", "minimum", rounded("mean", 9), "max", rounded("stdev", 4), rounded("range", 4), rounded("scaled_stdev"))


@query(f"""WITH {FEATURES} SELECT basemolname, {", ".join(f"round(avg({c}), 9) AS {c}" for c in ("MW", "AMW", "deepFl_logP", "nofusion_Eint"))} FROM features GROUP BY 1""")
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).groupBy("basemolname").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("MW", "AMW", "deepFl_logP", "nofusion_Eint")])


@query(f"""WITH {FEATURES}, c AS (SELECT protein, is_active, count(*) AS n FROM features GROUP BY 1, 2)
 SELECT protein, is_active, n, round(n / sum(n) OVER (PARTITION BY protein), 6) AS share FROM c""")
def class_share_weights(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.class_shares(features(spark, folder), ["protein"], "is_active", "share").select("protein", "is_active", "n", rounded("share"))


_SCORES = ("nofusion_Eint", "nofusion_DeltaH", "r_i_docking_score", "meanrank_Eint")


@query(f"WITH {RUNS} SELECT protein, {', '.join(f'count(*) FILTER (score_name = {chr(39)}{s}{chr(39)}) AS n_{s}' for s in _SCORES)} FROM runs GROUP BY 1")
def type_count_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.type_counts(runs(spark, folder), ["protein"], "score_name", list(_SCORES), "n_")


@query("SELECT lower(trim(basemolname)) AS basemolname, count(*) AS n FROM activities GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    return reduce.repeated(table(spark, folder, "activities").select(clean_name("basemolname").alias("basemolname")), ["basemolname"])


@query(f"""WITH {POSES}, m AS (SELECT *, avg(Eint) OVER (PARTITION BY basemolname, frame) AS mu FROM poses)
 SELECT basemolname, frame, count(Eint) AS n, round(avg(Eint), 9) AS mean, round(stddev_pop(Eint), 4) AS stdev, round(stddev_samp(Eint) / sqrt(count(Eint)), 4) AS stderr,
 CASE WHEN stddev_pop(Eint) > 1e-9 THEN round(avg(pow(Eint - mu, 3)) / pow(avg(pow(Eint - mu, 2)), 1.5), 3) END AS skewness FROM m GROUP BY 1, 2""")
def term_moments(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce.moments(poses(spark, folder), ["basemolname", "frame"], "Eint")
    skew = F.when(F.col("stdev") > 1e-9, F.round("skewness", 3)).alias("skewness")
    return out.select("basemolname", "frame", "n", rounded("mean", 9), rounded("stdev", 4), rounded("stderr", 4), skew)


@query(f"WITH {FEATURES}, {LABELS} SELECT feature_id FROM features SEMI JOIN labels USING (basemolname)")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return members(features(spark, folder), labels(spark, folder), ["basemolname"]).select("feature_id")


@query(f"WITH {FEATURES}, {LABELS} SELECT feature_id FROM features ANTI JOIN labels USING (basemolname)")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return members(features(spark, folder), labels(spark, folder), ["basemolname"], keep=False).select("feature_id")
