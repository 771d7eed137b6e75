"""Queries that train models. Only their rows can be compared, not their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.operators import learning
from posemill.plans.registry import query, rounded
from posemill.plans.views import FEATURES, RUNS, VECTOR, features, runs
from posemill.runtime import table

FEATURE_COLUMNS = ["nofusion_Eint", "MW", "AMW", "deepFl_logP", "ring_flexibility", "function_group_count", "bondType_SINGLE", "net_charge"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return features(spark, folder).where("is_active is not null and protein is not null")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    columns = [F.when(~F.isnan(v), F.col(v).cast("double")).alias(v) for v in VECTOR]
    return table(spark, folder, "features_df").select("feature_id", *columns).dropna("any")


@query(f"""WITH {FEATURES}, c AS (SELECT protein, count(*) AS n_rows FROM features WHERE protein IS NOT NULL GROUP BY 1)
 SELECT a.protein AS test_group, b.protein AS train_group, b.n_rows FROM c a JOIN c b ON a.protein <> b.protein""")
def fold_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return learning.fold_table(features(spark, folder), "protein")


@query(f"""WITH {FEATURES}, c AS (SELECT protein, 1.0 / count(*) AS i FROM features WHERE protein IS NOT NULL GROUP BY 1)
 SELECT protein, round(1 + (i - (SELECT min(i) FROM c)) / (SELECT max(i) - min(i) FROM c), 6) AS weight FROM c""")
def group_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).where("protein is not null")
    return learning.group_weights(rows, "protein", "weight").select("protein", rounded("weight")).distinct()


@query("SELECT ratio.column0 AS ratio, mad.column0 AS mad, keep.column0 AS keep FROM (VALUES (0.5), (0.8)) ratio(column0), (VALUES (2.0), (3.5), (5.0)) mad(column0), (VALUES (1.0), (2.0)) keep(column0)".replace("SELECT ratio.column0 AS ratio, mad.column0 AS mad, keep.column0 AS keep", "SELECT CAST(ratio.column0 AS DOUBLE) AS ratio, CAST(mad.column0 AS DOUBLE) AS mad, CAST(keep.column0 AS DOUBLE) AS keep"))
def hyper_grid(spark: SparkSession, folder: str) -> DataFrame:  # noqa: ARG001
    return learning.hyper_grid(spark, {"ratio": [0.5, 0.8], "mad": [2.0, 3.5, 5.0], "keep": [1.0, 2.0]})


@query(f"""WITH {RUNS} SELECT score_name, round(quantile_cont(auc_roc, 0.5), 6) AS middle, count(DISTINCT directory) AS n_directories FROM runs GROUP BY 1""")
def sweep_summary(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).groupBy("score_name").agg(F.round(F.percentile("auc_roc", 0.5), 6).alias("middle"), F.count_distinct("directory").alias("n_directories"))


@query()
def lr_fit_predict(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    model = learning.fit(rows, "logistic_regression", FEATURE_COLUMNS, "is_active")
    return learning.predict(model, rows, FEATURE_COLUMNS, "probability").select("feature_id", rounded("probability", 4))


@query()
def grouped_lr(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    model = learning.fit(rows, "grouped_logistic_regression", FEATURE_COLUMNS, "is_active", "protein")
    return learning.predict(model, rows, FEATURE_COLUMNS, "probability").select("feature_id", rounded("probability", 4))


@query()
def linear_svc_margins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    model = learning.fit(rows, "linear_svc", FEATURE_COLUMNS, "is_active")
    return learning.predict(model, rows, FEATURE_COLUMNS, "margin").select("feature_id", rounded("margin", 4))


@query()
def rf_importance(spark: SparkSession, folder: str) -> DataFrame:
    model = learning.fit(_rows(spark, folder), "random_forest", FEATURE_COLUMNS, "is_active")
    return learning.importances(spark, model, FEATURE_COLUMNS)


@query()
def gbt_selected_features(spark: SparkSession, folder: str) -> DataFrame:
    model = learning.fit(_rows(spark, folder), "gradient_boosting", FEATURE_COLUMNS, "is_active")
    return spark.createDataFrame([(f,) for f in learning.select_features(model, FEATURE_COLUMNS, 4)], "feature string")


@query()
def forest_contributions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    model = learning.fit(rows, "random_forest", FEATURE_COLUMNS, "is_active")
    return learning.tree_contributions(model, rows, FEATURE_COLUMNS)


@query()
def perm_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    model = learning.fit(rows, "logistic_regression", FEATURE_COLUMNS, "is_active")
    return learning.permutation_importance(model, rows, FEATURE_COLUMNS, "is_active")


@query()
def pca_reduce(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    out, _, names = learning.reduce_dimensions(rows, rows.limit(0), list(VECTOR), 5)
    return out.select("feature_id", *[F.round(F.abs(c), 3).alias(c) for c in names])


@query()
def leave_one_protein_out(spark: SparkSession, folder: str) -> DataFrame:
    return learning.leave_one_out(_rows(spark, folder), "grouped_logistic_regression", FEATURE_COLUMNS, "is_active", "protein")


@query()
def lasso_stability(spark: SparkSession, folder: str) -> DataFrame:
    return learning.stability_selection(_rows(spark, folder), FEATURE_COLUMNS, "is_active", 0.01, repeats=8)
