"""Training and evaluation on feature tables with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.operators.joins import null_safe_join
from posemill.operators.metrics import curve_areas
from posemill.runtime import Scratch, ship

ship(__name__)


def assemble(df: DataFrame, features: list[str], label: str | None) -> DataFrame:
    """Rows whose features (and label) are present, with a ``features`` vector and a double ``label``."""
    rows = df.dropna("any", subset=[*features, *([label] if label else [])])
    if label:
        rows = rows.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def group_weights(df: DataFrame, group: str, into: str) -> DataFrame:
    """Weight 1 + minmax(N/n_g normalised) in [1, 2] per group: small groups count up to twice; one group alone counts 1."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    bounds = counts.agg(F.min(1 / F.col("_n")).alias("lo"), F.max(1 / F.col("_n")).alias("hi")).first()
    span = (bounds["hi"] or 0) - (bounds["lo"] or 0)
    weight = F.lit(1.0) if not span else 1 + (1 / F.col("_n") - bounds["lo"]) / span
    return null_safe_join(df, counts.select(group, weight.alias(into)), [group])


def similarity_share(train: DataFrame, label: str, by: list[str], into: str) -> DataFrame:
    """Training rows with the share of their label in their group as weight."""
    from posemill.operators.reduce import class_shares

    shares = class_shares(train, by, label, into).drop("n")
    return null_safe_join(train, shares, [*by, label])


def registry(trees: int = 100, seed: int = 1) -> dict[str, Callable[[], object]]:
    """Estimators by name. The penalty of the logistic ones is set at the fit, where the sum of weights is known."""
    return {
        "logistic_regression": lambda: LogisticRegression(standardization=False, maxIter=200, tol=1e-9),
        "grouped_logistic_regression": lambda: LogisticRegression(standardization=False, maxIter=200, tol=1e-9, weightCol="weight"),
        "linear_svc": lambda: LinearSVC(maxIter=100),
        "random_forest": lambda: RandomForestClassifier(numTrees=trees, seed=seed),
        "gradient_boosting": lambda: GBTClassifier(maxIter=20, featureSubsetStrategy="2", seed=seed),
        "neural_network": lambda: MultilayerPerceptronClassifier(seed=seed, maxIter=100),
    }


def fit(train: DataFrame, name: str, features: list[str], label: str, group: str | None = None, alpha: float = 1.0) -> Model:
    """A fitted model of the registry; the grouped one weights rows by group_weights.

    Logistic models minimise sum(w * loss) + alpha/2*|b|^2, which is Spark's objective at regParam = alpha / sum(w).
    """
    rows = assemble(train, features, label)
    estimator = registry()[name]()
    if name == "grouped_logistic_regression":
        rows = group_weights(rows, group, "weight")
    if isinstance(estimator, LogisticRegression):
        total = rows.agg(F.sum("weight") if "weight" in rows.columns else F.count("*")).first()[0] or 1
        estimator.setRegParam(alpha / float(total))
    if isinstance(estimator, MultilayerPerceptronClassifier):
        estimator.setLayers([len(features), 1, 2])
    return estimator.fit(rows)


def fit_cross_validated(train: DataFrame, features: list[str], label: str, alphas: list[float], n_folds: int = 3, seed: int = 1) -> Model:
    """Logistic regression whose penalty is chosen among alphas by the ROC area over random folds."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = assemble(train, features, label)
    n = rows.count() or 1
    model = LogisticRegression(standardization=False, maxIter=200)
    grid = ParamGridBuilder().addGrid(model.regParam, [a / n for a in alphas]).build()
    return CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=n_folds, seed=seed).fit(rows).bestModel


@dataclass
class BoostedTrees:
    """Weighted vote of shallow trees."""

    trees: list
    weights: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with ``probability``: the weighted share of votes for class 0 and 1."""
        total = sum(self.weights) or 1.0
        vote, out = F.lit(0.0), rows
        for i, (t, w) in enumerate(zip(self.trees, self.weights, strict=True)):
            out = t.setPredictionCol(f"_p{i}").transform(out).drop("rawPrediction", "probability")
            vote = vote + F.col(f"_p{i}") * w
        from pyspark.ml.functions import array_to_vector

        share = vote / total
        out = out.withColumn("probability", array_to_vector(F.array(1 - share, share)))
        return out.drop(*[f"_p{i}" for i in range(len(self.trees))])


def fit_adaboost(train: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 1, seed: int = 1) -> BoostedTrees:
    """Discrete AdaBoost over decision trees: a weighted fit and one aggregate per round, weights kept in a written table."""
    scratch = Scratch(train.sparkSession, "adaboost")
    rows = scratch.cut(assemble(train, features, label).select("features", "label").withColumn("weight", F.lit(1.0)))
    trees, weights = [], []
    for _ in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=seed).fit(rows)
        judged = tree.transform(rows).select("features", "label", "weight", (F.col("prediction") != F.col("label")).alias("wrong"))
        bad, total = judged.agg(F.sum(F.when(F.col("wrong"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
        if not total or bad / total >= 0.5:
            break
        error = max(bad / total, 1e-10)
        stage = float(np.log((1 - error) / error))
        trees.append(tree)
        weights.append(stage)
        if bad == 0:
            break
        last, rows = rows, scratch.cut(judged.select("features", "label", F.when(F.col("wrong"), F.col("weight") * float(np.exp(stage))).otherwise(F.col("weight")).alias("weight")))
        scratch.drop(last)
    return BoostedTrees(trees, weights)


def random_fourier(df: DataFrame, features: list[str], count: int = 64, gamma: float | None = None, seed: int = 1) -> tuple[DataFrame, list[str]]:
    """df with cos(w.x + b) columns whose inner products approximate the RBF kernel exp(-gamma |x-y|^2); gamma 1/features by default."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * (gamma or 1 / len(features))), (count, len(features)))
    b = rng.uniform(0, 2 * np.pi, count)
    names = [f"rff{i}" for i in range(count)]
    columns = []
    for i, n in enumerate(names):
        total = F.lit(float(b[i]))
        for f, x in zip(features, w[i], strict=True):
            total = total + F.col(f) * float(x)
        columns.append((F.cos(total) * float(np.sqrt(2 / count))).alias(n))
    return df.select("*", *columns), names


def regression(train: DataFrame, features: list[str], target: str, kind: str, penalty: float = 0.1) -> DataFrame:
    """feature, coefficient of a linear, lasso or ridge regression."""
    mixing = {"linear": (0.0, 0.0), "lasso": (penalty, 1.0), "ridge": (penalty, 0.0)}[kind]
    model = LinearRegression(regParam=mixing[0], elasticNetParam=mixing[1]).fit(assemble(train, features, target))
    return train.sparkSession.createDataFrame(list(zip(features, model.coefficients.toArray().tolist(), strict=True)), "feature string, coefficient double")


def predict(model: Model, df: DataFrame, features: list[str], into: str) -> DataFrame:
    """df with the probability of class 1 (for the linear SVC its margin); rows with missing features are left out."""
    columns = df.columns
    out = model.transform(assemble(df, features, None))
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn(into, vector_to_array(F.col(raw))[1]).select(*columns, into)


def folds(df: DataFrame, group: str) -> list[tuple[list[str], str]]:
    """(training groups, test group) for every group; none where there is only one. Null groups take no part."""
    names = sorted(r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().collect())
    return [([x for x in names if x != n], n) for n in names] if len(names) > 1 else []


def fold_table(df: DataFrame, group: str) -> DataFrame:
    """test_group, train_group, n_rows: the groups every fold trains on."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"))
    everyone = counts.agg(F.collect_set(group).alias("all")).select("all")
    from posemill.operators.joins import beside

    return beside(counts, everyone).select(F.explode("all").alias("test_group"), F.col(group).alias("train_group"), "n_rows").where("test_group <> train_group")


def leave_one_out(df: DataFrame, name: str, features: list[str], label: str, group: str, reduce_to: int | None = None) -> DataFrame:
    """Metrics of every held-out group: test_group, n_actives, n_inactives, auc_roc, auc_croc, auc_bedroc.

    ``reduce_to`` replaces the features by principal components fitted on the training groups of the fold only.
    """
    rows = Scratch(df.sparkSession, "loo").cut(df.select(group, label, *features).dropna("any"))
    parts = []
    for _, held in folds(rows, group):
        train, test, used = rows.where(F.col(group) != held), rows.where(F.col(group) == held), features
        if reduce_to:
            train, test, used = reduce_dimensions(train, test, features, reduce_to)
        scored = predict(fit(train, name, used, label, group), test, used, "probability")
        parts.append(curve_areas(scored.withColumn("score", -F.col("probability")), "score", label, [group]))
    out = parts[0] if parts else rows.limit(0).select(group)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed(group, "test_group")


def reduce_dimensions(train: DataFrame, test: DataFrame, features: list[str], k: int | float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with plec_pc1.. beside the other columns, fitted on train: k components, or as many as explain a share k < 1."""
    rows = assemble(train, features, None)
    model = PCA(k=len(features) if k < 1 else int(k), inputCol="features", outputCol="pc").fit(rows)
    n = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), k) + 1) if k < 1 else int(k)
    names = [f"plec_pc{i + 1}" for i in range(n)]

    def project(t: DataFrame) -> DataFrame:
        out = model.transform(assemble(t, features, None))
        keep = [c for c in t.columns if c not in features]
        a = vector_to_array("pc")
        return out.select(*keep, *[a[i].alias(c) for i, c in enumerate(names)])

    return project(train), project(test), names


def importances(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    values = model.featureImportances.toArray()
    return spark.createDataFrame(list(zip(features, map(float, values), strict=True)), "feature string, importance double")


def select_features(model: Model, features: list[str], most: int) -> list[str]:
    """Features of at least mean importance, the most important ``most`` of them."""
    values = model.featureImportances.toArray()
    good = [i for i in np.argsort(-values, kind="stable") if values[i] >= values.mean()][:most]
    return [features[i] for i in sorted(good)]


def permutation_importance(model: Model, df: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """feature, importance: loss of ROC area when one feature's values are dealt out anew.

    Values are dealt by joining ranks in two hash orders; ranks are row numbers within hash buckets of about 100 000 rows, so no
    table is sorted in one task.
    """
    spark = df.sparkSession
    rows = Scratch(spark, "permutation").cut(df.select(label, *features).dropna("any").withColumn("_u", F.monotonically_increasing_id()))

    def area(t: DataFrame) -> float:
        scored = predict(model, t, features, "p").withColumn("s", -F.col("p"))
        r = curve_areas(scored, "s", label, []).first()
        return r["auc_roc"] if r and r["auc_roc"] is not None else float("nan")

    base, out = area(rows), []
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64("_u"), F.lit(1 + rows.count() // 100_000))
    turn = Window.partitionBy("_b")
    left = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(turn.orderBy(F.xxhash64("_u", F.lit(seed)))))
    for f in features:
        dealt = rows.select(F.col(f).alias("_v"), bucket.alias("_b"), F.row_number().over(Window.partitionBy(bucket).orderBy(F.xxhash64("_u", F.lit(seed), F.lit(f)))).alias("_r"))
        mixed = left.join(dealt, ["_b", "_r"]).withColumn(f, F.col("_v")).drop("_v", "_r", "_b")
        out.append((f, base - area(mixed)))
    return spark.createDataFrame(out, "feature string, importance double")


def stability_selection(df: DataFrame, features: list[str], label: str, penalty: float, repeats: int = 20, seed: int = 1) -> DataFrame:
    """feature, frequency: how often a lasso on half of the rows, columns weakened at random, keeps a feature."""
    rows = assemble(df, features, label)
    rng = np.random.default_rng(seed)
    kept = np.zeros(len(features))
    for i in range(repeats):
        weak = rng.choice([0.5, 1.0], len(features))
        scaled = F.transform(vector_to_array("features"), lambda x, j: x * F.get(F.array(*[F.lit(float(w)) for w in weak]), j))
        from pyspark.ml.functions import array_to_vector

        part = rows.sample(0.5, seed + i).withColumn("features", array_to_vector(scaled))
        model = LinearRegression(elasticNetParam=1.0, regParam=penalty).fit(part)
        kept += np.abs(model.coefficients.toArray()) > 1e-9
    return df.sparkSession.createDataFrame(list(zip(features, (kept / repeats).tolist(), strict=True)), "feature string, frequency double")


def tree_contributions(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """feature, contribution, share: mean absolute path contribution to the class-1 probability of a forest, and its softmax.

    A step of a decision path credits its feature with the change of the node's class-1 share (Saabas 2014); the trees, a few
    thousand nodes, travel to the workers and rows stay where they are.
    """
    trees = []
    for t in model.trees:
        nodes = {r.id: r for r in _nodes(t)}
        trees.append([nodes[i] for i in range(len(nodes))])

    flat = [[(r.left, r.right, r.feature, r.threshold, r.share) for r in t] for t in trees]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(np.float64)
            total = np.zeros_like(x)
            for t in flat:
                left, right, feat, cut, share = (np.array(c) for c in zip(*t, strict=True))
                node = np.zeros(len(x), int)
                while (open_ := left[node] >= 0).any():
                    i = np.flatnonzero(open_)
                    f = feat[node[i]]
                    child = np.where(x[i, f] <= cut[node[i]], left[node[i]], right[node[i]])
                    total[i, f] += share[child] - share[node[i]]
                    node[i] = child
            total /= max(len(flat), 1)
            yield pd.DataFrame({"feature": features, "s": np.abs(total).sum(0), "n": len(x)})

    sums = df.select(*[F.col(f).cast("double") for f in features]).dropna("any").mapInPandas(run, "feature string, s double, n long")
    mean = sums.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("contribution"))
    from posemill.operators.joins import beside

    e: Column = F.exp("contribution")
    return beside(mean, mean.agg(F.sum(e).alias("_e"))).withColumn("share", e / F.col("_e")).drop("_e")


def _nodes(tree: Model) -> list:
    """The nodes of a decision tree with the class-1 share of each, children by position."""
    from types import SimpleNamespace

    out: list = []

    def walk(node) -> int:  # noqa: ANN001
        stats = list(node.impurityStats().stats()) if hasattr(node, "impurityStats") else [1.0, 0.0]
        at = len(out)
        out.append(SimpleNamespace(id=at, left=-1, right=-1, feature=0, threshold=0.0, share=stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            out[at].feature, out[at].threshold = split.featureIndex(), split.threshold()
            out[at].left, out[at].right = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(tree._call_java("rootNode"))
    return out


def hyper_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """A row per combination of parameter values (the grid is given, hence small)."""
    rows = list(product(*values.values()))
    return spark.createDataFrame(rows, list(values)) if rows else spark.createDataFrame([], ", ".join(f"{k} string" for k in values))
