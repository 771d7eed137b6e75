"""Early-enrichment evaluation of scores; a lower score is better.

All curves are taken over distinct scores: rows are counted per group and score first (map-side), so running sums see each score
once, in ranges of scores, and tied rows always move together. Rows with a missing score or label do not count. A group with one class only has
null metrics.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.operators.joins import null_safe_join
from posemill.operators.ranking import running_totals

BEDROC_ALPHA = 20.0
CROC_ALPHA = 7.0


def score_blocks(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """by..., score, pos, neg, with the totals P, N and the counts cum_pos, cum_neg up to and with the score, best first."""
    s = F.col(score).cast("double")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).withColumn("_s", s)
    blocks = rows.groupBy(*by, "_s").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_totals(blocks, by, "_s", {"pos": ("cum_pos", "P"), "neg": ("cum_neg", "N")})


def _magnified(x: Column, alpha: float) -> Column:
    return (1 - F.exp(x * -alpha)) / (1 - exp(-alpha))


def curve_areas(df: DataFrame, score: str, label: str, by: list[str], bedroc_alpha: float = BEDROC_ALPHA, croc_alpha: float = CROC_ALPHA) -> DataFrame:
    """by..., n_actives, n_inactives, auc_roc, auc_croc, auc_bedroc.

    auc_roc is the Mann-Whitney probability with ties counted half; auc_croc the area under the curve whose false positive
    rate x becomes (1-e^(-ax))/(1-e^(-a)); auc_bedroc the closed form of Truchon and Bayly (2007), a tied row taking the
    mean weight of its block.
    """
    b = score_blocks(df, score, label, by)
    p, n, a = F.col("P"), F.col("N"), bedroc_alpha
    total = p + n
    fpr, tpr = F.col("cum_neg") / n, F.col("cum_pos") / p
    fpr0, tpr0 = (F.col("cum_neg") - F.col("neg")) / n, (F.col("cum_pos") - F.col("pos")) / p
    before, size = F.col("cum_pos") + F.col("cum_neg") - F.col("pos") - F.col("neg"), F.col("pos") + F.col("neg")
    weight = F.exp((before + 1) * -a / total) * (1 - F.exp(size * -a / total)) / ((1 - F.exp(F.lit(-a) / total)) * size)
    sums = b.where("P > 0 and N > 0").groupBy(*by).agg(
        F.max("P").alias("n_actives"), F.max("N").alias("n_inactives"),
        F.sum(F.col("pos") * (n - F.col("cum_neg") + F.col("neg") / 2) / p / n).alias("auc_roc"),
        F.sum((_magnified(fpr, croc_alpha) - _magnified(fpr0, croc_alpha)) * (tpr + tpr0) / 2).alias("auc_croc"),
        F.sum(F.col("pos") * weight).alias("_w"),
    )
    ap, all_ = F.col("n_actives"), F.col("n_actives") + F.col("n_inactives")
    ra = ap / all_
    rie = F.col("_w") / ap / ((1 / all_) * (1 - exp(-a)) / (F.exp(F.lit(a) / all_) - 1))
    bedroc = rie * ra * F.sinh(F.lit(a / 2)) / (F.cosh(F.lit(a / 2)) - F.cosh(F.lit(a / 2) - ra * a)) + 1 / (1 - F.exp((1 - ra) * a))
    scored = sums.withColumn("auc_bedroc", bedroc).drop("_w")
    one_class = b.where("P = 0 or N = 0").groupBy(*by).agg(F.max("P").alias("n_actives"), F.max("N").alias("n_inactives"))
    return scored.unionByName(one_class, allowMissingColumns=True)


def confusion(df: DataFrame, predicted: str, label: str, by: list[str]) -> DataFrame:
    """Confusion counts and rates, likelihood ratios, DOR and markedness; a rate over nothing is null."""
    y, p = F.col(label), F.col(predicted)
    c = df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y != 1) & (p != 1)).alias("tn"), F.count_if((y == 1) & (p != 1)).alias("fn"),
    )
    for name, x, rest in (("tpr", "tp", "fn"), ("fpr", "fp", "tn"), ("tnr", "tn", "fp"), ("fnr", "fn", "tp"), ("ppv", "tp", "fp"), ("npv", "tn", "fn")):
        c = c.withColumn(name, F.try_divide(F.col(x), F.col(x) + F.col(rest)))
    c = c.withColumn("lr_plus", F.try_divide(F.col("tpr"), F.col("fpr"))).withColumn("lr_minus", F.try_divide(F.col("fnr"), F.col("tnr")))
    return c.withColumn("dor", F.try_divide(F.col("lr_plus"), F.col("lr_minus"))).withColumn("mk", F.col("ppv") + F.col("npv") - 1)


def enrichment_factor(df: DataFrame, score: str, label: str, by: list[str], percent: float) -> DataFrame:
    """by..., n_selected, hits, norm_ef = hits/selected, ef = norm_ef/(actives/all) among the best ``percent`` of the rows.

    The selection holds percent x n rows (rounded down; groups in which that is none have no row) and the rest of the
    last block of tied scores.
    """
    b = score_blocks(df, score, label, by)
    n, upto = F.col("P") + F.col("N"), F.col("cum_pos") + F.col("cum_neg")
    want = F.floor(n * (percent / 100))
    first = b.where((upto >= want) & (upto - F.col("pos") - F.col("neg") < want) & (want > 0) & (F.col("P") > 0))
    hit = F.col("cum_pos") / upto
    return first.select(*by, upto.alias("n_selected"), F.col("cum_pos").alias("hits"), hit.alias("norm_ef"), (hit / (F.col("P") / n)).alias("ef"))


def selected(df: DataFrame, score: str, label: str, by: list[str], percent: float | None = None, most: int = 0) -> DataFrame:
    """The rows enrichment_factor selects; without percent the best ``most`` rows and those tied with the last of them."""
    b = score_blocks(df, score, label, by)
    n, upto = F.col("P") + F.col("N"), F.col("cum_pos") + F.col("cum_neg")
    want = F.lit(most) if percent is None else F.floor(n * (percent / 100))
    limit = b.where((upto >= want) & (upto - F.col("pos") - F.col("neg") < want)).select(*by, F.col("_s").alias("_limit"))
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return null_safe_join(rows, limit, by).where(F.col(score) <= F.col("_limit")).drop("_limit")


def scaffold_enrichment(df: DataFrame, score: str, label: str, scaffold: str, by: list[str], percent: float) -> DataFrame:
    """Distinct scaffolds of actives among the selected rows, against all distinct scaffolds of actives."""
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.count_distinct(F.when(F.col(label) == 1, F.col(scaffold))).alias(name))

    both = null_safe_join(count(df, "scaffolds"), count(selected(df, score, label, by, percent), "selected_scaffolds"), by, "left")
    return both.withColumn("share", F.try_divide(F.coalesce("selected_scaffolds", F.lit(0)), F.col("scaffolds")))


def actives_in_top(df: DataFrame, score: str, label: str, name: str, by: list[str], most: int) -> DataFrame:
    """Active rows among the best ``most``, with the whole last tie block: by..., name, score."""
    return selected(df, score, label, by, most=most).where(F.col(label) == 1).select(*by, name, score)
