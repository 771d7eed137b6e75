"""Cutoff per source that keeps a target fraction: cutting planes on the pinball loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posemill.llm.hot import hot_limit, join_groups
from posemill.runtime import Scratch

_BIG = 1.7e308
_HALVINGS = 7


def _probes(lo: Column, hi: Column, crossing: Column) -> Column:
    """Thresholds in [lo, hi): lo itself, the planes' crossing, and points that close in on it from both sides.

    lo is always among them, so every pass takes at least the smallest value out of the bracket.
    """
    half = hi / 2 - lo / 2
    c = F.when(crossing.isNotNull() & ~F.isnan(crossing), F.greatest(lo, F.least(hi, crossing))).otherwise(lo + half)
    steps = [half / float(2**j) for j in range(_HALVINGS)]
    points = F.array(lo, lo + half, c, *[c - s for s in steps], *[c + s for s in steps])
    return F.array_sort(F.array_distinct(F.filter(points, lambda p: (p >= lo) & (p < hi) & ~F.isnan(p))))


def keep_fraction_cutoffs(
    records: DataFrame, targets: DataFrame, by: list[str], score: str, share: str, whole: int = 1000,
    many_sources: int = 50_000, shrink_rows: int = 1_000_000,
) -> DataFrame:
    """Per source the smallest score at which ``whole`` x (records at or below it) >= share x (its records).

    The rank-k score minimises the convex pinball loss sum(tau*(x-c)+ + (1-tau)*(c-x)+) with tau=(k-1/2)/n. All
    sources advance together: a pass evaluates loss and subgradient at a few thresholds per source from counts and
    sums (pre-aggregated map-side, so a source with a third of all rows costs no more than another), the supporting
    lines at the bracket's ends cross at the next threshold, and the bracket snaps to scores that occur. A source is
    finished when its rank is an end of the bracket, which makes the cutoff exact. Once fewer than half of more than ``shrink_rows``
    rows lie in open brackets, only those are kept for the next passes.

    Defined cases: records with null/NaN score or a null key do not count; sources without a target, and targets
    without records or with a null share, give no row; a share of 0 keeps the smallest score, a share above ``whole``
    all; ties at the cutoff are all kept; infinite scores are ordered like numbers. Returns by..., n_records, share,
    cutoff, n_kept. Other columns of either table are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "cutoffs")
    x = F.col("_x")
    key_set = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    rows = scratch.cut(
        records.select(*by, F.col(score).cast("double").alias("_x")).where(key_set & x.isNotNull() & ~F.isnan(x))
        .select(*by, (x + F.lit(0.0)).alias("_x"))
    )
    clipped = F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), x))
    wanted = targets.select(*by, F.col(share).alias("_share")).where(key_set & F.col("_share").isNotNull())
    wanted = wanted.groupBy(*by).agg(F.max("_share").alias("_share"))
    n, k = F.col("_n"), F.col("_k")
    state = scratch.cut(
        rows.groupBy(*by)
        .agg(
            F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
            F.sum(clipped).alias("_sum"),
        )
        .join(wanted, by)
        .withColumn("_k", F.least(n, F.greatest(F.lit(1), F.ceil(F.col("_share") * n / F.lit(whole)))).cast("long"))
        .select(
            *by, "_share", "_n", "_k", "_sum", "_lo", "_hi", F.lit(0).cast("long").alias("_under"),
            F.col("_n").alias("_upto"), F.lit(0.0).alias("_sum_under"), F.col("_sum").alias("_sum_upto"),
            F.when(k == 1, F.col("_lo")).when(k == n, F.col("_hi")).alias("_cutoff"),
        )
        .withColumn("_cutoff", F.coalesce("_cutoff", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))))
    )
    sources, total, most = state.agg(F.count("*"), F.sum("_n"), F.max("_n")).first()
    # a few sources are broadcast whole by Spark; only beside very many do the hot ones need a way of their own
    hot = hot_limit(total) if sources > many_sources and most > hot_limit(total) else None
    seen, held = rows, total or 0  # the rows a pass looks at: all, later only those inside brackets that are open
    inside = F.count_if(F.col("_cutoff").isNull()), F.sum(F.when(F.col("_cutoff").isNull(), F.col("_upto") - F.col("_under")))
    while True:
        unsettled, needed = state.agg(*inside).first()
        if not unsettled:
            break
        if held > shrink_rows and needed < held / 2:
            brackets = state.where("_cutoff is null").select(*by, "_n", "_lo", "_hi")
            fewer = join_groups(seen, brackets, by, "_n", hot).where((x >= F.col("_lo")) & (x <= F.col("_hi"))).select(*by, "_x")
            last, seen, held = seen, scratch.cut(fewer), needed
            if last is not rows:
                scratch.drop(last)
        lo = F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), F.col("_lo")))
        hi = F.greatest(F.lit(-_BIG), F.least(F.lit(_BIG), F.col("_hi")))
        tau = (k - 0.5) / n

        def loss(at: Column, under: Column, total: Column) -> Column:
            return (1 - tau) * (under * at - total) + tau * (F.col("_sum") - total - (n - under) * at)

        slope_lo, slope_hi = F.col("_under") - tau * n, F.col("_upto") - tau * n
        drop = loss(lo, F.col("_under"), F.col("_sum_under")) - loss(hi, F.col("_upto"), F.col("_sum_upto"))
        open_ = state.where("_cutoff is null").withColumn("_crossing", F.try_divide(drop + slope_hi * hi - slope_lo * lo, slope_hi - slope_lo))
        open_ = open_.withColumn("_probes", _probes(lo, hi, F.col("_crossing")))
        bins = (
            join_groups(seen, open_.select(*by, "_n", "_lo", "_hi", "_probes"), by, "_n", hot)
            .where((x >= F.col("_lo")) & (x <= F.col("_hi")))
            .select(*by, "_x", F.size(F.filter("_probes", lambda p: p < x)).alias("_bin"))
            .groupBy(*by, "_bin")
            .agg(F.count("*").alias("_c"), F.sum(clipped).alias("_s"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
        )
        upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        hit = (
            bins.withColumn("_cc", F.sum("_c").over(upto)).withColumn("_cs", F.sum("_s").over(upto))
            .join(open_.drop("_crossing", "_probes", "_lo", "_hi", "_upto", "_sum_upto", "_cutoff"), by)
            .where((F.col("_under") + F.col("_cc") >= k) & (F.col("_under") + F.col("_cc") - F.col("_c") < k))
        )
        under, end = F.col("_under") + F.col("_cc") - F.col("_c"), F.col("_under") + F.col("_cc")
        moved = hit.select(
            *by, "_share", "_n", "_k", "_sum", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"),
            under.alias("_under"), end.alias("_upto"),
            (F.col("_sum_under") + F.col("_cs") - F.col("_s")).alias("_sum_under"),
            (F.col("_sum_under") + F.col("_cs")).alias("_sum_upto"),
            F.when((k == under + 1) | (F.col("_mn") == F.col("_mx")), F.col("_mn")).when(k == end, F.col("_mx")).alias("_cutoff"),
        )
        last, state = state, scratch.cut(state.where("_cutoff is not null").unionByName(moved))
        scratch.drop(last)
    kept = join_groups(rows, state.select(*by, "_n", "_cutoff"), by, "_n", hot).where(x <= F.col("_cutoff")).groupBy(*by).agg(F.count("*").alias("n_kept"))
    return state.join(kept, by).select(
        *by, F.col("_n").alias("n_records"), F.col("_share").alias(share), F.col("_cutoff").alias("cutoff"), "n_kept"
    )


def kept_records(records: DataFrame, cutoffs: DataFrame, by: list[str], score: str) -> DataFrame:
    """The records at or below their source's cutoff; null/NaN scores and unknown sources are left out."""
    name = "_cutoff"
    while name in records.columns:
        name += "_"
    s = F.col(score)
    return records.join(cutoffs.select(*by, F.col("cutoff").alias(name)), by).where(s.isNotNull() & ~F.isnan(s) & (s <= F.col(name))).drop(name)
