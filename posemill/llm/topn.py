"""Top N items of every group by simultaneous bisection of per-group cutoffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posemill.llm.hot import HOT_ROWS, hot_limit, join_groups
from posemill.runtime import Scratch

_BINS = 32
_CHUNK = 7


def _bin(word: Column, lo: Column, hi: Column) -> Column:
    """Section of [lo, hi] that holds word, 0.._BINS-1: five halvings at once. Monotone; lo is in the first, hi in the last."""
    part = F.try_divide(word.cast("double") / 2 - lo.cast("double") / 2, hi.cast("double") / 2 - lo.cast("double") / 2)
    inner = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), F.floor(part * _BINS)))
    return F.when(word <= lo, F.lit(0)).when(word >= hi, F.lit(_BINS - 1)).otherwise(F.coalesce(inner, F.lit(0))).cast("int")


def _common(a: Column, b: Column) -> Column:
    """Number of leading bytes two binary strings share, from their hexadecimal forms."""
    pairs = F.zip_with(F.split(F.hex(a), ""), F.split(F.hex(b), ""), lambda p, q: p.eqNullSafe(q))
    first = F.array_position(pairs, F.lit(False))
    return F.when(first == 0, F.length(a)).otherwise(F.floor((first - 1) / 2)).cast("int")


def _word(c: Column, skip: Column) -> Column:
    """Seven bytes of a string after skip bytes as a number in byte order; the end sorts before any byte."""
    return F.conv(F.rpad(F.hex(F.substr(F.encode(c, "UTF-8"), skip + 1, F.lit(_CHUNK))), 2 * _CHUNK, "0"), 16, 10).cast("long")


def top_n_per_group(rows: DataFrame, by: list[str], score: str, ties: list[str], n: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The n lowest-scored rows of every group, ties broken by the ``ties`` columns in ascending order.

    The order-preserving code of a row is (score, ties..., row number); each group holds a bracket on it. A pass counts
    the rows per section of every bracket at once, accepts the sections that fit wholly, drops those beyond the
    n-th row and shrinks the bracket to the codes that occur in the one section left. All groups with at most n rows
    end in the first pass; later passes see only rows whose section still straddles a cutoff. Nothing is ever sorted
    or gathered by group. Groups with more than max(hot_rows, rows/1000) rows (at most 1000 of them, hence safe to broadcast)
    are counted with map-side aggregation against a broadcast cutoff; the others by a join on the group.

    Defined cases: rows with null/NaN score or a null group key are left out; null ties sort first; rows equal in all
    keys are interchangeable and exactly n are returned; n <= 0 and empty input give no rows; extra columns are
    carried along. Strings order by code point. Strings holding NUL characters order as if cut there.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topn")
    names, given = rows.columns, by
    by = [f"_g{i}" for i in range(len(given))]
    back = [F.col(by[given.index(c)]).alias(c) if c in given else F.col(f"_row.{c}") for c in names]
    payload = [F.col(c) for c in names if c not in given] or [F.lit(None).cast("int").alias("none")]
    key_set = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in given])
    s = F.col(score)
    types = {f.name: f.dataType for f in rows.schema.fields}
    codes = [(s.cast("double") + F.lit(0.0)).alias("_k0")]
    words = ["_k0"]
    for i, t in enumerate(ties, 1):
        c = F.col(t)
        codes.append((F.coalesce(c, F.lit("")) if isinstance(types[t], T.StringType) else F.coalesce(c.cast("long"), F.lit(-(2**62)))).alias(f"_k{i}"))
        words.append(f"_k{i}")
    strings = {f"_k{i}" for i, t in enumerate(ties, 1) if isinstance(types[t], T.StringType)}
    words.append("_uid")
    if n <= 0:
        return rows.where(F.lit(False))
    work = scratch.cut(
        rows.where(key_set & s.isNotNull() & ~F.isnan(s.cast("double"))).select(
            *[F.col(c).alias(g) for c, g in zip(given, by)], F.struct(*payload).alias("_row"), *codes,
            F.monotonically_increasing_id().alias("_uid"),
        )
    )
    stats = scratch.cut(
        work.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_k0").alias("_lo0"), F.max("_k0").alias("_hi0"))
        .withColumn("_need", F.lit(n).cast("long"))
    )
    total, most = stats.agg(F.sum("_n"), F.max("_n")).first()
    limit = hot_limit(total or 0, hot_rows)
    accepted: list[DataFrame] = []
    first = True
    while True:
        phases = ["_k0"] if first else words
        hot = limit if (most or 0) > limit else None

        def with_cuts(cuts: DataFrame, work: DataFrame = work, hot: int | None = hot) -> DataFrame:
            return join_groups(work, cuts, by, "_n", hot)

        def section() -> Column:
            """Section by the first word that differs inside the group's bracket."""
            out = F.lit(0)
            for w in reversed(phases):
                j = w[2:] if w != "_uid" else "u"
                lo, hi = F.col(f"_lo{j}"), F.col(f"_hi{j}")
                if w in strings:
                    skip = F.col(f"_skip{j}")
                    inner = _bin(_word(F.col(w), skip), _word(lo, skip), _word(hi, skip))
                    b = F.when(F.col(w) <= lo, F.lit(0)).when(F.col(w) >= hi, F.lit(_BINS - 1)).otherwise(inner)
                else:
                    b = _bin(F.col(w), lo, hi)
                out = F.when(lo != hi, b).otherwise(out)
            return out

        counted = with_cuts(stats).where("_n > _need").select(*by, section().alias("_bin")).groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        edge = (
            counted.withColumn("_cc", F.sum("_c").over(upto)).join(stats.select(*by, F.col("_need").alias("_want")), by)
            .where((F.col("_cc") >= F.col("_want")) & (F.col("_cc") - F.col("_c") < F.col("_want")))
            .select(*by, F.col("_bin").alias("_edge"), (F.col("_cc") == F.col("_want")).alias("_whole"),
                    (F.col("_want") - F.col("_cc") + F.col("_c")).alias("_rest"))
        )
        cuts = stats.join(edge, by, "left")
        if hot is not None:  # then it is read twice
            cuts = scratch.cut(cuts)
        judged = with_cuts(cuts).withColumn("_bin", section()).where("_n <= _need or _bin <= _edge").withColumn(
            "_open", (F.col("_n") > F.col("_need")) & (F.col("_bin") == F.col("_edge")) & ~F.col("_whole")
        )
        judged = scratch.cut(judged.select(*by, "_row", *words, "_rest", "_open"))
        accepted.append(judged.where("not _open").select(*back))
        scratch.drop(work if first else None, stats, cuts)
        work = judged.where("_open").drop("_open")
        aggs = [F.count("*").alias("_n"), F.max("_rest").alias("_need")]
        for w in words:
            j = w[2:] if w != "_uid" else "u"
            aggs += [F.min(w).alias(f"_lo{j}"), F.max(w).alias(f"_hi{j}")]
        stats = work.groupBy(*by).agg(*aggs)
        for w in strings:
            j = w[2:]
            stats = stats.withColumn(f"_skip{j}", _common(F.encode(f"_lo{j}", "UTF-8"), F.encode(f"_hi{j}", "UTF-8")))
        stats = scratch.cut(stats)
        work = work.drop("_rest")
        first = False
        left, most = stats.agg(F.count("*"), F.max("_n")).first()
        if not left:
            return reduce(DataFrame.unionByName, accepted)
