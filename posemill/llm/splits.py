"""Train, validation and test splits that keep groups of records together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posemill.llm.hot import hot_limit, join_groups
from posemill.runtime import Scratch

_BUCKET_GROUPS = 50_000
_MEMORY_BITS = 1 << 29


def _reach(sizes: dict[int, int], goal: float) -> dict[int, int]:
    """How many of each size to take so that their total is the nearest to goal, by a bitset over totals (bit t: some subset
    has total t) that takes in each size with its multiplicity by binary splitting, smallest sizes first; walking back
    over the bitsets kept per size takes as few of the large ones as will do."""
    goal = min(goal, sum(s * m for s, m in sizes.items()))
    top = int(2 * goal) + 2
    mask = (1 << (top + 1)) - 1
    order = sorted(sizes)
    before, bits = [], 1
    for s in order:
        before.append(bits)
        left, step = sizes[s], 1
        while left and s * step <= top:
            step = min(step, left)
            bits |= (bits << (s * step)) & mask
            left -= step
            step *= 2
        # multiplicities cut off above only reach totals beyond top
    at = next(t for d in range(top + 1) for t in (int(goal) - d, int(goal) + 1 + d) if 0 <= t <= top and bits >> t & 1)
    taken: dict[int, int] = {}
    for s, prior in zip(reversed(order), reversed(before), strict=True):
        c = 0
        while not prior >> (at - c * s) & 1:
            c += 1
        if c:
            taken[s] = c
            at -= c * s
    return taken


def closest_subset(sizes: dict[int, int], target: float, memory_bits: int = _MEMORY_BITS) -> dict[int, int]:
    """How many groups of each size to take so that their total is near to target, all sizes taking part in proportion.

    Each size first gives its share, rounded down; what is then owed, less than one group of each size, is met by subset
    sums (_reach). If that misses the target, the shares are lowered step by step, to nothing at last, which makes
    the total as near to target as any subset's. While the bitsets of all sizes would not fit into ``memory_bits``, the
    largest sizes are settled one after the other instead: a size gives one more group as soon as it and the larger ones owe that
    much; what stays owed is less than one of its groups and goes to the smaller sizes. Totals are always counted in
    records, never in larger units. Sizes with multiplicity are at most sqrt(2 x records) many, so the table is
    small however many groups there are.
    """
    total = sum(s * m for s, m in sizes.items())
    if target <= 0 or not total:
        return {}
    target = min(target, total)
    best: dict[int, int] = {}
    missed = target
    back = 0
    while True:
        base = {s: max(0, int(m * target / total) - back) for s, m in sizes.items()}
        owed = target - sum(s * c for s, c in base.items())
        rest = sorted(s for s in sizes if sizes[s] > base[s])
        if back and 2 * owed * len(rest) > memory_bits:
            return best  # lower shares do not fit any more
        carried = 0.0
        while rest and 2 * owed * len(rest) > memory_bits:
            s = rest.pop()
            carried += s * (sizes[s] * target / total - base[s])
            more = min(sizes[s] - base[s], int(carried // s))
            base[s] += more
            carried -= s * more
            owed = carried + sum(x * (sizes[x] * target / total - base[x]) for x in rest)
        for s, c in (_reach({s: sizes[s] - base[s] for s in rest}, owed) if rest and owed > 0 else {}).items():
            base[s] += c
        off = abs(target - sum(s * c for s, c in base.items()))
        if off < missed or not best:
            best, missed = {s: c for s, c in base.items() if c}, off
        if missed <= 0.5 or back > max(m * target / total for m in sizes.values()):
            return best
        back = 2 * back + 1


def split_plan(sizes: dict[str, dict[int, tuple[int, float]]], shares: dict[str, float]) -> list[tuple[str, int, str, int, int]]:
    """(stratum, size, split, first, last) ranges of group ranks; ranks beyond all ranges belong to the first split.

    sizes: per stratum and size the number of groups and the mean number of positive records in one. Mixed strata come
    first; the positive and the other records they owe a split, or gave it too many of, are made up from the
    strata that hold only one kind.
    """
    plan = []
    others = sorted(list(shares)[1:], key=shares.get)
    owed = {kind: dict.fromkeys(others, 0.0) for kind in ("all", "none")}
    for stratum in sorted(sizes, key=lambda x: (x in owed, x)):
        groups = sizes[stratum]
        left = {s: m for s, (m, _) in groups.items()}
        total = sum(s * m for s, m in left.items())
        positive = sum(m * p for m, p in groups.values())
        used = dict.fromkeys(left, 0)
        for split in others:
            target = shares[split] * total + (owed[stratum][split] if stratum in owed else 0.0)
            taken = closest_subset({s: m for s, m in left.items() if m}, target)
            for s, c in taken.items():
                plan.append((stratum, s, split, used[s] + 1, used[s] + c))
                used[s] += c
                left[s] -= c
            if stratum not in owed:
                got = sum(c * groups[s][1] for s, c in taken.items())
                owed["all"][split] += shares[split] * positive - got
                owed["none"][split] += shares[split] * (total - positive) - (sum(s * c for s, c in taken.items()) - got)
    return plan


def assign_splits(records: DataFrame, record_id: str, group: str, label: str, shares: dict[str, float], seed: int = 0, bucket_groups: int = _BUCKET_GROUPS) -> DataFrame:
    """Split of every record; all records of a group share one. Returns record_id, split.

    Groups fall into strata by their share of positive labels (none labelled, none, quarters, all), and each stratum is
    divided in the given proportions on its own, which keeps the label balanced. Only the histogram of group sizes per
    stratum reaches the driver; closest_subset picks how many groups of each size every split takes. Which ones is
    settled by rank in hash order; ranks come from counts per hash bucket, of which there are so many that one holds about
    ``bucket_groups`` groups, so a size that most groups have (singletons) is ranked in parts. Records of a hot group meet
    its split in a broadcast of the hot groups alone.

    Defined cases: a record with a null group is a group of its own; null labels count in sizes only; groups too large
    for a small split stay in the first one named in shares; an empty table gives no rows. Other columns are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "splits")
    rows = records.select(F.col(record_id).alias("r"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("r"), F.col(record_id).cast("string"))).alias("g"), F.col(label).cast("double").alias("y"))
    share = F.try_divide(F.sum("y"), F.count("y"))
    groups = scratch.cut(
        rows.groupBy("g").agg(
            F.count("*").alias("size"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("positive"),
            F.when(F.count("y") == 0, "unlabelled").when(share == 0, "none").when(share == 1, "all")
            .otherwise(F.concat(F.lit("quarter"), F.floor(share * 4).cast("string"))).alias("stratum"),
        ).withColumn("h", F.xxhash64("g", F.lit(seed)))
    )
    n_groups, total, most = groups.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    buckets = 1 + n_groups // bucket_groups
    groups = groups.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = scratch.cut(groups.groupBy("stratum", "size", "bucket").agg(F.count("*").alias("c"), F.sum("positive").alias("p")))
    sizes: dict[str, dict[int, tuple[int, float]]] = {}
    for r in counts.groupBy("stratum", "size").agg(F.sum("c").alias("c"), F.sum("p").alias("p")).toLocalIterator():
        sizes.setdefault(r["stratum"], {})[r["size"]] = (r["c"], r["p"] / r["c"])
    plan = split_plan(sizes, shares)
    offset = counts.withColumn("before", F.sum("c").over(Window.partitionBy("stratum", "size").orderBy("bucket")) - F.col("c")).drop("c", "p")
    ranked = groups.join(offset, ["stratum", "size", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("stratum", "size", "bucket").orderBy("h", "g"))
    )
    ranges = spark.createDataFrame(plan, "stratum string, size long, split string, first long, last long")
    ranges = ranges.groupBy("stratum", "size").agg(F.collect_list(F.struct("split", "first", "last")).alias("ranges"))
    inside = F.filter("ranges", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") <= x["last"]))
    chosen = ranked.join(ranges, ["stratum", "size"], "left").select("g", "size", F.coalesce(F.get(inside, F.lit(0))["split"], F.lit(next(iter(shares)))).alias("split"))
    hot = hot_limit(total or 0)
    return join_groups(rows.select("r", "g"), chosen, ["g"], "size", hot if (most or 0) > hot else None).select(F.col("r").alias(record_id), "split")
