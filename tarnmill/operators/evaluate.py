"""Measures of corpora, labels, similarity, retrieval and workload."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions.columns import s_curve


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, n_distinct: one pass for all columns."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{k}") for k, c in enumerate(columns)], *[F.countDistinct(c).alias(f"distinct_{k}") for k, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.coalesce(f"null_{k}", F.lit(0)).alias("n_null"), F.col(f"distinct_{k}").alias("n_distinct")) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def percentiles(x: str, points: list[int]) -> list[Column]:
    """Exact, interpolated percentiles as p05, p50 ..."""
    return [F.expr(f"percentile({x}, {p / 100})").alias(f"p{p:02d}") for p in points]


def distribution(df: DataFrame, x: str, by: list[str] | None = None, points: list[int] | None = None) -> DataFrame:
    """n, mean, std (of the population), min, max and percentiles, overall or by group."""
    stats = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *percentiles(x, points or [5, 25, 50, 75, 90, 95, 99])]
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def is_upper(x: Column) -> Column:
    """A cased letter occurs, and none is lower case."""
    return (x == F.upper(x)) & (F.lower(x) != F.upper(x))


def counts_of(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of the values by row, 0 where there are none, and their total."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in an order that ends with all other columns, so the choice is one."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *rest))).where("_rn = 1").drop("_rn")


def share_of_total(df: DataFrame, x: str, out: str = "share_pct") -> DataFrame:
    """Percent of the sum (of 1 at least, so that nothing divides by 0)."""
    whole = df.agg(F.greatest(F.coalesce(F.sum(x), F.lit(0)), F.lit(1)).alias("_whole"))
    return df.crossJoin(F.broadcast(whole)).withColumn(out, F.round(100.0 * F.col(x) / F.col("_whole"), 2)).drop("_whole")


def pair_hygiene(pairs: DataFrame, notices: DataFrame, id_col: str) -> DataFrame:
    """Self pairs, repeated pairs, reversed pairs, and pairs with an unknown notice, as counts."""
    ids = notices.select(id_col).distinct()
    a, b = ids.select(F.col(id_col).alias("notice_id_a"), F.lit(1).alias("_a")), ids.select(F.col(id_col).alias("notice_id_b"), F.lit(1).alias("_b"))
    missing = pairs.join(a, "notice_id_a", "left").join(b, "notice_id_b", "left").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("notice_id_a") == F.col("notice_id_b")).cast("long")).alias("self_pairs"), F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")).alias("missing_pairs"))
    kinds = pairs.groupBy("notice_id_a", "notice_id_b").agg(F.count(F.lit(1)).alias("n"))
    again = kinds.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"))
    both = kinds.where("notice_id_a <> notice_id_b").groupBy(F.least("notice_id_a", "notice_id_b").alias("x"), F.greatest("notice_id_a", "notice_id_b").alias("y")).agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    return missing.crossJoin(again).crossJoin(both.agg(F.count(F.lit(1)).alias("reversed_pairs")))


def label_deltas(pairs: DataFrame, deltas: list[str]) -> DataFrame:
    """Of each label: mean, median, p95 and max of each delta (nulls left out)."""
    aggs = [f(d).alias(f"{name}_{d}") for d in deltas for name, f in (("mean", F.avg), ("median", F.median), ("max", F.max))]
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), *aggs, *[F.expr(f"percentile({d}, 0.95)").alias(f"p95_{d}") for d in deltas])


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by Mann and Whitney; ties count one half.

    Scores are counted first; distinct scores are dealt by ranges, and each range adds what the ranges before hold.
    """
    return auc_of(df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q")))


def auc_of(by: DataFrame) -> DataFrame:
    """The same from counts: s (each score once), p and q (its positives and negatives)."""
    from tarnmill.runtime import materialise

    dealt = materialise(by.repartitionByRange("s").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum("q").alias("_q"))
    earlier = sizes.select("_part", F.coalesce(F.sum("_q").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("q").over(Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = dealt.withColumn("_within", within).join(F.broadcast(earlier), "_part").withColumn("w", F.col("p") * (F.col("_before") + F.col("_within") + F.col("q") / 2.0))  # one row a partition
    return won.agg((F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def estimator_error(df: DataFrame, estimated: str, exact: str, within: float = 0.05) -> DataFrame:
    """mae, rmse, max_error, pct_within of an estimator."""
    e = F.abs(F.col(estimated) - F.col(exact))
    return df.agg(F.count(F.lit(1)).alias("pairs"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"), (100.0 * F.avg((e <= within).cast("double"))).alias("pct_within"))


def tenth_buckets(df: DataFrame, x: str, value: Column, out: str) -> DataFrame:
    """bucket 0 to 9 of width 0.1 (the last is closed), n and a value; empty buckets too."""
    own = df.groupBy(F.least(F.floor(F.col(x) * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), value.alias(out))
    spine = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), out)


def sample_size(z: float = 1.96, margin: float = 0.05) -> int:
    """Hashes for an error of at most the margin (normal approximation at the worst similarity)."""
    return math.ceil((z * 0.5 / margin) ** 2)


def chebyshev_size(margin: float = 0.05, failure: float = 0.05) -> int:
    return math.ceil(round(0.25 / (margin**2 * failure), 9))


def retrieval_sweep(labelled: DataFrame, found: dict[tuple[int, int], DataFrame]) -> DataFrame:
    """For each (bands, rows): recall of true pairs, exposure of others, and the risk of both.

    labelled: id_a, id_b, same (boolean). found: candidate pairs (id_a < id_b) of each configuration.
    """
    parts = []
    for (b, r), pairs in found.items():
        hit = labelled.join(pairs.select("id_a", "id_b").withColumn("_hit", F.lit(1)), ["id_a", "id_b"], "left")
        same, got = F.col("same"), F.col("_hit").isNotNull()
        counts = hit.agg(*[F.coalesce(F.sum((c).cast("long")), F.lit(0)).alias(n) for n, c in (("true_pairs", same), ("true_found", same & got), ("other_pairs", ~same), ("other_found", ~same & got))])
        parts.append(counts.select(F.lit(b).alias("bands"), F.lit(r).alias("rows"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return retrieval_measures(out)


def retrieval_measures(counts: DataFrame) -> DataFrame:
    """Counts (true_pairs, true_found, other_pairs, other_found) with recall, exposure and risk."""
    lost = F.col("true_pairs") - F.col("true_found")
    return counts.withColumns({"recall": F.col("true_found") / F.greatest("true_pairs", F.lit(1)), "exposure": F.col("other_found") / F.greatest("other_pairs", F.lit(1)), "risk": lost * 1.0 + 0.01 * F.col("other_found") * 50})


def operating_point(sweep: DataFrame, recall: float = 0.95) -> DataFrame:
    """The first configuration (most bands first) whose recall suffices, else the one of highest recall."""
    return sweep.orderBy(F.desc((F.col("recall") >= recall).cast("int")), F.when(F.col("recall") >= recall, -F.col("bands")), F.desc("recall"), F.desc("bands")).limit(1)


def ranked(df: DataFrame, x: str, tie: str) -> DataFrame:
    """_at: place in the descending order of x, then tie, without one sorted task.

    Ranges of x are dealt to partitions; a row's place is its place there plus the rows of the ranges before.
    """
    from tarnmill.runtime import materialise

    dealt = materialise(df.repartitionByRange(F.desc(x), F.asc(tie)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_work"))
    own = Window.partitionBy("_part").orderBy(F.desc(x), F.asc(tie))
    rows = dealt.join(F.broadcast(starts), "_part")  # one row per partition
    return rows.withColumns({"_at": F.col("_before") + F.row_number().over(own), "_cum": F.col("_work") + F.sum(x).over(own.rowsBetween(Window.unboundedPreceding, 0))}).drop("_part", "_before", "_work")


def workload(df: DataFrame, x: str, id_col: str) -> DataFrame:
    """Distribution of work per notice and the share of the heaviest 1, 5, 10 and 20 percent."""
    rows = ranked(df.select(id_col, x), x, id_col)
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.sum(x), F.lit(1)).alias("_w"))
    placed = rows.crossJoin(F.broadcast(whole))
    tops = [F.round(100.0 * F.sum(F.when(F.col("_at") <= F.ceil(F.col("_n") * F.lit(p) / 100), F.col(x)).otherwise(0)) / F.max("_w"), 2).alias(f"top_{p}_pct_work") for p in (1, 5, 10, 20)]
    return placed.agg(F.count(F.lit(1)).alias("total_notices"), F.sum(x).alias("total_comparisons"), F.round(F.avg(x), 1).alias("mean"), *percentiles(x, [50, 90, 95, 99]), F.max(x).alias("max"), *tops)


def workload_by_portal(df: DataFrame, x: str, portal: str) -> DataFrame:
    by = df.groupBy(F.coalesce(portal, F.lit("UNKNOWN")).alias("portal_id")).agg(F.count(F.lit(1)).alias("notices"), F.round(F.avg(x), 1).alias("mean_candidates"), F.median(x).alias("median_candidates"), F.expr(f"percentile({x}, 0.95)").alias("p95_candidates"), F.max(x).alias("max_candidates"), F.sum(x).alias("total_candidate_work"))
    return share_of_total(by, "total_candidate_work", "pct_of_total_work")


def lorenz(df: DataFrame, x: str, id_col: str) -> DataFrame:
    """place (heaviest first), work, cumulative percent of the work."""
    rows = ranked(df.select(id_col, x), x, id_col)
    whole = rows.agg(F.greatest(F.sum(x), F.lit(1)).alias("_w"))
    return rows.crossJoin(F.broadcast(whole)).select(F.col("_at").alias("place"), F.col(x).alias("work"), F.round(100.0 * F.col("_cum") / F.col("_w"), 6).alias("cumulative_pct"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change: the signed percent as text, N/A where before is not positive."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    change = F.when(F.col("before") > 0, F.format_string("%+.2f%%", 100.0 * (F.col("after") - F.col("before")) / F.col("before"))).otherwise("N/A")
    return both.withColumn("change", change)


def s_curve_table(spark, configurations: list[tuple[int, int]], steps: int = 20) -> DataFrame:
    s = spark.range(steps + 1).select((F.col("id") / steps).alias("similarity"))
    parts = [s.select(F.lit(b).alias("bands"), F.lit(r).alias("rows"), "similarity", F.round(s_curve("similarity", b, r), 9).alias("probability")) for b, r in configurations]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
