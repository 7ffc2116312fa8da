"""Aggregates over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_of_counts(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """(keys, median): the upper median of values given with their counts (AGG03).

    The windows run over the different values of a key, not over its rows.
    """
    w = Window.partitionBy(*keys)
    upto = F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.where(F.col(value).isNotNull()).select(*keys, value, upto.alias("_u"), F.sum(n).over(w).alias("_a"))
    return rows.where(F.col("_u") > F.floor(F.col("_a") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle value, the upper of two; nulls don't count."""
    return median_of_counts(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, "_n")


def progress(total: Column, done: Column, elapsed: Column, baseline: Column) -> Column:
    """Seconds left at the speed so far, null where nothing can be told (AGG12)."""
    return F.when((total > done) & (done > baseline) & (elapsed > 0), (total - done) * elapsed / (done - baseline))


def workers(memory_gb: Column, override: Column | None = None) -> Column:
    """Workers that fit: 6.5 GB each beside 2, one to three (AGG13)."""
    fit = F.greatest(F.lit(1), F.least(F.lit(3), F.floor((memory_gb - 2) / 6.5).cast("int")))
    return fit if override is None else F.coalesce(override, fit)


def stratified_total(rows: DataFrame, keys: list[str], place: str, of: str, value: str, strata: int = 4) -> DataFrame:
    """(keys, estimate): mean of each stratum of places times its width, an empty one by the mean of all (AGG17).

    ``place`` runs from 0 below ``of``, the number of places of the key.
    """
    bound = lambda i: F.floor(F.col("_n") * i / strata)
    ends = rows.groupBy(*keys).agg(F.max(of).alias("_n"), F.avg(value).alias("_all"))
    cells = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(strata - 1))).alias("_i")).select("*", bound(F.col("_i")).alias("_lo"), bound(F.col("_i") + 1).alias("_hi"))
    at = rows.join(ends.select(*keys, "_n"), keys).where((F.col(place) >= 0) & (F.col(place) < F.col("_n")))
    # the stratum of a place is the last whose lower bound isn't above it
    i = F.greatest(*(F.when(F.col(place) >= bound(F.lit(k)), k).otherwise(0) for k in range(strata)))
    means = at.withColumn("_i", i).groupBy(*keys, "_i").agg(F.avg(value).alias("_mean"))
    joined = cells.join(means, [*keys, "_i"], "left")
    return joined.groupBy(*keys).agg(F.sum(F.coalesce("_mean", "_all") * (F.col("_hi") - F.col("_lo"))).alias("estimate"))


def outliers(rows: DataFrame, keys: list[str], value: str, times: float = 5.0) -> DataFrame:
    """(keys, rows, outliers, total, cleaned): values above so many medians, and the total with them at the median (AGG18)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("*", upto.alias("_u"), F.sum("_n").over(w).alias("_a"))
    low, high = F.floor((F.col("_a") - 1) / 2), F.floor(F.col("_a") / 2)
    mids = ranked.groupBy(*keys).agg(F.min(F.when(F.col("_u") > low, F.col(value))).alias("_l"), F.min(F.when(F.col("_u") > high, F.col(value))).alias("_h"))
    joined = counts.join(mids.select(*keys, ((F.col("_l") + F.col("_h")) / 2).alias("_m")), keys)
    far = F.col(value) > F.lit(times) * F.col("_m")
    return joined.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(far, F.col("_n"))), F.lit(0)).alias("outliers"),
        F.sum(F.col(value) * F.col("_n")).alias("total"),
        F.sum(F.when(far, F.col("_m")).otherwise(F.col(value)) * F.col("_n")).alias("cleaned"),
    )


def label_speed(ratio: Column) -> Column:
    """SLOWER above 1.02, FASTER below 0.98, else SAME (AGG05)."""
    return F.when(ratio > 1.02, "SLOWER").when(ratio < 0.98, "FASTER").otherwise("SAME")


def cut_total(df: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """Rows by key (AGG01)."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))
