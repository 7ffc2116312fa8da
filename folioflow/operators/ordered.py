"""Window computations over one long sequence per key, spread over tasks.

A plain window sends all rows of a key to one task.  Here a key's rows are dealt to
blocks by their order, which must be a number; each block is handled by itself, and only one row
per block is carried to the next.  ``WIDTH`` is how many orders a block spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _blocked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / width).cast("bigint"))


def running_sums(df: DataFrame, key: str, order: str, values: dict[str, Column], inclusive: bool = False, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of its column over the earlier rows of the key (its own too if inclusive): one grouping and one join for all.

    Null values count as 0.  ``ties`` are further columns that order rows of equal order.
    """
    names = list(values)
    rows = _blocked(df.select("*", *(F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in values.items())), order, width)
    sums = rows.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names))
    over = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_k", "_b", *(F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_base_{n}") for n in names))
    inner = Window.partitionBy(key, "_block").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = rows.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)).alias(f"_in_{n}") for n in names))
    both = summed.join(base, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    return both.select(*df.columns, *((F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in names))


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, ties: list[str] | None = None, inclusive: bool = False, width: int = WIDTH) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, key, order, {name: value}, inclusive, ties, width)


def previous_row(df: DataFrame, key: str, order: str, columns: list[str], prefix: str = "prev_", width: int = WIDTH) -> DataFrame:
    """``df`` with the ``columns`` of the row before it in its key, null for the first row of a key."""
    rows = _blocked(df, order, width).withColumn("_row", F.struct(order, *[c for c in columns if c != order]))
    inner = Window.partitionBy(key, "_block").orderBy(order)
    lasts = rows.groupBy(F.col(key).alias("_k"), F.col("_block").alias("_b")).agg(F.max_by("_row", order).alias("_last"))
    carried = lasts.select("_k", "_b", F.lag("_last").over(Window.partitionBy("_k").orderBy("_b")).alias("_carry"))
    joined = rows.withColumn("_lag", F.lag("_row").over(inner)).join(carried, (F.col(key) == F.col("_k")) & (F.col("_block") == F.col("_b")))
    before = F.coalesce("_lag", "_carry")
    return joined.select(*df.columns, *(before[c].alias(prefix + c) for c in columns))


def next_row(df: DataFrame, key: str, order: str, columns: list[str], prefix: str = "next_", width: int = WIDTH) -> DataFrame:
    """``df`` with the ``columns`` of the row after it in its key, null for the last."""
    return previous_row(df.withColumn("_neg", -F.col(order)), key, "_neg", columns, prefix, width).drop("_neg")


def asof_forward(left: DataFrame, right: DataFrame, key: str, order: str, take: str, width: int = WIDTH) -> DataFrame:
    """``left`` with ``take`` of the first row of ``right`` at or after it in its key; null where there is none.

    Of rows of ``right`` with equal order the least ``take`` counts.  Both are merged by key and
    order and scanned block by block; only one row per block is carried back, so a long key is spread.
    """
    fields = [F.struct(*[F.col(c) for c in left.columns]).alias("_left")]
    a = left.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.lit(0).alias("_side"), *fields, F.lit(None).cast(right.schema[take].dataType).alias("_take"))
    b = right.groupBy(F.col(key).alias("_k"), F.col(order).alias("_o")).agg(F.min(take).alias("_take"))
    b = b.select("_k", "_o", F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_take")
    rows = a.unionByName(b).withColumn("_b", F.floor(F.col("_o") / width).cast("bigint"))
    inner = Window.partitionBy("_k", "_b").orderBy("_o", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = rows.groupBy("_k", "_b").agg(F.min_by("_take", F.when(F.col("_side") == 1, F.col("_o"))).alias("_first"))
    later = Window.partitionBy("_k").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = firsts.select("_k", "_b", F.first("_first", ignorenulls=True).over(later).alias("_carry"))
    seen = rows.withColumn("_in", F.first("_take", ignorenulls=True).over(inner)).where("_side = 0")
    return seen.join(carry, ["_k", "_b"], "left").select("_left.*", F.coalesce("_in", "_carry").alias(take))


def size_rank(df: DataFrame, key: str, size: str, order: str, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``name``: the place, from 0, of each row of a key by (size, order) (ORD01).

    Smaller sizes are counted over the histogram of sizes, equal ones by blocks of orders, so no
    task sorts a whole key.  Null sizes come last.
    """
    rows = _blocked(df, order, width).withColumn("_none", F.col(size).isNull().cast("int"))
    same = ["_none", size]
    histogram = rows.groupBy(key, *same).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(Window.partitionBy(key).orderBy(*same).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(key, *same, "_block").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key, *same).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    a = histogram.select(F.col(key).alias("_k"), F.col("_none").alias("_kn"), F.col(size).alias("_ks"), F.coalesce(below, F.lit(0)).alias("_below"))
    b = blocks.select(F.col(key).alias("_k"), F.col("_none").alias("_kn"), F.col(size).alias("_ks"), F.col("_block").alias("_kb"), F.coalesce(before, F.lit(0)).alias("_before"))
    base = a.join(b, (a["_k"] == b["_k"]) & (a["_kn"] == b["_kn"]) & a["_ks"].eqNullSafe(b["_ks"])).select(b["_k"], b["_kn"], b["_ks"], "_kb", (F.col("_below") + F.col("_before")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(key, *same, "_block").orderBy(order)) - 1
    ranked = rows.withColumn("_in", inner)
    on = (F.col(key) == F.col("_k")) & (F.col("_none") == F.col("_kn")) & F.col(size).eqNullSafe(F.col("_ks")) & (F.col("_block") == F.col("_kb"))
    return ranked.join(base, on).select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))
