"""What is still to do, in which batches and parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, LongType

MAX_BATCH, BUDGET = 12, 1300
CAP = 1000


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def todo(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the plan that nothing is done for (JON01)."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def missing(plan: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """(key, missing, first): how many rows of a key aren't done, and the first (JON02)."""
    return todo(plan, done, [key, order]).groupBy(key).agg(F.count("*").alias("missing"), F.min(order).alias("first"))


def shard(order: Column, shards: int) -> Column:
    """The shard of a row by its order (PLN07)."""
    return F.pmod(order, F.lit(shards))


def batches(items: DataFrame, key: str, order: str, size: str, max_batch: int = MAX_BATCH, budget: int = BUDGET) -> DataFrame:
    """``items`` with place and batch_no: ascending by size, a batch closed at max_batch rows or when
    rows times the largest size would pass the budget; a larger item is alone (FLD02, ORD01).

    The batches depend only on how many items of each size there are, so the fold runs over that
    histogram (as long as there are different sizes), and each item finds its batch from its rank among the equal ones.
    Ranks are taken over blocks of 4096 orders.  Null sizes count as 0.
    """
    rows = items.withColumn("_s", F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    histogram = rows.groupBy(key, "_s").agg(F.count("*").alias("_c"))

    def fold(s: Column, x: Column) -> Column:
        room = F.greatest(F.lit(1), F.least(F.lit(max_batch), F.floor(F.lit(budget) / F.greatest(x["s"], F.lit(1)))))
        # the open batch has s.n rows; it takes equal items up to ``room``
        rest = F.greatest(F.lit(0), room - s["n"])
        first = F.least(rest, x["c"])
        left = x["c"] - first
        full = F.ceil(left / room)
        n = F.when(left > 0, left - (full - 1) * room).otherwise(s["n"] + first)
        entry = F.struct(x["s"].alias("s"), s["at"].alias("at"), s["b"].alias("b"), rest.cast("bigint").alias("rest"), room.cast("bigint").alias("room"))
        return F.struct(F.concat(s["out"], F.array(entry)).alias("out"), (s["b"] + full).cast("bigint").alias("b"), n.cast("bigint").alias("n"), (s["at"] + x["c"]).cast("bigint").alias("at"))

    kind = "array<struct<s:bigint,at:bigint,b:bigint,rest:bigint,room:bigint>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at"))
    sizes = F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_c").alias("c"))))
    starts = histogram.groupBy(key).agg(F.aggregate(sizes, start, fold)["out"].alias("_e"))
    starts = starts.select(F.col(key).alias("_k"), F.explode("_e").alias("_e")).select("_k", *(F.col(f"_e.{c}").alias(f"_e_{c}") for c in ("s", "at", "b", "rest", "room")))
    # the rank among equal items, in two steps
    rows = rows.withColumn("_blk", F.floor(F.col(order) / 4096).cast("bigint"))
    counts = rows.groupBy(key, "_s", "_blk").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(key, "_s").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_s", "_blk", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(key, "_s", "_blk").orderBy(order)) - 1
    ranked = rows.withColumn("_rank", rank).join(base, [key, "_s", "_blk"]).withColumn("_i", F.col("_base") + F.col("_rank"))
    placed = ranked.join(starts, (F.col(key) == F.col("_k")) & (F.col("_s") == F.col("_e_s")))
    over_ = F.col("_i") - F.col("_e_rest")
    batch = F.when(over_ < 0, F.col("_e_b")).otherwise(F.col("_e_b") + 1 + F.floor(over_ / F.col("_e_room")))
    # numbers from 0: the first item of a key opens batch 0
    return placed.select(*items.columns, (F.col("_e_at") + F.col("_i")).alias("place"), batch.cast("bigint").alias("batch_no"))


def first_sound(attempts: DataFrame, keys: list[str], attempt: str, size: Column, cap: int = CAP) -> DataFrame:
    """(keys, attempts, sound): the first attempt below the cap, null where none is (PRD19, FLD04)."""
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), F.min(F.when(size < cap, F.col(attempt))).alias("sound"))


def retried(attempts: DataFrame, keys: list[str], attempt: str, size: Column, cap: int = CAP, most: int = 3) -> DataFrame:
    """(keys, attempt, state): the first sound attempt of at most ``most`` repeats after the first, "error" where they are used up, else "retry" (FLD04)."""
    rows = first_sound(attempts.where(F.col(attempt) <= most + 1), keys, attempt, size, cap)
    state = F.when(F.col("sound").isNotNull(), "sound").when(F.col("attempts") > most, "error").otherwise("retry")
    return rows.select(*keys, F.col("sound").alias("attempt"), state.alias("state"))


def parts(rows: DataFrame, key: str, order: str, seconds: str, ends_block: str, limit: float) -> DataFrame:
    """``rows`` (key, order, seconds, ends_block) with part_no from 1: a part closes at the first end of a block
    at or after ``limit`` seconds (FLD03).  No part is empty.

    The fold restarts where a part closes, so it isn't a prefix sum: each key's rows stream through
    one task in order, which holds only the running total.
    """
    plain = rows.select(key, order, F.coalesce(F.col(seconds), F.lit(0.0)).alias("seconds"), F.col(ends_block).alias("ends_block"))
    kind = StructType([*plain.schema.fields, StructField("part_no", LongType())])
    arrow = to_arrow_schema(kind)

    def fold(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, total, open_ = None, 1, 0.0, False
        for batch in batches_:
            numbers = []
            for k, s, e in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if k != now:
                    now, part, total, open_ = k, 1, 0.0, True
                elif not open_:
                    part, total, open_ = part + 1, 0.0, True
                total += s
                numbers.append(part)
                if total >= limit and e:
                    open_ = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], schema=arrow)

    return plain.repartition(key).sortWithinPartitions(key, order).mapInArrow(fold, kind)
