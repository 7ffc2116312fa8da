"""Problem 7: filling containers of fixed capacity with whole documents.

Sum-of-squares packing: documents come one after another; each goes to the
fill level that makes the sum of the squared counts of partly filled containers, counted by
windows of fill level, smallest.  Windows keep every level supplied with open containers, so later
documents find a place that leaves little room.  A document larger than the capacity
fills whole containers and only its rest is packed.

Documents are dealt by hash to shards of about ``SHARD`` documents, packed side by side;
what a shard leaves open at its end is packed once more, so it wastes about one container.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.tokens import document_sizes
from folioflow.sources.tables import checkpointed, table

SHARD = 25_000
WINDOWS = 64
#: A container that is at least this full stays as it is at the end.
CLOSED = 0.98


class SumOfSquares:
    """Open containers by window of their fill level."""

    def __init__(self, capacity: int, windows: int = WINDOWS):
        if capacity < 1:
            raise ValueError("the capacity must be positive")
        self.capacity = capacity
        self.width = max(1, -(-capacity // windows))
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(capacity // self.width + 1)]
        self.made = 0

    def _window(self, level: int) -> int:
        return level // self.width

    def place(self, size: int) -> int:
        """The container (from 0) that takes an item of ``size``, at most the capacity."""
        room = self.capacity - size
        counts = [len(x) for x in self.levels]
        # a new container: one more in the window of ``size``, unless it is full at once
        best_gain, best_level, best_at = (1 + 2 * counts[self._window(size)] if size < self.capacity else 0), -1, None
        for w in range(self._window(room), -1, -1):
            row = self.levels[w]
            if not row:
                continue
            k = bisect.bisect_right(row, (room, 1 << 62)) - 1
            if k < 0:
                continue
            level = row[k][0]
            to = self._window(level + size)
            if level + size == self.capacity:
                gain = 1 - 2 * counts[w]
            elif to == w:
                gain = 0
            else:
                gain = 2 * (counts[to] - counts[w]) + 2
            if gain < best_gain or (gain == best_gain and level > best_level):
                best_gain, best_level, best_at = gain, level, (w, k)
        if best_at is None:
            number, level = self.made, 0
            self.made += 1
        else:
            level, number = self.levels[best_at[0]].pop(best_at[1])
        if level + size < self.capacity:
            bisect.insort(self.levels[self._window(level + size)], (level + size, number))
        return number


def pack(sizes: list[int], capacity: int, windows: int = WINDOWS) -> list[list[tuple[int, int, int]]]:
    """For each item, its pieces (container, first token, end token).

    When the items have ended nothing will fill the containers that are still open, so those that
    are less than ``CLOSED`` full are dissolved and their items placed again, the largest
    first, each where it leaves least room.
    """
    bins = SumOfSquares(capacity, windows)
    out: list[list[tuple[int, int, int]]] = []
    holds: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        pieces = []
        at = 0
        while n - at > capacity:
            pieces.append((bins.made, at, at + capacity))
            bins.made += 1
            at += capacity
        if n > at:
            number = bins.place(n - at)
            pieces.append((number, at, n))
            holds.setdefault(number, []).append(i)
        out.append(pieces)
    free, again = [], []
    for row in bins.levels:
        for level, number in row:
            if level < CLOSED * capacity:
                free.append(number)
                again += holds[number]
    free.sort(reverse=True)
    open_now: list[tuple[int, int]] = []  # (room, container)
    for i in sorted(again, key=lambda i: (out[i][-1][1] - out[i][-1][2], i)):
        _, a, b = out[i][-1]
        k = bisect.bisect_left(open_now, (b - a, -1))
        if k < len(open_now):
            room, number = open_now.pop(k)
        else:
            if not free:
                free.append(bins.made)
                bins.made += 1
            room, number = capacity, free.pop()
        if room > b - a:
            bisect.insort(open_now, (room - (b - a), number))
        out[i][-1] = (number, a, b)
    return out


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, capacity_tokens): kinds of container with a capacity."""
    return table(spark, sf_dir, "containers").where("container is not null and capacity_tokens > 0").dropDuplicates(["container"]).select("container", "capacity_tokens")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, container_no, doc_id, piece_no, first_token, end_token): every document, for each capacity.

    Documents without tokens aren't packed.  container_no is unique within a container kind;
    piece_no counts from 1 and exceeds 1 only for documents larger than the capacity.
    """
    sizes = checkpointed(document_sizes(spark, sf_dir).select("doc_id", "tokens"))
    shards = max(1, -(-sizes.count() // SHARD))
    kinds = _kinds(spark, sf_dir).select("container", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    # containers holds one row per kind of container, the same at every scale
    work = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).join(F.broadcast(kinds))
    schema = pa.schema([("container", pa.string()), ("container_no", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("first_token", pa.int64()), ("end_token", pa.int64())])

    def fill(group: pa.Table) -> pa.Table:
        shard, capacity, name = (group.column(k)[0].as_py() for k in ("shard", "capacity", "container"))
        group = group.sort_by("doc_id")
        rows: dict[str, list] = {k: [] for k in schema.names}
        for doc, pieces in zip(group.column("doc_id").to_pylist(), pack(group.column("tokens").to_pylist(), capacity)):
            for k, (number, a, b) in enumerate(pieces, 1):
                for col, v in zip(rows.values(), (name, shard * (1 << 40) + number, doc, k, a, b)):
                    col.append(v)
        return pa.table(rows, schema=schema)

    # a partition for each group, however few bytes they have
    work = work.repartition(min(10_000, shards * max(1, kinds.count())), "container", "shard")
    return work.groupBy("container", "shard").applyInArrow(fill, "container string, container_no bigint, doc_id bigint, piece_no int, first_token bigint, end_token bigint")


def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, capacity_tokens, containers, tokens, fill, least_containers) of each kind."""
    rows = packed(spark, sf_dir).groupBy("container").agg(F.count_distinct("container_no").alias("containers"), F.sum(F.col("end_token") - F.col("first_token")).alias("tokens"))
    kinds = _kinds(spark, sf_dir)
    return kinds.join(rows, "container").select(
        "container",
        "capacity_tokens",
        "containers",
        "tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, doc_id, whole, over): whether a document's pieces are all its tokens, each once, and whether one of its containers holds too much."""
    rows = checkpointed(packed(spark, sf_dir))
    own = rows.groupBy("container", "doc_id").agg(F.min("first_token").alias("a"), F.max("end_token").alias("b"), F.sum(F.col("end_token") - F.col("first_token")).alias("n"))
    held = rows.groupBy("container", "container_no").agg(F.sum(F.col("end_token") - F.col("first_token")).alias("held")).join(_kinds(spark, sf_dir), "container")
    full = rows.join(held.where(F.col("held") > F.col("capacity_tokens")).select("container", "container_no"), ["container", "container_no"], "left_semi").select("container", "doc_id", F.lit(True).alias("over")).distinct()
    sizes = document_sizes(spark, sf_dir).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))
    both = own.join(sizes.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).join(full.withColumnRenamed("container", "_c").withColumnRenamed("doc_id", "_e"), (F.col("container") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_e")), "left")
    whole = (F.col("a") == 0) & (F.col("b") == F.col("n")) & (F.col("n") == F.col("tokens"))
    return both.select("container", "doc_id", whole.alias("whole"), F.coalesce("over", F.lit(False)).alias("over"))


CHECKED_SQL = "SELECT container, doc_id, true AS whole, false AS over FROM documents, (SELECT DISTINCT container FROM containers WHERE capacity_tokens > 0) WHERE length(text) > 0"
