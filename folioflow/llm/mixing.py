"""Problem 8: mixing sources to target weights.

The weights are the target shares of the sources that have text (those of sources without are shared out among the others).  A mix
has the largest total for which every source can give its share without more than max_repeats copies, so the scarcest source
sets it and every share is met; what the others hold beyond that is left out and reported.  A larger ``total`` may be asked for;
scarce sources then give all they may and fall short.

Each source is cut into blocks of ``BLOCK`` tokens, and blocks are scheduled as a proportionate-fair task set: block k of a source
of weight w is released at floor(k / w) and due at ceil((k + 1) / w); each slot goes to the released block that is due first.
So at any slot each source is less than one block from its share.  With integer weights that schedule repeats after their sum, so it is made
once for one period (at most ``PERIOD`` slots), and block k of a source has its slot in closed form, whatever the size of the corpus.
Documents take the slot of the block in which they begin.  They are placed by prefix sums in two levels (hash buckets of a source,
then within a bucket), so a source with most of the rows is spread.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.tokens import document_sizes
from folioflow.sources.tables import checkpointed, table

#: Tokens of a block, and the most slots of a period; a weight is met to half a slot of a period.
BLOCK = 2048
PERIOD = 10_000
#: Documents of one bucket of a source.
BUCKET_ROWS = 20_000


def weights(shares: dict[str, float]) -> dict[str, int]:
    """Integer weights in proportion to the shares above 0, with a sum of at most PERIOD: exact if that is possible, else by the largest remainders."""
    exact = {s: Fraction(repr(float(x))) for s, x in sorted(shares.items()) if x > 0}
    total = sum(exact.values())
    exact = {s: x / total for s, x in exact.items()}
    period = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    if period <= PERIOD:
        return {s: int(x * period) for s, x in exact.items()}
    out = {s: max(1, int(x * PERIOD)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (exact[s] * PERIOD - out[s], s), reverse=True)[: max(0, PERIOD - sum(out.values()))]:
        out[s] += 1
    return out


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """(integer weights, tokens to give) of the sources (source, share, max_repeats) that have text."""
    most = {s: available.get(s, 0) * max(0, repeats) for s, _, repeats in targets}
    own = weights({s: share for s, share, _ in targets if most[s] > 0})
    period = sum(own.values())
    aim = min((Fraction(most[s] * period, n) for s, n in own.items()), default=Fraction(0)) if total is None else Fraction(total)
    return own, {s: min(int(aim * n / period), most[s]) for s, n in own.items()}


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block from 0) of every slot: earliest deadline first among released blocks.

    Ties in the deadline go to the block whose window overlaps the next one of its source,
    then to the heavier source, then to the first by name.
    """
    total = sum(blocks.values())
    weights = {s: Fraction(n, total) for s, n in blocks.items() if n}

    def entry(s: str, k: int) -> tuple:
        w = weights[s]
        deadline = -(-(k + 1) // w)
        overlap = 0 if (Fraction(k + 1) / w).denominator == 1 else 1
        return deadline, -overlap, -w, s, k

    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, entry(s, k))
        _, _, _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (int(Fraction(k + 1) / weights[s]), s, k + 1))
    return out


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix, source, target_share, max_repeats), one row per mix and source; a null share is 0, null repeats are 1."""
    rows = table(spark, sf_dir, "mix_targets").where("mix is not null and source is not null").dropDuplicates(["mix", "source"])
    return rows.select("mix", "source", F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))


def _plan(spark: SparkSession, sf_dir: str, total: int | None):
    """(sizes, buckets of a source, targets with quotas, slots of one period); the last two are bounded by mix_targets and PERIOD."""
    targets = [tuple(r) for r in _targets(spark, sf_dir).collect()]
    sizes = checkpointed(document_sizes(spark, sf_dir).where(F.col("source").isNotNull()))
    # mix_targets is the same at every scale
    names = _targets(spark, sf_dir).select("source").distinct()
    sums = sizes.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    has = {r["source"]: r["tokens"] for r in sums}
    buckets = max([1, *(-(-r["docs"] // BUCKET_ROWS) for r in sums)])
    rows, slots = [], []
    for mix in sorted({t[0] for t in targets}):
        own = sorted(t[1:] for t in targets if t[0] == mix)
        weight, quota = quotas(own, has, total)
        period = sum(weight.values())
        rows += [(mix, s, share, repeats, has.get(s, 0), quota.get(s, 0), weight.get(s, 0), period, share > 0 and (s not in weight or total is not None and quota[s] < total * weight[s] // period)) for s, share, repeats in own]
        slots += [(mix, s, k, slot) for slot, (s, k) in enumerate(schedule(weight))]
    quota_df = spark.createDataFrame(rows, "mix string, source string, target_share double, max_repeats int, available bigint, quota bigint, weight bigint, period bigint, short boolean")
    slot_df = spark.createDataFrame(slots, "mix string, source string, turn bigint, in_period bigint")
    return sizes, buckets, quota_df, slot_df


def mixed(spark: SparkSession, sf_dir: str, total: int | None = None) -> DataFrame:
    """(mix, slot, source, doc_id, copy, position, tokens): the documents of every mix in order of slot.

    ``total`` is the aim in tokens; by default the largest for which all shares are met.  copy counts from 1 up
    to max_repeats; position is the place in tokens of the document within its source's stream and orders the documents of
    a slot.  Documents without tokens or source are in no mix.
    """
    return _mixed(*_plan(spark, sf_dir, total))


def _mixed(sizes: DataFrame, buckets: int, quota: DataFrame, slots: DataFrame) -> DataFrame:
    placed = _prefix(sizes, buckets)
    copies = placed.join(F.broadcast(quota.where("quota > 0")), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("max_repeats", F.ceil(F.col("quota") / F.col("available")).cast("int")))))
    at = (F.col("copy") - 1) * F.col("available") + F.col("before")
    # the document that crosses the quota's end is taken if at least half of it is within
    taken = copies.withColumn("position", at).where(F.col("position") + F.col("tokens") / 2 <= F.col("quota"))
    block = F.floor(F.col("position") / BLOCK)
    keyed = taken.withColumn("turn", F.pmod(block, F.col("weight"))).withColumn("_round", F.floor(block / F.col("weight")))
    both = keyed.join(F.broadcast(slots), ["mix", "source", "turn"])
    return both.select("mix", (F.col("_round") * F.col("period") + F.col("in_period")).alias("slot"), "source", "doc_id", "copy", "position", "tokens")


def _prefix(sizes: DataFrame, count: int) -> DataFrame:
    """``before``: the tokens of the source's documents that come earlier in its order of hashes, in ``count`` buckets a source."""
    hashed = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(count)))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    buckets = hashed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)).alias("base"))
    inner = hashed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return inner.join(base, ["source", "bucket"]).select("source", "doc_id", "tokens", (F.col("base") + F.col("inner")).alias("before"))


def shares(spark: SparkSession, sf_dir: str, total: int | None = None) -> DataFrame:
    """(mix, source, target_share, available, quota, tokens, share, most_copies, left_out, short): what every source reached.

    A source that gives nothing has tokens 0; left_out is what it holds and the mix doesn't take; short marks those
    whose text didn't suffice for their share.
    """
    sizes, buckets, quota, slots = _plan(spark, sf_dir, total)
    rows = _mixed(sizes, buckets, quota, slots).groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("most_copies"))
    joined = quota.join(rows, ["mix", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # one row a source of mix_targets
    all_of = F.sum("tokens").over(Window.partitionBy("mix"))
    share = F.coalesce(F.col("tokens") / F.nullif(all_of, F.lit(0)), F.lit(0.0))
    return joined.select(
        "mix", "source", "target_share", "available", "quota", "tokens", F.round(share, 6).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.greatest(F.lit(0), F.col("available") - F.col("tokens")).alias("left_out"), "short",
    )


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix, source, has_text, met, within_repeats): whether a source gives its quota to half its longest document, and no document too often."""
    sizes, buckets, quota, slots = _plan(spark, sf_dir, None)
    mixed_ = _mixed(sizes, buckets, quota, slots)
    copies = mixed_.groupBy("mix", "source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    given = copies.groupBy("mix", "source").agg(F.max("n").alias("n"), F.sum("tokens").alias("given"))
    longest = sizes.groupBy("source").agg(F.max("tokens").alias("longest"))
    rows = quota.join(given, ["mix", "source"], "left").join(longest, "source", "left")
    far = F.abs(F.coalesce("given", F.lit(0)) - F.col("quota"))
    return rows.select("mix", "source", (F.col("available") > 0).alias("has_text"), (far <= F.coalesce("longest", F.lit(0)) / 2).alias("met"), (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


CHECKED_SQL = """SELECT DISTINCT mix, source, EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND length(d.text) > 0) AS has_text, true AS met, true AS within_repeats
FROM mix_targets m WHERE mix IS NOT NULL AND source IS NOT NULL"""
