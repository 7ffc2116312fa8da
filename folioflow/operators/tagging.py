"""Lines of a page -> typed blocks, by windows over the page only.

Runs of table rows, dice table rows and number bullets are islands: a row goes on with the run if the line
before is of the kind, or is blank and the one before that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# What stands for text that isn't read.
TABLE_MARK = "A reference table is omitted here."
DICE_MARK = "A random table is omitted here."
DATA_MARK = "A data list is omitted here."
DIAGRAM_MARK = "A diagram is omitted here."
#: Rows of a dice table that are shorter than this (upper median) are data; from three rows on it is one.
DICE_SHORT, DICE_ROWS = 60, 3
#: A page of so many blocks is degenerate below this share of different texts.
LOOP_BLOCKS, LOOP_SHARE = 20, 0.3
#: A page of so many bodies is a diagram below this upper median and this total of signs.
LABELS, LABEL_MEDIAN, LABEL_TOTAL = 15, 30, 900


def upper_median(x: Column) -> Column:
    """The upper median of a group; the group's values are collected, so groups must be small."""
    return F.get(F.array_sort(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int"))


def classified(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """``lines`` with plain text, the facts of each line and the runs it belongs to."""
    c = F.col(line)
    kind = F.col("_kind")
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("plain", T.strip_markdown(c)).withColumn("_kind", T.line_class(c, F.col("plain")))
    rows = rows.select(
        "*",
        (kind == "blank").alias("bl"),
        T.is_table_row(c).alias("tr"),
        T.is_dice_header(c, F.col("plain")).alias("hd"),
        T.is_dice_row(c, F.col("plain")).alias("dr"),
        T.is_number_list(c).alias("nl"),
        kind.isin("page_number", "running_header", "markup", "code_fence").alias("sk"),
        (kind == "html_table").alias("ht"),
    ).withColumn("dm", F.col("hd") | F.col("dr"))
    runs = (("tr", "tr"), ("dm", "hd"), ("nl", "nl"))
    false = F.lit(False)
    on = lambda k: F.coalesce(F.lag(k).over(w), false) | (F.coalesce(F.lag("bl").over(w), false) & F.coalesce(F.lag(k, 2).over(w), false))
    rows = rows.select("*", *((F.col(k) & ~on(k)).alias(f"new_{k}") for k, _ in runs))
    rows = rows.select("*", *(F.sum(F.col(f"new_{k}").cast("int")).over(w).alias(f"isl_{k}") for k, _ in runs))
    start = lambda k, o: F.min(F.when(F.col(k) & F.col(o) & ~F.col("sk") & ~F.col("ht"), F.col(order))).over(Window.partitionBy(*keys, f"isl_{k}"))
    rows = rows.select("*", *(F.when(F.col(k), start(k, o)).alias(f"start_{k}") for k, o in runs))
    # a dice run counts only with enough rows after its header
    island = Window.partitionBy(*keys, "isl_dm")
    after = F.col("dr") & F.col("dm") & (F.col(order) > F.col("start_dm"))
    lengths = F.array_sort(F.collect_list(F.when(after, F.length("plain"))).over(island))
    rows = rows.withColumn("_lens", lengths)
    return rows.select("*", F.size("_lens").alias("dice_rows"), F.get("_lens", F.floor(F.size("_lens") / 2).cast("int")).alias("dice_median")).drop("_lens")


def _emitted(rows: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """(keys, order, type, text, _plain_body) of the lines that give a block."""
    at, c, plain = F.col(order), F.col(line), F.col("plain")
    in_tr, in_nl = at >= F.col("start_tr"), at >= F.col("start_nl")
    in_dm = (at >= F.col("start_dm")) & (F.col("dice_rows") >= DICE_ROWS)
    short = F.col("dice_median") < DICE_SHORT
    code = (
        F.when(F.col("bl"), None)
        .when(in_tr, F.when(at == F.col("start_tr"), "table"))
        .when(in_nl, F.when(at == F.col("start_nl"), "data"))
        .when(in_dm, F.when(short & (at == F.col("start_dm")), "dice").when(~short & F.col("dr"), "row"))
        .when(F.col("sk"), None)
        .when(F.col("ht"), "table")
        .when(T.is_heading(c, plain), "heading")
        .when(T.is_dialogue(c, plain), "dialogue")
        .otherwise("body")
    )
    coded = rows.select(*keys, order, "plain", code.alias("_code")).where(F.col("_code").isNotNull())
    k = F.col("_code")
    kind = F.when(k == "dice", "table").when(k == "data", "omitted_data").when(k == "row", "body").otherwise(k)
    text = F.when(k == "table", TABLE_MARK).when(k == "dice", DICE_MARK).when(k == "data", DATA_MARK).when(k == "row", T.strip_roll(plain)).otherwise(plain)
    out = coded.select(*keys, order, kind.alias("type"), text.alias("text"), (k == "body").alias("_plain_body"), (k == "row").alias("_row"))
    return out.where(~F.col("_row") | (F.col("text") != "")).drop("_row")


def drop_repeats(rows: DataFrame, keys: list[str], order: str, body: Column) -> DataFrame:
    """``rows`` (order, type, text) of a page without bodies that equal the block before them (SEQ05); ``body`` tells which rows may be dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.lag("type").over(w) == "body") & (F.lag("text").over(w) == F.col("text"))
    return rows.withColumn("_drop", body & F.coalesce(same, F.lit(False))).where(~F.col("_drop")).drop("_drop")


def page_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blocks, distinct_share, upper_median, signs) of the texts of a page (SEQ06)."""
    n = F.length("text")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("blocks"), F.round(F.count_distinct("text") / F.count("*"), 6).alias("distinct_share"), upper_median(n).alias("upper_median"), F.sum(n).alias("signs")
    )


def tag_blocks(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """(keys, order, type, text): the blocks of every page.

    ``keys`` name a page, ``order`` its lines.  Null lines are left out; a page that only repeats
    itself has no blocks; a page of labels becomes one mark at its first line.
    """
    rows = _emitted(classified(lines.where(F.col(line).isNotNull()).select(*keys, order, line), keys, order, line), keys, order, line)
    kept = drop_repeats(rows, keys, order, F.col("_plain_body")).drop("_plain_body")
    texty = F.col("type").isin("body", "heading")
    page = Window.partitionBy(*keys)
    ranked = kept.select(
        "*",
        (F.row_number().over(Window.partitionBy(*keys, "text").orderBy(order)) == 1).cast("int").alias("_once"),
        F.when(texty, F.length("text")).alias("_size"),
        F.row_number().over(Window.partitionBy(*keys, texty).orderBy(F.length("text"))).alias("_rank"),
    )
    facts = ranked.select(
        "*",
        F.count("*").over(page).alias("_n"),
        F.sum("_once").over(page).alias("_d"),
        F.count("_size").over(page).alias("_nb"),
        F.sum("_size").over(page).alias("_tot"),
        F.min(order).over(page).alias("_first"),
    )
    median = F.max(F.when(F.col("_rank") == F.floor(F.col("_nb") / 2) + 1, F.col("_size"))).over(page)
    loop = (F.col("_n") >= LOOP_BLOCKS) & (F.col("_d") / F.col("_n") < LOOP_SHARE)
    labels = (F.col("_nb") >= LABELS) & (F.col("_tot") < LABEL_TOTAL) & (F.col("_med") < LABEL_MEDIAN)
    judged = facts.withColumn("_med", median).where(~loop).withColumn("_labels", F.coalesce(labels, F.lit(False)))
    judged = judged.where(~F.col("_labels") | (F.col(order) == F.col("_first")))
    return judged.select(
        *keys, order, F.when(F.col("_labels"), "omitted_data").otherwise(F.col("type")).alias("type"), F.when(F.col("_labels"), DIAGRAM_MARK).otherwise(F.col("text")).alias("text")
    )
