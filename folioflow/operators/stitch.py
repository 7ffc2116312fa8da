"""Joining a sentence that runs over the end of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.ordered import WIDTH, previous_row, running_sum

#: A block whose last sign is none of these goes on.
TERMINAL = ".?!:;”’\"'"


def stitch_pages(blocks: DataFrame, key: str, page: str, order: str, width: int = WIDTH) -> DataFrame:
    """(key, order, type, text, source_page, source_page_end) with bodies joined across pages.

    A page's first block joins the last one before it if both are bodies and that one doesn't
    end in a terminal sign; joins chain.  ``order`` is an integer that orders the blocks of a key over all pages and
    keeps each page together.  Blank and null texts are left out.  The order of a joined block is that of its first part.
    A joined block ends on the last page that any of its parts names.
    Long keys are spread (operators.ordered): only one row per block of ``width`` orders is carried on.
    """
    rows = blocks.where(F.col("text").isNotNull() & ~T.is_blank(F.col("text"))).select(key, order, "type", "text", F.col(page).alias("source_page"), F.col("source_page_end"))
    rows = previous_row(rows, key, order, ["type", "text", "source_page"], "_p_", width)
    first = F.col("_p_type").isNotNull() & ~F.col("source_page").eqNullSafe(F.col("_p_source_page"))
    open_end = ~F.substring("_p_text", -1, 1).isin(*TERMINAL)
    joins = first & (F.col("type") == "body") & (F.col("_p_type") == "body") & open_end
    flagged = rows.withColumn("_new", F.when(joins, 0).otherwise(1))
    groups = running_sum(flagged, key, order, F.col("_new"), "_g", inclusive=True, width=width)
    part = F.struct(F.col(order).alias("o"), F.col("type").alias("t"), F.col("text").alias("x"), F.col("source_page").alias("p"), F.coalesce("source_page_end", "source_page").alias("e"), F.col("source_page_end").alias("s"))
    # a group holds the few blocks of one sentence
    whole = groups.groupBy(key, "_g").agg(F.array_sort(F.collect_list(part)).alias("a"))

    def trimmed(r, i):
        x = F.when(i > 0, F.regexp_replace(r["x"], rf"(?U)\A{T.WS}+", "")).otherwise(r["x"])
        return F.when(i < F.size("a") - 1, F.regexp_replace(x, rf"(?U){T.WS}+\z", "")).otherwise(x)

    texts = F.transform("a", trimmed)
    lead = F.element_at("a", 1)
    ends = F.filter(F.transform("a", lambda r: r["e"]), lambda e: e.isNotNull())
    return whole.select(
        key,
        lead["o"].alias(order),
        lead["t"].alias("type"),
        F.array_join(texts, " ").alias("text"),
        lead["p"].alias("source_page"),
        F.when(F.size("a") > 1, F.try_element_at(ends, F.lit(-1))).otherwise(lead["s"]).alias("source_page_end"),
    )


def chapters_by_image(pages: DataFrame, key: str, page: str, has_image: str) -> DataFrame:
    """(key, page, chapter): a page with an image opens a chapter; pages before belong to the first (SEQ11)."""
    opened = running_sum(pages.select(key, page, has_image), key, page, F.col(has_image).cast("int"), "_c", inclusive=True)
    return opened.select(key, page, F.greatest(F.lit(1), "_c").cast("int").alias("chapter"))
