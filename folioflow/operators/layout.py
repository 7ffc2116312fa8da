"""Lines with their place on the page -> paragraphs, and the measures that choose the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: A line this much (points) right of the page's margin opens a paragraph.
INDENT = 6.0
#: So does a gap of this many times the leading, down or up.
GAP_RATIO = 1.5
#: From this share of indented lines on, indents mark paragraphs.
INDENT_SHARE = 0.05
#: Above this share of lines that begin with a capital, a text is verse.
VERSE_SHARE = 0.45
#: A cluster of gaps needs this share of the most frequent gap, and this many points.
CLUSTER_SHARE, LEAST_GAP, NEAR_GAP = 0.2, 4, 1.5


def merge_drop_caps(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``lines`` (x0, y0, size, text) without empty lines and bare numbers; a drop cap joins the line after it (SRC01).

    A drop cap is one capital, with or without an opening quote, of at least 1.4 times the page's upper median size.
    The line after a drop cap isn't tested itself, so in a run every other one is a cap.
    """
    text = T.strip(T.replace_ligatures(F.col("text")))
    rows = lines.withColumn("text", text).where((F.col("text") != "") & ~T.is_page_number(F.col("text")))
    page, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    sizes = F.array_sort(F.collect_list("size").over(page))
    rows = rows.withColumn("_m", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))
    rows = rows.withColumn("_cap", F.col("text").rlike(r"""\A["“'‘]?[A-Z]\z""") & (F.col("size") >= 1.4 * F.col("_m")))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_cap"), 0).otherwise(1)).over(w))
    # the place inside a run of caps: odd ones take the next line
    rows = rows.withColumn("_i", F.sum(F.col("_cap").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(order)))
    rows = rows.withColumn("_takes", F.col("_cap") & (F.pmod("_i", F.lit(2)) == 1) & F.lead("text").over(w).isNotNull())
    rows = rows.withColumn("_next", F.lead("text").over(w)).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    merged = F.when(F.col("_takes"), F.concat("text", "_next")).otherwise(F.col("text"))
    return rows.where(~F.col("_taken")).select(*keys, order, "x0", "y0", merged.alias("text"))


def _joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Paragraphs from lines that carry ``_new``; those of one paragraph are joined by blanks."""
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("para_no", F.sum(F.col("_new").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return numbered.groupBy(*keys, "para_no").agg(F.array_join(F.transform(parts, lambda r: r["t"]), " ").alias("text"))


def prose_paragraphs(lines: DataFrame, keys: list[str], order: str, leading: str | None = None) -> DataFrame:
    """(keys, para_no, text): a heading line, an indent or, with a ``leading`` column, a wide gap opens a paragraph (SEQ08)."""
    w = Window.partitionBy(*keys).orderBy(order)
    head = T.is_heading_line(F.col("text"))
    rows = lines.withColumn("_h", head).withColumn("_first", F.lag("_h").over(w).isNull())
    indent = F.col("x0") > F.min("x0").over(Window.partitionBy(*keys)) + INDENT
    gap = F.lit(False)
    if leading:
        step, most = F.col("y0") - F.lag("y0").over(w), F.col(leading) * GAP_RATIO
        gap = F.coalesce((F.col(leading) > 0) & ((step > most) | (step < -most)), F.lit(False))
    new = F.col("_first") | F.col("_h") | F.coalesce(F.lag("_h").over(w), F.lit(False)) | indent | gap
    text = F.when(F.col("_h"), T.strip(F.col("text"))).otherwise(F.col("text"))
    return _joined(rows.withColumn("_new", new).withColumn("text", text), keys, order)


def verse_paragraphs(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, para_no, text): a line that ends a sentence closes the paragraph, a heading stands alone (SEQ09)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("_h", T.is_heading_line(F.col("text"))).withColumn("_c", F.substring("text", -1, 1).isin(*'.?!”"'))
    before = F.coalesce(F.lag("_h").over(w) | F.lag("_c").over(w), F.lit(True))
    return _joined(rows.withColumn("_new", F.col("_h") | before), keys, order)


def paragraph_blocks(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with type heading or body and plain text (SEQ10)."""
    t = F.col("text")
    kind = F.when(T.is_heading_line(t) | T.is_heading(t), "heading").otherwise("body")
    return paragraphs.withColumn("type", kind).withColumn("text", T.strip_markdown(t))


def text_mode(lines: DataFrame, key: str) -> DataFrame:
    """(key, share, mode): verse if more than VERSE_SHARE of the lines begin with a capital (AGG06)."""
    share = F.avg(F.col("text").rlike(r"\A\p{Lu}").cast("double"))
    return lines.groupBy(key).agg(share.alias("share")).select(key, F.round("share", 6).alias("share"), F.when(F.col("share") > VERSE_SHARE, "verse").otherwise("prose").alias("mode"))


def indent_share(lines: DataFrame, key: str, page: str) -> DataFrame:
    """(key, share, style): indent if enough lines are indented, else gap (AGG07)."""
    margin = F.min("x0").over(Window.partitionBy(key, page))
    rows = lines.withColumn("_i", (F.col("x0") > margin + INDENT).cast("double"))
    out = rows.groupBy(key).agg(F.avg("_i").alias("share"))
    return out.select(key, F.round("share", 6).alias("share"), F.when(F.col("share") >= INDENT_SHARE, "indent").otherwise("gap").alias("style"))


def modal_leading(gaps: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, leading): the smallest gap that many lines have, refined to the upper median near it (AGG08).

    Gaps of 0 and less, and nulls, don't count; a key without a cluster has 0.  The median is taken from a
    histogram of equal gaps, so no list of a key's gaps is collected.
    """
    rows = gaps.where(F.col(gap) > 0).select(key, F.col(gap).cast("double").alias("g"))
    equal = rows.groupBy(key, "g").agg(F.count("*").alias("n"))
    bins = equal.groupBy(key, F.bround("g").alias("b")).agg(F.sum("n").alias("n"))
    peaks = bins.groupBy(key).agg(F.max("n").alias("peak"))
    chosen = bins.join(peaks, key).where((F.col("n") >= F.col("peak") * CLUSTER_SHARE) & (F.col("b") >= LEAST_GAP)).groupBy(key).agg(F.min("b").alias("b"))
    near = equal.join(chosen, key).where(F.abs(F.col("g") - F.col("b")) <= NEAR_GAP)
    w = Window.partitionBy(key)
    upto = F.sum("n").over(w.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    counted = near.select(key, "g", upto.alias("upto"), F.sum("n").over(w).alias("all"))
    found = counted.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min("g").alias("leading"))
    return gaps.select(key).distinct().join(found, key, "left").select(key, F.coalesce("leading", F.lit(0.0)).alias("leading"))


def suggested_path(pages: DataFrame, key: str) -> DataFrame:
    """(key, path) from pages (chars, lines, mid_lines): B for little text or columns, else A (AGG09)."""
    out = pages.groupBy(key).agg(F.avg("chars").alias("c"), F.sum("lines").alias("l"), F.sum("mid_lines").alias("m"))
    return out.select(key, F.when(F.coalesce("c", F.lit(0.0)) <= 300, "B").when(F.coalesce(F.try_divide("m", "l"), F.lit(0.0)) > 0.25, "B").otherwise("A").alias("path"))
