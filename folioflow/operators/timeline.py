"""Where each piece begins, and the chapters of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.ordered import asof_forward, next_row, running_sum

OPENING_MS = 1500


def timeline(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """The plan's pieces with a segment, with start_sample, samples and start_ms (JON03, WIN01).

    ``segments`` has one row per (book, chunk_idx) with frames and sr, neither null.  Pauses are cut down to whole samples.
    """
    rows = plan.join(segments.select("book", "chunk_idx", "frames", "sr"), ["book", "chunk_idx"])
    quiet = lambda c: F.floor(F.col("sr") * F.col(c) / 1000.0)
    rows = rows.withColumn("samples", (quiet("before_ms") + F.col("frames") + quiet("after_ms")).cast("bigint"))
    rows = running_sum(rows, "book", "chunk_idx", F.col("samples"), "start_sample")
    return rows.withColumn("start_ms", F.floor(F.col("start_sample") / F.col("sr") * 1000).cast("bigint"))


def page_starts(rows: DataFrame) -> DataFrame:
    """(book, page, ms) of the first piece of each page (WIN02); pieces without page are left out."""
    return rows.where(F.col("source_page").isNotNull()).groupBy("book", F.col("source_page").alias("page")).agg(F.min_by("start_ms", "chunk_idx").alias("ms"))


def outline_marks(outline: DataFrame, starts: DataFrame) -> DataFrame:
    """(book, start_ms, title): outline entries (book, ord, level, title, page) at the first piece on or after their page (JON04, WIN06).

    Entries that aren't divisions, or lie outside the pages with audio, are dropped; of entries at one time the deepest, then the last.
    """
    ends = starts.groupBy("book").agg(F.min("page").alias("_a"), F.max("page").alias("_b"))
    kept = outline.where(T.is_outline_title(F.col("title"))).join(ends, "book").where(F.col("page").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    marks = asof_forward(kept, starts, "book", "page", "ms")
    w = Window.partitionBy("book", "ms").orderBy(F.desc("level"), F.desc("ord"))
    return marks.where(F.col("ms").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("book", F.col("ms").alias("start_ms"), T.collapse(F.col("title")).alias("title"))


def spoken_chapters(rows: DataFrame) -> DataFrame:
    """(book, start_ms, title) of the pieces whose heading names a division (PRD12)."""
    return rows.where(T.is_chapter(F.col("heading"))).select("book", "start_ms", F.col("heading").alias("title"))


def chosen_chapters(outline: DataFrame, spoken: DataFrame) -> DataFrame:
    """Per book the outline's marks if there are more of them, else the spoken ones (WIN04)."""
    counts = outline.groupBy("book").agg(F.count("*").alias("_o")).join(spoken.groupBy("book").agg(F.count("*").alias("_s")), "book", "full")
    pick = counts.select("book", (F.coalesce("_o", F.lit(0)) > F.coalesce("_s", F.lit(0))).alias("_outline"))
    take = lambda df, want: df.join(pick.where(F.col("_outline") == want).select("book"), "book", "left_semi")
    return take(outline, True).unionByName(take(spoken, False))


def with_opening(chapters: DataFrame) -> DataFrame:
    """``chapters`` and, where a book's first begins late, one called Opening at 0 (WIN05)."""
    late = chapters.groupBy("book").agg(F.min("start_ms").alias("_m")).where(F.col("_m") > OPENING_MS)
    return chapters.unionByName(late.select("book", F.lit(0).cast("bigint").alias("start_ms"), F.lit("Opening").alias("title")))


def chapter_ends(chapters: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, start_ms, end_ms, title): up to the next chapter or the book's total, at least one second (WIN03)."""
    rows = next_row(chapters, "book", "start_ms", ["start_ms"], "_n_", width=1 << 24).join(totals.select("book", "total_ms"), "book")
    end = F.coalesce("_n_start_ms", "total_ms")
    return rows.select("book", "start_ms", F.when(end <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(end).alias("end_ms"), "title")


def totals(rows: DataFrame) -> DataFrame:
    """(book, total_ms) of a timeline."""
    end = F.max(F.struct("chunk_idx", (F.col("start_sample") + F.col("samples")).alias("e"), "sr"))
    return rows.groupBy("book").agg(end.alias("_e")).select("book", F.floor(F.col("_e.e") / F.col("_e.sr") * 1000).cast("bigint").alias("total_ms"))


def metadata_text(chapters: DataFrame, titles: DataFrame, tags: tuple[str, ...] = ("title",)) -> DataFrame:
    """(book, text): the chapter file of each book (SNK04), with a tag for each of the columns ``tags`` that isn't empty."""
    entry = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), T.ffmeta_escape(F.col("title")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("s"), entry.alias("t"))))
    body = chapters.groupBy("book").agg(F.array_join(F.transform(listed, lambda r: r["t"]), "\n").alias("body"))
    lines = [F.when(F.coalesce(T.strip(F.col(t)), F.lit("")) != "", F.concat(F.lit(f"{t}="), T.ffmeta_escape(F.col(t)))) for t in tags]
    return body.join(titles.select("book", *tags), "book").select("book", F.concat_ws("\n", F.lit(";FFMETADATA1"), *lines, "body").alias("text"))


def forward_frames(rows: DataFrame, target_ms: int) -> DataFrame:
    """(book, chunk_idx, last_chunk): the shortest run from each piece that lasts ``target_ms`` (WIN08).

    Pieces after which less than nine tenths of the target are left have none; the last ones run to the end.
    """
    end = (F.col("start_sample") + F.col("samples")) / F.col("sr") * 1000
    ends = rows.select("book", F.floor(end).cast("bigint").alias("at"), F.col("chunk_idx").alias("last_chunk"))
    last = ends.groupBy("book").agg(F.max("at").alias("_end"), F.max("last_chunk").alias("_last"))
    left = rows.select("book", "chunk_idx", (F.col("start_ms") + target_ms).alias("at"))
    found = asof_forward(left, ends, "book", "at", "last_chunk", width=1 << 22)
    enough = F.col("_end") - (F.col("at") - target_ms) >= 0.9 * target_ms
    return found.join(last, "book").where(enough).select("book", "chunk_idx", F.coalesce("last_chunk", "_last").alias("last_chunk"))
