"""Sinks.  Every writer goes through Spark's commit protocol: readers see whole results only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.schedule import latest


def write_blocks(blocks: DataFrame, path: str, key: str = "book") -> None:
    """Blocks as JSON lines, one folder per book, in order of block_no within a file (SNK01).

    A long book gives a file for each 65,536 block numbers.
    """
    rows = blocks.select(key, "block_no", "type", "text", "source_page", "source_page_end")
    rows.repartition(key, F.floor(F.col("block_no") / 65536)).sortWithinPartitions(key, "block_no").write.partitionBy(key).mode("overwrite").json(path)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], version: str, path: str) -> None:
    """The newest row of each key, of the state and its changes, written to a new place (SNK02).

    Of equal versions the changed row wins.
    """
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest(both, keys, [F.desc_nulls_last(version), F.desc("_new")]).drop("_new").write.mode("errorifexists").parquet(path)


#: Folders that segments are dealt to by their book; the same for all deliveries to a place.
SHELVES = 64


def write_segments(segments: DataFrame, path: str, key: str = "book") -> None:
    """Segments by book; books that are written replace what there was, others stay (SNK03, SNK07).

    A folder (``shelf``) holds many books, as a file for each of many small books takes far longer than its rows.  A shelf that gets
    books is written again with the books that it keeps, in order of the book.
    """
    shelved = lambda x: x.withColumn("shelf", F.pmod(F.xxhash64(key), F.lit(SHELVES)).cast("int"))
    spark, rows = segments.sparkSession, shelved(segments)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and any(x.getPath().getName().startswith("shelf=") for x in files.listStatus(place)):
        new = segments.select(F.col(key).alias("_k")).distinct()
        kept = spark.read.option("mergeSchema", "true").parquet(path).join(F.broadcast(shelved(new.withColumnRenamed("_k", key)).select("shelf").distinct()), "shelf", "left_semi")
        rows = rows.unionByName(kept.join(new, kept[key].eqNullSafe(new["_k"]), "left_anti"), allowMissingColumns=True)
    rows.hint("rebalance", "shelf").sortWithinPartitions("shelf", key).write.partitionBy("shelf").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Fails if the place exists (SNK08)."""
    df.write.mode("errorifexists").json(path)


def append_log(lines: DataFrame, path: str) -> None:
    """Rows ``message`` appended with the time before them (SNK09)."""
    stamped = F.concat(F.lit("["), F.date_format(F.current_timestamp(), "HH:mm:ss"), F.lit("] "), F.col("message"))
    lines.select(stamped.alias("value")).write.mode("append").text(path)


def chapter_files(parts: DataFrame, path: str) -> None:
    """(book, chapter, order_no, text): one folder of text per chapter, paragraphs apart by blank lines (SNK11)."""
    rows = parts.select("book", "chapter", "order_no", F.concat("text", F.lit("\n")).alias("value"))
    rows.repartition("book", "chapter").sortWithinPartitions("book", "chapter", "order_no").select("book", "chapter", "value").write.partitionBy("book", "chapter").mode("overwrite").text(path)


def combined_book(parts: DataFrame) -> DataFrame:
    """(book, part_no, value): all chapters of a book with a line before each, as rows in order (SNK11); rows, so no task holds a book."""
    text = parts.select("book", "chapter", F.col("order_no").cast("bigint").alias("order_no"), F.col("text").alias("value"))
    marks = parts.select("book", "chapter").distinct().select("book", "chapter", F.lit(-1).cast("bigint").alias("order_no"), F.format_string("===== CHAPTER %d =====", F.col("chapter").cast("bigint")).alias("value"))
    return text.unionByName(marks)


def write_tagged(blocks: DataFrame, path: str) -> None:
    """Blocks as JSON lines, one file a task (SNK12)."""
    blocks.select("book", "block_no", "type", "text").write.mode("overwrite").json(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """(book, name, value): counts, digests and the like beside a plan, in place of small files (SNK13)."""
    facts.select("book", "name", F.col("value").cast("string").alias("value")).write.mode("overwrite").parquet(path)


def report(facts: DataFrame) -> DataFrame:
    """(text): one line "name: value" per row (name, value) in order of name (SNK10); for small tables of facts."""
    line = F.concat_ws(": ", "name", F.coalesce("value", F.lit("-")))
    rows = facts.groupBy().agg(F.array_sort(F.collect_list(line)).alias("l"))
    return rows.select(F.array_join("l", "\n").alias("text"))
