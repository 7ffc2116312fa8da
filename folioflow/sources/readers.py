"""Sources beside Parquet tables.

PDF pages and scanned images need libraries that aren't part of this package; ``pages_from`` takes
any function that decodes one file, and everything after it is columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.functions import text as T

BLOCK = "type string, text string, source_page int, source_page_end int"


def block_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block_no, type, text, source_page, source_page_end) of files {"blocks": [...]} (SRC07).

    An absent key is null; block_no counts from 0.
    """
    rows = spark.read.schema(f"blocks array<struct<{BLOCK.replace(' string', ':string').replace(' int', ':int')}>>").json(paths, multiLine=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode("blocks").alias("block_no", "b")).select("path", "block_no", "b.*")


def job_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One row per JSON file, newest name first (SRC08)."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("path", F.col("_metadata.file_path")).orderBy(F.desc("path"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of one text file, from 1.

    The whole file is one record, so files must fit one task; larger ones need a format with its own keys.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(T.lines(F.col("value"))).alias("i", "value")).select((F.col("i") + 1).alias("line_no"), "value")


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines of one file between line feeds, from 1.

    The file is read in splits of any number: lines are counted by split, and the counts summed in order of the splits' first bytes.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    counts = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    # one row a split
    before = counts.select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_s").orderBy("_i"))
    return rows.withColumn("_w", within).join(before, "_s").select((F.col("_before") + F.col("_w")).alias("line_no"), "value")


def json_record(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """The ``number``-th record (from 1) of a JSON lines file; no row if there are fewer (SRC09)."""
    return numbered_records(spark, path).where(F.col("line_no") == number).select(F.from_json("value", schema).alias("r")).select("r.*")


def paragraphs(c: Column) -> Column:
    """Array of the paragraphs that blank lines divide, inner line ends as blanks (SRC10)."""
    parts = F.transform(F.split(c, rf"\n{T.WS}*\n", -1), T.collapse)
    return F.filter(parts, lambda p: p != "")


def log_tail(log: DataFrame, order: str, count: int = 30) -> DataFrame:
    """The last ``count`` rows in order (SRC13): a top-k, not a sort of the log."""
    return log.orderBy(F.desc(order)).limit(count).orderBy(order)


def setting(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty (SRC14)."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def setting_list(c: Column, sign: str = ";") -> Column:
    """The parts of a list setting, trimmed, without empty ones (SRC14)."""
    return F.filter(F.transform(F.split(c, f"\\Q{sign}\\E", -1), T.strip), lambda x: x != "")


def embedded_segments(c: Column) -> Column:
    """Array of (role, text, after_ms) from a command line that holds records role = '..' text = '..' after_ms = n, quotes doubled inside (SRC16)."""
    quoted = r"'([^']*+(?:''[^']*+)*+)'"
    pattern = F.lit(rf"role\s*=\s*{quoted}\s+text\s*=\s*{quoted}\s+after_ms\s*=\s*(\d+)")
    plain = lambda x: F.replace(x, F.lit("''"), F.lit("'"))
    role, text, after = (F.regexp_extract_all(c, pattern, F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(role.alias("a"), text.alias("b"), after.alias("c")), lambda r: F.struct(plain(r["a"]).alias("role"), plain(r["b"]).alias("text"), r["c"].cast("int").alias("after_ms")))


def exactly(segments: Column, n: int) -> Column:
    """The array if it has n entries; anything else is an error (SRC16)."""
    return F.when(F.size(segments) == n, segments).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} segments, found "), F.size(segments))).cast("array<struct<role:string,text:string,after_ms:int>>"))


def files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of all files below a folder (SRC06)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


#: Bytes of the largest file that is imported.
MOST_BYTES = 2 << 30


def import_error(name: Column, length: Column, head: Column, encrypted: Column, pages: Column) -> Column:
    """What is wrong with an imported file, null if nothing (SRC18).

    ``head`` holds the first bytes as text; null where something isn't known yet counts as right.
    """
    return (
        F.when(length == 0, "empty")
        .when(length > MOST_BYTES, "larger than 2 GiB")
        .when(~F.lower(name).endswith(".pdf"), "not a .pdf")
        .when(~F.contains(head, F.lit("%PDF-")), "no PDF header")
        .when(encrypted, "encrypted")
        .when(pages < 1, "no pages")
    )


def import_names(found: DataFrame, path: str = "path") -> DataFrame:
    """``found`` with ``name``: the file name that file systems accept, with (2), (3) and so on for equal ones in order of path (SRC18)."""
    plain = F.coalesce(F.nullif(T.windows_name(T.file_stem(F.col(path))), F.lit("")), F.lit("document"))
    rows = found.withColumn("_s", plain)
    r = F.row_number().over(Window.partitionBy(F.lower("_s")).orderBy(path))
    return rows.withColumn("_r", r).withColumn("name", F.concat("_s", F.when(F.col("_r") > 1, F.concat(F.lit(" ("), "_r", F.lit(")"))).otherwise(""), F.lit(".pdf"))).drop("_s", "_r")


def pdf_checks(found: DataFrame) -> DataFrame:
    """(path, error) of files with their content; the file source doesn't list empty files, so they have no row (SRC18)."""
    head = F.substring(F.col("content"), 1, 1024).cast("string")
    return found.select("path", import_error(F.col("path"), F.col("length"), head, F.lit(False), F.lit(1)).alias("error"))


def _little(c: str, at: int, size: int) -> Column:
    """An unsigned little-endian number of the bytes of a column, ``at`` from 0."""
    digits = F.hex(F.substring(F.col(c), at + 1, size))
    return F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))), 16, 10).cast("bigint")


def heads(found: DataFrame, size: int) -> DataFrame:
    """(path, head): the first bytes of each file, read by themselves, whatever the size of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                fs, place = FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    out.append(f.read(size))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "head"])

    return found.select("path").mapInArrow(run, "path string, head binary")


def wav_headers(found: DataFrame) -> DataFrame:
    """(path, channels, sr, bits, frames) from the first 44 bytes of plain PCM files (SRC11)."""
    rows = heads(found, 44).withColumnRenamed("head", "h")
    out = rows.select("path", _little("h", 22, 2).cast("int").alias("channels"), _little("h", 24, 4).cast("int").alias("sr"), _little("h", 34, 2).cast("int").alias("bits"), _little("h", 40, 4).alias("_b"))
    return out.select("path", "channels", "sr", "bits", F.floor(F.try_divide(F.col("_b") * 8, F.col("bits") * F.col("channels"))).alias("frames"))


def wav_samples(found: DataFrame) -> DataFrame:
    """(path, samples) of 16-bit PCM files as floats in [-1, 1) (SRC12)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            data = [np.frombuffer(x.as_py()[44:], "<i2").astype(np.float32) / 32768 for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(data, pa.list_(pa.float32()))], ["path", "samples"])

    return found.select("path", "content").mapInArrow(decode, "path string, samples array<float>")


def voice_sample(samples: Column, sr: Column, seconds: int = 20, least: int = 3) -> Column:
    """The first seconds, scaled so that no sample passes 0.95; null if shorter than ``least`` seconds (SRC19)."""
    cut = F.slice(samples, F.lit(1), (sr * seconds).cast("int"))
    peak = F.array_max(F.transform(cut, F.abs))
    scale = 0.95 / F.greatest(peak, F.lit(0.95))
    return F.when(F.size(cut) >= sr * least, F.when(peak > 0, F.transform(cut, lambda x: x * scale)).otherwise(cut))


def raster_zoom(width: Column, height: Column, dpi: int, most_megapixels: float = 12.0) -> Column:
    """Zoom of a page for a resolution, lessened so that the image stays within its pixels (SRC03)."""
    zoom = F.lit(dpi / 72.0)
    mp = width * zoom * height * zoom / 1e6
    return F.when(mp > most_megapixels, zoom * F.sqrt(most_megapixels / mp)).otherwise(zoom)


def pages_from(found: DataFrame, decode: Callable[[bytes], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """``decode`` over each file's content, its rows with the file's path before them (SRC01, SRC04).

    An error of one file gives one row with ``error`` set and the other columns null, so a bad file doesn't end the job (SRC20).
    """
    kind = StructType.fromDDL(f"path string, {schema}, error string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [{"path": path, **r} for r in decode(content)]
                except Exception as e:  # noqa: BLE001
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return found.select("path", "content").mapInArrow(run, kind)


def uncached(pages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The pages whose text isn't in the cache yet (SRC04)."""
    return pages.join(cache.select(*keys), keys, "left_anti")
