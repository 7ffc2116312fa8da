"""Files, jobs and their details."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioflow.functions import text as T
from folioflow.sources.tables import checkpointed


def once_by_path(files: DataFrame, order: list[Column], path: str = "path") -> DataFrame:
    """One file per path, letter case aside: the first in ``order`` (SRC06, SET02)."""
    w = Window.partitionBy(F.lower(F.col(path))).orderBy(*order)
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ancestors(path: Column) -> Column:
    """The folders that hold a path, the nearest last, without the path itself (PRD16)."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def outside(files: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """``files`` that lie in none of ``folders`` (JON10): an equi-join on the folders of each path."""
    inside = files.select(path, F.explode(ancestors(F.col(path))).alias("_f")).join(folders.select(F.col(folder).alias("_f")).distinct(), "_f", "left_semi").select(path).distinct()
    return files.join(inside, path, "left_anti")


def shared_paths(jobs: DataFrame, key: str, path: str) -> DataFrame:
    """(key) of the jobs whose file another job has too, letter case aside (JON06)."""
    rows = jobs.select(key, F.lower(F.col(path)).alias("_p")).where(F.col("_p").isNotNull()).distinct()
    many = rows.groupBy("_p").agg(F.count("*").alias("_n")).where("_n > 1")
    return rows.join(many, "_p", "left_semi").select(key)


def in_use(jobs: DataFrame, key: str, path: str, status: str, unfinished: list[str]) -> DataFrame:
    """(key) of the jobs whose file another job needs that isn't finished, letter case aside (JON06): such a file isn't put away.

    Jobs are counted by file first, so a file of many jobs gives one row.
    """
    rows = jobs.select(key, F.lower(F.col(path)).alias("_p"), F.col(status).isin(unfinished).cast("int").alias("_u")).where(F.col("_p").isNotNull()).distinct()
    counts = rows.groupBy("_p").agg(F.sum("_u").alias("_n"))
    return rows.join(counts, "_p").where(F.col("_n") > F.coalesce("_u", F.lit(0))).select(key)


def covers(images: DataFrame, key: str, order: str, least: int = 200) -> DataFrame:
    """(key, order): the largest image of each document by bytes, the first of equal ones, of those with both sides at least ``least`` (SRC05)."""
    rows = images.where((F.col("width") >= least) & (F.col("height") >= least))
    return rows.groupBy(key).agg(F.max(F.struct("bytes", -F.col(order))).alias("_b")).select(key, (-F.col("_b")["col2"]).alias(order))


def start_page(lines: DataFrame, outline: DataFrame, key: str, pages: int = 80, head: int = 20, contents: int = 10, markers: int = 3) -> DataFrame:
    """(key, page, reason): where reading should begin (AGG10).

    The least page of an opening heading in the outline (key, page, title), else the first of the leading pages that has one
    among its first lines (key, page, line_no, text), unless it looks like a table of contents; else page 1 without reason.
    line_no counts the non-blank lines of a page from 1.
    """
    by_outline = outline.where(T.is_start_heading(F.col("title")) & (F.col("page") >= 1)).groupBy(key).agg(F.min("page").alias("_po"))
    facts = lines.where(F.col("page") <= pages).groupBy(key, "page").agg(
        F.count(F.when(T.is_start_heading(F.col("text")), 1)).alias("_m"),
        F.count(F.when(T.is_start_heading(F.col("text")) & (F.col("line_no") <= head), 1)).alias("_h"),
        F.count(F.when((F.col("line_no") <= contents) & F.lower("text").contains("contents"), 1)).alias("_c"),
    )
    by_page = facts.where((F.col("_h") > 0) & (F.col("_c") == 0) & (F.col("_m") < markers)).groupBy(key).agg(F.min("page").alias("_pp"))
    keys = lines.select(key).union(outline.select(key)).distinct()
    out = keys.join(by_outline, key, "left").join(by_page, key, "left")
    reason = F.when(F.col("_po").isNotNull(), "outline").when(F.col("_pp").isNotNull(), "page heading")
    return out.select(key, F.coalesce("_po", "_pp", F.lit(1)).alias("page"), reason.alias("reason"))


#: Windows of passages have a power of two of bytes, so many at most.
_WIDEST = 512
#: A passage sets so many bits of the filter, of so many a passage and so many at most (128 MB).
_PROBES, _ROOM, _MOST_BITS = 4, 32, 1 << 30
#: Bytes looked at together; longer texts in parts.
_SHARE = 1 << 20
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shares(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, n + 1 places where its texts begin and end) of rows of a column; the parts of a long text overlap by a window."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, row = column.buffers()[2], 0
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + _SHARE, "right")) - 1)
        for begin in range(at[row], at[end], _SHARE):
            until = min(at[end], begin + _SHARE + _WIDEST - 1)
            yield row, data[begin:until], np.clip(at[row : end + 1], begin, until) - begin
        row = end


def _windows(data: np.ndarray, widths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, digests) of all windows of each width, by doubling; windows may run over the ends of texts."""
    h, width = _BYTE[data], 1
    while width <= max(widths, default=0) and len(h):
        if width in widths:
            yield width, h
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2


def _bits(a: np.ndarray, probe: int, size: int) -> np.ndarray:
    return (_mixed(a + np.uint64(probe * _BASE % (1 << 64))) & np.uint64(size - 1)).astype(np.int64)


def _marked_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids, the width of the widest window that a passage holds, and the digest of its first such window."""
    for batch in batches:
        k = batch.column("_k").to_numpy().view(np.uint64)
        widths, a = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.uint64)
        for row, data, at in _shares(batch.column("text")):
            rows = slice(row, row + len(at) - 1)
            widths[rows] = width = np.minimum(2 ** np.floor(np.log2(np.diff(at))).astype(np.int64), _WIDEST)
            for n, h in _windows(data, set(width.tolist())):
                own = width == n
                a[rows][own] = _mixed(h[at[:-1][own]] ^ _mixed(k[rows][own] + np.uint64(n)))
        yield pa.record_batch([*batch.columns[:2], pa.array(widths), pa.array(a.view(np.int64))], [*batch.schema.names[:2], "_n", "_a"])


def _passage_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("_a").to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(np.unique(np.concatenate([_bits(a, i, size) for i in range(_PROBES)])))], ["bit"])

    return run


def _marked_texts(filter_, widths: set[int], size: int):
    """The id of a text and each digest of its windows that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            k = batch.column("_k").to_numpy().view(np.uint64)
            for row, data, at in _shares(batch.column("text")):
                of, end = np.repeat(np.arange(row, row + len(at) - 1), np.diff(at)), np.repeat(at[1:], np.diff(at))
                for n, h in _windows(data, widths):
                    whole = np.arange(n, n + len(h)) <= end[: len(h)]
                    i = of[: len(h)][whole]
                    a = _mixed(h[whole] ^ _mixed(k + np.uint64(n))[i])
                    for probe in range(_PROBES):
                        b = _bits(a, probe, size)
                        there = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                        i, a = i[there], a[there]
                    order = np.lexsort((a, i))
                    i, a = i[order], a[order]
                    new = np.append(True, (i[1:] != i[:-1]) | (a[1:] != a[:-1]))[: len(i)]
                    yield pa.record_batch([batch.column(0).take(pa.array(i[new])), pa.array(a[new].view(np.int64))], [batch.schema.names[0], "_a"])

    return run


def contained(passages: DataFrame, texts: DataFrame, key: str, passage_id: str, text_id: str) -> DataFrame:
    """(key, passage_id, text_id): passages (key, id, text) that stand in a text of their key (JON07).

    Instead of comparing all pairs, a passage is looked up by its first bytes, as many as the greatest power of two that it holds (512 at most), so
    by more than half of it as a rule, and the pairs found are checked sign by sign.  Texts give the digest of every window of these
    widths; a Bloom filter of the passages' digests is sent to the tasks, so only windows that may begin a passage are shuffled.
    Blank passages stand in no text.
    """
    spark = passages.sparkSession
    # the same conditions as the joins below have, so that each table is shuffled once for both of its uses
    p = passages.where(F.col(key).isNotNull() & F.col(passage_id).isNotNull() & ~T.is_blank(F.col("text"))).select(key, passage_id, "text")
    t = texts.where(F.col(key).isNotNull() & F.col(text_id).isNotNull() & (F.col("text") != "")).select(key, text_id, "text")
    own, other = p.schema, t.schema
    marks = StructType([own[key], own[passage_id], StructField("_n", LongType()), StructField("_a", LongType())])
    marks = checkpointed(p.select(key, passage_id, F.substring("text", 1, _WIDEST).alias("text"), F.xxhash64(key).alias("_k")).mapInArrow(_marked_passages, marks))
    counts = marks.groupBy("_n").count().collect()
    size = min(_MOST_BITS, max(1 << 15, 1 << (_ROOM * sum(r["count"] for r in counts)).bit_length()))
    bits = marks.select("_a").mapInArrow(_passage_bits(size), "bit bigint")
    pages = bits.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("bigint"))).alias("bits"))
    filter_ = bytearray(size // 8)
    for r in pages.toLocalIterator():
        filter_[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    found = _marked_texts(spark.sparkContext.broadcast(bytes(filter_)), {r["_n"] for r in counts}, size)
    hits = t.select(text_id, "text", F.xxhash64(key).alias("_k")).mapInArrow(found, StructType([other[text_id], StructField("_a", LongType())]))
    pairs = marks.select(key, passage_id, "_a").join(hits, "_a").select(key, passage_id, text_id)
    full = pairs.join(p.withColumnRenamed("text", "_pt"), [key, passage_id]).join(t.withColumnRenamed("text", "_tt"), [key, text_id])
    return full.where(F.contains("_tt", "_pt")).select(key, passage_id, text_id).distinct()
