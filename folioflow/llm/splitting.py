"""Problem 4: cutting oversized items at natural boundaries.

A text (a column, or a file of any size) is handled in ranges, and every oversized item goes the same way, whatever
its size.  The edge of a range is moved to the next letter or digit, which no boundary mark can hold, so a
mark is seen whole in one range: for that a worker reads a halo beyond its range, and more if the halo has no letter.  Workers
detect the boundaries of ranges; boundary tables are stitched in order, lengths being summed as they pass;
pieces are offsets, and each is cut out of the ranges it lies in.  No worker holds more than one range and the open piece
(and, for a column, the row that the range comes from).
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.sources.tables import checkpointed, table

#: Code points of one range of a column, bytes of one range of a file, and bytes that are read beyond it at first.
RANGE = 1024
RANGE_BYTES = 64 << 20
HALO = 256

# Boundaries by strength; each match ends where a cut may be made.
_CLOSE = "”»›)\\]’'\"」』）】"
_BOUNDARY = re.compile(
    rf"(?P<p>\n\s*)|(?P<s>[.!?…।॥]+[{_CLOSE}]*\s+|[。！？]+[{_CLOSE}]*\s*)|(?P<c>[,;:—–][{_CLOSE}]*\s+|[，、；：]\s*)|(?P<w>\s+)"
)
_STRENGTH = {"p": 4, "s": 3, "c": 2, "w": 1}
#: Characters that a cut may not stand before: they belong to the sign before them.
_BOUND = re.compile("[\\u0300-\\u036f\\u0483-\\u0489\\u0591-\\u05bd\\u064b-\\u065f\\u0900-\\u0903\\u093a-\\u094f\\u0e31\\u0e34-\\u0e3a\\u0e47-\\u0e4e\\u200c\\u200d\\u20d0-\\u20ff\\u3099\\u309a\\ufe00-\\ufe0f]")


#: A range may begin with such a sign: no boundary holds it.
_PLAIN = re.compile(r"[^\W_]")


def boundaries(text: str, at: int) -> list[tuple[int, int]]:
    """(place, strength) of the cuts in a range that begins at place ``at`` of its item."""
    return [(at + m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text)]


def joined(text: str, at: int) -> list[int]:
    """Places of a range that a cut may not stand at."""
    return [at + m.start() for m in _BOUND.finditer(text)]


def edges(text: str, size: int) -> list[int]:
    """Where the ranges of a text begin, and its end; every range begins with a letter or digit, but for the first."""
    out, n = [0], len(text)
    while (m := _PLAIN.search(text, out[-1] + size)) is not None:
        out.append(m.start())
    return [*out, n]


class Stitch:
    """Folds the boundary tables of one item, in order, into pieces (start, end)."""

    def __init__(self, limit: int, overlap: int):
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError("the limit must be positive and the overlap below it")
        self.limit, self.overlap = limit, overlap
        self.start = self.cut = self.known = 0
        self.places: list[int] = []
        self.strengths: list[int] = []
        self.joined: list[int] = []

    def add(self, marks: list[tuple[int, int]], known: int, joined: list[int], last: bool) -> Iterator[tuple[int, int]]:
        """The pieces that are settled when everything up to ``known`` has been seen; ``joined`` ascends."""
        k = bisect_right(self.places, self.start)
        self.places, self.strengths = self.places[k:], self.strengths[k:]
        self.places += [p for p, _ in marks]
        self.strengths += [s for _, s in marks]
        self.joined = self.joined[bisect_right(self.joined, self.start) :] + joined
        self.known = known
        while self.known - self.start > self.limit:
            start = self.start
            yield start, self._next()
        if last and (self.known > self.cut or not self.cut):
            yield self.start, self.known

    def _is_joined(self, place: int) -> bool:
        k = bisect_left(self.joined, place)
        return k < len(self.joined) and self.joined[k] == place

    def _window(self, after: int, upto: int) -> list[tuple[int, int]]:
        """(strength, place) of the marks with after < place <= upto."""
        i, j = bisect_right(self.places, after), bisect_right(self.places, upto)
        return list(zip(self.strengths[i:j], self.places[i:j]))

    def _next(self) -> int:
        a, most = self.start, self.start + self.limit
        inside = self._window(self.cut, most)
        far = [x for x in inside if x[1] > max(self.cut, a + self.limit // 2)]
        if far:
            strong = max(s for s, _ in far)
            end = max(p for s, p in far if s == strong)
        elif inside:
            end = inside[-1][1]
        else:
            end = most
            while end > self.cut + 1 and self._is_joined(end):
                end -= 1
        # the next piece begins at the first good place that repeats at most ``overlap``
        least = max(end - self.overlap, a + 1)
        starts = self._window(least - 1, end - 1)
        if starts:
            strong = max(s for s, _ in starts)
            begin = min(p for s, p in starts if s == strong)
        elif not self._window(a, end):  # a text without blanks
            begin = least
            while begin < end and self._is_joined(begin):
                begin += 1
        else:
            begin = end
        self.start, self.cut = begin, end
        return end


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, as one range."""
    if not text:
        return []
    return list(Stitch(limit, overlap).add(boundaries(text, 0), len(text), joined(text, 0), True))


def ranges_of(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """(keys, _limit, _overlap, _n, _r, _at, _part): the ranges of every item longer than its limit, spread over the workers and written once."""
    long = items.where(F.length(text) > F.col(limit)).select(*keys, F.col(limit).cast("int").alias("_limit"), F.col(overlap).cast("int").alias("_overlap"), F.length(text).cast("bigint").alias("_n"), F.col(text).alias("_t"))
    fixed = [*keys, "_limit", "_overlap", "_n"]
    kind = StructType([*long.select(*fixed).schema.fields, *StructType.fromDDL("_r int, _at bigint, _part string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("_t").to_pylist()):
                at = edges(t, RANGE)
                for k in range(0, len(at) - 1, 4096):
                    some = list(zip(at[k:], at[k + 1 : k + 4097]))
                    picked = batch.select(fixed).take(pa.array([i] * len(some), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(range(k, k + len(some)), pa.int32()), pa.array([a for a, _ in some], pa.int64()), pa.array([t[a:b] for a, b in some], pa.string())], [*fixed, "_r", "_at", "_part"])

    return checkpointed(long.mapInArrow(cut, kind).repartition(*keys, "_r"))


def piece_table(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, piece_no, start, end, _from, _to): pieces by offset, with the first and last range they lie in."""
    fixed = [*keys, "_limit", "_overlap", "_n", "_r"]
    kind = StructType([*ranges.select(*fixed).schema.fields, *StructType.fromDDL("_at bigint, _known bigint, _places array<bigint>, _strengths array<int>, _joined array<bigint>").fields])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, parts = batch.column("_at").to_pylist(), batch.column("_part").to_pylist()
            marks = [boundaries(p, a) for a, p in zip(ats, parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(fixed).columns, pa.array(ats, pa.int64()), pa.array([a + len(p) for a, p in zip(ats, parts)], pa.int64()),
                    pa.array([[x for x, _ in m] for m in marks], pa.list_(pa.int64())), pa.array([[x for _, x in m] for m in marks], pa.list_(pa.int32())), pa.array([joined(p, a) for a, p in zip(ats, parts)], pa.list_(pa.int64())),
                ],
                [*fixed, "_at", "_known", "_places", "_strengths", "_joined"],
            )

    out_kind = StructType([*ranges.select(*keys).schema.fields, *StructType.fromDDL("piece_no int, start bigint, end bigint, _from int, _to int").fields])
    out_schema = to_arrow_schema(out_kind)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, no, starts = None, None, 0, []
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now or row["_r"] == 0:
                    now, fold, no, starts = key, Stitch(row["_limit"], row["_overlap"]), 0, []
                starts = [x for x in starts if x[1] > fold.start] + [(row["_at"], row["_known"], row["_r"])]
                for s, e in fold.add(list(zip(row["_places"], row["_strengths"])), row["_known"], row["_joined"], row["_known"] == row["_n"]):
                    no += 1
                    first, last = (next(r for a, b, r in starts if a <= x < b) for x in (s, e - 1))
                    rows.append(dict(zip(keys, key)) | {"piece_no": no, "start": s, "end": e, "_from": first, "_to": last})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    return ranges.mapInArrow(detect, kind).repartition(*keys).sortWithinPartitions(*keys, "_r").mapInArrow(stitch, out_kind)


def split_column(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """(keys, piece_no, start, end, text): pieces of every item longer than its limit; keys are unique.

    ``limit`` and ``overlap`` are columns.  piece_no counts from 1; start and end are code
    points of the item; without the repeated parts the pieces join to the item.  Items within the
    limit, and null texts, have no pieces.  A piece is put together from the ranges it lies in.
    """
    ranges = ranges_of(items, keys, text, limit, overlap)
    pieces = piece_table(ranges, keys).withColumn("_r", F.explode(F.sequence("_from", "_to"))).alias("p")
    parts = ranges.select(*keys, "_r", "_at", "_part").alias("r")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = pieces.join(parts, [*on, F.col("p._r") == F.col("r._r")]).select(*(F.col(f"p.{k}") for k in (*keys, "piece_no", "start", "end", "_from", "_to", "_r")), "_at", "_part")
    inside = F.expr("substring(_part, int(greatest(start - _at, 0L)) + 1, int(end - greatest(start, _at)))")
    one = both.where("_from = _to").select(*keys, "piece_no", "start", "end", inside.alias("text"))
    several = both.where("_from < _to").groupBy(*keys, "piece_no", "start", "end").agg(F.array_sort(F.collect_list(F.struct("_r", inside.alias("x")))).alias("a"))
    return one.unionByName(several.select(*keys, "piece_no", "start", "end", F.array_join(F.col("a.x"), "").alias("text")))


def _decode(data: bytes) -> str:
    """UTF-8, with every byte that isn't as one sign, so that signs and bytes can be counted against each other."""
    return data.decode("utf-8", "surrogateescape")


def _bytes_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _edge(f, nominal: int, size: int) -> int:
    """The byte of the first letter or digit at or after ``nominal``, or the size: the same for whoever looks."""
    if nominal <= 0:
        return 0
    halo = HALO
    while nominal < size:
        f.seek(nominal)
        data = f.read(halo)
        skip = next((i for i, b in enumerate(data) if b & 0xC0 != 0x80), len(data))
        # a sign that the halo cuts is left for the longer look
        text = _decode(data[skip:])
        for m in _PLAIN.finditer(text):
            return nominal + skip + _bytes_of(text[: m.start()])
        if nominal + halo >= size:
            return size
        halo *= 4
    return size


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start, end, text) of UTF-8 files of any size on storage all workers see.

    The limit and the overlap are signs, start and end are bytes.  A byte that isn't UTF-8 counts as one sign and reads as U+FFFD.
    Every worker reads only its range and halo, then only the ranges of the pieces it emits.
    """
    sizes = [(p, os.path.getsize(p)) for p in dict.fromkeys(paths)]
    work = [(p, k, n) for p, n in sizes for k in range(-(-n // range_bytes))]
    if not work:
        return spark.createDataFrame([], "path string, piece_no int, start bigint, end bigint, text string")
    df = spark.createDataFrame(work, "path string, r int, n bigint").repartition(min(len(work), 10_000), "path", "r")
    mark_kind = StructType.fromDDL("path string, r int, last boolean, first_byte bigint, end_byte bigint, signs bigint, places array<bigint>, strengths array<int>, joined array<bigint>")
    mark_arrow = to_arrow_schema(mark_kind)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(row["path"], "rb") as f:
                    a, b = (_edge(f, k * range_bytes, row["n"]) for k in (row["r"], row["r"] + 1))
                    f.seek(a)
                    text = _decode(f.read(b - a)) if b > a else ""
                marks = boundaries(text, 0)
                out = {"path": row["path"], "r": row["r"], "last": (row["r"] + 1) * range_bytes >= row["n"], "first_byte": a, "end_byte": b, "signs": len(text)}
                yield pa.RecordBatch.from_pylist([out | {"places": [x for x, _ in marks], "strengths": [x for _, x in marks], "joined": joined(text, 0)}], schema=mark_arrow)

    piece_kind = StructType.fromDDL("path string, piece_no int, r int, first_byte bigint, end_byte bigint, skip bigint, size bigint")
    piece_arrow = to_arrow_schema(piece_kind)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, no, base, open_ranges = None, None, 0, 0, []
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != now:
                    now, fold, no, base, open_ranges = row["path"], Stitch(limit, overlap), 0, 0, []
                # prefix sum of the lengths: a range's signs begin at ``base``
                open_ranges = [x for x in open_ranges if x[1] > fold.start] + [(base, base + row["signs"], row["r"], row["first_byte"], row["end_byte"])]
                marks = [(base + c, s) for c, s in zip(row["places"], row["strengths"])]
                base += row["signs"]
                for s, e in fold.add(marks, base, [base - row["signs"] + c for c in row["joined"]], row["last"]):
                    no += 1
                    a, _, r, first, end = next(x for x in open_ranges if x[0] <= s < x[1])
                    rows.append({"path": now, "piece_no": no, "r": r, "first_byte": first, "end_byte": end, "skip": s - a, "size": e - s})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=piece_arrow)

    out_kind = StructType.fromDDL("path string, piece_no int, start bigint, end bigint, text string")
    out_arrow = to_arrow_schema(out_kind)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, at, byte = None, "", 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if (row["path"], row["r"]) != now:
                    now, at, byte = (row["path"], row["r"]), 0, row["first_byte"]
                    with open(row["path"], "rb") as f:
                        f.seek(byte)
                        text = _decode(f.read(row["end_byte"] - byte + 4 * limit))
                # pieces of a range come in order, so bytes are counted from the one before
                byte, at = byte + _bytes_of(text[at : row["skip"]]), row["skip"]
                own = text[at : at + row["size"]]
                rows.append({"path": row["path"], "piece_no": row["piece_no"], "start": byte, "end": byte + _bytes_of(own), "text": re.sub("[\udc80-\udcff]", "\ufffd", own)})
            yield pa.RecordBatch.from_pylist(rows, schema=out_arrow)

    marks = df.mapInArrow(detect, mark_kind).repartition("path").sortWithinPartitions("path", "r")
    return marks.mapInArrow(stitch, piece_kind).repartition("path", "r").sortWithinPartitions("path", "r", "piece_no").mapInArrow(emit, out_kind)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a null overlap is none, and an overlap is always below the limit
    limits = table(spark, sf_dir, "split_limits").where("item_table is not null and max_chars > 0").dropDuplicates(["item_table"])
    limits = limits.select("item_table", "max_chars", F.greatest(F.lit(0), F.least(F.coalesce("overlap_chars", F.lit(0)), F.col("max_chars") - 1)).alias("overlap_chars"))
    blocks = table(spark, sf_dir, "blocks").select(F.lit("blocks").alias("item_table"), "book", F.col("block_no").alias("item_no"), "text")
    plan = table(spark, sf_dir, "chunk_plan").select(F.lit("chunk_plan").alias("item_table"), "book", F.col("chunk_idx").alias("item_no"), "text")
    # split_limits has one row per table: its size is fixed
    return blocks.unionByName(plan).join(F.broadcast(limits), "item_table")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_table, book, item_no, piece_no, start, end, text) of the oversized items of both tables.

    Items stored twice are cut once.
    """
    keys = ["item_table", "book", "item_no"]
    items = _items(spark, sf_dir).where(F.length("text") > F.col("max_chars")).dropDuplicates(keys)
    return split_column(items, keys, "text", "max_chars", "overlap_chars")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_table, book, item_no): items that came out as more than one piece; null texts have no row."""
    keys = ["item_table", "book", "item_no"]
    items = _items(spark, sf_dir).where(F.length("text") > F.col("max_chars")).dropDuplicates(keys)
    return piece_table(ranges_of(items, keys, "text", "max_chars", "overlap_chars"), keys).where(F.col("piece_no") == 2).select(*keys)


def rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_table, book, item_no, text): every oversized item put together again from its pieces without their repeated parts."""
    keys = ["item_table", "book", "item_no"]
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "text")))
    rows = pieces(spark, sf_dir).groupBy(*keys).agg(parts.alias("a"))
    new = F.expr("transform(a, (x, i) -> if(i = 0, x.text, substring(x.text, int(a[i - 1].end - x.start) + 1, int(x.end - a[i - 1].end))))")
    return rows.select(*keys, F.array_join(new, "").alias("text"))


FOUND_SQL = """
SELECT DISTINCT 'blocks' AS item_table, book, block_no AS item_no FROM blocks
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_table = 'blocks')
UNION ALL
SELECT DISTINCT 'chunk_plan', book, chunk_idx FROM chunk_plan
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_table = 'chunk_plan')
"""

REJOINED_SQL = """
SELECT DISTINCT 'blocks' AS item_table, book, block_no AS item_no, text FROM blocks
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_table = 'blocks')
UNION ALL
SELECT DISTINCT 'chunk_plan', book, chunk_idx, text FROM chunk_plan
WHERE length(text) > (SELECT max_chars FROM split_limits WHERE item_table = 'chunk_plan')
"""
