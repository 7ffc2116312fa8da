"""Problem 3: lines repeated across the books of one folder.

The text of a block is cut by content: wherever a rolling hash over the last ``WINDOW`` signs of the normalised text is
small, a chunk ends.  Line breaks are blanks to it, so a chunk runs over them, and a repeated passage
gives the same chunks wherever its lines break or stand.  All hashes are differences of one prefix sum per batch.  Distinct
books are counted per chunk and folder; chunks of at least ``MIN_BOOKS`` books are excessive, and runs of them are the
repeated passages.  A line is taken out if all chunks that lie in it are excessive; a line too short to hold a
whole chunk is a chunk of its own.  What is left is checked once more by the digest of the whole line.

Counting needs one shuffle and no group is large: a task passes on at most MIN_BOOKS books of each chunk of a batch, which
can't change whether MIN_BOOKS are reached.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import map_columns, sent_if_small, spoken_blocks
from folioflow.sources.tables import checkpointed, jobs_once

MIN_BOOKS = 5
MIN_LETTERS = 12
WINDOW = 8
#: A cut after about so many signs.
MEAN_CHUNK = 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGES = re.compile(r"[^\S\n]*\n[^\S\n]*")
_DIGITS = re.compile("[0-9]+")


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str) -> str:
    """Lines trimmed, in lower case, each run of digits one sign."""
    return _DIGITS.sub("\x01", _EDGES.sub("\n", "\n" + text.lower() + "\n"))[1:-1]


class Chunks:
    """The chunks and lines of a list of texts."""

    def __init__(self, texts: list[str]):
        with np.errstate(over="ignore"):
            counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
            self.text = normalised("\n".join(texts)) + "\n"
            signs = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
            n = len(signs)
            power, self._inverse = _power_tables(n + 1)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_mixed(np.where(signs == 10, np.uint32(32), signs)) * power[:n], out=self._sums[1:])
            #: first and last place of each line, the text it is of, and its number there from 1
            self.ends = np.flatnonzero(signs == 10)
            self.starts = np.concatenate([[0], self.ends[:-1] + 1])
            self.owner = np.repeat(np.arange(len(texts)), counts)
            self.number = np.arange(len(self.ends)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
            letters = np.concatenate([[0], np.cumsum(_letters()[signs])])
            self.enough = letters[self.ends] - letters[self.starts] >= MIN_LETTERS
            # cuts: windows inside one text, and the edges of the texts
            bounds = np.concatenate([[0], self.ends[np.cumsum(counts) - 1] + 1]) if len(texts) else np.zeros(1, np.int64)
            at = np.arange(WINDOW, n)
            rolling = _mixed((self._sums[at] - self._sums[at - WINDOW]) * self._inverse[at - WINDOW])
            cuts = at[rolling < np.uint64((1 << 64) // MEAN_CHUNK)]
            cuts = cuts[cuts - WINDOW >= bounds[np.searchsorted(bounds, cuts, "right") - 1]]
            places = np.union1d(cuts, bounds)
            #: first place, end and hash of each chunk
            self.a, self.b = places[:-1], places[1:]
            self.hash = self.digest(self.a, self.b)
            #: the line each chunk lies in with the window before it, so that nothing outside the line sets its edges; else -1
            line = np.searchsorted(self.ends, self.a)
            line = np.minimum(line, len(self.ends) - 1)
            whole = (self.b <= self.ends[line]) & (self.a - WINDOW >= self.starts[line])
            self.line = np.where(whole, line, -1)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self._sums[b] - self._sums[a]) * self._inverse[a] + (b - a).astype(np.uint64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, first, end) for every line with enough letters: its chunks are first to end of ``own``."""
        inside = np.flatnonzero(self.line >= 0)
        inside = inside[self.enough[self.line[inside]]]
        count = np.bincount(self.line[inside], minlength=len(self.ends))
        alone = np.flatnonzero(self.enough & (count == 0))
        line = np.concatenate([self.line[inside], alone])
        keys = np.concatenate([self.hash[inside], self.digest(self.starts[alone], self.ends[alone])])
        order = np.argsort(line, kind="stable")
        self.own = keys[order]
        every, first = np.unique(line[order], return_index=True)
        return every, first, np.append(first[1:], len(order))


def _keyed(hashes: np.ndarray, folders: np.ndarray) -> np.ndarray:
    """A chunk's key in a folder."""
    return _mixed(hashes ^ folders.astype(np.uint64)).view(np.int64)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, folder, text) of spoken blocks in books with a folder."""
    folders = checkpointed(jobs_once(spark, sf_dir, "folder").where(F.col("folder").isNotNull()).select("book", F.xxhash64("folder").alias("folder")))
    return spoken_blocks(spark, sf_dir).join(sent_if_small(folders), "book").select("book", "block_no", "folder", "text")


def _excessive(texts: DataFrame) -> DataFrame:
    """(chunk) keys of at least MIN_BOOKS distinct books, written once."""

    def count(c: dict[str, list]) -> dict[str, list]:
        own = Chunks(c["text"])
        line, first, _ = own.lines()
        alone = np.diff(np.append(first, len(own.own))) == 1  # a line that is a chunk of its own, or has one
        owner = np.concatenate([own.owner[np.searchsorted(own.ends, own.a)], own.owner[line[alone]]])
        hashes = np.concatenate([own.hash, own.own[first[alone]]])
        keys, books = _keyed(hashes, np.array(c["folder"], np.int64)[owner]), np.array(c["book_key"], np.int64)[owner]
        order = np.lexsort((books, keys))
        keys, books = keys[order], books[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (books[1:] != books[:-1])
        keys, books = keys[new], books[new]
        start = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
        nth = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
        few = nth < MIN_BOOKS
        return {"chunk": keys[few], "book": books[few]}

    rows = map_columns(texts.select("folder", F.xxhash64("book").alias("book_key"), "text"), count, "chunk bigint, book bigint")
    once = rows.repartition("chunk").dropDuplicates(["chunk", "book"])
    return checkpointed(once.groupBy("chunk").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_BOOKS).select("chunk"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, line_no) of every line to remove.

    Null texts have no lines; books without folder belong to no site; a block stored twice
    gives its lines once.
    """
    texts = _texts(spark, sf_dir)
    excessive = _excessive(texts)

    def cut(c: dict[str, list]) -> dict[str, list]:
        own = Chunks(c["text"])
        line, first, end = own.lines()
        owner = own.owner[line]
        keys = _keyed(own.own, np.repeat(np.array(c["folder"], np.int64)[owner], end - first))
        digests = [hashlib.blake2b(own.text[a:b].encode("utf-8", "surrogatepass"), digest_size=16).digest() for a, b in zip(own.starts[line].tolist(), own.ends[line].tolist())]
        col = {k: [c[k][i] for i in owner.tolist()] for k in ("folder", "book", "block_no")}
        return col | {"line_no": own.number[line].astype(np.int32), "line": digests, "chunks": [keys[a:b] for a, b in zip(first, end)]}

    lines = map_columns(texts, cut, "folder bigint, book string, block_no int, line_no int, line binary, chunks array<bigint>")
    key = ["folder", "book", "block_no", "line_no", "line"]
    parts = lines.select(*key, F.size(F.array_distinct("chunks")).alias("n"), F.explode(F.array_distinct("chunks")).alias("chunk"))
    hit = parts.join(sent_if_small(excessive), "chunk", "left_semi")
    full = checkpointed(hit.groupBy(*key, "n").agg(F.count_distinct("chunk").alias("hits")).where(F.col("n") == F.col("hits")).select(key))
    books = full.select("folder", "line", "book").distinct().groupBy("folder", "line").agg(F.count("*").alias("books"))
    repeated = checkpointed(books.where(F.col("books") >= MIN_BOOKS).select("folder", "line"))
    return full.join(sent_if_small(repeated), ["folder", "line"], "left_semi").select("book", "block_no", "line_no")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, text): every run of excessive chunks, in the normalised text and cut at chunk edges, wherever lines break.

    So a notice that stands within a longer line, or is wrapped at another place, is seen as well.
    """
    texts = _texts(spark, sf_dir)
    excessive = _excessive(texts)

    def cut(c: dict[str, list]) -> dict[str, list]:
        own = Chunks(c["text"])
        owner = own.owner[np.searchsorted(own.ends, own.a)]
        keys = _keyed(own.hash, np.array(c["folder"], np.int64)[owner])
        owners = owner.tolist()
        return {"book": [c["book"][i] for i in owners], "block_no": [c["block_no"][i] for i in owners], "chunk_no": np.arange(len(owner)) - np.searchsorted(owner, owner), "text": [own.text[a:b] for a, b in zip(own.a.tolist(), own.b.tolist())], "chunk": keys}

    rows = map_columns(texts, cut, "book string, block_no int, chunk_no bigint, text string, chunk bigint")
    hit = rows.join(sent_if_small(excessive), "chunk", "left_semi").dropDuplicates(["book", "block_no", "chunk_no"])
    # runs: the chunk's number less its rank among the hits of its block stays the same
    rank = F.row_number().over(Window.partitionBy("book", "block_no").orderBy("chunk_no"))
    runs = hit.withColumn("run", F.col("chunk_no") - rank).groupBy("book", "block_no", "run").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("a"))
    return runs.select("book", "block_no", F.array_join(F.col("a.text"), "").alias("text"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, text): spoken blocks without their folder's repeated lines.

    A block of which nothing but blanks is left has no row.
    """
    drop = found(spark, sf_dir).groupBy("book", "block_no").agg(F.collect_set("line_no").alias("gone"))
    blocks = spoken_blocks(spark, sf_dir).dropDuplicates(["book", "block_no"]).join(drop, ["book", "block_no"], "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(gone, i + 1)), '\\n')")
    out = blocks.select("book", "block_no", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
    return out.where(F.col("text").rlike(r"\S"))


FOUND_SQL = rf"""
WITH j AS (SELECT DISTINCT id, folder FROM jobs WHERE folder IS NOT NULL),
b AS (SELECT DISTINCT book, block_no, text FROM blocks WHERE type IN ('body', 'dialogue') AND text IS NOT NULL),
l AS (SELECT book, block_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM b),
n AS (SELECT l.book, block_no, line_no, folder, regexp_replace(lower(regexp_replace(line, '^\s+|\s+$', '', 'g')), '[0-9]+', chr(1), 'g') AS line
      FROM l JOIN j ON j.id = l.book WHERE length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= {MIN_LETTERS}),
r AS (SELECT folder, line FROM n GROUP BY folder, line HAVING count(DISTINCT book) >= {MIN_BOOKS})
SELECT DISTINCT n.book, n.block_no, CAST(n.line_no AS INTEGER) AS line_no FROM n JOIN r ON n.folder = r.folder AND n.line = r.line
"""

CLEANED_SQL = rf"""
WITH f AS ({FOUND_SQL}),
b AS (SELECT DISTINCT book, block_no, text FROM blocks WHERE type IN ('body', 'dialogue') AND text IS NOT NULL),
l AS (SELECT book, block_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM b),
k AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book = l.book AND f.block_no = l.block_no AND f.line_no = l.line_no)),
t AS (SELECT book, block_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM k GROUP BY book, block_no)
SELECT book, block_no, text FROM t WHERE regexp_matches(text, '\S')
"""
