"""Blocks -> the plan of pieces to narrate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.ordered import running_sum
from folioflow.sources.tables import checkpointed

CEILING = 400
# Milliseconds of silence by kind of job.
PAUSES = {
    "A": {"gap_ms": 150, "block_gap_ms": 650, "heading_before_ms": 200, "heading_after_ms": 150},
    "B": {"gap_ms": 50, "block_gap_ms": 100, "heading_before_ms": 200, "heading_after_ms": 150},
}


def pack_text(c: Column, ceiling: int = CEILING) -> Column:
    """Array of pieces: sentences packed up to ``ceiling`` signs (FLD01).

    A longer sentence is packed by clauses, and its last clauses go on collecting sentences; a longer clause stays whole.
    """

    def state(out: Column, now: Column) -> Column:
        return F.struct(out.alias("out"), now.alias("now"))

    def push(out: Column, x: Column) -> Column:
        return F.when(x != "", F.concat(out, F.array(x))).otherwise(out)

    def add(s: Column, x: Column) -> Column:
        more = F.when(s["now"] == "", x).otherwise(F.concat_ws(" ", s["now"], x))
        return F.when(F.length(more) <= ceiling, state(s["out"], more)).otherwise(state(push(s["out"], s["now"]), x))

    def sentence(s: Column, x: Column) -> Column:
        more = F.when(s["now"] == "", x).otherwise(F.concat_ws(" ", s["now"], x))
        closed = state(push(s["out"], s["now"]), F.lit(""))
        by_clause = F.aggregate(T.split_clauses(x), closed, add)
        return F.when(F.length(more) <= ceiling, state(s["out"], more)).when(F.length(x) > ceiling, by_clause).otherwise(state(push(s["out"], s["now"]), x))

    start = state(F.array().cast("array<string>"), F.lit(""))
    return F.aggregate(T.split_sentences(c), start, sentence, lambda s: push(s["out"], s["now"]))


def _pauses(path: Column, what: str) -> Column:
    out = F.raise_error(F.concat(F.lit("no pauses for path "), F.coalesce(path, F.lit("null")))).cast("int")
    for k, v in PAUSES.items():
        out = F.when(path == k, F.lit(v[what])).otherwise(out)
    return out


def build_plan(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(book, chunk_idx, block_no, text, before_ms, after_ms, heading, source_page, source_page_end) (PLN01).

    ``paths`` gives each book's path; books without one have no plan, another path than A and B is an error.
    A heading is one piece; the last piece of a block is followed by the block gap, except in a book's last
    block, blank ones counted.  chunk_idx counts from 0 and is numbered by prefix sums over the blocks.
    """
    last = blocks.groupBy("book").agg(F.max("block_no").alias("_last"))
    text = T.normalize_quoted_ellipsis(T.strip(F.col("text")))
    rows = blocks.where(F.col("text").isNotNull()).withColumn("text", text).where(F.col("text") != "")
    rows = rows.join(last, "book").join(paths.select("book", "path"), "book")
    rows = rows.withColumn("_parts", F.when(F.col("type") == "heading", F.array("text")).otherwise(pack_text(F.col("text"))))
    # packed once: the numbering reads the pieces' counts first
    rows = checkpointed(rows.select("book", "block_no", "type", "path", "_last", "source_page", "source_page_end", "_parts"))
    rows = running_sum(rows, "book", "block_no", F.size("_parts"), "_before")
    out = rows.select("*", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_i", "_piece"))
    head, end = F.col("type") == "heading", F.col("_i") == F.col("_n") - 1
    gap = F.when(F.col("block_no") == F.col("_last"), 0).otherwise(_pauses(F.col("path"), "block_gap_ms"))
    return out.select(
        "book",
        (F.col("_before") + F.col("_i")).cast("int").alias("chunk_idx"),
        "block_no",
        F.col("_piece").alias("text"),
        F.when(head, _pauses(F.col("path"), "heading_before_ms")).otherwise(0).alias("before_ms"),
        F.when(head, _pauses(F.col("path"), "heading_after_ms") + gap).when(end, gap).otherwise(_pauses(F.col("path"), "gap_ms")).alias("after_ms"),
        F.when(head, F.col("_piece")).alias("heading"),
        "source_page",
        "source_page_end",
    )


def spans(parts: Column) -> Column:
    """Array of (start, end) of parts joined by single blanks (PLN05)."""
    ends = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x) + 1)
    return F.transform(parts, lambda x, i: F.struct(ends(i).alias("start"), (ends(i) + F.length(x)).alias("end")))


def plan_hash(plan: DataFrame, key: str, order: str, columns: list[str], width: int = 4096) -> DataFrame:
    """(key, digest): SHA-256 over the rows in order, of the given columns only (AGG21).

    Rows are hashed in blocks of ``width`` orders and the blocks' digests once more, so no task
    holds the text of a whole key.  A row is the JSON array of its values, so null isn't empty and no sign in a value divides it.
    """
    row = F.to_json(F.array(*(F.col(c).cast("string") for c in columns)), {"ignoreNullFields": "false"})
    rows = plan.select(key, F.col(order).alias("_o"), F.floor(F.col(order) / width).cast("bigint").alias("_b"), F.sha2(row, 256).alias("_h"))
    joined = lambda o, h: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, h))), lambda r: r[h]), chr(30))
    blocks = rows.groupBy(key, "_b").agg(F.sha2(joined("_o", "_h"), 256).alias("_h"))
    return blocks.groupBy(key).agg(F.sha2(joined("_b", "_h"), 256).alias("digest"))


def pack_paragraphs(c: Column, ceiling: int = CEILING) -> Column:
    """Array of (text, end_of_paragraph): every paragraph of an array packed by itself (FLD01b)."""
    one = lambda p: F.transform(pack_text(p, ceiling), lambda x, i: F.struct(x.alias("text"), i.alias("i")))
    marked = lambda a: F.transform(a, lambda r: F.struct(r["text"].alias("text"), (r["i"] == F.size(a) - 1).alias("end_of_paragraph")))
    return F.flatten(F.transform(c, lambda p: marked(one(p))))


def identity(digests: DataFrame, jobs: DataFrame, key: str, parts: list[str], version: str) -> DataFrame:
    """(key, identity): SHA-256 over a plan's digest, the named columns of its job (null as empty) and the planner's version (AGG21)."""
    own = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return digests.join(jobs.select(key, *parts), key).select(key, F.sha2(F.to_json(F.array("digest", *own, F.lit(version))), 256).alias("identity"))


def staleness(new: DataFrame, old: DataFrame, key: str, prefix: str = "v2:") -> DataFrame:
    """(key, state): fresh without an old digest, current if it is equal, else stale (AGG22).

    Old digests with the prefix are compared with ``digest``, those without, of an earlier form, with ``legacy`` where ``new`` has such a column.
    """
    legacy = F.col("legacy") if "legacy" in new.columns else F.col("digest")
    both = new.select(key, "digest", legacy.alias("_legacy")).join(old.select(key, F.col("digest").alias("_old")), key, "left")
    same = F.when(F.col("_old").startswith(prefix), F.col("_old") == F.concat(F.lit(prefix), F.col("digest"))).otherwise(F.col("_old") == F.col("_legacy"))
    return both.select(key, F.when(F.col("_old").isNull(), "fresh").when(same, "current").otherwise("stale").alias("state"))
