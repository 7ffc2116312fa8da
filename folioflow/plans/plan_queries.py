"""Queries of planning, scheduling and timelines over blocks, chunk_plan, segments and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import planning, schedule, timeline
from folioflow.operators.metrics import median_of_counts
from folioflow.operators.ordered import running_sum, running_sums
from folioflow.plans import sqlgen as S
from folioflow.plans.text_queries import blocks_once
from folioflow.sources.tables import checkpointed, jobs_once, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def plan_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_plan").dropDuplicates(["book", "chunk_idx"])


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last written segment with frames of each piece."""
    rows = table(spark, sf_dir, "segments").where(F.col("frames").isNotNull() & F.col("sr").isNotNull())
    order = [F.desc_nulls_last("written_at"), F.desc_nulls_last("loaded_at"), F.desc("frames"), F.desc("sr")]
    return schedule.latest(rows, ["book", "chunk_idx"], order)


DONE = """(SELECT book, chunk_idx, frames, sr FROM (SELECT *, row_number() OVER (PARTITION BY book, chunk_idx ORDER BY written_at DESC NULLS LAST, loaded_at DESC NULLS LAST, frames DESC, sr DESC) AS r
 FROM segments WHERE frames IS NOT NULL AND sr IS NOT NULL) WHERE r = 1)"""


def pack_sql(x: str) -> str:
    """The packer as two nested list folds."""
    push = lambda a, v: f"(CASE WHEN {v} <> '' THEN list_append({a}, {v}) ELSE {a} END)"
    more = lambda a, v: f"(CASE WHEN {a}.c = '' THEN {v} ELSE {a}.c || ' ' || {v} END)"
    wrap = lambda lst: f"list_transform({lst}, lambda w: {{'o': []::VARCHAR[], 'c': w}})"
    ceil = planning.CEILING
    inner = f"""list_reduce({wrap(S.clauses('e.c'))}, lambda b, f: CASE WHEN length({more('b', 'f.c')}) <= {ceil} THEN {{'o': b.o, 'c': {more('b', 'f.c')}}} ELSE {{'o': {push('b.o', 'b.c')}, 'c': f.c}} END, {{'o': {push('a.o', 'a.c')}, 'c': ''}})"""
    outer = f"""list_reduce({wrap(S.sentences(x))}, lambda a, e: CASE WHEN length({more('a', 'e.c')}) <= {ceil} THEN {{'o': a.o, 'c': {more('a', 'e.c')}}} WHEN length(e.c) > {ceil} THEN {inner} ELSE {{'o': {push('a.o', 'a.c')}, 'c': e.c}} END, {{'o': []::VARCHAR[], 'c': ''}})"""
    return outer


_PACKED = f"(SELECT doc_id, list_append(p.o, p.c) AS parts FROM (SELECT doc_id, {pack_sql('text')} AS p FROM documents WHERE text IS NOT NULL))"


@query("fld01_pack", f"SELECT doc_id, part, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM {_PACKED}) WHERE part <> ''")
def fld01(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(planning.pack_text(F.col("text"))).alias("i", "part")).select("doc_id", "part", (F.col("i") + 1).alias("pos"))


_STATS = f"""SELECT source, count(*) AS chunks, sum(length(part))::BIGINT AS signs, list_sort(list(length(part)))[count(*) // 2 + 1]::INTEGER AS upper_median, (sum(length(part)) // count(*))::BIGINT AS mean,
 max(length(part))::INTEGER AS longest, count(*) FILTER (length(part) > 400) AS over_ceiling, count(*) FILTER (length(part) < 30) AS short
FROM (SELECT source, unnest(parts) AS part FROM {_PACKED} p JOIN documents d USING (doc_id)) WHERE part <> '' GROUP BY source"""


@query("agg04_chunk_stats", _STATS)
def agg04(spark, d):
    """Pieces of the documents of each source: the flagship query."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    pieces = docs.select("source", F.explode(planning.pack_text(F.col("text"))).alias("part")).select("source", F.length("part").alias("n"))
    # pieces are counted by length first, so no source's lengths are collected
    by_length = pieces.groupBy("source", "n").agg(F.count("*").alias("c"))
    facts = by_length.groupBy("source").agg(
        F.sum("c").alias("chunks"),
        F.sum(F.col("n") * F.col("c")).alias("signs"),
        F.max("n").alias("longest"),
        F.coalesce(F.sum(F.when(F.col("n") > planning.CEILING, F.col("c"))), F.lit(0)).alias("over_ceiling"),
        F.coalesce(F.sum(F.when(F.col("n") < 30, F.col("c"))), F.lit(0)).alias("short"),
    )
    medians = median_of_counts(by_length, ["source"], "n", "c")
    same = facts["source"].eqNullSafe(medians["source"])
    return facts.join(medians, same).select(facts["source"], "chunks", "signs", F.col("median").alias("upper_median"), F.floor(F.col("signs") / F.col("chunks")).alias("mean"), "longest", "over_ceiling", "short")


_TEXT = S.quoted_ellipsis(S.strip("text"))
PLAN_SQL = f"""WITH l AS (SELECT book, max(block_no) AS last FROM {S.BLOCKS} b GROUP BY book),
r AS (SELECT b.book, b.block_no, type, source_page, source_page_end, {_TEXT} AS text FROM {S.BLOCKS} b WHERE text IS NOT NULL),
n AS (SELECT r.*, path, last FROM r JOIN l USING (book) JOIN (SELECT DISTINCT id, path FROM jobs) j ON j.id = r.book WHERE text <> ''),
p AS (SELECT *, CASE WHEN type = 'heading' THEN [text] ELSE (SELECT list_filter(list_append(q.o, q.c), lambda w: w <> '') FROM (SELECT {pack_sql('text')} AS q)) END AS parts FROM n),
x AS (SELECT * EXCLUDE (parts, text), unnest(parts) AS piece, generate_subscripts(parts, 1) AS i, len(parts) AS k FROM p)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY block_no, i) - 1 AS INTEGER) AS chunk_idx, block_no, piece AS text, CASE WHEN type = 'heading' THEN 200 ELSE 0 END AS before_ms,
 CASE WHEN type = 'heading' THEN 150 + CASE WHEN block_no = last THEN 0 WHEN path = 'A' THEN 650 ELSE 100 END WHEN i = k THEN CASE WHEN block_no = last THEN 0 WHEN path = 'A' THEN 650 ELSE 100 END WHEN path = 'A' THEN 150 ELSE 50 END AS after_ms,
 CASE WHEN type = 'heading' THEN piece END AS heading, source_page, source_page_end FROM x"""


def built_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.build_plan(table(spark, sf_dir, "blocks").dropDuplicates(["book", "block_no"]), jobs_once(spark, sf_dir, "path"))


@query("pln01_plan", PLAN_SQL)
def pln01(spark, d):
    return built_plan(spark, d)


_SENT = S.sentences("text")


@query(
    "pln05_spans",
    f"""SELECT book, block_no, CAST(i AS INTEGER) AS part_no, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY book, block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first_sign, length(s)::INTEGER AS signs
 FROM (SELECT book, block_no, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM {S.BLOCKS} b WHERE text IS NOT NULL)""",
)
def pln05(spark, d):
    rows = blocks_once(spark, d).withColumn("parts", T.split_sentences(F.col("text")))
    out = rows.select("book", "block_no", F.posexplode(planning.spans(F.col("parts"))).alias("i", "s"))
    return out.select("book", "block_no", (F.col("i") + 1).alias("part_no"), F.col("s.start").alias("first_sign"), (F.col("s.end") - F.col("s.start")).alias("signs"))


@query(
    "pln06_arms",
    f"""SELECT book, count(*) AS pieces, count(*) FILTER (a.text = b.text) AS same_text, count(*) FILTER (a.after_ms <> b.after_ms) AS other_pause
 FROM {S.PLAN} a JOIN (SELECT book, chunk_idx, text, CASE WHEN after_ms = 650 THEN 900 ELSE after_ms END AS after_ms FROM {S.PLAN} p) b USING (book, chunk_idx) GROUP BY book""",
)
def pln06(spark, d):
    a = plan_once(spark, d)
    b = a.select("book", "chunk_idx", F.col("text").alias("t"), F.when(F.col("after_ms") == 650, 900).otherwise(F.col("after_ms")).alias("p"))
    both = a.join(b, ["book", "chunk_idx"])
    return both.groupBy("book").agg(F.count("*").alias("pieces"), F.count(F.when(F.col("text") == F.col("t"), 1)).alias("same_text"), F.count(F.when(F.col("after_ms") != F.col("p"), 1)).alias("other_pause"))


@query("pln07_shards", f"SELECT book, chunk_idx % 3 AS shard, count(*) AS pieces, sum(length(text))::BIGINT AS signs FROM {S.PLAN} p GROUP BY ALL")
def pln07(spark, d):
    return plan_once(spark, d).groupBy("book", schedule.shard(F.col("chunk_idx"), 3).alias("shard")).agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("signs"))


_FOLD = """list_reduce(list_transform(list(n ORDER BY n, chunk_idx), lambda x: {'o': []::BIGINT[], 'b': -1::BIGINT, 'k': 0::BIGINT, 'x': x}),
 lambda a, e: CASE WHEN a.b >= 0 AND a.k + 1 <= 12 AND (a.k + 1) * e.x <= 1300 THEN {'o': list_append(a.o, a.b), 'b': a.b, 'k': a.k + 1, 'x': e.x} ELSE {'o': list_append(a.o, a.b + 1), 'b': a.b + 1, 'k': 1::BIGINT, 'x': e.x} END,
 {'o': []::BIGINT[], 'b': -1::BIGINT, 'k': 0::BIGINT, 'x': 0::BIGINT}).o"""


@query(
    "fld02_batches",
    f"""WITH s AS (SELECT book, chunk_idx, coalesce(length(text) // 4, 0)::BIGINT AS n FROM {S.PLAN} p), f AS (SELECT book, list(chunk_idx ORDER BY n, chunk_idx) AS c, {_FOLD} AS b FROM s GROUP BY book)
 SELECT book, unnest(c) AS chunk_idx, unnest(b) AS batch_no, generate_subscripts(c, 1) - 1 AS place FROM f""",
)
def fld02(spark, d):
    items = plan_once(spark, d).select("book", "chunk_idx", F.floor(F.length("text") / 4).alias("n"))
    return schedule.batches(items, "book", "chunk_idx", "n").select("book", "chunk_idx", "batch_no", "place")


@query("agg19_batch_sizes", None)
def agg19(spark, d):
    return fld02(spark, d).groupBy("book", "batch_no").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("batches"))


ORACLE_SQL["agg19_batch_sizes"] = f"SELECT rows, count(*) AS batches FROM (SELECT book, batch_no, count(*) AS rows FROM ({ORACLE_SQL['fld02_batches']}) GROUP BY ALL) GROUP BY rows"


@query("fld03_parts", None)
def fld03(spark, d):
    rows = plan_once(spark, d).join(finished(spark, d), ["book", "chunk_idx"])
    secs = F.col("frames") / F.col("sr") + (F.col("before_ms") + F.col("after_ms")) / 1000.0
    rows = rows.select("book", "chunk_idx", secs.alias("seconds"), (~F.col("after_ms").isin(150, 50)).alias("ends_block"))
    return schedule.parts(rows, "book", "chunk_idx", "seconds", "ends_block", 60.0).select("book", "chunk_idx", "part_no")


_SECS = f"SELECT book, chunk_idx, frames / sr + (before_ms + after_ms) / 1000.0 AS s, after_ms NOT IN (150, 50) AS e FROM {S.PLAN} p JOIN {DONE} d USING (book, chunk_idx)"
ORACLE_SQL["fld03_parts"] = f"""WITH r AS ({_SECS}), f AS (SELECT book, list(chunk_idx ORDER BY chunk_idx) AS c,
 list_reduce(list_transform(list({{'s': s, 'e': e}} ORDER BY chunk_idx), lambda x: {{'o': []::BIGINT[], 'p': 1::BIGINT, 't': 0::DOUBLE, 'open': true, 's': x.s, 'e': x.e}}),
 lambda a, x: CASE WHEN a.open THEN {{'o': list_append(a.o, a.p), 'p': a.p, 't': a.t + x.s, 'open': NOT (a.t + x.s >= 60.0 AND x.e), 's': x.s, 'e': x.e}}
  ELSE {{'o': list_append(a.o, a.p + 1), 'p': a.p + 1, 't': x.s, 'open': NOT (x.s >= 60.0 AND x.e), 's': x.s, 'e': x.e}} END, {{'o': []::BIGINT[], 'p': 1::BIGINT, 't': 0::DOUBLE, 'open': true, 's': 0::DOUBLE, 'e': false}}).o AS p FROM r GROUP BY book)
 SELECT book, unnest(c) AS chunk_idx, unnest(p) AS part_no FROM f"""


@query(
    "fld04_first_sound",
    """WITH a AS (SELECT book, chunk_idx, frames, row_number() OVER (PARTITION BY book, chunk_idx ORDER BY written_at, loaded_at, frames) AS attempt FROM (SELECT DISTINCT * FROM segments) WHERE frames IS NOT NULL)
 SELECT book, chunk_idx, count(*) AS attempts, CAST(min(attempt) FILTER (frames < 150000) AS INTEGER) AS sound FROM a GROUP BY book, chunk_idx""",
)
def fld04(spark, d):
    w = Window.partitionBy("book", "chunk_idx").orderBy(F.asc_nulls_last("written_at"), F.asc_nulls_last("loaded_at"), "frames")
    rows = table(spark, d, "segments").distinct().where(F.col("frames").isNotNull()).withColumn("attempt", F.row_number().over(w))
    return schedule.first_sound(rows, ["book", "chunk_idx"], "attempt", F.col("frames"), 150_000)


@query("jon01_todo", f"SELECT book, chunk_idx FROM {S.PLAN} p WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.book = p.book AND s.chunk_idx = p.chunk_idx AND frames IS NOT NULL)")
def jon01(spark, d):
    done = table(spark, d, "segments").where(F.col("frames").isNotNull())
    return schedule.todo(plan_once(spark, d), done, ["book", "chunk_idx"]).select("book", "chunk_idx")


@query("jon02_missing", f"SELECT book, count(*) AS missing, min(chunk_idx) AS first FROM {S.PLAN} p WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.book = p.book AND s.chunk_idx = p.chunk_idx AND frames IS NOT NULL) GROUP BY book")
def jon02(spark, d):
    return schedule.missing(plan_once(spark, d), table(spark, d, "segments").where(F.col("frames").isNotNull()), "book", "chunk_idx")


TIME = f"""(SELECT *, floor(start_sample / sr * 1000)::BIGINT AS start_ms FROM (SELECT *, coalesce(sum(samples) OVER (PARTITION BY book ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_sample
 FROM (SELECT p.*, frames, sr, (floor(sr * before_ms / 1000.0) + frames + floor(sr * after_ms / 1000.0))::BIGINT AS samples FROM {S.PLAN} p JOIN {DONE} d USING (book, chunk_idx))))"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline(plan_once(spark, sf_dir), finished(spark, sf_dir))


@query("win01_timeline", f"SELECT book, chunk_idx, samples, start_sample, start_ms FROM {TIME}")
def win01(spark, d):
    return timed(spark, d).select("book", "chunk_idx", "samples", "start_sample", "start_ms")


STARTS = f"(SELECT book, source_page AS page, arg_min(start_ms, chunk_idx) AS ms FROM {TIME} WHERE source_page IS NOT NULL GROUP BY book, source_page)"


@query("win02_page_start", f"SELECT * FROM {STARTS}")
def win02(spark, d):
    return timeline.page_starts(timed(spark, d))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the blocks as an outline: level 2 where the heading isn't all capitals."""
    rows = blocks_once(spark, sf_dir).where((F.col("type") == "heading") & F.col("source_page").isNotNull())
    return rows.select("book", F.col("block_no").alias("ord"), F.when(F.col("text") == F.upper("text"), 1).otherwise(2).alias("level"), F.col("text").alias("title"), F.col("source_page").alias("page"))


_OUTLINE = f"(SELECT book, block_no AS ord, CASE WHEN text = upper(text) THEN 1 ELSE 2 END AS level, text AS title, source_page AS page FROM {S.BLOCKS} b WHERE type = 'heading' AND text IS NOT NULL AND source_page IS NOT NULL)"
_DIVISION = S.match(S.collapse("title"), S.OUTLINE)
MARKS = f"""(SELECT book, ms AS start_ms, {S.collapse('title')} AS title FROM (SELECT *, row_number() OVER (PARTITION BY book, ms ORDER BY level DESC, ord DESC) AS r FROM
 (SELECT o.*, s.ms FROM (SELECT o.* FROM {_OUTLINE} o JOIN (SELECT book, min(page) AS a, max(page) AS b FROM {STARTS} GROUP BY book) e USING (book) WHERE page BETWEEN a AND b AND ({_DIVISION})) o ASOF JOIN {STARTS} s ON o.book = s.book AND o.page <= s.page)) WHERE r = 1)"""


@query("jon04_asof_forward", f"SELECT book, start_ms, title FROM {MARKS}")
def jon04(spark, d):
    return timeline.outline_marks(outline(spark, d), timeline.page_starts(timed(spark, d)))


SPOKEN = f"(SELECT book, start_ms, heading AS title FROM {TIME} WHERE {S.match('heading', S.CHAPTER)})"
CHOSEN = f"""(WITH o AS (SELECT * FROM {MARKS}), s AS (SELECT * FROM {SPOKEN}), k AS (SELECT coalesce(a.book, b.book) AS book, coalesce(a.n, 0) > coalesce(b.n, 0) AS out_ FROM (SELECT book, count(*) AS n FROM o GROUP BY book) a FULL JOIN (SELECT book, count(*) AS n FROM s GROUP BY book) b ON a.book = b.book)
 SELECT o.* FROM o JOIN k USING (book) WHERE out_ UNION ALL SELECT s.* FROM s JOIN k USING (book) WHERE NOT out_)"""
OPENED = f"(SELECT * FROM {CHOSEN} UNION ALL SELECT book, 0, 'Opening' FROM {CHOSEN} GROUP BY book HAVING min(start_ms) > 1500)"
TOTAL = f"(SELECT book, floor(arg_max(start_sample + samples, chunk_idx) / arg_max(sr, chunk_idx) * 1000)::BIGINT AS total_ms FROM {TIME} GROUP BY book)"
ENDED = f"(SELECT book, start_ms, CASE WHEN e <= start_ms THEN start_ms + 1000 ELSE e END AS end_ms, title FROM (SELECT c.*, coalesce(lead(start_ms) OVER (PARTITION BY book ORDER BY start_ms), total_ms) AS e FROM {OPENED} c JOIN {TOTAL} t USING (book)))"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what is read several times below is written first; marks and chapters are a few rows a book
    rows = checkpointed(timed(spark, sf_dir).select("book", "chunk_idx", "heading", "source_page", "start_sample", "samples", "sr", "start_ms"))
    marks = checkpointed(timeline.outline_marks(outline(spark, sf_dir), timeline.page_starts(rows)))
    chosen = checkpointed(timeline.with_opening(timeline.chosen_chapters(marks, timeline.spoken_chapters(rows))))
    return timeline.chapter_ends(chosen, timeline.totals(rows))


@query("win03_chapters", f"SELECT * FROM {ENDED}")
def win03(spark, d):
    return chapters(spark, d)


@query(
    "snk04_ffmeta",
    f"""SELECT book, concat_ws(chr(10), ';FFMETADATA1', CASE WHEN coalesce({S.strip('title')}, '') <> '' THEN 'title=' || replace({S.sub('title', r'([\\=;#])', chr(92) * 2 + chr(92) + '1')}, chr(10), ' ') END, body) AS text
 FROM (SELECT book, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || replace({S.sub('title', r'([\\=;#])', chr(92) * 2 + chr(92) + '1')}, chr(10), ' '), chr(10) ORDER BY start_ms) AS body FROM {ENDED} GROUP BY book)
 JOIN (SELECT DISTINCT id AS book, title FROM jobs) USING (book)""",
)
def snk04(spark, d):
    return timeline.metadata_text(chapters(spark, d), jobs_once(spark, d, "title"))


_ENDS = f"(SELECT book, floor((start_sample + samples) / sr * 1000)::BIGINT AS stop_at, chunk_idx AS last_chunk FROM {TIME})"


@query(
    "win08_forward_frames",
    f"""WITH l AS (SELECT book, max(stop_at) AS stop, max(last_chunk) AS lc FROM {_ENDS} GROUP BY book)
 SELECT r.book, r.chunk_idx, coalesce(e.last_chunk, lc) AS last_chunk FROM (SELECT book, chunk_idx, start_ms + 30000 AS due, start_ms FROM {TIME}) r JOIN l USING (book) ASOF LEFT JOIN (SELECT book, stop_at, min(last_chunk) AS last_chunk FROM {_ENDS} GROUP BY book, stop_at) e ON r.book = e.book AND r.due <= e.stop_at WHERE stop - start_ms >= 27000""",
)
def win08(spark, d):
    return timeline.forward_frames(timed(spark, d), 30_000)


@query(
    "win09_runs",
    f"""WITH b AS (SELECT book, block_no, row_number() OVER (PARTITION BY book ORDER BY block_no) AS place, sum(length(text)) OVER (PARTITION BY book ORDER BY block_no) AS upto, length(text) AS n FROM {S.BLOCKS} x WHERE text IS NOT NULL)
 SELECT a.book, a.block_no, CAST(e.place - a.place + 1 AS INTEGER) AS blocks, (e.upto - a.upto + a.n)::BIGINT AS signs FROM b a JOIN b e ON a.book = e.book AND e.place BETWEEN a.place AND a.place + 3 WHERE e.upto - a.upto + a.n BETWEEN 300 AND 900""",
)
def win09(spark, d):
    rows = blocks_once(spark, d).select("book", "block_no", F.length("text").cast("bigint").alias("n"))
    rows = running_sums(rows, "book", "block_no", {"place": F.lit(1), "upto": F.col("n")}, inclusive=True)
    first = rows.select("book", "block_no", (F.col("upto") - F.col("n")).alias("base"), "place", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("blocks")).withColumn("last", F.col("place") + F.col("blocks") - 1)
    last = rows.select("book", F.col("place").alias("last"), "upto")
    return first.join(last, ["book", "last"]).withColumn("signs", F.col("upto") - F.col("base")).where(F.col("signs").between(300, 900)).select("book", "block_no", "blocks", "signs")


@query("win10_progress", f"SELECT book, chunk_idx, place FROM (SELECT book, chunk_idx, row_number() OVER (PARTITION BY book ORDER BY chunk_idx) AS place FROM {DONE}) WHERE place % 10 = 0")
def win10(spark, d):
    rows = running_sum(finished(spark, d).select("book", "chunk_idx"), "book", "chunk_idx", F.lit(1), "place", inclusive=True)
    return rows.where(F.col("place") % 10 == 0).select("book", "chunk_idx", F.col("place").cast("bigint").alias("place"))


_ROW = "CAST(to_json([type, text]) AS VARCHAR)"


@query(
    "agg21_plan_hash",
    f"""WITH r AS (SELECT book, block_no, block_no // 4096 AS b, sha256({_ROW}) AS h FROM {S.BLOCKS} x), g AS (SELECT book, b, sha256(string_agg(h, chr(30) ORDER BY block_no)) AS h FROM r GROUP BY book, b)
 SELECT book, sha256(string_agg(h, chr(30) ORDER BY b)) AS digest FROM g GROUP BY book""",
)
def agg21(spark, d):
    return planning.plan_hash(table(spark, d, "blocks").dropDuplicates(["book", "block_no"]), "book", "block_no", ["type", "text"])
