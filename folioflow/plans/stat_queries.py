"""Queries of joins, aggregates, samples and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import arrays as A
from folioflow.functions import text as T
from folioflow.operators import catalog, metrics
from folioflow.operators.ordered import running_sum, running_sums, size_rank
from folioflow.operators.timeline import forward_frames
from folioflow.plans import sqlgen as S
from folioflow.plans.page_queries import PLACED, placed_lines
from folioflow.plans.plan_queries import _ENDS, _OUTLINE, DONE, TIME, finished, outline, plan_once, timed
from folioflow.plans.text_queries import blocks_once
from folioflow.sources import readers
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


# ---- files and jobs


@query(
    "src06_library_once",
    "SELECT path, name, folder FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY folder, path, name) AS r FROM library) WHERE r = 1",
)
def src06(spark, d):
    return catalog.once_by_path(table(spark, d, "library"), [F.col("folder"), F.col("path"), F.col("name")]).select("path", "name", "folder")


@query("src13_tail", "SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def src13(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "event_type").orderBy(F.desc("event_id")).limit(30)


@query("src18_import_names", r"SELECT path, regexp_matches(lower(path), '\.pdf$') AS is_pdf, name || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END AS unique_name FROM (SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM library)")
def src18(spark, d):
    """A number for files of one name; only equal names share a window."""
    r = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    rows = table(spark, d, "library").select("path", "name", r.alias("r"))
    return rows.select("path", F.lower("path").rlike(r"\.pdf$").alias("is_pdf"), F.concat("name", F.when(F.col("r") > 1, F.concat(F.lit(" ("), F.col("r"), F.lit(")"))).otherwise("")).alias("unique_name"))


@query("src22_voices", "SELECT voice, CAST(row_number() OVER (ORDER BY voice <> 'Default', voice) AS INTEGER) AS place FROM (SELECT DISTINCT voice FROM jobs WHERE voice IS NOT NULL UNION SELECT 'Default')")
def src22(spark, d):
    """Voices in use, the default first.  There are few voices, whatever the number of jobs."""
    voices = table(spark, d, "jobs").select("voice").where(F.col("voice").isNotNull()).union(spark.createDataFrame([("Default",)], "voice string")).distinct()
    w = Window.orderBy(F.col("voice") != "Default", "voice")
    return voices.select("voice", F.row_number().over(w).alias("place"))


@query("src16_embedded", f"SELECT book, block_no, type AS role, text, block_no AS after_ms FROM {S.BLOCKS} b WHERE text IS NOT NULL")
def src16(spark, d):
    """Segments read back from a quoted command line: every block with text, written so and recovered."""
    rows = blocks_once(spark, d)
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    command = F.concat(F.lit("say role = "), quote(F.col("type")), F.lit(" text = "), quote(F.col("text")), F.lit(" after_ms = "), F.col("block_no").cast("string"))
    rows = rows.select("book", "block_no", command.alias("c"))
    rows = rows.select("book", "block_no", F.inline(readers.exactly(readers.embedded_segments(F.col("c")), 1)))
    return rows.select("book", "block_no", "role", "text", "after_ms")


@query("src21_validated", f"SELECT book, chunk_idx, CASE WHEN text IS NULL OR {S.strip('text')} = '' THEN 'blank' WHEN after_ms NOT BETWEEN 0 AND 5000 THEN 'after_ms' END AS error FROM {S.PLAN} p")
def src21(spark, d):
    text = F.col("text")
    bad = F.when(text.isNull() | T.is_blank(text), "blank").when(~F.col("after_ms").between(0, 5000), "after_ms")
    return plan_once(spark, d).select("book", "chunk_idx", bad.alias("error"))


@query("jsn02_event_props", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def jsn02(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("jsn01_block_json", f"""SELECT book, block_no, '{{"type":"' || type || '","block_no":' || block_no || ',"page":' || source_page || '}}' AS json FROM {S.BLOCKS} b WHERE source_page IS NOT NULL""")
def jsn01(spark, d):
    rows = table(spark, d, "blocks").where(F.col("source_page").isNotNull()).dropDuplicates(["book", "block_no"])
    return rows.select("book", "block_no", F.to_json(F.struct("type", "block_no", F.col("source_page").alias("page"))).alias("json"))


@query("prd16_inside", "SELECT path, starts_with(path, '/shelf/tidewater-room/') AS inside FROM library")
def prd16(spark, d):
    return table(spark, d, "library").select("path", F.array_contains(catalog.ancestors(F.col("path")), "/shelf/tidewater-room").alias("inside"))


@query("jon10_outside", "SELECT path FROM library l WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.path = 'B' AND starts_with(l.path, j.folder || '/'))")
def jon10(spark, d):
    folders = table(spark, d, "jobs").where(F.col("path") == "B").select("folder").where(F.col("folder").isNotNull())
    return catalog.outside(table(spark, d, "library"), folders).select("path")


@query("jon06_shared_files", f"SELECT id AS book FROM {S.JOBS} a WHERE EXISTS (SELECT 1 FROM {S.JOBS} b WHERE lower(a.pdf_path) = lower(b.pdf_path) AND a.id <> b.id)")
def jon06(spark, d):
    return catalog.shared_paths(jobs_once(spark, d, "pdf_path"), "book", "pdf_path")


@query(
    "jon07_containment",
    f"SELECT DISTINCT p.book, p.chunk_idx, b.block_no FROM {S.PLAN} p JOIN {S.BLOCKS} b ON p.book = b.book AND contains(b.text, p.text) WHERE {S.strip('p.text')} <> ''",
)
def jon07(spark, d):
    plan = plan_once(spark, d).where(F.col("text").isNotNull())
    return catalog.contained(plan, blocks_once(spark, d), "book", "chunk_idx", "block_no")


@query("jon05_neighbours", "SELECT a.vec_id, a.label = b.label AS same_label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def jon05(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "label")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    return a.join(b, "vec_id").select("vec_id", (F.col("label") == F.col("other")).alias("same_label"))


@query(
    "jon11_job_detail",
    f"""SELECT j.id AS book, coalesce(bodies, 0) AS bodies, coalesce(headings, 0) AS headings, coalesce(planned, 0) AS planned, coalesce(made, 0) AS made, last_written FROM (SELECT DISTINCT id FROM jobs) j
 LEFT JOIN (SELECT book, count(*) FILTER (type = 'body') AS bodies, count(*) FILTER (type = 'heading') AS headings FROM {S.BLOCKS} b GROUP BY book) b ON b.book = j.id
 LEFT JOIN (SELECT book, count(*) AS planned FROM {S.PLAN} p GROUP BY book) p ON p.book = j.id
 LEFT JOIN (SELECT book, count(DISTINCT chunk_idx) AS made, max(written_at) AS last_written FROM segments WHERE frames IS NOT NULL GROUP BY book) s ON s.book = j.id""",
)
def jon11(spark, d):
    jobs = jobs_once(spark, d)
    blocks = table(spark, d, "blocks").select("book", "block_no", "type").dropDuplicates(["book", "block_no"]).groupBy("book").agg(F.count(F.when(F.col("type") == "body", 1)).alias("bodies"), F.count(F.when(F.col("type") == "heading", 1)).alias("headings"))
    plan = table(spark, d, "chunk_plan").select("book", "chunk_idx").distinct().groupBy("book").agg(F.count("*").alias("planned"))
    made = table(spark, d, "segments").where(F.col("frames").isNotNull()).groupBy("book").agg(F.count_distinct("chunk_idx").alias("made"), F.max("written_at").alias("last_written"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return jobs.join(blocks, "book", "left").join(plan, "book", "left").join(made, "book", "left").select("book", zero("bodies"), zero("headings"), zero("planned"), zero("made"), "last_written")


@query("jon12_gap_variants", f"SELECT gap_ms, book, sum(CASE WHEN after_ms IN (650, 100) THEN gap_ms ELSE after_ms END)::BIGINT AS pause_ms FROM {S.PLAN} p, (VALUES (400), (650), (900)) v(gap_ms) GROUP BY ALL")
def jon12(spark, d):
    rows = plan_once(spark, d).select("book", "after_ms", F.explode(F.array(*map(F.lit, (400, 650, 900)))).alias("gap_ms"))
    return rows.groupBy("gap_ms", "book").agg(F.sum(F.when(F.col("after_ms").isin(650, 100), F.col("gap_ms")).otherwise(F.col("after_ms"))).alias("pause_ms"))


# ---- aggregates


@query("agg01_type_counts", f"SELECT book, type, count(*) AS blocks FROM {S.BLOCKS} b GROUP BY ALL")
def agg01(spark, d):
    return metrics.cut_total(table(spark, d, "blocks").dropDuplicates(["book", "block_no"]), ["book", "type"], "blocks")


@query("agg02_distinct_share", f"SELECT book, round(count(DISTINCT text) / count(text), 6) AS share FROM {S.BLOCKS} b WHERE text IS NOT NULL GROUP BY book")
def agg02(spark, d):
    return blocks_once(spark, d).groupBy("book").agg(F.round(F.count_distinct("text") / F.count("text"), 6).alias("share"))


@query("agg03_upper_median", f"SELECT type, list_sort(list(length(text)))[count(*) // 2 + 1]::INTEGER AS median FROM {S.BLOCKS} b WHERE text IS NOT NULL GROUP BY type")
def agg03(spark, d):
    return metrics.upper_median(blocks_once(spark, d).select("type", F.length("text").alias("n")), ["type"], "n")


@query(
    "agg05_arm_ratio",
    f"""SELECT a.book, round(b / a, 6) AS ratio, CASE WHEN b / a > 1.02 THEN 'SLOWER' WHEN b / a < 0.98 THEN 'FASTER' ELSE 'SAME' END AS label FROM (SELECT book, sum(frames)::DOUBLE AS a, sum(CASE WHEN chunk_idx % 2 = 0 THEN frames * 1.1 ELSE frames * 0.85 END) AS b FROM {DONE} GROUP BY book HAVING sum(frames) > 0) a""",
)
def agg05(spark, d):
    other = F.when(F.col("chunk_idx") % 2 == 0, F.col("frames") * 1.1).otherwise(F.col("frames") * 0.85)
    rows = finished(spark, d).groupBy("book").agg(F.sum("frames").alias("a"), F.sum(other).alias("b")).where("a > 0")
    ratio = F.col("b") / F.col("a")
    return rows.select("book", F.round(ratio, 6).alias("ratio"), metrics.label_speed(ratio).alias("label"))


_NUMBERED = f"(SELECT book, page, row_number() OVER (PARTITION BY book, page ORDER BY line_no) AS line_no, text FROM {PLACED})"
_START = S.match(S.collapse("text"), S.START)


@query(
    "agg10_start_page",
    f"""WITH o AS (SELECT book, min(page) AS po FROM {_OUTLINE} WHERE {S.match(S.collapse('title'), S.START)} AND page >= 1 GROUP BY book),
 f AS (SELECT book, page, count(*) FILTER ({_START}) AS m, count(*) FILTER ({_START} AND line_no <= 20) AS h, count(*) FILTER (line_no <= 10 AND contains(lower(text), 'contents')) AS c FROM {_NUMBERED} WHERE page <= 80 GROUP BY book, page),
 p AS (SELECT book, min(page) AS pp FROM f WHERE h > 0 AND c = 0 AND m < 3 GROUP BY book)
 SELECT k.book, coalesce(po, pp, 1) AS page, CASE WHEN po IS NOT NULL THEN 'outline' WHEN pp IS NOT NULL THEN 'page heading' END AS reason FROM (SELECT DISTINCT book FROM {PLACED} UNION SELECT book FROM {_OUTLINE}) k LEFT JOIN o USING (book) LEFT JOIN p USING (book)""",
)
def agg10(spark, d):
    w = Window.partitionBy("book", "page").orderBy("line_no")
    lines = placed_lines(spark, d).select("book", "page", F.row_number().over(w).alias("line_no"), "text")
    return catalog.start_page(lines, outline(spark, d), "book")


@query("agg11_folder_pages", "SELECT folder, count(*) AS files, coalesce(sum(pages), 0)::BIGINT AS pages FROM library GROUP BY folder")
def agg11(spark, d):
    return table(spark, d, "library").groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


@query(
    "agg12_progress",
    f"""SELECT p.book, total, coalesce(done, 0) AS done, round(CASE WHEN total > coalesce(done, 0) AND coalesce(done, 0) > 1 AND secs > 0 THEN (total - done) * secs / (done - 1) END, 3) AS seconds_left
 FROM (SELECT book, count(*) AS total FROM {S.PLAN} x GROUP BY book) p LEFT JOIN (SELECT book, count(DISTINCT chunk_idx) AS done, (epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1e6 AS secs FROM segments WHERE frames IS NOT NULL GROUP BY book) s USING (book)""",
)
def agg12(spark, d):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    total = table(spark, d, "chunk_plan").select("book", "chunk_idx").distinct().groupBy("book").agg(F.count("*").alias("total"))
    seg = table(spark, d, "segments").where(F.col("frames").isNotNull()).groupBy("book").agg(F.count_distinct("chunk_idx").alias("done"), ((F.max(micros("written_at")) - F.min(micros("written_at"))) / 1e6).alias("secs"))
    rows = total.join(seg, "book", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return rows.select("book", "total", "done", F.round(metrics.progress(F.col("total"), F.col("done"), F.col("secs"), F.lit(1)), 3).alias("seconds_left"))


@query(
    "agg14_cosine",
    """SELECT label, round(avg(c), 4) AS mean, round(min(c), 4) AS least, round(max(c), 4) AS most FROM (SELECT a.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS c
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY label""",
)
def agg14(spark, d):
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = a.join(b, "vec_id").select("label", A.cosine(F.col("embedding"), F.col("other")).alias("c"))
    return c.groupBy("label").agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.min("c"), 4).alias("least"), F.round(F.max("c"), 4).alias("most"))


@query("arr01_unit", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def arr01(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(A.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


_K = "least(floor(480 * 30 / 1000.0)::INT, len(v) // 3)"


@query(
    "arr03_fade",
    f"""SELECT vec_id, list_transform(v, lambda x, i: round(CASE WHEN i <= {_K} THEN x * (i - 1) / ({_K} - 1) WHEN i > len(v) - {_K} THEN x * (1 - (i - 1 - (len(v) - {_K})) / ({_K} - 1)) ELSE x END, 6) + 0.0) AS faded FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
)
def arr03(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(A.fade(F.col("embedding"), F.lit(480), 30), lambda x: F.round(x, 6)).alias("faded"))


@query("arr06_quantise", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: trunc(greatest(-1.0, least(1.0, x)) * 32767)::INTEGER) AS samples FROM embeddings")
def arr06(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.quantise(F.col("embedding")).alias("samples"))


@query("arr07_pad", "SELECT vec_id, list_concat(embedding[1:label + 1]::DOUBLE[], list_transform(range(9 - label), lambda i: 0.0::DOUBLE)) AS padded FROM embeddings")
def arr07(spark, d):
    cut = F.slice(A.doubles(F.col("embedding")), F.lit(1), F.col("label") + 1)
    return table(spark, d, "embeddings").select("vec_id", A.pad(cut, F.lit(10), F.lit(0.0)).alias("padded"))


@query("arr08_positions", "SELECT vec_id, list_transform(m, lambda x, i: CASE WHEN x = 1 THEN (list_sum(m[1:i]) - 1)::INTEGER ELSE 0 END) AS positions FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS m FROM embeddings)")
def arr08(spark, d):
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, d, "embeddings").withColumn("m", mask).select("vec_id", A.positions(F.col("m")).alias("positions"))


@query("agg15_audio_stats", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS samples, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding)), 6) AS rms, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS peak FROM embeddings")
def agg15(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(v).alias("samples"), F.round(A.rms(v), 6).alias("rms"), F.round(A.peak(v), 6).alias("peak"))


@query("agg16_throughput", f"SELECT book, count(*) AS pieces, round(sum(frames * 1000000 // sr)::BIGINT / 1e6, 3) AS seconds, round(count(*) / (sum(frames * 1000000 // sr)::BIGINT / 6e7), 6) AS per_minute FROM {DONE} GROUP BY book HAVING sum(frames) > 0")
def agg16(spark, d):
    # whole microseconds, so the sum doesn't depend on the order of rows
    secs = F.sum(F.floor(F.col("frames") * 1000000 / F.col("sr"))) / 1e6
    return finished(spark, d).groupBy("book").agg(F.sum("frames").alias("f"), F.count("*").alias("pieces"), F.round(secs, 3).alias("seconds"), F.round(F.count("*") / (secs / 60), 6).alias("per_minute")).where("f > 0").drop("f")


@query(
    "agg17_stratified",
    f"""WITH n AS (SELECT book, max(chunk_idx) + 1 AS n FROM {S.PLAN} p GROUP BY book), r AS (SELECT d.book, chunk_idx, n, frames::DOUBLE AS v FROM {DONE} d JOIN n USING (book) WHERE chunk_idx < n),
 e AS (SELECT book, max(n) AS n, avg(v) AS al FROM r GROUP BY book), c AS (SELECT book, n, al, i, floor(n * i / 4) AS lo, floor(n * (i + 1) / 4) AS hi FROM e, range(4) t(i)),
 m AS (SELECT c.book, c.i, avg(v) AS mean FROM c JOIN r ON r.book = c.book AND chunk_idx >= lo AND chunk_idx < hi GROUP BY c.book, c.i)
 SELECT c.book, round(sum(coalesce(mean, al) * (hi - lo)), 3) AS estimate FROM c LEFT JOIN m USING (book, i) GROUP BY c.book""",
)
def agg17(spark, d):
    """Each book's frames, from all finished pieces."""
    n = table(spark, d, "chunk_plan").groupBy("book").agg((F.max("chunk_idx") + 1).alias("n"))
    rows = finished(spark, d).join(n, "book").where(F.col("chunk_idx") < F.col("n")).select("book", "chunk_idx", "n", F.col("frames").cast("double").alias("v"))
    return metrics.stratified_total(rows, ["book"], "chunk_idx", "n", "v").select("book", F.round("estimate", 3).alias("estimate"))


@query(
    "agg18_outliers",
    f"""WITH r AS (SELECT sr, frames, median(frames) OVER (PARTITION BY sr) AS m FROM {DONE}) SELECT sr, count(*) AS rows, count(*) FILTER (frames > 2.0 * m) AS outliers, sum(frames)::BIGINT AS total, sum(CASE WHEN frames > 2.0 * m THEN m ELSE frames END)::DOUBLE AS cleaned FROM r GROUP BY sr""",
)
def agg18(spark, d):
    return metrics.outliers(finished(spark, d), ["sr"], "frames", 2.0)


@query("agg23_made_or_not", "SELECT book, count(*) FILTER (frames IS NOT NULL) AS made, count(*) FILTER (frames IS NULL) AS failed FROM (SELECT DISTINCT * FROM segments) GROUP BY book")
def agg23(spark, d):
    return table(spark, d, "segments").distinct().groupBy("book").agg(F.count("frames").alias("made"), F.count(F.when(F.col("frames").isNull(), 1)).alias("failed"))


_FRAMES = f"""(WITH l AS (SELECT book, max(stop_at) AS stop, max(last_chunk) AS lc FROM {_ENDS} GROUP BY book)
 SELECT r.book, r.chunk_idx, coalesce(e.last_chunk, lc) AS last_chunk FROM (SELECT book, chunk_idx, start_ms + 30000 AS due, start_ms FROM {TIME}) r JOIN l USING (book)
 ASOF LEFT JOIN (SELECT book, stop_at, min(last_chunk) AS last_chunk FROM {_ENDS} GROUP BY book, stop_at) e ON r.book = e.book AND r.due <= e.stop_at WHERE stop - start_ms >= 27000)"""


@query(
    "agg24_densest_passage",
    f"""WITH u AS (SELECT book, chunk_idx, sum(2 * (after_ms >= 400)::INT + (frames / sr < 2.0)::INT) OVER (PARTITION BY book ORDER BY chunk_idx) AS upto, 2 * (after_ms >= 400)::INT + (frames / sr < 2.0)::INT AS own FROM {TIME}),
 s AS (SELECT f.book, f.chunk_idx, f.last_chunk, b.upto - a.upto + a.own AS score FROM {_FRAMES} f JOIN u a ON a.book = f.book AND a.chunk_idx = f.chunk_idx JOIN u b ON b.book = f.book AND b.chunk_idx = f.last_chunk)
 SELECT book, chunk_idx, last_chunk, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, chunk_idx) AS r FROM s) WHERE r = 1""",
)
def agg24(spark, d):
    rows = checkpointed(timed(spark, d).select("book", "chunk_idx", "after_ms", "frames", "sr", "start_sample", "samples", "start_ms"))
    own = 2 * (F.col("after_ms") >= 400).cast("int") + (F.col("frames") / F.col("sr") < 2.0).cast("int")
    sums = running_sum(rows.withColumn("own", own), "book", "chunk_idx", F.col("own"), "upto", inclusive=True).select("book", "chunk_idx", "own", "upto")
    first = forward_frames(rows, 30_000).join(sums, ["book", "chunk_idx"])
    both = first.join(sums.select("book", F.col("chunk_idx").alias("last_chunk"), F.col("upto").alias("to")), ["book", "last_chunk"])
    score = F.struct((F.col("to") - F.col("upto") + F.col("own")).alias("score"), (-F.col("chunk_idx")).alias("first"), "last_chunk")
    best = both.groupBy("book").agg(F.max(score).alias("b"))
    return best.select("book", (-F.col("b.first")).alias("chunk_idx"), "b.last_chunk", "b.score")


@query("agg25_peak_scale", "SELECT vec_id, round(CASE WHEN p > 0.3 THEN 0.3 / p ELSE 1.0 END, 6)::DOUBLE AS scale FROM (SELECT vec_id, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS p FROM embeddings)")
def agg25(spark, d):
    p = A.peak(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.when(p > 0.3, 0.3 / p).otherwise(1.0), 6).alias("scale"))


# ---- order and samples


@query("ord01_by_size", f"SELECT book, chunk_idx, row_number() OVER (PARTITION BY book ORDER BY length(text) NULLS LAST, chunk_idx) - 1 AS place FROM {S.PLAN} p")
def ord01(spark, d):
    items = plan_once(spark, d).select("book", "chunk_idx", F.length("text").alias("n"))
    return size_rank(items, "book", "n", "chunk_idx", "place").select("book", "chunk_idx", "place")


@query("ord02_newest_jobs", f"SELECT id AS book, created_at FROM {S.JOBS} j ORDER BY created_at DESC, id LIMIT 50")
def ord02(spark, d):
    return jobs_once(spark, d, "created_at").orderBy(F.desc_nulls_last("created_at"), "book").limit(50)


_BODY = f"(SELECT book, chunk_idx, text, length(text) AS n FROM {S.PLAN} p WHERE heading IS NULL AND text IS NOT NULL)"


@query(
    "ord04_representative",
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n, chunk_idx) - 1 AS r, row_number() OVER (PARTITION BY book ORDER BY chunk_idx) - 1 AS i, count(*) OVER (PARTITION BY book) AS k,
 CASE WHEN contains(text, '"') OR contains(text, '“') THEN sum(CASE WHEN contains(text, '"') OR contains(text, '“') THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY chunk_idx) END AS quoted FROM {_BODY}),
 h AS (SELECT book, min(chunk_idx) AS chunk_idx FROM {S.PLAN} p WHERE heading IS NOT NULL GROUP BY book)
 SELECT book, chunk_idx, false AS is_heading FROM b WHERE r IN (0, k - 1, floor(k * 0.25), floor(k * 0.5), floor(k * 0.75)) OR quoted <= 4 OR i BETWEEN k // 2 AND k // 2 + 2 UNION ALL SELECT book, chunk_idx, true FROM h""",
)
def ord04(spark, d):
    plan = plan_once(spark, d)
    quoted = (F.contains(F.col("text"), F.lit('"')) | F.contains(F.col("text"), F.lit("“"))).cast("int")
    body = plan.where(F.col("heading").isNull() & F.col("text").isNotNull()).select("book", "chunk_idx", F.length("text").alias("n"), quoted.alias("q"))
    body = size_rank(body, "book", "n", "chunk_idx", "r")
    # both sums count the row itself, so its place is one less
    body = running_sums(body, "book", "chunk_idx", {"i": F.lit(1), "qs": F.col("q")}, inclusive=True).withColumn("i", F.col("i") - 1)
    body = body.join(body.groupBy("book").agg(F.count("*").alias("k")), "book")
    r, k, mid = F.col("r"), F.col("k"), F.floor(F.col("k") / 2)
    spread = (r == 0) | (r == k - 1) | (r == F.floor(k * 0.25)) | (r == F.floor(k * 0.5)) | (r == F.floor(k * 0.75))
    picked = body.where(spread | ((F.col("q") == 1) & (F.col("qs") <= 4)) | F.col("i").between(mid, mid + 2)).select("book", "chunk_idx", F.lit(False).alias("is_heading"))
    heads = plan.where(F.col("heading").isNotNull()).groupBy("book").agg(F.min("chunk_idx").alias("chunk_idx")).select("book", "chunk_idx", F.lit(True).alias("is_heading"))
    return picked.unionByName(heads)


@query("ord05_systematic", "SELECT container, list_sort(list_distinct(list_transform(range(4), lambda i: least(capacity_tokens - 1, round_even(i * capacity_tokens / 4, 0))::INTEGER))) AS picks FROM containers")
def ord05(spark, d):
    return table(spark, d, "containers").select("container", A.systematic(F.col("capacity_tokens"), F.lit(4)).alias("picks"))


@query("ord06_page_sample", "SELECT path, CASE WHEN pages < 1 THEN [] WHEN pages <= 24 THEN list_transform(range(pages), lambda i: i::INTEGER) ELSE list_transform(range(24), lambda i: floor(i * pages / 24.0)::INTEGER) END AS sample FROM library WHERE pages IS NOT NULL")
def ord06(spark, d):
    return table(spark, d, "library").where(F.col("pages").isNotNull()).select("path", A.spread_pages(F.lit(1), F.col("pages"), 24).alias("sample"))


@query("ord07_stride", f"SELECT id AS book, list_transform(range(page_from - 1, page_to, greatest(1, (page_to - page_from) // 6)), lambda i: i::INTEGER) AS pages FROM {S.JOBS} j WHERE page_from BETWEEN 1 AND page_to")
def ord07(spark, d):
    rows = jobs_once(spark, d, "page_from", "page_to").where(F.col("page_from").between(1, F.col("page_to")))
    step = F.greatest(F.lit(1), F.floor((F.col("page_to") - F.col("page_from")) / 6).cast("int"))
    return rows.select("book", F.sequence(F.col("page_from") - 1, F.col("page_to") - 1, step).alias("pages"))


@query("set02_first_of_text", f"SELECT book, text, min(block_no) AS block_no FROM {S.BLOCKS} b WHERE text IS NOT NULL GROUP BY book, text")
def set02(spark, d):
    return blocks_once(spark, d).groupBy("book", "text").agg(F.min("block_no").alias("block_no"))


@query("set03_rejoined", f"SELECT book, block_no, array_to_string({S.sentences('text')}, ' ') = {S.collapse('text')} AS whole FROM {S.BLOCKS} b WHERE text IS NOT NULL")
def set03(spark, d):
    return blocks_once(spark, d).select("book", "block_no", (F.array_join(T.split_sentences(F.col("text")), " ") == T.collapse(F.col("text"))).alias("whole"))


@query("map02_tags", "SELECT id AS book, array_to_string(list_filter([CASE WHEN coalesce(title, '') <> '' THEN 'title' END, CASE WHEN coalesce(lang, '') <> '' THEN 'lang' END, CASE WHEN coalesce(voice, '') <> '' THEN 'voice' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT DISTINCT id, title, lang, voice FROM jobs)")
def map02(spark, d):
    tags = F.create_map(*(x for k in ("title", "lang", "voice") for x in (F.lit(k), F.coalesce(F.col(k), F.lit("")))))
    return jobs_once(spark, d, "title", "lang", "voice").select("book", F.array_join(F.map_keys(F.map_filter(tags, lambda k, v: v != "")), ",").alias("tags"))


@query("dat01_durations", "SELECT DISTINCT book, chunk_idx, greatest(0, (epoch_us(loaded_at) - epoch_us(written_at)) / 1e6)::DOUBLE AS late, strftime(written_at, '%H:%M:%S') AS clock FROM segments WHERE loaded_at IS NOT NULL AND written_at IS NOT NULL")
def dat01(spark, d):
    rows = table(spark, d, "segments").where(F.col("loaded_at").isNotNull() & F.col("written_at").isNotNull())
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = F.greatest(F.lit(0.0), (micros("loaded_at") - micros("written_at")) / 1e6)
    return rows.select("book", "chunk_idx", late.alias("late"), F.date_format("written_at", "HH:mm:ss").alias("clock")).distinct()


# ---- the rest of the inventory


@query(
    "src03_raster_zoom",
    "SELECT path, round(CASE WHEN mp > 12 THEN z * sqrt(12 / mp) ELSE z END, 6) AS zoom FROM (SELECT path, 300 / 72.0::DOUBLE AS z, (595.0::DOUBLE * 300 / 72.0::DOUBLE) * ((pages * 10.0)::DOUBLE * 300 / 72.0::DOUBLE) / 1e6 AS mp FROM library WHERE pages IS NOT NULL)",
)
def src03(spark, d):
    """Zoom for 300 dots an inch within 12 million pixels; a page is taken to be 10 points high for each page of its file."""
    rows = table(spark, d, "library").where(F.col("pages").isNotNull())
    return rows.select("path", F.round(readers.raster_zoom(F.lit(595.0), F.col("pages") * 10.0, 300), 6).alias("zoom"))


@query("src05_largest_file", "SELECT folder, path, pages FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY pages DESC, path) AS r FROM library WHERE pages IS NOT NULL) WHERE r = 1")
def src05(spark, d):
    """The largest file of each folder, the first by path of equal ones: an aggregate, so a large folder isn't sorted."""
    rows = table(spark, d, "library").where(F.col("pages").isNotNull())
    most = rows.groupBy("folder").agg(F.max("pages").alias("pages"))
    return rows.join(most, ["folder", "pages"]).groupBy("folder", "pages").agg(F.min("path").alias("path")).select("folder", "path", "pages")


_PARAS = f"list_filter(list_transform(string_split_regex(text, '\\n{S.WS}*\\n'), lambda p: {S.collapse('p')}), lambda p: p <> '')"


@query("src10_paragraphs", f"SELECT doc_id, unnest({_PARAS}) AS paragraph, CAST(generate_subscripts({_PARAS}, 1) AS INTEGER) AS pos FROM documents WHERE text IS NOT NULL")
def src10(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(readers.paragraphs(F.col("text"))).alias("i", "paragraph")).select("doc_id", "paragraph", (F.col("i") + 1).alias("pos"))


@query("src14_settings", "SELECT id AS book, coalesce(nullif(voice, ''), nullif(lang, ''), 'Default') AS setting FROM (SELECT DISTINCT id, voice, lang FROM jobs)")
def src14(spark, d):
    return jobs_once(spark, d, "voice", "lang").select("book", readers.setting(F.col("voice"), F.col("lang"), F.lit("Default")).alias("setting"))


@query("prd18_segment_names", r"SELECT book, chunk_idx, name, regexp_matches(name, '^seg_[0-9]{6}\.wav$') AS final FROM (SELECT DISTINCT book, chunk_idx, 'seg_' || lpad(chunk_idx::VARCHAR, 6, '0') || CASE WHEN frames IS NULL THEN '.wav.tmp' ELSE '.wav' END AS name FROM segments)")
def prd18(spark, d):
    name = F.concat(F.lit("seg_"), F.lpad(F.col("chunk_idx").cast("string"), 6, "0"), F.when(F.col("frames").isNull(), ".wav.tmp").otherwise(".wav"))
    rows = table(spark, d, "segments").select("book", "chunk_idx", name.alias("name")).distinct()
    return rows.select("book", "chunk_idx", "name", F.col("name").rlike(r"\Aseg_[0-9]{6}\.wav\z").alias("final"))


@query("prd20_valid_tokens", "SELECT vec_id, list_filter(list_transform(embedding::DOUBLE[], lambda x: floor(abs(x) * 40000)::INTEGER), lambda t: t < 6561) AS tokens FROM embeddings")
def prd20(spark, d):
    tokens = F.transform(A.doubles(F.col("embedding")), lambda x: F.floor(F.abs(x) * 40000).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.filter(tokens, lambda t: t < 6561).alias("tokens"))


@query("pln04_arms", f"SELECT arm, book, chunk_idx, 20260730 + chunk_idx * 10 AS seed, CASE WHEN arm = 'short' THEN least(after_ms, 150) ELSE after_ms END AS after_ms FROM {S.PLAN} p, (VALUES ('plain'), ('short')) a(arm)")
def pln04(spark, d):
    rows = plan_once(spark, d).withColumn("arm", F.explode(F.array(F.lit("plain"), F.lit("short"))))
    return rows.select("arm", "book", "chunk_idx", (20260730 + F.col("chunk_idx") * 10).alias("seed"), F.when(F.col("arm") == "short", F.least("after_ms", F.lit(150))).otherwise(F.col("after_ms")).alias("after_ms"))


@query("agg20_pause_share", f"SELECT book, round(sum(before_ms + after_ms) / (sum(before_ms + after_ms) + sum(frames * 1000 // sr)), 6) AS share FROM {S.PLAN} p JOIN {DONE} d USING (book, chunk_idx) GROUP BY book HAVING sum(frames) > 0")
def agg20(spark, d):
    rows = plan_once(spark, d).join(finished(spark, d), ["book", "chunk_idx"])
    pause, sound = F.sum(F.col("before_ms") + F.col("after_ms")), F.sum(F.floor(F.col("frames") * 1000 / F.col("sr")))
    return rows.groupBy("book").agg(F.sum("frames").alias("f"), F.round(pause / (pause + sound), 6).alias("share")).where("f > 0").select("book", "share")


@query(
    "ord08_blind_labels",
    """SELECT book, label, CASE WHEN (label = 'A') = f THEN 'plain' ELSE 'short' END AS arm FROM (SELECT DISTINCT book, substr(sha256(book || 'concealed'), 1, 1) < '8' AS f FROM chunk_plan WHERE book IS NOT NULL), (VALUES ('A'), ('B')) l(label)""",
)
def ord08(spark, d):
    """Each plan's two arms under the letters A and B, in an order that a salted digest conceals."""
    first = F.substring(F.sha2(F.concat("book", F.lit("concealed")), 256), 1, 1) < "8"
    books = table(spark, d, "chunk_plan").select("book").where(F.col("book").isNotNull()).distinct()
    arms = F.when(first, F.array(F.lit("plain"), F.lit("short"))).otherwise(F.array(F.lit("short"), F.lit("plain")))
    rows = books.select("book", F.posexplode(arms).alias("i", "arm"))
    return rows.select("book", F.when(F.col("i") == 0, "A").otherwise("B").alias("label"), "arm")


@query("set01_roots", "SELECT folder, min(r) AS origin FROM (SELECT folder, 1 AS r FROM library UNION ALL SELECT folder, 2 FROM jobs) WHERE folder IS NOT NULL GROUP BY folder")
def set01(spark, d):
    both = table(spark, d, "library").select("folder", F.lit(1).alias("r")).unionByName(table(spark, d, "jobs").select("folder", F.lit(2).alias("r")))
    return both.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.min("r").alias("origin"))


@query("arr05_page_text", f"SELECT book, source_page AS page, string_agg(text, chr(10) ORDER BY block_no) AS text FROM {S.BLOCKS} b WHERE text IS NOT NULL AND source_page IS NOT NULL GROUP BY book, source_page")
def arr05(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    rows = blocks_once(spark, d).where(F.col("source_page").isNotNull())
    return rows.groupBy("book", F.col("source_page").alias("page")).agg(F.array_join(F.transform(parts, lambda r: r["text"]), "\n").alias("text"))


@query("arr04_silence", "SELECT book, chunk_idx, floor(24000 * before_ms / 1000.0)::INTEGER + floor(24000 * after_ms / 1000.0)::INTEGER AS zeros FROM (SELECT DISTINCT * FROM chunk_plan)")
def arr04(spark, d):
    """The zeros around every piece."""
    quiet = lambda c: F.size(A.silence(F.lit(24000), F.col(c)))
    return plan_once(spark, d).select("book", "chunk_idx", (quiet("before_ms") + quiet("after_ms")).alias("zeros"))


@query("agg13_workers", "SELECT path, greatest(1, least(3, floor((pages / 10.0 - 2) / 6.5)))::INTEGER AS workers FROM library WHERE pages IS NOT NULL")
def agg13(spark, d):
    """Workers that fit, a file's tenth of pages taken as memory in GB."""
    return table(spark, d, "library").where(F.col("pages").isNotNull()).select("path", metrics.workers(F.col("pages") / 10.0).alias("workers"))


def _by_row(name: str, key: str, values: str) -> None:
    """The arrays of a query as rows (key, i, value), i from 1."""
    whole = QUERIES[name]

    def rows(spark: SparkSession, d: str) -> DataFrame:
        return whole(spark, d).select(key, F.posexplode(values).alias("_i", values)).select(key, (F.col("_i") + 1).alias("i"), values)

    QUERIES[name] = rows
    ORACLE_SQL[name] = f"SELECT {key}, CAST(i AS INTEGER) AS i, x AS {values} FROM (SELECT {key}, unnest({values}) AS x, generate_subscripts({values}, 1) AS i FROM ({ORACLE_SQL[name]}))"


for _n, _k, _v in (
    ("arr01_unit", "vec_id", "unit"), ("arr03_fade", "vec_id", "faded"), ("arr06_quantise", "vec_id", "samples"), ("arr07_pad", "vec_id", "padded"), ("arr08_positions", "vec_id", "positions"),
    ("prd20_valid_tokens", "vec_id", "tokens"), ("ord05_systematic", "container", "picks"), ("ord06_page_sample", "path", "sample"), ("ord07_stride", "book", "pages"),
):
    _by_row(_n, _k, _v)
