"""Queries of the rest of the inventory: sources and sinks read back, plan variants, identities and states.

Where the tables lack a column (image sizes, file lengths, channels) the docstring says what stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import arrays as A
from folioflow.functions import text as T
from folioflow.operators import catalog, metrics, planning, schedule, timeline
from folioflow.operators.ordered import next_row, running_sum, running_sums
from folioflow.plans import page_queries, sqlgen as S
from folioflow.plans.plan_queries import DONE, ENDED, PLAN_SQL, built_plan, chapters, finished, pack_sql, plan_once
from folioflow.plans.text_queries import blocks_once
from folioflow.sources import readers, writers
from folioflow.sources.tables import jobs_once, scratch, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_B = f"{S.BLOCKS} b WHERE text IS NOT NULL"

# ---- sources


@query("src02_plain_lines", f"SELECT book, page, line_no, text FROM ({page_queries.ORACLE_SQL['src01_drop_caps']})")
def src02(spark, d):
    """Lines with drop caps joined, without their geometry."""
    return page_queries.QUERIES["src01_drop_caps"](spark, d).select("book", "page", "line_no", "text")


_WANTED = f"(SELECT id AS book, unnest(range(page_from, page_to + 1))::INTEGER AS page FROM {S.JOBS} j WHERE path = 'B' AND page_from <= page_to)"


@query("src04_uncached", f"SELECT book, page FROM {_WANTED} w WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.book = w.book AND b.source_page = w.page AND b.text IS NOT NULL)")
def src04(spark, d):
    """Pages of scanned jobs whose text isn't there yet: the blocks are the cache."""
    jobs = jobs_once(spark, d, "path", "page_from", "page_to").where((F.col("path") == "B") & (F.col("page_from") <= F.col("page_to")))
    pages = jobs.select("book", F.explode(F.sequence("page_from", "page_to")).alias("page"))
    cache = table(spark, d, "blocks").where(F.col("text").isNotNull()).select("book", F.col("source_page").alias("page"))
    return readers.uncached(pages, cache, ["book", "page"])


@query("src05_covers", "SELECT folder, arg_max(pages, (pages % 37 * 1000, -pages)) AS pages FROM (SELECT DISTINCT folder, pages FROM library WHERE pages >= 60) GROUP BY folder")
def src05(spark, d):
    """The largest image of a folder; a file of so many pages stands for an image of 140 more points on both sides and (pages mod 37) KB."""
    n = F.col("pages")
    images = table(spark, d, "library").where(n.isNotNull()).select("folder", "pages", (n + 140).alias("width"), (n + 140).alias("height"), (n % 37 * 1000).alias("bytes")).distinct()
    return catalog.covers(images, "folder", "pages")


@query("src05_titles", f"SELECT id AS book, coalesce(nullif({S.strip('title')}, ''), regexp_extract(pdf_path, '([^/]*)\\.[^./]*$', 1)) AS title FROM (SELECT DISTINCT id, title, pdf_path FROM jobs) WHERE pdf_path IS NOT NULL")
def src05_titles(spark, d):
    """The title of a document, unless it is empty, else the name of its file."""
    jobs = jobs_once(spark, d, "title", "pdf_path").where(F.col("pdf_path").isNotNull())
    return jobs.select("book", readers.setting(T.strip(F.col("title")), T.file_stem(F.col("pdf_path"))).alias("title"))


@query("src14_setting_lists", "SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY i) AS INTEGER) AS pos, x AS part FROM (SELECT id AS book, unnest([folder, pdf_path, lang]) AS x, generate_subscripts([1, 2, 3], 1) AS i FROM (SELECT DISTINCT id, folder, pdf_path, lang FROM jobs)) WHERE x IS NOT NULL AND trim(x) <> ''")
def src14(spark, d):
    """The parts of a list of paths, some of them empty."""
    jobs = jobs_once(spark, d, "folder", "pdf_path", "lang")
    listed = F.concat_ws(";", F.coalesce("folder", F.lit("")), F.lit(" "), F.coalesce("pdf_path", F.lit("")), F.coalesce("lang", F.lit("")))
    return jobs.select("book", F.posexplode(readers.setting_list(listed)).alias("i", "part")).select("book", (F.col("i") + 1).alias("pos"), "part")


@query(
    "src18_import_errors",
    "SELECT path, CASE WHEN pages % 11 = 0 THEN 'empty' WHEN pages > 500 THEN 'larger than 2 GiB' WHEN pages % 13 = 0 THEN 'no PDF header' WHEN pages % 17 = 0 THEN 'encrypted' WHEN pages % 19 = 0 THEN 'no pages' END AS error FROM library WHERE pages IS NOT NULL AND lower(path) LIKE '%.pdf'",
)
def src18(spark, d):
    """What is wrong with each file; multiples of 11, 13, 17 and 19 pages stand for empty files, no header, locked files and none at all."""
    n = F.col("pages")
    length = F.when(n % 11 == 0, 0).when(n > 500, readers.MOST_BYTES + 1).otherwise(n.cast("bigint") * 50_000)
    head = F.when(n % 13 == 0, "<html>").otherwise("\x00\x00%PDF-1.7")
    rows = table(spark, d, "library").where(n.isNotNull() & F.lower("path").endswith(".pdf"))
    return rows.select("path", readers.import_error(F.col("path"), length, head, n % 17 == 0, F.when(n % 19 == 0, 0).otherwise(n)).alias("error"))


_STEM = S.sub(S.sub(S.sub("regexp_extract(path, '([^/" + chr(92) * 2 + "]*)$', 1)", r"(.)\.[^.]*$", chr(92) + "1", ""), r'[<>:"/\\|?*\x00-\x1f]', "_"), "^[ .]+|[ .]+$")


@query("src18_safe_names", f"SELECT path, s || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.pdf' AS name FROM (SELECT path, s, row_number() OVER (PARTITION BY lower(s) ORDER BY path) AS r FROM (SELECT path, coalesce(nullif({_STEM}, ''), 'document') AS s FROM library))")
def src18_names(spark, d):
    return readers.import_names(table(spark, d, "library").select("path")).select("path", "name")


_MEAN = "list_transform(embedding[1:32]::DOUBLE[], lambda x, i: (x + embedding[i + 32]::DOUBLE) / 2)"


@query(
    "src19_voice_samples",
    f"""SELECT vec_id, CAST(i AS INTEGER) AS i, round(s, 6) AS sample FROM (SELECT vec_id, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM (SELECT vec_id, list_transform(v, lambda x: x * 0.95 / greatest(p, 0.95)) AS v
 FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS p FROM (SELECT vec_id, list_transform({_MEAN}, lambda x: x * 8)[1:20] AS v FROM embeddings))))""",
)
def src19(spark, d):
    """The mean of two channels (the halves of a vector, eight times as loud), its first 20 seconds of one sample each, scaled."""
    v = F.col("embedding")
    mean = F.transform(A.channel_mean(F.slice(v, 1, 32), F.slice(v, 33, 32)), lambda x: x * 8)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(readers.voice_sample(mean, F.lit(1))).alias("i", "s"))
    return rows.select("vec_id", (F.col("i") + 1).alias("i"), F.round("s", 6).alias("sample"))


@query(
    "src20_batch_status",
    f"SELECT book, CASE WHEN count(text) < count(*) THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (type = 'body') AS bodies, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (type NOT IN ('body', 'heading')) AS others FROM {S.BLOCKS} b GROUP BY book",
)
def src20(spark, d):
    """A book fails if one of its blocks has no text; the others count by type all the same."""
    rows = table(spark, d, "blocks").dropDuplicates(["book", "block_no"])
    kind = F.col("type")
    return rows.groupBy("book").agg(
        F.when(F.count("text") < F.count("*"), "failed").otherwise("ok").alias("status"),
        F.count_if(kind == "body").alias("bodies"), F.count_if(kind == "heading").alias("headings"), F.count_if(~kind.isin("body", "heading")).alias("others"),
    )


@query("src16_pairs", f"SELECT book, block_no, role, text, after_ms FROM (SELECT book, block_no, type AS role, text, 0 AS after_ms FROM {_B} UNION ALL SELECT book, block_no, 'echo', coalesce(type, ''), block_no FROM {_B})")
def src16(spark, d):
    """Two segments in a command line of JSON, both read back; one more or less would be an error."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    record = lambda role, text, ms: F.concat(F.lit(" role = "), quote(role), F.lit(" text = "), quote(text), F.lit(" after_ms = "), ms.cast("string"))
    line = F.concat(F.lit("say"), record(F.col("type"), F.col("text"), F.lit(0)), record(F.lit("echo"), F.coalesce("type", F.lit("")), F.col("block_no")))
    back = F.from_json(F.to_json(F.struct(line.alias("command"))), "command string")["command"]
    return blocks_once(spark, d).select("book", "block_no", F.inline(readers.exactly(readers.embedded_segments(back), 2)))


@query("src17_by_stem", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7 WHERE a.vec_id % 3 > 0")
def src17(spark, d):
    """Vectors of two folders matched by the stem of their file names; those without a partner are left out."""
    rows = table(spark, d, "embeddings")
    name = lambda folder, n: F.concat(F.lit(f"/{folder}/voice_"), n.cast("string"), F.lit(".npy"))
    a = rows.where(F.col("vec_id") % 3 > 0).select("vec_id", T.file_stem(name("reference", F.col("vec_id"))).alias("stem"), F.col("embedding").alias("x"))
    b = rows.select(T.file_stem(name("test", F.col("vec_id") - 7)).alias("stem"), F.col("embedding").alias("y"))
    return a.join(b, "stem").select("vec_id", (F.round(A.cosine(F.col("x"), F.col("y")), 4) + 0.0).alias("cosine"))


@query("src21_json_rows", "SELECT event_id, CASE WHEN props->>'k' IS NULL THEN 'no k' WHEN CAST(props->>'k' AS INTEGER) NOT BETWEEN 0 AND 50 THEN 'out of range' END AS error FROM events")
def src21(spark, d):
    """Rows of JSON that is no object, has no k, or one out of range."""
    k = F.from_json("props", "k int")["k"]
    whole = F.trim("props").startswith("{")
    return table(spark, d, "events").select("event_id", F.when(~whole, "no object").when(k.isNull(), "no k").when(~k.between(0, 50), "out of range").alias("error"))


@query("jsn02_nested", f"SELECT book, block_no, type, source_page AS first_page, source_page_end AS last_page FROM {_B}")
def jsn02(spark, d):
    """Blocks written as nested JSON and read back."""
    doc = F.to_json(F.struct("book", F.struct("block_no", "type", F.struct(F.col("source_page").alias("first"), F.col("source_page_end").alias("last")).alias("pages")).alias("block")))
    back = F.from_json(doc, "book string, block struct<block_no:int,type:string,pages:struct<first:int,last:int>>")
    rows = blocks_once(spark, d).select(back.alias("j"))
    return rows.select("j.book", "j.block.block_no", "j.block.type", F.col("j.block.pages.first").alias("first_page"), F.col("j.block.pages.last").alias("last_page"))


# ---- sinks, each read back


@query("snk01_blocks_back", "SELECT book, block_no, type, text, source_page FROM (SELECT DISTINCT * FROM blocks) WHERE book IS NOT NULL")
def snk01(spark, d):
    path = scratch(spark, "blocks")
    writers.write_blocks(table(spark, d, "blocks").where(F.col("book").isNotNull()).dropDuplicates(["book", "block_no"]), path)
    kind = "book string, block_no int, type string, text string, source_page int"
    return spark.read.schema(kind).json(path).select("book", "block_no", "type", "text", "source_page")


@query("snk02_upsert_back", f"SELECT book, chunk_idx, frames, sr FROM {DONE}")
def snk02(spark, d):
    """Segments of an even sample rate step as the state, all others as its changes; the newest of each piece stays."""
    rows = table(spark, d, "segments").where(F.col("frames").isNotNull() & F.col("sr").isNotNull())
    path = scratch(spark, "state")
    order = [F.desc_nulls_last("written_at"), F.desc_nulls_last("loaded_at"), F.desc("frames"), F.desc("sr")]
    older = F.col("chunk_idx") % 2 == 0
    newest = lambda x: schedule.latest(x, ["book", "chunk_idx"], order)
    writers.upsert(newest(rows.where(older)), newest(rows.where(~older)), ["book", "chunk_idx"], "written_at", path)
    return spark.read.parquet(path).select("book", "chunk_idx", "frames", "sr")


@query("snk07_delivered", "SELECT book, chunk_idx, frames FROM (SELECT DISTINCT book, chunk_idx, max(frames) AS frames FROM segments WHERE book IS NOT NULL AND frames IS NOT NULL GROUP BY book, chunk_idx)")
def snk07(spark, d):
    """Segments delivered twice: the second delivery of a book replaces the first."""
    rows = table(spark, d, "segments").where(F.col("book").isNotNull() & F.col("frames").isNotNull()).groupBy("book", "chunk_idx").agg(F.max("frames").alias("frames"))
    path = scratch(spark, "segments")
    writers.write_segments(rows.withColumn("frames", F.lit(0).cast("bigint")), path)
    writers.write_segments(rows, path)
    return spark.read.schema("chunk_idx int, frames bigint, book string").parquet(path).select("book", "chunk_idx", "frames")


@query("snk09_log_back", "SELECT 'made ' || count(*) AS message FROM segments GROUP BY sr")
def snk09(spark, d):
    """Lines appended to a log, read back without their times."""
    path = scratch(spark, "log")
    writers.append_log(table(spark, d, "segments").groupBy("sr").agg(F.concat(F.lit("made "), F.count("*")).alias("message")).select("message"), path)
    return spark.read.schema("value string").text(path).select(F.regexp_replace("value", r"\A\[[0-9:]{8}\] ", "").alias("message"))


@query("snk10_report", "SELECT string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT coalesce(status, '-') || ': ' || count(*) AS line FROM (SELECT DISTINCT * FROM jobs) GROUP BY status) HAVING count(*) > 0")
def snk10(spark, d):
    facts = jobs_once(spark, d, "status").groupBy(F.coalesce("status", F.lit("-")).alias("name")).agg(F.count("*").cast("string").alias("value"))
    return writers.report(facts).where(F.col("text") != "")


_CHAPTERS = f"""(SELECT book, block_no, text, greatest(1, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY block_no)) AS chapter FROM {_B} AND book IS NOT NULL)"""


def _chapter_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks_once(spark, d).where(F.col("book").isNotNull()).select("book", "block_no", "text", (F.col("type") == "heading").cast("int").alias("h"))
    opened = running_sum(rows, "book", "block_no", F.col("h"), "c", inclusive=True)
    return opened.select("book", F.greatest(F.lit(1), "c").cast("bigint").alias("chapter"), F.col("block_no").alias("order_no"), "text")


@query("snk11_combined", f"SELECT book, chapter::BIGINT AS chapter, block_no::BIGINT AS order_no, text AS value FROM {_CHAPTERS} UNION ALL SELECT DISTINCT book, chapter::BIGINT, -1, '===== CHAPTER ' || chapter || ' =====' FROM {_CHAPTERS}")
def snk11(spark, d):
    """All chapters of a book, opened by its headings, with a line before each."""
    return writers.combined_book(_chapter_rows(spark, d))


@query("snk11_chapter_files", f"SELECT book, chapter::BIGINT AS chapter, count(*) AS blocks FROM {_CHAPTERS} GROUP BY ALL")
def snk11_files(spark, d):
    """Blocks found in each chapter's folder of text."""
    path = scratch(spark, "chapters")
    writers.chapter_files(_chapter_rows(spark, d).withColumn("text", F.lit("x")), path)
    rows = spark.read.text(path)
    if "chapter" not in rows.columns:  # nothing was written, so there are no folders
        rows = rows.select("value", F.lit("").alias("book"), F.lit(0).alias("chapter")).limit(0)
    rows = rows.where(F.col("value") == "x").select(F.col("book").cast("string").alias("book"), F.col("chapter").cast("bigint").alias("chapter"))
    return rows.groupBy("book", "chapter").agg(F.count("*").alias("blocks"))


@query("snk12_tagged_back", f"SELECT book, block_no, type, text FROM {_B}")
def snk12(spark, d):
    path = scratch(spark, "tagged")
    writers.write_tagged(blocks_once(spark, d), path)
    return spark.read.schema("book string, block_no int, type string, text string").json(path)


@query("snk13_facts_back", f"SELECT book, 'plan_total' AS name, count(*)::VARCHAR AS value FROM {S.PLAN} p GROUP BY book")
def snk13(spark, d):
    path = scratch(spark, "facts")
    writers.write_facts(plan_once(spark, d).groupBy("book").agg(F.count("*").alias("value")).withColumn("name", F.lit("plan_total")), path)
    return spark.read.schema("book string, name string, value string").parquet(path)


def _tag(column: str) -> str:
    return f"CASE WHEN coalesce({S.strip(column)}, '') <> '' THEN '{column}=' || replace({S.sub(column, r'([\\=;#])', chr(92) * 2 + chr(92) + '1')}, chr(10), ' ') END"


@query(
    "snk04_ffmeta_tags",
    f"""SELECT book, concat_ws(chr(10), ';FFMETADATA1', {_tag('title')}, {_tag('voice')}, {_tag('lang')}, body) AS text
 FROM (SELECT book, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || replace({S.sub('title', r'([\\=;#])', chr(92) * 2 + chr(92) + '1')}, chr(10), ' '), chr(10) ORDER BY start_ms) AS body FROM {ENDED} GROUP BY book)
 JOIN (SELECT DISTINCT id AS book, title, voice, lang FROM jobs) USING (book)""",
)
def snk04(spark, d):
    return timeline.metadata_text(chapters(spark, d), jobs_once(spark, d, "title", "voice", "lang"), ("title", "voice", "lang"))


# ---- predicates and small functions


@query(
    "str15_forms",
    """SELECT path, CASE WHEN b > 1e9 THEN printf('%.2f', round(b / 1e9, 2)) || ' GB' WHEN b > 1e6 THEN printf('%.1f', round(b / 1e6, 1)) || ' MB' ELSE floor(b / 1024.0 + 0.5)::BIGINT || ' KB' END AS bytes,
 CASE WHEN e IS NULL THEN '' WHEN e >= 3600 THEN 'about ' || e // 3600 || 'h ' || e % 3600 // 60 || 'm left' WHEN e >= 60 THEN 'about ' || e // 60 || 'm left' ELSE 'under a minute left' END AS eta
 FROM (SELECT path, pages::BIGINT * pages * 9000 AS b, CASE WHEN pages % 5 > 0 THEN pages * 31 END AS e FROM library WHERE pages IS NOT NULL)""",
)
def str15(spark, d):
    n = F.col("pages").cast("bigint")
    rows = table(spark, d, "library").where(n.isNotNull())
    return rows.select("path", T.bytes_text(n * n * 9000).alias("bytes"), T.eta_text(F.when(n % 5 > 0, n * 31)).alias("eta"))


@query("prd17_engines", "SELECT id AS book, CASE WHEN engine IN ('batched', 'serial') THEN engine ELSE 'batched' END AS engine FROM (SELECT DISTINCT id, engine FROM jobs)")
def prd17(spark, d):
    """The engine of a job if it is a known one, else the default."""
    return jobs_once(spark, d, "engine").select("book", F.when(F.col("engine").isin("batched", "serial"), F.col("engine")).otherwise("batched").alias("engine"))


@query("prd22_preflight", "SELECT id AS book, CASE WHEN voice IS NULL OR voice = '' THEN 'no voice' WHEN engine = 'parallel' AND lang IS NULL THEN 'no language' END AS error FROM (SELECT DISTINCT id, voice, engine, lang FROM jobs)")
def prd22(spark, d):
    """The first thing that a job lacks, null if nothing."""
    rows = jobs_once(spark, d, "voice", "engine", "lang")
    return rows.select("book", F.when(F.coalesce("voice", F.lit("")) == "", "no voice").when((F.col("engine") == "parallel") & F.col("lang").isNull(), "no language").alias("error"))


_PLAIN, _MARKED = {"exaggeration": 0.5, "cfg_weight": 0.5, "temperature": 0.8}, {"exaggeration": 0.7, "cfg_weight": 0.35, "temperature": 0.8}
_VALUES = ", ".join(f"('{k}', '{n}', {v}::DOUBLE)" for n, m in (("body", _PLAIN), ("dialogue", _MARKED)) for k, v in m.items())


@query("map01_parameters", f"SELECT book, block_no, k AS name, v AS value FROM {S.BLOCKS} b JOIN (VALUES {_VALUES}) t(k, kind, v) ON b.type = t.kind")
def map01(spark, d):
    """Parameters by the kind of a block, from two maps."""
    made = lambda m: F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(v))))
    rows = table(spark, d, "blocks").where(F.col("type").isin("body", "dialogue")).dropDuplicates(["book", "block_no"])
    return rows.select("book", "block_no", F.explode(F.when(F.col("type") == "dialogue", made(_MARKED)).otherwise(made(_PLAIN))).alias("name", "value"))


@query("dat02_iso", "SELECT DISTINCT book, chunk_idx, strftime(written_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM segments WHERE written_at IS NOT NULL")
def dat02(spark, d):
    """Times as ISO stamps; the tables' times are UTC without a zone."""
    rows = table(spark, d, "segments").where(F.col("written_at").isNotNull())
    return rows.select("book", "chunk_idx", F.date_format("written_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")).distinct()


@query("arr05_joined_samples", "SELECT label, CAST(i AS INTEGER) AS i, round(s, 6) AS sample FROM (SELECT label, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM (SELECT label, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS v FROM embeddings GROUP BY label))")
def arr05(spark, d):
    """The samples of a label one after another: places are counted from the sizes before, so no array of a whole label is made."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("v"))
    placed = running_sum(rows, "label", "vec_id", F.size("v"), "before")
    return placed.select("label", "before", F.posexplode("v").alias("i", "s")).select("label", (F.col("before") + F.col("i") + 1).cast("int").alias("i"), F.round("s", 6).alias("sample"))


@query("arr07_trimmed", "SELECT vec_id, len(embedding[1:round_even(64 / 9.0::DOUBLE * (label % 10), 0)::INTEGER])::INTEGER AS samples FROM embeddings")
def arr07(spark, d):
    """Samples left of a padded output for its own tokens (the label) of the longest nine."""
    return table(spark, d, "embeddings").select("vec_id", F.size(A.trim_back(F.col("embedding"), F.col("label") % 10, F.lit(9))).alias("samples"))


@query("agg25_loudness", "SELECT vec_id, round(CASE WHEN r > 0 THEN least(0.1 / r, 0.99 / p) ELSE 1.0 END, 6)::DOUBLE AS scale FROM (SELECT vec_id, sqrt(list_dot_product(v, v) / len(v)) AS r, list_max(list_transform(v, lambda x: abs(x))) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def agg25(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(A.loudness_scale(F.col("embedding"), 0.1), 6).alias("scale"))


# ---- plans

_PARAS = f"list_filter(list_transform(string_split_regex(text, '\\n{S.WS}*\\n'), lambda p: {S.collapse('p')}), lambda p: p <> '')"
_OWN = f"(SELECT doc_id, para, list_filter(list_append(p.o, p.c), lambda w: w <> '') AS parts FROM (SELECT doc_id, para, {pack_sql('x')} AS p FROM (SELECT doc_id, unnest({_PARAS}) AS x, generate_subscripts({_PARAS}, 1) AS para FROM documents WHERE text IS NOT NULL)))"


@query("fld01b_paragraph_ends", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, i) AS INTEGER) AS pos, text, i = k AS end_of_paragraph FROM (SELECT doc_id, para, unnest(parts) AS text, generate_subscripts(parts, 1) AS i, len(parts) AS k FROM {_OWN})")
def fld01b(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    rows = docs.select("doc_id", F.posexplode(planning.pack_paragraphs(readers.paragraphs(F.col("text")))).alias("i", "r"))
    return rows.select("doc_id", (F.col("i") + 1).alias("pos"), "r.text", "r.end_of_paragraph")


@query(
    "fld04_retried",
    """WITH a AS (SELECT book, chunk_idx, frames, row_number() OVER (PARTITION BY book, chunk_idx ORDER BY written_at, loaded_at, frames) AS attempt FROM (SELECT DISTINCT * FROM segments) WHERE frames IS NOT NULL),
 c AS (SELECT book, chunk_idx, n AS attempt, CASE WHEN n = 1 THEN f1 ELSE f1 + 1000 * n END AS frames FROM (SELECT book, chunk_idx, frames AS f1 FROM a WHERE attempt = 1), range(1, 5) t(n) WHERE n <= 1 + chunk_idx % 4)
 SELECT book, chunk_idx, CAST(min(attempt) FILTER (frames < 150000) AS INTEGER) AS attempt, CASE WHEN min(attempt) FILTER (frames < 150000) IS NOT NULL THEN 'sound' WHEN count(*) > 3 THEN 'error' ELSE 'retry' END AS state FROM c GROUP BY book, chunk_idx""",
)
def fld04(spark, d):
    """Pieces tried up to four times, each time a little longer: sound, to be tried again, or an error after three repeats."""
    w = Window.partitionBy("book", "chunk_idx").orderBy(F.asc_nulls_last("written_at"), F.asc_nulls_last("loaded_at"), "frames")
    rows = table(spark, d, "segments").distinct().where(F.col("frames").isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    tries = rows.select("book", "chunk_idx", "frames", F.explode(F.sequence(F.lit(1), 1 + F.col("chunk_idx") % 4)).alias("attempt"))
    tries = tries.withColumn("frames", F.when(F.col("attempt") > 1, F.col("frames") + 1000 * F.col("attempt")).otherwise(F.col("frames")))
    return schedule.retried(tries, ["book", "chunk_idx"], "attempt", F.col("frames"), 150_000)


@query("pln02_sample_plan", f"SELECT book, chunk_idx, text, heading IS NOT NULL AS heading FROM ({PLAN_SQL})")
def pln02(spark, d):
    """A plan without pauses, headings marked."""
    return built_plan(spark, d).select("book", "chunk_idx", "text", F.col("heading").isNotNull().alias("heading"))


@query(
    "pln03_gaps",
    f"""SELECT book, chunk_idx, 'speak' AS kind, length(text)::BIGINT AS size FROM {S.PLAN} p WHERE text IS NOT NULL UNION ALL
 SELECT book, chunk_idx, 'gap', after_ms::BIGINT FROM (SELECT *, lead(chunk_idx) OVER (PARTITION BY book ORDER BY chunk_idx) AS n FROM {S.PLAN} p) WHERE n IS NOT NULL AND after_ms > 0""",
)
def pln03(spark, d):
    """Pieces, and a row of its own for each pause between two of them."""
    plan = plan_once(spark, d)
    spoken = plan.where(F.col("text").isNotNull()).select("book", "chunk_idx", F.lit("speak").alias("kind"), F.length("text").cast("bigint").alias("size"))
    gaps = next_row(plan.select("book", "chunk_idx", "after_ms"), "book", "chunk_idx", ["chunk_idx"], "_n_").where(F.col("_n_chunk_idx").isNotNull() & (F.col("after_ms") > 0))
    return spoken.unionByName(gaps.select("book", "chunk_idx", F.lit("gap").alias("kind"), F.col("after_ms").cast("bigint").alias("size")))


_SENT = S.sentences("text")
_SPANS = f"(SELECT book, block_no, text, i, s, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY book, block_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS a FROM (SELECT book, block_no, text, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM {_B}))"
_CLEAN = "(starts_with(s, '“') AND ends_with(s, '”') AND length(s) - length(replace(s, '“', '')) = 1 AND length(s) - length(replace(s, '”', '')) = 1)"


@query(
    "pln04_segments",
    f"""SELECT arm, book, block_no, CAST(i AS INTEGER) AS part_no, a AS first_sign, 20260730 + a AS seed, CASE WHEN arm = 'roles' AND {_CLEAN} THEN 'character' ELSE 'narrator' END AS role FROM {_SPANS}, (VALUES ('plain'), ('roles')) t(arm)""",
)
def pln04(spark, d):
    """The sentences of a block in two arms, with their spans, seeds by span and roles; only the second arm tells roles."""
    rows = blocks_once(spark, d).withColumn("parts", T.split_sentences(F.col("text")))
    parts = rows.select("book", "block_no", F.posexplode(F.arrays_zip("parts", planning.spans(F.col("parts")).alias("spans"))).alias("i", "r"))
    arms = parts.select("book", "block_no", (F.col("i") + 1).alias("part_no"), F.col("r.parts").alias("s"), F.col("r.spans.start").alias("first_sign"), F.explode(F.array(F.lit("plain"), F.lit("roles"))).alias("arm"))
    role = F.when((F.col("arm") == "roles") & T.is_clean_turn(F.col("s")), "character").otherwise("narrator")
    return arms.select("arm", "book", "block_no", "part_no", "first_sign", (20260730 + F.col("first_sign")).alias("seed"), role.alias("role"))


@query(
    "pln06_proof",
    f"""WITH a AS (SELECT book, chunk_idx, text, before_ms, after_ms FROM {S.PLAN} p), b AS (SELECT book, chunk_idx, text, before_ms, CASE WHEN after_ms = 650 THEN 900 ELSE after_ms END AS after_ms FROM a)
 SELECT (SELECT count(*) FROM (SELECT book, chunk_idx, text, before_ms FROM a EXCEPT ALL SELECT book, chunk_idx, text, before_ms FROM b)) AS other_fields, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS other_pauses""",
)
def pln06(spark, d):
    """Two arms differ in no field but the one that is tried: rows of one that the other doesn't have."""
    a = plan_once(spark, d).select("book", "chunk_idx", "text", "before_ms", "after_ms")
    b = a.withColumn("after_ms", F.when(F.col("after_ms") == 650, 900).otherwise(F.col("after_ms")))

    def rest(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        signed = x.withColumn("_n", F.lit(1)).unionByName(y.withColumn("_n", F.lit(-1))).groupBy(*x.columns).agg(F.sum("_n").alias("_n"))
        return signed.groupBy().agg(F.coalesce(F.sum(F.greatest(F.lit(0), "_n")), F.lit(0)).alias(name))

    fields, pauses = rest(a.drop("after_ms"), b.drop("after_ms"), "other_fields"), rest(a, b, "other_pauses")
    one = F.lit(1).alias("_k")  # one row each
    return fields.select("*", one).join(pauses.select("*", one), "_k").drop("_k")


@query(
    "jon09_zipped",
    f"""SELECT book, block_no, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS same_length, count(*) FILTER (sha256(a) IS DISTINCT FROM sha256(b)) AS differ FROM
 (SELECT coalesce(x.book, y.book) AS book, coalesce(x.block_no, y.block_no) AS block_no, x.s AS a, y.s AS b FROM (SELECT book, block_no, i, s FROM {_SPANS}) x FULL JOIN
 (SELECT book, block_no, unnest({S.sentences(S.strip_markdown('text'))}) AS s, generate_subscripts({S.sentences(S.strip_markdown('text'))}, 1) AS i FROM {_B}) y ON x.book = y.book AND x.block_no = y.block_no AND x.i = y.i) GROUP BY book, block_no""",
)
def jon09(spark, d):
    """Sentences before and after markdown is stripped, paired by place: equal in number, and how many differ."""
    rows = blocks_once(spark, d)
    parts = lambda c, name: rows.select("book", "block_no", F.posexplode(T.split_sentences(c)).alias("i", name))
    both = parts(F.col("text"), "a").join(parts(T.strip_markdown(F.col("text")), "b"), ["book", "block_no", "i"], "full")
    return both.groupBy("book", "block_no").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_length"), F.count_if(~F.sha2("a", 256).eqNullSafe(F.sha2("b", 256))).alias("differ"))


_OPEN = ["queued", "narrating"]


@query("jon06_in_use", f"SELECT a.id AS book FROM (SELECT DISTINCT id, folder FROM jobs) a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT id, folder, status FROM jobs) b WHERE lower(a.folder) = lower(b.folder) AND a.id <> b.id AND b.status IN ('queued', 'narrating'))")
def jon06(spark, d):
    """Jobs whose folder another job that isn't finished needs; a folder stands for a file, as no file of the tables has two jobs."""
    return catalog.in_use(jobs_once(spark, d, "folder", "status"), "book", "folder", "status", _OPEN)


_COUNTS = f"""(SELECT p.book, total, coalesce(done, 0) AS done, secs, last_chunk, bytes FROM (SELECT book, count(*) AS total FROM {S.PLAN} x GROUP BY book) p
 LEFT JOIN (SELECT book, count(DISTINCT chunk_idx) AS done, (epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1e6 AS secs, max(chunk_idx) AS last_chunk, sum(2 * frames)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM segments) WHERE frames IS NOT NULL GROUP BY book) s USING (book))"""
_MESSAGE = "CASE WHEN total > 0 AND done >= total THEN 'assembling' WHEN done = 0 THEN 'loading' ELSE 'generating' END"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    total = table(spark, d, "chunk_plan").select("book", "chunk_idx").distinct().groupBy("book").agg(F.count("*").alias("total"))
    rows = table(spark, d, "segments").distinct().where(F.col("frames").isNotNull())
    seg = rows.groupBy("book").agg(F.count_distinct("chunk_idx").alias("done"), ((F.max(micros("written_at")) - F.min(micros("written_at"))) / 1e6).alias("secs"), F.max("chunk_idx").alias("last_chunk"), F.sum(2 * F.col("frames")).alias("bytes"))
    return total.join(seg, "book", "left").withColumn("done", F.coalesce("done", F.lit(0)))


def _message():
    return F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "assembling").when(F.col("done") == 0, "loading").otherwise("generating")


@query("agg12_messages", f"SELECT book, done, total, {_MESSAGE} AS message FROM {_COUNTS}")
def agg12(spark, d):
    """What a job is doing, told by what it has done."""
    return _counts(spark, d).select("book", "done", "total", _message().alias("message"))


@query(
    "jon11_details",
    f"""SELECT id AS book, status, done, total, {_MESSAGE} AS message, round(CASE WHEN total > done AND done > 0 AND secs > 0 THEN (total - done) * secs / done END, 3) AS seconds_left, last_chunk, bytes FROM (SELECT DISTINCT id, status FROM jobs) j JOIN {_COUNTS} c ON c.book = j.id""",
)
def jon11(spark, d):
    """A job with its progress, the last of its log (the last piece made) and the bytes of what came out."""
    rows = jobs_once(spark, d, "status").join(_counts(spark, d), "book")
    left = metrics.progress(F.col("total"), F.col("done"), F.col("secs"), F.lit(0))
    return rows.select("book", "status", "done", "total", _message().alias("message"), F.round(left, 3).alias("seconds_left"), "last_chunk", "bytes")


# ---- aggregates


@query("agg18_outliers_5x", f"WITH r AS (SELECT sr, frames, median(frames) OVER (PARTITION BY sr) AS m FROM {DONE}) SELECT sr, count(*) AS rows, count(*) FILTER (frames > 5.0 * m) AS outliers, sum(frames)::BIGINT AS total, sum(CASE WHEN frames > 5.0 * m THEN m ELSE frames END)::DOUBLE AS cleaned FROM r GROUP BY sr")
def agg18(spark, d):
    return metrics.outliers(finished(spark, d), ["sr"], "frames")


@query(
    "agg20_arms",
    f"""SELECT arm, count(*) AS books, round(avg(estimate / total), 6) AS ratio, count(*) FILTER (abs(estimate - total) / total <= 0.25) AS trusted FROM (SELECT arm, book, sum(f)::DOUBLE AS total, avg(f) FILTER (chunk_idx % 2 = 0) * count(*) AS estimate
 FROM (SELECT book, chunk_idx, arm, CASE WHEN arm = 'short' THEN frames // 2 ELSE frames END AS f FROM {DONE} d, (VALUES ('plain'), ('short')) t(arm)) GROUP BY arm, book) WHERE total > 0 AND estimate IS NOT NULL GROUP BY arm""",
)
def agg20(spark, d):
    """For each arm, how near the estimate from every second piece comes to what was measured, and the books within 25 %."""
    rows = finished(spark, d).select("book", "chunk_idx", "frames", F.explode(F.array(F.lit("plain"), F.lit("short"))).alias("arm"))
    rows = rows.withColumn("f", F.when(F.col("arm") == "short", F.floor(F.col("frames") / 2)).otherwise(F.col("frames")))
    books = rows.groupBy("arm", "book").agg(F.sum("f").cast("double").alias("total"), (F.avg(F.when(F.col("chunk_idx") % 2 == 0, F.col("f"))) * F.count("*")).alias("estimate")).where("total > 0 and estimate is not null")
    far = F.abs(F.col("estimate") - F.col("total")) / F.col("total")
    return books.groupBy("arm").agg(F.count("*").alias("books"), F.round(F.avg(F.col("estimate") / F.col("total")), 6).alias("ratio"), F.count_if(far <= 0.25).alias("trusted"))


_HASH = f"""(WITH r AS (SELECT book, block_no, block_no // 4096 AS b, sha256(CAST(to_json([type, text]) AS VARCHAR)) AS h FROM {S.BLOCKS} x), g AS (SELECT book, b, sha256(string_agg(h, chr(30) ORDER BY block_no)) AS h FROM r GROUP BY book, b)
 SELECT book, sha256(string_agg(h, chr(30) ORDER BY b)) AS digest FROM g GROUP BY book)"""
_IDENTITY = f"(SELECT h.book, sha256(CAST(to_json([digest, coalesce(path, ''), coalesce(voice, ''), '3']) AS VARCHAR)) AS identity FROM {_HASH} h JOIN (SELECT DISTINCT id, path, voice FROM jobs) j ON j.id = h.book)"


def _identities(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    digests = planning.plan_hash(table(spark, d, "blocks").dropDuplicates(["book", "block_no"]), "book", "block_no", columns)
    return planning.identity(digests, jobs_once(spark, d, "path", "voice"), "book", ["path", "voice"], "3")


@query("agg21_identity", f"SELECT book, identity FROM {_IDENTITY}")
def agg21(spark, d):
    """The identity of a job's audio: its blocks' types and texts, path, voice and the planner's version."""
    return _identities(spark, d, ["type", "text"])


@query(
    "agg22_staleness",
    f"""SELECT book, CASE WHEN k = 0 THEN 'fresh' WHEN k IN (1, 3) THEN 'current' ELSE 'stale' END AS state FROM (SELECT book, ascii(substr(sha256(book), 1, 1)) % 5 AS k FROM {_IDENTITY})""",
)
def agg22(spark, d):
    """By the first sign of a book's digest: no old identity, the same one, another one, the same in the earlier form, another in that form."""
    new = _identities(spark, d, ["type", "text"]).withColumnRenamed("identity", "digest")
    legacy = _identities(spark, d, ["type", "text", "source_page"]).withColumnRenamed("identity", "legacy")
    k = F.ascii(F.substring(F.sha2("book", 256), 1, 1)) % 5
    both = new.join(legacy, "book")
    old = F.when(k == 1, F.concat(F.lit("v2:"), "digest")).when(k == 2, F.concat(F.lit("v2:"), F.reverse("digest"))).when(k == 3, F.col("legacy")).otherwise(F.reverse("legacy"))
    return planning.staleness(both, both.where(k != 0).select("book", old.alias("digest")), "book")


_TURN = _CLEAN.replace("(s,", "(text,").replace("(s)", "(text)")
_TURNS = f"""(SELECT *, row_number() OVER w AS place, sum(n0) OVER w AS upto, sum(t0) OVER w AS turns, sum(s0) OVER w AS short
 FROM (SELECT book, block_no, length(text) AS n0, {_TURN}::INT AS t0, ({_TURN} AND length(text) <= 60)::INT AS s0 FROM {_B}) WINDOW w AS (PARTITION BY book ORDER BY block_no))"""


@query(
    "agg24_turns",
    f"""WITH r AS (SELECT * FROM {_TURNS}), z AS (SELECT a.book, a.block_no, n AS blocks, e.upto - a.upto + a.n0 + n - 1 AS signs, e.turns - a.turns + a.t0 AS turns, e.short - a.short + a.s0 AS short
 FROM r a CROSS JOIN range(1, 5) t(n) JOIN r e ON e.book = a.book AND e.place = a.place + n - 1)
 SELECT book, -m[2]::INTEGER AS block_no, -m[3]::INTEGER AS blocks, m[1] AS score FROM (SELECT book, max([(2 * short + turns)::BIGINT, -block_no, -blocks]) AS m FROM z WHERE signs BETWEEN 100 AND 900 GROUP BY book)""",
)
def agg24(spark, d):
    """The run of up to four blocks of 100 to 900 signs with the most quoted turns, short ones counting thrice; the first of equal ones."""
    turn = T.is_clean_turn(F.col("text"))
    rows = blocks_once(spark, d).select("book", "block_no", F.length("text").cast("bigint").alias("n"), turn.cast("int").alias("t"), (turn & (F.length("text") <= 60)).cast("int").alias("s"))
    rows = running_sums(rows, "book", "block_no", {"upto": F.col("n"), "place": F.lit(1), "turns": F.col("t"), "short": F.col("s")}, inclusive=True)
    first = rows.select("book", "block_no", "place", (F.col("upto") - F.col("n")).alias("a"), (F.col("turns") - F.col("t")).alias("b"), (F.col("short") - F.col("s")).alias("c"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("blocks"))
    last = rows.select("book", F.col("place").alias("_p"), "upto", "turns", "short")
    runs = first.withColumn("_p", F.col("place") + F.col("blocks") - 1).join(last, ["book", "_p"])
    good = runs.where((F.col("upto") - F.col("a") + F.col("blocks") - 1).between(100, 900))
    score = 2 * (F.col("short") - F.col("c")) + F.col("turns") - F.col("b")
    best = good.groupBy("book").agg(F.max(F.struct(score.alias("score"), (-F.col("block_no")).alias("x"), (-F.col("blocks")).alias("y"))).alias("m"))
    return best.select("book", (-F.col("m.x")).alias("block_no"), (-F.col("m.y")).alias("blocks"), F.col("m.score").alias("score"))
