"""Queries of the text functions over blocks, jobs, library and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.plans import sqlgen as S
from folioflow.sources.tables import jobs_once, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def blocks_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with text, rows stored twice once."""
    return table(spark, sf_dir, "blocks").where(F.col("text").isNotNull()).dropDuplicates(["book", "block_no"])


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, line_no, line) of every block with text; line_no from 1."""
    return blocks_once(spark, sf_dir).select("book", "block_no", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).select("book", "block_no", (F.col("i") + 1).alias("line_no"), "line")


_B = f"{S.BLOCKS} b WHERE text IS NOT NULL"
LINES_SQL = f"(SELECT book, block_no, unnest({S.lines('text')}) AS line, CAST(generate_subscripts({S.lines('text')}, 1) AS INTEGER) AS line_no FROM {_B})"


@query("str01_strip_markdown", f"SELECT book, block_no, {S.strip_markdown('text')} AS plain, {S.emphasis('text', 6)} <> {S.emphasis('text', 7)} AS residue FROM {_B}")
def str01(spark, d):
    return blocks_once(spark, d).select("book", "block_no", T.strip_markdown(F.col("text")).alias("plain"), T.markdown_residue(F.col("text")).alias("residue"))


_LIG = "text"
for _a, _b in T.LIGATURES.items():
    _LIG = f"replace({_LIG}, {S.q(_a)}, {S.q(_b)})"


@query("str02_ligatures", f"SELECT book, block_no, {_LIG} AS text FROM {_B}")
def str02(spark, d):
    return blocks_once(spark, d).select("book", "block_no", T.replace_ligatures(F.col("text")).alias("text"))


@query("str03_sentences", f"SELECT book, block_no, unnest({S.sentences('text')}) AS sentence, CAST(generate_subscripts({S.sentences('text')}, 1) AS INTEGER) AS pos FROM {_B}")
def str03(spark, d):
    rows = blocks_once(spark, d).select("book", "block_no", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("book", "block_no", "sentence", (F.col("i") + 1).alias("pos"))


@query("str04_clauses", f"SELECT book, block_no, unnest({S.clauses('text')}) AS clause, CAST(generate_subscripts({S.clauses('text')}, 1) AS INTEGER) AS pos FROM {_B}")
def str04(spark, d):
    rows = blocks_once(spark, d).select("book", "block_no", F.posexplode(T.split_clauses(F.col("text"))).alias("i", "clause"))
    return rows.select("book", "block_no", "clause", (F.col("i") + 1).alias("pos"))


@query("str05_quoted_ellipsis", f"SELECT book, block_no, {S.quoted_ellipsis('text')} AS text FROM {_B}")
def str05(spark, d):
    return blocks_once(spark, d).select("book", "block_no", T.normalize_quoted_ellipsis(F.col("text")).alias("text"))


@query(
    "str06_title_forms",
    rf"""SELECT id AS book, replace({S.sub('title', r'([\\=;#])', chr(92) * 2 + chr(92) + '1')}, chr(10), ' ') AS escaped,
 coalesce(nullif({S.strip(S.sub('title', r'[^\p{L}\p{M}\p{Nd}\p{Pc} \-]'))}, ''), 'audiobook') AS safe,
 {S.sub(S.sub('title', r'[<>:"/\\|?*\x00-\x1f]', '_'), '^[ .]+|[ .]+$')} AS file_name, {S.collapse('title')} AS collapsed FROM (SELECT DISTINCT id, title FROM jobs)""",
)
def str06(spark, d):
    t = F.col("title")
    return jobs_once(spark, d, "title").select("book", T.ffmeta_escape(t).alias("escaped"), T.safe_title(t).alias("safe"), T.windows_name(t).alias("file_name"), T.collapse(t).alias("collapsed"))


@query("str10_hash", "SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM documents")
def str10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("chars"))


_DROP = S.sub("text", rf"""^({S.WS}*["“]?)([A-Z]){S.WS}+([a-z])""", r"\1\2\3", "")
_ROLL = S.sub("line", S.ROLL, "", "")


@query("str11_drop_caps", f"SELECT book, block_no, {_DROP} AS text FROM {_B}")
def str11(spark, d):
    return blocks_once(spark, d).select("book", "block_no", T.repair_drop_cap(F.col("text")).alias("text"))


@query("str12_roll_prefix", f"SELECT book, block_no, line_no, {_ROLL} AS line FROM {LINES_SQL}")
def str12(spark, d):
    return block_lines(spark, d).select("book", "block_no", "line_no", T.strip_roll(F.col("line")).alias("line"))


@query("str14_alias", f"SELECT book, block_no, {S.sub('text', r'(?is)^(.*?)lantern', chr(92) + '1lamp', '')} AS text, {S.match('text', '(?i)lantern')} AS replaced FROM {_B}")
def str14(spark, d):
    t = F.col("text")
    return blocks_once(spark, d).select("book", "block_no", T.replace_first(t, "lantern", "lamp").alias("text"), t.rlike("(?i)lantern").alias("replaced"))


@query(
    "str15_duration",
    """SELECT DISTINCT book, chunk_idx, frames, CASE WHEN s < 0 THEN NULL WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
 ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration
 FROM (SELECT book, chunk_idx, frames, CAST(floor(frames / sr * 60.0) AS BIGINT) AS s FROM segments WHERE frames IS NOT NULL)""",
)
def str15(spark, d):
    rows = table(spark, d, "segments").where(F.col("frames").isNotNull()).select("book", "chunk_idx", "frames", "sr").distinct()
    return rows.select("book", "chunk_idx", "frames", T.duration_text(F.col("frames") / F.col("sr") * 60.0).alias("duration")).distinct()


@query(
    "str16_paths",
    rf"""SELECT path, regexp_extract(path, '([^/\\]*)$', 1) AS name, {S.sub("regexp_extract(path, '([^/" + chr(92) * 2 + "]*)$', 1)", r'(.)\.[^.]*$', chr(92) + '1', '')} AS stem,
 lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '.(\.[^.]*)$', 1)) AS suffix FROM library""",
)
def str16(spark, d):
    p = F.col("path")
    return table(spark, d, "library").select("path", T.file_name(p).alias("name"), T.file_stem(p).alias("stem"), T.file_suffix(p).alias("suffix"))


@query("prd_line_class", f"SELECT book, block_no, line_no, {S.line_class('line')} AS kind FROM {LINES_SQL}")
def prd_line_class(spark, d):
    rows = block_lines(spark, d).withColumn("plain", T.strip_markdown(F.col("line")))
    return rows.select("book", "block_no", "line_no", T.line_class(F.col("line"), F.col("plain")).alias("kind"))


_H = [S.match(S.strip("line"), S.HEADING_LINE), S.match("line", S.CHAPTER), S.match(S.collapse("line"), S.START)]
_OUT = S.match(S.collapse("line"), S.OUTLINE)


@query("prd11_headings", f"SELECT book, block_no, line_no, {_H[0]} AS heading_line, {_H[1]} AS chapter, {S.collapse('line')} <> '' AND ({_OUT}) AS outline_title, {_H[2]} AS start FROM {LINES_SQL}")
def prd11(spark, d):
    c = F.col("line")
    return block_lines(spark, d).select(
        "book", "block_no", "line_no", T.is_heading_line(c).alias("heading_line"), T.is_chapter(c).alias("chapter"), T.is_outline_title(c).alias("outline_title"), T.is_start_heading(c).alias("start")
    )


@query("prd15_clean_turns", f"SELECT book, block_no, starts_with(text, '“') AND ends_with(text, '”') AND length(text) - length(replace(text, '“', '')) = 1 AND length(text) - length(replace(text, '”', '')) = 1 AS clean FROM {_B}")
def prd15(spark, d):
    return blocks_once(spark, d).select("book", "block_no", T.is_clean_turn(F.col("text")).alias("clean"))


@query("prd21_page_range", f"SELECT j.id AS book, greatest(1, page_from) AS first_page, least(l.pages, page_to) AS last_page FROM {S.JOBS} j JOIN library l ON j.pdf_path = l.path WHERE l.pages IS NOT NULL")
def prd21(spark, d):
    jobs = jobs_once(spark, d, "pdf_path", "page_from", "page_to")
    files = table(spark, d, "library").where(F.col("pages").isNotNull()).select(F.col("path").alias("pdf_path"), "pages")
    return jobs.join(files, "pdf_path").select("book", F.greatest(F.lit(1), "page_from").alias("first_page"), F.least("pages", "page_to").alias("last_page"))
