"""Queries over pages: tagging, stitching, paragraphs and layout.

The tables have no geometry, so x0 and y0 are derived from the lines: a line whose length is a multiple of 5 is
indented by 9 points, lines are 12 points apart and another 12 after a line whose length is a multiple of 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import layout, stitch, tagging
from folioflow.plans import sqlgen as S
from folioflow.plans.text_queries import blocks_once
from folioflow.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["book", "page"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, line_no, line): all lines of the blocks of a page in reading order."""
    rows = blocks_once(spark, sf_dir).where(F.col("source_page").isNotNull())
    lines = rows.select("book", F.col("source_page").alias("page"), "block_no", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    return lines.select("book", "page", (F.col("block_no").cast("bigint") * (1 << 20) + F.col("i")).alias("line_no"), "line")


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, line_no, x0, y0, size, text) of the lines that aren't blank."""
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = page_lines(spark, sf_dir).where(~T.is_blank(F.col("line"))).withColumn("text", T.strip(F.col("line")))
    n = F.length("text")
    rows = rows.withColumn("x0", F.when(n % 5 == 0, 81.0).otherwise(72.0)).withColumn("size", F.when(n == 1, 20.0).otherwise(10.0))
    wide = F.coalesce(F.sum((n % 7 == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("book", "page", "line_no", "x0", (12.0 * (F.row_number().over(w) + wide)).alias("y0"), "size", "text")


LINES = f"""(SELECT book, source_page AS page, CAST(block_no AS BIGINT) * 1048576 + generate_subscripts({S.lines('text')}, 1) - 1 AS line_no, unnest({S.lines('text')}) AS line
 FROM {S.BLOCKS} b WHERE text IS NOT NULL AND source_page IS NOT NULL)"""
PLACED = f"""(SELECT book, page, line_no, CASE WHEN length(text) % 5 = 0 THEN 81.0 ELSE 72.0 END::DOUBLE AS x0, CASE WHEN length(text) = 1 THEN 20.0 ELSE 10.0 END::DOUBLE AS size, text,
 (12.0 * (row_number() OVER w + coalesce(sum(CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::DOUBLE AS y0
 FROM (SELECT book, page, line_no, {S.strip('line')} AS text FROM {LINES} WHERE {S.strip('line')} <> '') WINDOW w AS (PARTITION BY book, page ORDER BY line_no))"""


def _runs_sql() -> str:
    w = "(PARTITION BY book, page ORDER BY line_no)"
    cont = lambda k: f"({k} AND NOT (coalesce(lag({k}) OVER w, false) OR (coalesce(lag(bl) OVER w, false) AND coalesce(lag({k}, 2) OVER w, false))))"
    start = lambda k, o: f"CASE WHEN {k} THEN min(CASE WHEN {k} AND {o} AND NOT sk AND NOT ht THEN line_no END) OVER (PARTITION BY book, page, isl_{k}) END AS start_{k}"
    s = S.strip("line")
    return f"""
c0 AS (SELECT book, page, line_no, line, {S.strip_markdown('line')} AS plain, {S.line_class('line')} AS kind FROM {LINES}),
c1 AS (SELECT *, kind = 'blank' AS bl, (starts_with({s}, '|') AND ends_with({s}, '|') AND length({s}) > 1) AS tr, {S.match('plain', S.DICE)} AS hd, {S.match('plain', S.ROLL + S.NOT_WS)} AS dr,
  kind IN ('page_number', 'running_header', 'markup', 'code_fence') AS sk, kind = 'html_table' AS ht, {S.number_list('line')} AS nl FROM c0),
c2 AS (SELECT *, hd OR dr AS dm FROM c1),
c3 AS (SELECT *, {cont('tr')} AS n_tr, {cont('dm')} AS n_dm, {cont('nl')} AS n_nl FROM c2 WINDOW w AS {w}),
c4 AS (SELECT *, sum(n_tr::INT) OVER w AS isl_tr, sum(n_dm::INT) OVER w AS isl_dm, sum(n_nl::INT) OVER w AS isl_nl FROM c3 WINDOW w AS {w}),
c5 AS (SELECT *, {start('tr', 'tr')}, {start('dm', 'hd')}, {start('nl', 'nl')} FROM c4),
c6 AS (SELECT *, list_sort(list(length(plain)) FILTER (dr AND line_no > start_dm) OVER (PARTITION BY book, page, isl_dm)) AS lens FROM c5)"""


_DICE = "(coalesce(len(lens), 0) >= 3 AND line_no >= start_dm)"
_MED = "lens[len(lens) // 2 + 1]"
_HEADING = f"(length(plain) BETWEEN 2 AND 60 AND NOT {S.match('plain', '[.:,;]$')} AND {S.match('plain', chr(92) + 'p{L}')} AND NOT {S.match(S.sub('plain', chr(92) + 'p{Lu}'), chr(92) + 'p{L}')})"
_ROLL = S.sub("plain", S.ROLL, "", "")
TAG_SQL = f"""WITH {_runs_sql()},
d AS (SELECT *, CASE
  WHEN bl THEN NULL
  WHEN line_no >= start_tr THEN CASE WHEN line_no = start_tr THEN ['table', '{tagging.TABLE_MARK}', 'n'] END
  WHEN line_no >= start_nl THEN CASE WHEN line_no = start_nl THEN ['omitted_data', '{tagging.DATA_MARK}', 'n'] END
  WHEN {_DICE} THEN CASE WHEN line_no = start_dm AND {_MED} < 60 THEN ['table', '{tagging.DICE_MARK}', 'n'] WHEN dr AND {_MED} >= 60 AND {_ROLL} <> '' THEN ['body', {_ROLL}, 'n'] END
  WHEN sk THEN NULL
  WHEN ht THEN ['table', '{tagging.TABLE_MARK}', 'n']
  WHEN {_HEADING} THEN ['heading', plain, 'n']
  WHEN {S.match('plain', S.SPEAKER)} THEN ['dialogue', plain, 'n']
  ELSE ['body', plain, 'y'] END AS o FROM c6),
e AS (SELECT book, page, line_no, o[1] AS type, o[2] AS text, o[3] = 'y' AS pb FROM d WHERE o IS NOT NULL),
f AS (SELECT *, pb AND coalesce(lag(type) OVER w = 'body' AND lag(text) OVER w = text, false) AS dropped FROM e WINDOW w AS (PARTITION BY book, page ORDER BY line_no)),
g AS (SELECT book, page, line_no, type, text FROM f WHERE NOT dropped),
v AS (SELECT book, page, count(*) AS n, count(DISTINCT text) AS dis, count(*) FILTER (type IN ('body', 'heading')) AS nb,
  list_sort(list(length(text)) FILTER (type IN ('body', 'heading'))) AS ls, sum(length(text)) FILTER (type IN ('body', 'heading')) AS tot, min(line_no) AS first_line FROM g GROUP BY book, page),
j AS (SELECT g.*, first_line, n >= 20 AND dis / n < 0.3 AS loop_, coalesce(nb >= 15 AND ls[nb // 2 + 1] < 30 AND tot < 900, false) AS labels FROM g JOIN v USING (book, page))
SELECT book, page, line_no, CASE WHEN labels THEN 'omitted_data' ELSE type END AS type, CASE WHEN labels THEN '{tagging.DIAGRAM_MARK}' ELSE text END AS text FROM j WHERE NOT loop_ AND (NOT labels OR line_no = first_line)"""


@query("seq01_tag_blocks", TAG_SQL)
def seq01(spark, d):
    return tagging.tag_blocks(page_lines(spark, d), PAGE)


_RUN_SQL = f"WITH {_runs_sql()} SELECT book, page, count(DISTINCT start_tr) AS table_runs, count(DISTINCT start_nl) AS number_runs, count(DISTINCT CASE WHEN len(lens) >= 3 THEN start_dm END) AS dice_tables FROM c6 GROUP BY book, page"


@query("seq02_runs", _RUN_SQL)
def seq02(spark, d):
    rows = tagging.classified(page_lines(spark, d), PAGE, "line_no", "line")
    return rows.groupBy(*PAGE).agg(
        F.count_distinct("start_tr").alias("table_runs"),
        F.count_distinct("start_nl").alias("number_runs"),
        F.count_distinct(F.when(F.col("dice_rows") >= tagging.DICE_ROWS, F.col("start_dm"))).alias("dice_tables"),
    )


@query(
    "seq05_drop_repeats",
    f"""SELECT book, block_no, type, text FROM (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px FROM {S.BLOCKS} b WHERE text IS NOT NULL AND source_page IS NOT NULL WINDOW w AS (PARTITION BY book, source_page ORDER BY block_no))
 WHERE NOT coalesce(type = 'body' AND pt = type AND px = text, false)""",
)
def seq05(spark, d):
    rows = blocks_once(spark, d).where(F.col("source_page").isNotNull())
    return tagging.drop_repeats(rows, ["book", "source_page"], "block_no", F.col("type") == "body").select("book", "block_no", "type", "text")


@query(
    "seq06_page_facts",
    f"""SELECT book, source_page AS page, count(*) AS blocks, round(count(DISTINCT text) / count(*), 6) AS distinct_share, list_sort(list(length(text)))[count(*) // 2 + 1]::INTEGER AS upper_median, sum(length(text))::BIGINT AS signs
 FROM {S.BLOCKS} b WHERE text IS NOT NULL AND source_page IS NOT NULL GROUP BY book, source_page""",
)
def seq06(spark, d):
    rows = blocks_once(spark, d).where(F.col("source_page").isNotNull()).select("book", F.col("source_page").alias("page"), "text")
    return tagging.page_facts(rows, PAGE)


_STITCH = f"""WITH r AS (SELECT book, block_no, type, text, source_page, source_page_end FROM {S.BLOCKS} b WHERE text IS NOT NULL AND {S.strip('text')} <> ''),
l AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lag(source_page) OVER w AS pp FROM r WINDOW w AS (PARTITION BY book ORDER BY block_no)),
g AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND source_page IS DISTINCT FROM pp AND type = 'body' AND pt = 'body' AND px[-1] NOT IN ('.', '?', '!', ':', ';', '”', '’', '"', '''') THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY block_no) AS grp FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY book, grp ORDER BY block_no) AS i, count(*) OVER (PARTITION BY book, grp) AS k FROM g)
SELECT book, CAST(min(block_no) AS INTEGER) AS block_no, arg_min(type, block_no) AS type,
 string_agg(CASE WHEN i > 1 AND i < k THEN {S.strip('text')} WHEN i > 1 THEN {S.sub('text', '^' + S.WS + '+')} WHEN k > 1 THEN {S.sub('text', S.WS + '+$')} ELSE text END, ' ' ORDER BY block_no) AS text,
 first(source_page ORDER BY block_no) AS source_page, CASE WHEN count(*) > 1 THEN last(coalesce(source_page_end, source_page) ORDER BY block_no) FILTER (coalesce(source_page_end, source_page) IS NOT NULL) ELSE first(source_page_end ORDER BY block_no) END AS source_page_end
FROM n GROUP BY book, grp"""


@query("seq07_stitch", _STITCH)
def seq07(spark, d):
    return stitch.stitch_pages(blocks_once(spark, d), "book", "source_page", "block_no")


def _para_sql(new: str, text: str = "text") -> str:
    return f"""q AS (SELECT *, sum(CASE WHEN {new} THEN 1 ELSE 0 END) OVER (PARTITION BY book, page ORDER BY line_no) AS para_no FROM p)
SELECT book, page, CAST(para_no AS BIGINT) AS para_no, string_agg({text}, ' ' ORDER BY line_no) AS text FROM q GROUP BY book, page, para_no"""


_P = f"""WITH p AS (SELECT *, {S.match(S.strip('text'), S.HEADING_LINE)} AS h, lag({S.match(S.strip('text'), S.HEADING_LINE)}) OVER w AS ph, y0 - lag(y0) OVER w AS step, min(x0) OVER (PARTITION BY book, page) AS x1, lag(text) OVER w AS pt FROM {PLACED} WINDOW w AS (PARTITION BY book, page ORDER BY line_no)),"""


@query("seq08_prose", _P + _para_sql("ph IS NULL OR h OR ph OR x0 > x1 + 6 OR coalesce(step > 18 OR step < -18, false)"))
def seq08(spark, d):
    return layout.prose_paragraphs(placed_lines(spark, d).withColumn("leading", F.lit(12.0)), PAGE, "line_no", "leading")


@query("seq09_verse", _P + _para_sql("""h OR ph IS NULL OR ph OR pt[-1] IN ('.', '?', '!', '”', '"')"""))
def seq09(spark, d):
    return layout.verse_paragraphs(placed_lines(spark, d), PAGE, "line_no")


_TYPED = f"SELECT book, block_no, CASE WHEN {S.match(S.strip('text'), S.HEADING_LINE)} OR {S.line_is_heading('text')} THEN 'heading' ELSE 'body' END AS type, {S.strip_markdown('text')} AS text FROM {S.BLOCKS} b WHERE text IS NOT NULL"


@query("seq10_paragraph_blocks", _TYPED)
def seq10(spark, d):
    return layout.paragraph_blocks(blocks_once(spark, d).select("book", "block_no", "text"))


@query(
    "seq11_image_chapters",
    f"""SELECT book, page, CAST(greatest(1, sum(i) OVER (PARTITION BY book ORDER BY page)) AS INTEGER) AS chapter
 FROM (SELECT book, source_page AS page, max(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) AS i FROM {S.BLOCKS} b WHERE source_page IS NOT NULL GROUP BY book, source_page)""",
)
def seq11(spark, d):
    pages = table(spark, d, "blocks").where(F.col("source_page").isNotNull()).groupBy("book", F.col("source_page").alias("page")).agg(F.max(F.when(F.col("type") == "heading", True).otherwise(False)).alias("has"))
    return stitch.chapters_by_image(pages, "book", "page", "has")


_LIGATED = "text"
for _a, _b in T.LIGATURES.items():
    _LIGATED = f"replace({_LIGATED}, {S.q(_a)}, {S.q(_b)})"
_DROPS = f"""WITH r AS (SELECT * FROM (SELECT book, page, line_no, x0, y0, size, {S.strip(_LIGATED)} AS text FROM {PLACED}) WHERE text <> '' AND NOT {S.match('text', '^[0-9]{1,4}$')}),
m AS (SELECT *, list_sort(list(size) OVER p)[count(*) OVER p // 2 + 1] AS med FROM r WINDOW p AS (PARTITION BY book, page)),
c AS (SELECT *, {S.match('text', '^[\"“‘' + chr(39) + ']?[A-Z]$')} AND size >= 1.4 * med AS cap FROM m),
g AS (SELECT *, sum(CASE WHEN cap THEN 0 ELSE 1 END) OVER (PARTITION BY book, page ORDER BY line_no) AS run FROM c),
i AS (SELECT *, sum(cap::INT) OVER (PARTITION BY book, page, run ORDER BY line_no) AS i FROM g),
t AS (SELECT *, cap AND i % 2 = 1 AND lead(text) OVER w IS NOT NULL AS takes, lead(text) OVER w AS nxt FROM i WINDOW w AS (PARTITION BY book, page ORDER BY line_no)),
u AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY book, page ORDER BY line_no), false) AS taken FROM t)
SELECT book, page, line_no, x0, y0, CASE WHEN takes THEN text || nxt ELSE text END AS text FROM u WHERE NOT taken"""


@query("src01_drop_caps", _DROPS)
def src01(spark, d):
    return layout.merge_drop_caps(placed_lines(spark, d), PAGE, "line_no")


@query("agg06_text_mode", f"SELECT book, round(avg({S.match('text', '^' + chr(92) + 'p{Lu}')}::INT), 6) AS share, CASE WHEN avg({S.match('text', '^' + chr(92) + 'p{Lu}')}::INT) > 0.45 THEN 'verse' ELSE 'prose' END AS mode FROM {PLACED} GROUP BY book")
def agg06(spark, d):
    return layout.text_mode(placed_lines(spark, d), "book")


@query("agg07_indent_share", f"SELECT book, round(avg(i), 6) AS share, CASE WHEN avg(i) >= 0.05 THEN 'indent' ELSE 'gap' END AS style FROM (SELECT book, (x0 > min(x0) OVER (PARTITION BY book, page) + 6)::INT AS i FROM {PLACED}) GROUP BY book")
def agg07(spark, d):
    return layout.indent_share(placed_lines(spark, d), "book", "page")


_LEAD = f"""WITH a AS (SELECT book, y0 - lag(y0) OVER (PARTITION BY book, page ORDER BY line_no) + (length(text) % 3) / 4.0 AS gap FROM {PLACED}),
r AS (SELECT book, gap FROM a WHERE gap > 0), bins AS (SELECT book, round_even(gap, 0) AS b, count(*) AS n FROM r GROUP BY ALL),
ch AS (SELECT book, min(b) AS b FROM (SELECT *, max(n) OVER (PARTITION BY book) AS peak FROM bins) WHERE n >= peak * 0.2 AND b >= 4 GROUP BY book),
nr AS (SELECT r.book, list_sort(list(gap)) AS l FROM r JOIN ch ON r.book = ch.book WHERE abs(gap - b) <= 1.5 GROUP BY r.book)
SELECT DISTINCT a.book, coalesce(l[len(l) // 2 + 1], 0.0)::DOUBLE AS leading FROM a LEFT JOIN nr ON a.book = nr.book"""


@query("agg08_modal_leading", _LEAD)
def agg08(spark, d):
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    gaps = placed_lines(spark, d).select("book", (F.col("y0") - F.lag("y0").over(w) + (F.length("text") % 3) / 4.0).alias("gap"))
    return layout.modal_leading(gaps, "book", "gap")


@query(
    "agg09_path",
    f"""SELECT book, CASE WHEN avg(chars) <= 300 THEN 'B' WHEN sum(mid) / sum(n) > 0.25 THEN 'B' ELSE 'A' END AS path
 FROM (SELECT book, page, sum(length(text)) AS chars, count(*) AS n, sum(CASE WHEN x0 > 80 THEN 1 ELSE 0 END) AS mid FROM {PLACED} GROUP BY book, page) GROUP BY book""",
)
def agg09(spark, d):
    pages = placed_lines(spark, d).groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("lines"), F.sum((F.col("x0") > 80).cast("int")).alias("mid_lines"))
    return layout.suggested_path(pages, "book")
