"""Tagging, stitching and paragraphs."""

import random

from pyspark.sql import functions as F

from folioflow.operators import layout, stitch, tagging
from folioflow.operators.ordered import asof_forward, next_row, previous_row, running_sum, size_rank

LONG = "a row that tells a rather long tale about the road and the inn"


def tag(spark, text):
    df = spark.createDataFrame([("b", 1, i, x) for i, x in enumerate(text)], "book string, page int, line_no bigint, line string")
    return [(r.type, r.text) for r in tagging.tag_blocks(df, ["book", "page"]).orderBy("line_no").collect()]


def kinds(spark, text):
    return [k for k, _ in tag(spark, text)]


def test_runs(spark):
    assert kinds(spark, ["| a |", "", "| b |"]) == ["table"]
    assert kinds(spark, ["| a |", "", "", "| b |"]) == ["table", "table"]
    assert kinds(spark, ["|---|", "| a |"]) == ["table"]
    assert kinds(spark, ["| a |", "| <td>x</td> |"]) == ["table"]
    assert kinds(spark, ["| <td>x</td> |", "| a |"]) == ["table", "table"]
    assert tag(spark, ["1d4 Mood", "1 Calm", "2 Angry", "3 Sad"]) == [("table", tagging.DICE_MARK)]
    assert kinds(spark, ["1d4 Mood", "1 Calm", "2 Angry"]) == ["body"] * 3
    assert [t for _, t in tag(spark, ["1d4 Hook", *(f"{i} {LONG}" for i in (1, 2, 3))])] == [LONG] * 3
    assert kinds(spark, ["- 12 7", "", "- 9 dead", "text"]) == ["omitted_data", "body"]
    assert len(tag(spark, ["same line", "same line", "other", "same line"])) == 3
    assert tag(spark, []) == [] and tag(spark, ["", "  "]) == []


def test_page_verdicts(spark):
    loop = [f"a line that is long enough, number {i % 5}" for i in range(20)]
    assert tag(spark, loop) == []
    assert len(tag(spark, [f"a line that is long enough, number {i % 6}" for i in range(20)])) == 20
    short = [f"label {chr(97 + i)}xx" for i in range(15)]
    assert tag(spark, short) == [("omitted_data", tagging.DIAGRAM_MARK)]
    assert len(tag(spark, [f"{chr(97 + i)}" * 30 for i in range(15)])) == 15


def blocks(spark, rows):
    return spark.createDataFrame(rows, "book string, block_no int, type string, text string, source_page int, source_page_end int")


def joined(spark, rows, width=2):
    out = stitch.stitch_pages(blocks(spark, rows), "book", "source_page", "block_no", width)
    return [(r.text, r.source_page, r.source_page_end) for r in out.orderBy("book", "block_no").collect()]


def test_stitch(spark):
    rows = [("b", 1, "body", "a", 1, None), ("b", 2, "body", "b", 2, None), ("b", 3, "body", "c.", 3, None)]
    for width in (1, 2, 100):
        assert joined(spark, rows, width) == [("a b c.", 1, 3)]
    assert joined(spark, [("b", 1, "body", "says:", 1, None), ("b", 2, "body", "next", 2, None)]) == [("says:", 1, None), ("next", 2, None)]
    assert joined(spark, [("b", 1, "heading", "A", 1, None), ("b", 2, "body", "next", 2, None)]) == [("A", 1, None), ("next", 2, None)]
    assert joined(spark, [("b", 1, "body", "a ", 1, None), ("b", 2, "body", " ", 2, None), ("b", 3, "body", None, 2, None), ("b", 4, "body", "b", 3, None)]) == [("a b", 1, 3)]
    assert joined(spark, []) == []


def placed(spark, rows):
    return spark.createDataFrame([("b", 1, i, float(x), float(y), s, t) for i, (x, y, s, t) in enumerate(rows)], "book string, page int, line_no bigint, x0 double, y0 double, size double, text string")


def test_paragraphs(spark):
    rows = placed(spark, [(0, 0, 9.0, "one"), (0, 12, 9.0, "two."), (9, 24, 9.0, "three"), (0, 36, 9.0, "Chapter 1"), (0, 48, 9.0, "four"), (0, 80, 9.0, "five")])
    key = ["book", "page"]
    plain = [r.text for r in layout.prose_paragraphs(rows, key, "line_no").orderBy("para_no").collect()]
    assert plain == ["one two.", "three", "Chapter 1", "four five"]
    gaps = [r.text for r in layout.prose_paragraphs(rows.withColumn("l", F.lit(12.0)), key, "line_no", "l").orderBy("para_no").collect()]
    assert gaps == ["one two.", "three", "Chapter 1", "four", "five"]
    verse = [r.text for r in layout.verse_paragraphs(rows, key, "line_no").orderBy("para_no").collect()]
    assert verse == ["one two.", "three", "Chapter 1", "four five"]


def test_drop_caps(spark):
    rows = placed(spark, [(0, 0, 20.0, "T"), (0, 12, 9.0, "he sea"), (0, 24, 9.0, "12"), (0, 36, 9.0, "ﬁsh"), (0, 48, 20.0, "A"), (0, 60, 20.0, "B"), (0, 72, 9.0, "c"), *((0, 84 + 12 * i, 9.0, "line") for i in range(4))])
    assert [r.text for r in layout.merge_drop_caps(rows, ["book", "page"], "line_no").orderBy("line_no").collect()] == ["The sea", "fish", "AB", "c", *["line"] * 4]


def test_modal_leading(spark):
    gaps = lambda *x: spark.createDataFrame([("b", float(g)) for g, n in x for _ in range(n)], "k string, g double")
    get = lambda df: layout.modal_leading(df, "k", "g").collect()[0].leading
    assert get(gaps((12, 10), (24, 30))) == 12.0
    assert get(gaps((12, 5), (24, 30))) == 24.0
    assert get(gaps((-1, 3), (2, 9))) == 0.0


def test_ordered_match_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 1, 2, 5])) for k in "ab" for i in rng.sample(range(300), 80)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select("*", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), (F.row_number().over(Window.partitionBy("k").orderBy(F.asc_nulls_last("v"), "o")) - 1).alias("r"))
    want = sorted(map(tuple, plain.collect()), key=repr)
    for width in (1, 7, 1000):
        got = running_sum(df, "k", "o", F.col("v"), "s", width=width)
        got = next_row(previous_row(got, "k", "o", ["v"], "p_", width), "k", "o", ["v"], "n_", width)
        got = size_rank(got, "k", "v", "o", "r", width).select("k", "o", "v", "s", "p_v", "n_v", "r")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_asof_matches_brute_force(spark):
    rng = random.Random(2)
    left = [("ab"[i % 2], rng.randrange(100), i) for i in range(60)]
    right = [("ab"[i % 2], rng.randrange(90), i) for i in range(25)]
    a, b = spark.createDataFrame(left, "k string, o int, i int"), spark.createDataFrame(right, "k string, o int, v int")
    best = lambda k, o: min(((ro, v) for rk, ro, v in right if rk == k and ro >= o), default=(None, None))[1]
    want = sorted((k, o, i, best(k, o)) for k, o, i in left)
    for width in (1, 10, 1000):
        assert sorted(map(tuple, asof_forward(a, b, "k", "o", "v", width).collect())) == want
