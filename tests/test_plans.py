"""Packing, plans, batches, timelines, metrics."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import arrays as A
from folioflow.operators import catalog, metrics, planning, schedule, timeline


def pack(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(planning.pack_text(F.col("t"))).collect()]


def test_pack(spark):
    s = "A" * 199 + "."
    exact, over = f"{s} {'B' * 198}.", f"{s} {'B' * 199}."
    clause = "C" * 250 + ","
    long = f"{clause} {'d' * 200}, {'e' * 40}."
    got = pack(spark, exact, over, f"{long} End here.", "x" * 500 + ".", "He left. then", "end.” Next", "", None)
    assert [len(x) for x in got[0]] == [400] and [len(x) for x in got[1]] == [200, 200]
    assert got[2] == [clause, "d" * 200 + ", " + "e" * 40 + ". End here."]
    assert [len(x) for x in got[3]] == [501]
    assert got[4:7] == [["He left. then"], ["end.” Next"], []]


def test_plan_pauses(spark):
    two = "A" * 299 + ". " + "B" * 299 + "."
    rows = [("b", 0, "heading", "H", 1, None), ("b", 1, "body", two, 1, None), ("b", 2, "body", "Last.", 2, None)]
    kind = "book string, block_no int, type string, text string, source_page int, source_page_end int"
    jobs = spark.createDataFrame([("b", "A")], "book string, path string")
    plan = planning.build_plan(spark.createDataFrame(rows, kind), jobs).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.before_ms, r.after_ms) for r in plan] == [(0, 200, 800), (1, 0, 150), (2, 0, 650), (3, 0, 0)]
    blank = planning.build_plan(spark.createDataFrame([*rows, ("b", 3, "body", " ", 2, None)], kind), jobs).orderBy("chunk_idx").collect()
    assert blank[-1].after_ms == 650
    with pytest.raises(Exception, match="no pauses"):
        planning.build_plan(spark.createDataFrame(rows, kind), spark.createDataFrame([("b", "C")], "book string, path string")).collect()


def reference_batches(sizes):
    out, n, b = [], 0, 0
    for s in sorted(sizes):
        if n and (n + 1 > 12 or (n + 1) * s > 1300):
            b, n = b + 1, 0
        out.append(b)
        n += 1
    return out


def test_batches(spark):
    rng = random.Random(3)
    cases = {"a": [10] * 13, "b": [323] * 5, "c": [2000], "d": [rng.randrange(1, 700) for _ in range(200)], "e": [0, 0, 5]}
    df = spark.createDataFrame([(k, i, s) for k, v in cases.items() for i, s in enumerate(v)], "k string, i int, s int")
    rows = schedule.batches(df, "k", "i", "s").orderBy("k", "place").collect()
    for k, v in cases.items():
        assert [r.batch_no for r in rows if r.k == k] == reference_batches(v)
        assert [r.s for r in rows if r.k == k] == sorted(v)


def test_parts_and_retries(spark):
    df = spark.createDataFrame([("b", i, 10.0, i % 2 == 1) for i in range(8)], "k string, o int, s double, e boolean")
    assert [r.part_no for r in schedule.parts(df, "k", "o", "s", "e", 30.0).orderBy("o").collect()] == [1, 1, 1, 1, 2, 2, 2, 2]
    tries = spark.createDataFrame([(1, 1, [1] * 4), (1, 2, [1] * 3), (2, 1, [1] * 4)], "row int, attempt int, t array<int>")
    got = {r.row: r.sound for r in schedule.first_sound(tries, ["row"], "attempt", F.size("t"), 4).collect()}
    assert got == {1: 2, 2: None}


def test_timeline(spark):
    plan = spark.createDataFrame([("b", 0, 200, 800, "CHAPTER 1", 5), ("b", 1, 0, 0, None, 7)], "book string, chunk_idx int, before_ms int, after_ms int, heading string, source_page int")
    seg = spark.createDataFrame([("b", 0, 24000, 24000), ("b", 1, 48000, 24000)], "book string, chunk_idx int, frames bigint, sr int")
    rows = timeline.timeline(plan, seg)
    assert [r.start_ms for r in rows.orderBy("chunk_idx").collect()] == [0, 2000]
    assert timeline.totals(rows).collect()[0].total_ms == 4000
    late = spark.createDataFrame([("b", 2000, "x"), ("c", 1500, "y")], "book string, start_ms bigint, title string")
    assert sorted((r.book, r.start_ms) for r in timeline.with_opening(late).collect()) == [("b", 0), ("b", 2000), ("c", 1500)]


def test_outline_marks(spark):
    outline = spark.createDataFrame([("b", i, lv, t, p) for i, (lv, t, p) in enumerate([(1, "Chapter 1", 5), (1, "Chapter 2", 7), (1, "1.2 Installation", 8), (1, "Chapter 3", 10), (2, "Part 9", 11), (1, "Chapter 4", 12)])], "book string, ord int, level int, title string, page int")
    starts = spark.createDataFrame([("b", 5, 0), ("b", 7, 15000), ("b", 11, 45000)], "book string, page int, ms bigint")
    got = timeline.outline_marks(outline, starts).orderBy("start_ms").collect()
    assert [(r.start_ms, r.title) for r in got] == [(0, "Chapter 1"), (15000, "Chapter 2"), (45000, "Part 9")]


def test_plan_hash(spark):
    kind = "k string, o int, type string, text string, page int"
    a = spark.createDataFrame([("x", 1, "body", "a", 1), ("x", 2, "body", "b", 2), ("y", 1, "body", None, 3)], kind)
    h = lambda df: {r.k: r.digest for r in planning.plan_hash(df, "k", "o", ["type", "text"]).collect()}
    assert h(a) == h(a.withColumn("page", F.lit(9)))
    changed = h(a.withColumn("text", F.when(F.col("o") == 2, "c").otherwise(F.col("text"))))
    assert changed["x"] != h(a)["x"] and changed["y"] == h(a)["y"]
    state = planning.staleness(planning.plan_hash(a, "k", "o", ["text"]), spark.createDataFrame([("x", "old")], "k string, digest string"), "k")
    assert {r.k: r.state for r in state.collect()} == {"x": "stale", "y": "fresh"}


def test_metrics(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2, None)] + [("b", None)], "k string, v int")
    assert [tuple(r) for r in metrics.upper_median(df, ["k"], "v").collect()] == [("a", 3)]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).collect()[0].x
    assert get(A.systematic(F.lit(10), F.lit(4))) == [0, 2, 5, 8]
    assert get(A.upper_median(F.array(*map(F.lit, (1, 2, 3, 4))))) == 3
    assert get(metrics.workers(F.lit(24.0))) == 3 and get(metrics.workers(F.lit(4.0))) == 1 and get(metrics.workers(F.lit(24.0), F.lit(7))) == 7
    assert get(A.spread_pages(F.lit(1), F.lit(3), 24)) == [0, 1, 2]
    assert get(A.silence(F.lit(1000), F.lit(3))) == [0.0] * 3
    assert get(A.positions(F.array(*map(F.lit, (1, 0, 1, 1))))) == [0, 0, 1, 2]
    assert get(A.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    est = metrics.stratified_total(spark.createDataFrame([("k", 0, 8, 1.0), ("k", 7, 8, 3.0)], "k string, i int, n int, v double"), ["k"], "i", "n", "v")
    assert est.collect()[0].estimate == 2 * 1.0 + 2 * 2.0 + 2 * 2.0 + 2 * 3.0


def test_catalog(spark):
    files = spark.createDataFrame([("/a/X.pdf", 1), ("/A/x.pdf", 2), ("/b/y.pdf", 1)], "path string, o int")
    assert sorted(r.path for r in catalog.once_by_path(files, [F.col("o")]).collect()) == ["/a/X.pdf", "/b/y.pdf"]
    assert [r.path for r in catalog.outside(files, spark.createDataFrame([("/a",), ("/A",)], "folder string")).collect()] == ["/b/y.pdf"]
    texts = spark.createDataFrame([("k", 1, "the cold sea was calm and wide"), ("k", 2, "a hat"), ("m", 3, "the cold sea was calm")], "k string, t int, text string")
    parts = spark.createDataFrame([("k", 1, "cold sea was ca"), ("k", 2, "a hat"), ("k", 3, "sea"), ("k", 4, "sea hat"), ("k", 5, "")], "k string, p int, text string")
    assert sorted((r.p, r.t) for r in catalog.contained(parts, texts, "k", "p", "t").collect()) == [(1, 1), (2, 2), (3, 1)]
