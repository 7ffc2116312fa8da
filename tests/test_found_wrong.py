"""Cases that once came out wrong."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import catalog, planning, stitch

TEXTS = ["How nice. He held a red lamp here.", "a\u00a0b  c", "", None, "one", "lampoon lamp", "x y z", "The old red lamp\nstood here. How nice it was", "ab cd ab cd ef gh ij kl mn"]


def passages():
    rng = random.Random(2)
    out = ["ice.", "ld a red lamp here", "", " ", None, "red lamp", "d a r", "lamp", "amp", "e", " y ", "p\nstood h", "zz", "b cd a", "\u00a0b", "One", "a red", "w nice. He h", "w nice. He held a r"]
    for _ in range(150):
        t = rng.choice([x for x in TEXTS if x])
        a = rng.randrange(len(t))
        out.append(t[a : a + rng.randrange(1, 30)])
    return out


def test_every_contained_passage(spark):
    ps = passages()
    p = spark.createDataFrame([("k", i, x) for i, x in enumerate(ps)], "k string, i int, text string")
    t = spark.createDataFrame([("k", i, x) for i, x in enumerate(TEXTS)], "k string, j int, text string")
    got = {(r["i"], r["j"]) for r in catalog.contained(p, t, "k", "i", "j").collect()}
    assert got == {(i, j) for i, x in enumerate(ps) for j, y in enumerate(TEXTS) if x and y and x.strip() and x in y}


def _shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_passages_of_common_words_give_few_pairs(spark):
    n = 400
    rows = [("k", i, f"{i:04d} the old red lamp of the house stood here by night {i}") for i in range(n)]
    p, t = spark.createDataFrame(rows, "k string, i int, text string"), spark.createDataFrame(rows, "k string, j int, text string")
    before = _shuffled(spark)
    got = sorted((r["i"], r["j"]) for r in catalog.contained(p, t, "k", "i", "j").collect())
    assert got == [(i, i) for i in range(n)]
    assert _shuffled(spark) - before < 50 * n


def test_passages_in_long_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcé 雨") for _ in range(900_000))
    cuts = [(a, n) for a in (0, 524_000, 699_990, 700_100, 899_000) for n in (9, 64, 300, 700)]
    p = spark.createDataFrame([("k", i, long[a : a + n]) for i, (a, n) in enumerate(cuts)] + [("k", 99, long[5:300] + "x"), ("m", 7, long[:40])], "k string, i int, text string")
    t = spark.createDataFrame([("k", 1, long), ("k", 2, ""), ("k", 3, "short"), ("m", 1, None)], "k string, j int, text string")
    got = sorted((r["i"], r["j"]) for r in catalog.contained(p, t, "k", "i", "j").collect())
    assert got == [(i, 1) for i in range(len(cuts))]


def test_span_with_a_null_page(spark):
    rows = [("b", 1, "body", "A sentence that", 7, None), ("b", 2, "body", "goes on", 8, None), ("b", 3, "body", "to here.", None, None), ("b", 4, "body", "Next.", 9, 10)]
    df = spark.createDataFrame(rows, "book string, block_no int, type string, text string, source_page int, source_page_end int")
    got = sorted(map(tuple, stitch.stitch_pages(df, "book", "source_page", "block_no").select("block_no", "text", "source_page", "source_page_end").collect()))
    assert got == [(1, "A sentence that goes on to here.", 7, 8), (4, "Next.", 9, 10)]


@pytest.mark.parametrize("a, b", [((None, "x"), ("", "x")), (("x\x1fy", "z"), ("x", "y\x1fz")), (("x", None), ("x", "null")), (("a", 'b"'), ('a"', "b"))])
def test_other_rows_other_digests(spark, a, b):
    df = spark.createDataFrame([("1", 0, *a), ("2", 0, *b), ("3", 0, *a)], "k string, o int, type string, text string")
    got = {r["k"]: r["digest"] for r in planning.plan_hash(df, "k", "o", ["type", "text"]).collect()}
    assert got["1"] == got["3"] != got["2"]


def test_blanks_of_any_kind_in_headings(spark):
    df = spark.createDataFrame([("CHAPTER\u00a0IV",), ("chapter\u2003twenty-one\u3000",), ("Part  one two",), ("Epilogue ",), ("chapter",), ("Partly 3",)], "c string")
    c = F.col("c")
    assert [tuple(r) for r in df.select(T.is_heading_line(c), T.is_chapter(c), T.is_start_heading(c)).collect()] == [(True, True, False), (True, True, False), (True, True, True), (True, True, False), (False, True, False), (False, False, False)]


def test_emphasis_of_any_depth(spark):
    deep = "x"
    for i in range(30):
        deep = f"*{deep}_a_*" if i % 2 else f"_{deep}*b*_"
    import re

    want, rule = deep, re.compile(r"\*{1,3}([^*]+)\*{1,3}|_{1,3}([^_]+)_{1,3}")
    while (new := rule.sub(lambda m: (m.group(1) or "") + (m.group(2) or ""), want)) != want:
        want = new
    assert spark.createDataFrame([(deep,)], "c string").select(T.strip_markdown(F.col("c"))).first()[0] == " ".join(want.split())


def test_covers_and_imports(spark):
    from folioflow.sources import readers

    images = spark.createDataFrame([("a", 1, 200, 300, 50), ("a", 2, 900, 900, 70), ("a", 3, 300, 300, 70), ("a", 4, 199, 900, 99), ("b", 1, 10, 10, 5)], "k string, o int, width int, height int, bytes int")
    assert [tuple(r) for r in catalog.covers(images, "k", "o").collect()] == [("a", 2)]
    df = spark.createDataFrame([("/x/a:b.pdf",), ("/y/A_b.pdf",), ("/z/ ..pdf",)], "path string")
    assert [r["name"] for r in readers.import_names(df).orderBy("path").collect()] == ["a_b.pdf", "A_b (2).pdf", "document.pdf"]
    c = F.lit
    rows = [("a.pdf", 0, "%PDF-", False, 1), ("a.txt", 9, "%PDF-", False, 1), ("a.PDF", 9, "x", False, 1), ("a.pdf", 9, "x%PDF-", True, 1), ("a.pdf", 9, "%PDF-", False, 0), ("a.pdf", 9, "%PDF-", False, None)]
    got = spark.range(1).select(*(readers.import_error(c(n), c(s).cast("bigint"), c(h), c(e), c(p).cast("int")).alias(f"c{i}") for i, (n, s, h, e, p) in enumerate(rows))).first()
    assert list(got) == ["empty", "not a .pdf", "no PDF header", "encrypted", "no pages", None]


def test_retries_end_in_an_error(spark):
    from folioflow.operators import schedule

    rows = [("a", 1, 9), ("a", 2, 3), ("b", 1, 9), ("b", 2, 9), ("c", 1, 9), ("c", 2, 9), ("c", 3, 9), ("c", 4, 4), ("d", 1, 4), ("d", 2, 9), ("d", 3, 9), ("d", 4, 9)]
    rows += [("e", i, 9) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "k string, attempt int, n int")
    got = {r["k"]: (r["attempt"], r["state"]) for r in schedule.retried(df, ["k"], "attempt", F.col("n"), 5).collect()}
    assert got == {"a": (2, "sound"), "b": (None, "retry"), "c": (4, "sound"), "d": (1, "sound"), "e": (None, "error")}


def test_job_files_newest_name_first(spark, tmp_path):
    from folioflow.sources import readers

    for n in ("j1", "j3", "j2"):
        (tmp_path / f"{n}.json").write_text('{\n "id": "%s"\n}' % n)
    assert [r["id"] for r in readers.job_files(spark, str(tmp_path), "id string, voice string").collect()] == ["j3", "j2", "j1"]
