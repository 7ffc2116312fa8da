"""The pN_ queries on tables of odd rows: nulls in every column, clashing extra columns, empty tables, repeated rows."""

import datetime
import os

import pytest

from folioflow.llm import queries

DATA = os.environ.get("FOLIOFLOW_TESTDATA", "/root/testdata/sf0.001")
AT = datetime.datetime(2031, 1, 1)
NOTICE = "Printed for the members of the Harbour Library, issue 12"

TABLES = {
    "blocks": "book string, block_no int, type string, text string, source_page int, source_page_end int",
    "jobs": "id string, title string, pdf_path string, folder string, path string, style string, lang string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string",
    "chunk_plan": "book string, chunk_idx int, text string, before_ms int, after_ms int, heading string, source_page int, source_page_end int",
    "subjects": "subject string, gloss string",
    "subject_examples": "example_id int, subject string, lang string, text string",
    "split_limits": "item_table string, max_chars int, overlap_chars int",
    "containers": "container string, capacity_tokens int",
    "mix_targets": "mix string, source string, target_share double, max_repeats int",
}
#: Names that the operators use inside.
CLASHING = ["word", "n", "line", "chunk", "chunks", "form", "stored", "f", "ends", "shard", "tokens", "s", "position", "_t", "_n", "gone", "defect", "share", "capacity", "overlap"]


def rows():
    books = [f"b{i}" for i in range(6)]
    blocks = [(b, 1, "body", f"{NOTICE.replace('12', str(i))}\nA line of book {chr(97 + i) * 3} alone", 1, None) for i, b in enumerate(books)]
    blocks += [("b0", 2, "body", "The old mill was calm. The southern road was long.", 1, 2), ("b1", 2, "body", "The old mill was cаlm. The southern road was long.", 2, None)]
    blocks += [("b0", 3, "body", "The south-\nern mill\n— 3 —\nwas old and the old mi11 was calm", 2, None)] * 2
    blocks += [("b0", 4, None, None, None, None), (None, None, "body", "x", None, None), ("b0", 5, "body", "", 3, None), ("b0", 6, "dialogue", " \n ", 3, None), ("b9", 7, "body", "No job at all.", 1, 1)]
    blocks += [("b2", 8, "body", "A very long text. " * 20_000, 4, None), ("b2", 9, "table", "| a | 1 | 2 |\n| b | 3 | 4 |", 5, None), ("b3", 9, "body", "x" * 100_000, 6, None)]
    blocks += [("b0", 10 + i, "body", "the old southern mill was calm and long", 7, None) for i in range(4)]
    jobs = [(b, None if i % 2 else "The Mill", "/shelf/the_mill_01.pdf", "/shelf", "AB"[i % 2 == 0], "prose", None) for i, b in enumerate(books)]
    jobs += [jobs[0], ("b7", None, None, None, None, None, None), (None,) * 7]
    docs = [(1, "The mill has a wheel. The judge read the law.", "en", "s1", 10, None), (2, None, None, None, None, None), (3, "", "en", "s1", 0, "t"), (4, "  \n", None, "s2", 3, None), (5, "The law is long. " * 9000, "en", "s1", None, None), (6, "The law.", "en", None, 8, None), (7, "The law.", "en", "s2", 8, None), (None, "The law.", "en", "s2", 8, None)]
    plan = [("b0", 1, "y" * 900, 0, 0, None, None, None), ("b0", 2, None, None, None, None, None, None), (None, None, "z " * 300, 0, 0, None, None, None), ("b0", 3, "A piece. " * 60, 0, 0, None, 1, 1)] * 2
    examples = [(i, ("law", "mill")[i % 2], "en", ("The judge read the law in the court.", "The wheel of the mill grinds the corn.")[i % 2]) for i in range(20)] + [(30, None, None, None), (31, "law", "en", ""), (None, "other", "en", "x")]
    return {
        "blocks": blocks, "jobs": jobs, "documents": docs, "chunk_plan": plan,
        "subjects": [("law", None), ("mill", "g"), (None, None)], "subject_examples": examples,
        "split_limits": [("blocks", 1200, 120), ("chunk_plan", 400, None), (None, None, None)],
        "containers": [("small", 16), ("odd", None), (None, 8), ("zero", 0), ("large", 4096)],
        "mix_targets": [("m", "s1", 0.5, 2), ("m", "s2", 0.5, None), ("m", "none", None, 3), (None, "s1", 1.0, 1), ("m", "s1", 0.5, 2)],
    }


def write(spark, folder, tables, extra=()):
    from pyspark.sql import functions as F

    for name, kind in TABLES.items():
        df = spark.createDataFrame(tables.get(name, []), kind).coalesce(1)
        for c in extra:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(os.path.join(folder, f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), rows(), CLASHING)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), {})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    df = queries.QUERIES[name](spark, odd)
    got = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(got) == len(set(got))
    want = {
        "p1_found": {("b0", 3, "hyphen"), ("b0", 3, "glyph"), ("b0", 3, "furniture")},
        "p3_found": {(f"b{i}", 1, 1) for i in range(6)},
        "p4_found": {("blocks", "b2", 8), ("blocks", "b3", 9), ("chunk_plan", "b0", 1), ("chunk_plan", "b0", 3), ("chunk_plan", None, None)},
        "p5_found": {("b0", 2, "b1", 2)},
        "p6_found": {("b2", 5), ("b3", 6)},
        "p9_found": {(1, "law"), (1, "mill"), (5, "law"), (6, "law"), (7, "law"), (None, "law")},
    }
    if name in want:
        assert set(got) == want[name]
    if name == "p2_found":
        assert {("b1", 1, 55), ("b1", 2, 22), ("b1", 2, 50)} <= set(got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    df = queries.QUERIES[name](spark, empty)
    assert df.collect() == [] and df.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{DATA}/{f}'")
    want = c.execute(queries.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, DATA).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_passages_within_longer_lines(spark, tmp_path, monkeypatch):
    """A notice without a line of its own, wrapped anywhere, is found by its chunks; lines alone would not tell it."""
    from folioflow.llm import repeats

    notice = "this edition was read by the harbour volunteers for members only and must not be sold or lent to anyone outside the society of readers"
    rng = __import__("random").Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    fill = lambda: " ".join(word() for _ in range(30))
    texts = [f"{fill()} {notice if i % 2 else notice.replace(' volunteers ', chr(10) + 'volunteers ')} {fill()}" for i in range(6)]
    blocks = [(f"b{i}", 1, "body", t, 1, None) for i, t in enumerate(texts)]
    jobs = [(f"b{i}", None, None, "/shelf", "A", "prose", None) for i in range(6)]
    d = write(spark, tmp_path, {"blocks": blocks, "jobs": jobs})
    got = {r["book"]: r["text"].replace("\n", " ") for r in repeats.passages(spark, d).collect()}
    assert set(got) == {f"b{i}" for i in range(6)} and all(len(x) > 60 and x.strip() in notice for x in got.values())
    assert repeats.found(spark, d).count() == 0

    class Uncut(repeats.Chunks):  # without the rolling hash there are no cuts
        def __init__(self, texts):
            super().__init__(texts)
            first = [i for i, k in enumerate(self.number) if k == 1]
            self.a, self.b = self.starts[first], [*self.starts[first][1:], self.ends[-1] + 1]
            self.b = self.a * 0 + self.b
            self.hash, self.line = self.digest(self.a, self.b), self.a * 0 - 1

    monkeypatch.setattr(repeats, "Chunks", Uncut)
    assert repeats.passages(spark, d).count() == 0


LONG = "Hello there, this is a sentence. And another one; yes.\n" * 200 + "日本語の文です。次の文。" * 50 + " " * 700 + "é" * 300 + "." * 300 + "\n \n" * 90 + "end"


def test_ranges_give_the_same_pieces(spark, tmp_path, monkeypatch):
    from folioflow.llm import splitting

    df = spark.createDataFrame([(1, LONG, 100, 10), (2, "x" * 950, 100, 10), (3, None, 100, 10)], "k int, text string, l int, o int")
    pieces = lambda: sorted(map(tuple, splitting.split_column(df, ["k"], "text", "l", "o").collect()))
    one = [(k, no, a, b, t[a:b]) for k, t in ((1, LONG), (2, "x" * 950)) for no, (a, b) in enumerate(splitting.split_text(t, 100, 10), 1)]
    for size in (splitting.RANGE, 997, 61):
        monkeypatch.setattr(splitting, "RANGE", size)
        assert pieces() == one
    f = tmp_path / "big.txt"
    f.write_text(LONG, encoding="utf-8")
    for size in (4096, 1001, 64):
        cut = sorted(map(tuple, splitting.split_files(spark, [str(f)], 100, 10, range_bytes=size).collect()), key=lambda r: r[1])
        assert [r[4] for r in cut] == [r[4] for r in one if r[0] == 1]


@pytest.mark.parametrize("size", [1000, 998, 37, 1 << 20])
def test_files_without_stops_and_with_other_bytes(spark, tmp_path, size):
    from folioflow.llm import splitting

    rng = __import__("random").Random(3)
    whole = {"zh": ("汉" * 4000).encode(), "mixed": bytes(rng.choice([32, 65, 46, 0xC3, 0xA9, 0xE6, 0xB1, 0x89, 0xFF, 0x80]) for _ in range(5000)), "none": b"", "blank": b" " * 3000}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    rows = splitting.split_files(spark, [str(tmp_path / n) for n in whole], 100, 10, range_bytes=size).collect()
    for name, data in whole.items():
        own = sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: r["piece_no"])
        joined, last = b"", 0
        for r in own:
            assert 0 < len(r["text"]) <= 100 and last >= r["start"] and r["end"] > last
            assert r["text"].count("\ufffd") == sum("\udc80" <= c <= "\udcff" for c in data[r["start"] : r["end"]].decode("utf-8", "surrogateescape"))
            joined += data[last : r["end"]]
            last = r["end"]
        assert joined == data
        text = data.decode("utf-8", "surrogateescape")
        assert [len(r["text"]) for r in own] == [b - a for a, b in splitting.split_text(text, 100, 10)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_stitching_decides(spark, monkeypatch):
    """Items of the tables lie in several ranges, and without the stitching the queries have no rows."""
    from folioflow.llm import splitting

    keys = ["item_table", "book", "item_no"]
    ranges = splitting.ranges_of(splitting._items(spark, DATA).dropDuplicates(keys), keys, "text", "max_chars", "overlap_chars")
    assert ranges.groupBy(*keys).count().where("count > 1").count() > 0

    class Silent(splitting.Stitch):
        def add(self, *_):
            return iter(())

    monkeypatch.setattr(splitting, "Stitch", Silent)
    assert splitting.found(spark, DATA).count() == splitting.pieces(spark, DATA).count() == 0


def test_mixing_and_packing_invariants(spark, odd):
    packed = queries.QUERIES["p7_packed"](spark, odd).toPandas()
    packed["n"] = packed.end_token - packed.first_token
    assert packed.groupby(["container", "container_no"]).n.sum().max() <= 4096
    assert set(packed.container) == {"small", "large"}
    mixed = queries.QUERIES["p8_mixed"](spark, odd).toPandas()
    assert (mixed.groupby(["mix", "source", "doc_id"], dropna=False).size() <= 2).all()


def test_shares_are_met_within_a_document(spark, tmp_path):
    rng = __import__("random").Random(8)
    docs = [(i, "word " * rng.randrange(20, 400), "en", ("large", "middle", "small")[min(2, i % 7 // 3)], 1, None) for i in range(700)]
    d = write(spark, tmp_path, {"documents": docs, "mix_targets": [("m", "large", 0.5, 1), ("m", "middle", 0.3, 2), ("m", "small", 0.2, 3), ("m", "none", 0.25, 9)]})
    from folioflow.llm import mixing

    got = {r["source"]: r for r in mixing.shares(spark, d).collect()}
    assert got["none"]["tokens"] == 0 and got["none"]["short"]
    for s, share in (("large", 0.5), ("middle", 0.3), ("small", 0.2)):
        assert abs(got[s]["share"] - share) < 0.01 and abs(got[s]["tokens"] - got[s]["quota"]) <= 400
    rows = mixing.mixed(spark, d).orderBy("slot", "position").toPandas()
    total = got["large"]["quota"] + got["middle"]["quota"] + got["small"]["quota"]
    for s, share in (("large", 0.5), ("middle", 0.3), ("small", 0.2)):
        ahead = (rows.tokens.where(rows.source == s, 0).cumsum() - share * rows.tokens.cumsum()).abs().max()
        assert ahead < 2 * mixing.BLOCK + 800 < total / 10
