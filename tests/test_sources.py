"""Readers, writers and the stream."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from folioflow.sources import readers, writers
from folioflow.streaming import progress


def test_json_and_lines(spark, tmp_path):
    f = tmp_path / "blocks.json"
    f.write_text(json.dumps({"blocks": [{"type": "body", "text": "é", "source_page": 3}, {"type": "heading", "text": "H"}]}))
    rows = readers.block_files(spark, str(f)).orderBy("block_no").collect()
    assert [(r.type, r.text, r.source_page) for r in rows] == [("body", "é", 3), ("heading", "H", None)]
    log = tmp_path / "x.jsonl"
    log.write_text('{"a": 1}\n{"a": 2}\n')
    assert [r.a for r in readers.json_record(spark, str(log), 2, "a int").collect()] == [2]
    assert readers.json_record(spark, str(log), 3, "a int").count() == 0
    assert [r.value for r in readers.log_tail(readers.numbered_lines(spark, str(log)), "line_no", 1).collect()] == ['{"a": 2}']
    df = spark.createDataFrame([("one\ntwo\n \nthree\n\n",)], "t string")
    assert df.select(readers.paragraphs(F.col("t"))).collect()[0][0] == ["one two", "three"]
    assert df.select(readers.setting(F.lit(""), F.lit(None), F.lit("x"))).collect()[0][0] == "x"


def test_binary(spark, tmp_path):
    pcm = struct.pack("<4h", 0, 16384, -32768, 8192)
    head = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 24000, 48000, 2, 16) + b"data" + struct.pack("<I", len(pcm))
    (tmp_path / "a.wav").write_bytes(head + pcm)
    (tmp_path / "b.pdf").write_bytes(b"junk %PDF-1.4")
    (tmp_path / "d.pdf").write_bytes(b"text")
    wav = readers.files(spark, str(tmp_path), "*.wav")
    h = readers.wav_headers(wav).collect()[0]
    assert (h.channels, h.sr, h.bits, h.frames) == (1, 24000, 16, 4)
    assert readers.wav_samples(wav).collect()[0].samples == [0.0, 0.5, -1.0, 0.25]
    errors = {r.path[-5:]: r.error for r in readers.pdf_checks(readers.files(spark, str(tmp_path))).collect()}
    assert errors == {"b.pdf": None, "d.pdf": "no PDF header"}
    bad = readers.pages_from(wav, lambda content: 1 / 0, "page int").collect()
    assert bad[0].page is None and bad[0].error.startswith("ZeroDivisionError")
    short = spark.createDataFrame([([1.0, 0.5],)], "s array<double>").select(readers.voice_sample(F.col("s"), F.lit(1), 2, 2), readers.voice_sample(F.col("s"), F.lit(1), 2, 3)).collect()[0]
    assert short[0] == [0.95, 0.475] and short[1] is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "body", "y", 1, None), ("a", 1, "body", "x", 1, None)], "book string, block_no int, type string, text string, source_page int, source_page_end int")
    writers.write_blocks(rows, str(tmp_path / "b"))
    assert [r.block_no for r in spark.read.json(str(tmp_path / "b/book=a")).collect()] == [1, 2]
    state = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "id int, v int, s string")
    writers.upsert(state, spark.createDataFrame([(1, 1, "new")], "id int, v int, s string"), ["id"], "v", str(tmp_path / "s"))
    assert sorted((r.id, r.s) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, "new"), (2, "kept")]
    writers.write_new(state, str(tmp_path / "n"))
    with pytest.raises(Exception, match="exists"):
        writers.write_new(state, str(tmp_path / "n"))
    writers.append_log(spark.createDataFrame([("m",)], "message string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).collect()[0].value.endswith("] m")
    assert writers.report(spark.createDataFrame([("b", "2"), ("a", None)], "name string, value string")).collect()[0].text == "a: -\nb: 2"


def test_stream(spark, tmp_path):
    import datetime

    at = datetime.datetime(2031, 1, 7, 10, 3)
    rows = [("a", 1, 24000, 24000, at, at), ("a", 1, 24000, 24000, at, at), ("a", 2, 48000, 24000, at, at), ("a", 3, None, 24000, at, at)]
    later = [("b", 1, 24000, 24000, at + datetime.timedelta(days=9), at)]
    for k, part in enumerate((rows, later, later)):
        spark.createDataFrame(part, progress.SEGMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = progress.made_by_window(progress.segment_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    progress.run_available(out, "made", str(tmp_path / "ck"))
    got = [(r.book, r.pieces, r.seconds) for r in spark.table("made").collect()]
    assert got == [("a", 2, 3.0)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    f = tmp_path / "records.jsonl"
    f.write_text("".join('{"n": %d, "x": "%s"}\n' % (i, "y" * (i % 90)) for i in range(1, 3001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = readers.numbered_records(spark, str(f))
        assert rows.select("value").rdd.getNumPartitions() > 1 and rows.where("line_no != cast(get_json_object(value, '$.n') as bigint)").count() == 0 and rows.count() == 3000
        assert [r["n"] for r in readers.json_record(spark, str(f), 2999, "n int").collect()] == [2999]
        assert readers.json_record(spark, str(f), 3001, "n int").collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_delivered_books_replace_their_own_rows_only(spark, tmp_path):
    path, kind = str(tmp_path / "d"), "book string, chunk_idx int, frames bigint"
    back = lambda: sorted(map(tuple, spark.read.parquet(path).select("book", "chunk_idx", "frames").collect()), key=str)
    writers.write_segments(spark.createDataFrame([], kind), path)
    books = [f"b{i}" for i in range(300)] + ["", "a/b=c", None]
    first = [(b, i, 1) for b in books for i in range(3)]
    writers.write_segments(spark.createDataFrame(first, kind).repartition(8), path)
    assert back() == sorted(first, key=str)
    assert len(list((tmp_path / "d").rglob("*.parquet"))) < 300
    second = [("b7", 0, 2), ("", 5, 2), (None, 1, 2), ("new", 0, 2)]
    writers.write_segments(spark.createDataFrame(second, kind), path)
    assert back() == sorted([r for r in first if r[0] not in ("b7", "", None)] + second, key=str)
