"""Queries over whole tables against brute force on small ones."""

import pytest

from folioflow.plans import catalogue


def run(spark, name, d, *columns):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, str(d)).select(*columns).collect()]


def test_embedded_of_every_page(spark, tmp_path):
    texts = ["plain", "it's 'quoted'", "", "'", "two\nlines", "x' text = 'y' after_ms = 7", "'" * 60_000, "a'b" * 40_000, "\\1 $2"]
    rows = [("b", i, "body" if i % 2 else "head'ing", t, p) for i, (t, p) in enumerate((t, p) for t in texts for p in (5, 6, None))]
    blocks = rows + rows[:4] + [("b", 900, "body", None, 5)]
    spark.createDataFrame(blocks, "book string, block_no int, type string, text string, source_page int").write.parquet(str(tmp_path / "blocks.parquet"))
    got = run(spark, "src16_embedded", tmp_path, "book", "block_no", "role", "text", "after_ms")
    assert sorted(got) == sorted((b, n, kind, t, n) for b, n, kind, t, _ in rows)


def test_silence_of_every_piece(spark, tmp_path):
    pauses = [(0, 0), (0, 50), (0, 150), (0, 199), (0, 200), (200, 250), (0, 650), (200, 800), (1, 5000), (7, 333)]
    rows = [("b", i, "text", before, after) for i, (before, after) in enumerate(pauses)]
    spark.createDataFrame(rows + rows[4:6], "book string, chunk_idx int, text string, before_ms int, after_ms int").write.parquet(str(tmp_path / "chunk_plan.parquet"))
    got = run(spark, "arr04_silence", tmp_path, "book", "chunk_idx", "zeros")
    assert sorted(got) == [("b", i, int(24000 * before / 1000) + int(24000 * after / 1000)) for i, (before, after) in enumerate(pauses)]


def test_stratified_reads_every_finished_piece(spark, tmp_path):
    n, done = 23, [i for i in range(23) if i % 4 != 3 and not 11 <= i < 17] + [40]  # the third stratum is empty, 40 isn't in the plan
    frames = {i: 1000 * i + (7 if i % 5 else 90_000) for i in done}
    plan = [("b", i) for i in range(n)] + [("only", 0), ("only", 1)]
    segments = [("b", i, f, 24000, i, i) for i, f in frames.items()] + [("b", 0, 1, 24000, -1, 0), ("only", 1, 500, 24000, 0, 0), ("only", 0, None, 24000, 0, 0)]
    spark.createDataFrame(plan, "book string, chunk_idx int").write.parquet(str(tmp_path / "chunk_plan.parquet"))
    spark.createDataFrame(segments, "book string, chunk_idx int, frames long, sr int, written_at long, loaded_at long").write.parquet(str(tmp_path / "segments.parquet"))
    mean = lambda v: sum(v) / len(v)
    inside = [i for i in frames if i < n]
    cells = [(n * s // 4, n * (s + 1) // 4) for s in range(4)]
    assert not [i for i in inside if cells[2][0] <= i < cells[2][1]]
    want = sum(mean([frames[i] for i in inside if lo <= i < hi] or [frames[i] for i in inside]) * (hi - lo) for lo, hi in cells)
    assert sorted(run(spark, "agg17_stratified", tmp_path, "book", "estimate")) == [("b", pytest.approx(want, abs=1e-3)), ("only", 1000.0)]
