"""Problem 1: words too rare for the vocabulary are looked up in the whole corpus."""

import random

from folioflow.llm import scan_repair

FILLER = "the old clerk carried a polished lantern and the crimson village mended a clean mirror every morning"


def tables(spark, at, texts):
    """Body blocks of scanned books from (book, block_no, text)."""
    books = sorted({b for b, *_ in texts})
    spark.createDataFrame([(b, "B", f"title {b}", f"/{b}.pdf") for b in books], "id string, path string, title string, pdf_path string").write.parquet(f"{at}/jobs.parquet")
    spark.createDataFrame([(b, n, "body", t, None) for b, n, t in texts], "book string, block_no int, type string, text string, source_page int").write.parquet(f"{at}/blocks.parquet")
    return str(at)


def corpus():
    """Rare words in book a, their misreadings in book b, words that only look alike in book c."""
    a = [("a", i, f"{FILLER} quondhal {FILLER} zarthmoel {FILLER} großvarn {FILLER} Vinumbra") for i in range(5)]
    b = [("b", i, f"{FILLER} {w} {FILLER}") for i, w in enumerate(["quonclhal", "zarthmoe1", "grobvarn", "Vinurnbra", "quondhal", "unseen"])]
    c = [("c", i, f"{FILLER} quonclhat {FILLER} tessarnor tessamor") for i in range(4)]
    return a + b + c


def test_key_keeps_every_rewriting():
    for a, ts in [(a, t) for a, t in scan_repair.CONFUSIONS.items()] + scan_repair.CONFUSIONS_LONG:
        for t in ts if len(a) == 1 and a in scan_repair.CONFUSIONS and ts == scan_repair.CONFUSIONS[a] else [ts]:
            assert scan_repair.reading_key(a) == scan_repair.reading_key(t), (a, t)


def test_rare_words_of_other_books(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_repair, "MIN_SHARE", 0.01)  # as in a corpus so large that the share asks for more than five occurrences
    got = scan_repair.found(spark, tables(spark, tmp_path, corpus())).collect()
    assert sorted((r.book, r.block_no) for r in got if r.defect == "glyph") == [("b", 0), ("b", 1), ("b", 2), ("b", 3)]


def test_lookup_is_complete(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("ehlimnrudcbß") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    forms = ["".join(rng.choice("ehlimnrudcb8") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    steps = [(a, t) for a, ts in scan_repair.CONFUSIONS.items() for t in ts] + scan_repair.CONFUSIONS_LONG
    for w in words:  # and forms two rewritings away
        for _ in range(2):
            seen, true = rng.choice([(s, t) for s, t in steps if t in w] or [("", "")])
            forms.append(w.replace(true, seen, 1))
    forms = sorted({f for f in forms if f not in words and not scan_repair.SURE.search(f)})
    sums = spark.createDataFrame([(w, 4) for w in sorted(set(words))] + [("", 10_000)], "word string, n bigint")
    left = spark.createDataFrame([(f, f, False) for f in forms], "word string, base string, named boolean")
    got = {(r.word, r.right) for r in scan_repair.rare_misread(left, sums, 15, lambda: scan_repair.Scan({"morning": 900})).collect()}
    trie = scan_repair.Trie({w: 4 for w in words})
    want = {(f, c) for f in forms for c, *_ in trie.candidates(f, scan_repair.reach(f))}
    assert len(want) > 100 and {(f, w) for f, w in got if f in set(forms)} == want


def test_repair_mends_what_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_repair, "MIN_SHARE", 0.01)
    own = [("d", i, f"{FILLER} Moldrath {FILLER}") for i in range(3)] + [("d", 3, f"{FILLER} ‘Mo1drath!’ and Molclrath, {FILLER}"), ("d", 4, None)]
    at = tables(spark, tmp_path, corpus() + own)
    got = {(r.book, r.block_no): r.text for r in scan_repair.repaired(spark, at).collect()}
    rare = ["quondhal", "zarthmoel", "großvarn", "Vinumbra", "quondhal", "unseen"]
    assert [got["b", i] for i in range(6)] == [f"{FILLER} {w} {FILLER}" for w in rare]
    assert got["d", 3] == f"{FILLER} ‘Moldrath!’ and Moldrath, {FILLER}"
    assert all(got[b, i] == t for b, i, t in corpus() if b in "ac")
    assert len(got) == 19


def test_repair_mends_names_of_the_own_book(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_repair, "MIN_SHARE", 0.05)
    # three misreadings in one word are beyond the automaton, so the book alone tells
    at = tables(spark, tmp_path, [("f", i, f"{FILLER} {w} {FILLER}") for i, w in enumerate(["Tadodedo"] * 4 + ["Taclocleclo"])])
    assert [(r.block_no, r.defect) for r in scan_repair.found(spark, at).collect()] == [(4, "glyph")]
    assert {r.text for r in scan_repair.repaired(spark, at).collect()} == {f"{FILLER} Tadodedo {FILLER}"}


def test_repair_keeps_case_and_edges():
    scan = scan_repair.Scan({w: 50 for w in FILLER.split()})
    assert scan_repair.repair("The ‘quonclhal’ QUONCLHAL old", "t", None, scan, {("quonclhal", False): "quondhal"}) == "The ‘quondhal’ QUONDHAL old"
