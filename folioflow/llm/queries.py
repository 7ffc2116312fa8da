"""The pN_ queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import lookalike, mixing, packing, quality, repeats, scan_repair, sentences, splitting, subjects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": scan_repair.found,
    "p1_repaired": scan_repair.repaired,
    "p2_found": sentences.found,
    "p2_sentences": sentences.sentences,
    "p3_found": repeats.found,
    "p3_cleaned": repeats.cleaned,
    "p3_passages": repeats.passages,
    "p4_found": splitting.found,
    "p4_pieces": splitting.pieces,
    "p4_rejoined": splitting.rejoined,
    "p5_found": lookalike.found,
    "p5_normalised": lookalike.normalised,
    "p6_found": quality.found,
    "p6_pages": quality.pages,
    "p7_packed": packing.packed,
    "p7_fill": packing.fill_report,
    "p7_checked": packing.checked,
    "p8_mixed": mixing.mixed,
    "p8_shares": mixing.shares,
    "p8_checked": mixing.checked,
    "p9_found": subjects.found,
    "p9_shares": subjects.subject_shares,
}

ORACLE_SQL: dict[str, str] = {
    "p3_found": repeats.FOUND_SQL,
    "p3_cleaned": repeats.CLEANED_SQL,
    "p4_found": splitting.FOUND_SQL,
    "p4_rejoined": splitting.REJOINED_SQL,
    "p7_checked": packing.CHECKED_SQL,
    "p8_checked": mixing.CHECKED_SQL,
}
