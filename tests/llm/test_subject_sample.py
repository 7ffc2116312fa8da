"""Problem 9: the second training reads its documents whole."""

import numpy as np

from folioflow.llm import subjects


def test_sampled_documents_are_read_whole(spark):
    text = "\n\n".join(f"The clerk carried lantern number {i} through the old village." for i in range(600))
    assert len(text) > 30_000
    docs = spark.createDataFrame([("x", text)], "doc_id string, text string")
    parameters = (np.zeros((subjects.BUCKETS, 1), np.float32), np.full(1, 9, np.float32), frozenset(), np.array([1.0, 0.0, 0.0]))
    got = [r["text"] for r in subjects._clear_documents(docs, ["trade"], parameters).collect()]
    assert got == subjects.parts_of(text) and "599" in got[-1]


def test_one_task_trains_where_tasks_cannot_meet(spark, monkeypatch):
    class Cut(subjects.Exchange):
        def __init__(self, task, key):
            raise ConnectionError("no way")

    rows = [("law", f"The judge read law number {i} in the court.", i % 5 == 4) for i in range(20)] + [("mill", f"The wheel of mill number {i} grinds corn.", i % 5 == 4) for i in range(20)]
    examples = spark.createDataFrame(rows, "subject string, text string, held boolean")
    both = subjects._fit(examples, ["law", "mill"], 5)
    monkeypatch.setattr(subjects, "Exchange", Cut)
    alone = subjects._fit(examples, ["law", "mill"], 5)
    assert both[2] == alone[2] and np.allclose(both[0], alone[0], atol=1e-3) and np.allclose(both[1], alone[1], atol=1e-3)
