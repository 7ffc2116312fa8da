"""Problem 2: a sentence may hold any number of doubtful marks."""

import random

from folioflow.llm.sentences import LEAST_SPAN, _best, _span_score


def every_span(line, end, nodes):
    """The best ends by trying all predecessors."""
    at, best = [(0, 0.0, False), *nodes, (end, 0.0, False)], [(0.0, [])]
    for j in range(1, len(at)):
        scores = []
        for i in range(j - 1, -1, -1):
            start = at[i][0] + (line[at[i][0]] == " ")
            scores.append((best[i][0] + at[j][1] + _span_score(line, start, at[j][0], at[j][2]), best[i][1] + [at[j][0]]))
        best.append(max(scores, key=lambda x: x[0]))
    return best[-1][1]


def test_spans_cross_any_number_of_doubtful_marks():
    line = "The list " + "Abel. " * 60 + "end."
    marks = [i + 1 for i, ch in enumerate(line[:-1]) if ch == "."]
    assert _best(line, 0, len(line), [(m, -4.0, True) for m in marks]) == [len(line)]
    rng = random.Random(5)
    for _ in range(20):
        nodes = [(m, rng.choice([-4.0, -2.0, 0.0, 0.5, 1.0]), True) for m in marks]
        assert _best(line, 0, len(line), nodes) == every_span(line, len(line), nodes)


WORDS = ["the", "Lee", "(so", "over)", "“Run", "away”", "at", "to", "„so", "«no", "x" * 300, "9", "and"]


def test_what_is_left_out_is_in_no_best_sequence():
    rng = random.Random(7)
    for _ in range(60):
        line = " ".join(rng.choice(WORDS) + rng.choice(["", ".", "."]) for _ in range(25))
        nodes = [(i + 1, rng.choice([LEAST_SPAN - 0.01, -30.0, -7.0, 0.5, 6.0]), rng.random() < 0.5) for i, ch in enumerate(line[:-1]) if ch == "."]
        kept = [n for n in nodes if n[1] >= LEAST_SPAN]
        assert _best(line, 0, len(line), kept) == every_span(line, len(line), nodes)
        a, b = sorted(rng.sample(range(len(line)), 2))
        for unit in ("words", "cjk", "thai"):
            assert LEAST_SPAN <= _span_score(line, a, b, True, unit) <= 0
