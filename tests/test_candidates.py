"""Candidate signals against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curatrix.plans import candidates as Ca


def logit(p):
    p = min(max(p, 1e-5), 1 - 1e-5)
    return math.log(p / (1 - p))


def test_candidate_report_equals_a_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for k in range(160):
        y = int(rng.random() < 0.4)
        rows.append((k, "ab"[k % 2], y, round(rng.random(), 2), round(min(1, max(0, 0.5 * y + 0.5 * rng.random())), 2) if k % 5 else None, 0.5))
    df = spark.createDataFrame(rows, "id int, category string, y int, base double, good double, flat double")
    got = {(r["category"], r["candidate"]): r for r in Ca.candidate_report(Ca.candidate_grid(df, "y", "base", ["good", "flat"], ["category"]), ["category"]).collect()}

    def best(own, weight, column):
        scored = [(round(1 / (1 + math.exp(-((1 - weight) * logit(r[3]) + weight * logit(r[3] if column is None or r[column] is None else r[column])))), 12), r[2]) for r in own]
        found = []
        for t in sorted({s for s, _ in scored}):
            tp, fp, fn = (sum(y == a and (s >= t) == b for s, y in scored) for a, b in ((1, True), (0, True), (1, False)))
            found.append((-round(2 * tp / (2 * tp + fp + fn), 12), t))
        return min(found)

    for category in "ab":
        own = [r for r in rows if r[1] == category]
        alone = -best(own, 0.0, None)[0]
        for name, column in (("good", 4), ("flat", 5)):
            f1, weight, t = min((best(own, w, column)[0], w, best(own, w, column)[1]) for w in Ca.WEIGHTS)
            row = got[category, name]
            assert (row["weight"], row["threshold"]) == (weight, pytest.approx(t)) and row["f1"] == pytest.approx(-f1) and row["gain"] == pytest.approx(-f1 - alone)
    assert got["a", "good"]["gain"] > 0.05


def test_signals_by_fold(spark):
    rng = random.Random(2)
    rows = []
    for k in range(90):
        y = k // 6 % 2
        state = [[float(y) + rng.gauss(0, 0.2), 1.0], [9.0, 9.0]]
        rows.append((str(k), "ab"[k % 2], "tea pot" if y else "nail oak", "long words here " * 3, y, k % 3, state, [1, 0], [1.0, 0.1] if y else [0.1, 1.0]))
    rows.append(("x", "c", "none", None, 1, 0, None, None, [1.0, 0.0]))
    cards = spark.createDataFrame(rows, "id string, category string, title string, description string, y int, fold int, states array<array<double>>, mask array<int>, embedding array<double>")
    known = cards.where("category <> 'c'")
    for name in ("title", "weighted", "short"):
        got = {r["id"]: r["score"] for r in Ca.field_lexical_scores(known, "y", "fold", 3, name, limits={"word": 20, "char": 50}).collect()}
        assert len(got) == 90 and all((got[r[0]] > 0.5) == bool(r[4]) for r in rows[:90])
    hidden = {r["id"]: r["score"] for r in Ca.hidden_state_scores(known, F.col("states"), F.col("mask"), "y", "fold", 3).collect()}
    assert len(hidden) == 90 and sum((hidden[r[0]] > 0.5) == bool(r[4]) for r in rows[:90]) > 85
    prototypes = spark.createDataFrame([(1, "a", [1.0, 0.0], 1), (2, "a", [0.0, 1.0], 0), (3, "b", [1.0, 0.0], 1), (4, "b", [0.0, 1.0], 0), (5, "c", [1.0, 0.0], 1)], "id int, category string, embedding array<double>, label int")
    margins = {r["id"]: r["score"] for r in Ca.prototype_scores(cards, prototypes).collect()}
    assert all((margins[r[0]] > 0.5) == bool(r[4]) for r in rows[:90]) and margins["x"] is None
