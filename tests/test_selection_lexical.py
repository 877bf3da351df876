"""Exact selection, folds by classes of groups, ordered digests, and the lexical models trained side by side."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import hashing as H
from curatrix.operators import estimators as E
from curatrix.operators import lexical as L
from curatrix.operators import reports as Re
from curatrix.operators import selection as Se
from curatrix.operators import splits as Sp
from curatrix.operators.relational import Violation
from curatrix.session import settled


@pytest.mark.parametrize("cells", [4, 4096])
def test_order_statistics_are_those_of_sorted_values(spark, cells):
    rng = np.random.default_rng(3)
    columns = [
        rng.normal(size=501), np.exp(rng.normal(scale=60, size=300)) * rng.choice([-1, 1], 300), np.repeat([1.0, 2.0, 2.0, 3.0], 40), np.array([5.0]), rng.integers(0, 3, 100).astype(float),
        np.array([1e308, -1e308, 0.0, 1.7e308, -1.7e308]), np.array([5e-324, 0.0, 1e-300, -5e-324]),
    ]
    shares = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    for values in columns:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        n, got = Se.order_statistics(df, F.col("v"), shares, cells)
        ordered = sorted(values)
        assert n == len(values)
        for share, x in zip(shares, got, strict=True):
            place = share * (n - 1)
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            assert x == (low if low == high else low + (high - low) * (place - math.floor(place)))


def test_order_statistics_of_odd_columns(spark):
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -float("inf"), 1.0, 2.0, None)], "v double")
    n, got = Se.order_statistics(odd, F.col("v"), [0.0, 0.25, 0.5, 0.75])
    assert n == 5 and got == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(Se.order_statistics(odd, F.col("v"), [1.0])[1][0])
    assert Se.order_statistics(odd.where("v is null"), F.col("v"), [0.5]) == (0, [None])
    assert tuple(Re.quantiles(odd.limit(0), F.col("v")).first()) == (None,) * 5


def test_numbered_counts_through_parts(spark):
    rows = [(k % 3, random.Random(k).random(), k) for k in range(300)]
    made = Se.numbered(spark.createDataFrame(rows, "g int, x double, id int").repartition(7), ["g"], "x", "id").collect()
    for g in range(3):
        assert [r["number"] for r in sorted((r for r in made if r["g"] == g), key=lambda r: (r["x"], r["id"]))] == list(range(1, 101))


def test_rank_share_is_the_cumulative_distribution(spark):
    rows = [(k, k % 2, [0.1, 0.1, 0.7, -3.0, 900.0][k % 5]) for k in range(40)] + [(40, 1, None), (41, None, 0.5)]
    got = {r["id"]: r["rank_share"] for r in Re.rank_share(spark.createDataFrame(rows, "id int, y int, x double"), "x", "y").collect()}
    for k, y, x in rows:
        same = [(-math.inf if v is None else v) for _, z, v in rows if z == y]
        assert got[k] == pytest.approx(sum(v <= (-math.inf if x is None else x) for v in same) / len(same))


def row_wise(classes, folds):
    """The same greedy filling, a group at a time."""
    width = len(classes[0][0]) - 1
    total = [sum(kind[1 + k] * n for kind, n in classes) for k in range(width)]
    goal, rows_goal = [t / folds for t in total], sum(kind[0] * n for kind, n in classes) / folds
    order = sorted(classes, key=lambda c: (-sum(y / max(t, 1) for y, t in zip(c[0][1:], total)), -c[0][0], c[0]))
    have, size, opened, made = np.zeros((folds, width)), np.zeros(folds), 0, {}
    for kind, n in order:
        for _ in range(n):
            y = np.array(kind[1:], dtype=float)
            costs = [(((have[f] + y - goal) / np.maximum(goal, 1)) ** 2).mean() + 0.25 * ((size[f] + kind[0] - rows_goal) / max(rows_goal, 1)) ** 2 for f in range(folds)]
            fold = opened if opened < folds else int(np.argmin(np.round(costs, 12)))
            opened += 1
            have[fold] += y
            size[fold] += kind[0]
            made[kind, fold] = made.get((kind, fold), 0) + 1
    return made, have, size


def test_folds_by_classes_cost_what_row_wise_ones_do():
    rng = random.Random(9)
    for _ in range(60):
        kinds = {(rng.randint(1, 9), *(float(rng.randint(0, 4)) for _ in range(rng.choice([1, 2])))) for _ in range(rng.randint(1, 8))}
        width = min(len(k) for k in kinds)
        classes = [(k[:width], rng.randint(1, 60)) for k in {k[:width] for k in kinds}]
        folds = rng.randint(2, 5)
        made = Sp.fill_folds(classes, folds)
        assert {(kind, f): n for kind, dealt in made for f, _, n in dealt} == row_wise(classes, folds)[0]
        assert all([low for _, low, _ in dealt] == list(np.cumsum([0, *(n for _, _, n in dealt)])[:-1]) for _, dealt in made)
    many = Sp.fill_folds([((3, 1.0), 10**9), ((2, 0.0), 10**9)], 5)  # classes, not groups, are what it costs
    assert sum(n for _, dealt in many for _, _, n in dealt) == 2 * 10**9


def test_greedy_folds_deal_whole_groups_once(spark):
    rows = [(f"g{k // 3}", int(k % 9 == 0), int(k % 4 == 1)) for k in range(900)]
    df = spark.createDataFrame(rows, "group string, x int, y int")
    made = Sp.greedy_folds(df, "group", [F.col("x"), F.col("y")], 5).collect()
    assert len(made) == len({r["group"] for r in made}) == 300
    per = {}
    for r in made:
        own = [x for x in rows if x[0] == r["group"]]
        kind = (len(own), float(sum(x[1] for x in own)), float(sum(x[2] for x in own)))
        per[kind, r["fold"]] = per.get((kind, r["fold"]), 0) + 1
    classes = {}
    for (kind, _), n in per.items():
        classes[kind] = classes.get(kind, 0) + n
    assert per == row_wise(list(classes.items()), 5)[0]


def test_holdout_search_equals_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randint(0, 40)}", rng.choice("abc")) for _ in range(400)]
    got = {r["seed"]: r for r in Sp.holdout_search(spark.createDataFrame(rows, "grp string, s string"), "grp", "s", 0.3, 7, 6).collect()}
    groups = sorted({g for g, _ in rows})
    share = lambda seed, g: int(hashlib.md5(f"{seed}/{g}".encode()).hexdigest()[:8], 16) / 16**8
    for seed in range(7, 13):
        held = set(sorted(groups, key=lambda g: (share(seed, g), g))[: math.ceil(0.3 * len(groups))])
        inside = [s for g, s in rows if g in held]
        errors = [abs(inside.count(s) / len(inside) - sum(x == s for _, x in rows) / 400) for s in "abc"]
        assert (got[seed]["valid_rows"], got[seed]["valid_groups"]) == (len(inside), len(held))
        assert got[seed]["objective"] == pytest.approx(np.mean(errors) + abs(len(inside) / 400 - 0.3))
    plan = Sp.holdout_search(spark.createDataFrame(rows, "grp string, s string"), "grp", "s", 0.3, 7, 6)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_ordered_digests_read_parts_in_turn(spark):
    ids = [f"id{random.Random(k).randint(0, 10**6)}" for k in range(3000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "pos int, id string").repartition(9, "id")
    row = H.id_fingerprint(df, "id", "pos").first()
    assert row["fingerprint"] == hashlib.sha256("".join(f"{v}\0" for v in ids).encode()).hexdigest() and row["rows"] == 3000
    assert H.short_hash(df, "id").first()[0] == hashlib.sha256("".join(sorted(ids)).encode()).hexdigest()[:16]
    assert H.short_hash(df.limit(0), "id").first()[0] == hashlib.sha256(b"").hexdigest()[:16]


def lexical_cards(spark):
    rng = random.Random(11)
    words = {("a", 0): "tea leaf pot cup warm", ("a", 1): "flame spark fuse burn café", ("b", 0): "shelf wood oak nail", ("b", 1): "pill dose vitamin gel herb"}
    rows = []
    for k in range(150):
        category, y = "ab"[k % 2], int(rng.random() < 0.35)
        own = words[category, y].split() if rng.random() < 0.8 else words[category, 1 - y].split()
        rows.append((k, category, " ".join(rng.choices(own + ["the", "of", "and"], k=rng.randint(1, 14))), y, k // 2 % 3, "kept"))
    return spark.createDataFrame([*rows, (900, "a", None, 0, 1, "kept"), (901, "a", "", 1, 2, None)], "id int, category string, text string, y int, fold int, score string")


def test_models_trained_together_equal_single_fits(spark):
    """Every category and fold against its own vocabulary and features by the ordinary operators, solved by Newton's method with a constant as penalised intercept."""
    cards, limits = lexical_cards(spark), {"word": 30, "char": 60}  # limits that cut, through many equal counts
    got = {r["id"]: r["score"] for r in L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits, tolerance=1e-6).select("id", "score").collect()}
    assert len(got) == 152
    for category in "ab":
        own = cards.where(F.col("category") == category).drop("score")
        statistics = settled(E.lexical_statistics(own, "id", F.col("text"), "fold"))
        for k in range(3):
            rows = E.lexical_union(own, "id", F.col("text"), statistics, own.where(F.col("fold") != k).count(), k, limits).collect()
            x = np.array([[*r["features"].toArray(), 1.0] for r in rows])
            y, inside = np.array([r["y"] for r in rows]), np.array([r["fold"] == k for r in rows])
            a, t = x[~inside], y[~inside]
            weights = np.where(t == 1, len(t) / 2 / t.sum(), len(t) / 2 / (len(t) - t.sum()))
            w = np.zeros(x.shape[1])
            for _ in range(30):
                p = 1 / (1 + np.exp(-a @ w))
                w -= np.linalg.solve(4 * (a.T * (weights * p * (1 - p))) @ a + np.eye(len(w)), 4 * a.T @ (weights * (p - t)) + w)
            want = 1 / (1 + np.exp(-x[inside] @ w))
            assert np.allclose([got[r["id"]] for r, here in zip(rows, inside, strict=True) if here], want, atol=1e-6)


def test_runs_of_the_optimiser_and_tolerance(spark):
    cards, limits = lexical_cards(spark), {"word": 30, "char": 60}
    fine = {r["id"]: r["score"] for r in L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits, tolerance=1e-7).collect()}
    rough = {r["id"]: r["score"] for r in L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits, most_coefficients=1).collect()}  # a category a run
    assert max(abs(fine[k] - rough[k]) for k in fine) <= 1e-3 * 3**0.5 / 4 + 1e-6
    with pytest.raises(Violation):
        L.lexical_out_of_fold(cards.where("fold = 0 or y = 1"), "y", "fold", 3, F.col("text"), limits=limits)
    assert L.lexical_out_of_fold(cards.limit(0), "y", "fold", 3, F.col("text")).count() == 0


def test_gradients_add_up_whatever_the_tasks(spark, monkeypatch):
    cards, limits = lexical_cards(spark), {"word": 30, "char": 60}
    seen = []
    plain = L.losses_and_gradients

    def both(stored, weights, idf, by_class, tasks):
        one = plain(stored, weights, idf, by_class, tasks)
        if len(seen) < 2:
            stored = stored.repartition(6)
            seen.append(all(np.allclose(a, b) for a, b in zip(one, plain(stored, weights, idf, by_class, 6, tree=2), strict=True)))
        return one

    monkeypatch.setattr(L, "losses_and_gradients", both)
    monkeypatch.setattr(L, "_BLOCK", 50)
    L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits).count()
    assert seen == [True, True]


def test_models_settle_in_few_passes(spark, monkeypatch):
    """Ill-conditioned models (long texts over common words): Newton's directions need far fewer passes over the rows than their gradients did."""
    rng, seen = random.Random(5), []
    rows = []
    for k in range(240):
        y = int(rng.random() < 0.8)
        rows.append((k, "a", " ".join(rng.choices([f"w{j}" for j in range(60)], weights=[1 + (j % 7 == 3) * y * 0.3 for j in range(60)], k=120)), y, k % 3))
    plain = L.minimise
    monkeypatch.setattr(L, "minimise", lambda *args: seen.append(plain(*args)) or seen[-1])
    made = L.lexical_out_of_fold(spark.createDataFrame(rows, "id int, category string, text string, y int, fold int"), "y", "fold", 3, F.col("text"), limits={"word": 500, "char": 500})
    (_, sizes, passes), = seen
    assert made.count() == 240 and (sizes <= 1e-3).all() and passes <= 60


def test_blocks_multiply_as_plain_matrices():
    """Dense and other slots of a block, and texts without terms, against the matrix of all folds."""
    rng, folds = np.random.default_rng(2), 3
    rows, plain = [], np.zeros((60, 900, folds))
    for i in range(60):
        own = [np.sort(rng.choice(np.arange(low, high), size, replace=False)) for low, high, size in ((0, 300, 0 if i == 7 else 4), (300, 899, 30), (899, 900, 1))]
        own[1] = np.union1d(own[1], np.arange(300, 310)) if i % 9 else own[1]
        counts, lengths = [rng.integers(1, 5, len(x)).astype(float) for x in own], rng.random((3, folds))
        for slots, times, length in zip(own, counts, lengths, strict=True):
            plain[i, slots] = times[:, None] * length
        rows.append((0, i % 2, i % folds, (own, counts, lengths)))
    block = L.Block([memoryview(x) for x in L._packed(rows)], folds)
    assert min(len(block.places), sum(len(slots) for slots, _ in block.dense)) > 5
    weights, residuals = rng.normal(size=(2, 900, folds)), rng.normal(size=(60, folds))
    for got, w in zip(block.margins(*[(w, w.T.copy()) for w in weights]), weights, strict=True):
        assert np.allclose(got, np.einsum("isf,sf->if", plain, w))
    total = np.zeros((900, folds)), np.zeros((folds, 900))
    block.back(residuals, total)
    assert np.allclose(total[0] + total[1].T, np.einsum("isf,if->sf", plain, residuals))


def test_terms_counted_together_equal_counts_text_by_text(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Tea", "leaf,", "café", "a", "x" * 9, "Ω-3", " "], k=rng.randint(0, 20))) for _ in range(50)]
    monkeypatch.setattr(L, "_SPREAD", 100)
    held = L._Counted(2)
    for k, text in enumerate(texts):
        held.add(k % 2, text)
    for kind, made in (("word", held.word_terms()), ("char", held.char_terms())):
        got = {term: (tuple(rows), tuple(times)) for terms, r, t in made for term, rows, times in zip(terms.to_pylist(), r.tolist(), t.tolist(), strict=True)}
        want: dict = {}
        for k, text in enumerate(texts):
            for term, n in E.lexical_terms(text, kind).items():
                own = want.setdefault(term, ([0, 0], [0, 0]))
                own[0][k % 2] += 1
                own[1][k % 2] += n
        assert got == {term: (tuple(rows), tuple(times)) for term, (rows, times) in want.items()}


def test_scores_come_with_the_rows_that_the_blocks_carry(spark):
    cards, limits = lexical_cards(spark), {"word": 30, "char": 60}
    made = L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits, keep=["id", "category"])
    whole = L.lexical_out_of_fold(cards, "y", "fold", 3, F.col("text"), limits=limits)
    assert made.columns == ["id", "category", "score"] and whole.columns == cards.columns
    assert {r["id"]: r["score"] for r in made.collect()} == pytest.approx({r["id"]: r["score"] for r in whole.collect()}, abs=1e-3)
    assert {(r["id"], r["text"]) for r in whole.collect()} == {(r["id"], r["text"]) for r in cards.collect()}
