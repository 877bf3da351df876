"""Classification metrics, threshold sweeps and rule statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.constants import ERROR_FAMILIES


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_counts(label: Column, prediction: Column) -> list[Column]:
    return [F.count_if((label == a) & (prediction == b)).alias(name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def category_f1(df: DataFrame, label: str = "label", prediction: str = "prediction", category: str = "category", official: str = "official_score", known: tuple[str, ...] | None = None) -> DataFrame:
    """(category, f1) of the positive class, and their plain mean under the name official.

    With `known`, a row of another category fails the query, and so does a known category without rows.
    """
    if known is not None:
        name = F.col(category)
        df = df.withColumn(category, F.when(name.isin(*known), name).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(name, F.lit("null"))))))
    per = df.groupBy(category).agg(*confusion_counts(F.col(label), F.col(prediction))).select(F.col(category).alias("category"), _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    mean = F.avg("f1")
    if known is not None:
        mean = F.when(F.count("*") == len(set(known)), mean).otherwise(F.raise_error(F.lit("a known category has no rows")).cast("double"))
    return per.unionByName(per.agg(F.lit(official).alias("category"), mean.alias("f1")))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) of every class that occurs among labels or predictions."""
    sides = df.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("m")), F.struct(F.col(prediction).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(label) == F.col(prediction)).cast("int").alias("m")))).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("m").alias("tp"))
    return sums.select("class", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), _f1(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")).alias("f1"), "support")


def classification_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: macro_f1, weighted_f1, accuracy, balanced_accuracy (classes without support don't count there)."""
    p = per_class(df, label, prediction)
    return p.agg(
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def multilabel_summary(df: DataFrame, key: str, label: str = "y", prediction: str = "p", cls: str = "class") -> DataFrame:
    """One row from the long form (key, class, y, p): macro, micro and weighted F1, and subset accuracy."""
    per = df.groupBy(cls).agg(*confusion_counts(F.col(label), F.col(prediction)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    head = per.agg(
        F.avg(_f1(tp, fp, fn)).alias("macro_f1"), _f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        F.coalesce(F.sum(_f1(tp, fp, fn) * (tp + fn)) / F.nullif(F.sum(tp + fn), F.lit(0)), F.lit(0.0)).alias("weighted_f1"),
    )
    exact = df.groupBy(key).agg(F.min((F.col(label) == F.col(prediction)).cast("int")).alias("e")).agg(F.avg("e").alias("subset_accuracy"))
    return head.crossJoin(exact)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for all pairs of classes that occur, zeros kept. Classes are few by nature."""
    classes = df.select(F.col(label).alias("c")).union(df.select(F.col(prediction))).distinct()
    counts = df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count("*").alias("k"))
    grid = classes.select(F.col("c").alias("actual")).crossJoin(F.broadcast(classes.select(F.col("c").alias("predicted"))))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("k", F.lit(0)).alias("n"))


def running_sums(df: DataFrame, order: str, sums: list[str], by: list[str], descending: bool = True, then: str | None = None) -> DataFrame:
    """df with run_<x>, the sum of x up to the row in the order of a number (within by; equal ones by `then`), and all_<x>, the whole sum.

    Rows are windowed within cells of the number's range, and only the cells' sums (65,537 a partition at most) within a
    partition, so a partition with all rows is spread over many tasks. Order by probabilities fills 4,096 cells; numbers
    beyond -8 to 8 share the outermost ones.
    """
    cell = F.coalesce(F.floor(F.least(F.greatest(F.col(order) * 4096, F.lit(-32768.0)), F.lit(32767.0))).cast("int"), F.lit(-32769))
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    celled = df.withColumn("__cell", cell)
    totals = celled.groupBy(*by, "__cell").agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    earlier = Window.partitionBy(*by).orderBy(way("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = totals.select(*by, "__cell", *[F.coalesce(F.sum(f"__{x}").over(earlier), F.lit(0)).alias(f"__before_{x}") for x in sums], *[F.sum(f"__{x}").over(Window.partitionBy(*by)).alias(f"all_{x}") for x in sums])
    within = Window.partitionBy(*by, "__cell").orderBy(way(order), *([then] if then else [])).rowsBetween(Window.unboundedPreceding, 0)
    inside = celled.withColumns({f"run_{x}": F.sum(x).over(within) for x in sums})
    made = inside.join(cells, [*by, "__cell"]).withColumns({f"run_{x}": F.col(f"run_{x}") + F.col(f"__before_{x}") for x in sums})
    return made.drop("__cell", *[f"__before_{x}" for x in sums])


def score_steps(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Rows and positives at each distinct score and above it, per partition: (by..., score, tp, n, pos, rows).

    Scores are first reduced to one row each, so the running sums pass over distinct scores only.
    """
    per = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).alias("p1"), F.count("*").alias("n1"))
    made = running_sums(per, "score", ["p1", "n1"], by)
    return made.select(*by, "score", "p1", "n1", F.col("run_p1").alias("tp"), F.col("run_n1").alias("n"), F.col("all_p1").alias("pos"), F.col("all_n1").alias("rows"))


def _candidates(df: DataFrame, score: str, by: list[str], grid: list[float]) -> DataFrame:
    own = df.select(*by, F.col(score).alias("t"))
    spread = df.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("t"))
    return own.unionByName(spread).distinct()


def sweep(df: DataFrame, label: str, score: str, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., t, tp, n, pos, rows): at every candidate threshold t, the rows with score >= t and the positives among them.

    Candidates are the grid and the scores themselves. They and the scores meet in one ordered window:
    n log n, where comparing every candidate with every row would be quadratic.
    """
    by = by or []
    marks = _candidates(df, score, by, grid).select(*by, "t", F.lit(0).alias("p1"), F.lit(0).alias("n1"), F.lit(1).alias("mark"))
    rows = df.groupBy(*by, F.col(score).alias("t")).agg(F.sum(F.col(label).cast("int")).alias("p1"), F.count("*").alias("n1")).withColumn("mark", F.lit(0))
    merged = marks.unionByName(rows).groupBy(*by, "t").agg(F.sum("p1").alias("p1"), F.sum("n1").alias("n1"), F.max("mark").alias("mark"))
    made = running_sums(merged, "t", ["p1", "n1"], by).where("mark = 1")
    return made.select(*by, "t", F.col("run_p1").alias("tp"), F.col("run_n1").alias("n"), F.col("all_p1").alias("pos"), F.col("all_n1").alias("rows"))


POSITIVE_GRID = [0.01 + 0.98 * k / 196 for k in range(197)]
MACRO_GRID = [0.01, *[0.05 + 0.9 * k / 180 for k in range(181)], 0.99]


def _best(swept: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """The threshold of highest value; ties go to the one nearest 0.5, then to the smaller. A grouped maximum, which every task reduces first."""
    key = F.struct(F.round(value, 12).alias("f1"), (-F.round(F.abs(F.col("t") - 0.5), 12)).alias("near"), (-F.col("t")).alias("low"))
    best = swept.groupBy(*by).agg(F.max(F.struct(key.alias("key"), F.col("t"))).alias("b")).where("b is not null")
    return best.select(*by, F.col("b.t").alias("threshold"), F.col("b.key.f1").alias("f1"))


def positive_threshold(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, grid: list[float] | None = None) -> DataFrame:
    """(by..., threshold, f1): best positive-class F1; ties go to the threshold nearest 0.5, then to the smaller."""
    by = by or []
    s = sweep(df, label, score, POSITIVE_GRID if grid is None else grid, by)
    return _best(s, _f1(F.col("tp"), F.col("n") - F.col("tp"), F.col("pos") - F.col("tp")), by)


def grid_threshold(df: DataFrame, grid: list[float], label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, f1): best positive F1 among the grid's points alone; of equals the first in the grid's order."""
    by = by or []
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(g)).alias("t")) for k, g in enumerate(grid)])
    hits = df.select(*by, F.col(label).alias("y"), F.col(score).alias("s"), F.explode(points).alias("g")).select(*by, "y", "g.*", (F.col("s") >= F.col("g.t")).cast("int").alias("p"))
    per = hits.groupBy(*by, "k", "t").agg(*confusion_counts(F.col("y"), F.col("p")))
    f1 = F.round(_f1(F.col("tp"), F.col("fp"), F.col("fn")), 12)
    best = per.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("first"), F.col("t"))).alias("b")).where("b is not null")
    return best.select(*by, F.col("b.t").alias("threshold"), F.col("b.f1").alias("f1"))


def macro_f1_at(tp: Column, n: Column, pos: Column, rows: Column) -> Column:
    fp, fn = n - tp, pos - tp
    tn = rows - n - fn
    return (_f1(tp, fp, fn) + _f1(tn, fn, fp)) / 2


def macro_threshold(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, f1): best macro F1 over both classes; partitions with one class get 0.5 and their positive F1 there."""
    by = by or []
    s = sweep(df, label, score, [*MACRO_GRID, 0.5], by)
    both = _best(s.where("pos > 0 and pos < rows"), macro_f1_at(F.col("tp"), F.col("n"), F.col("pos"), F.col("rows")), by)
    single = s.where("(pos = 0 or pos = rows) and t = 0.5").select(*by, F.col("t").alias("threshold"), _f1(F.col("tp"), F.col("n") - F.col("tp"), F.col("pos") - F.col("tp")).alias("f1"))
    return both.unionByName(single)


def curve_threshold(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, f1): best F1 over the scores themselves; ties go to the smaller, as along a precision-recall curve."""
    by = by or []
    s = score_steps(df, label, score, by).withColumn("f1", F.round(_f1(F.col("tp"), F.col("n") - F.col("tp"), F.col("pos") - F.col("tp")), 12))
    best = s.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("low"), "score")).alias("b")).where("b is not null")
    return best.select(*by, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores of the recall gained there times the precision there."""
    by = by or []
    s = score_steps(df, label, score, by)
    return s.groupBy(*by).agg(F.coalesce(F.sum(F.col("p1") / F.col("pos") * F.col("tp") / F.col("n")), F.lit(0.0)).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Rank-sum form: pairs won by the positive, half a pair for a tie; null with one class only."""
    by = by or []
    s = score_steps(df, label, score, by)
    negative = F.col("rows") - F.col("pos")
    below = negative - (F.col("n") - F.col("tp"))
    won = F.sum(F.col("p1") * (below + 0.5 * (F.col("n1") - F.col("p1"))))
    pairs = F.max(F.col("pos") * negative)
    return s.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("roc_auc"))


def fold_report(df: DataFrame, fold: str, category: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts, precision, recall and F1 for each fold and category, each fold, and in total (nulls stand for all)."""
    sums = df.rollup(fold, category).agg(*confusion_counts(F.col(label), F.col(prediction)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _f1(tp, fp, fn)})


def rule_statistics(df: DataFrame, rules: DataFrame, text: str, label: str, fold: str, base: str) -> DataFrame:
    """Per rule: matches, positives, precision, recall, new matches beyond the base prediction, and the mean, deviation and minimum of its precision over folds.

    rules (rule, pattern) is a short list; it is broadcast and its patterns are matched row by row.
    """
    total = df.agg(F.sum(label).alias("all_pos"))
    hits = df.join(F.broadcast(rules), F.expr(f"rlike({text}, pattern)"))
    per = hits.groupBy("rule").agg(F.count("*").alias("matches"), F.sum(label).alias("positives"), F.count_if(F.col(base) == 0).alias("new_matches"), F.sum(F.when(F.col(base) == 0, F.col(label)).otherwise(0)).alias("new_positives"))
    folds = hits.groupBy("rule", fold).agg(F.avg(label).alias("p")).groupBy("rule").agg(F.avg("p").alias("fold_mean"), F.stddev_pop("p").alias("fold_std"), F.min("p").alias("fold_min"))
    joined = rules.select("rule").join(per, "rule", "left").join(folds, "rule", "left").crossJoin(total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("rule", *[zero(c).alias(c) for c in ("matches", "positives", "new_matches", "new_positives")], _ratio(zero("positives"), zero("matches")).alias("precision"), _ratio(zero("positives"), F.col("all_pos")).alias("recall"), "fold_mean", "fold_std", "fold_min")


def keyword_prevalence(df: DataFrame, flags: dict[str, Column], label: str) -> DataFrame:
    """(keyword, positive, negative, difference): share of rows with each keyword among either label."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), c.cast("double").alias("hit")) for k, c in flags.items()])).alias("f")).select("y", "f.*")
    per = long.groupBy("keyword").agg(F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("hit"))), F.lit(0.0)).alias("positive"), F.coalesce(F.avg(F.when(F.col("y") == 0, F.col("hit"))), F.lit(0.0)).alias("negative"))
    return per.withColumn("difference", F.col("positive") - F.col("negative"))


def error_families(df: DataFrame, text: Column, families: tuple = ERROR_FAMILIES, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(family, misses, share, f1_if_fixed): false negatives by the first family whose word occurs, and F1 if that family were right."""
    family = F.lit("other")
    for name, words in reversed(families):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        family = F.when(hit, name).otherwise(family)
    named = df.withColumn("family", family)
    counts = named.agg(*confusion_counts(F.col(label), F.col(prediction)))
    misses = named.where((F.col(label) == 1) & (F.col(prediction) == 0)).groupBy("family").agg(F.count("*").alias("misses"))
    tp, fp, fn, m = (F.col(c) for c in ("tp", "fp", "fn", "misses"))
    return misses.crossJoin(counts).select("family", "misses", (m / fn).alias("share"), _f1(tp + m, fp, fn - m).alias("f1_if_fixed"))


def misses_outside(df: DataFrame, text: Column, words: tuple[str, ...], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The false negatives in whose text none of the words occurs."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return df.where((F.col(label) == 1) & (F.col(prediction) == 0) & ~F.coalesce(hit, F.lit(False)))
