"""Leakage-safe holdouts and folds over complete groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.metrics import running_sums
from curatrix.operators.relational import Violation
from curatrix.operators.selection import numbered
from curatrix.session import settled

#: Cells of the hash's range in which a candidate split's cut is looked for.
CELLS = 4096


def hash_share(*parts: Column) -> Column:
    """A number from 0 to 1 from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(16**8)


def hash_fold(group: Column, folds: int, seed: int = 42) -> Column:
    """Fold from 0 of a group, by hash: no statistics, any size."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), group.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def require_groups(df: DataFrame, group: str, least: int = 2) -> None:
    """Every row needs a group, and there must be at least `least` of them: a split of single rows would leak."""
    row = df.agg(F.count_if(F.coalesce(F.col(group).cast("string"), F.lit("")) == "").alias("blank"), F.count_distinct(group).alias("k")).first()
    if row["blank"]:
        raise Violation(f"{row['blank']} rows have no {group}; random splits are refused")
    if row["k"] < least:
        raise Violation(f"needs at least {least} groups, has {row['k']}")


def holdout_search(df: DataFrame, group: str, stratum: str, valid_size: float = 0.2, seed: int = 42, candidates: int = 64, relative: bool = False) -> DataFrame:
    """(seed, objective, valid_rows, valid_groups) of every candidate split.

    Under each seed the groups stand in the order of a hash, and the first ceil(valid_size * groups) are
    held out. The objective is the mean error of the strata's rates (relative to the rate, at least 1e-4, if asked) plus
    the error of the held-out share. Groups are reduced to their counts once; a group's place under each seed is only
    ever counted, in the task that holds the group: what is shuffled is cells and strata of each seed.
    """
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("n"))
    totals = settled(counts.groupBy(stratum).agg(F.sum("n").alias("all_n")))
    groups = settled(counts.groupBy(group).agg(F.collect_list(F.struct(F.col(stratum).alias("s"), "n")).alias("parts")))
    rows = totals.agg(F.sum("all_n")).first()[0] or 0
    held_groups = math.ceil(valid_size * groups.count())
    placed = groups.withColumn("seed", F.explode(F.sequence(F.lit(seed).cast("long"), F.lit(seed + candidates - 1).cast("long")))).withColumn("share", hash_share(F.col("seed"), F.col(group)))
    placed = placed.withColumn("cell", F.floor(F.col("share") * CELLS))
    # The cell of the share in which each seed's cut lies, from counts that every task adds up; then the cut itself, among that cell's groups.
    full = placed.groupBy("seed", "cell").agg(F.count("*").alias("n")).withColumn("run", F.sum("n").over(Window.partitionBy("seed").orderBy("cell")))
    full = full.where((F.col("run") >= held_groups) & (F.col("run") - F.col("n") < held_groups)).select("seed", "cell", (held_groups - F.col("run") + F.col("n")).alias("place"))
    inside = placed.join(F.broadcast(settled(full)), ["seed", "cell"]).withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("share", group)))
    cuts = settled(inside.where(F.col("k") == F.col("place")).select("seed", F.struct("share", group).alias("cut")))  # a row a seed
    held = placed.join(F.broadcast(cuts), "seed").where(F.struct("share", group) <= F.col("cut"))
    per = settled(held.select("seed", F.explode("parts").alias("p")).groupBy("seed", F.col("p.s").alias(stratum)).agg(F.sum("p.n").alias("n")))
    sizes = per.groupBy("seed").agg(F.sum("n").alias("valid_rows")).withColumns({"valid_groups": F.lit(held_groups).cast("long"), "rows": F.lit(rows)})
    grid = sizes.crossJoin(F.broadcast(totals)).join(per, ["seed", stratum], "left")
    rate, valid_rate = F.col("all_n") / F.col("rows"), F.coalesce("n", F.lit(0)) / F.col("valid_rows")
    error = F.abs(valid_rate - rate) / (F.greatest(rate, F.lit(1e-4)) if relative else F.lit(1.0))
    scored = grid.groupBy("seed", "valid_rows", "valid_groups", "rows").agg(F.avg(error).alias("e"))
    return scored.select("seed", (F.col("e") + F.abs(F.col("valid_rows") / F.col("rows") - valid_size)).alias("objective"), "valid_rows", "valid_groups")


def best_seed(search: DataFrame) -> int:
    return search.orderBy(F.round("objective", 12), "seed").first()["seed"]


def holdout(df: DataFrame, group: str, stratum: str, valid_size: float = 0.2, seed: int = 42, candidates: int = 64, relative: bool = False) -> DataFrame:
    """df with split = 'train' or 'valid' under the best candidate; groups never straddle."""
    require_groups(df, group)
    chosen = best_seed(holdout_search(df, group, stratum, valid_size, seed, candidates, relative))
    groups = df.select(group).distinct().withColumn("share", hash_share(F.lit(chosen), F.col(group)))
    # Their rank in the order of the hash and their number are running sums of ones.
    marked = running_sums(groups.withColumn("one", F.lit(1)), "share", ["one"], [], descending=False, then=group)
    marked = marked.withColumn("k", F.col("run_one")).withColumn("take", F.ceil(F.col("all_one") * F.lit(valid_size)))
    return df.join(marked.select(group, F.when(F.col("k") <= F.col("take"), "valid").otherwise("train").alias("split")), group)


def greedy_folds(df: DataFrame, group: str, labels: list[Column], folds: int, seed: int = 42) -> DataFrame:
    """(group, fold): folds of nearly equal label counts, filled greedily by rare labels and large groups first.

    Groups of equal size and label counts are one class, and only the classes with their multiplicities go to the driver, which fills the
    folds in runs of equal groups; members of a class are dealt to its folds by their number in the order of a hash. The
    first groups open a fold each.
    """
    require_groups(df, group, folds)
    kinds = ["__size", *(f"__y{k}" for k in range(len(labels)))]
    stats = df.groupBy(group).agg(F.count("*").alias("__size"), *[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(f"__y{k}") for k, c in enumerate(labels)])
    stats = settled(stats.withColumn("__jitter", hash_share(F.lit(seed), F.col(group))))
    classes = [((r[0], *r[1:-1]), r[-1]) for r in stats.groupBy(*kinds).agg(F.count("*").alias("__times")).collect()]
    shares = [(*kind, low, low + n, fold) for kind, dealt in fill_folds(classes, folds) for fold, low, n in dealt]
    fields = ", ".join(["__size long", *(f"{k} double" for k in kinds[1:]), "__low long", "__high long", "fold int"])
    shares = df.sparkSession.createDataFrame(shares, fields)
    own = numbered(stats, kinds, "__jitter", group, out="__number")
    met = own.join(shares, kinds).where((F.col("__number") > F.col("__low")) & (F.col("__number") <= F.col("__high")))
    return met.select(group, "fold")


def fill_folds(classes: list[tuple[tuple, int]], folds: int) -> list[tuple[tuple, list[tuple[int, int, int]]]]:
    """For each class ((size, label counts...), times): how many of its groups go to which fold, as (fold, groups before, groups).

    Groups go one after another to the fold of least cost, and a run of equal groups to one fold is made in one step: its cost is a
    convex function of the run's length, so it stays the least up to a length that bisection finds.
    """
    width = len(classes[0][0]) - 1
    total = [sum(kind[1 + k] * n for kind, n in classes) for k in range(width)]
    goal = [t / folds for t in total]
    rows_goal = sum(kind[0] * n for kind, n in classes) / folds
    have, size = [[0.0] * width for _ in range(folds)], [0.0] * folds
    order = sorted(classes, key=lambda c: (-sum(y / max(t, 1) for y, t in zip(c[0][1:], total, strict=True)), -c[0][0], c[0]))
    opened, made = 0, []
    for kind, times in order:
        rows, counts = kind[0], kind[1:]

        def cost(f: int, ahead: int = 0, rows=rows, counts=counts) -> tuple:
            errors = [((have[f][k] + c * (ahead + 1) - goal[k]) / max(goal[k], 1)) ** 2 for k, c in enumerate(counts)]
            return sum(errors) / max(1, len(errors)) + 0.25 * ((size[f] + rows * (ahead + 1) - rows_goal) / max(rows_goal, 1)) ** 2, f

        dealt, left = [0] * folds, times
        while left:
            if opened < folds:
                fold, run = opened, 1
                opened += 1
            else:
                costs = sorted(cost(f) for f in range(folds))
                fold, run = costs[0][1], left
                if folds > 1 and cost(fold, left - 1) >= costs[1]:
                    run, beyond = 1, left  # the fold wins `run` times in a row, but not `beyond` times
                    while beyond - run > 1:
                        middle = (run + beyond) // 2
                        run, beyond = (middle, beyond) if cost(fold, middle - 1) < costs[1] else (run, middle)
            size[fold] += rows * run
            for k, c in enumerate(counts):
                have[fold][k] += c * run
            dealt[fold] += run
            left -= run
        starts = [sum(dealt[:f]) for f in range(folds)]
        made.append((kind, [(f, starts[f], n) for f, n in enumerate(dealt) if n]))
    return made


def stratified_group_folds(df: DataFrame, group: str, stratum: str, folds: int, seed: int = 42) -> DataFrame:
    """(group, fold) with the strata's shares balanced: greedy_folds over the strata's indicators."""
    values = [r[0] for r in df.select(stratum).distinct().orderBy(stratum).collect()]
    return greedy_folds(df, group, [F.col(stratum) == v for v in values], folds, seed)


def shared_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; must be empty."""
    return a.select(group).distinct().join(b.select(group).distinct(), group, "left_semi")
