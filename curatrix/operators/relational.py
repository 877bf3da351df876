"""Checked joins, validators, set overlaps, sampling and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.session import settled


class Violation(ValueError):
    """A precondition on the data doesn't hold."""


def aligned_join(left: DataFrame, right: DataFrame, key: str, value: str, fill=None) -> DataFrame:
    """left with right's value by key, one to one. Duplicate keys on either side fail the query, and so do missing values unless fill is given."""
    side = right.groupBy(key).agg(F.count("*").alias("__n"), F.first(value).alias("__v"))
    joined = left.withColumn("__m", F.count("*").over(Window.partitionBy(key))).join(side, key, "left")
    found = F.col("__v") if fill is None else F.coalesce(F.col("__v"), F.lit(fill))
    stop = F.when((F.col("__m") > 1) | (F.col("__n") > 1), F.raise_error(F.lit(f"{key} is not unique")).cast("double"))
    lacking = F.raise_error(F.lit(f"{value} is missing")).cast("double")
    return joined.withColumn(value, F.coalesce(stop, found.cast("double"), lacking)).drop("__n", "__m", "__v")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """Dictionary look-up: table has one value a key; absent keys take the default, or fail the query without one. A null value counts as absent."""
    joined = df.join(table.select(key, F.col(value).alias("__v")), key, "left")
    lacking = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(table.schema[value].dataType)
    return joined.withColumn(value, F.coalesce(F.col("__v"), F.lit(default) if default is not None else lacking)).drop("__v")


def unknown_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct values of a column that aren't among the first column of known."""
    return df.select(F.col(column).alias("value")).distinct().join(known.select(F.col(known.columns[0]).alias("value")), "value", "left_anti")


def require_none(df: DataFrame, what: str) -> None:
    found = df.limit(5).collect()
    if found:
        raise Violation(f"{what}: {[r.asDict() for r in found]}")


def overlap_counts(a: DataFrame, b: DataFrame, keys: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(check, overlap): distinct non-empty values that both sides have, for each named key."""
    parts = []
    for name, key in keys.items():
        ka, kb = key if isinstance(key, tuple) else (key, key)
        left, right = (df.select(k.cast("string").alias("v")).where("v is not null and v <> ''").distinct() for df, k in ((a, ka), (b, kb)))
        parts.append(left.join(right, "v", "left_semi").agg(F.lit(name).alias("check"), F.count("*").alias("overlap")))
    return reduce(DataFrame.unionByName, parts)


def leakage_verdict(counts: DataFrame) -> DataFrame:
    """BLOCKED if any check overlaps, else READY."""
    return counts.agg(F.when(F.max("overlap") > 0, "BLOCKED").otherwise("READY").alias("status"), F.sum("overlap").alias("overlaps"))


def coverage(df: DataFrame, key: str, mask: Column | None = None) -> DataFrame:
    """Whether every processed key was predicted exactly once: (keys, least, most, complete)."""
    rows = df.where(mask) if mask is not None else df
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most"), F.coalesce((F.min("n") == 1) & (F.max("n") == 1), F.lit(True)).alias("complete"))


def validate_submission(df: DataFrame, expected: DataFrame, pattern: str) -> DataFrame:
    """Counts of violations of an (pos, id, result) table against (pos, id): duplicates, nulls, format, ids out of place."""
    own = df.agg((F.count("*") - F.count_distinct("id")).alias("duplicate_or_null_ids"), F.count_if(~F.coalesce(F.col("result").rlike(pattern), F.lit(False))).alias("bad_format"))
    placed = df.select("pos", F.col("id").cast("string").alias("a")).join(expected.select("pos", F.col("id").cast("string").alias("b")), "pos", "full_outer")
    return own.crossJoin(placed.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("out_of_place")))


def consistent_groups(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups whose labels are all equal."""
    clean = df.groupBy(group).agg(F.count_distinct(label).alias("k")).where("k = 1").select(group)
    return df.join(clean, group, "left_semi")


def stratified_sample(df: DataFrame, stratum: str, sizes: dict, order: list[Column], default: int = 0) -> DataFrame:
    """The first sizes[value] rows of each stratum in the given order (None: all of them).

    Whole strata are not ranked; of the others every task first keeps as many rows as the largest size.
    """
    whole = [v for v, n in sizes.items() if n is None]
    limit = F.lit(default)
    for value, n in sizes.items():
        if n is not None:
            limit = F.when(F.col(stratum) == value, F.lit(n)).otherwise(limit)
    is_whole = F.coalesce(F.col(stratum).isin(whole), F.lit(False)) if whole else F.lit(False)
    most = max([default, *(n for n in sizes.values() if n is not None)])
    ranked = df.where(~is_whole).withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__k") <= most)
    return ranked.where(F.col("__k") <= limit).drop("__k").unionByName(df.where(is_whole))


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """n rows dealt from the strata in turn: their first rows by stratum, then their second ones, and so on. Tasks first keep n rows a stratum."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def weighted_draws(groups: DataFrame, draws: int, weight: str = "weight", key: str = "group", seed: int = 42) -> DataFrame:
    """(draw, group): groups drawn with replacement in proportion to their weight, by inverse distribution.

    Each group owns a stretch of the range from 0 to 1, in the order of the keys, and each draw a number in it. Groups are
    sorted in parts of the key's range, whose sums are the only thing that meets; stretches and numbers meet by
    1,024 cells of the range, so nothing is broadcast but the parts' sums.
    """
    own = settled(groups.select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    sums = own.groupBy("part").agg(F.sum("w").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("t"))  # a row a partition
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranges = own.withColumn("c", upto).join(F.broadcast(before), "part").select(F.col("key").alias(key), ((F.col("before") + F.col("c") - F.col("w")) / F.col("t")).alias("low"), ((F.col("before") + F.col("c")) / F.col("t")).alias("high"))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * 1024), F.floor(F.col("high") * 1024))))
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    numbers = groups.sparkSession.range(draws).select(F.col("id").alias("draw"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * 1024))
    return numbers.join(ranges, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("draw", key)


def balanced_draws(df: DataFrame, draws: int, group: str, positive: Column, hardness: Column, row_id: str, seed: int = 42) -> DataFrame:
    """(draw, positive, group, row_id): every other draw from the positive rows' groups, the rest from the others', a group in proportion
    to its mean hardness within its class, and one of the group's rows of that class by hash."""
    made = None
    for k, y in enumerate((True, False)):
        own = df.where(positive == F.lit(y))
        groups = own.groupBy(F.col(group).alias("group")).agg(F.greatest(F.lit(0.02), F.avg(hardness)).alias("weight"), F.count("*").alias("__n"))
        drawn = weighted_draws(groups, (draws + 1 - k) // 2, seed=seed + k).join(groups.select("group", "__n"), "group").withColumn("draw", 2 * F.col("draw") + k)
        share = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"row {seed}"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
        pick = F.floor(share * F.col("__n")).cast("long") + 1
        ranked = own.select(F.col(group).alias("group"), F.col(row_id), F.row_number().over(Window.partitionBy(group).orderBy(row_id)).cast("long").alias("__k"))
        one = drawn.withColumn("__k", pick).join(ranked, ["group", "__k"]).select("draw", F.lit(y).alias("positive"), "group", row_id)
        made = one if made is None else made.unionByName(one)
    return made


def available_in_all(key: str, *signals: DataFrame) -> DataFrame:
    """Distinct keys that every signal has."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [signals[0].select(key).where(F.col(key).isNotNull()).distinct(), *[s.select(key) for s in signals[1:]]])


def sampling_weights(df: DataFrame, group: str, hardness: Column, floor: float = 0.02) -> DataFrame:
    """(group, weight): each group's mean hardness, at least floor, as a share of the sum."""
    per = df.groupBy(group).agg(F.greatest(F.lit(floor), F.avg(hardness)).alias("h"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("h").alias("__t")))).select(group, (F.col("h") / F.col("__t")).alias("weight"))


def oversample(df: DataFrame, positive: Column, times: int, key: str, seed: int = 42) -> DataFrame:
    """Positive rows times over, the others once, in an order that a hash of key and copy gives."""
    copies = F.sequence(F.lit(1), F.when(positive, times).otherwise(1))
    return df.withColumn("copy", F.explode(copies)).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"), F.col("copy").cast("string"))))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def error_tag(label: Column, prediction: Column) -> Column:
    return F.when((label == 1) & (prediction == 0), "FN").when((label == 0) & (prediction == 1), "FP").otherwise("")
