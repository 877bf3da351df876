"""Target-distribution importance resampling (operator 13): position-table n-grams.

Words are exploded with their positions; within a document lead() puts the following words beside each, so a row yields one
feature for each order. Features are hashed into buckets, which are counted over all documents and over all texts of the target;
the logarithm of their ratio is a bucket's gain. Gains join the features again and add up to a document's weight, to
which a Gumbel number of its id is added: the highest sums are a sample without replacement in proportion to exp(weight).

Everything is built of Spark's own functions. Buckets are few by the parameter, so their gains are broadcast and
no word is ever shuffled for them: rows of one document lie side by side in their task and are added up there. Only orders over 1
need a document's rows in one window, and then whole documents are dealt out before their words are exploded. Ranks are counted
in parts of the scores' range, so no task sorts more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.checksums import CRC_TABLE, crc32_sql
from curatrix.llm.common import settled

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that stands between words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _GAPS), lambda w: w != "")


def features_of(texts: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(row, words, bucket): a row for each run of 1 to `orders` consecutive words of each (row, text); a text without words has one with a null bucket.

    words is the number of the text's words.
    """
    dealt = texts if orders == 1 else texts.repartition("row")
    placed = dealt.select("row", words_of(F.col("text")).alias("all")).select("row", F.size("all").cast("long").alias("words"), F.posexplode_outer("all").alias("at", "w"))
    if orders == 1:
        grams = placed.select("row", "words", F.col("w").alias("gram"))
    else:
        following = Window.partitionBy("row").orderBy("at")
        runs = [F.col("w")]
        for k in range(1, orders):
            runs.append(F.concat(runs[-1], F.lit(" "), F.lead("w", k).over(following)))  # null past the text's end
        grams = placed.select("row", "words", F.array(*runs).alias("runs")).select("row", "words", F.explode_outer(F.filter("runs", lambda g: g.isNotNull())).alias("gram"))
    return grams.select("row", "words", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(features: DataFrame, out: str) -> DataFrame:
    return features.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(out))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket that the source or the target holds, from their features' counts."""
    counts = source.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return counts.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 that the key and the seed give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, n: int, draws: int, score: str, tie: str, part_rows: int = 100_000) -> DataFrame:
    """The n rows with rank: 1, 2, 3 and so on by falling score and rising tie, null past `draws`.

    Rows are sorted in parts of the order's range, as many as their number asks for, with the row's position behind the tie, so that equal
    rows spread over parts too; only the parts' counts meet, and are broadcast.
    """
    parts = max(1, n // part_rows)
    order = [F.desc("score_"), F.col("tie_").asc_nulls_first(), F.col("at_")]
    placed = rows.withColumns({"score_": F.col(score), "tie_": F.col(tie), "at_": F.monotonically_increasing_id()})
    own = settled(placed.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()))
    sizes = own.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # a row a part
    rank = F.col("before_") + F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    made = own.join(F.broadcast(before), "part_").withColumn("rank", rank.cast("long"))
    return made.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).drop("score_", "tie_", "at_", "part_", "before_")


def importance_resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    orders: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is null where the row isn't drawn.

    Features are all runs of 1 to `orders` consecutive words, repeats counted. weight is the floored mean of their buckets'
    gains (none: 0), score the weight plus the Gumbel number of the doc_id. Of the N rows with at least least_words words
    floor(percent * N / 100) are drawn, by falling score, then smaller doc_id (null first).

    Null texts count as empty, null ids as the empty string. Rows that repeat are rows of their own; those with one id share their
    Gumbel number. Empty tables are allowed: without target words gains only fall with a bucket's count. Texts of any length
    are read whole; further columns are left out.
    """
    if buckets < 1 or orders < 1:
        raise ValueError("orders and buckets must be 1 or more")
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    goal = target.select(F.col(target_text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    gains = settled(bucket_gains(bucket_counts(features_of(own, orders, buckets), "s"), bucket_counts(features_of(goal, orders, buckets), "t"), buckets))
    found = features_of(own.select(F.struct("row", "id").alias("row"), "text"), orders, buckets).join(F.broadcast(gains), "bucket", "left")
    per = found.groupBy("row").agg(F.max("words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = per.select(F.col("row.id").alias("doc_id"), "n_words", "n_features", mean.alias("weight"))
    scored = settled(scored.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")))
    enough = scored.where(F.col("n_words") >= least_words)
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    n = enough.count()
    made = ranked(enough, n, n * percent // 100, "score", "doc_id").unionByName(few)
    return made.select("doc_id", "n_features", "weight", "score", "rank")


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
own AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, {_SQL_WORDS} AS words FROM documents),
goal AS MATERIALIZED (SELECT {_SQL_WORDS} AS words FROM benchmark),
source_words AS MATERIALIZED (SELECT row, unnest(words) AS w FROM own),
target_words AS MATERIALIZED (SELECT unnest(words) AS w FROM goal),
known AS (SELECT w FROM source_words UNION SELECT w FROM target_words),
hashed AS MATERIALIZED (SELECT w, {crc32_sql("w")} % 10000 AS bucket FROM known, crc_table),
s AS (SELECT bucket, count(*) AS s FROM source_words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (w) GROUP BY bucket),
counts AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS all_s, coalesce(sum(t), 0)::BIGINT AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT row, sum(gain)::BIGINT AS total FROM source_words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features,
    CASE WHEN len(words) > 0 THEN ((total - ((total % len(words)) + len(words)) % len(words)) // len(words))::BIGINT ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM own LEFT JOIN weighed USING (row)),
summed AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS rank FROM summed)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM summed WHERE n_features >= 20) * 10 // 100 THEN rank END AS rank FROM ranked
"""
