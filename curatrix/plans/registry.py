"""The registered queries of the library's own operators and their oracle SQL.

Roles of the tables: documents are cards (title: first line, category: lang, group: source), labels their
targets, embeddings the vector cache and reference bank, benchmark the other side of leakage checks,
pages HTML descriptions, conversations chat turns, part short titles, events.props JSON cells.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import arrays as A
from curatrix.functions import constants as K
from curatrix.functions import hashing as H
from curatrix.functions import maths as M
from curatrix.functions import prompts as P
from curatrix.functions import text as X
from curatrix.operators import estimators as E
from curatrix.operators import fusion as Fu
from curatrix.operators import grouping as G
from curatrix.operators import metrics as Me
from curatrix.operators import neartext as N
from curatrix.operators import relational as R
from curatrix.operators import reports as Re
from curatrix.operators import schema as S
from curatrix.operators import splits as Sp
from curatrix.operators import vectors as V
from curatrix.plans import scoring as Pl
from curatrix.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, category, grp, y, toxic, score, prediction, fold of labelled documents."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("grp"), "n_chars")
    made = docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), "toxic"), "doc_id")
    made = made.withColumn("score", F.least(F.lit(0.999), F.col("n_chars") / F.lit(4000.0)))
    return made.withColumn("prediction", (F.col("score") >= 0.3).cast("int")).withColumn("fold", Sp.hash_fold(F.col("grp"), 5))


LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang AS category, d.source AS grp, d.n_chars, l.quality AS y, l.toxic, least(0.999::DOUBLE, d.n_chars / 4000.0::DOUBLE) AS score,
    CAST(least(0.999::DOUBLE, d.n_chars / 4000.0::DOUBLE) >= 0.3::DOUBLE AS INT) AS prediction,
    CAST(('0x' || substr(md5('42/' || d.source), 1, 8))::BIGINT % 5 AS INT) AS fold
  FROM documents d JOIN labels l USING (doc_id))"""
F1 = "CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2.0::DOUBLE * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0::DOUBLE END"
COUNTS = "sum((y = 1 AND prediction = 1)::INT) AS tp, sum((y = 0 AND prediction = 1)::INT) AS fp, sum((y = 1 AND prediction = 0)::INT) AS fn, sum((y = 0 AND prediction = 0)::INT) AS tn"
_f = lambda tp="tp", fp="fp", fn="fn": F1.format(tp=tp, fp=fp, fn=fn)
POSITIVE = "SELECT 0.01::DOUBLE + 0.98::DOUBLE * k / 196 AS t FROM range(197) r(k)"
SWEEP = """
cand AS (SELECT DISTINCT t FROM ({grid} UNION ALL SELECT score FROM scored)),
swept AS (SELECT t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn, sum((y = 0 AND score < t)::INT) AS tn FROM cand, scored GROUP BY t)"""


# --- metrics and thresholds ---------------------------------------------------------------------------------------


@query(f"""WITH {LABELLED}, scored AS (SELECT * FROM labelled), {SWEEP.format(grid=POSITIVE)},
best AS (SELECT t FROM swept ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t LIMIT 1),
per AS (SELECT category, {_f()} AS f1 FROM (SELECT category, {COUNTS} FROM (SELECT category, y, (score >= t)::INT AS prediction FROM labelled, best) GROUP BY category))
SELECT category, round(f1, 6) AS f1 FROM per UNION ALL SELECT 'official_score', round(avg(f1), 6) FROM per""")
def category_f1(spark, d):
    rows = labelled(spark, d)
    cut = Me.positive_threshold(rows, "y", "score")
    decided = rows.crossJoin(F.broadcast(cut.select("threshold"))).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
    return Me.category_f1(decided, "y").select("category", r6("f1").alias("f1"))


@query(f"""WITH {LABELLED}, scored AS (SELECT * FROM labelled), {SWEEP.format(grid=POSITIVE)}
SELECT round(t, 6) AS threshold, round({_f()}, 6) AS f1 FROM swept ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t LIMIT 1""")
def threshold_positive_f1(spark, d):
    return Me.positive_threshold(labelled(spark, d), "y", "score").select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


MACRO = f"({_f()} + {_f('tn', 'fn', 'fp')}) / 2"
MACRO_CAND = "SELECT 0.01::DOUBLE AS t UNION ALL SELECT 0.05::DOUBLE + 0.9::DOUBLE * k / 180 FROM range(181) r(k) UNION ALL SELECT 0.99::DOUBLE UNION ALL SELECT 0.5::DOUBLE"


@query(f"""WITH {LABELLED}, scored AS (SELECT * FROM labelled), {SWEEP.format(grid=MACRO_CAND)}
SELECT round(t, 6) AS threshold, round({MACRO}, 6) AS f1 FROM swept ORDER BY round({MACRO}, 12) DESC, round(abs(t - 0.5), 12), t LIMIT 1""")
def threshold_macro_f1(spark, d):
    return Me.macro_threshold(labelled(spark, d), "y", "score").select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""WITH {LABELLED}, longer AS (SELECT 'quality' AS class, y, score FROM labelled UNION ALL SELECT 'toxic', toxic, score FROM labelled UNION ALL SELECT 'none', 0, score FROM labelled),
cand AS (SELECT DISTINCT class, t FROM (SELECT class, t FROM (SELECT DISTINCT class FROM longer), ({MACRO_CAND}) UNION ALL SELECT class, score FROM longer)),
swept AS (SELECT class, t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn, sum((y = 0 AND score < t)::INT) AS tn FROM cand JOIN longer USING (class) GROUP BY class, t),
ranked AS (SELECT class, t, {MACRO} AS f1, row_number() OVER (PARTITION BY class ORDER BY round({MACRO}, 12) DESC, round(abs(t - 0.5), 12), t) AS k FROM swept WHERE tp + fn > 0 AND fp + tn > 0)
SELECT class, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ranked WHERE k = 1
UNION ALL SELECT class, 0.5::DOUBLE, round({_f()}, 6) FROM swept WHERE (tp + fn = 0 OR fp + tn = 0) AND t = 0.5::DOUBLE""")
def threshold_per_class(spark, d):
    rows = labelled(spark, d).select("score", F.explode(F.array(F.struct(F.lit("quality").alias("class"), F.col("y").alias("v")), F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("v")), F.struct(F.lit("none").alias("class"), F.lit(0).alias("v")))).alias("c")).select("score", "c.class", F.col("c.v").alias("y"))
    return Me.macro_threshold(rows, "y", "score", ["class"]).select("class", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""WITH {LABELLED}, swept AS (SELECT a.category, a.score AS t, sum((b.y = 1 AND b.score >= a.score)::INT) AS tp, sum((b.y = 0 AND b.score >= a.score)::INT) AS fp, sum((b.y = 1 AND b.score < a.score)::INT) AS fn
  FROM (SELECT DISTINCT category, score FROM labelled) a JOIN labelled b ON a.category = b.category GROUP BY a.category, a.score),
ranked AS (SELECT category, t, {_f()} AS f1, row_number() OVER (PARTITION BY category ORDER BY round({_f()}, 12) DESC, t) AS k FROM swept)
SELECT category, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ranked WHERE k = 1""")
def threshold_curve_f1(spark, d):
    return Me.curve_threshold(labelled(spark, d), "y", "score", ["category"]).select("category", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""WITH {LABELLED}, steps AS (SELECT category, score, sum(y) AS p1, count(*) AS n1 FROM labelled GROUP BY category, score),
run AS (SELECT category, p1, sum(p1) OVER w AS tp, sum(n1) OVER w AS n, sum(p1) OVER (PARTITION BY category) AS pos FROM steps WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT category, round(sum(p1 / pos::DOUBLE * tp / n), 6) AS average_precision FROM run GROUP BY category""")
def average_precision(spark, d):
    return Me.average_precision(labelled(spark, d), "y", "score", ["category"]).select("category", r6("average_precision").alias("average_precision"))


@query(f"""WITH {LABELLED} SELECT a.category, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS roc_auc
FROM labelled a JOIN labelled b ON a.category = b.category AND a.y = 1 AND b.y = 0 GROUP BY a.category""")
def roc_auc(spark, d):
    return Me.roc_auc(labelled(spark, d), "y", "score", ["category"]).where("roc_auc is not null").select("category", r6("roc_auc").alias("roc_auc"))


@query(f"""WITH {LABELLED}, c AS (SELECT unnest([0, 1]) AS k), per AS (SELECT k, sum((y = k AND prediction = k)::INT) AS tp, sum((y <> k AND prediction = k)::INT) AS fp, sum((y = k AND prediction <> k)::INT) AS fn FROM labelled, c GROUP BY k)
SELECT round(avg({_f()}), 6) AS macro_f1, round(sum({_f()} * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1, round(sum(tp)::DOUBLE / sum(tp + fn), 6) AS accuracy, round(avg(tp::DOUBLE / (tp + fn)), 6) AS balanced_accuracy FROM per""")
def macro_weighted_metrics(spark, d):
    made = Me.classification_summary(labelled(spark, d), "y")
    return made.select(*[r6(c).alias(c) for c in made.columns])


def _long(rows: DataFrame) -> DataFrame:
    pred = (F.col("score") < 0.1).cast("int")
    return rows.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("class"), F.col("y").alias("y"), F.col("prediction").alias("p")), F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("y"), pred.alias("p")))).alias("c")).select("doc_id", "c.*")


@query(f"""WITH {LABELLED}, longer AS (SELECT doc_id, 'quality' AS class, y, prediction FROM labelled UNION ALL SELECT doc_id, 'toxic', toxic, (score < 0.1::DOUBLE)::INT FROM labelled),
per AS (SELECT class, {COUNTS} FROM longer GROUP BY class), e AS (SELECT avg(ok) AS subset_accuracy FROM (SELECT doc_id, min((y = prediction)::INT) AS ok FROM longer GROUP BY doc_id))
SELECT round(avg({_f()}), 6) AS macro_f1, round({_f('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) AS micro_f1, round(sum({_f()} * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1, (SELECT round(subset_accuracy, 6) FROM e) AS subset_accuracy FROM per""")
def multilabel_metrics(spark, d):
    made = Me.multilabel_summary(_long(labelled(spark, d)), "doc_id")
    return made.select(*[r6(c).alias(c) for c in made.columns])


@query(f"""WITH {LABELLED}, c AS (SELECT y AS k FROM labelled UNION SELECT prediction FROM labelled)
SELECT a.k AS actual, b.k AS predicted, (SELECT count(*) FROM labelled WHERE y = a.k AND prediction = b.k) AS n FROM c a, c b""")
def confusion_matrix(spark, d):
    return Me.confusion_matrix(labelled(spark, d), "y")


@query(f"""WITH {LABELLED}, c AS (SELECT y AS class FROM labelled UNION SELECT prediction FROM labelled),
per AS (SELECT class, sum((y = class AND prediction = class)::INT) AS tp, sum((y <> class AND prediction = class)::INT) AS fp, sum((y = class AND prediction <> class)::INT) AS fn FROM labelled, c GROUP BY class)
SELECT class, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round({_f()}, 6) AS f1, (tp + fn)::BIGINT AS support FROM per""")
def per_class_report(spark, d):
    return Me.per_class(labelled(spark, d), "y").select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@query(f"""WITH {LABELLED} SELECT fold, category, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision,
round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round({_f()}, 6) AS f1 FROM (SELECT fold, category, {COUNTS} FROM labelled GROUP BY ROLLUP (fold, category))""")
def fold_category_rollup(spark, d):
    made = Me.fold_report(labelled(spark, d), "fold", "category", "y")
    return made.select("fold", "category", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {LABELLED} SELECT fold, count(*) AS rows, sum((y = 1)::INT)::BIGINT AS pos, sum((y = 0)::INT)::BIGINT AS neg FROM labelled GROUP BY fold""")
def fold_distribution(spark, d):
    return Re.fold_distribution(labelled(spark, d), "fold", "y", "grp")[0]


@query(f"""WITH {LABELLED} SELECT doc_id, round(score, 6) AS score, y, CASE WHEN y = 1 THEN 'FN' ELSE 'FP' END AS error FROM labelled WHERE y <> prediction ORDER BY score DESC, doc_id LIMIT 100""")
def top_errors(spark, d):
    made = Re.diagnostics(labelled(spark, d), "doc_id", "y", "prediction", "score")["errors"]
    return made.select("doc_id", r6("score").alias("score"), "y", R.error_tag(F.col("y"), F.col("prediction")).alias("error"))


@query(f"""WITH {LABELLED} SELECT doc_id, round(abs(2 * score - 1), 6) AS uncertainty_margin FROM labelled ORDER BY abs(2 * score - 1), doc_id LIMIT 100""")
def most_uncertain(spark, d):
    rows = labelled(spark, d).withColumn("p", F.array(1 - F.col("score"), F.col("score")))
    rows = Re.difficulty(rows, "p").withColumn("uncertainty_margin", r6(F.abs(2 * F.col("score") - 1)))
    return rows.orderBy(F.abs(2 * F.col("score") - 1), "doc_id").limit(100).select("doc_id", "uncertainty_margin")


@query(f"""WITH {LABELLED} SELECT doc_id, round(least(abs(score - 0.5), abs(n_chars % 100 / 100.0::DOUBLE - 0.5)), 6) AS uncertainty_margin, ((score >= 0.5) <> (n_chars % 2 = 0)) AS conflict FROM labelled""")
def uncertainty_margin(spark, d):
    rows = labelled(spark, d).withColumn("p", F.array("score", F.col("n_chars") % 100 / F.lit(100.0)))
    made = Re.difficulty(rows, "p", single=False)
    return made.select("doc_id", r6("uncertainty_margin").alias("uncertainty_margin"), ((F.col("score") >= 0.5) != (F.col("n_chars") % 2 == 0)).alias("conflict"))


@query(f"""WITH {LABELLED} SELECT doc_id, CASE WHEN score >= 0.2 AND score < 0.3 AND n_chars % 2 = 0 THEN 1 ELSE prediction END AS prediction FROM labelled""")
def uncertainty_zone_boost(spark, d):
    return labelled(spark, d).withColumn("prediction", Re.uncertainty_boost("score", F.col("n_chars") % 2 == 0, 0.2, 0.3)).select("doc_id", "prediction")


RULES = [("short_word", r"\b(?:the|and)\b"), ("digit", r"[0-9]{3,}"), ("shout", r"[A-Z]{4,}"), ("nothing", r"qqqq")]


@query(f"""WITH {LABELLED}, t AS (SELECT l.*, d.text FROM labelled l JOIN documents d USING (doc_id)), rules(rule, pattern) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}),
hits AS (SELECT rule, fold, y, prediction FROM t JOIN rules ON regexp_matches(text, pattern)),
per AS (SELECT rule, count(*) AS matches, sum(y) AS positives, sum((prediction = 0)::INT) AS new_matches, sum(CASE WHEN prediction = 0 THEN y ELSE 0 END) AS new_positives FROM hits GROUP BY rule),
folds AS (SELECT rule, avg(p) AS m, stddev_pop(p) AS s, min(p) AS lo FROM (SELECT rule, fold, avg(y) AS p FROM hits GROUP BY rule, fold) GROUP BY rule)
SELECT rules.rule, coalesce(matches, 0)::BIGINT AS matches, coalesce(positives, 0)::BIGINT AS positives, coalesce(new_matches, 0)::BIGINT AS new_matches, coalesce(new_positives, 0)::BIGINT AS new_positives,
round(CASE WHEN matches > 0 THEN positives::DOUBLE / matches ELSE 0 END, 6) AS precision, round(coalesce(positives, 0)::DOUBLE / (SELECT sum(y) FROM labelled), 6) AS recall, round(m, 6) AS fold_mean, round(s, 6) AS fold_std, round(lo, 6) AS fold_min
FROM rules LEFT JOIN per USING (rule) LEFT JOIN folds USING (rule)""")
def rule_statistics(spark, d):
    rows = labelled(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = Me.rule_statistics(rows, spark.createDataFrame(RULES, "rule string, pattern string"), "text", "y", "fold", "prediction")
    return made.select("rule", *[F.col(c).cast("long").alias(c) for c in ("matches", "positives", "new_matches", "new_positives")], *[r6(c).alias(c) for c in ("precision", "recall", "fold_mean", "fold_std", "fold_min")])


@query(f"""WITH {LABELLED}, t AS (SELECT y, lower(text) AS x FROM labelled JOIN documents USING (doc_id)), h AS (SELECT y, k, (x LIKE '%' || k || '%')::INT AS hit FROM t, (SELECT unnest(['license', 'the ', '@']) AS k))
SELECT k AS keyword, round(coalesce(avg(CASE WHEN y = 1 THEN hit END), 0), 6) AS positive, round(coalesce(avg(CASE WHEN y = 0 THEN hit END), 0), 6) AS negative, round(coalesce(avg(CASE WHEN y = 1 THEN hit END), 0) - coalesce(avg(CASE WHEN y = 0 THEN hit END), 0), 6) AS difference FROM h GROUP BY k""")
def keyword_prevalence(spark, d):
    rows = labelled(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = Me.keyword_prevalence(rows, X.keyword_flags(F.col("text"), {"license": "license", "the ": "the ", "@": "@"}), "y")
    return made.select("keyword", *[r6(c).alias(c) for c in ("positive", "negative", "difference")])


FAMILIES = (("license", ("licens",)), ("table", ("|",)), ("shout", ("!!",)))


@query(f"""WITH {LABELLED}, t AS (SELECT y, prediction, lower(text) AS x FROM labelled JOIN documents USING (doc_id)),
n AS (SELECT *, CASE WHEN contains(x, 'licens') THEN 'license' WHEN contains(x, '|') THEN 'table' WHEN contains(x, '!!') THEN 'shout' ELSE 'other' END AS family FROM t), c AS (SELECT {COUNTS} FROM n),
m AS (SELECT family, count(*) AS misses FROM n WHERE y = 1 AND prediction = 0 GROUP BY family)
SELECT family, misses, round(misses::DOUBLE / fn, 6) AS share, round({_f('(tp + misses)', 'fp', '(fn - misses)')}, 6) AS f1_if_fixed FROM m, c""")
def error_family_whatif(spark, d):
    rows = labelled(spark, d).join(table(spark, d, "documents").select("doc_id", F.lower("text").alias("low")), "doc_id")
    made = Me.error_families(rows, F.col("low"), FAMILIES, "y")
    return made.select("family", "misses", r6("share").alias("share"), r6("f1_if_fixed").alias("f1_if_fixed"))


# --- text, schema, contracts ------------------------------------------------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS id, '[TITLE] ' || trim(p_name) || CASE WHEN trim(p_brand) <> '' THEN ' [BRAND] ' || trim(p_brand) ELSE '' END || ' [CATEGORY] ' || trim(p_type) AS text FROM part")
def adapt_compose_text(spark, d):
    schema = {"schema_version": 1, "columns": {"id": "p_partkey", "title": "p_name", "brand": "p_brand", "category": "p_type"}, "text_fields": ["title", "brand", "category"]}
    return S.adapt(table(spark, d, "part"), schema).select("id", "text")


@query()
def canonical_schema_infer(spark, d):
    """The roles of four tables' columns, out of profiles of all their columns and rows."""
    profiles = [S.column_profile(table(spark, d, t)).select(F.lit(t).alias("source"), "role", "column") for t in ("documents", "part", "labels", "embeddings")]
    return reduce(DataFrame.unionByName, profiles).where("role is not null")


@query("""WITH v(k, cell) AS (VALUES (0, '["a.jpg", "b.jpg"]'), (1, 'a.jpg|b.jpg'), (2, NULL), (3, ''), (4, ' x | | y '), (5, '[broken')),
p AS (SELECT k, CASE WHEN trim(coalesce(cell, '')) LIKE '[%' AND json_valid(trim(cell)) THEN json_extract_string(trim(cell), '$[*]') ELSE string_split(trim(coalesce(cell, '')), '|') END AS items FROM v)
SELECT (e.event_id * 10 + k)::BIGINT AS id, array_to_string([trim(x) for x in items if trim(x) <> ''], ';') AS items FROM p, events e""")
def list_parse(spark, d):
    cells = ['["a.jpg", "b.jpg"]', "a.jpg|b.jpg", None, "", " x | | y ", "[broken"]
    rows = table(spark, d, "events").select("event_id", F.posexplode(F.array(*[F.lit(c).cast("string") for c in cells])).alias("k", "cell"))
    return rows.select((F.col("event_id") * 10 + F.col("k")).cast("long").alias("id"), F.array_join(X.parse_list(F.col("cell")), ";").alias("items"))


@query("SELECT doc_id, array_to_string([x for x in [CASE WHEN quality <> 0 THEN 'quality' END, CASE WHEN toxic <> 0 THEN 'toxic' END] if x IS NOT NULL], ',') AS labels FROM labels")
def label_truthiness(spark, d):
    made = S.adapt(table(spark, d, "labels"), {"schema_version": 1, "columns": {"id": "doc_id", "title": "doc_id"}, "label_columns": ["quality", "toxic"], "text_fields": ["title"]})
    return made.select("doc_id", F.array_join("labels", ",").alias("labels"))


NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '<[^>]+>', ' ', 'g'), '[^a-zа-яё0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM.format(c='text')} AS key FROM documents")
def group_key_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", X.group_key(F.col("text")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || ' Ёлка №7'), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g')) AS key FROM part")
def title_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", X.title_key(F.concat("p_name", F.lit(" Ёлка №7"))).alias("key"))


@query("""SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') || CASE WHEN contains(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), 'ing ') THEN ' __RULE_GERUND__' ELSE '' END
|| CASE WHEN regexp_matches(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '(?:[0-9]{4})|(?:%%%)') THEN ' __RULE_DIGITS__' ELSE '' END AS text FROM pages""")
def html_strip_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", X.rule_tokens(F.col("html"), {"gerund": ("ing ",), "digits": ("[0-9]{4}", "%%%")}).alias("text"))


CARDS = [("БАД. Не является лекарством", K.SUPPLEMENT), ("Спортивное питание BCAA", K.SUPPLEMENT), ("Зажигалка без газа", K.FLAMMABLE), ("Мангал для дачи", K.FLAMMABLE), ("Уголь древесный 3 кг", K.FLAMMABLE), ("Чай зелёный", "other")]
TOKENS = [" __RULE_BAD_DIRECT__", " __RULE_SPORTS_FOOD__", " __RULE_IGNITION_SOURCE__ __RULE_WITHOUT_CONTENT__", " __RULE_CONSTRUCTION_ONLY__", "", ""]


@query("WITH v(k, text) AS (VALUES " + ", ".join(f"({k}, '{t}{TOKENS[k]}')" for k, (t, _) in enumerate(CARDS)) + ") SELECT p_partkey, v.text, CASE WHEN v.k = 4 THEN 1 END AS rule_label FROM part JOIN v ON p_partkey % 6 = k")
def rule_tokens_case(spark, d):
    pick = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in CARDS])[(F.col("p_partkey") % 6).cast("int")]
    return table(spark, d, "part").select("p_partkey", pick.alias("x")).select("p_partkey", X.category_rule_tokens(F.col("x.t"), F.col("x.c")).alias("text"), X.title_rule_label(X.title_key(F.col("x.t"))).alias("rule_label"))


@query(f"WITH k AS (SELECT doc_id, {NORM.format(c='text')} AS key FROM documents) SELECT doc_id, md5(CASE WHEN length(key) >= 800 THEN left(key, 800) END) AS head, md5(CASE WHEN length(key) >= 800 THEN right(key, 400) END) AS tail FROM k")
def head_tail_keys(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", X.group_key(F.col("text")).alias("k"))
    return keyed.select("doc_id", F.md5(X.head_key(F.col("k")).cast("binary")).alias("head"), F.md5(X.tail_key(F.col("k")).cast("binary")).alias("tail"))


@query(r"SELECT doc_id, round(ln(1 + length(trim(text))), 6) AS log_chars, round(ln(1 + CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END), 6) AS log_words FROM documents")
def text_counts_log(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(F.log1p(F.length(F.trim("text")))).alias("log_chars"), r6(F.log1p(X.word_count(F.col("text")))).alias("log_words"))


PAD = " Решение принято по названию, описанию и изображениям товара."


@query(rf"""WITH c AS (SELECT doc_id, coalesce(quality, 0) AS y, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT doc_id, y, CASE WHEN length(c) < 50 THEN trim(c || '{PAD}') ELSE c END AS c FROM c),
f AS (SELECT doc_id, y, CASE WHEN length(c) > 300 THEN rtrim(CASE WHEN contains(left(c, 300), ' ') THEN regexp_replace(left(c, 300), ' [^ ]*$', '') ELSE left(c, 300) END, ' ,;:-') ELSE c END AS c FROM p)
SELECT doc_id, CASE WHEN length(c) BETWEEN 50 AND 300 THEN '<комментарий>' || c || '<вердикт>' || CASE WHEN y = 1 THEN 'не бан' ELSE 'бан' END END AS result FROM f""")
def result_format(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", X.format_result(F.col("text"), F.coalesce("quality", F.lit(0))).alias("result"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS verdict,
CASE event_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 WHEN 4 THEN 0.5 ELSE 0.2 END::DOUBLE AS yes_probability FROM events""")
def answer_parsing(spark, d):
    said = F.array(*[F.lit(x) for x in ("Yes: 1", "no, 0", "maybe 10", "I say yes 1", "12 or 21", "well, no (0)")])[(F.col("event_id") % 6).cast("int")]
    return table(spark, d, "events").select("event_id", X.parse_verdict(said).alias("verdict"), X.yes_probability(said).alias("yes_probability"))


@query(r"""SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace('"<think>a' || chr(10) || 'b</think> ' || html || '"', '(?is)<think>.*?</think>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '^"+|"+$', '', 'g')) AS comment FROM pages""")
def comment_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_comment(F.concat(F.lit('"<think>a\nb</think> '), "html", F.lit('"'))).alias("comment"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS contradicts FROM part")
def contradiction_check(spark, d):
    cases = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(y).alias("y")) for t, y in (("соответствует положительному классу", 0), ("не соответствует категории", 1), ("не соответствует категории", 0), ("Соответствует категории", 1))])
    pick = cases[(F.col("p_partkey") % 4).cast("int")]
    return table(spark, d, "part").select("p_partkey", X.contradicts(pick["t"], pick["y"]).alias("contradicts"))


@query("SELECT doc_id, 'Category: ' || lang || chr(10) || 'Product name: ' || string_split(text, chr(10))[1] || chr(10) || 'Description: ' || left(text, 2500) AS prompt FROM documents")
def prompt_render(spark, d):
    return table(spark, d, "documents").select("doc_id", P.reference_text(F.col("lang"), F.substring_index("text", "\n", 1), F.col("text")).alias("prompt"))


@query("""SELECT doc_id, sha256('Инструкция: ' || c || chr(10) || 'Категория: ' || cat || chr(10) || 'Название: ' || source || chr(10) || 'Описание: ' || left(text, 5000)) AS digest
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'БАД' ELSE 'Легковоспламеняющиеся' END AS cat, CASE WHEN doc_id % 2 = 0 THEN '""" + K.TASK_CONTEXT[K.SUPPLEMENT] + "' ELSE '" + K.TASK_CONTEXT[K.FLAMMABLE] + "' END AS c FROM documents)")
def prompt_embedding(spark, d):
    cat = F.when(F.col("doc_id") % 2 == 0, K.SUPPLEMENT).otherwise(K.FLAMMABLE)
    return table(spark, d, "documents").select("doc_id", F.sha2(P.embedding_text(cat, F.col("source"), F.col("text")), 256).alias("digest"))


@query("SELECT conv_id, turn, 2 AS messages, 'system' AS first_role, text AS said FROM conversations")
def prompt_chat(spark, d):
    made = table(spark, d, "conversations").select("conv_id", "turn", P.chat(K.MODERATOR, F.col("text"), with_image=True).alias("c"))
    return made.select("conv_id", "turn", F.size("c").alias("messages"), F.col("c")[0]["role"].alias("first_role"), F.col("c")[1]["content"][1]["text"].alias("said"))


DECISIONS = [
    ('{"predicted_labels":["a"],"confidence":{"a":0.9},"evidence_text":["x"],"evidence_image":[],"reason_short":"r"}', True), ('```json\n{"predicted_labels":[],"confidence":{},"evidence_text":[],"evidence_image":[],"reason_short":""}\n```', True),
    ('{"predicted_labels":["z"],"confidence":{},"evidence_text":[],"evidence_image":[],"reason_short":""}', False), ('{"predicted_labels":[],"confidence":{"a":true},"evidence_text":[],"evidence_image":[],"reason_short":""}', False),
    ('{"predicted_labels":[],"confidence":{"a":1.5},"evidence_text":[],"evidence_image":[],"reason_short":""}', False), ('{"predicted_labels":[],"confidence":{},"evidence_text":[],"evidence_image":[]}', False),
    ('{"predicted_labels":[],"confidence":{},"evidence_text":[],"evidence_image":[],"reason_short":"","more":1}', False), ("no json", False), ('{"predicted_labels":[1],"confidence":{},"evidence_text":[],"evidence_image":[],"reason_short":""}', False),
    ('{"predicted_labels":[],"confidence":{"a":"0.5"},"evidence_text":[],"evidence_image":[],"reason_short":""}', False),
]


@query("SELECT event_id, event_id % 10 IN (0, 1) AS accepted FROM events")
def strict_json_contract(spark, d):
    raw = F.array(*[F.lit(x) for x, _ in DECISIONS])[(F.col("event_id") % 10).cast("int")]
    parsed, reason = P.decision_json(F.col("raw"), ["a", "b"])
    return table(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", reason.isNull().alias("accepted"))


@query("SELECT sha256(string_agg(doc_id::VARCHAR || chr(0), '' ORDER BY doc_id)) AS fingerprint, count(*) AS rows FROM documents")
def id_fingerprint(spark, d):
    return H.id_fingerprint(table(spark, d, "documents"), "doc_id", "doc_id")


@query("SELECT substr(sha256(string_agg(doc_id::VARCHAR, '' ORDER BY doc_id::VARCHAR)), 1, 16) AS short_hash FROM labels")
def short_hash(spark, d):
    return H.short_hash(table(spark, d, "labels"), "doc_id")


# --- audits, duplicates, leakage ----------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT doc_id) AS duplicate_ids, sum((trim(text) = '')::INT)::BIGINT AS empty_text, count(*) - count(DISTINCT text) AS duplicate_texts FROM documents")
def audit_summary(spark, d):
    return Re.audit_summary(table(spark, d, "documents"), "doc_id", F.col("text")).drop("no_image")


@query("SELECT " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) AS p{q * 100:g}" for q in (0.0, 0.5, 0.9, 0.99, 1.0)) + " FROM documents")
def text_length_quantiles(spark, d):
    made = Re.quantiles(table(spark, d, "documents"), F.length("text"))
    return made.select(*[r6(c).alias(c) for c in made.columns])


@query("WITH l AS (SELECT unnest([x for x in [CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END] if x IS NOT NULL]) AS label FROM labels) SELECT label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS rate FROM l GROUP BY label")
def label_distribution(spark, d):
    rows = table(spark, d, "labels").withColumn("l", F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()))
    return Re.label_distribution(rows, "l").select("label", "n", r6("rate").alias("rate"))


@query(f"""WITH {LABELLED} SELECT category || '::' || y AS stratum, count(*) AS all_rows, sum((fold > 0)::INT)::BIGINT AS train_rows, sum((fold = 0)::INT)::BIGINT AS valid_rows FROM labelled GROUP BY 1""")
def stratum_counts(spark, d):
    return Re.stratum_counts(labelled(spark, d), F.concat_ws("::", "category", "y"), F.when(F.col("fold") == 0, "valid").otherwise("train"))


KEYS = f"""k AS (SELECT doc_id, {NORM.format(c="string_split(text, chr(10))[1]")} AS title, {NORM.format(c='text')} AS body FROM documents),
keys AS (SELECT doc_id, 'title' AS kind, title AS key FROM k UNION ALL SELECT doc_id, 'full_text', body FROM k UNION ALL SELECT doc_id, 'text_head', left(body, 800) FROM k WHERE length(body) >= 800 UNION ALL SELECT doc_id, 'text_tail', right(body, 400) FROM k WHERE length(body) >= 800),
buckets AS (SELECT kind, key, count(*) AS n, min(doc_id) AS least FROM keys WHERE length(key) >= 8 GROUP BY kind, key HAVING count(*) BETWEEN 2 AND 1000)"""


def _keys(spark, d) -> tuple[DataFrame, dict]:
    return table(spark, d, "documents"), G.entity_keys(F.substring_index("text", "\n", 1), F.col("text"))


@query(f"WITH {KEYS} SELECT kind, count(*) AS buckets, sum(n)::BIGINT AS rows FROM buckets GROUP BY kind")
def exact_duplicate_buckets(spark, d):
    docs, keys = _keys(spark, d)
    per = G.key_buckets(docs, "doc_id", keys).groupBy("kind", "key").agg(F.count("*").alias("n"), F.first("most").alias("most")).where("n > 1 and n <= most")
    return per.groupBy("kind").agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"))


@query(f"""WITH RECURSIVE {KEYS}, e AS (SELECT DISTINCT doc_id AS a, least AS b FROM keys JOIN buckets USING (kind, key) WHERE doc_id <> least), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT id AS doc_id, min(r) AS entity_group FROM reach GROUP BY id""")
def entity_groups(spark, d):
    docs, keys = _keys(spark, d)
    return G.entity_groups(docs, "doc_id", keys)


@query(r"""WITH n AS (SELECT DISTINCT regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents), b AS (SELECT DISTINCT regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark)
SELECT 'ids' AS check, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT item_id FROM benchmark)) AS overlap UNION ALL SELECT 'texts', (SELECT count(*) FROM n JOIN b USING (t))""")
def leakage_report(spark, d):
    a, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    return R.overlap_counts(a, b, {"ids": (F.col("doc_id"), F.col("item_id")), "texts": X.leakage_key(F.col("text"))})


@query(r"WITH n AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents), b AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark) SELECT doc_id, count(*) AS items FROM n JOIN b ON contains(n.t, b.t) WHERE length(b.t) >= 20 GROUP BY doc_id")
def benchmark_contamination(spark, d):
    items = table(spark, d, "benchmark").select("item_id", X.leakage_key(F.col("text")).alias("b")).where("length(b) >= 20")
    rows = table(spark, d, "documents").select("doc_id", X.leakage_key(F.col("text")).alias("t"))
    return N.contained_items(rows, items, "doc_id", "item_id", "t", "b").groupBy("doc_id").agg(F.count("*").alias("items"))


WORDS = r"""words AS (SELECT doc_id AS id, lang AS part, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
tf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM words GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


def _vectors(spark, d) -> DataFrame:
    return N.tfidf(table(spark, d, "documents"), "doc_id", N.word_terms(F.col("text")))


@query(f"WITH {WORDS} SELECT id, count(*) AS terms, round(max(w), 6) AS top_weight FROM v GROUP BY id")
def tfidf_vectors(spark, d):
    return _vectors(spark, d).groupBy("id").agg(F.count("*").alias("terms"), r6(F.max("w")).alias("top_weight"))


@query(f"""WITH {WORDS}, p AS (SELECT DISTINCT id, part FROM words) SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM v a JOIN v b ON a.term = b.term AND a.id < b.id
JOIN p x ON x.id = a.id JOIN p y ON y.id = b.id AND x.part = y.part GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.97 - 1e-12""")
def near_text_pairs(spark, d):
    rows = N.TermRows(table(spark, d, "documents"), "doc_id", N.word_terms(F.col("text")), "lang")
    return N.near_text_pairs(rows, 0.97).select("a", "b", r6("similarity").alias("similarity"))


@query(f"""WITH {WORDS}, p AS (SELECT DISTINCT id, part FROM words), s AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.term = b.term JOIN p x ON x.id = a.id JOIN p y ON y.id = b.id AND x.part = y.part GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.97 - 1e-12),
z AS (SELECT id, string_agg(term || ':' || round(w, 9), ' ' ORDER BY term) AS z FROM v GROUP BY id), c AS (SELECT id, min(id) OVER (PARTITION BY z, part) AS class FROM z JOIN p USING (id))
SELECT id, class, count(*) - 1 AS n_links FROM c JOIN s ON s.a = c.id GROUP BY id, class""")
def near_text_classes(spark, d):
    rows = N.TermRows(table(spark, d, "documents"), "doc_id", N.word_terms(F.col("text")), "lang")
    return N.near_text_classes(rows, 0.97)


@query(r"""WITH d AS (SELECT 'a/' || doc_id AS id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents), i AS (SELECT 'b/' || item_id AS id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark),
same AS (SELECT t FROM d INTERSECT SELECT t FROM i), r AS (SELECT * FROM d UNION ALL SELECT * FROM i), b AS (SELECT id, t FROM r WHERE length(t) >= 20 AND t NOT IN (SELECT t FROM same WHERE t IS NOT NULL)),
w AS (SELECT id, ' ' || w || ' ' AS w, count(*) AS m FROM (SELECT id, unnest(string_split_regex(t, '\s+')) AS w FROM b) WHERE w <> '' GROUP BY id, w),
g AS (SELECT id, m, unnest(list_transform(range(1, length(w) - k + 2), lambda j: substr(w, j::INT, k::INT))) AS term FROM w, range(3, 6) r(k) WHERE length(w) >= k),
tf AS (SELECT id, term, 1 + ln(sum(m)) AS tf FROM g GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM b))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), size AS (SELECT id, sqrt(sum(w * w)) AS size FROM raw GROUP BY id),
v AS (SELECT id, term, w / size AS w FROM raw JOIN size USING (id)),
p AS (SELECT y.id FROM (SELECT * FROM v WHERE id LIKE 'b/%') y JOIN (SELECT * FROM v WHERE id LIKE 'a/%') x USING (term) GROUP BY y.id, x.id HAVING sum(x.w * y.w) >= 0.97 - 1e-12)
SELECT count(DISTINCT id) AS overlap FROM p""")
def near_text_overlap(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return Pl.near_text_overlap(docs, items)


# --- joins, sets, samples ---------------------------------------------------------------------------------------------------


@query(f"WITH k AS (SELECT {NORM.format(c='source')} AS title_key, lang, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT trim(title_key || ' ' || lang) AS title_key, quality FROM k) SELECT title_key, count(*) AS n, min(quality) AS label FROM t GROUP BY title_key HAVING count(*) >= 2 AND count(DISTINCT quality) = 1")
def exact_title_lookup(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("title", F.concat_ws(" ", "source", "lang"))
    return Fu.exact_title_table(rows, F.col("title"), "quality")


@query("SELECT doc_id, coalesce(quality, 0.5)::DOUBLE AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def aligned_join_checked(spark, d):
    return R.aligned_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", fill=0.5).select("doc_id", "quality")


@query("SELECT DISTINCT lang AS value FROM documents WHERE lang NOT IN ('en', 'fr')")
def unknown_values_except(spark, d):
    return R.unknown_values(table(spark, d, "documents"), "lang", spark.createDataFrame([("en",), ("fr",)], "lang string"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents), s AS (SELECT doc_id, lang FROM r WHERE k <= CASE lang WHEN 'es' THEN 1000000 WHEN 'en' THEN 50 ELSE 20 END)
SELECT doc_id, lang FROM s UNION SELECT doc_id, lang FROM documents WHERE source = 'src1'""")
def union_distinct_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    some = R.stratified_sample(docs, "lang", {"es": None, "en": 50}, [F.md5(F.col("doc_id").cast("string").cast("binary"))], 20)
    return some.unionByName(docs.where("source = 'src1'")).dropDuplicates(["doc_id"]).select("doc_id", "lang")


@query(f"""WITH {LABELLED}, p AS (SELECT doc_id, count(*) AS n FROM labelled WHERE fold < 4 GROUP BY doc_id) SELECT count(*) AS keys, min(n) AS least, max(n) AS most, min(n) = 1 AND max(n) = 1 AS complete FROM p""")
def oof_coverage(spark, d):
    return R.coverage(labelled(spark, d), "doc_id", F.col("fold") < 4)


@query(f"""WITH {LABELLED}, g AS (SELECT grp || category AS g, * FROM labelled) SELECT doc_id FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(DISTINCT y) = 1)""")
def clean_groups(spark, d):
    return R.consistent_groups(labelled(spark, d).withColumn("g", F.concat("grp", "category")), "g", "y").select("doc_id")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INT AS turn FROM r ORDER BY turn, source LIMIT 100")
def round_robin_sample(spark, d):
    return R.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 100)


@query(f"""WITH {LABELLED}, g AS (SELECT grp, greatest(0.02, avg(1 - score)) AS h FROM labelled GROUP BY grp) SELECT grp, round(h / sum(h) OVER (), 6) AS weight FROM g""")
def sampling_weights(spark, d):
    return R.sampling_weights(labelled(spark, d), "grp", 1 - F.col("score")).select("grp", r6("weight").alias("weight"))


@query(f"""WITH {LABELLED}, g AS (SELECT grp, greatest(0.02, avg(1 - score)) AS h FROM labelled GROUP BY grp), w AS (SELECT grp, h, sum(h) OVER (ORDER BY grp ROWS UNBOUNDED PRECEDING) AS c, sum(h) OVER () AS t FROM g),
u AS (SELECT k AS draw, ('0x' || substr(md5('42/' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM range(1000) r(k)) SELECT draw, grp FROM u JOIN w ON u.u >= (c - h) / t AND u.u < c / t""")
def weighted_draws(spark, d):
    rows = labelled(spark, d).groupBy("grp").agg(F.greatest(F.lit(0.02), F.avg(1 - F.col("score"))).alias("weight"))
    return R.weighted_draws(rows, 1000, "weight", "grp")


@query("SELECT doc_id, unnest(range(1, CASE WHEN toxic = 1 THEN 11 ELSE 2 END)) AS copy FROM labels")
def positive_oversampling(spark, d):
    return R.oversample(table(spark, d, "labels"), F.col("toxic") == 1, 10, "doc_id").select("doc_id", F.col("copy").cast("long").alias("copy"))


# --- splits ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT doc_id, grp, fold FROM labelled")
def fold_assignment(spark, d):
    return labelled(spark, d).select("doc_id", "grp", "fold")


HOLDOUT = """, g AS (SELECT grp, count(*) AS size FROM x GROUP BY grp), s AS (SELECT k AS seed FROM range(42, 42 + {n}) r(k)),
r AS (SELECT seed, grp, size, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(seed || '/' || grp), 1, 8))::BIGINT, grp) AS k FROM g, s),
h AS (SELECT seed, grp, size FROM r WHERE k <= ceil((SELECT count(*) FROM g) * 0.2::DOUBLE)),
z AS (SELECT seed, sum(size) AS valid_rows, count(*) AS valid_groups FROM h GROUP BY seed), a AS (SELECT stratum, count(*) AS all_n FROM x GROUP BY stratum),
p AS (SELECT seed, stratum, count(*) AS n FROM h JOIN x USING (grp) GROUP BY seed, stratum), t AS (SELECT count(*)::DOUBLE AS rows FROM x)
SELECT z.seed::BIGINT AS seed, round(avg(abs(coalesce(n, 0)::DOUBLE / valid_rows - all_n / rows) / {by}) + abs(max(valid_rows) / max(rows) - 0.2::DOUBLE), 6) AS objective, max(valid_rows)::BIGINT AS valid_rows, max(valid_groups)::BIGINT AS valid_groups
FROM z CROSS JOIN a CROSS JOIN t LEFT JOIN p ON p.seed = z.seed AND p.stratum = a.stratum GROUP BY z.seed"""


@query(f"WITH {LABELLED}, x AS (SELECT grp, y::VARCHAR AS stratum FROM labelled)" + HOLDOUT.format(n=64, by="1"))
def group_holdout_search(spark, d):
    made = Sp.holdout_search(labelled(spark, d).withColumn("stratum", F.col("y").cast("string")), "grp", "stratum")
    return made.withColumn("objective", r6("objective"))


@query(f"WITH {LABELLED}, x AS (SELECT grp, category || '::' || y AS stratum FROM labelled)" + HOLDOUT.format(n=512, by="greatest(all_n / rows, 0.0001)"))
def stratified_holdout_search(spark, d):
    made = Sp.holdout_search(labelled(spark, d).withColumn("stratum", F.concat_ws("::", "category", "y")), "grp", "stratum", candidates=512, relative=True)
    return made.withColumn("objective", r6("objective"))


@query()
def multilabel_greedy_folds(spark, d):
    return Sp.greedy_folds(labelled(spark, d), "grp", [F.col("y"), F.col("toxic")], 5)


@query()
def stratified_group_folds(spark, d):
    return Sp.stratified_group_folds(labelled(spark, d).withColumn("stratum", F.concat_ws("::", "category", "y")), "grp", "stratum", 5)


# --- vectors -----------------------------------------------------------------------------------------------------------------------


def _bank(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("int").alias("label"))


KNN = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (label < 5)::INT AS y, vec_id % 5 AS f FROM embeddings),
s AS (SELECT a.id, b.id AS rid, b.y, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON {on})
SELECT id, round(max(CASE WHEN y = 1 THEN s END) - max(CASE WHEN y = 0 THEN s END), 6) AS margin, round(max(s), 6) AS nearest, arg_max(y, struct_pack(s := round(s, 12), r := -rid)) AS nearest_label FROM s GROUP BY id"""


@query("WITH " + KNN.format(on="a.id <> b.id AND b.f > 0 AND a.f = 0"))
def knn_margin(spark, d):
    rows = _bank(spark, d)
    made = V.knn_margin(rows.where(F.col("id") % 5 == 0), rows.where(F.col("id") % 5 != 0))
    return made.select("id", r6("margin").alias("margin"), r6("nearest").alias("nearest"), "nearest_label")


@query("WITH " + KNN.format(on="a.f <> b.f"))
def knn_margin_fold_excluded(spark, d):
    rows = _bank(spark, d).withColumn("f", (F.col("id") % 5).cast("int"))
    made = V.knn_margin(rows, rows, query_fold="f", ref_fold="f")
    return made.select("id", r6("margin").alias("margin"), r6("nearest").alias("nearest"), "nearest_label")


@query("WITH " + KNN.format(on="a.id <> b.id"))
def knn_margin_whole(spark, d):
    """Every row against the whole bank but itself."""
    rows = _bank(spark, d)
    made = V.knn_margin(rows, rows, query_fold="id", ref_fold="id")
    return made.select("id", r6("margin").alias("margin"), r6("nearest").alias("nearest"), "nearest_label")


@query()
def prototype_margin_texts(spark, d):
    """Every document against the literal prototype texts, both in the stand-in encoder's space."""
    texts = [(i, t, int(i < len(K.PROTOTYPES_POSITIVE))) for i, t in enumerate(K.PROTOTYPES_POSITIVE + K.PROTOTYPES_NEGATIVE)]
    vector = H.token_hash_vector(F.col("text"), 64).alias("embedding")
    bank = spark.createDataFrame(texts, "id long, text string, label int").select("id", vector, "label")
    made = V.knn_margin(table(spark, d, "documents").select(F.col("doc_id").alias("id"), vector), bank)
    return made.select("id", r6("margin").alias("margin"), r6("nearest").alias("nearest"), "nearest_label")


@query("WITH " + KNN.format(on="a.id <> b.id AND b.id < 46"))
def prototype_margin(spark, d):
    rows = _bank(spark, d)
    made = V.knn_margin_sql(rows, rows.where("id < 46"), exclude=F.col("q.id") == F.col("r.id"))
    return made.select("id", r6("margin").alias("margin"), r6("nearest").alias("nearest"), "nearest_label")


@query("""WITH c AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), p AS (SELECT label, pos, avg(x) AS a, max(x) AS m FROM c GROUP BY label, pos)
SELECT label, (pos - 1)::INT AS pos, round(a, 6) AS mean, round(m, 6) AS maximum FROM p""")
def vector_pool(spark, d):
    made = V.pool(table(spark, d, "embeddings"), "label", "embedding")
    return made.select("label", F.posexplode(F.arrays_zip("mean", "maximum")).alias("pos", "z")).select("label", "pos", r6("z.mean").alias("mean"), r6("z.maximum").alias("maximum"))


@query("SELECT vec_id::VARCHAR AS id, 128::INT AS dimensions, round(list_sum(embedding::DOUBLE[]) + 2 * list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def cache_concat(spark, d):
    from curatrix.sources.cache import combine_caches

    one = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), A.doubles(F.col("embedding")).alias("embedding"))
    two = one.select("id", F.transform("embedding", lambda x: 2 * x).alias("embedding"))
    made = combine_caches(one, two)
    return made.select("id", F.size("embedding").alias("dimensions"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("""WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT id, round(list_sum([abs(z[1] - z[2]) for z in list_zip(x, y)]), 6) AS difference, round(list_sum([z[1] * z[2] for z in list_zip(x, y)]), 6) AS product, round(list_cosine_similarity(x, y), 6) AS cosine FROM p""")
def vector_blocks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    total = lambda v: r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
    a, b = F.col("embedding"), F.col("other")
    return p.select(F.col("vec_id").alias("id"), total(A.abs_difference(a, b)).alias("difference"), total(A.product(a, b)).alias("product"), r6(A.cosine(a, b)).alias("cosine"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label < 5)::INT AS y FROM embeddings), c AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS pos, unnest(e) AS x FROM e WHERE y = 1) GROUP BY pos),
m AS (SELECT list(x ORDER BY pos) AS c FROM c), s AS (SELECT vec_id, y, list_cosine_similarity(e, c) AS s FROM e, m), q AS (SELECT quantile_cont(s, 0.95) AS q FROM s WHERE y = 0)
SELECT vec_id, round(s, 6) AS centroid_cosine, y = 0 AND s >= q AS hard FROM s, q""")
def hard_negatives(spark, d):
    rows = table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return V.hard_negatives(rows, "embedding", "y").select("vec_id", r6("centroid_cosine").alias("centroid_cosine"), "hard")


@query()
def principal_removal(spark, d):
    rows = table(spark, d, "embeddings")
    made = V.remove_components(rows, "embedding", V.fit_principal(rows, "embedding", 2))
    return made.select("vec_id", r6(A.norm(F.col("projected"))).alias("norm"))


# --- fusion and composite plans -----------------------------------------------------------------------------------------------------


def _scored(spark, d) -> DataFrame:
    made = labelled(spark, d).withColumnRenamed("score", "lexical_probability")
    return made.withColumn("vlm_probability", (F.col("doc_id") * 37 % 101 + 1) / F.lit(103.0))


SCORED = LABELLED + ", sc AS (SELECT *, score AS lex, (doc_id * 37 % 101 + 1) / 103.0::DOUBLE AS vlm FROM labelled)"
LOGIT = "ln(least(greatest({x}, 1e-5), 1 - 1e-5) / (1 - least(greatest({x}, 1e-5), 1 - 1e-5)))"
_lo = lambda x: LOGIT.format(x=x)
GRID = f"""g AS (SELECT k / 20.0::DOUBLE AS alpha, s AS strategy FROM range(21) r(k), (SELECT unnest(['raw_probability', 'logit_margin']) AS s)),
b AS (SELECT alpha, strategy, y, round(CASE WHEN strategy = 'raw_probability' THEN alpha * vlm + (1 - alpha) * lex ELSE 1 / (1 + exp(-(alpha * ({_lo('vlm')} - {_lo('0.5::DOUBLE')}) + (1 - alpha) * ({_lo('lex')} - {_lo('0.3::DOUBLE')})))) END, 12) AS p FROM sc, g),
st AS (SELECT alpha, strategy, p, sum(y) AS p1, count(*) AS n1 FROM b GROUP BY alpha, strategy, p),
ru AS (SELECT alpha, strategy, p AS t, sum(p1) OVER w AS tp, sum(n1) OVER w - sum(p1) OVER w AS fp, sum(p1) OVER (PARTITION BY alpha, strategy) - sum(p1) OVER w AS fn FROM st WINDOW w AS (PARTITION BY alpha, strategy ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT alpha, strategy, t, {_f()} AS f1, row_number() OVER (PARTITION BY alpha, strategy ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t) AS k FROM ru)"""


@query(f"WITH {SCORED}, {GRID} SELECT round(alpha, 6) AS alpha, strategy, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ra WHERE k = 1")
def blend_grid_search(spark, d):
    made = Fu.blend_grid(_scored(spark, d), "y", "vlm_probability", "lexical_probability", F.lit(0.5), F.lit(0.3))
    return made.select(r6("alpha").alias("alpha"), "strategy", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"WITH {SCORED}, {GRID} SELECT round(alpha, 6) AS alpha, strategy, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ra WHERE k = 1 ORDER BY round(f1, 12) DESC, round(abs(alpha - 0.5), 12), strategy, alpha LIMIT 1")
def blend_best(spark, d):
    made = Fu.best_blend(Fu.blend_grid(_scored(spark, d), "y", "vlm_probability", "lexical_probability", F.lit(0.5), F.lit(0.3)))
    return made.select(r6("alpha").alias("alpha"), "strategy", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


DECISION_ROWS = [(K.SUPPLEMENT, 0.5, 0.3, 0.15, "raw_probability", 0.4), (K.FLAMMABLE, 0.5, 0.3, 0.25, "logit_margin", 0.5)]
TITLES = ["Уголь древесный 3 кг", "Чай", "Брикеты для гриля", "Дымовая шашка", "Газ для портативных плит", "Мангал"]
k = K.KNN
LAYERS = f"""c AS (SELECT doc_id AS id, lex, vlm, doc_id % 2 AS fl, doc_id % 6 AS ti, ((doc_id * 13) % 41 - 20) / 1000.0::DOUBLE AS margin, (doc_id * 29 % 97 + 1) / 99.0::DOUBLE AS head FROM sc),
l0 AS (SELECT *, CASE WHEN fl = 0 THEN 0.15::DOUBLE * vlm + (1 - 0.15::DOUBLE) * lex ELSE 1 / (1 + exp(-(0.25::DOUBLE * ({_lo('vlm')} - {_lo('0.5::DOUBLE')}) + (1 - 0.25::DOUBLE) * ({_lo('lex')} - {_lo('0.3::DOUBLE')})))) END AS p FROM c),
l1 AS (SELECT *, CASE WHEN fl = 1 THEN 1 / (1 + exp(-((1 - {k["knn_alpha"]}::DOUBLE) * ({_lo('p')} - {_lo(str(k["base_threshold"]) + '::DOUBLE')}) + {k["knn_alpha"]}::DOUBLE * (margin - ({k["knn_threshold"]}::DOUBLE)) / {k["margin_scale"]}::DOUBLE))) ELSE p END AS p1 FROM l0),
l2 AS (SELECT *, CASE WHEN fl = 1 THEN 1 / (1 + exp(-(0.75::DOUBLE * {_lo('p1')} + 0.25::DOUBLE * {_lo('head')}))) ELSE p1 END AS p2 FROM l1)
SELECT id, round(CASE WHEN fl = 1 AND ti NOT IN (1, 5) THEN 1.0 ELSE p2 END, 6) AS probability, CASE WHEN fl = 1 AND ti NOT IN (1, 5) THEN 1 WHEN fl = 1 THEN (p2 >= 0.26)::INT ELSE (p2 >= 0.4)::INT END AS prediction FROM l2"""
del k


@query(f"WITH {SCORED}, {LAYERS}")
def frozen_scoring(spark, d):
    rows = _scored(spark, d)
    cards = rows.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, K.SUPPLEMENT).otherwise(K.FLAMMABLE).alias("category"), F.array(*[F.lit(t) for t in TITLES])[(F.col("doc_id") % 6).cast("int")].alias("title"),
        "lexical_probability", "vlm_probability", (((F.col("doc_id") * 13) % 41 - 20) / F.lit(1000.0)).alias("margin"), ((F.col("doc_id") * 29 % 97 + 1) / F.lit(99.0)).alias("head_probability"),
    )
    decisions = spark.createDataFrame(DECISION_ROWS, "category string, vlm_threshold double, lexical_threshold double, blend_alpha_vlm double, blend_strategy string, blend_threshold double")
    made = Fu.apply_title_rules(Fu.apply_head(Fu.apply_knn(Fu.apply_decisions(cards, decisions))))
    return made.select("id", r6("probability").alias("probability"), "prediction")


@query(f"WITH {SCORED} SELECT doc_id, round({_lo('lex')}, 6) AS logit, round(1 / (1 + exp(-{_lo('lex')})), 6) AS back, round(1 / (1 + exp(lex - vlm)), 6) AS two_class FROM sc")
def probability_maths(spark, d):
    p = F.col("lexical_probability")
    return _scored(spark, d).select("doc_id", r6(M.logit(p)).alias("logit"), r6(M.sigmoid(M.logit(p))).alias("back"), r6(M.two_class(p, F.col("vlm_probability"))).alias("two_class"))


@query()
def knn_fusion_grid(spark, d):
    rows = _scored(spark, d).withColumn("margin", ((F.col("doc_id") * 13) % 41 - 20) / F.lit(1000.0))
    made = Fu.knn_grid(rows, "y", "lexical_probability", "margin", 0.3)
    return made.select("knn_alpha", "margin_scale", r6("center").alias("center"), r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query("""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'Карточка соответствует правилам категории: обнаружена прямая маркировка товара как БАД.'
ELSE 'Товар не проходит правила категории: обнаружена поставка без горючего содержимого; самостоятельное горючее содержимое или источник огня не подтверждены.' END AS comment FROM documents""")
def deterministic_comments(spark, d):
    even = F.col("n_chars") % 2 == 0
    made = X.deterministic_comment(F.when(even, K.SUPPLEMENT).otherwise(K.FLAMMABLE), F.when(even, "Омега, БАД").otherwise("Горелка без газа"), F.lit("описание"), F.when(even, 1).otherwise(0))
    return table(spark, d, "documents").select("doc_id", made.alias("comment"))


@query()
def submission_contract(spark, d):
    rows = _scored(spark, d).select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), F.lit(K.FLAMMABLE).alias("category"), F.lit("Зажигалка").alias("title"), F.lit("").alias("description"), "prediction")
    made = Pl.submission(rows)
    return R.validate_submission(made, rows.select("pos", "id"), K.RESULT_PATTERN)


@query()
def logistic_oof(spark, d):
    rows = E.with_vector(_bank(spark, d).withColumn("fold", (F.col("id") % 3).cast("int")), "embedding")
    made = E.out_of_fold(rows, "fold", "label", 3, c=0.03, scale=True)
    return made.select("id", "label", "fold", F.round("score", 4).alias("score"))


@query()
def fold_stacking(spark, d):
    rows = _scored(spark, d).withColumn("short", (F.col("n_chars") < 500).cast("double")).withColumn("f", (F.col("doc_id") % 3).cast("int"))
    return E.fold_stacking(rows, ["lexical_probability", "vlm_probability", "short"], "f", "y", 3).select("doc_id", F.round("score", 4).alias("score"), "prediction")


@query()
def nested_audit(spark, d):
    rows = E.with_vector(_bank(spark, d).withColumn("grp", F.col("id") % 40), "embedding")
    return Pl.nested_audit(rows, "grp", "label", outer=5, inner=5).select("fold", F.round("threshold", 3).alias("threshold"), F.round("f1", 3).alias("f1"))


@query()
def lexical_baseline(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.lit("all").alias("category"), "quality", (F.col("doc_id") % 5).cast("int").alias("fold"))
    return Pl.train_text_baseline(docs, "quality", "fold", 5)[1].select("category", F.round("threshold", 2).alias("threshold"), F.round("f1", 3).alias("f1"))


@query(r"SELECT doc_id::VARCHAR AS id, 5 * 16 + 1 + 5 + 4 + 2 * 64 AS dimensions, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR text IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS text_norm FROM documents")
def fusion_feature_blocks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("category"), F.col("source").alias("brand"), F.array().cast("array<string>").alias("images"))
    v = H.token_hash_vector(F.col("text"), 16)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    made = E.fusion_features(docs, v, v, zeros(16), F.lit(False), zeros(4))
    return made.select("id", F.size(F.concat(*E.VIEWS["fusion"])).alias("dimensions"), r6(A.norm(F.col("block_text"))).alias("text_norm"))
