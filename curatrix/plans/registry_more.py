"""Further registered queries: operators that the first module leaves out, each over whole tables through its own function."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import arrays as A
from curatrix.functions import constants as K
from curatrix.functions import prompts as P
from curatrix.functions import text as X
from curatrix.operators import encoders as En
from curatrix.operators import estimators as E
from curatrix.operators import fusion as Fu
from curatrix.operators import grouping as G
from curatrix.operators import images as Im
from curatrix.operators import metrics as Me
from curatrix.operators import ocr as O
from curatrix.operators import relational as R
from curatrix.operators import reports as Re
from curatrix.operators import splits as Sp
from curatrix.operators import vectors as V
from curatrix.plans import artifacts as Ar
from curatrix.plans import candidates as Ca
from curatrix.plans import training as Tr
from curatrix.plans.registry import COUNTS, HOLDOUT, LABELLED, MACRO, MACRO_CAND, ORACLES, SCORED, _bank, _f, _lo, _scored, labelled, query, r6
from curatrix.session import table

# --- joins, look-ups, sets ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1.5 WHEN 'de' THEN 2.5 ELSE 0.25 END::DOUBLE AS weight FROM documents")
def lookup_default(spark, d):
    known = spark.createDataFrame([("en", 1.5), ("de", 2.5)], "lang string, weight double")
    return R.lookup(table(spark, d, "documents").select("doc_id", "lang"), known, "lang", "weight", 0.25).select("doc_id", "weight")


@query("WITH k AS (SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL), l AS (SELECT k, min(doc_id) AS src FROM k GROUP BY k HAVING count(*) > 1) SELECT src, doc_id AS dst FROM k JOIN l USING (k) WHERE doc_id > src")
def equal_text_pairs(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return G.equal_pairs(keyed, "doc_id", "k")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings)")
def available_in_all(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return R.available_in_all("doc_id", table(spark, d, "documents"), table(spark, d, "labels"), vectors)


@query(f"WITH {LABELLED} SELECT DISTINCT grp FROM labelled WHERE category = 'en' AND grp IN (SELECT grp FROM labelled WHERE category <> 'en')")
def groups_on_both_sides(spark, d):
    rows = labelled(spark, d)
    return Sp.shared_groups(rows.where("category = 'en'"), rows.where("category <> 'en'"), "grp")


HARD = "greatest(0.02, avg(1 - score))"


@query(f"""WITH {LABELLED}, own AS (SELECT *, row_number() OVER (PARTITION BY y, grp ORDER BY doc_id) AS k FROM labelled), g AS (SELECT y, grp, {HARD} AS h, count(*) AS n FROM own GROUP BY y, grp),
w AS (SELECT y, grp, n, h, sum(h) OVER (PARTITION BY y ORDER BY grp ROWS UNBOUNDED PRECEDING) AS c, sum(h) OVER (PARTITION BY y) AS t FROM g),
u AS (SELECT y, 2 * k + 1 - y AS draw, ('0x' || substr(md5((43 - y) || '/' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM range(500) r(k), (SELECT unnest([0, 1]) AS y)),
p AS (SELECT draw, u.y, grp, floor(('0x' || substr(md5('row 42/' || draw), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * n)::BIGINT + 1 AS k FROM u JOIN w ON u.y = w.y AND u.u >= (c - h) / t AND u.u < c / t)
SELECT draw, p.y = 1 AS positive, grp AS "group", doc_id FROM p JOIN own USING (y, grp, k)""")
def balanced_group_draws(spark, d):
    return R.balanced_draws(labelled(spark, d), 1000, "grp", F.col("y") == 1, 1 - F.col("score"), "doc_id")


# --- reports and thresholds ---------------------------------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT doc_id, round(score, 6) AS score FROM labelled ORDER BY score DESC, doc_id LIMIT 50")
def top_scores(spark, d):
    return R.top_k(labelled(spark, d), 50, F.desc("score"), F.col("doc_id")).select("doc_id", r6("score").alias("score"))


@query(f"WITH {LABELLED}, m AS (SELECT doc_id, round(abs(2 * score - 1), 9) AS uncertainty_margin FROM labelled) SELECT doc_id, round(uncertainty_margin, 6) AS uncertainty_margin FROM m ORDER BY m.uncertainty_margin, doc_id LIMIT 100")
def most_uncertain_rows(spark, d):
    rows = Re.difficulty(labelled(spark, d).withColumn("p", F.array(1 - F.col("score"), F.col("score"))), "p")
    made = Re.most_uncertain(rows.withColumn("uncertainty_margin", F.round("uncertainty_margin", 9)), "doc_id")
    return made.select("doc_id", r6("uncertainty_margin").alias("uncertainty_margin"))


@query(f"WITH {LABELLED} SELECT doc_id FROM labelled WHERE (score >= 0.5) <> (n_chars % 2 = 0)")
def modality_conflicts(spark, d):
    return Re.conflicts(labelled(spark, d), F.col("score") >= 0.5, F.col("n_chars") % 2 == 0).select("doc_id")


@query(f"WITH {LABELLED} SELECT grp, list_sort(list(DISTINCT fold))::VARCHAR AS folds FROM labelled GROUP BY grp")
def group_folds(spark, d):
    made = Re.fold_distribution(labelled(spark, d), "fold", "y", "grp")[1]
    return made.select("grp", F.concat(F.lit("["), F.array_join(F.col("folds").cast("array<string>"), ", "), F.lit("]")).alias("folds"))


@query(f"WITH {LABELLED} SELECT doc_id, round((score + least(1.0, score * 1.5) + score * score) / 3, 6) AS score FROM labelled")
def seed_ensemble(spark, d):
    rows = labelled(spark, d)
    runs = [rows, rows.withColumn("score", F.least(F.lit(1.0), F.col("score") * 1.5)), rows.withColumn("score", F.col("score") * F.col("score"))]
    return Re.ensemble_average(runs, "doc_id", "score").select("doc_id", r6("score").alias("score"))


@query(f"WITH {LABELLED}, r AS (SELECT doc_id, y, cume_dist() OVER (PARTITION BY y ORDER BY score) AS share FROM labelled) SELECT doc_id, round(share, 6) AS share, round(1 + 4 * least(greatest(share, 0), 1), 6) AS weight FROM r")
def hard_negative_weights(spark, d):
    ranked = Re.rank_share(labelled(spark, d), "score", "y", "share")
    return ranked.select("doc_id", r6("share").alias("share"), r6(V.hard_negative_weight(F.col("share"))).alias("weight"))


@query(f"""WITH {SCORED}, g AS (SELECT k / 40.0::DOUBLE AS alpha FROM range(41) r(k)), b AS (SELECT alpha, y, alpha * vlm + (1 - alpha) * lex AS score FROM sc, g),
cand AS (SELECT DISTINCT alpha, t FROM (SELECT alpha, t FROM g, ({MACRO_CAND}) UNION ALL SELECT alpha, score FROM b)),
st AS (SELECT alpha, t, sum(p) AS p1, sum(n) AS n1, max(m) AS m FROM (SELECT alpha, t, 0 AS p, 0 AS n, 1 AS m FROM cand UNION ALL SELECT alpha, score, y, 1, 0 FROM b) GROUP BY alpha, t),
ru AS (SELECT alpha, t, m, sum(p1) OVER w AS tp, sum(n1) OVER w AS n, sum(p1) OVER (PARTITION BY alpha) AS pos, sum(n1) OVER (PARTITION BY alpha) AS rows FROM st WINDOW w AS (PARTITION BY alpha ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
sw AS (SELECT alpha, t, tp, n - tp AS fp, pos - tp AS fn, rows - n - (pos - tp) AS tn FROM ru WHERE m = 1),
ra AS (SELECT alpha, t, {MACRO} AS f1, row_number() OVER (PARTITION BY alpha ORDER BY round({MACRO}, 12) DESC, round(abs(t - 0.5), 12), t) AS k FROM sw)
SELECT round(alpha, 6) AS alpha, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ra WHERE k = 1""")
def blend_search_macro(spark, d):
    made = Fu.blend_search(_scored(spark, d), "y", "vlm_probability", "lexical_probability")
    return made.select(r6("alpha").alias("alpha"), r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN lex >= vlm AND lex >= 0.4 THEN 'lexical' WHEN vlm >= 0.4 THEN 'vlm' ELSE 'none' END AS single, array_to_string([x for x in [CASE WHEN lex >= 0.3 THEN 'lexical' END, CASE WHEN vlm >= 0.6 THEN 'vlm' END] if x IS NOT NULL], ',') AS several FROM sc")
def fixed_decisions(spark, d):
    rows = _scored(spark, d).withColumn("p", F.array("lexical_probability", "vlm_probability", F.lit(0.4))).withColumn("q", F.array("lexical_probability", "vlm_probability"))
    single, several = Fu.fixed_decision(rows, "p", ["lexical", "vlm", "none"]), Fu.fixed_decision(rows, "q", ["lexical", "vlm"], [0.3, 0.6])
    return rows.select("doc_id", single[0].alias("single"), F.array_join(several, ",").alias("several"))


@query("""WITH l AS (SELECT [x for x in [CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END] if x IS NOT NULL] AS l FROM labels)
SELECT CASE WHEN max(len(l)) = 1 AND min(len(l)) = 1 THEN 'single_label' ELSE 'multi_label' END AS task_type, sum((len(l) > 1)::INT)::BIGINT AS multi_rows FROM l""")
def label_task_type(spark, d):
    return E.task_type(_label_lists(spark, d), "labels")


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN '[\"quality\",\"toxic\"]' WHEN quality = 1 THEN '[\"quality\"]' WHEN toxic = 1 THEN '[\"toxic\"]' ELSE '[]' END AS labels_json, (toxic = 1)::INT || '/' || (quality = 1)::INT AS hot FROM labels")
def label_lists_json(spark, d):
    rows = _label_lists(spark, d)
    return rows.select("doc_id", Tr.labels_json(F.col("labels")).alias("labels_json"), F.array_join(E.multi_hot(F.col("labels"), ["toxic", "quality"]).cast("array<string>"), "/").alias("hot"))


def _label_lists(spark, d):
    return table(spark, d, "labels").withColumn("labels", F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality")), lambda x: x.isNotNull()))


@query(f"""WITH {LABELLED}, x AS (SELECT grp, y::VARCHAR AS stratum FROM labelled){HOLDOUT.format(n=64, by="1").replace("SELECT z.seed", ", o AS (SELECT z.seed", 1)})
SELECT doc_id, l.grp, CASE WHEN h.grp IS NULL THEN 'train' ELSE 'valid' END AS split FROM labelled l LEFT JOIN h ON h.grp = l.grp AND h.seed = (SELECT seed FROM o ORDER BY objective, seed LIMIT 1)""")
def holdout_split(spark, d):
    """Every labelled row's side under the best of 64 seeded splits of complete groups."""
    return Sp.holdout(labelled(spark, d).withColumn("stratum", F.col("y").cast("string")), "grp", "stratum").select("doc_id", "grp", "split")


@query(f"""WITH {SCORED}, f AS (SELECT unnest(range(5)) AS fold),
cand AS (SELECT DISTINCT f.fold, s.score AS t FROM f JOIN labelled s ON s.fold <> f.fold UNION SELECT fold, 0.01::DOUBLE + 0.98::DOUBLE * k / 196 FROM f, range(197) r(k)),
sw AS (SELECT cand.fold, t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn FROM cand JOIN labelled l ON l.fold <> cand.fold GROUP BY cand.fold, t),
b AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t) AS k FROM sw)
SELECT b.fold::INT AS fold, round(t, 6) AS threshold, sum((y = 1 AND score >= t)::INT)::BIGINT AS tp, sum((y = 0 AND score >= t)::INT)::BIGINT AS fp, sum((y = 1 AND score < t)::INT)::BIGINT AS fn FROM b JOIN labelled l ON l.fold = b.fold WHERE k = 1 GROUP BY b.fold, t""")
def outer_threshold_audit(spark, d):
    """Each fold judged at the threshold that the other folds choose."""
    rows, out = labelled(spark, d), None
    for k in range(5):
        cut = Me.positive_threshold(rows.where(F.col("fold") != k), "y", "score").select("threshold")
        own = rows.where(F.col("fold") == k).crossJoin(F.broadcast(cut)).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
        made = own.groupBy("fold", "threshold").agg(*Me.confusion_counts(F.col("y"), F.col("prediction"))).drop("tn")
        out = made if out is None else out.unionByName(made)
    return out.select("fold", r6("threshold").alias("threshold"), "tp", "fp", "fn")


BLEND = f"round(CASE WHEN strategy = 'raw_probability' THEN alpha * vlm + (1 - alpha) * lex ELSE 1 / (1 + exp(-(alpha * ({_lo('vlm')} - {_lo('vt')}) + (1 - alpha) * ({_lo('lex')} - {_lo('lt')})))) END, 12)"


@query(f"""WITH {SCORED}, d AS (SELECT * FROM sc WHERE fold IS NOT NULL), f AS (SELECT unnest(range(5)) AS k), u AS (SELECT fold, y, 'v' AS which, vlm AS score FROM d UNION ALL SELECT fold, y, 'l', lex FROM d),
cand AS (SELECT DISTINCT k, which, score AS t FROM f JOIN u ON fold <> k UNION SELECT k, which, 0.01::DOUBLE + 0.98::DOUBLE * j / 196 FROM f, (SELECT unnest(['v', 'l']) AS which), range(197) r(j)),
sw AS (SELECT cand.k, cand.which, t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn FROM cand JOIN u ON u.which = cand.which AND fold <> cand.k GROUP BY cand.k, cand.which, t),
cut AS (SELECT k, which, t, row_number() OVER (PARTITION BY k, which ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t) AS r FROM sw),
cuts AS (SELECT k, max(CASE WHEN which = 'v' THEN t END) AS vt, max(CASE WHEN which = 'l' THEN t END) AS lt FROM cut WHERE r = 1 GROUP BY k),
g AS (SELECT j / 20.0::DOUBLE AS alpha, strategy FROM range(21) r(j), (SELECT unnest(['raw_probability', 'logit_margin']) AS strategy)),
b AS (SELECT k, alpha, strategy, fold, y, {BLEND} AS p FROM cuts, g, d),
st AS (SELECT k, alpha, strategy, p, sum(y) AS p1, count(*) AS n1 FROM b WHERE fold <> k GROUP BY k, alpha, strategy, p),
ru AS (SELECT k, alpha, strategy, p AS t, sum(p1) OVER w AS tp, sum(n1) OVER w - sum(p1) OVER w AS fp, sum(p1) OVER (PARTITION BY k, alpha, strategy) - sum(p1) OVER w AS fn FROM st WINDOW w AS (PARTITION BY k, alpha, strategy ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT k, alpha, strategy, t, {_f()} AS f1, row_number() OVER (PARTITION BY k, alpha, strategy ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t) AS r FROM ru),
be AS (SELECT k, alpha, strategy, t, row_number() OVER (PARTITION BY k ORDER BY round(f1, 12) DESC, round(abs(alpha - 0.5), 12), strategy, alpha) AS r FROM ra WHERE r = 1),
j AS (SELECT be.k, be.alpha, be.strategy, be.t, sum((y = 1 AND p >= t)::INT)::BIGINT AS tp, sum((y = 0 AND p >= t)::INT)::BIGINT AS fp, sum((y = 1 AND p < t)::INT)::BIGINT AS fn FROM be JOIN b ON be.k = b.k AND b.fold = b.k AND be.alpha = b.alpha AND be.strategy = b.strategy WHERE be.r = 1 GROUP BY be.k, be.alpha, be.strategy, be.t)
SELECT k::INT AS fold, round(alpha, 6) AS alpha, strategy, round(t, 6) AS threshold, tp, fp, fn, round({_f()}, 6) AS f1 FROM j""")
def outer_reselection(spark, d):
    rows = _scored(spark, d).where("fold is not null")
    made = Ar.outer_reselection(rows, "y", "fold", 5, "vlm_probability", "lexical_probability")
    return made.select("fold", r6("alpha").alias("alpha"), "strategy", r6("threshold").alias("threshold"), "tp", "fp", "fn", r6("f1").alias("f1"))


@query(f"WITH {LABELLED}, g AS (SELECT k, 0.1::DOUBLE + k * 0.05::DOUBLE AS t FROM range(17) r(k)), sw AS (SELECT category, k, t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn FROM labelled, g GROUP BY category, k, t), ra AS (SELECT *, {_f()} AS f1, row_number() OVER (PARTITION BY category ORDER BY round({_f()}, 12) DESC, k) AS r FROM sw) SELECT category, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ra WHERE r = 1")
def threshold_coarse_grid(spark, d):
    made = Me.grid_threshold(labelled(spark, d), [0.1 + k * 0.05 for k in range(17)], "y", "score", ["category"])
    return made.select("category", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"WITH {LABELLED} SELECT doc_id FROM labelled JOIN documents USING (doc_id) WHERE y = 1 AND prediction = 0 AND NOT contains(lower(text), 'licens') AND NOT contains(lower(text), '!!')")
def misses_outside_families(spark, d):
    rows = labelled(spark, d).join(table(spark, d, "documents").select("doc_id", F.lower("text").alias("low")), "doc_id")
    return Me.misses_outside(rows, F.col("low"), ("licens", "!!"), "y").select("doc_id")


@query(f"WITH {LABELLED}, per AS (SELECT category, {COUNTS} FROM labelled GROUP BY category), f AS (SELECT category, {_f()} AS f1 FROM per) SELECT category, round(f1, 6) AS f1 FROM f UNION ALL SELECT 'official_score', round(avg(f1), 6) FROM f")
def category_f1_known(spark, d):
    return Me.category_f1(labelled(spark, d), "y", known=("en", "de", "fr", "es")).select("category", r6("f1").alias("f1"))


@query("SELECT doc_id, quality AS label FROM labels")
def binary_label_cast(spark, d):
    rows = table(spark, d, "labels").withColumn("labels", F.array(F.col("quality").cast("string"), F.lit("7")))
    return rows.select("doc_id", X.binary_label(F.col("labels")).alias("label"))


# --- text, prompts, pictures -----------------------------------------------------------------------------------------------

OCR_SQL = ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}')::INT" for p in K.OCR_FEATURES.values())


@query(f"SELECT doc_id, array_to_string([{OCR_SQL}], '/') AS flags FROM documents")
def ocr_keyword_vector(spark, d):
    made = O.ocr_vector(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(made.cast("array<int>").cast("array<string>"), "/").alias("flags"))


@query(f"""WITH {LABELLED}, scored AS (SELECT l.*, contains(lower(text), 'license') AS s FROM labelled l JOIN documents USING (doc_id)),
cand AS (SELECT DISTINCT t FROM (SELECT 0.01::DOUBLE + 0.98::DOUBLE * k / 196 AS t FROM range(197) r(k) UNION ALL SELECT score FROM scored)),
sw AS (SELECT t, sum((y = 1 AND score >= t)::INT) AS tp, sum((y = 0 AND score >= t)::INT) AS fp, sum((y = 1 AND score < t)::INT) AS fn FROM cand, scored GROUP BY t),
b AS (SELECT t FROM sw ORDER BY round({_f()}, 12) DESC, round(abs(t - 0.5), 12), t LIMIT 1), z AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS low),
p AS (SELECT low, y, CASE WHEN score >= low AND score < low + 0.2::DOUBLE AND s THEN 1 ELSE (score >= t)::INT END AS prediction FROM scored, b, z)
SELECT low, sum((y = 1 AND prediction = 1)::INT)::BIGINT AS tp, sum((y = 0 AND prediction = 1)::INT)::BIGINT AS fp, sum((y = 1 AND prediction = 0)::INT)::BIGINT AS fn FROM p GROUP BY low""")
def ocr_boost_zones(spark, d):
    ocr = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text"))
    rows = O.recognised(labelled(spark, d).withColumn("id", F.col("doc_id")), ocr)
    return O.boosted_f1(rows, "y", "score", F.lower("ocr_text").contains("license"), [(x, x + 0.2) for x in (0.05, 0.1, 0.2)]).select("low", "tp", "fp", "fn")


@query(f"""SELECT doc_id, 'Category: ' || coalesce(lang, '') || chr(10) || 'Product name: ' || coalesce(source, '') || chr(10) || 'Description: ' || substr(coalesce(text, ''), 1, 2500) AS reference,
'Категория: ' || '{K.FLAMMABLE}' || chr(10) || 'Правила: ' || '{K.RULE_PROMPTS[K.FLAMMABLE]}' || chr(10) || 'Название: ' || coalesce(source, '') || chr(10) || 'Описание: ' || substr(coalesce(text, ''), 1, 2500) || chr(10) || chr(10) || 'Ответь строго одним символом: 1, если товар соответствует категории, иначе 0.' || coalesce(quality, 0) AS tuning
FROM documents LEFT JOIN labels USING (doc_id)""")
def reference_and_tuning_prompts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", P.reference_text(F.col("lang"), F.col("source"), F.col("text")).alias("reference"), P.training_prompt(F.lit(K.FLAMMABLE), F.col("source"), F.col("text"), F.coalesce("quality", F.lit(0))).alias("tuning"))


PICTURES = "SELECT doc_id AS id, (length(text) + 40)::INT AS w, (strlen(text) - length(text) + 30)::INT AS h FROM documents WHERE text IS NOT NULL"


@query(f"""WITH p AS ({PICTURES}), s AS (SELECT *, sqrt(200000.0::DOUBLE / (w * h)) AS k FROM p), c AS (SELECT id, CASE WHEN w * h <= 200000 THEN w ELSE greatest(28, floor(floor(w * k) / 28) * 28)::INT END AS width,
CASE WHEN w * h <= 200000 THEN h ELSE greatest(28, floor(floor(h * k) / 28) * 28)::INT END AS height, w, h FROM s), g AS (SELECT a AS columns, b AS rows FROM range(1, 7) x(a), range(1, 7) y(b) WHERE a * b <= 6),
t AS (SELECT id, columns, rows, row_number() OVER (PARTITION BY id ORDER BY round(abs(w::DOUBLE / h - columns::DOUBLE / rows), 9), columns * rows, columns, rows) AS r FROM p, g)
SELECT c.id, width, height, columns::INT AS columns, rows::INT AS rows, (columns * rows + (columns * rows > 1)::INT)::INT AS tiles FROM c JOIN t ON c.id = t.id AND r = 1""")
def picture_sizes_and_tiles(spark, d):
    """Sizes that texts give: as wide as they have characters, as high as they have further bytes."""
    rows = table(spark, d, "documents").where("text is not null")
    w, h = (F.length("text") + 40).cast("int"), (F.octet_length("text") - F.length("text") + 30).cast("int")
    made = rows.select(F.col("doc_id").alias("id"), Im.capped_size(w, h, 200_000).alias("s"), Im.tiling(w, h).alias("t"))
    return made.select("id", "s.width", "s.height", "t.columns", "t.rows", "t.tiles")


SHADES = "list_transform(embedding, lambda x: floor(least(greatest((x::DOUBLE + 1) * 127.5::DOUBLE, 0), 255))::INT)"


def _vector_pictures(spark, d, width: int, height: int, spread):
    """(path, content): each vector as a grey picture file, a shade for each component, dealt to the pixels by `spread`; files of label 3 lack their last byte."""
    shades = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))
    body = F.unhex(F.array_join(F.transform(spread(shades), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    whole = F.concat(F.lit(f"P5\n{width} {height}\n255\n").cast("binary"), body)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "label", whole.alias("whole"))
    return rows.select("path", F.when(F.col("label") == 3, F.expr("substring(whole, 1, length(whole) - 1)")).otherwise(F.col("whole")).alias("content"))


def _small_pictures(spark, d):
    """Nine pixels by eight: the components, and the first eight again."""
    return Im.decode(_vector_pictures(spark, d, 9, 8, lambda v: F.concat(v, F.slice(v, 1, 8))))


GRADIENTS = f"p AS (SELECT vec_id, label = 3 AS broken, list_concat({SHADES}, {SHADES}[1:8]) AS v FROM embeddings), b AS (SELECT vec_id, broken, list_transform(range(64), lambda k: CASE WHEN v[(k // 8 * 9 + k % 8 + 2)::INT] > v[(k // 8 * 9 + k % 8 + 1)::INT] THEN '01' ELSE '00' END) AS bits FROM p)"


@query(f"""WITH {GRADIENTS} SELECT count(*) AS sampled, sum(broken::INT)::BIGINT AS broken, sum((NOT broken)::INT)::BIGINT AS low_resolution, sum((NOT broken)::INT)::BIGINT - count(DISTINCT CASE WHEN NOT broken THEN array_to_string(bits, '') END) AS duplicate_hashes,
9.0::DOUBLE AS median_width, 8.0::DOUBLE AS median_height FROM b""")
def picture_audit(spark, d):
    return Im.picture_audit(_small_pictures(spark, d))


@query(f"WITH {GRADIENTS} SELECT vec_id::VARCHAR AS path, CASE WHEN NOT broken THEN sha256(unhex(array_to_string(bits, ''))) END AS dhash FROM b")
def picture_hashes(spark, d):
    return _small_pictures(spark, d).select("path", "picture.dhash")


@query(f"""WITH x AS (SELECT vec_id // 3 AS card, vec_id, label = 3 AS broken, unnest({SHADES}) / 255.0::DOUBLE AS v FROM embeddings), q AS (SELECT card, vec_id, broken, v FROM x, range(12)),
p AS (SELECT card, vec_id, broken, avg(v) AS mean, quantile_cont(v, 0.9) AS high FROM q GROUP BY card, vec_id, broken)
SELECT card::VARCHAR AS id, max((NOT broken)::INT) = 1 AS present, sum(broken::INT)::BIGINT AS broken, round(coalesce(avg(CASE WHEN NOT broken THEN mean END), 0), 6) AS first_feature, round(coalesce(avg(CASE WHEN NOT broken THEN high END), 0), 6) AS last_feature,
CASE WHEN max((NOT broken)::INT) = 1 THEN round(ln(17), 6) ELSE 0 END AS log_width, CASE WHEN max((NOT broken)::INT) = 1 THEN 1.0::DOUBLE ELSE 0 END AS aspect, CASE WHEN max((NOT broken)::INT) = 1 THEN 1.0::DOUBLE ELSE 0 END AS small FROM p GROUP BY card""")
def card_pictures(spark, d):
    """Three vectors a card, each as a picture of 16 by 16 pixels with every component four times."""
    decoded = Im.decode(_vector_pictures(spark, d, 16, 16, lambda v: F.flatten(F.transform(v, lambda x: F.array_repeat(x, 4)))))
    cards = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).cast("long").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.col("vec_id").cast("string"))).alias("images"))
    made = Im.card_pictures(cards, decoded)
    return made.select("id", "present", "broken", r6(F.col("features")[0]).alias("first_feature"), r6(F.col("features")[8]).alias("last_feature"), *[r6(F.col("stats")[k]).alias(n) for k, n in ((0, "log_width"), (2, "aspect"), (3, "small"))])


# --- candidate signals ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {SCORED}, w AS (SELECT unnest({list(Ca.WEIGHTS)})::DOUBLE AS weight), c AS (SELECT unnest(['vlm_probability', 'short']) AS candidate),
g AS (SELECT category, y, candidate, weight, lex, CASE WHEN candidate = 'short' THEN CASE WHEN n_chars >= 100 THEN 50.0::DOUBLE / n_chars END ELSE vlm END AS p FROM sc, c, w UNION ALL SELECT category, y, '', 0, lex, lex FROM sc),
b AS (SELECT category, y, candidate, weight, round(1 / (1 + exp(-((1 - weight) * {_lo('lex')} + weight * {_lo('coalesce(p, lex)')}))), 12) AS p FROM g),
st AS (SELECT category, candidate, weight, p, sum(y) AS p1, count(*) AS n1 FROM b GROUP BY ALL),
ru AS (SELECT category, candidate, weight, p AS t, sum(p1) OVER v AS tp, sum(n1) OVER v - sum(p1) OVER v AS fp, sum(p1) OVER (PARTITION BY category, candidate, weight) - sum(p1) OVER v AS fn FROM st WINDOW v AS (PARTITION BY category, candidate, weight ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT *, round({_f()}, 12) AS f1, row_number() OVER (PARTITION BY category, candidate ORDER BY round({_f()}, 12) DESC, weight, t) AS k FROM ru), be AS (SELECT * FROM ra WHERE k = 1)
SELECT be.category, be.candidate, be.weight, round(be.t, 6) AS threshold, round(be.f1, 6) AS f1, round(be.f1 - a.f1, 6) AS gain FROM be JOIN be a ON a.category = be.category AND a.candidate = '' WHERE be.candidate <> ''""")
def candidate_blends(spark, d):
    """Two candidate signals against the base score of each category; one of them is missing for short documents."""
    short = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 100, 50.0 / F.col("n_chars")).alias("short"))
    rows = _scored(spark, d).join(short, "doc_id")
    made = Ca.candidate_report(Ca.candidate_grid(rows, "y", "lexical_probability", ["vlm_probability", "short"], ["category"]), ["category"])
    return made.select("category", "candidate", "weight", r6("threshold").alias("threshold"), r6("f1").alias("f1"), r6("gain").alias("gain"))


# --- functions on the texts that the tables hold -------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), w AS (SELECT *, regexp_extract(text, '(?:^|[^0-9])([01])(?:[^0-9]|$)', 1) AS lone, lower(trim(text)) AS low FROM t)
SELECT conv_id, turn, CASE WHEN lone = '' THEN -1 ELSE lone::INT END AS verdict, CASE WHEN starts_with(low, 'yes') THEN 0.9 WHEN starts_with(low, 'no') THEN 0.1 WHEN contains(left(low, 20), 'yes') THEN 0.8 WHEN contains(left(low, 20), 'no') THEN 0.2 ELSE 0.5 END::DOUBLE AS yes_probability FROM w""")
def verdicts_in_turns(spark, d):
    """Every turn of every conversation read as an answer."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.parse_verdict(F.col("text")).alias("verdict"), X.yes_probability(F.col("text")).alias("yes_probability"))


@query(r"""WITH t AS (SELECT doc_id, [trim(x) for x in string_split(trim(coalesce(text, '')), chr(10)) if trim(x) <> ''] AS items FROM documents) SELECT doc_id, len(items)::INT AS n, sha256(array_to_string(items, '|')) AS digest FROM t""")
def lines_as_lists(spark, d):
    """Every document as a cell of a list whose separator is the end of a line."""
    items = X.parse_list(F.col("text"), "\n")
    return table(spark, d, "documents").select("doc_id", items.alias("i")).select("doc_id", F.size("i").alias("n"), F.sha2(F.array_join("i", "|"), 256).alias("digest"))


@query("SELECT doc_id, lang IN ('en', 'fr') AND n_chars <= 2000 AND text IS NOT NULL AS accepted FROM documents")
def decisions_with_texts(spark, d):
    """A decision in JSON of every document: its language as the label, its length as the confidence, its text as evidence and reason."""
    raw = F.to_json(F.struct(F.array("lang").alias("predicted_labels"), F.create_map("lang", F.col("n_chars") / F.lit(2000.0)).alias("confidence"), F.array("text").alias("evidence_text"), F.array().cast("array<string>").alias("evidence_image"), F.col("text").alias("reason_short")))
    parsed, reason = P.decision_json(F.col("raw"), ["en", "fr"])
    return table(spark, d, "documents").select("doc_id", raw.alias("raw")).select("doc_id", reason.isNull().alias("accepted"))


# --- vectors ------------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id, b.id AS ref_id, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT id, ref_id, s, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, ref_id) AS k FROM s) SELECT id, (k - 1)::INT AS place, ref_id, round(s, 6) AS similarity FROM r WHERE k <= 4""")
def retrieved_examples(spark, d):
    """The four nearest references of every query row (ids divisible by 50) among all rows but itself."""
    rows = _bank(spark, d)
    return V.most_similar(rows.where("id % 50 = 0"), rows, 4, exclude_own=True).select("id", "place", "ref_id", r6("similarity").alias("similarity"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT id, k, (id + k) % 3 <> 0 AS on_, list_slice(e, 16 * k + 1, 16 * k + 16) AS s FROM e, range(4) r(k)),
m AS (SELECT id, p, avg(s[p]) AS x FROM t, range(1, 17) q(p) WHERE on_ GROUP BY id, p), l AS (SELECT id, arg_max(s, k) AS s FROM t WHERE on_ GROUP BY id)
SELECT m.id, round(sum(x * p), 6) AS mean_sum, round(any_value(list_sum(s)), 6) AS last_sum FROM m JOIN l USING (id) GROUP BY m.id""")
def token_state_pooling(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)]).alias("s"), F.array(*[((F.col("vec_id") + k) % 3 != 0).cast("int") for k in range(4)]).alias("m"))
    mean, last = En.masked_mean(F.col("s"), F.col("m")), En.last_token(F.col("s"), F.col("m"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", r6(total(F.transform(mean, lambda x, k: x * (k + 1)))).alias("mean_sum"), r6(total(last)).alias("last_sum"))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (label < 5)::INT AS y, vec_id % 40 AS g FROM embeddings), f AS (SELECT id, e, y, seed, CAST(('0x' || substr(md5(seed || '/' || g), 1, 8))::BIGINT % 5 AS INT) AS f FROM e, (SELECT unnest({list(K.KNN_SEEDS)}) AS seed)),
s AS (SELECT e1.id, e2.id AS rid, list_cosine_similarity(e1.e, e2.e) AS s FROM e e1, e e2), m AS (SELECT a.seed, a.id, max(CASE WHEN b.y = 1 THEN s END) - max(CASE WHEN b.y = 0 THEN s END) AS m FROM f a JOIN f b ON a.seed = b.seed AND a.f <> b.f JOIN s ON s.id = a.id AND s.rid = b.id GROUP BY a.seed, a.id)
SELECT id, round(avg(m), 6) AS margin FROM m GROUP BY id""")
def seed_averaged_margin(spark, d):
    rows = _bank(spark, d).withColumn("g", F.col("id") % 40)
    return V.fold_excluded_margin(rows, None, "id", "g", "embedding", "label", K.KNN_SEEDS).select("id", r6("margin").alias("margin"))


ORACLES["knn_fusion_grid"] = f"""WITH {SCORED}, m AS (SELECT *, ((doc_id * 13) % 41 - 20) / 1000.0::DOUBLE AS margin FROM sc), c AS (SELECT DISTINCT unnest(quantile_cont(margin, [0.5, 0.75, 0.9, 0.95])) AS center FROM m),
g AS (SELECT * FROM c, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS knn_alpha), (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS margin_scale)),
b AS (SELECT knn_alpha, margin_scale, center, y, round(1 / (1 + exp(-((1 - knn_alpha) * ({_lo('lex')} - {_lo('0.3::DOUBLE')}) + knn_alpha * (margin - center) / margin_scale))), 12) AS p FROM m, g),
st AS (SELECT knn_alpha, margin_scale, center, p, sum(y) AS p1, count(*) AS n1 FROM b GROUP BY ALL),
ru AS (SELECT knn_alpha, margin_scale, center, p AS t, sum(p1) OVER w AS tp, sum(n1) OVER w - sum(p1) OVER w AS fp, sum(p1) OVER (PARTITION BY knn_alpha, margin_scale, center) - sum(p1) OVER w AS fn FROM st WINDOW w AS (PARTITION BY knn_alpha, margin_scale, center ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT *, {_f()} AS f1, row_number() OVER (PARTITION BY knn_alpha, margin_scale, center ORDER BY round({_f()}, 12) DESC, t) AS k FROM ru)
SELECT knn_alpha, margin_scale, round(center, 6) AS center, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM ra WHERE k = 1"""

ORACLES["canonical_schema_infer"] = """SELECT table_name AS source, 'label' AS role, column_name AS "column" FROM information_schema.columns
WHERE table_schema = 'main' AND table_name IN ('documents', 'part', 'labels', 'embeddings') AND column_name IN ('label', 'quality')"""

ORACLES["submission_contract"] = f"""WITH {LABELLED} SELECT count(*) - count(DISTINCT doc_id) AS duplicate_or_null_ids, sum((NOT coalesce(prediction IN (0, 1), false))::INT)::BIGINT AS bad_format, sum((doc_id IS NULL)::INT)::BIGINT AS out_of_place FROM labelled"""


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (label < 5)::INT AS y FROM embeddings), s AS (SELECT a.id, b.id AS rid, b.y, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON a.id <> b.id),
n AS (SELECT id, max(s) AS nearest, arg_max(y, struct_pack(s := round(s, 12), r := -rid)) AS label FROM s GROUP BY id)
SELECT id, CASE WHEN nearest >= 0.5 THEN label ELSE (id % 10 < 4)::INT END AS prediction, round(CASE WHEN nearest >= 0.5 THEN label ELSE (id % 10) / 10.0 END::DOUBLE, 6) AS probability FROM n""")
def nearest_label_override(spark, d):
    rows = _bank(spark, d)
    made = V.knn_margin(rows, rows, query_fold="id", ref_fold="id").withColumns({"category": F.lit(K.FLAMMABLE), "probability": F.col("id") % 10 / F.lit(10.0), "prediction": (F.col("id") % 10 < 4).cast("int")})
    return Fu.apply_nearest(made, K.FLAMMABLE, 0.5).select("id", "prediction", r6("probability").alias("probability"))


@query("SELECT vec_id, true AS unit, true AS orthogonal FROM embeddings")
def principal_invariants(spark, d):
    """What is left without the first two directions has unit length and no part along them."""
    rows = table(spark, d, "embeddings")
    fitted = V.fit_principal(rows, "embedding", 2)
    made = V.remove_components(rows, "embedding", fitted)
    along = [F.abs(A.dot(F.col("projected"), F.array(*[F.lit(float(x)) for x in axis]))) < 1e-6 for axis in fitted[1]]
    return made.select("vec_id", (F.abs(A.norm(F.col("projected")) - 1) < 1e-6).alias("unit"), (along[0] & along[1]).alias("orthogonal"))
