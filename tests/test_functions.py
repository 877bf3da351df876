import numpy as np
import pytest
from conftest import one
from pyspark.sql import functions as F

from curatrix.functions import arrays as A
from curatrix.functions import constants as K
from curatrix.functions import hashing as H
from curatrix.functions import maths as M
from curatrix.functions import prompts as P
from curatrix.functions import text as X


def test_title_keys(spark):
    for text, key in (("Hello World", "hello world"), ("Тест!@#123", "тест 123"), ("ёлка", "елка"), ("  ", ""), (None, "")):
        c = F.lit(text).cast("string")
        assert one(spark, X.title_key(c), x=0) == key
        assert one(spark, X.exact_title_key(c), x=0) == key
    assert one(spark, X.exact_title_key(F.lit("Ⅳ ﬁne")), x=0) == "iv fine"


def test_group_key_keeps_yo_and_drops_tags(spark):
    assert one(spark, X.group_key(F.lit("<b>Ёлка</b> №1<br>Ok")), x=0) == "ёлка 1 ok"


def test_rule_tokens_by_category(spark):
    supplement = one(spark, X.category_rule_tokens(F.lit("БАД. Не является лекарством"), F.lit(K.SUPPLEMENT)), x=0)
    assert "__RULE_BAD_DIRECT__" in supplement
    lighter = one(spark, X.category_rule_tokens(F.lit("Зажигалка без газа"), F.lit(K.FLAMMABLE)), x=0)
    assert "__RULE_IGNITION_SOURCE__" in lighter and "__RULE_WITHOUT_CONTENT__" in lighter
    assert one(spark, X.category_rule_tokens(F.lit("<i>Чай</i>"), F.lit("other")), x=0).strip() == "Чай"


@pytest.mark.parametrize("title", ["Уголь древесный 5 кг", "Мангал одноразовый с углем", "Газ для портативной плиты", "Цветная дымовая шашка", "Брикеты для гриля"])
def test_shipped_rules_match(spark, title):
    assert one(spark, X.title_rule_label(X.title_key(F.lit(title))), x=0) == 1


@pytest.mark.parametrize("title", ["БАД Омега 3", "Витамин C", "Коллаген морской", "Угольный фильтр"])
def test_shipped_rules_leave_others(spark, title):
    assert one(spark, X.title_rule_label(X.title_key(F.lit(title))), x=0) is None


def test_later_rule_wins(spark):
    rules = (("a", "x", 1), ("b", "x", 0))
    assert one(spark, X.title_rule_label(F.lit("x"), rules, ("a", "b")), x=0) == 0


def test_list_parsing(spark):
    for cell, parts in (('["a.jpg", "b.jpg"]', ["a.jpg", "b.jpg"]), ("a.jpg|b.jpg", ["a.jpg", "b.jpg"]), (None, []), ("", []), ("[broken", ["[broken"])):
        assert one(spark, X.parse_list(F.lit(cell).cast("string")), x=0) == parts


def test_format_result_contract(spark):
    short = one(spark, X.format_result(F.lit("коротко"), F.lit(1)), x=0)
    assert short.startswith("<комментарий>коротко Решение принято") and short.endswith("<вердикт>не бан")
    long = one(spark, X.format_result(F.lit("слово " * 100), F.lit(0)), x=0)
    assert long.endswith("<вердикт>бан") and len(long) <= 300 + len("<комментарий><вердикт>бан")
    assert "слов<" not in long


def test_contradictions(spark):
    for text, label, answer in (("соответствует положительному классу", 0, True), ("не соответствует категории", 1, True), ("не соответствует категории", 0, False)):
        assert one(spark, X.contradicts(F.lit(text), F.lit(label)), x=0) is answer


def test_comments_fit_the_contract(spark):
    rows = spark.createDataFrame([(c, t, y) for c in K.CATEGORIES for t in ("БАД", "BCAA протеин", "Зажигалка без газа", "мангал", "чай") for y in (0, 1)], "c string, t string, y int")
    made = rows.select("y", X.deterministic_comment(F.col("c"), F.col("t"), F.lit(""), F.col("y")).alias("m")).collect()
    for r in made:
        assert 50 <= len(r["m"]) <= 300
    bad = rows.select(X.contradicts(X.deterministic_comment(F.col("c"), F.col("t"), F.lit(""), F.col("y")), F.col("y")).alias("b")).where("b").count()
    assert bad == 0


def test_answers(spark):
    assert one(spark, X.parse_verdict(F.lit("ответ: 1.")), x=0) == 1
    assert one(spark, X.parse_verdict(F.lit("10")), x=0) == -1
    assert one(spark, X.yes_probability(F.lit("No way")), x=0) == 0.1
    assert one(spark, X.clean_comment(F.lit('<think>a\nb</think> "x  <b>y</b>"')), x=0) == "x y"


def test_blends(spark):
    assert one(spark, M.raw_blend(F.lit(0.5), F.lit(0.8), F.lit(0.3)), x=0) == pytest.approx(0.55)
    p = one(spark, M.logit_blend(F.lit(0.5), F.lit(0.8), F.lit(0.5), F.lit(0.3), F.lit(0.4)), x=0)
    assert 0 < p < 1
    assert one(spark, M.sigmoid(M.logit(F.lit(0.25))), x=0) == pytest.approx(0.25)


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, A.l2_normalise(v(3, 4)), x=0) == [0.6, 0.8]
    assert one(spark, A.l2_normalise(v(0, 0)), x=0) == [0.0, 0.0]
    assert one(spark, A.cosine(v(1, 0), v(0, 0)), x=0) == 0.0
    assert one(spark, A.first_maximum(v(1, 3, 3)), x=0) == 1


def test_token_hash_vector_is_unit_and_stable(spark):
    a, b, empty = (np.array(one(spark, H.token_hash_vector(F.lit(t)), x=0)) for t in ("Чай чёрный", "чай ЧЁРНЫЙ", ""))
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not empty.any()


def test_table_fingerprint_ignores_order(spark):
    rows = [(i, f"t{i}") for i in range(50)]
    one_, two = (spark.createDataFrame(r, "id int, text string") for r in (rows, rows[::-1]))
    a, b = (H.table_fingerprint(d.repartition(3), ["id", "text"]).first() for d in (one_, two))
    assert a == b and len(a["fingerprint"]) == 20
    assert H.table_fingerprint(two.limit(49), ["id", "text"]).first() != a


def test_decision_contract(spark):
    ok = '{"predicted_labels":["a"],"confidence":{"a":0.9},"evidence_text":["x"],"evidence_image":[],"reason_short":"r"}'
    d, reason = P.decision_json(F.lit(ok), ["a", "b"])
    assert one(spark, reason, x=0) is None and one(spark, d, x=0)["confidence"] == {"a": 0.9}
    for raw, word in ((ok.replace('["a"]', '["z"]'), "Unknown"), (ok.replace("}", ',"k":1}', 2).replace(',"k":1}', "}", 1), "exactly"), (ok.replace("0.9", "true"), "confidence"), ("{", "JSON")):
        d, reason = P.decision_json(F.lit(raw), ["a", "b"])
        assert word in one(spark, reason, x=0) and one(spark, d, x=0) is None


def test_prompts(spark):
    assert one(spark, P.embedding_text(F.lit("other"), F.lit("t"), F.lit("d")), x=0) is None
    examples = F.array(*[F.struct(F.lit(f"t{k}").alias("title"), F.lit("d").alias("description"), F.lit(k % 2).alias("label")) for k in range(4)])
    shown = one(spark, P.few_shot_question(F.lit(K.FLAMMABLE), F.lit("t"), F.lit("d"), examples), x=0)
    assert shown.index("t0") < shown.index("t2") < shown.index("t1") < shown.index("t3")
