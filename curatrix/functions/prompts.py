"""Prompts and chat structures as columns. Their sentences are fixed values: an answer depends on every word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions import constants as K
from curatrix.functions.text import blank, json_literal


def _by_category(category: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in table.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def embedding_text(category: Column, title: Column, description: Column) -> Column:
    """Task context, category, title and the description's first 5,000 characters; null for unknown categories."""
    return F.concat(F.lit("Инструкция: "), _by_category(category, K.TASK_CONTEXT), F.lit("\nКатегория: "), category, F.lit("\nНазвание: "), blank(title), F.lit("\nОписание: "), F.substring(blank(description), 1, 5000))


def reference_text(category: Column, title: Column, description: Column) -> Column:
    return F.concat(F.lit("Category: "), blank(category), F.lit("\nProduct name: "), blank(title), F.lit("\nDescription: "), F.substring(blank(description), 1, 2500))


def chat(system: str, user: Column, with_image: bool = False, image: Column | None = None) -> Column:
    """[{role, content: [{type, text|image}]}] with the picture, if any, before the text."""
    part = lambda kind, text, picture: F.struct(F.lit(kind).alias("type"), text.alias("text"), picture.alias("image"))
    none = F.lit(None).cast("string")
    content = [part("image", none, image if image is not None else F.lit("placeholder"))] if with_image else []
    content.append(part("text", user, none))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.array(part("text", F.lit(system), none)).alias("content")),
        F.struct(F.lit("user").alias("role"), F.array(*content).alias("content")),
    )


def question(category: Column, title: Column, description: Column, chars: int = 2500) -> Column:
    """The zero-shot 0/1 question; null for unknown categories."""
    return F.concat(
        F.lit("Категория: "), category, F.lit("\nПравила: "), _by_category(category, K.RULE_PROMPTS), F.lit("\nНазвание: "), blank(title), F.lit("\nОписание: "), F.substring(blank(description), 1, chars),
        F.lit("\n\nОтветь строго одним символом: 1 если товар соответствует правилам указанной категории (не бан), иначе 0 (бан)."),
    )


def few_shot_question(category: Column, title: Column, description: Column, examples: Column, order=(0, 2, 1, 3)) -> Column:
    """The 0/1 question after four retrieved examples (array of title, description, label), classes interleaved."""
    shown = [
        F.concat(F.lit(f"Пример {n}\nНазвание: "), blank(examples[k]["title"]), F.lit("\nОписание: "), F.substring(blank(examples[k]["description"]), 1, 500), F.lit("\nПравильный ответ: "), examples[k]["label"].cast("string"))
        for n, k in enumerate(order, 1)
    ]
    return F.concat(
        F.lit("Категория: "), category, F.lit("\nПравила: "), _by_category(category, K.RULE_PROMPTS),
        F.lit("\n\nНиже приведены похожие товары с правильными ответами. Учитывай различия в составе и комплектности, не копируй ответ только из-за похожего названия.\n\n"),
        F.concat_ws("\n\n", *shown), F.lit("\n\nНовый товар\nНазвание: "), blank(title), F.lit("\nОписание: "), F.substring(blank(description), 1, 2500),
        F.lit("\n\nОтветь строго одним символом: 1, если новый товар соответствует категории, иначе 0."),
    )


def training_prompt(category: Column, title: Column, description: Column, label: Column, chars: int = 2500) -> Column:
    """The 0/1 question with its answer appended, for supervised tuning."""
    return F.concat(
        F.lit("Категория: "), category, F.lit("\nПравила: "), _by_category(category, K.RULE_PROMPTS), F.lit("\nНазвание: "), blank(title), F.lit("\nОписание: "), F.substring(blank(description), 1, chars),
        F.lit("\n\nОтветь строго одним символом: 1, если товар соответствует категории, иначе 0."), label.cast("string"),
    )


def explanation_prompt(category: Column, title: Column, description: Column, label: Column, example: Column) -> Column:
    verdict = F.when(label == 1, "соответствует категории и получает не бан").otherwise("не соответствует категории и получает бан")
    return F.concat(
        F.lit("Правило: "), _by_category(category, K.TASK_CONTEXT), F.lit("\nКатегория: "), category, F.lit("\nНазвание: "), F.substring(blank(title), 1, 500), F.lit("\nОписание: "), F.substring(blank(description), 1, 1400),
        F.lit("\nРешение классификатора: товар "), verdict,
        F.lit(".\nНапиши одно краткое объяснение по-русски длиной 70–200 символов. Не меняй решение, не придумывай фактов и не выводи теги. Если явного доказательства в тексте нет, используй нейтральную формулировку по названию, описанию и изображениям. Пример: "), example,
    )


#: The answer's fields, in order.
DECISION_FIELDS = ("predicted_labels", "confidence", "evidence_text", "evidence_image", "reason_short")


def audit_prompt(text: Column, allowed: list[str], rules: str = "") -> Column:
    """Structured audit request whose answer decision_json checks."""
    return F.concat(
        F.lit(f"You audit a marketplace product using its text and attached images.\nAllowed labels: {json_literal(allowed)}\nRules/context (may be empty): {rules}\nProduct text: "), blank(text),
        F.lit('\n\nReturn JSON only with exactly this schema:\n{\n  "predicted_labels": [],\n  "confidence": {},\n  "evidence_text": [],\n  "evidence_image": [],\n  "reason_short": ""\n}\nUse only allowed labels. Confidence values must be numbers from 0 to 1. Evidence must be short observations, not claims of ground truth. Do not invent a violation when evidence is absent.'),
    )


def decision_json(raw: Column, allowed: list[str]) -> tuple[Column, Column]:
    """(parsed decision or null, reason for rejection or null) of a structured answer.

    The answer may stand in a code fence. It must be an object of exactly the five fields with their
    types; labels and confidence keys must be allowed; confidences must be numbers from 0 to 1, not booleans.
    """
    body = F.regexp_replace(F.regexp_replace(F.trim(blank(raw)), r"^```[^\n]*\n", ""), r"\n```\s*$", "")
    tree = F.try_parse_json(body)
    kind = F.schema_of_variant(tree)
    keys = F.json_object_keys(body)
    shape = "predicted_labels array<string>, confidence map<string,string>, evidence_text array<string>, evidence_image array<string>, reason_short string"
    d = F.from_json(body, shape)
    known = F.array(*[F.lit(x) for x in allowed])

    def field(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))

    strings = lambda name: field(name).isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>")
    conf = F.map_entries(F.coalesce(d["confidence"], F.create_map().cast("map<string,string>")))
    number = lambda v: v.isNotNull() & v.rlike(r"^-?[0-9.]+([eE][+-]?[0-9]+)?$") & v.try_cast("double").between(0.0, 1.0)
    reason = (
        F.when(tree.isNull(), "not valid JSON")
        .when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)) | (F.array_sort(keys) != F.array(*[F.lit(x) for x in sorted(DECISION_FIELDS)])), "must contain exactly the five fields")
        .when(~F.coalesce(strings("predicted_labels"), F.lit(False)), "predicted_labels must be a list of strings")
        .when(F.size(F.array_except(d["predicted_labels"], known)) > 0, "Unknown predicted labels")
        .when(~F.coalesce(field("confidence").startswith("OBJECT"), F.lit(False)) | (F.size(F.array_except(F.map_keys(d["confidence"]), known)) > 0), "confidence must map allowed labels to probabilities")
        .when(F.coalesce(field("confidence").rlike(r": (BOOLEAN|STRING|ARRAY|OBJECT|VOID)"), F.lit(False)) | ~F.forall(conf, lambda e: number(e["value"])), "Invalid confidence")
        .when(~F.coalesce(strings("evidence_text") & strings("evidence_image"), F.lit(False)), "evidence must be lists of strings")
        .when(field("reason_short") != "STRING", "reason_short must be a string")
    )
    parsed = F.struct(d["predicted_labels"].alias("predicted_labels"), F.transform_values(d["confidence"], lambda _, v: v.try_cast("double")).alias("confidence"), d["evidence_text"].alias("evidence_text"), d["evidence_image"].alias("evidence_image"), d["reason_short"].alias("reason_short"))
    return F.when(reason.isNull(), parsed), reason
