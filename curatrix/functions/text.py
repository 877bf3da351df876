"""Text scalars: normalisers, rule tokens, list and label parsing, comments and result strings.

Every function takes and returns columns made of built-in expressions, so it stays inside whole-stage
code generation; the one exception, exact_title_key, needs Unicode normalisation, which Spark lacks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions import constants as K


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stringify(c: Column, kind: str = "string") -> Column:
    """Null to "", containers to JSON (maps with sorted keys), all else to its trimmed text."""
    if kind.startswith("map"):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit(""))
    if kind.startswith(("array", "struct")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.trim(blank(c))


def compose_text(fields: Mapping[str, Column]) -> Column:
    """'[ROLE] value' of the fields that aren't empty, in their order."""
    return F.concat_ws(" ", *[F.when(v != "", F.concat(F.lit(f"[{role.upper()}] "), v)) for role, v in fields.items()])


def group_key(c: Column) -> Column:
    """Key for grouping copies: lower case, tags and everything but Latin, Cyrillic and digits to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "<[^>]+>", " "), "[^a-zа-яё0-9]+", " "))


def title_key(c: Column) -> Column:
    """Key for titles: like group_key without tag removal, and ё counts as е. Exact for text that NFKC leaves alone."""
    return F.trim(F.regexp_replace(F.translate(F.lower(blank(c)), "ё", "е"), "[^a-zа-я0-9]+", " "))


def exact_title_key(c: Column) -> Column:
    """title_key with full Unicode compatibility normalisation and case folding (Arrow batches)."""
    import re
    import unicodedata

    import pyarrow as pa

    def fold(values: pa.Array) -> pa.Array:
        out = [re.sub("[^a-zа-я0-9]+", " ", unicodedata.normalize("NFKC", v or "").casefold().replace("ё", "е")).strip() for v in values.to_pylist()]
        return pa.array(out, pa.string())

    fold.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(fold, "string")(c)


def leakage_key(c: Column) -> Column:
    """Key for overlaps between splits: lower case, white space collapsed."""
    return F.regexp_replace(F.lower(blank(c)), r"\s+", " ")


def head_key(c: Column, length: int = 800) -> Column:
    return F.when(F.length(c) >= length, F.left(c, F.lit(length)))


def tail_key(c: Column, length: int = 400, least: int = 800) -> Column:
    return F.when(F.length(c) >= least, F.right(c, F.lit(length)))


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with Unicode classes and boundaries, which Java leaves off by default."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(blank(c), "<[^>]+>", " ")


def rule_tokens(c: Column, families: Mapping[str, Iterable[str]], prefix: str = " __RULE_") -> Column:
    """Tag-free text with a token appended for each family that occurs in its lower-cased form."""
    text = strip_tags(c)
    low = F.lower(text)
    return F.concat(text, *[F.when(low.rlike(unicode_pattern(any_of(p))), F.lit(f"{prefix}{name.upper()}__")).otherwise("") for name, p in families.items()])


def category_rule_tokens(text: Column, category: Column) -> Column:
    """rule_tokens by the row's category; rows of other categories get their tag-free text."""
    out = strip_tags(text)
    for name, families in K.RULE_FAMILIES.items():
        out = F.when(category == name, rule_tokens(text, families)).otherwise(out)
    return out


def title_rule_label(key: Column, rules=K.TITLE_RULES, names: Iterable[str] = K.SHIPPED_RULES) -> Column:
    """Label of the last listed rule that matches the title key, else null."""
    chosen = set(names)
    hits = [F.when(key.rlike(unicode_pattern(p)), F.lit(label)) for name, p, label in rules if name in chosen]
    return F.coalesce(*reversed(hits))


def keyword_flags(c: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    low = F.lower(blank(c))
    return {name: low.rlike(unicode_pattern(p)).cast("double") for name, p in patterns.items()}


def evidence_flags(c: Column, category: str) -> Column:
    return F.array(*[blank(c).rlike(unicode_pattern(p, True)) for p, _ in K.EVIDENCE[category]])


def deterministic_comment(category: Column, title: Column, description: Column, label: Column) -> Column:
    """A grounded comment from the first evidence that supports the label; null for other categories. Its sentences are fixed values."""
    text = F.concat_ws(" ", blank(title), blank(description))
    positive = label == 1

    def seen(kind: str, k: int) -> Column:
        return text.rlike(unicode_pattern(K.EVIDENCE[kind][k][0], True))

    def said(kind: str, k: int) -> Column:
        return F.lit(K.EVIDENCE[kind][k][1])

    a, b = K.CATEGORIES
    marking = F.when(seen(a, 0), said(a, 0)).otherwise("прямая маркировка БАД в данных карточки и на изображениях")
    supplement = (
        F.when(positive, F.concat(F.lit("Карточка соответствует правилам категории: обнаружена "), marking, F.lit(".")))
        .when(seen(a, 1), F.concat(F.lit("Карточка не соответствует правилам БАД: обнаружены "), said(a, 1), F.lit(", а обязательная прямая маркировка не подтверждена.")))
        .when(seen(a, 2), F.concat(F.lit("Карточка не соответствует правилам БАД: в данных есть "), said(a, 2), F.lit(".")))
        .otherwise("В карточке не подтверждена обязательная прямая маркировка БАД или dietary supplement, поэтому товар не проходит требования категории.")
    )
    source = F.when(seen(b, 0), said(b, 0)).when(seen(b, 1), said(b, 1)).otherwise("источник огня, горючее содержимое или такой предмет в комплекте")
    against = F.when(seen(b, 2), said(b, 2)).when(seen(b, 3), said(b, 3))
    flammable = (
        F.when(positive, F.concat(F.lit("Карточка соответствует категории: указан "), source, F.lit(", то есть товар отвечает критериям легковоспламеняющегося.")))
        .when(against.isNotNull(), F.concat(F.lit("Товар не проходит правила категории: обнаружена "), against, F.lit("; самостоятельное горючее содержимое или источник огня не подтверждены.")))
        .otherwise("Название, описание и изображения не подтверждают самостоятельный источник огня, горючее вещество, газ или такой предмет в комплекте.")
    )
    return F.when(category == a, supplement).when(category == b, flammable)


def clean_comment(c: Column) -> Column:
    """Without reasoning blocks, tags and enclosing quotes; white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(blank(c), r"(?is)<think>.*?</think>", ""), "<[^>]+>", "")
    out = F.regexp_replace(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), '^"+|"+$', "")
    return F.trim(out)


def contradicts(comment: Column, label: Column) -> Column:
    """Whether a comment argues against its label. The patterns are fixed values."""
    low = F.translate(F.lower(blank(comment)), "ё", "е")
    against = low.rlike(r"(?U)(?:отрицательн.{0,12}класс|не\s+(?:соответствует|проходит|подтвержден|относится))")
    for_it = low.rlike(r"(?U)положительн.{0,12}класс") | low.rlike(r"(?U)(?<!не\s)соответствует\s+(?:категор|правил|критер)")
    return F.when(label == 1, against).otherwise(for_it)


def format_result(comment: Column, label: Column, pad: str = " Решение принято по названию, описанию и изображениям товара.") -> Column:
    """Comment of 50 to 300 characters between its tags, then the verdict; null where no padding or cutting makes it fit."""
    c = F.trim(F.regexp_replace(blank(comment), r"(?U)\s+", " "))
    c = F.trim(F.when(F.length(c) < 50, F.concat(c, F.lit(pad))).otherwise(c))
    cut = F.substring(c, 1, 300)
    cut = F.regexp_replace(F.when(cut.contains(" "), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut), "[ ,;:-]+$", "")
    c = F.when(F.length(c) > 300, cut).otherwise(c)
    out = F.concat(F.lit("<комментарий>"), c, F.lit("<вердикт>"), F.when(label == 1, "не бан").otherwise("бан"))
    return F.when(out.rlike(K.RESULT_PATTERN), out)


def parse_verdict(c: Column) -> Column:
    """The first lone 0 or 1 of an answer, -1 without one."""
    found = F.regexp_extract(blank(c), r"(?<!\d)([01])(?!\d)", 1)
    return F.when(found == "", -1).otherwise(found.cast("int"))


def yes_probability(c: Column) -> Column:
    """Probability from an answer in words: 0.9 or 0.1 where it begins with yes or no, 0.8 or 0.2 near its start, else 0.5."""
    low = F.lower(F.trim(blank(c)))
    near = F.substring(low, 1, 20)
    return F.when(low.startswith("yes"), 0.9).when(low.startswith("no"), 0.1).when(near.contains("yes"), 0.8).when(near.contains("no"), 0.2).otherwise(0.5)


def is_positive(c: Column) -> Column:
    """Whether a cell of an indicator column says yes; null says no."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*K.NEGATIVE_CELLS), F.lit(False))


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(blank(c), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def parse_list(c: Column, separator: str = "|") -> Column:
    """A JSON array if the cell begins with [ and parses as one, else its parts; trimmed, without empty ones."""
    t = F.trim(blank(c))
    parsed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    quoted = "\\Q" + separator + "\\E"
    parts = F.coalesce(parsed, F.split(t, quoted))
    return F.filter(F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit("None")))), lambda x: x != "")


def resolve_paths(paths: Column, base: str) -> Column:
    """Relative paths put under base; URLs and absolute paths as they are."""
    root = base.rstrip("/") + "/"
    return F.transform(paths, lambda p: F.when(p.rlike(r"^(https?://|/)"), p).otherwise(F.concat(F.lit(root), F.regexp_replace(p, r"^(\./)+", ""))))


def remap(labels: Column, values: Mapping[str, str]) -> Column:
    if not values:
        return labels
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.transform(labels, lambda x: F.coalesce(table[x], x))


def json_literal(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def binary_label(labels: Column) -> Column:
    """The first of a card's labels as a number; null without labels, and a failed query where it is no number."""
    return F.get(labels, F.lit(0)).cast("int")
