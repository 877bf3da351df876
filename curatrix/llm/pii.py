"""Personal data (operator 2): weak supervision over span candidates.

Four labelers (format, gazetteer, context, boundary) vote on every candidate span of every text.
Expectation-maximisation over the counts of vote patterns, which cover the whole corpus, estimates each
labeler's reliability per kind; the resulting probabilities train a final span classifier. Spans of the
base patterns always stay; the classifier decides on the further candidates.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import sha256_hex, short_batches, texts_udf

#: Kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "id", "secret", "name")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_AT = re.compile(r"[\[({<]\s?(?:at|AT|arroba)\s?[\])}>]\s?([A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}>]\s?)[A-Za-z0-9-]++)+)")
_AT_WORD = re.compile(r"(?<= )(?:at|AT) ([A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)+)")
_NATIONAL = re.compile(r"(?<![0-9.+/-])\(?[0-9]{2,5}\)?[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])")
_ASSIGNED = re.compile(r"(?i:password|passwd|passwort|pwd|token|secret|api[_-]?key)\s?[=:]\s?[\"']?([^\s\"']{6,})")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_TITLES = ("Mr", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "y name is", "ch heiße", "e m'appelle", "e llamo")
_TITLED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo)\.? ([A-ZÄÖÜÉÁÍÓÚÑ][a-zäöüßéèêáíóúñç]+(?: [A-ZÄÖÜÉÁÍÓÚÑ][a-zäöüßéèêáíóúñç]+)*)")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:19|20)[0-9]{2}")

# Gazetteers (fixed values).
_TLDS = set(
    "com org net edu gov mil int info biz name pro io co me tv app dev cloud online site shop store blog tech ai xyz "
    "at au be bg br ca ch cl cn cy cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr li lt lu lv mt mx nl no nz pe pl pt ro ru se si sk tr tw ua uk us za example test invalid".split()
)
_IBAN_LANDS = set("AD AE AL AT AZ BA BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT KW LB LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SA SE SI SK SM TN TR UA".split())
_GIVEN = set(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald peter "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley emily donna michelle carol amanda emma olivia laura anna julia alice jane "
    "hans klaus jürgen wolfgang dieter uwe stefan andreas lukas felix jonas maximilian sabine petra monika ursula karin heike claudia katharina lena sophie greta ingrid "
    "pierre jean michel philippe alain nicolas louis antoine julien marie claire nathalie isabelle sylvie catherine camille chloé léa hélène "
    "josé juan antonio manuel francisco javier carlos miguel pedro pablo alejandro carmen maría ana isabel lucía pilar dolores elena marta sofía".split()
)
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62|35")
_WORDS = {
    "email": "mail email e-mail contact kontakt correo courriel write schreib", "ip": "ip host server address adresse dirección adresse login", "card": "card karte carte tarjeta visa mastercard credit kredit",
    "phone": "phone tel telefon téléphone teléfono call mobile handy fax cell ruf", "id": "ssn social iban konto account passport ausweis security", "secret": "password token secret key credential passwd pwd", "name": "name called signed regards",
}
_CONTEXT = {k: re.compile("|".join(rf"\b{re.escape(w)}" for w in v.split())) for k, v in _WORDS.items()}
_AGAINST = re.compile(r"version|isbn|issn|chapter|figure|page|table|section|order|invoice|\$|€|%|\bv\b|\bno\b|\bart\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, sorted; code points, end exclusive.

    Equal to leftmost, non-overlapping matching of each pattern, written so that a long run of letters or
    digits is read once: an address is found from its @ and extended left to the end of the match before.
    """
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), 0))
                free = m.end()
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found)


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base patterns: obfuscated addresses, national numbers, ids, secrets, names."""
    found = []
    for pattern in (_AT, *[_AT_WORD] * (" dot " in text or " DOT " in text)):
        free = 0  # no text is read to the left of the match before
        for m in pattern.finditer(text):
            start = first = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < first:
                found.append((start, m.end(), 0))
            free = m.end()
    if _DIGIT.search(text):
        if text.count(":") >= 7:
            found += [(m.start(), m.end(), 1) for m in _IP6.finditer(text)]
        found += [(m.start(), m.end(), 3) for m in _NATIONAL.finditer(text) if not _SSN.fullmatch(m[0])]
        found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= sum(c.isdecimal() for c in m[0][:48]) <= 19]
        if "-" in text:
            found += [(m.start(), m.end(), 4) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), 4) for m in _IBAN.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), m.end(), 5) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), 5) for m in _ASSIGNED.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [(m.start(1), m.end(1), 6) for m in _TITLED.finditer(text)]
    return found


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: int) -> tuple[int, int, int, int]:
    """Each labeler's vote on a span: 1 for personal data, -1 against, 0 abstains."""
    value = text[start:end]
    digits = "".join(c for c in value if "0" <= c <= "9")
    name = KINDS[kind]
    shape = gazetteer = 0
    if name == "email":
        last = re.split(r"[^A-Za-z0-9-]+", value.strip())
        shape = 1 if "@" in value or re.search(r"(?i)\bat\b.*(?:\.|\bdot\b|punkt|point|punto)", value) else -1
        ends = [x for x in last if x]
        gazetteer = 1 if ends and ends[-1].lower() in _TLDS else -1
    elif name == "ip":
        parts = value.split(".")
        shape = 1 if len(parts) == 4 or value.count(":") == 7 else -1
        gazetteer = -1 if len(parts) == 4 and (int(parts[0][:9] or 0) in (0, 127) or all(len(p) == 1 for p in parts)) else 1
    elif name == "card":
        shape = 1 if luhn(digits) else -1
        gazetteer = 1 if _ISSUERS.match(digits) else -1
    elif name == "phone":
        date = _DATE.fullmatch(value)
        shape = 1 if value[0] == "+" and 9 <= len(digits) <= 15 else (0 if 9 <= len(digits) <= 12 and not date else -1)
        gazetteer = 1 if value[0] in "+(0" else -1 if date else 0
    elif name == "id":
        if value[0].isalpha():
            shape = 1 if _iban_ok(value) else -1
            gazetteer = 1 if value[:2] in _IBAN_LANDS else -1
        else:
            shape = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name == "secret":
        mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        shape = 1 if mixed >= 2 and len(value) >= 8 else -1
        gazetteer = 1 if value.startswith("AKIA") or re.fullmatch(r"[0-9a-f]{16,}", value) else 0
    else:
        gazetteer = 1 if value.split(" ")[0].lower() in _GIVEN else 0
        shape = 1 if " " in value else 0
    around = text[max(0, start - 40) : start].lower()
    context = 1 if _CONTEXT[name].search(around) else (-1 if _AGAINST.search(around[-14:]) else 0)
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    boundary = -1 if glued or (len(digits) >= 8 and len(set(digits)) <= 2) else 1
    return shape, gazetteer, context, boundary


def pattern(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """What the models see of a span: kind and four votes, and for the classifier alone its length class, its shape and its neighbours' classes."""
    start, end, kind = span
    return (kind, *votes(text, start, end, kind), min(3, (end - start) // 8), shape_of(text[start:end]), neighbour(text[start - 1 : start]), neighbour(text[end : end + 1]))


def shape_of(value: str) -> int:
    """0 digits and signs, 1 letters alone, 2 letters with blanks, 3 letters and signs, 4 letters and digits, 5 these and both cases."""
    letters, digits = any(c.isalpha() for c in value), any("0" <= c <= "9" for c in value)
    if not letters:
        return 0
    if digits:
        return 5 if value.lower() != value != value.upper() else 4
    return 1 if value.isalpha() else 2 if value.replace(" ", "").isalpha() else 3


def neighbour(c: str) -> int:
    """0 the text's end, 1 white space, 2 a sign that introduces or ends a value, 3 another sign, 4 a letter or digit."""
    return 0 if not c else 1 if c.isspace() else 4 if c.isalnum() else 2 if c in ":=,.;()<>[]\"'" else 3


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> np.ndarray:
    """Weights of the final classifier from pattern counts.

    Dawid-Skene on kind and votes, with one accuracy table per kind and labeler (votes -1, 0, 1 under either class), started
    at the majority vote, with pseudo-counts that expect labelers to be right; then a logistic model on the one-hot votes and
    kind, and on the length, shape and neighbours that no labeler reports, is fitted to the probabilities by Newton steps with a ridge.
    """
    keys = sorted(patterns)
    design = np.array([design_row(k) for k in keys]).reshape(-1, DESIGN)
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    if not keys:
        return np.zeros(DESIGN)
    kind = np.array([k[0] for k in keys])
    vote = np.array([k[1:5] for k in keys]) + 1
    p = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
    prior_yes, prior_no = np.array([2.0, 6.0, 12.0]), np.array([12.0, 6.0, 2.0])
    for _ in range(rounds):
        score = np.zeros(len(keys))
        for k in set(kind.tolist()):
            of = kind == k
            yes, no = (n * p)[of], (n * (1 - p))[of]
            rate = (yes.sum() + 1) / (n[of].sum() + 2)
            score[of] = np.log(rate / (1 - rate))
            for j in range(4):
                a = np.bincount(vote[of, j], yes, 3) + prior_yes
                b = np.bincount(vote[of, j], no, 3) + prior_no
                score[of] += np.log(a / a.sum())[vote[of, j]] - np.log(b / b.sum())[vote[of, j]]
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    w = np.zeros(DESIGN)
    weight = np.sqrt(n)  # a pattern seen a million times says hardly more than one seen a thousand times
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - q)) - 0.05 * w
        hess = (design * (weight * q * (1 - q))[:, None]).T @ design + 0.05 * np.eye(DESIGN)
        w += np.linalg.solve(hess, grad)
    return w


#: Values of each part of a pattern in the classifier's one-hot design: kind, votes, length, shape, the neighbours before and after.
PARTS = (len(KINDS), 3, 3, 3, 3, 4, 6, 5, 5)
DESIGN = 1 + sum(PARTS)


def design_row(key: tuple[int, ...]) -> np.ndarray:
    row, at = np.zeros(DESIGN), 1
    row[0] = 1
    for k, (value, size) in enumerate(zip(key, PARTS, strict=True)):
        row[at + value + (1 <= k <= 4)] = 1
        at += size
    return row


def fit_spans(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The final classifier's weights from the vote patterns of all candidates of all texts.

    A task sends one row for each pattern it saw: kinds x 81 votes x 4 lengths x 6 shapes x 25 neighbours at most, whatever the input.
    """

    short_batches(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    seen.update(pattern(x, s) for s in {*base_spans(x), *further_spans(x)})
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "p array<int>, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return estimate({tuple(r["p"]): r["n"] for r in counted.collect()})


def all_spans(text: str, weights: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """Base spans plus accepted candidates that overlap neither them nor a likelier candidate.

    A candidate is accepted at the threshold unless the format labeler votes against it (a failed
    checksum, a date): on no text may the others outvote that.
    """
    base = base_spans(text)
    scored = []
    for span in set(further_spans(text)) - set(base):
        seen = pattern(text, span)
        p = 1 / (1 + np.exp(-design_row(seen) @ weights))
        if p >= threshold and seen[1] >= 0:
            scored.append((-p, span))
    if not scored:
        return base
    taken = list(base)
    for _, span in sorted(scored):
        if all(span[1] <= s or span[0] >= e for s, e, _ in taken):
            taken.append(span)
    return sorted(taken)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping base spans fall to one."""
    kept, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            kept += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def find_pii(docs: DataFrame, text: str = "text", mask: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans added (same names are replaced).

    The counts and the digest are of the base spans; spans lists all spans. With mask the text itself is
    masked. Null and empty texts have no spans (a null text stays null); an empty table stays empty; repeated rows count each; long
    texts are searched whole; further columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_spans(docs, text))

    def per_text(x: str) -> tuple:
        base = base_spans(x)
        spans = all_spans(x, shared.value)
        kinds = Counter(k for _, _, k in base)
        out = (*(kinds.get(k, 0) for k in range(4)), sha256_hex(joined(base).encode()), joined(spans))
        return (*out, masked(x, spans)) if mask else out

    counts = [f"n_{k}" for k in BASE]
    fields = {**{c: pa.int64() for c in counts}, "base_sha256": pa.string(), "spans": pa.string()} | ({"masked": pa.string()} if mask else {})
    ddl = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in fields.items())
    made = docs.withColumn("__pii", texts_udf(per_text, ddl, fields)(F.col(text)))
    names = [*counts, "base_sha256", "spans"]
    if mask:
        made = made.withColumn(text, F.when(F.col(text).isNotNull(), F.col("__pii.masked")))
    return made.withColumns({c: F.col(f"__pii.{c}") for c in names}).drop("__pii")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with their own columns only, and personal data in the text replaced by the kind's name in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_spans(docs, text))
    hide = texts_udf(lambda x: (masked(x, all_spans(x, shared.value)),), "t string", {"t": pa.string()})
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), hide(F.col(text))["t"]))
