"""Personal-data masking as a chain of DataFrame steps.

Every stage works on the result of the one before, so later patterns see earlier placeholders.
Stages whose matches need a checksum split the text at the pattern and put each match back or its
placeholder. Digits are ASCII digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, luhn_valid, national_id_valid

# Placeholders and the shapes they stand for, in the order of application.
EMAIL, TOKEN, IP, CARD, NATIONAL_ID, PHONE = "[EMAIL]", "[TOKEN]", "[IP]", "[CARD]", "[NATIONAL_ID]", "[PHONE]"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
TOKEN_PATTERNS = (
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"(?i)\bBearer\s+[A-Za-z0-9._\-]+",
    r"\b(?:sk|pk|rk)[-_][A-Za-z0-9]{16,}\b",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b[0-9a-fA-F]{32,}\b",
)
IPV4_PATTERN = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
IPV6_PATTERN = (
    r"(?<![\p{L}\p{N}_:])(?:"
    r"(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})"
    r"|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})::"
    r")(?![\p{L}\p{N}_:])"
)
CARD_PATTERN = r"\b(?:[0-9][ -]?){13,19}\b"
NATIONAL_ID_PATTERN = r"\b[0-9]{11}\b"
PHONE_PATTERN = r"(?<![\p{L}\p{N}_.])(?:\+?[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{2,4}\)?[ .-]?)[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}(?![\p{L}\p{N}_.])"

STAGES = (
    (EMAIL, EMAIL_PATTERN, None),
    *((TOKEN, pattern, None) for pattern in TOKEN_PATTERNS),
    (IP, IPV4_PATTERN, None),
    (IP, IPV6_PATTERN, None),
    (CARD, CARD_PATTERN, luhn_valid),
    (NATIONAL_ID, NATIONAL_ID_PATTERN, national_id_valid),
    (PHONE, PHONE_PATTERN, None),
)
LABELS = (EMAIL, TOKEN, IP, CARD, NATIONAL_ID, PHONE)


def _bound(value: Column, use) -> Column:
    """use(value) with the value bound to a variable: a chain of stages stays linear in size however often each uses it."""
    return F.get(F.transform(F.array(value), use), 0)


def _stage(text: Column, label: str, pattern: str, valid) -> Column:
    """struct(t: the text after the stage, n: its replacements)."""
    if valid is None:
        n = F.regexp_count(text, F.lit(pattern))
        return F.struct(F.regexp_replace(text, pattern, label).alias("t"), n.alias("n"))
    pieces = F.split(text, pattern, -1)

    def replaced(matches: Column) -> Column:
        after = F.transform(matches, lambda m: F.when(valid(digits(m)), F.lit(label)).otherwise(m))
        return _bound(after, lambda r: F.struct(
            F.array_join(F.zip_with(pieces, r, lambda piece, x: F.concat(piece, F.coalesce(x, F.lit("")))), "").alias("t"),
            F.size(F.filter(r, lambda x: x == label)).alias("n"),
        ))

    return _bound(F.regexp_extract_all(text, F.lit(pattern), 0), replaced)


def masked(text: Column, stages=STAGES) -> Column:
    """struct(text, counts): the text after all stages and the replacements of each."""

    def after(i: int, t: Column, counts: list[Column]) -> Column:
        if i == len(stages):
            return F.struct(t.alias("text"), F.array(*counts).alias("counts"))
        return _bound(_stage(t, *stages[i]), lambda s: after(i + 1, s["t"], [*counts, s["n"]]))

    return after(0, text, [])


def mask(df: DataFrame, text_col: str = "text", *, stages=STAGES, counts_col: str = "redactions") -> DataFrame:
    """``df`` with the text masked and a map of label to count (labels that hit, in order of their stages)."""
    out = df.withColumn("_m", F.when(F.col(text_col).isNotNull(), masked(F.col(text_col), stages)))
    places: dict[str, list[int]] = {}
    for i, (label, _, _) in enumerate(stages):
        places.setdefault(label, []).append(i)
    total = lambda of: sum((F.coalesce(F.get(F.col("_m.counts"), i), F.lit(0)) for i in of), F.lit(0)).cast("int")
    entries = F.array(*(F.struct(F.lit(label).alias("key"), total(of).alias("value")) for label, of in places.items()))
    return out.withColumns({text_col: F.col("_m.text"), counts_col: F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))}).drop("_m")
