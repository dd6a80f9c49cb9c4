"""Prompt-injection guard, text normalisation, risk score, and the output guard."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, entropy_terms, iban_valid, jaccard, luhn_valid, national_id_valid, sentences, token_set
from .mask import CARD_PATTERN, NATIONAL_ID_PATTERN

# Pattern groups in the order of their check.
INJECTION = (
    ("instruction_override", r"(?i)\b(ignore|disregard|forget)\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|rules?)\b"),
    ("persona_override", r"(?i)\byou\s+are\s+now\b|\back\s+as\b.{0,20}\bDAN\b|\bjailbreak\b|\bDAN\s+mode\b"),
    ("role_switch", r"(?im)^\s*(system|assistant|user)\s*:"),
    ("special_token", r"<\|im_start\|>|<\|im_end\|>|\[/?INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>"),
    ("prompt_leak", r"(?i)\b(reveal|print|show|display|repeat)\b.{0,30}\bsystem\s+prompt\b"),
)
# Weights of the score.
GROUP_WEIGHTS = {"instruction_override": 0.35, "persona_override": 0.35, "role_switch": 0.20, "special_token": 0.20, "prompt_leak": 0.20}
KEYWORDS = (
    "ignore previous", "disregard previous", "act as", "pretend you are", "developer mode", "unlock mode", "bypass your", "override your", "reveal your", "no restrictions",
    "sistem promptu", "önceki talimatları yoksay", "talimatları görmezden gel", "rol yap", "gizli talimat", "geliştirici modu", "kısıtlamaları kaldır", "artık sınırsız", "kurallarını yoksay", "kurallarını unut",
)
KEYWORD_WEIGHT, KEYWORD_CAP = 0.15, 0.30
MIMICRY = (r'(?i)"role"\s*:\s*"(system|assistant)"', r"(?is)<system>.*?</system>", r"(?i)```\s*(system|instruction)")
MIMICRY_WEIGHT = 0.20
ENTROPY_LEAST_LENGTH, ENTROPY_FROM, ENTROPY_WEIGHT = 20, 4.2, 0.15
SCRIPT_WEIGHT = 0.15
LENGTH_FROM, LENGTH_WEIGHT = 2000, 0.05
DENSE_CHARACTERS, DENSITY_FROM, DENSITY_WEIGHT = "{}<>|`", 0.03, 0.10
# Characters without a glyph; look-alikes of Latin letters; delimiters of chat templates.
ZERO_WIDTH = "​‌‍﻿⁠⁡⁢⁣⁤"
LOOKALIKES = (
    "аАеЕоОрРсСхХуУіІѕЅјЈкКмМнНтТвВ" + "αΑβΒοΟρΡνΝκΚτΤιΙυΥ",
    "aAeEoOpPcCxXyYiIsSjJkKmMhHtTbB" + "aAbBoOpPvNkKtTiIuY",
)
CHAT_DELIMITERS = ("<|im_start|>", "<|im_end|>", "</system>", "</user>", "</assistant>", "[SYSTEM]", "[USER]", "[ASSISTANT]", "---", "###")
#: Longest first, so that none leaves a piece of a longer one.
DELIMITERS = "(?i)" + "|".join(re.escape(d) for d in sorted(CHAT_DELIMITERS, key=len, reverse=True))
IBAN_PATTERN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b"
CANARY_PIECE = 8
SCRIPTS = (r"[\x{0370}-\x{03FF}&&\p{L}]", r"[\x{0400}-\x{04FF}&&\p{L}]", r"[\x{0600}-\x{06FF}&&\p{L}]", r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}&&\p{L}]")


def injection_reason(text: Column) -> Column:
    """Name of the first matching group, or "ok"; null and empty texts are ok."""
    reason = F.lit("ok")
    for name, pattern in reversed(INJECTION):
        reason = F.when(text.rlike(pattern), name).otherwise(reason)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "ok").otherwise(reason)


def nfkc(text: Column) -> Column:
    """Unicode normal form KC; Spark has no such function, so an Arrow function does it. ASCII texts are their own form and are sent as nulls."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(run(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


def fold(text: Column) -> Column:
    """Drop zero-width characters, fold look-alikes, strip delimiters, collapse runs of three or more punctuation marks."""
    out = F.translate(F.regexp_replace(text, f"[{ZERO_WIDTH}]", ""), *LOOKALIKES)
    return F.regexp_replace(F.regexp_replace(out, DELIMITERS, ""), r"([!?.,;:])\1{2,}", "$1")


def normalise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with normalised, raw_length, normalised_length and drift (their difference)."""
    out = df.withColumn("_k", nfkc(F.col(text_col))).withColumn("normalised", fold(F.col("_k"))).drop("_k")
    lengths = {"raw_length": F.coalesce(F.length(text_col), F.lit(0)), "normalised_length": F.coalesce(F.length("normalised"), F.lit(0))}
    return out.withColumns(lengths).withColumn("drift", F.abs(F.col("raw_length") - F.col("normalised_length")))


def score_features(text: Column) -> dict[str, Column]:
    """Contribution of each feature of the rule score, 0 where absent."""
    low, length = F.lower(text), F.length(text)
    on = lambda condition, weight: F.when(condition, float(weight)).otherwise(0.0)
    out = {f"regex_{name}": on(text.rlike(pattern), GROUP_WEIGHTS[name]) for name, pattern in INJECTION}
    hits = F.get(F.transform(F.array(low), lambda t: sum((F.contains(t, F.lit(k)).cast("int") for k in KEYWORDS), F.lit(0))), 0)
    out["keyword_hits"] = F.least(F.lit(KEYWORD_CAP), hits * KEYWORD_WEIGHT)
    mimics = F.lit(False)
    for pattern in MIMICRY:
        mimics = mimics | text.rlike(pattern)
    out["format_mimicry"] = on(mimics, MIMICRY_WEIGHT)
    above = F.least(F.lit(ENTROPY_WEIGHT), F.greatest(F.lit(0.0), entropy_terms(text) - ENTROPY_FROM) * ENTROPY_WEIGHT)
    out["entropy"] = F.when(length >= ENTROPY_LEAST_LENGTH, above).otherwise(0.0)
    other = F.lit(False)
    for script in SCRIPTS:
        other = other | text.rlike(script)
    out["script_mixing"] = on(text.rlike(r"[\x{0000}-\x{024F}&&\p{L}]") & other, SCRIPT_WEIGHT)
    out["length_abnormality"] = on(length > LENGTH_FROM, LENGTH_WEIGHT)
    dense = length - F.length(F.translate(text, DENSE_CHARACTERS, ""))
    out["punct_density"] = on((length > 0) & (dense / length > DENSITY_FROM), DENSITY_WEIGHT)
    return out


def rule_score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with score (sum of contributions, 1 at most) and top_features (the five largest, first of equals first)."""
    names = {f"_{name}": c for name, c in score_features(F.col(text_col)).items()}
    out = df.withColumns(names)
    entries = F.array(*(F.struct((-F.col(c)).alias("minus"), F.lit(i).alias("i"), F.lit(c[1:]).alias("name")) for i, c in enumerate(names)))
    top = F.slice(F.array_sort(F.filter(entries, lambda e: e["minus"] < 0)), 1, 5)
    out = out.withColumn("score", F.least(F.lit(1.0), sum((F.col(c) for c in names), F.lit(0.0))))
    return out.withColumn("top_features", F.transform(top, lambda e: F.struct(e["name"].alias("name"), (-e["minus"]).alias("weight")))).drop(*names)


def zone(stage1: Column, *, ran: Column, degraded: Column, label: Column, confidence: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """pass, restricted or reject from the stage-1 score and the optional stage-2 verdict."""
    uncertain = F.coalesce(ran & (label == "safe") & (confidence < 0.7), F.lit(False))
    return (
        F.when(F.coalesce(degraded, F.lit(False)), "restricted")
        .when(F.coalesce(ran & (label == "unsafe"), F.lit(False)), "reject")
        .when(stage1 >= high, "reject")
        .when(uncertain | (stage1 >= low), "restricted")
        .otherwise("pass")
    )


def ungrounded(answer: Column, contexts: Column, threshold: float) -> Column:
    """Cited tags, in order of number, whose best sentence has a token similarity below the threshold to its context."""
    parts = sentences(answer)
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[S([0-9]+)\]"), 1), lambda n: n.try_cast("int"))))
    valid = F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(contexts)))

    def best(n: Column) -> Column:
        citing = F.filter(parts, lambda s: F.contains(s, F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))))
        return F.array_max(F.transform(citing, lambda s: jaccard(token_set(s), token_set(F.get(contexts, n - 1)), 1.0)))

    return F.transform(F.filter(valid, lambda n: F.coalesce(best(n) < threshold, F.lit(False))), lambda n: F.concat(F.lit("S"), n.cast("string")))


def canary_leaked(answer: Column, canary: Column) -> Column:
    """The whole canary or any piece of eight of its characters occurs in the answer."""
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(canary) - CANARY_PIECE + 1, F.lit(1))), lambda i: F.substring(canary, i, F.lit(CANARY_PIECE)))
    return F.when(F.coalesce(F.length(canary), F.lit(0)) == 0, False).otherwise(F.contains(answer, canary) | ((F.length(canary) >= CANARY_PIECE) & F.exists(pieces, lambda p: F.contains(answer, p))))


def leaked_categories(answer: Column, contexts: Column) -> Column:
    """Categories (PAN, NATIONAL_ID, IBAN) of valid numbers in the answer that no context holds verbatim."""
    source = F.array_join(contexts, "\n")
    checks = (("PAN", CARD_PATTERN, luhn_valid, True), ("NATIONAL_ID", NATIONAL_ID_PATTERN, national_id_valid, True), ("IBAN", IBAN_PATTERN, iban_valid, False))
    found = []
    for name, pattern, valid, numeric in checks:
        matches = F.regexp_extract_all(answer, F.lit(pattern), 0)
        leaks = F.exists(matches, _leak(valid, numeric, source))
        found.append(F.when(leaks, name))
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _leak(valid, numeric: bool, source: Column):
    return lambda m: valid(digits(m) if numeric else m) & ~F.contains(source, m)


def output_guard(df: DataFrame, *, answer_col: str = "answer", contexts_col: str = "contexts", canary_col: str = "canary", threshold: float = 0.1, fallback: str = "The answer was withheld.") -> DataFrame:
    """``df`` with ungrounded, canary_leaked, pii_categories, blocked and guarded (the text to show).

    Ungrounded tags are annotated; a leaked canary blocks, else leaked numbers block.
    """
    out = df.withColumn("ungrounded", ungrounded(F.col(answer_col), F.col(contexts_col), threshold))
    out = out.withColumn("canary_leaked", canary_leaked(F.col(answer_col), F.col(canary_col)))
    out = out.withColumn("pii_categories", F.when(F.col("canary_leaked"), F.array().cast("array<string>")).otherwise(leaked_categories(F.col(answer_col), F.col(contexts_col))))
    out = out.withColumn("blocked", F.col("canary_leaked") | (F.size("pii_categories") > 0))
    return out.withColumn("guarded", F.when(F.col("blocked"), fallback).otherwise(annotated(F.col(answer_col), F.col("ungrounded"))))


def annotated(answer: Column, tags: Column) -> Column:
    """The answer with [unverified] immediately after each occurrence of a listed tag."""
    return F.aggregate(tags, answer, lambda t, tag: F.replace(t, F.concat(F.lit("["), tag, F.lit("]")), F.concat(F.lit("["), tag, F.lit("][unverified]"))))


def two_stage(df: DataFrame, text_col: str = "text", *, model: Column | None = None, stage2=None, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """``df`` normalised and judged: stage1_score, stage1_source, top_features, stage2 (ran, degraded, label, confidence), zone.

    model: stage-1 probability of a trained model, the rules hold where it is null; stage2(df) -> Column
    of struct(label, confidence), asked about scores from ``low`` on and null where it fails. Without a
    stage 2 such rows count as degraded only if their score is uncertain (below ``high``).
    """
    out = rule_score(normalise(df, text_col).withColumn("_raw", F.col(text_col)).withColumn(text_col, F.col("normalised")), text_col).withColumn(text_col, F.col("_raw")).drop("_raw")
    out = out.withColumn("stage1_score", F.coalesce(model, F.col("score")) if model is not None else F.col("score")).drop("score")
    out = out.withColumn("stage1_source", F.when(model.isNotNull(), "model").otherwise("rules") if model is not None else F.lit("rules"))
    asked = F.col("stage1_score") >= low
    verdict = F.when(asked, stage2(out)) if stage2 is not None else F.lit(None).cast("struct<label:string,confidence:double>")
    out = out.withColumn("_verdict", verdict)
    ran = F.col("_verdict").isNotNull()
    degraded = asked & ~ran if stage2 is not None else F.lit(False)
    out = out.withColumn("stage2", F.struct(ran.alias("ran"), degraded.alias("degraded"), F.col("_verdict.label").alias("label"), F.col("_verdict.confidence").cast("double").alias("confidence"))).drop("_verdict")
    return out.withColumn("zone", zone(F.col("stage1_score"), ran=F.col("stage2.ran"), degraded=F.col("stage2.degraded"), label=F.col("stage2.label"), confidence=F.col("stage2.confidence"), low=low, high=high))


def train_stage1(labelled: DataFrame, text_col: str = "text", label_col: str = "label", *, features: int = 1 << 16):
    """A fitted pyspark.ml pipeline: n-grams of 3 to 5 characters within words, hashed, idf, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, SQLTransformer

    grams = SQLTransformer(statement=f"SELECT *, {_GRAMS.format(text=text_col)} AS _grams FROM __THIS__")
    stages = [grams, HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_tfidf"), LogisticRegression(featuresCol="_tfidf", labelCol=label_col, probabilityCol="_probability", regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled.withColumn(label_col, F.col(label_col).cast("double")))


#: n-grams of 3 to 5 characters of each word with a space on either side.
_GRAMS = r"flatten(transform(filter(split(lower({text}), '\\s+'), w -> w <> ''), w -> flatten(transform(sequence(3, 5), n -> if(length(w) + 2 >= n, transform(sequence(1, length(w) + 3 - n), i -> substring(concat(' ', w, ' '), i, n)), array(concat(' ', w, ' ')))))))"


def stage1_probability(fitted, df: DataFrame) -> DataFrame:
    """``df`` with model_score: the probability of the label 1."""
    from pyspark.ml.functions import vector_to_array

    out = fitted.transform(df)
    added = ["_grams", "_tf", "_tfidf", "_probability", "rawPrediction", "prediction"]
    return out.withColumn("model_score", vector_to_array("_probability")[1]).drop(*added)
