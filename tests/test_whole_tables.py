"""Operators that no SQL expresses against plain Python, on a whole small table."""

import os
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from groundwell.operators import guard, mask

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
#: One of each kind, valid and not, put into some of the documents.
PERSONAL = (
    "write to a.b@c-d.org now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "id 10000000146 or 10000000147", "call +90 532 123 45 67 today", "::1 and 2001:db8::1 and fe80::1 at 12:30:45",
    "Bearer abc.def-ghi and sk-abcdefghijklmnop1234", "10.0.0.255 and 10.0.0.256", "ghp_abcdefghijklmnopqrst12",
)


def luhn(number):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in number])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def national(number):
    if len(number) != 11 or number[0] == "0":
        return False
    d = [int(c) for c in number]
    return (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def masked(text):
    counts = {}
    checks = {mask.CARD: luhn, mask.NATIONAL_ID: national}
    for label, pattern, _ in mask.STAGES:
        def put(m, label=label):
            if label in checks and not checks[label](regex.sub("[^0-9]", "", m[0])):
                return m[0]
            counts[label] = counts.get(label, 0) + 1
            return label

        text = regex.sub(pattern, put, text)
    return text, counts


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, f"{PERSONAL[k % len(PERSONAL)]} {r.text} {PERSONAL[(k + 3) % len(PERSONAL)]}" if k % 2 else r.text) for k, r in enumerate(rows)]


def test_masking(spark, documents):
    got = {r.doc_id: (r.text, r.redactions) for r in mask.mask(spark.createDataFrame(documents, "doc_id long, text string")).collect()}
    want = {d: masked(t) for d, t in documents}
    assert {label for _, counts in want.values() for label in counts} == set(mask.LABELS)
    assert got == want


def test_normal_form(spark, documents):
    odd = ["ﬁ ½ Ⅳ ｆｕｌｌ", "​А⁠", "<|IM_start|>x[user]", "a---b####", "?!?!?!??? ...", ""]
    rows = [(d, t + odd[d % len(odd)]) for d, t in documents]

    def plain(text):
        text = regex.sub(f"[{guard.ZERO_WIDTH}]", "", unicodedata.normalize("NFKC", text)).translate(str.maketrans(*guard.LOOKALIKES))
        for d in sorted(guard.CHAT_DELIMITERS, key=len, reverse=True):
            assert "|" in guard.DELIMITERS and d
        text = regex.sub(guard.DELIMITERS, "", text)
        return regex.sub(r"([!?.,;:])\1{2,}", r"\1", text)

    got = {r.doc_id: (r.normalised, r.drift) for r in guard.normalise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (plain(t), abs(len(t) - len(plain(t)))) for d, t in rows}


def test_scores_of_the_plain_form(spark, documents):
    rows = [(d, t[:3000]) for d, t in documents]
    got = {r.doc_id: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.round(guard.entropy_terms(F.col("text")), 9).alias("h")).collect()}
    import collections
    import math

    for d, t in rows:
        n = len(t)
        assert got[d] == pytest.approx(-sum(k / n * math.log2(k / n) for k in collections.Counter(t).values()) if n else 0.0, abs=1e-8)
