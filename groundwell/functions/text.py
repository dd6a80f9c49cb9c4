"""Column functions over text: tokens, checksums, similarity, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equals the Unicode word class of the token rules; ASCII digits only are not implied.
WORD = r"([\p{L}\p{N}_]+)"
BETWEEN = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens with repeats; an empty array for null. What lies between the words splits, which costs less than finding each word."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def token_set(text: Column) -> Column:
    """Distinct word tokens, lower-cased after the match."""
    found = F.regexp_extract_all(text, F.lit(WORD), 1)
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), F.lower))


def whitespace_tokens(text: Column) -> Column:
    """Distinct lower-cased runs between white space, as the answer metrics use them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """|a & b| / |a | b| of distinct arrays; 0 if one is empty, ``both_empty`` if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; cosine similarity for unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def national_id_valid(number: Column) -> Column:
    """Eleven digits, the first not 0; digit 10 from the odd and even sums, digit 11 from the sum of ten."""
    d = [F.substring(number, i + 1, 1).try_cast("int") for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    ten = F.pmod(7 * odd - even, F.lit(10)) == d[9]
    eleven = F.pmod(odd + even + d[9], F.lit(10)) == d[10]
    return F.coalesce((F.length(number) == 11) & (d[0] != 0) & ten & eleven, F.lit(False))


def iban_valid(number: Column) -> Column:
    """15 to 34 characters whose rearranged digits leave 1 modulo 97, by a running remainder."""
    moved = F.concat(F.substring(number, 5, 34), F.substring(number, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0).cast("long"), lambda r, v: F.pmod(r * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))
    return F.coalesce(F.length(number).between(15, 34) & (rest == 1), F.lit(False))


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space; a piece of citation tags alone joins the piece before it."""
    pieces = F.split(text, r"(?<=[.!?])\s+")
    only_tags = r"^(\[S[0-9]+\]\s*)+$"

    def add(done: Column, piece: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), piece)))
        return F.when((F.size(done) > 0) & piece.rlike(only_tags), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(F.filter(pieces, lambda p: strip(p) != ""), F.array().cast("array<string>"), add)


def cited(text: Column) -> Column:
    """Sorted distinct numbers n of tags [Sn]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[S([0-9]+)\]"), 1), lambda n: n.try_cast("int"))))


def cache_key(query: Column, chunk_ids: Column, *versions: Column) -> Column:
    """SHA-256 of query, chunk ids in their order, and versions, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", query, chunk_ids, *versions), 256)


def entropy_terms(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for a null or empty text.

    The sorted characters, joined again, are runs of equal ones; with run lengths k the entropy is
    log2(n) - sum(k * log2(k)) / n. The pattern finds a run at a time, so a text makes as many values
    as it has distinct characters. (Counting in Python would take a third of the time, but a plan can't
    hold it behind the Python function that ``normalise`` needs.)
    """
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    lengths = F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), 0), lambda r: F.length(r).cast("double"))

    def finish(k: Column) -> Column:
        n = F.length(text).cast("double")
        return F.when(n > 0, F.log2(n) - F.aggregate(k, F.lit(0.0), lambda s, x: s + x * F.log2(x)) / n).otherwise(0.0)

    return F.get(F.transform(F.array(lengths), finish), 0)
