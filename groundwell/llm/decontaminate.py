"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts are canonicalised to templates: numbers, units after numbers and names (up to ``NAME_WORDS``
capitalised words in a row, wherever they stand, unless the first is one of ``OPENERS``) become typed
placeholders, other words lose case and punctuation. Windows of
template words of the documents are hash-joined with those of the benchmark items; shorter probe
windows at a stride first select the documents that can have a hit, which passes none over. On each
diagonal (document, item, offset) the slots must agree: one benchmark value stands for one document
value and the reverse, so a question with other numbers or names is caught as long as they are
exchanged consistently; windows whose slots all hold the item's own values stay in any case. Windows with fewer than half literal words, and items of fewer than
``LEAST_WORDS`` words, say too little as templates: they are joined by the values that their
placeholders stand for, so they are found as copies only. A document is contaminated if consistent
windows cover at least ``least_share`` of an item's words.

The benchmark's windows are broadcast only if they number at most ``BROADCAST_WINDOWS``, integer ids of
candidate documents up to ``BROADCAST_IDS``; beyond that Spark joins by shuffle.

Defined cases: null or blank texts hold no window; items shorter than a window are one window of
their own length, so that an item of one word is found in every document with the word; items with
equal text count once, under the smallest id; very long texts and items are read whole; rows that
share a doc id share the verdict, repeated rows too; null doc ids are judged together; without items
or without documents nothing is found; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

WINDOW = 8
LEAST_WORDS = 5
BROADCAST_WINDOWS = 500_000
BROADCAST_IDS = 2_000_000
#: Private-use characters that stand for a number, a unit and a name.
NUMBER, UNIT, NAME = chr(0xE000), chr(0xE001), chr(0xE002)
#: Joins the parts of a number, unit or name where its value is kept; END marks where a name ends meanwhile.
JOINT, END = chr(0xE003), chr(0xE004)
#: Words of one name at most.
NAME_WORDS = 4
#: Capitalised words that open sentences and are no names.
OPENERS = (
    "A After All Also An And Another Are As At Before But By Calculate Can Compute Consider Determine Did Do Does During Each Every Find For From "
    "Given Has Have How If In Into Is It Its Let Of On Or Since So Some Suppose Than That The Then There These This Those To Under Until Was Were "
    "What When Where Which While Who Whose Why With"
).split()
#: What separates words after lower-casing: ASCII bytes that are neither letters nor digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the windows that select candidate documents.
PROBE = 5
#: Units recognised after a number.
UNITS = (
    "km cm mm m miles mile feet foot inches inch kg g mg lb lbs pounds pound tons ton l ml liters liter litres litre gallons gallon "
    "seconds second minutes minute hours hour days day weeks week months month years year km/h mph percent dollars dollar euros euro cents cent degrees"
).split()


def template_words(text: Column, values: bool = False) -> Column:
    """The template words of a text; with values, placeholders carry what they stand for."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    number, unit, name = (NUMBER + f"$1{JOINT}$2{JOINT}$3 ", "$1" + UNIT + "$2", f" {NAME}$0{END} ") if values else (NUMBER + " ", "$1" + UNIT, f" {NAME} ")
    out = F.coalesce(text.cast("string"), F.lit(""))
    word = r"\p{Lu}\p{Ll}{1,40}"
    names = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{N}}])){word}(?: {word}){{0,{NAME_WORDS - 1}}}(?![\p{{L}}\p{{N}}])"
    out = F.regexp_replace(out, names, name)
    if values:  # a name stays one word, as its placeholder is
        out = F.translate(F.regexp_replace(out, rf" (?=[^{NAME}{END}]{{1,{41 * NAME_WORDS}}}{END})", JOINT), END, "")
    numbers = F.regexp_replace(out, rf"(?=[0-9])(?<![\p{{L}}\p{{N}}])([0-9]+)(?:[.,:/]([0-9]+))?(?:[.,:/]([0-9]+))?(?=[^\p{{L}}\p{{N}}]|$|(?:{units})(?![\p{{L}}\p{{N}}]))", number)
    units_too = F.regexp_replace(numbers, rf"({NUMBER}\S*\s+)({units})(?![\p{{L}}\p{{N}}])", unit)
    if values:  # a unit stays one word, as its placeholder is
        for whole in (u for u in UNITS if "/" in u):
            units_too = F.regexp_replace(units_too, rf"{UNIT}{whole}(?![\p{{L}}\p{{N}}])", UNIT + whole.replace("/", JOINT))
    out = F.when(out.rlike("[0-9]"), units_too).otherwise(out)
    out = F.trim(F.regexp_replace(F.lower(out), SEPARATORS, " "))
    return F.when(out == "", F.array().cast("array<string>")).otherwise(F.split(out, " "))


def _once(value: Column, use) -> Column:
    """use(value) with the value bound, so that expressions inside it don't compute it anew."""
    return F.get(F.transform(F.array(value), use), 0)


def _window_keys(hashes: Column, size: int, stride: int = 1) -> Column:
    """Hash of each window of ``size`` word hashes, at every ``stride``-th place; none for fewer words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size, F.lit(stride)), lambda i: F.xxhash64(F.lit(size), F.slice(hashes, i + 1, F.lit(size))))
    return F.when(F.size(hashes) >= size, windows).otherwise(F.array().cast("array<bigint>"))


def _sized(size: int, stride: int = 1):
    return lambda hashes: _window_keys(hashes, size, stride)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(scratch: Scratch, parts: list[DataFrame]) -> tuple[DataFrame, int]:
    """The written union of ``parts``, broadcast in joins if bounded, and its rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = scratch.settle(out)
    n = out.count()
    return F.broadcast(out) if n <= BROADCAST_WINDOWS else out, n


def _words_of(hits: DataFrame) -> DataFrame:
    """(id, item, offset, start, at) of each word of the windows, by their first word."""
    words = hits.select("id", "item", (F.col("place") - F.col("at")).alias("offset"), F.col("at").alias("start"), "size")
    return words.select("id", "item", "offset", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least_share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, covered, n_words, share) for each document and benchmark item that it holds."""
    scratch = Scratch(docs.sparkSession, "leaks")
    items = benchmark.where(F.col(item_text_col).isNotNull()).groupBy(F.col(item_text_col).alias("text")).agg(F.min(item_col).alias("item"))
    items = items.select("item", template_words(F.col("text")).alias("words"), template_words(F.col("text"), True).alias("filled"))
    items = scratch.settle(items.where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("size", F.least(F.col("n"), F.lit(window))))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` values
    literal = lambda words: F.size(F.filter(words, lambda w: ~w.rlike(f"^[{NUMBER}{UNIT}{NAME}]")))
    parts, copies = [], []
    for size in sizes:
        for column, found in (("words", parts), ("filled", copies)):
            of_size = items.where(F.col("size") == size).select("item", "words", F.posexplode(_once(_hashes(F.col(column)), _sized(size))).alias("at", "key"))
            telling = (literal(F.slice("words", F.col("at") + 1, F.lit(size))) * 2 >= size) & F.lit(size >= LEAST_WORDS)
            found.append(of_size.where(telling if found is parts else ~telling).select("item", "at", "key", F.lit(size).alias("size")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    if not parts:
        return docs.select(F.col(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), *(F.lit(0).cast(t).alias(c) for c, t in (("covered", "long"), ("n_words", "long"), ("share", "double")))).where("false")
    table, _ = _windows(scratch, parts)
    copy_table, n_copied = _windows(scratch, copies)
    # A run of ``size`` template words holds a probe of PROBE words at a stride of size - PROBE + 1;
    # with the benchmark's probes at every place, no document with a window hit is passed over.
    stride = max(1, min([size for size in sizes if size >= PROBE], default=PROBE) - PROBE + 1)
    probes = items.select(F.explode(_once(_hashes(F.col("words")), _sized(PROBE))).alias("key")).distinct()
    probes = scratch.settle(probes)
    if probes.count() <= BROADCAST_WINDOWS:
        probes = F.broadcast(probes)
    hashes = _once(template_words(F.col("text")), _hashes)
    probed = texts.select("id", F.explode(_once(hashes, _sized(PROBE, stride))).alias("key"))
    found = probed.join(probes, "key", "left_semi").select("id")
    filled_hashes = _once(template_words(F.col("text"), True), _hashes)
    for size in (size for size in sizes if size < PROBE):
        short = texts.select("id", F.explode(_once(filled_hashes, _sized(size))).alias("key"))
        found = found.unionByName(short.join(copy_table.where(F.col("size") == size), "key", "left_semi").select("id"))
    candidates = scratch.settle(found.distinct().withColumnRenamed("id", "_id"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType) and candidates.count() <= BROADCAST_IDS:
        candidates = F.broadcast(candidates)
    # Written: else Spark derives a filter on the words and computes them for all texts, below the join.
    some = scratch.settle(texts.join(candidates, texts["id"].eqNullSafe(F.col("_id")), "left_semi"))
    some = scratch.settle(some.select("id", template_words(F.col("text")).alias("words"), template_words(F.col("text"), True).alias("filled")))

    def hits_of(column: str, table: DataFrame) -> DataFrame:
        placed = None
        for size in sizes:
            of_size = some.select("id", F.posexplode(_once(_hashes(F.col(column)), _sized(size))).alias("place", "key"))
            placed = of_size if placed is None else placed.unionByName(of_size)
        return scratch.settle(placed.join(table, "key").select("id", "item", "place", "at", "size").distinct())

    hits = hits_of("words", table)

    # Slots: each placeholder with the value it stands for.
    slots = some.select("id", F.posexplode("filled").alias("place", "value")).where(F.col("value").rlike(f"^[{NUMBER}{UNIT}{NAME}]"))
    theirs = items.select("item", F.posexplode("filled").alias("at", "value")).where(F.col("value").rlike(f"^[{NUMBER}{UNIT}{NAME}]"))
    words_hit = _words_of(hits).select("id", "item", "offset", "at").distinct().withColumn("place", F.col("at") + F.col("offset"))
    words_hit = scratch.settle(words_hit)
    paired = words_hit.join(theirs.withColumnRenamed("value", "theirs"), ["item", "at"]).join(slots.select(F.col("id").alias("sid"), F.col("place").alias("splace"), F.col("value").alias("ours")), F.col("id").eqNullSafe(F.col("sid")) & (F.col("place") == F.col("splace")))
    paired = scratch.settle(paired.select("id", "item", "offset", "at", "theirs", "ours"))
    pairs = paired.select("id", "item", "offset", "theirs", "ours").distinct()
    verdict = pairs.groupBy("id", "item", "offset").agg(F.count("*").alias("pairs"), F.countDistinct("theirs").alias("a"), F.countDistinct("ours").alias("b")).where("pairs > a or pairs > b").select("id", "item", "offset")
    wrong = scratch.settle(verdict)

    def matched(left: DataFrame, right: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
        right = right.select(*(F.col(c).alias("_" + c) for c in columns))
        on = [left[c].eqNullSafe(right["_" + c]) for c in columns]
        return left.join(right, reduce(and_, on), how)

    diagonal = ("id", "item", "offset")
    agreed = matched(words_hit, wrong, diagonal, "left_anti").select("id", "item", "at")
    # On the other diagonals, windows without a changed value are copies and stay.
    changed = paired.groupBy("id", "item", "offset", "at").agg(F.max(F.col("theirs") == F.col("ours")).alias("same")).where("not same")
    doubtful = scratch.settle(matched(_words_of(hits), wrong, diagonal, "left_semi"))
    spoiled = matched(doubtful, changed, (*diagonal, "at"), "left_semi").select(*diagonal, "start").distinct()
    agreed = agreed.unionByName(matched(doubtful, spoiled, (*diagonal, "start"), "left_anti").select("id", "item", "at"))
    if n_copied:
        agreed = agreed.unionByName(_words_of(hits_of("filled", copy_table)).select("id", "item", "at"))
    covered = agreed.distinct().groupBy("id", "item").agg(F.count("*").alias("covered"))
    out = covered.join(items.select("item", F.col("n").cast("long").alias("n_words")), "item").withColumn("share", F.col("covered") / F.col("n_words"))
    return scratch.settle(out.where(F.col("share") >= least_share).select(F.col("id").cast(kind).alias(id_col), F.col("item").alias("item_id"), "covered", "n_words", "share"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, first_item, share) for each row of ``docs``."""
    found = leaks(docs, benchmark, id_col=id_col, **options)
    found = found.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("share").alias("share"))
    ids = docs.select(id_col)
    out = ids.join(found, ids[id_col].eqNullSafe(found["_id"]), "left")
    return out.select(id_col, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "first_item", F.coalesce("share", F.lit(0.0)).alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    found = leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_gone"]), "left_anti")
