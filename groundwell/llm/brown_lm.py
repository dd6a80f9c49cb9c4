"""Brown class-based bigram language model, learnt from the corpus and scored on every text.

Counts cover all training tokens, and every training word has one of the classes. The
``exchange_words`` most frequent words are assigned by exchange: each word in turn moves to the class
that gives the class bigrams of the training text the highest likelihood. Each of the other words
then joins the class with the highest gain of the same likelihood, from its own counts of neighbour
classes, where words outside the exchange are neighbours of one kind. The end of text is a class by
itself, and so is the unseen word, which has one share in all tokens + 1 after any class.
A word's probability is that of its class after the previous word's class times that of the word in
its class, so that probabilities sum to 1. It is interpolated with the add-one unigram (the base).

Only tables of fixed size reach the driver: the ``lookup_words`` most frequent words, the bigram
counts of the exchange words and those of the classes. The table of words with their classes and
counts grows with the corpus and stays distributed: pairs with words beyond the lookup meet it in a
join, pre-aggregated by document.

Defined cases: null text counts as empty; an empty text is one end token; every row is scored by
itself, and trains by itself if its id is not held out, so repeated rows count repeatedly; a null
id is not held out, so it trains; very long texts are counted and scored whole; an empty table gives
an empty result; a corpus without training rows gives every token the probability 1; extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .scratch import Scratch

EXCHANGE_WORDS = 2048
CLASSES = 64
LOOKUP_WORDS = 1 << 19
SWEEPS = 6
#: Share of the class model; the rest is the base.
SHARE = 0.9
#: Hash of the end token; no word hash equals it but by a 2**-64 chance.
END_HASH = 0x5DEECE66D1234567


def _unique_counts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _counted(keys_of, limit: int = 3_000_000):
    """Arrow function that emits (key, count) of what keys_of yields for each slice, merged up to ``limit`` keys."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, bounds in wh.slices(batch.column(0)):
                parts.append(keys_of(data, bounds))
                held += len(parts[-1])
                if held >= limit:
                    yield _count_batch(parts)
                    parts, held = [], 0
        if parts:
            yield _count_batch(parts)

    return run


def _count_batch(parts):
    keys, counts = _unique_counts(parts)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "count"])


def _word_keys(data, bounds):
    starts, ends, _ = wh.word_spans(data, bounds)
    return np.concatenate([wh.word_hashes(data, starts, ends), np.full(len(bounds) - 1, END_HASH, np.uint64)])


class Places:
    """The places of hashes in a sorted table, by their leading bits: a look-up meets two entries or so, where a search halves the table."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self._table, self._shift = np.append(table, np.uint64(0)), np.uint64(64 - bits)
        self._begin = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)
        self._begin = np.append(self._begin, np.int32(len(table)))

    def of(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for one that is not in the table."""
        out = np.full(len(words), -1)
        head = words >> self._shift
        at, end = self._begin[head], self._begin[head + np.uint64(1)]
        left = np.flatnonzero(at < end)
        at, end, sought = at[left], end[left], words[left]
        while len(left):
            hit = self._table[at] == sought
            out[left[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end)
            left, at, end, sought = left[on], at[on], end[on], sought[on]
        return out


def _places(table) -> Places:
    """The look-up of a table's hashes, made once in a worker and never sent."""
    made = getattr(table, "_made", None)
    if made is None:
        made = Places(table.hashes)
        object.__setattr__(table, "_made", made)
    return made


@dataclass(frozen=True)
class Lookup:
    """The most frequent words: sorted hashes, counts and exchange index (``rare`` for words without)."""

    hashes: np.ndarray
    counts: np.ndarray
    index: np.ndarray
    rare: int

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exchange index, place in the table or -1) of each word."""
        if not len(self.hashes):
            return np.full(len(words), self.rare, np.int32), np.full(len(words), -1)
        place = _places(self).of(words)
        return np.where(place >= 0, self.index[place], self.rare).astype(np.int32), place

    def tokens(self, data, bounds):
        """(words, place, index of every token with an end after each text, first token of each text)."""
        starts, ends, upto = wh.word_spans(data, bounds)
        words = wh.word_hashes(data, starts, ends)
        index, place = self.find(words)
        return words, place, np.insert(index, upto[1:], self.rare + 1), upto, upto[:-1] + np.arange(len(upto) - 1)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word by the exchange algorithm: until one word in 200 moves in a sweep, or ``sweeps`` are made.

    bigrams: dense counts over words, then the rare and the end token, which keep classes of their own.
    """
    n = len(bigrams) - 2
    total = classes + 2
    cls = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    if n <= 0:
        return cls
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    table = np.zeros((total, total))
    np.add.at(table, (np.repeat(cls, len(cls)), np.tile(cls, len(cls))), bigrams.ravel())
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            own, same = cls[w], float(bigrams[w, w])
            left = np.bincount(cls, bigrams[:, w], total)
            right = np.bincount(cls, bigrams[w], total)
            left[own] -= same
            right[own] -= same
            table[:, own] -= left
            table[own] -= right
            table[own, own] -= same
            column, row = table[:, :classes], table[:classes]
            gain = (xlogx(column + left[:, None]) - xlogx(column)).sum(0) + (xlogx(row + right) - xlogx(row)).sum(1)
            diagonal = table.diagonal()[:classes]
            l, r = left[:classes], right[:classes]
            gain += xlogx(diagonal + l + r + same) - xlogx(diagonal + l) - xlogx(diagonal + r) + xlogx(diagonal)
            ins, outs = column.sum(0), row.sum(1)
            gain -= xlogx(ins + left.sum() + same) - xlogx(ins) + xlogx(outs + right.sum() + same) - xlogx(outs)
            best = int(gain.argmax())
            cls[w] = best
            table[:, best] += left
            table[best] += right
            table[best, best] += same
            moved += best != own
        if moved * 200 < n:
            break
    return cls


@dataclass(frozen=True)
class Classed:
    """The most frequent words with their classes; other words have the class -1 here."""

    hashes: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    classes: int
    ends: int

    def pairs(self, data, bounds):
        """(place in the table or -1, class and hash of each token with an end after each text, ends, texts' tokens)."""
        starts, ends, upto = wh.word_spans(data, bounds)
        words = wh.word_hashes(data, starts, ends)
        place = _places(self).of(words)
        cls = np.where(place >= 0, self.cls[place] if len(self.cls) else 0, -1)
        put = lambda x, end: np.insert(x, upto[1:], end)
        return put(place, -1), put(cls, self.classes + 1), put(words, np.uint64(END_HASH)), upto

    def far(self, cls, words):
        """Places of pairs with a word beyond the table, and their columns k1, d1, k2, d2.

        The key of a known word is made from the other one: it meets no word, and spreads over tasks.
        """
        before = np.concatenate([[self.classes + 1], cls[:-1]])
        at = np.flatnonzero((before < 0) | (cls < 0))
        d1, d2, k2 = before[at], cls[at], words[at]
        k1 = np.where(d1 < 0, words[at - 1], wh.mix(k2))
        return before, at, [k1, d1, np.where(d2 < 0, k2, wh.mix(k1)), d2]


@dataclass(frozen=True)
class ClassModel:
    """next_class[c, d] = P(d | c), size: tokens of each class, by word classes, then the unseen word and the end."""

    words: Classed
    next_class: np.ndarray
    size: np.ndarray
    base_size: int
    tokens: int

    def per_token(self) -> np.ndarray:
        """next_class for one of the class's tokens: times a word's count, it is the word's probability."""
        return self.next_class / np.maximum(self.size, 1)


def _tally(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows of the columns, and their counts."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = wh.mix(mixed * np.uint64(0xC2B2AE3D27D4EB4F) + c.astype(np.int64, copy=False).view(np.uint64) if c.dtype != np.uint64 else mixed * np.uint64(0xC2B2AE3D27D4EB4F) + c)
    order = np.argsort(mixed)  # any of equal rows stands for them, so the order need not be stable
    mixed = mixed[order]
    first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)])
    return [*(c[order[first]] for c in columns), np.diff(np.append(first, len(mixed)))]


def _tally_batch(parts: list[list[np.ndarray]], names: list[str]):
    columns = _tally([np.concatenate(c) for c in zip(*parts, strict=True)])
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=names)


def _neighbours(lookup: Lookup, cls: np.ndarray, total: int, limit: int = 4_000_000):
    """(key, code, count) of each word outside the exchange: code d for the class d before it, total + d after it, 2 * total for itself before it."""

    narrow = np.uint8 if 2 * total < 256 else np.int32

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, bounds in wh.slices(batch.column(0)):
                words, _, index, upto, _ = lookup.tokens(data, bounds)
                words = np.insert(words, upto[1:], np.uint64(END_HASH))
                at = np.flatnonzero(index == lookup.rare)
                if not len(at):
                    continue
                d = cls[index]
                h = words[at]
                again = (words[at - 1] == h) & (at > 0)
                left = np.where(again, 2 * total, np.where(at > 0, d[at - 1], total - 1))
                other = words[at + 1] != h
                parts.append([np.concatenate([h, h[other]]), np.concatenate([left, total + d[at + 1][other]]).astype(narrow)])
                held += len(parts[-1][0])
                if held >= limit:
                    yield _tally_batch(parts, ["key", "code", "count"])
                    parts, held = [], 0
        if parts:
            yield _tally_batch(parts, ["key", "code", "count"])

    return run


def best_classes(table: np.ndarray, word: np.ndarray, code: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The class of highest likelihood gain for each of n words that are in the rare class so far.

    table: class bigram counts, with the rare and the end class last; word, code and count: neighbour counts, see _neighbours.
    """
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    total = len(table)
    classes, rare = total - 2, total - 2
    dense = np.zeros((n, 2 * total + 1))
    dense[word, code] = count
    left, right, same = dense[:, :total], dense[:, total : 2 * total], dense[:, 2 * total :]
    gain = np.zeros((n, classes))
    for side, counts, rows in ((0, left, table[:, :classes]), (1, right, table[:classes].T)):
        plain = (code // total == side) & (code - side * total != rare)
        w, d, c = word[plain], code[plain] - side * total, count[plain]
        np.add.at(gain, w, xlogx(rows[d] + c[:, None]) - xlogx(rows)[d])
        # The word itself leaves the rare class.
        own = rows[rare] - (right, left)[side][:, :classes]
        gain += xlogx(own + counts[:, rare, None]) - xlogx(own)
    diagonal = table.diagonal()[:classes]
    l, r = left[:, :classes], right[:, :classes]
    gain += xlogx(diagonal + l + r + same) - xlogx(diagonal + l) - xlogx(diagonal + r) + xlogx(diagonal)
    for counts, sums in ((left, table.sum(0)[:classes]), (right, table.sum(1)[:classes])):
        gain -= xlogx(sums + counts.sum(1, keepdims=True) + same) - xlogx(sums)
    return gain.argmax(1)


def _assigner(table: np.ndarray, rows: int = 1000):
    total = len(table)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, rows):
                batch = whole.slice(low, rows)
                codes, counts = batch.column(1), batch.column(2)
                lengths = np.diff(codes.offsets.to_numpy())
                word = np.repeat(np.arange(batch.num_rows), lengths)
                code, count = codes.flatten().to_numpy(), counts.flatten().to_numpy()
                before = (code < total) | (code == 2 * total)
                c = np.bincount(word[before], count[before], batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_classes(table, word, code, count, batch.num_rows).astype(np.int32)), pa.array(c)], names=["key", "cls", "c"])

    return run


def _class_pairs(shared, limit: int = 1_500_000):
    """(k1, d1, k2, d2, count) of the training pairs: by classes alone, or with the words beyond the lookup."""

    def run(batches):
        words: Classed = shared.value
        total, names = words.classes + 2, ["k1", "d1", "k2", "d2", "count"]
        known, parts, held = np.zeros(total * total, np.int64), [], 0
        for batch in batches:
            for _, _, data, bounds in wh.slices(batch.column(0)):
                _, cls, hashes, _ = words.pairs(data, bounds)
                before, at, columns = words.far(cls, hashes)
                near = np.ones(len(cls), bool)
                near[at] = False
                known += np.bincount(before[near] * total + cls[near], minlength=total * total)
                parts.append(columns)
                held += len(at)
                if held >= limit:
                    yield _tally_batch(parts, names)
                    parts, held = [], 0
        if held:
            yield _tally_batch(parts, names)
        some = np.flatnonzero(known)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, some // total, some, some % total, known[some])], names=names)

    return run


def _met(pairs: DataFrame, assigned: DataFrame, unseen: int) -> DataFrame:
    """``pairs`` with the classes c1 and c2, and the count m2 of a second word beyond the lookup."""
    one = assigned.select(F.col("key").alias("k1"), F.col("cls").alias("cls1"))
    two = assigned.select(F.col("key").alias("k2"), F.col("cls").alias("cls2"), F.col("c").alias("m2"))
    pairs = pairs.join(one, "k1", "left").join(two, "k2", "left")
    ends = (F.when(F.col(f"d{k}") >= 0, F.col(f"d{k}")).otherwise(F.coalesce(f"cls{k}", F.lit(unseen))).cast("int").alias(f"c{k}") for k in (1, 2))
    return pairs.select("*", *ends)


def most_frequent(table: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows of (key, c), those with the highest counts; of nearly equal ones those with the smallest keys.

    The least count comes from a histogram of at most some hundred rows, so nothing is sorted and no task gathers candidates.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    left, cut, share = limit, -1, 0.0
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        if row["count"] > left:
            cut, share = row["level"], left / row["count"]
            break
        left -= row["count"]
    return table.where((level > cut) | (level == cut) & (F.col("key") < int(share * 2.0**64 - 2.0**63)))


def train(training: DataFrame, scratch: Scratch, *, classes: int = CLASSES, exchange_words: int = EXCHANGE_WORDS, lookup_words: int = LOOKUP_WORDS, sweeps: int = SWEEPS) -> tuple[ClassModel, DataFrame]:
    """The model of the column ``text`` of ``training``, and the table (key, cls, c) of the words outside the exchange."""
    spark = training.sparkSession
    counts = training.mapInArrow(_counted(_word_keys), "key long, count long").groupBy("key").agg(F.sum("count").alias("c"))
    counts = scratch.settle(counts)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.where(F.col("key") != END_HASH), exchange_words).toArrow().sort_by([("c", "descending"), ("key", "ascending")])
    keys, c = (top.column(k).to_numpy() for k in ("key", "c"))
    n = len(keys)
    order = np.argsort(keys.view(np.uint64))
    lookup = Lookup(keys.view(np.uint64)[order], c[order], np.arange(n)[order].astype(np.int32), n)

    def pair_keys(data, bounds):
        index = lookup.tokens(data, bounds)[2].astype(np.uint64)
        before = np.concatenate([np.array([n + 1], np.uint64), index[:-1]])
        return before * np.uint64(n + 2) + index

    pairs = training.mapInArrow(_counted(pair_keys), "key long, count long").groupBy("key").agg(F.sum("count").alias("c")).toArrow()
    bigrams = np.zeros((n + 2, n + 2))
    bigrams.ravel()[pairs.column("key").to_numpy()] = pairs.column("c").to_numpy()
    cls = exchange(bigrams, classes, sweeps)
    whole = classes + 2
    table = np.zeros((whole, whole))
    np.add.at(table, (np.repeat(cls, n + 2), np.tile(cls, n + 2)), bigrams.ravel())

    # The words outside the exchange, by their neighbours' classes.
    around = training.mapInArrow(_neighbours(lookup, cls, whole), "key long, code long, count long")
    around = around.repartition("key").groupBy("key", "code").agg(F.sum("count").alias("c")).groupBy("key").agg(F.collect_list("code").alias("codes"), F.collect_list("c").alias("counts"))
    assigned = scratch.settle(around.mapInArrow(_assigner(table), "key long, cls int, c long"), batch_rows=2000)
    more = most_frequent(assigned, max(0, lookup_words - n)).toArrow()
    keys, c, cls = (np.concatenate([x, more.column(k).to_numpy()]) for k, x in (("key", keys), ("c", c), ("cls", cls[:n])))
    order = np.argsort(keys.view(np.uint64))
    ends = int(bigrams[:, n + 1].sum())
    words = Classed(keys.view(np.uint64)[order], c[order], cls[order].astype(np.int64), classes, ends)

    pairs = scratch.settle(training.mapInArrow(_class_pairs(spark.sparkContext.broadcast(words)), "k1 long, d1 long, k2 long, d2 long, count long"))
    known = pairs.where("d1 >= 0 and d2 >= 0").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "count")
    far = _met(pairs.where("d1 < 0 or d2 < 0"), assigned, classes).select("c1", "c2", "count")
    found = known.unionByName(far).groupBy("c1", "c2").agg(F.sum("count").alias("c")).toArrow()
    table = np.zeros((whole, whole))
    table[found.column("c1").to_numpy(), found.column("c2").to_numpy()] = found.column("c").to_numpy()
    scratch.drop(pairs)
    size = table.sum(0)
    share = size / max(1, size.sum())
    next_class = (table + whole * share) / (table.sum(1, keepdims=True) + whole) * (total / (total + 1))
    next_class[:, classes] = 1 / (total + 1)
    return ClassModel(words, next_class, size, total + distinct + 1, int(total)), assigned


def _scorer(shared):
    kinds = {"k1": pa.int64(), "d1": pa.int32(), "k2": pa.int64(), "d2": pa.int32(), "n2": pa.int64(), "times": pa.int32()}

    def run(batches):
        model: ClassModel = shared.value
        words, per_token = model.words, model.per_token()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "score", *kinds)}
            for _, _, data, bounds in wh.slices(batch.column(2)):
                place, cls, hashes, upto = words.pairs(data, bounds)
                first = upto[:-1] + np.arange(len(upto) - 1)
                n = np.diff(upto) + 1
                before, at, columns = words.far(cls, hashes)
                count = np.where(place >= 0, words.counts[place] if len(words.counts) else 0, 0)
                count[first + n - 1] = words.ends
                base = (count + 1) / model.base_size
                near = np.ones(len(cls), bool)
                near[at] = False
                logs = np.zeros(len(cls))
                logs[near] = np.log10(SHARE * per_token[before[near], cls[near]] * count[near] + (1 - SHARE) * base[near]) if model.tokens else 0.0
                out["n_tokens"].append(n)
                out["n_known"].append(np.add.reduceat(((cls >= 0) & (model.tokens > 0)).astype(np.int64), first))
                out["base"].append(np.add.reduceat(np.where(cls >= 0, np.log10(base), 0.0), first))
                out["score"].append(np.add.reduceat(logs, first))
                of = np.searchsorted(first, at, "right") - 1
                of, *columns = _tally([of, *columns, count[at]])
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(len(n) + 1))
                for (name, kind), c in zip(kinds.items(), columns, strict=True):
                    c = c[order].view(np.int64) if c.dtype == np.uint64 else c[order]
                    out[name].append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(c).cast(kind)))
            joined = {k: np.concatenate(out[k]) if out[k] else np.zeros(0) for k in ("n_tokens", "n_known", "base", "score")}
            lists = [pa.concat_arrays(out[k]) if out[k] else pa.array([], pa.list_(kind)) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(joined["n_tokens"].astype(np.int64)), pa.array(joined["n_known"].astype(np.int64)), pa.array(joined["base"].astype(float)), pa.array(joined["score"].astype(float)), *lists],
                names=["row", "id", "n_tokens", "n_known", "base", "score", *kinds],
            )

    return run


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    options: classes, exchange_words, lookup_words and sweeps, see ``train``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    training = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"))
    model, assigned = train(training, scratch, **options)
    classes = model.words.classes
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = ("k1", "d1", "k2", "d2", "n2", "times")
    scored = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"row long, id {kind}, n_tokens long, n_known long, base double, score double, k1 array<long>, d1 array<int>, k2 array<long>, d2 array<int>, n2 array<long>, times array<int>")
    scored = scratch.settle(scored, batch_rows=1000)
    far = scored.select("row", F.explode(F.arrays_zip(*lists)).alias("x")).select("row", *(F.col(f"x.{k}").alias(k) for k in lists))
    step = [(a, b, float(p)) for (a, b), p in np.ndenumerate(model.per_token())]
    step = F.broadcast(spark.createDataFrame(step, "c1 int, c2 int, step double"))
    beyond = F.col("d2") < 0
    count = F.when(beyond, F.coalesce("m2", F.lit(0))).otherwise(F.col("n2"))
    chance = SHARE * F.col("step") * F.greatest(count, F.lit(1)) + (1 - SHARE) * (count + 1) / model.base_size
    met = _met(far, assigned, classes).join(step, ["c1", "c2"]).groupBy("row").agg(
        F.sum(F.when(beyond & (count > 0), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(beyond, F.col("times") * F.log10((count + 1) / model.base_size)).otherwise(0.0)).alias("more_base"),
        F.sum(F.col("times") * F.log10(chance)).alias("more_score"),
    )
    met = scratch.settle(met)  # so the shuffles of the joins are gone before the next one
    out = scored.drop(*lists).join(met, "row", "left")
    base = F.when(F.lit(model.tokens == 0), 0.0).otherwise(F.col("base") + F.coalesce("more_base", F.lit(0.0)))
    score = F.when(F.lit(model.tokens == 0), 0.0).otherwise(F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    out = out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
    out = out.withColumns({"held_out": held_out(id_col), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})
    return out.select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
