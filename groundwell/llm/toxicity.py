"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences; it is toxic if any sentence is. A sentence's probability is
logistic in the hashed words it holds, and the document's is 1 - prod(1 - p): only document labels
are needed to train it, and the trained sentence scores locate the offending sentences.

Training uses at most ``TRAIN_PER_CLASS`` labelled documents of each class, those with the smallest
hash of the id, and of these the ones of at most ``TRAIN_BYTES`` bytes; these bounds of the training
sample are all that is left out. Scores use the text alone, all of it.

Defined cases: null and blank texts have no sentence and score 0; a null id is not held out and has no
label; a null label is no label; several labels of one id count as toxic if any does; of several
texts of one id the first in order trains; repeated rows are scored alike; very long texts are scored
whole; without labels of both classes every score is 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .scratch import bound_batches

BUCKETS = 1 << 19
HEAD_BYTES = 5
TRAIN_PER_CLASS = 2500
TRAIN_BYTES = 1 << 14
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class SentenceModel:
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray, sentence_of: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n sentences."""
        z = np.bincount(sentence_of, self.weights[features].sum(1), n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sentences(data: np.ndarray, bounds: np.ndarray):
    """(features of each word: itself and its first bytes, sentence of each word, sentences before each row, first byte and end byte of each sentence).

    A sentence ends at . ! ? or a line break, and with its text.
    """
    starts, ends, upto = wh.word_spans(data, bounds, wh.NOT_ALNUM)
    heads = wh.mix(wh.word_hashes(data, starts, np.minimum(ends, starts + HEAD_BYTES)) + wh.U(1))
    features = (np.stack([wh.word_hashes(data, starts, ends), heads], 1) & wh.U(BUCKETS - 1)).astype(np.int64)
    if not len(starts):
        return features, starts, np.zeros(len(bounds), np.int64), starts, ends
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = stops[starts[1:]] > stops[ends[:-1]]
    fresh[upto[:-1][upto[:-1] < len(starts)]] = True
    sentence_of = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    before = np.concatenate([begin, [len(starts)]])
    return features, sentence_of, np.searchsorted(begin, upto), starts[begin], ends[before[1:] - 1]


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], *, rounds: int = 200, rate: float = 0.3, shrink: float = 0.01, least_documents: int = 3) -> SentenceModel:
    """Maximise the noisy-or likelihood less shrink / sqrt(documents) * |weights| by adaptive proximal gradient steps.

    Words of fewer than ``least_documents`` training documents get no weight.

    bags: (features, sentence of each feature, label) of each document.
    """
    labels = np.array([b[2] for b in bags], float)
    if len(set(labels.tolist())) < 2:
        return SentenceModel(np.zeros(BUCKETS, np.float32), -40.0)
    common = np.bincount(np.concatenate([np.unique(b[0]) for b in bags]), minlength=BUCKETS) >= least_documents
    used, features = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    features = features.reshape(-1, 2)
    counts = np.array([int(b[1][-1]) + 1 if len(b[1]) else 0 for b in bags])
    begin = np.cumsum(counts) - counts
    sentence_of = np.concatenate([b[1] + at for b, at in zip(bags, begin, strict=True)]).astype(np.int64)
    n = int(counts.sum())
    bag_of = np.repeat(np.arange(len(bags)), counts)
    shrink /= np.sqrt(len(bags))
    w, bias = np.zeros(len(used)), -float(np.log(4 * max(1.0, counts.mean())))
    square, square_bias = np.full(len(used), 1e-8), 1e-8
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(rounds):
        z = np.clip(np.bincount(sentence_of, w[features].sum(1), n) + bias, -40, 40)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        none = np.exp(clean)
        ratio = np.where(labels > 0, none / np.maximum(1 - none, 1e-9), -1.0) * balance / len(bags)
        step = p * ratio[bag_of]
        grad = np.bincount(features.ravel(), np.repeat(step[sentence_of], 2), len(used))
        top = float(step.sum())
        square += grad * grad
        square_bias += top * top
        pace = rate / np.sqrt(square)
        w += pace * grad
        w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink, 0) * common[used]
        bias += rate * top / np.sqrt(square_bias)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return SentenceModel(weights, float(bias))


def _reader(batches):
    for batch in batches:
        rows: dict[str, list] = {"features": [], "of": []}
        for _, _, data, bounds in wh.slices(batch.column(1)):
            features, sentence_of, before, _, _ = sentences(data, bounds)
            words = np.searchsorted(sentence_of, before)
            for k in range(len(bounds) - 1):
                part = slice(words[k], words[k + 1])
                rows["features"].append(features[part].astype("<i4").tobytes())
                rows["of"].append((sentence_of[part] - before[k]).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows["features"], pa.binary()), pa.array(rows["of"], pa.binary())], names=["toxic", "features", "of"])


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SentenceModel:
    """Fit on at most ``per_class`` labelled documents of each class, of at most ``most_bytes`` bytes each.

    The sampled ids (at most 2 * per_class) are broadcast; the driver receives their hashed words.
    """
    bound_batches(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    marks = marks.withColumn("_at", F.xxhash64(F.col("_id").cast("string")))
    picked = [marks.where(F.col("_toxic") == v).orderBy("_at", "_id").limit(per_class) for v in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= most_bytes).join(chosen, "_id")
    texts = texts.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    found = texts.select("_toxic", "_text").mapInArrow(_reader, "toxic int, features binary, of binary").collect()
    bags = [(np.frombuffer(r.features, "<i4").reshape(-1, 2), np.frombuffer(r.of, "<i4"), r.toxic) for r in sorted(found)]
    return fit(bags) if bags else SentenceModel(np.zeros(BUCKETS, np.float32), -40.0)


def score(docs: DataFrame, model: SentenceModel, *, id_col: str = "doc_id", text_col: str = "text", locate: bool = False, at_least: float = 0.5) -> DataFrame:
    """(id, score) for each row; with locate also ``offending``: the sentences with a score of at_least or more."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for _, _, data, bounds in wh.slices(batch.column(1)):
                features, sentence_of, before, begin, end = sentences(data, bounds)
                p = model.score(features, sentence_of, int(before[-1]))
                clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
                scores.append(-np.expm1(np.minimum(clean[before[1:]] - clean[before[:-1]], 0.0)))
                if locate:
                    for k in range(len(bounds) - 1):
                        hot = [i for i in range(before[k], before[k + 1]) if p[i] >= at_least]
                        spans.append([data[begin[i] : end[i]].tobytes().decode() for i in hot])
            columns = [batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.string()))] if locate else columns, names=[id_col, "score", *(["offending"] if locate else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, score double" + ", offending array<string>" * locate)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text is a multiple of folds; not so for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from the labels outside the held-out fold."""
    model = train(docs, labels.where(~held_out()))
    out = score(docs, model, **options)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= 0.5).cast("int")})


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, all columns unchanged. No join: the score is made in passing."""
    model = train(docs, labels.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            keep = []
            for _, _, data, bounds in wh.slices(batch.column(column)):
                features, sentence_of, before, _, _ = sentences(data, bounds)
                clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(model.score(features, sentence_of, int(before[-1])), 1 - 1e-12)))])
                keep.append(-np.expm1(np.minimum(clean[before[1:]] - clean[before[:-1]], 0.0)) < 0.5)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
