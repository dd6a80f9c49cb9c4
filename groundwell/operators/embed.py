"""Embeddings as a plug-in: a factory makes one model per Python worker, texts go to it in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError


@dataclass(frozen=True)
class Embedder:
    """load() -> (list of texts -> list of vectors); prefixes: what a model wants before passages and queries."""

    load: Callable[[], Callable[[list[str]], list]]
    passage_prefix: str = ""
    query_prefix: str = ""
    version: str = "custom"
    retries: int = 2


def hash_embedder(dim: int = 64, version: str = "hash") -> Embedder:
    """A deterministic stand-in for a model: signed hashes of the words."""

    def load():
        def run(texts: list[str]) -> list:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
            return list(out)

        return run

    return Embedder(load, version=version)


def e5_prefixes(embedder: Embedder) -> Embedder:
    """The embedder with the prefixes that models of the e5 family are trained with."""
    return Embedder(embedder.load, "passage: ", "query: ", embedder.version, embedder.retries)


def null_embedder() -> Embedder:
    """One constant number, for set-ups that only search by words."""
    return Embedder(lambda: lambda texts: [[1.0]] * len(texts), version="none")


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": hash_embedder, "none": null_embedder}


def embedder_of(name: str) -> Embedder:
    """The embedder registered in EMBEDDERS under a name; add to it what a site has."""
    if name not in EMBEDDERS:
        raise ConfigError(f"unknown embedder {name!r}; known: {', '.join(EMBEDDERS)}")
    return EMBEDDERS[name]()


def embed(df: DataFrame, embedder: Embedder, *, kind: str = "passage", text_col: str = "text", vector_col: str = "vector") -> DataFrame:
    """``df`` with vector_col: the embedding of the text at length 1, null for a null or blank text.

    A batch that fails is tried again ``retries`` times; then the error ends the task, and Spark's own
    retries begin. A zero vector stays zero.
    """
    prefix = {"passage": embedder.passage_prefix, "query": embedder.query_prefix}[kind]

    def encode(model, texts: list[str]) -> list:
        for attempt in range(embedder.retries + 1):
            try:
                return model(texts)
            except Exception:
                if attempt == embedder.retries:
                    raise
        return []

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for texts in batches:
            held = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            out: list = [None] * len(texts)
            for i, vector in zip(held, encode(model, [prefix + texts.iloc[i] for i in held]) if held else [], strict=True):
                v = np.asarray(vector, np.float64)
                norm = float(np.linalg.norm(v))
                out[i] = (v / norm if norm else v).astype(np.float32)
            yield pd.Series(out, dtype=object)

    return df.withColumn(vector_col, run(F.col(text_col)))
