"""Structured Streaming forms of ingest and of multi-turn slots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.answer import AnswerConfig, audit_rows
from ..operators.ingest import ingest
from ..operators.retrieve import Index, build_index, idf


def ingest_stream(docs: DataFrame, chunks_path: str, checkpoint: str, *, strategy: str = "paragraph", size: int = 500, overlap: int = 80) -> StreamingQuery:
    """Chunk a stream of documents into a chunk table as files arrive; each batch replaces its own folder, so replays don't repeat rows."""

    def store(batch: DataFrame, batch_id: int) -> None:
        chunks, _ = ingest(batch, strategy=strategy, size=size, overlap=overlap)
        chunks.write.mode("overwrite").parquet(f"{chunks_path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def slot_stream(turns: DataFrame, slots: dict[str, str]) -> DataFrame:
    """(conv_id, turn, slots as JSON) after each turn of a stream: state is the merged slots of a conversation."""
    import re

    import pandas as pd

    patterns = {name: re.compile(p) for name, p in slots.items()}

    def run(key, frames, state):
        held = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for frame in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.turn):
            for name, pattern in patterns.items():
                if found := pattern.search(frame.text or ""):
                    held[name] = found[1]
            rows.append((key[0], frame.turn, json.dumps(held, sort_keys=True)))
        state.update((json.dumps(held, sort_keys=True),))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "slots"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turn long, slots string", "slots string", "append", "NoTimeout")


def index_stream(chunks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep BM25 tables of a growing chunk table: each batch adds its postings and lengths, replays replace their own.

    Corpus statistics are not stored but computed by ``read_index`` from the lengths and postings, so no
    batch rebuilds what is there already.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        index = build_index(batch)
        index.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
        index.doc_len.write.mode("overwrite").parquet(f"{folder}/lengths/batch={batch_id}")

    return chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, folder: str) -> Index:
    """The index of all batches so far; ``retrieve.index_scores`` searches it."""
    postings = spark.read.parquet(f"{folder}/postings").drop("batch")
    doc_len = spark.read.parquet(f"{folder}/lengths").drop("batch")
    stats = doc_len.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))
    return Index(postings, doc_len, stats, terms.select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")))


def audit_stream(answered: DataFrame, path: str, checkpoint: str, config: AnswerConfig = AnswerConfig()) -> StreamingQuery:
    """Append the audit records of a stream of answers as JSON lines."""
    return audit_rows(answered, config).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
