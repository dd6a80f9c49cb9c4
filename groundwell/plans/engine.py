"""The engine: table paths and plug-ins in one immutable configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, StoreError
from ..operators import answer as answers
from ..operators import chunk as chunking
from ..operators import retrieve
from ..operators.embed import Embedder, embed
from ..operators.ingest import described, ingest, upload_id
from ..sources import files

CHUNKERS: dict[str, Callable[..., DataFrame]] = {"paragraph": chunking.chunk_paragraphs, "structural": chunking.chunk_structural}


@dataclass(frozen=True)
class EngineConfig:
    """Paths, strategies and plug-ins. embedder: adds vectors to chunks and queries; generate(prompt, sources),
    scorer(ranking) and rewrite(question) are functions on columns; cache_path None is no cache."""

    chunks_path: str | None = None
    strategy: str = "paragraph"
    retrieval: str = "auto"
    size: int = 500
    overlap: int = 80
    embedder: Embedder | None = None
    generate: Callable = answers.stub_generate
    scorer: Callable | None = None
    rewrite: Callable | None = None
    cache_path: str | None = None
    audit_path: str | None = None
    answer: answers.AnswerConfig = field(default_factory=answers.AnswerConfig)

    def __post_init__(self):
        if self.retrieval not in ("auto", "dense", "sparse", "hybrid"):
            raise ConfigError(f"unknown retrieval {self.retrieval!r}")
        if self.strategy not in CHUNKERS:
            raise ConfigError(f"unknown chunking strategy {self.strategy!r}; known: {', '.join(CHUNKERS)}")
        if self.overlap < 0 or self.size < 1:
            raise ConfigError("size must be positive and overlap not negative")


@dataclass(frozen=True)
class Engine:
    spark: SparkSession
    config: EngineConfig
    #: Chunks held in a DataFrame instead of a path.
    table: DataFrame | None = None

    def with_config(self, **changes) -> Engine:
        return replace(self, config=replace(self.config, **changes))

    def ingest(self, docs: DataFrame, *, reset: bool = False, check_injection: bool = False) -> DataFrame:
        """Chunk documents (doc_id, text and optionally title, doc_type, access_tags, freshness) into the chunk table; returns the rejects."""
        if self.config.chunks_path is None:
            raise StoreError("the engine has no chunk table")
        chunks, rejects = ingest(docs, strategy=self.config.strategy, size=self.config.size, overlap=self.config.overlap, check_injection=check_injection)
        chunks = chunks.withColumnRenamed("doc_id", "document_id")
        for name in ("title", "doc_type"):
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, F.lit("document") if name == "doc_type" else F.col("document_id").cast("string"))
        if self.config.embedder is not None:
            chunks = embed(chunks, self.config.embedder, kind="passage")
        (files.reset_to if reset else files.append_chunks)(chunks, self.config.chunks_path)
        return rejects

    def load_documents(self, folder: str, *, access_tags: list[str] | None = None, reset: bool = False) -> tuple[int, DataFrame]:
        """Take in the text files of a folder's top level: their number, and the rejected ones with the reason."""
        accepted, rejected = files.read_uploads(self.spark, folder)
        docs = described(accepted, tags=access_tags).withColumn("doc_id", upload_id(F.col("path"), F.col("text"))).withColumnRenamed("path", "source_path").drop("name")
        refused = self.ingest(docs, reset=reset, check_injection=True)
        refused = refused.select(F.col("source_path").alias("path"), F.element_at(F.split("source_path", "/"), -1).alias("name"), "reject_reason")
        rejects = rejected.unionByName(refused)
        return accepted.count() - refused.count(), rejects

    def chunks(self) -> DataFrame:
        if self.table is not None:
            return self.table
        if self.config.chunks_path is None:
            raise StoreError("the engine has no chunk table")
        return files.read_chunks(self.spark, self.config.chunks_path)

    def _asked(self, queries: DataFrame) -> DataFrame:
        if self.config.embedder is None or "vector" in queries.columns or self.config.retrieval == "sparse":
            return queries
        return embed(queries, self.config.embedder, kind="query", text_col="question")

    def strategy(self, queries: DataFrame) -> str:
        return retrieve.strategy_of(self.config.retrieval, self.chunks(), self._asked(queries))

    def retrieve(self, queries: DataFrame, k: int | None = None, *, as_of: Column | None = None) -> DataFrame:
        """(query_id, chunk_id, document_id, rank, score, strategy) of queries (query_id, question and optionally vector, roles, doc_type).

        Access rules always hold; k None or 0 means the configured one.
        """
        asked, c = self._asked(queries), self.config.answer
        out = retrieve.ranked(self.chunks(), asked, retrieval=self.config.retrieval, k=k or c.k, depth=c.depth, per_document=c.per_document, as_of=as_of, scorer=self.config.scorer)
        name = retrieve.strategy_of(self.config.retrieval, self.chunks(), asked)
        return out.withColumn("strategy", F.lit(retrieve.label(name, self.config.scorer is not None and name != "dense")))

    def answer(self, queries: DataFrame, *, as_of: Column | None = None, now: Column | None = None) -> DataFrame:
        """``operators.answer.answer`` with the configured plug-ins and cache."""
        cache = files.read_cache(self.spark, self.config.cache_path) if self.config.cache_path else None
        config = replace(self.config.answer, retrieval=self.config.retrieval)
        return answers.answer(self._asked(queries), self.chunks(), config, generate=self.config.generate, as_of=as_of, cache=cache, now=now, rewrite=self.config.rewrite, scorer=self.config.scorer)

    def record(self, answered: DataFrame, *, now: Column | None = None) -> None:
        """Append the audit records of answers, and what was generated to the cache. Give a written or cached table: it is read twice."""
        if self.config.audit_path:
            files.append_audit(answers.audit_rows(answered, self.config.answer, now=now), self.config.audit_path)
        if self.config.cache_path:
            fresh = answered.where("status = 'ok' and not cached").select("cache_key", F.col("answer").alias("answer_text"), (now if now is not None else F.current_timestamp()).alias("created_at"))
            files.append_cache(fresh, self.config.cache_path)

    def samples(self, queries: DataFrame) -> DataFrame:
        """(question_id, answer, contexts, retrieved) of answers, as the evaluation takes them."""
        answered = self.answer(queries)
        return answered.select(F.col("query_id").alias("question_id"), "answer", F.transform("sources", lambda s: s["text"]).alias("contexts"), F.transform("sources", lambda s: s["document_id"].cast("string")).alias("retrieved"))
