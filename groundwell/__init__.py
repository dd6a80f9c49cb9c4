"""Retrieval, guards, extraction and evaluation over documents, as DataFrame operators for Spark."""

from .errors import ConfigError, EngineError, EngineWarning, IngestionError, ModelError, PromptError, SourceError, StoreError
from .operators.answer import AnswerConfig, Messages, answer, audit_rows
from .operators.chunk import chunk, chunk_paragraphs, chunk_structural
from .operators.embed import Embedder, embed, hash_embedder, null_embedder
from .operators.evaluate import evaluate, run_averages, score_samples
from .operators.extract import Field, Rule, Schema, Steps, extract, fold_turns, preview, route
from .operators.guard import injection_reason, normalise, output_guard, rule_score, two_stage
from .operators.ingest import ingest
from .operators.mask import mask
from .operators.retrieve import bm25_scores, build_index, dense_top_k, hybrid, index_scores, ranked, top_k
from .plans.engine import Engine, EngineConfig

__version__ = "0.2.0"
__all__ = [
    "AnswerConfig", "ConfigError", "Embedder", "Engine", "EngineConfig", "EngineError", "EngineWarning", "Field", "IngestionError", "Messages", "ModelError", "PromptError", "Rule", "Schema", "SourceError",
    "Steps", "StoreError", "answer", "audit_rows", "bm25_scores", "build_index", "chunk", "chunk_paragraphs", "chunk_structural", "dense_top_k", "embed", "evaluate", "extract", "fold_turns", "hash_embedder",
    "hybrid", "index_scores", "ingest", "injection_reason", "mask", "normalise", "null_embedder", "output_guard", "preview", "ranked", "route", "rule_score", "run_averages", "score_samples", "top_k", "two_stage",
]
