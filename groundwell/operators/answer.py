"""The grounded answer pipeline: one DataFrame of queries carried through stages with a status column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import held
from ..functions.text import cache_key, cited, strip
from . import retrieve
from .extract import CONTEXT_LIMIT, summarise
from .guard import injection_reason, output_guard, two_stage
from .mask import mask


@dataclass(frozen=True)
class Messages:
    """What a caller sees besides an answer; replace any of them."""

    empty: str = "Please ask a question."
    blocked: str = "This question can't be processed."
    guard_v2_reject: str = "This question can't be processed."
    empty_kb: str = "There are no documents yet."
    no_chunks: str = "The documents do not answer this."
    low_confidence: str = "The documents do not answer this with confidence."
    withheld: str = "The answer was withheld."
    unverified: str = "\n\nUnverified sources: "


@dataclass(frozen=True)
class AnswerConfig:
    k: int = 5
    depth: int = 20
    per_document: int = 2
    threshold: float = 0.15
    retrieval: str = "auto"
    prompt_version: str = "p1"
    llm_version: str = "stub"
    embedding_version: str = "none"
    excerpt: int = 100
    #: None leaves the guard out; else cited sentences less similar to their source are marked.
    grounding: float | None = None
    canary: str = ""
    #: (low, high) scores of the two-stage guard, None leaves it out.
    guard_v2: tuple[float, float] | None = None
    cache_ttl_seconds: int = 86_400
    messages: Messages = Messages()


def source_block(sources: Column) -> Column:
    """Numbered sources of an array of structs (rank, doc_type, title, text), joined by a blank line."""
    one = lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] (type="), F.coalesce(s["doc_type"], F.lit("document")), F.lit(", title="), F.coalesce(s["title"], F.lit("")), F.lit(")\n[DOC]\n"), strip(s["text"]), F.lit("\n[/DOC]"))
    return F.array_join(F.transform(sources, one), "\n\n")


def user_prompt(question: Column, sources: Column) -> Column:
    """Question, sources and an instruction that names only tags that exist."""
    tags = F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("]"))), ", ")
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Sources:\n"), source_block(sources)), F.concat(F.lit("Answer from the sources alone and cite them as "), tags, F.lit(".")))


def retrieval_query(question: Column, context: Column) -> Column:
    """The question, with a line of the context's summary where there is one."""
    return F.when(F.coalesce(strip(context), F.lit("")) == "", strip(question)).otherwise(F.concat(strip(question), F.lit("\nContext: "), context))


def stub_generate(prompt: Column, sources: Column) -> Column:
    """A deterministic stand-in for a language model: repeats the first source's first 80 characters and cites it."""
    return F.concat(F.substring(strip(F.get(sources, 0)["text"]), 1, 80), F.lit(" [S1]"))


def citation_links(answers: DataFrame) -> DataFrame:
    """(query_id, n, chunk_id, valid): each cited number with the source of that rank; numbers without one are invalid."""
    tags = answers.select("query_id", "sources", F.explode(cited(F.col("answer"))).alias("n"))
    return tags.select("query_id", "n", F.when((F.col("n") >= 1) & (F.col("n") <= F.size("sources")), F.get("sources", F.col("n") - 1)["chunk_id"]).alias("chunk_id")).withColumn("valid", F.col("chunk_id").isNotNull())


def cache_probe(keyed: DataFrame, cache: DataFrame, *, now: Column, ttl_seconds: int) -> DataFrame:
    """``keyed`` with cached_answer: the newest entry of its key, unless older than the ttl (equal still counts)."""
    newest = cache.groupBy("cache_key").agg(F.max_by("answer_text", "created_at").alias("_text"), F.max("created_at").alias("_at"))
    out = keyed.join(newest, "cache_key", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("_at")
    return out.withColumn("cached_answer", F.when(age <= ttl_seconds, F.col("_text"))).drop("_text", "_at")


def answer(queries: DataFrame, chunks: DataFrame, config: AnswerConfig = AnswerConfig(), *, generate=stub_generate, as_of: Column | None = None, cache: DataFrame | None = None, now: Column | None = None, rewrite=None, scorer=None, stage2=None) -> DataFrame:
    """One row for each query: status, answer, sources, citations, redactions, cache key and guard results.

    queries: query_id, question and optionally context, roles, doc_type, vector; chunks: chunk_id,
    document_id, title, doc_type, text and optionally vector, access_tags, freshness columns.

    status: empty, blocked, guard_v2_reject, empty_kb, no_chunks, low_confidence or ok; the first that
    applies. Only rows without an earlier status are retrieved, and only ok rows that ``cache`` (cache_key,
    answer_text, created_at) doesn't hold are generated. as_of switches the freshness filter on.
    rewrite(question) -> Column changes the text that is searched for, scorer reranks, stage2 belongs to
    the two-stage guard. A blocked answer keeps no sources.
    """
    asked = mask(queries.withColumn("question", F.coalesce("question", F.lit(""))).withColumn("raw_hash", F.sha2(F.coalesce("question", F.lit("")), 256)), "question")
    if "context" in queries.columns:
        # Spark computes the summary in Arrow batches; rows without a context are sent as nulls.
        asked = asked.withColumn("context", F.when(strip(F.col("context")) != "", summarise(F.substring("context", 1, CONTEXT_LIMIT))))
        asked = mask(asked, "context", counts_col="_more")
        merged = F.map_zip_with(F.coalesce("redactions", F.create_map().cast("map<string,int>")), F.coalesce("_more", F.create_map().cast("map<string,int>")), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        asked = asked.withColumn("redactions", merged).drop("_more")
    context = F.col("context") if "context" in queries.columns else F.lit(None).cast("string")
    asked = asked.withColumn("retrieval_query", retrieval_query(F.col("question"), context))
    asked = asked.withColumn("early", F.when(strip(F.col("question")) == "", "empty").when(injection_reason(F.col("retrieval_query")) != "ok", "blocked"))
    if config.guard_v2 is not None:
        low, high = config.guard_v2
        asked = two_stage(asked, "retrieval_query", stage2=stage2, low=low, high=high)
        asked = asked.withColumn("early", F.coalesce("early", F.when(F.col("zone") == "reject", "guard_v2_reject")))
    empty = chunks.limit(1).count() == 0
    live = held(asked, F.col("early").isNull()).withColumn("_search", rewrite(F.col("retrieval_query")) if rewrite is not None else F.col("retrieval_query"))
    ranking = retrieve.ranked(chunks, live, retrieval=config.retrieval, k=config.k, depth=config.depth, per_document=config.per_document, as_of=as_of, scorer=scorer, question_col="_search")
    found = ranking.drop("document_id").join(chunks.select("chunk_id", "document_id", "title", "doc_type", "text"), "chunk_id")
    entry = F.struct("rank", "chunk_id", "document_id", "title", "doc_type", "text", "score")
    every = found.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("retrieved"))
    out = asked.join(every, "query_id", "left")
    sure = F.filter("retrieved", lambda s: s["score"] >= config.threshold)
    status = F.coalesce("early", F.when(F.lit(empty), "empty_kb"), F.when(F.col("retrieved").isNull(), "no_chunks"), F.when(F.size(sure) == 0, "low_confidence"), F.lit("ok"))
    out = out.withColumns({"sources": sure, "status": status}).drop("early", "retrieved")
    ok = F.col("status") == "ok"
    out = out.withColumn("user_prompt", F.when(ok, user_prompt(F.col("question"), F.col("sources"))))
    key = cache_key(F.col("retrieval_query"), F.transform("sources", lambda s: s["chunk_id"].cast("string")), F.lit(config.prompt_version), F.lit(config.llm_version), F.lit(config.embedding_version))
    out = out.withColumn("cache_key", F.when(ok, key))
    if cache is not None:
        out = cache_probe(out, cache, now=now if now is not None else F.current_timestamp(), ttl_seconds=config.cache_ttl_seconds)
    else:
        out = out.withColumn("cached_answer", F.lit(None).cast("string"))
    out = out.withColumn("cached", ok & F.col("cached_answer").isNotNull())
    miss = ok & ~F.col("cached")
    out = out.withColumn("answer", F.coalesce("cached_answer", F.when(miss, generate(F.when(miss, F.col("user_prompt")), F.col("sources"))))).drop("cached_answer")
    out = out.withColumn("_cited", cited(F.col("answer")))
    valid = lambda n: (n >= 1) & (n <= F.size("sources"))
    out = out.withColumn("citations", F.transform(F.filter("_cited", valid), lambda n: F.struct(F.concat(F.lit("S"), n.cast("string")).alias("tag"), F.get(F.col("sources"), n - 1)["document_id"].alias("document_id"), F.get(F.col("sources"), n - 1)["score"].alias("score"))))
    out = out.withColumn("invalid_citations", F.filter("_cited", lambda n: ~valid(n)))
    warning = F.concat(F.lit(config.messages.unverified), F.array_join(F.transform("invalid_citations", lambda n: F.concat(F.lit("S"), n.cast("string"))), ", "))
    out = out.withColumn("answer", F.when(F.size("invalid_citations") > 0, F.concat("answer", warning)).otherwise(F.col("answer"))).drop("_cited")
    if config.grounding is not None:
        out = out.withColumns({"_contexts": F.transform("sources", lambda s: s["text"]), "_canary": F.lit(config.canary)})
        out = output_guard(out, contexts_col="_contexts", canary_col="_canary", threshold=config.grounding, fallback=config.messages.withheld)
        gone = F.coalesce("blocked", F.lit(False))
        out = out.withColumns({"answer": F.col("guarded"), "sources": F.when(~gone, F.col("sources")), "citations": F.when(~gone, F.col("citations"))}).drop("guarded", "_contexts", "_canary")
    says = F.lit(None).cast("string")
    for name in ("empty", "blocked", "guard_v2_reject", "empty_kb", "no_chunks", "low_confidence"):
        says = F.when(F.col("status") == name, getattr(config.messages, name)).otherwise(says)
    # Only the last two abstain; what comes before was not asked of the documents.
    abstained = F.col("status").isin("no_chunks", "low_confidence")
    return out.withColumns({"abstained": abstained, "message": says, "top_score": F.array_max(F.transform("sources", lambda s: s["score"]))})


#: The keys of an audit record, in order; each record has them all.
AUDIT = (
    ("timestamp", "string"), ("trace_id", "string"), ("event_type", "string"), ("action", "string"), ("target", "string"), ("input_hash", "string"), ("input_redacted", "string"), ("identity", "string"),
    ("is_authenticated", "boolean"), ("roles", "array<string>"), ("faithfulness_score", "double"), ("hallucination_rate", "double"), ("accessed_chunks", "array<string>"), ("llm_version", "string"),
    ("embedding_version", "string"), ("system_prompt_version", "string"), ("normalized_length", "int"), ("norm_drift", "int"), ("stage1_score", "double"), ("stage1_top_features", "array<struct<name:string,weight:double>>"),
    ("stage2_score", "double"), ("stage2_degraded", "boolean"), ("zone", "string"), ("model_version", "string"), ("guard_version", "string"), ("thresholds", "struct<low:double,high:double>"),
    ("output_checks", "struct<ungrounded:array<string>,canary:boolean,pii:array<string>,blocked:boolean>"), ("metadata", "map<string,string>"),
)


def audit_rows(answers: DataFrame, config: AnswerConfig = AnswerConfig(), *, now: Column | None = None) -> DataFrame:
    """One record of 28 keys for each answer: ids, hashes and counts, never the raw question or chunk texts.

    Columns of the answers named like a key (trace_id, identity, roles, ...) are taken; what nothing
    tells is null, the metadata hold the status and the redactions.
    """
    has = set(answers.columns)
    low_high = config.guard_v2 or (None, None)
    known = {
        "timestamp": F.date_format(F.to_utc_timestamp(now if now is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"),
        "event_type": F.lit("answer"), "input_hash": F.col("raw_hash") if "raw_hash" in has else F.sha2("question", 256), "input_redacted": F.substring("retrieval_query", 1, config.excerpt),
        "accessed_chunks": F.transform(F.coalesce("sources", F.array().cast(answers.schema["sources"].dataType)), lambda s: s["chunk_id"].cast("string")),
        "llm_version": F.lit(config.llm_version), "embedding_version": F.lit(config.embedding_version), "system_prompt_version": F.lit(config.prompt_version),
        "thresholds": F.when(F.lit(config.guard_v2 is not None), F.struct(F.lit(low_high[0]).cast("double").alias("low"), F.lit(low_high[1]).cast("double").alias("high"))),
        "metadata": F.map_filter(F.create_map(F.lit("status"), F.col("status"), F.lit("redactions"), F.to_json("redactions"), F.lit("abstained"), F.col("abstained").cast("string")), lambda k, v: v.isNotNull()),
    }
    if "zone" in has:
        known |= {"normalized_length": F.col("normalised_length"), "norm_drift": F.col("drift"), "stage1_top_features": F.col("top_features"), "stage2_score": F.col("stage2.confidence"), "stage2_degraded": F.col("stage2.degraded")}
    if "ungrounded" in has:
        known["output_checks"] = F.struct(F.col("ungrounded"), F.col("canary_leaked").alias("canary"), F.col("pii_categories").alias("pii"), F.col("blocked"))
    columns = [(known.get(name, F.col(name) if name in has else F.lit(None))).cast(kind).alias(name) for name, kind in AUDIT]
    return answers.select("query_id", *columns)


def windowed_audit(records: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, status, n) of a stream or table of audit records; records later than ``late`` are left out of a stream."""
    at = records.withColumn("at", F.to_timestamp("timestamp")).withColumn("status", F.try_element_at("metadata", F.lit("status")))
    return at.withWatermark("at", late).groupBy(F.window("at", width), "event_type", "status").agg(F.count("*").alias("n"))
