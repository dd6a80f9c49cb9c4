"""Sources and sinks: text directories, uploads, golden sets, audit logs, caches."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError, StoreError
from ..operators.ingest import TEXT_SUFFIXES, unique_ids, upload_reject

GOLDEN = "question_id string, question string, expected_sources array<string>, golden_chunks array<string>, golden_answer string, category string"


def read_directory(spark: SparkSession, folder: str, *, recursive: bool = True, suffixes=TEXT_SUFFIXES) -> DataFrame:
    """(path, doc_id, text) of the text files below a folder; bytes that are no UTF-8 are replaced."""
    pattern = "(?i)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(F.col("path").rlike(pattern))
    return unique_ids(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))


def read_uploads(spark: SparkSession, folder: str, *, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of the top level of a folder; rejects carry reject_reason."""
    files = spark.read.format("binaryFile").load(folder)
    judged = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("reject_reason", upload_reject(F.col("name"), F.col("content"), max_bytes))
    return judged.where("reject_reason is null").select("path", "name", F.col("content").cast("string").alias("text")), judged.where("reject_reason is not null").select("path", "name", "reject_reason")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden rows of a JSON-lines file; blank lines are skipped.

    A malformed line, a missing id or question and a value of a wrong type raise with file and line
    number. Lines are numbered within each file, which is read as one text: golden sets are small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value")).where("trim(value) <> ''")
    parsed = whole.withColumn("r", F.from_json("value", GOLDEN + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    texts = [F.array_contains(keys, c) & F.get_json_object("value", f"$.{c}").isNotNull() & ~F.get_json_object("value", f"$.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("question_id", "question", "golden_answer", "category")]
    raw = lambda c: F.try_variant_get(F.try_parse_json("value"), f"$.{c}", "variant")
    lists = [F.col(f"r.{c}").isNull() & F.get_json_object("value", f"$.{c}").isNotNull() for c in ("expected_sources", "golden_chunks")]
    kinds = [raw(c).isNotNull() & ~F.schema_of_variant(raw(c)).isin("STRING", "VOID") for c in ("question_id", "question", "golden_answer", "category")]
    why = F.when(F.try_parse_json("value").isNull(), "malformed").when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), "a value has a wrong type")
    why = why.when(F.col("r.question_id").isNull() | F.col("r.question").isNull(), "question_id or question is missing")
    why = why.when(reduce(or_, [*texts, *lists, *kinds]), "a value has a wrong type")
    said = F.concat(F.lit("golden set "), F.col("file"), F.lit(", line "), (F.col("at") + 1).cast("string"), F.lit(": "), why)
    checked = parsed.withColumn("r", F.when(why.isNotNull(), F.raise_error(said)).otherwise(F.col("r")))
    none = F.array().cast("array<string>")
    return checked.select("r.question_id", "r.question", F.coalesce("r.expected_sources", none).alias("expected_sources"), F.coalesce("r.golden_chunks", none).alias("golden_chunks"), F.coalesce("r.golden_answer", F.lit("")).alias("golden_answer"), "r.category")


def read_policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, role permissions) of a JSON policy: {"roles": {name: [permission]}, "rules": [{resource, action, roles, permissions}]}.

    ``access.check_access`` takes both tables; to change a policy, edit them.
    """
    text = spark.read.text(path, wholetext=True).first()
    try:
        policy = json.loads(text[0] if text else "")
        roles = [(str(name), [str(p) for p in granted]) for name, granted in policy.get("roles", {}).items()]
        rules = [(str(r["resource"]), str(r["action"]), [str(x) for x in r.get("roles", [])], [str(x) for x in r.get("permissions", [])]) for r in policy.get("rules", [])]
    except (ValueError, TypeError, KeyError, AttributeError) as error:
        raise SourceError(f"policy {path}: {error}") from error
    return spark.createDataFrame(rules, "resource string, action string, roles array<string>, permissions array<string>"), spark.createDataFrame(roles, "role string, granted array<string>")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, event_type: str | None = None) -> DataFrame:
    """Audit records, bad lines dropped, filtered by event type before any limit of the caller; none if there is no log yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return out if event_type is None else out.where(F.col("event_type") == event_type)


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def reset_to(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def reset_chunks(chunks: DataFrame, path: str) -> None:
    chunks.limit(0).write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with defaults for columns that older files lack; files that were replaced since an earlier read are listed anew."""
    if not exists(spark, path):
        raise StoreError(f"no chunk table at {path}")
    spark.catalog.refreshByPath(path)
    out = spark.read.option("mergeSchema", "true").parquet(path)
    defaults = {"content_type": F.lit("text"), "obsolete": F.lit(False), "access_tags": F.array().cast("array<string>")}
    return out.withColumns({c: F.coalesce(F.col(c), d) if c in out.columns else d for c, d in defaults.items()})


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id)


def chunks_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks whose id is listed; missing ids are omitted."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def latest_cache(cache: DataFrame) -> DataFrame:
    """Newest answer of each key of an append-only cache."""
    return cache.groupBy("cache_key").agg(F.max_by("answer_text", "created_at").alias("answer_text"), F.max("created_at").alias("created_at"))


def rewrites_alive(cache: DataFrame, now) -> DataFrame:
    """Newest rewrite of each query hash that is not older than its own ttl."""
    newest = cache.groupBy("query_hash").agg(F.max_by(F.struct("rewritten_query", "ttl_seconds"), "created_at").alias("r"), F.max("created_at").alias("created_at"))
    return newest.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= F.col("r.ttl_seconds")).select("query_hash", "r.rewritten_query")


CACHE = "cache_key string, answer_text string, created_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_cache(rows: DataFrame, path: str) -> None:
    """Add answers; the newest of a key holds when the cache is read."""
    rows.select("cache_key", "answer_text", "created_at").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)


def append_rewrites(rows: DataFrame, path: str) -> None:
    rows.select("query_hash", "rewritten_query", "created_at", "ttl_seconds").write.mode("append").parquet(path)


EVALUATIONS = "id long, run_id string, question_id string, retrieved array<string>, metrics map<string,double>, answer string"


def append_results(results: DataFrame, path: str, run_id: str) -> None:
    """Add a run's samples to the evaluation store. The ids grow from run to run, so the newest run is that of the largest id."""
    spark = results.sparkSession
    base = (read_results(spark, path).agg(F.max("id")).first()[0] or 0) + 1
    rows = results.withColumn("id", F.monotonically_increasing_id() + F.lit(base)).withColumn("run_id", F.lit(run_id))
    columns = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(EVALUATIONS).fields]
    rows.select(*columns).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATIONS).parquet(path) if exists(spark, path) else spark.createDataFrame([], EVALUATIONS)


def collections(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, rows) of the chunk tables below a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    names = sorted(f.getPath().getName() for f in listed if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))
    return [(name, spark.read.parquet(f"{folder}/{name}").count()) for name in names]
