"""Ingestion transforms: metadata, titles, types, tags, ids, upload checks and the corpus chain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .chunk import chunk
from .guard import injection_reason
from .mask import mask

# Accepted suffixes and leading bytes of binary formats.
TEXT_SUFFIXES = (".md", ".txt", ".json", ".xml", ".log")
UPLOAD_SUFFIXES = (*TEXT_SUFFIXES, ".pdf")
SIGNATURES = (("pdf", "25504446"), ("png", "89504E47"), ("jpg", "FFD8FF"), ("gif", "47494638"), ("zip", "504B0304"), ("gz", "1F8B08"), ("elf", "7F454C46"), ("exe", "4D5A"))


def metadata(text: Column) -> Column:
    """Map of the first line ``**Metadata:** a: b · c: d``: keys lower-cased, the first colon splits, the last of equal keys wins."""
    line = F.regexp_extract(text, r"(?m)^\s*\*\*Metadata:\*\*\s*(.+)$", 1)
    parts = F.filter(F.split(line, "·"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(strip(F.substring_index(p, ":", 1))).alias("key"), strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def title(text: Column, fallback: Column) -> Column:
    """First non-blank line: without leading #s if it is a heading, else its first 80 characters; else the fallback."""
    first = F.element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != ""), 1)
    return F.coalesce(F.when(F.startswith(first, F.lit("#")), strip(F.regexp_replace(first, "^#+", ""))).otherwise(F.substring(first, 1, 80)), fallback)


def doc_type(name: Column, prefixes: dict[str, str]) -> Column:
    """Type of the first prefix, in mapping order, that the file name starts with; else "document"."""
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), F.lit(t)) for p, t in prefixes.items()), F.lit("document"))


def access_tags(tags: Column) -> Column:
    """Distinct tags in order; null means none; a blank tag raises."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.exists(tags, lambda t: strip(t) == ""), F.raise_error(F.lit("blank access tag"))).otherwise(F.array_distinct(tags))


def freshness(meta: Column) -> dict[str, Column]:
    """effective_date, expiry_date (null where absent or malformed) and obsolete."""
    return {"effective_date": F.try_to_date(meta["effective_date"]), "expiry_date": F.try_to_date(meta["expiry_date"]), "obsolete": F.coalesce(F.lower(meta["obsolete"]) == "true", F.lit(False))}


def unique_ids(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with doc_id: the first path of a stem takes the stem, others stem_ext, then stem_ext_2 and so on.

    No two files share an id. A name that is some file's stem belongs to that file, so others pass it
    over; what still collides after that (a_b.c and a.b_c, say) gets a suffix from its path's hash. Windows
    are split by stem and extension, and only the first of a stem is found by an aggregate, so many files
    of one name (README.md in each folder) meet in one task only with those of the same extension.
    """
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    out = files.withColumns({"_stem": F.regexp_replace(name, r"\.[^.]*$", ""), "_ext": F.regexp_extract(name, r"\.([^.]*)$", 1)})
    stems = out.groupBy(F.col("_stem").alias("_s")).agg(F.min(path_col).alias("_first"))
    out = out.join(stems, F.col("_stem") == F.col("_s")).drop("_s")
    own = F.col(path_col) == F.col("_first")
    out = out.withColumn("_b", F.row_number().over(Window.partitionBy("_stem", "_ext", own).orderBy(path_col)))
    wide = F.concat_ws("_", "_stem", F.nullif(F.col("_ext"), F.lit("")))
    out = out.withColumn("_id", F.when(own & (F.col("_b") == 1), F.col("_stem")).when(F.col("_b") == 1, wide).otherwise(F.concat_ws("_", wide, F.col("_b").cast("string"))))
    taken = stems.select(F.col("_s").alias("_id"), F.lit(True).alias("_taken"))
    out = out.withColumn("_own", own & (F.col("_b") == 1)).join(taken, "_id", "left")
    again = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("_own"), path_col))
    clash = ~F.col("_own") & (F.coalesce("_taken", F.lit(False)) | (F.col("_again") > 1))
    out = out.withColumn("_again", again)
    doc_id = F.when(clash, F.concat_ws("_", "_id", F.substring(F.sha2(F.col(path_col), 256), 1, 12))).otherwise(F.col("_id"))
    return out.withColumn("doc_id", doc_id).select(*files.columns, "doc_id")


def upload_reject(name: Column, content: Column, max_bytes: int | None = None) -> Column:
    """Why an upload is rejected, or null: size, suffix, empty, signature, encoding, blank, in this order."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kind = F.lit(None).cast("string")
    for label, prefix in reversed(SIGNATURES):
        kind = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(prefix)), label).otherwise(kind)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return (
        F.when(F.octet_length(content) > (max_bytes if max_bytes is not None else (1 << 62)), "too_large")
        .when(~suffix.isin(*UPLOAD_SUFFIXES), "unsupported_suffix")
        .when(F.octet_length(content) == 0, "empty")
        .when(kind.isNotNull() & ((suffix != ".pdf") | (kind != "pdf")), "content_mismatch")
        .when((suffix == ".pdf") & kind.isNull(), "missing_pdf_signature")
        .when(suffix == ".pdf", "pdf_reader_missing")
        .when(text.isNull(), "undecodable")
        .when(strip(text) == "", "no_text")
    )


def described(docs: DataFrame, *, name_col: str = "name", text_col: str = "text", prefixes: dict[str, str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """``docs`` with what the text and the file name tell: title, doc_type, effective_date, expiry_date, obsolete, access_tags."""
    meta = metadata(F.col(text_col))
    stem = F.regexp_replace(F.col(name_col), r"\.[^.]*$", "")
    out = docs.withColumns({"title": title(F.col(text_col), stem), "doc_type": doc_type(F.col(name_col), prefixes or {}), **freshness(meta)})
    given = F.array(*map(F.lit, tags)) if tags else F.lit(None).cast("array<string>")
    return out.withColumn("access_tags", access_tags(given))


def upload_id(path: Column, text: Column) -> Column:
    """A deterministic id of an upload: repeated tasks give the same one."""
    return F.concat(F.lit("upload_"), F.substring(F.sha2(F.concat_ws("\x1f", path, text), 256), 1, 12))


def pdf_text(uploads: DataFrame, reader, *, content_col: str = "content") -> DataFrame:
    """``uploads`` with text: ``reader(bytes) -> list of page texts``, blank pages left out, a blank line between pages; null where it fails."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        def one(raw):
            try:
                pages = [p.strip() for p in reader(bytes(raw))]
            except Exception:  # any reader's error means: this is no usable PDF
                return None
            return "\n\n".join(p for p in pages if p) or None

        return contents.map(one)

    return uploads.withColumn("text", read(F.col(content_col)))


def ingest(docs: DataFrame, *, strategy: str = "paragraph", size: int = 500, overlap: int = 80, check_injection: bool = False, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects): mask, optionally refuse injections, chunk. The corpus form does not run the injection check."""
    masked = mask(docs, text_col)
    reason = injection_reason(F.col(text_col)) if check_injection else F.lit("ok")
    judged = masked.withColumn("reject_reason", F.when(reason != "ok", reason))
    return chunk(judged.where("reject_reason is null").drop("reject_reason", "redactions"), strategy, size=size, overlap=overlap), judged.where("reject_reason is not null")
