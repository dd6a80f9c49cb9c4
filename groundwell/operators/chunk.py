"""Chunking: paragraph packing as a native fold, structural chunking as an Arrow function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def _hard_windows(para: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters at a stride of size - overlap (1 at least) until the start passes the end."""
    stride = max(1, size - overlap)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(para) - 1, F.lit(0)), F.lit(stride)), lambda at: F.substring(para, at + 1, F.lit(size)))


def paragraph_windows(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Windows of whole paragraphs, joined by a blank line while they fit; longer paragraphs are cut hard."""
    paragraphs = F.filter(F.transform(F.split(strip(text), "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def flushed(s: Column) -> Column:
        return F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))

    def add(s: Column, para: Column) -> Column:
        fits = F.length(s["held"]) + F.length(para) + 2 <= size
        packed = F.when(s["held"] == "", para).otherwise(F.concat(s["held"], F.lit("\n\n"), para))
        whole = F.length(para) <= size
        done = F.when(fits, s["done"]).when(whole, flushed(s)).otherwise(F.concat(flushed(s), _hard_windows(para, size, overlap)))
        return F.struct(done.alias("done"), F.when(fits, packed).when(whole, para).otherwise(F.lit("")).alias("held"))

    return F.aggregate(paragraphs, start, add, flushed)


def chunk_paragraphs(docs: DataFrame, *, size: int = 500, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: all columns of the document, chunk_id "doc::i", chunk_index, content_type and the window as text."""
    out = docs.withColumn("_w", paragraph_windows(F.col(text_col), size, overlap)).drop(text_col)
    out = out.select(*out.columns, F.posexplode("_w").alias("chunk_index", text_col)).drop("_w")
    return out.withColumns({"chunk_id": F.concat_ws("::", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")), "content_type": F.lit("text")})


# The shapes of headings, table rows, separators and glossary lines, and prefixes that are no terms.
HEADING = re.compile(r"^(#{1,3})\s+(.+?)\s*$")
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")
GLOSSARY_LINE = re.compile(r"^\s*(?:[-*]\s+)?\*{0,2}(?P<term>[^\n:*]{1,40}?)\*{0,2}\s*:\s+(?P<definition>\S.*)$")
NO_TERMS = {"not", "note", "örnek", "example", "önemli", "important", "uyarı", "warning", "dikkat", "tip", "see", "also", "ayrıca", "nb"}


def pack(paragraphs: list[str], size: int, overlap: int) -> list[str]:
    """The same windows as ``paragraph_windows``, for one text in Python."""
    out: list[str] = []
    held: list[str] = []

    def used() -> int:
        return sum(map(len, held)) + 2 * max(0, len(held) - 1)

    for para in paragraphs:
        if used() + len(para) + 2 <= size:
            held.append(para)
            continue
        if held:
            out.append("\n\n".join(held))
        held = [para] if len(para) <= size else []
        if not held:
            out += [para[at : at + size] for at in range(0, len(para), max(1, size - overlap))]
    return out + ["\n\n".join(held)] * bool(held)


def sections(text: str):
    """(titles above, body) of each section with a body; levels 1 to 3 open sections."""
    path: dict[int, str] = {}
    body: list[str] = []
    for line in [*text.splitlines(), None]:
        found = HEADING.match(line) if line is not None else None
        if line is not None and not found:
            body.append(line)
            continue
        if "".join(body).strip():
            yield list(path.values()), "\n".join(body).strip()
        body = []
        if found:
            level = len(found[1])
            path = {k: v for k, v in path.items() if k < level} | {level: found[2].strip()}


def table_json(para: str) -> str | None:
    """{"columns", "rows"} of a table with a header and a dash rule; None for anything else."""
    lines = [line.strip() for line in para.splitlines() if line.strip()]
    if len(lines) < 2 or not TABLE_ROW.match(lines[0]) or not TABLE_RULE.match(lines[1]):
        return None
    header, *rows = ([c.strip() for c in line.strip("|").split("|")] for line in [lines[0], *lines[2:]])
    records = [{name: row[i] if i < len(row) else "" for i, name in enumerate(header)} for row in rows]
    return json.dumps({"columns": header, "rows": records}, ensure_ascii=False)


def glossary_entry(line: str) -> dict[str, str] | None:
    found = GLOSSARY_LINE.match(line)
    term = found["term"].strip() if found else ""
    if not term or not term[0].isalpha() or len(term.split()) > 5 or term.lower() in NO_TERMS:
        return None
    return {"term": term, "definition": found["definition"].strip()}


def structural_pieces(text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    """(content type, text): of each section its tables, then prose windows under the titles, then glossary batches."""
    out: list[tuple[str, str]] = []
    for titles, body in sections(text.strip()):
        prose, terms = [], []
        for para in filter(None, map(str.strip, body.split("\n\n"))):
            if table := table_json(para):
                out.append(("table", table))
                continue
            entries = [(line, glossary_entry(line)) for line in para.splitlines()]
            terms += [e for _, e in entries if e]
            if rest := "\n".join(line for line, e in entries if not e).strip():
                prose.append(rest)
        head = " > ".join(titles)
        out += [("text", f"{head}\n\n{w}" if head else w) for w in pack(prose, size, overlap)]
        batch, used = [], 2
        for entry in [*terms, None]:
            cost = len(json.dumps(entry, ensure_ascii=False)) + 1 if entry else 0
            if batch and (entry is None or used + cost > size):
                out.append(("glossary", json.dumps(batch, ensure_ascii=False)))
                batch, used = [], 2
            if entry:
                batch.append(entry)
                used += cost
    return out


def chunk_structural(docs: DataFrame, *, size: int = 500, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``chunk_paragraphs`` by headings, tables and glossary lines; the stateful parse runs in Arrow batches."""
    @F.pandas_udf("array<struct<content_type:string,text:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"content_type": k, "text": v} for k, v in structural_pieces(t or "", size, overlap)])

    out = docs.withColumn("_p", pieces(F.col(text_col))).drop(text_col)
    out = out.select(*out.columns, F.posexplode("_p").alias("chunk_index", "_x")).drop("_p")
    out = out.withColumns({"content_type": F.col("_x.content_type"), text_col: F.col("_x.text"), "chunk_id": F.concat_ws("::", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"))})
    return out.drop("_x")


def chunk(docs: DataFrame, strategy: str = "paragraph", **options) -> DataFrame:
    """Chunk by the named strategy; an unknown name is an error."""
    known = {"paragraph": chunk_paragraphs, "structural": chunk_structural}
    if strategy not in known:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known: {', '.join(known)}")
    return known[strategy](docs, **options)
