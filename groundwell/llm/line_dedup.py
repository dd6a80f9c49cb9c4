"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as word sequences, and the edit bound is one word: inserted, deleted or
replaced. A line goes if an earlier line of any document, by (id, line number), is equal or within
the bound; so the earliest stays. One edit keeps a similarity of 0.8 from five words on; shorter
lines go only if they repeat exactly. Blank lines always stay.

Equal lines are one class, found by partial aggregation. Two lines within one edit share the first
or the last half of the shorter one, so only classes that share a half with another class emit
their variants: the line itself, and the line without word p, for each p. Equal (variant, p) means
a replacement at p, a variant equal to a whole line an insertion. Every bucket needs only its
earliest members, so no bucket is expanded into pairs; each hit is then verified on the words.

Defined cases: null text stays null with no lines; an empty text is one blank line; rows that share
an id share their line positions (repeated rows get equal results); null ids sort last; an empty
table stays empty; very long texts and lines are read whole, a line of n words makes n + 1 variants;
all columns pass through, whatever their names, except that the added ones replace columns of the
same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch

#: Words from which one edit is within the bound.
NEAR_WORDS = 5


_SHIFT = 1 << 31


def _order(id_type: T.DataType):
    """(position, its id, its line): positions order lines by id, null last, then line number.

    For integer ids a position is one decimal, which hash aggregation can hold; else a struct.
    """
    if not isinstance(id_type, T.IntegralType):
        position = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("line").alias("line"))
        return position, F.col("pos.id"), F.col("pos.line")
    kind = id_type.simpleString()
    position = F.expr(f"cast(coalesce(cast(id as decimal(20,0)), 9223372036854775808BD) * {_SHIFT}BD + cast(line as decimal(10,0)) as decimal(38,0))")
    line = F.expr(f"cast(pmod(pos, {_SHIFT}BD) as int)")
    return position, F.expr(f"case when pos < 9223372036854775808BD * {_SHIFT}BD then cast((pos - pmod(pos, {_SHIFT}BD)) div {_SHIFT}BD as {kind}) end"), line


def _without(words: str, p: str) -> str:
    """SQL of a word array without its word p (from 0)."""
    return f"concat(slice({words}, 1, {p}), slice({words}, {p} + 2, size({words})))"


#: SQL of (p, v) for the word hashes h: p = -1 and the hash of the line, then p and the hash without word p.
#: The hash of a sequence is the exclusive or of the hashes of (place, word), so each deletion follows
#: from the one before it in one step. The running values are made in blocks, as an array that grows
#: word by word would be copied for each word of a very long line.
_BLOCK = 256
_VARIANTS = f"""
get(transform(array(transform(h, (x, i) -> if(i = 0, 0L, xxhash64(i - 1, x) ^ xxhash64(i - 1, h[i - 1])))), step ->
 get(transform(array(aggregate(sequence(0, (size(h) - 1) div {_BLOCK}),
   array(aggregate(transform(h, (x, i) -> if(i = 0, 0L, xxhash64(i - 1, x))), 0L, (s, x) -> s ^ x)),
   (s, k) -> concat(s, array(element_at(s, -1) ^ aggregate(slice(step, k * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a ^ x))))), starts ->
  concat(array(named_struct('p', -1, 'v', aggregate(transform(h, (x, i) -> xxhash64(i, x)), 0L, (s, x) -> s ^ x))),
   transform(flatten(transform(sequence(0, (size(h) - 1) div {_BLOCK}), k ->
     slice(aggregate(slice(step, k * {_BLOCK} + 1, {_BLOCK}), array(starts[k]), (s, x) -> concat(s, array(element_at(s, -1) ^ x))), 2, {_BLOCK}))),
    (v, i) -> named_struct('p', i, 'v', v)))), 0)), 0)"""


def _plain(line: Column) -> Column:
    """The line with single spaces between words; lines that hold no other white space skip the pattern."""
    odd = F.contains(line, F.lit("  "))
    for space in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line, norm): each line of (id, text) with single spaces between its words; not the blank ones."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return lines.select("id", "line", _plain(F.col("raw")).alias("norm")).where("norm <> ''")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less its repeated lines, and n_lines, n_kept, n_removed (long)."""
    scratch = Scratch(docs.sparkSession, "lines")
    position, id_of, line_of = _order(docs.schema[id_col].dataType)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = _lines(texts).withColumn("n", F.expr("length(norm) - length(replace(norm, ' ', '')) + 1"))
    half = lambda size, sign: F.expr(f"case when n >= {NEAR_WORDS} then xxhash64({sign}1, {size}, substring_index(norm, ' ', {sign}({size}))) end")  # noqa: E731
    halves = {f"k{i}": half(size, sign) for i, (size, sign) in enumerate((s, e) for s in ("n div 2", "(n - 1) div 2") for e in ("", "-"))}
    keyed = keyed.select("id", "line", "n", position.alias("pos"), F.xxhash64("norm").alias("whole"), F.xxhash64(F.lit(7), "norm").alias("check"), *(c.alias(k) for k, c in halves.items()))
    classes = scratch.settle(keyed.groupBy("whole", "check", "n").agg(F.min("pos").alias("pos"), *(F.min(k).alias(k) for k in halves)))

    # Classes that share a half with another class.
    keys = F.expr("array_distinct(filter(array(k0, k1, k2, k3), k -> k is not null))")
    shared = scratch.settle(classes.select(F.explode(keys).alias("key")).groupBy("key").count().where("count > 1").select("key"))
    close = scratch.settle(classes.select("pos", F.explode(keys).alias("key")).join(shared, "key").select("pos").distinct().select("pos", id_of.alias("id"), line_of.alias("line")))
    some = scratch.settle(close.select("id").distinct())
    # Below the session's own broadcast limit Spark sends these ids to the scan; beyond it, it joins by shuffle.
    nearby = _lines(texts.join(some, texts["id"].eqNullSafe(some["id"]), "left_semi")).select(position.alias("pos"), "norm")
    words = nearby.join(close.select("pos"), "pos").dropDuplicates(["pos", "norm"])
    words = scratch.settle(words.select("pos", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h")))
    scratch.drop(shared, some, close)

    # The earliest line of each (variant, deleted word); p = -1 is the line itself.
    variants = words.select("pos", F.expr(f"explode({_VARIANTS})").alias("x")).select("pos", "x.p", "x.v")
    variants = scratch.settle(variants)
    first = variants.groupBy("v", "p").agg(F.min("pos").alias("same"), F.count("*").alias("lines"))
    by_variant = Window.partitionBy("v")
    first = first.withColumns({"plain": F.min(F.when(F.col("p") < 0, F.col("same"))).over(by_variant), "cut": F.min(F.when(F.col("p") >= 0, F.col("same"))).over(by_variant), "all": F.sum("lines").over(by_variant)})
    first = scratch.settle(first.where("all > 1").select("v", "p", "same", "plain", "cut"))
    hits = variants.join(first, ["v", "p"]).select("pos", F.explode(F.when(F.col("p") < 0, F.array("cut")).otherwise(F.array("same", "plain"))).alias("earlier")).where("earlier < pos").distinct()
    ends = hits.join(words.withColumnRenamed("h", "a"), "pos").join(words.select(F.col("pos").alias("earlier"), F.col("h").alias("b")), "earlier")
    within = F.expr(
        f"""case when size(a) = size(b) then size(filter(zip_with(a, b, (x, y) -> x <> y), z -> z)) <= 1
            when size(a) = size(b) + 1 then exists(sequence(0, size(b)), p -> {_without('a', 'p')} = b)
            when size(b) = size(a) + 1 then exists(sequence(0, size(a)), p -> {_without('b', 'p')} = a) else false end"""
    )
    near = scratch.settle(ends.where(within).select("pos").distinct())

    kept = classes.select("pos").join(near, "pos", "left_anti").select(id_of.alias("id"), line_of.alias("line"))
    kept = kept.groupBy(F.col("id").alias("of")).agg(F.collect_set("line").alias("kept"))
    added = ("n_lines", "n_kept", "n_removed")
    rest = [c for c in docs.columns if c not in added]
    others = [F.col(f"`{c}`") for c in rest if c != text_col]  # packed, so that no name of theirs meets one used here
    out = docs.select(F.struct(*others).alias("others"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out.join(kept, out["id"].eqNullSafe(kept["of"]), "left").withColumn("lines", F.split("text", "\n"))
    blank = F.filter(F.transform("lines", lambda line, i: F.when(_plain(line) == "", i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    out = out.withColumn("all", F.array_sort(F.array_union(F.coalesce("kept", none), F.coalesce(blank, none))))
    picked = F.transform("all", lambda i: F.get("lines", i))
    picked = F.filter(picked, lambda line: line.isNotNull())
    out = out.withColumn("picked", F.when(F.col("text").isNotNull(), picked))
    n_lines, n_kept = (F.coalesce(F.size(F.when(F.col("text").isNotNull(), F.col(c))), F.lit(0)).cast("long") for c in ("lines", "picked"))
    n_lines, n_kept = F.greatest(n_lines, F.lit(0).cast("long")), F.greatest(n_kept, F.lit(0).cast("long"))
    out = out.withColumns({"n_lines": n_lines, "n_kept": n_kept}).withColumn("n_removed", F.col("n_lines") - F.col("n_kept"))
    columns = [F.array_join("picked", "\n").alias(c) if c == text_col else F.col(f"others.`{c}`") for c in rest]
    return out.select(*columns, *added)


#: DuckDB SQL of doc_id, n_lines, n_kept, n_removed and the SHA-256 of the text that is left.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, trim(regexp_replace(ls[i], '[ 	
]+', ' ', 'g'), ' ') AS norm
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT norm, min((doc_id, i)) AS pos, string_split(norm, ' ') AS ws FROM l WHERE norm <> '' GROUP BY norm),
v AS (SELECT pos, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') AS v
      FROM (SELECT pos, ws, unnest(range(1, len(ws) + 1)) AS p FROM f WHERE len(ws) >= 5)),
g AS (SELECT v, p, min(pos) AS first FROM v GROUP BY v, p),
w AS (SELECT norm, pos FROM f WHERE len(ws) >= 5),
gone AS (
  SELECT v.pos FROM v JOIN g ON v.v = g.v AND v.p = g.p WHERE g.first < v.pos
  UNION SELECT v.pos FROM v JOIN w ON v.v = w.norm WHERE w.pos < v.pos
  UNION SELECT w.pos FROM v JOIN w ON v.v = w.norm WHERE v.pos < w.pos),
k AS (SELECT pos[1] AS doc_id, pos[2] AS i FROM f WHERE pos NOT IN (SELECT pos FROM gone)
      UNION ALL SELECT doc_id, i FROM l WHERE norm = ''),
a AS (SELECT doc_id, list(i ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(kept), 0) AS BIGINT) AS n_kept,
       CAST(len(ls) - coalesce(len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(kept, lambda i: ls[i]), chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""
