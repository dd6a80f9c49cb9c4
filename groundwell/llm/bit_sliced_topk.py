"""Exact top-k by integer inner product on a bit-sliced index.

Each component is quantised to floor(scale * x). Rows are dealt into blocks of bounded size; in a
block, bit b of attribute j over all rows is one bitmap. For a query, the inner product of all rows
of a block is added up with bitmap arithmetic alone: each set bit t of a query weight adds the
slices of its attribute, shifted by t, and carry-save adders reduce all shifted slices to one
bitmap per bit of the sum. Negative weights add complemented slices, which differs by a constant.
The top rows are then selected from the most significant sum slice downward: rows with the bit set
are taken if fewer than needed, else the others are dismissed. What is left at the end are exactly
the rows tied on the boundary score; the smallest ids among them fill up. Blocks give k rows a
query, and the k best of those are the result.

Every query meets every block, in blocks of queries: the stated work of an exact search. Results
are exact for every input whose scores fit 64 bits.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
null ids; a query meets vectors of its own length only; each row is a candidate by itself, so a
repeated row may take several ranks (k of its copies are indexed, which is all a result can hold),
and a query by itself, so a repeated query gives its result as often; a row is no candidate of a
query with its own id; ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives an empty result; ids must be whole numbers; very long vectors make blocks of fewer rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch

BLOCK_ROWS = 32_768
#: Components of a block, which bound its rows where vectors are long.
BLOCK_CELLS = 1 << 22
BLOCK_QUERIES = 2_048
#: Tasks of the search; beyond it a task takes several pairs of a block and a part of the queries, one by one.
MOST_TASKS = 20_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long; null for a vector that takes no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def build_slices(table: pa.Table) -> pa.Table:
    """Pack the rows (id, q) of one block, sorted by id, into bitmaps."""
    table = table.sort_by("id")
    n, dim = table.num_rows, table.column("dim")[0].as_py()
    values = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
    low = int(values.min()) if dim else 0
    bits = (int(values.max()) - low).bit_length() if dim else 0
    words = -(-n // 64)
    level = np.zeros((dim, words * 64), np.uint64)
    level[:, :n] = (values - low).T.astype(np.uint64)
    planes = np.zeros((dim, bits, words), "<u8")
    for b in range(bits):
        planes[:, b] = np.packbits((level >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block")[:1], "ids": [ids.astype("<i8").tobytes()], "low": pa.array([low], pa.int64()), "bits": pa.array([bits], pa.int32()), "planes": pa.array([planes.tobytes()], pa.binary())})


def slice_sum(levels: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Add bitmaps: levels[w] holds those of weight 2**w. Returns the slices of the sum, lowest first."""
    out, w = [], 0
    while levels:
        held = levels.pop(w, [])
        up = levels.setdefault(w + 1, [])
        at = 0
        while len(held) - at >= 3:
            a, b, c = held[at], held[at + 1], held[at + 2]
            at += 3
            t = a ^ b
            held.append(t ^ c)
            t &= c
            t |= a & b
            up.append(t)
        if len(held) - at == 2:
            up.append(held[at] & held[at + 1])
            out.append(held[at] ^ held[at + 1])
        else:
            out.append(held[at] if len(held) > at else np.zeros(words, np.uint64))
        if not up:
            del levels[w + 1]
        w += 1
    return out


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among the valid rows; ties on the boundary go to the lowest rows."""
    left, taken = valid, np.zeros_like(valid)
    for plane in reversed(slices):
        high = left & plane
        count = int(np.bitwise_count(high).sum())
        if count >= k:
            left = high
        elif count:
            taken |= high
            left = left & ~plane
            k -= count
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(taken), rows(left)[:k]])


def _searcher(k: int):
    def search(batches):
        for batch in batches:
            found: dict[str, list] = {"query_id": [], "query_key": [], "times": [], "vec_id": [], "score": []}
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                n, dim, bits, low = len(ids), row["dim"], row["bits"], row["low"]
                words = -(-n // 64)
                plain = np.frombuffer(row["planes"], "<u8").astype(np.uint64).reshape(dim, bits, words)
                turned = plain ^ ONES
                everyone = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
                top = (1 << bits) - 1
                for q in row["queries"]:
                    levels: dict[int, list[np.ndarray]] = {}
                    base = 0
                    for j, weight in enumerate(q["q"]):
                        source = plain if weight >= 0 else turned
                        base += weight * low + (weight * top if weight < 0 else 0)
                        size, t = abs(weight), 0
                        while size:
                            if size & 1:
                                for b in range(bits):
                                    levels.setdefault(t + b, []).append(source[j, b])
                            size >>= 1
                            t += 1
                    slices = slice_sum(levels, words)
                    valid = everyone.copy()
                    for own in range(int(np.searchsorted(ids, q["id"])), int(np.searchsorted(ids, q["id"], "right"))):
                        valid[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    rows = select_top(slices, valid, k)
                    score = [base] * len(rows)
                    for w, plane in enumerate(slices):
                        for i, bit in enumerate(((plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).tolist()):
                            score[i] += bit << w
                    found["query_id"] += [q["id"]] * len(rows)
                    found["query_key"] += [q["key"]] * len(rows)
                    found["times"] += [q["times"]] * len(rows)
                    found["vec_id"] += ids[rows].tolist()
                    found["score"] += score
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return search


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``rows`` for each row of ``queries``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")

    def prepared(df: DataFrame) -> DataFrame:
        """The distinct rows, and how often each occurs: one row many times over is no large group."""
        out = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q")).where("id is not null and q is not null")
        return out.groupBy("id", "q").agg(F.count("*").alias("times")).withColumns({"key": F.xxhash64("id", "q"), "dim": F.size("q")})

    if not isinstance(rows.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    every, asked = scratch.settle(prepared(rows)), scratch.settle(prepared(queries))
    held = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CELLS) / F.greatest("dim", F.lit(1)))))
    copies = F.least("times", F.lit(k)).cast("int")
    sizes = every.groupBy("dim").agg(F.ceil(F.sum(copies) / held).cast("long").alias("blocks"))
    # Queries are dealt into more parts where there are fewer pairs of a block and a part than cores; neither changes the result.
    fewest = F.ceil(4 * spark.sparkContext.defaultParallelism / F.col("blocks"))
    asks = asked.groupBy("dim").agg(F.count("*").alias("n"))
    plan = sizes.join(asks, "dim").select("dim", "blocks", F.greatest(F.ceil(F.col("n") / BLOCK_QUERIES), F.least(F.ceil(F.col("n") / 32), fewest)).cast("long").alias("parts"))
    plan = scratch.settle(plan)
    pairs = plan.agg(F.coalesce(F.sum(F.col("blocks") * F.col("parts")), F.lit(0))).first()[0]
    dealt = every.join(plan, "dim").withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("block", F.pmod(F.xxhash64("key", "copy"), "blocks"))
    index = dealt.select("dim", "block", "id", "q").groupBy("dim", "block").applyInArrow(build_slices, "dim int, block long, ids binary, low long, bits int, planes binary")
    index = scratch.settle(index)
    packed = asked.join(plan, "dim").withColumn("part", F.pmod("key", "parts")).groupBy("dim", "part", "blocks").agg(F.collect_list(F.struct("id", "key", "times", "q")).alias("queries"))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = index.join(packed, ["dim", "block"]).repartition(int(min(max(pairs, 1), MOST_TASKS)), "dim", "block", "part")
    met = met.select("dim", "ids", "low", "bits", "planes", "queries")
    best = scratch.settle(met.mapInArrow(_searcher(k), "query_id long, query_key long, times long, vec_id long, score long"), batch_rows=4)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
