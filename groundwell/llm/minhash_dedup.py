"""MinHash near-duplicate groups with tensored banding.

Two small collections of half keys are made for each text, each half key from ``half_width``
minhashes. The table keys are all pairs of a half key of the first and one of the second
collection, so ``side**2`` tables of ``2 * half_width`` hashes cost only ``2 * side *
half_width`` minhashes: about the square root of what independent tables take.

With side = 10 and half_width = 2 a pair at similarity 0.8 shares no table with probability
below 1e-4, and each candidate is then confirmed on its full shingle sets.

No group is expanded into its pairs. Texts with equal sets become one class. In each bucket the
links to the bucket's smallest class, its centre, are confirmed first, and components are made.
Members that share a centre but not a component are then compared in blocks of bounded size by
their differences to the centre, which gives exact similarities and emits a spanning forest only.
The few members that a centre's sketch shows to be unlike it are compared with the members of
their buckets that have another component. Set sizes that can't reach the threshold discard pairs
before any set is read. A one-permutation sketch of 256 bits decides how a member is compared, and
between members discards pairs that look 40 points below the threshold (some 5 deviations at 100 shingles).

Defined cases: null or blank text has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle; very long texts are read whole; a null id is never linked and
is kept; rows that share an id are one document (a link of either text links the id, the size is the
row's own); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import wordhash as wh
from .components import component_of
from .scratch import Scratch

SKETCH_BITS = 256
#: Texts with fewer shingles than this skip the sketch test, as their sketches vary more.
SKETCH_LEAST = 100
#: Percent of similarity to a centre, by sketch, from which a class is compared by its difference to it.
STAR_PERCENT = 30
#: Members of a star that are compared at a time with as many others.
STAR_BLOCK = 384
#: Integer ids of candidate texts are broadcast up to this many, others by Spark's own limit; else they are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _row_sets(column, size):
    """Yields (row, sorted distinct shingle hashes) for each text of an Arrow column."""
    for at, end, data, bounds in wh.slices(column):
        starts, ends, upto = wh.word_spans(data, bounds)
        words = wh.word_hashes(data, starts, ends)
        for k in range(end - at):
            yield at + k, np.unique(wh.shingles(words[upto[k] : upto[k + 1]], size))


def _signer(id_name: str, size: int, side: int, width: int):
    def sign(batches):
        rng = np.random.default_rng(20240229)
        scale = rng.integers(1, 1 << 63, 2 * side * width, dtype=np.uint64) * wh.U(2) + wh.U(1)
        tags = wh.mix(np.arange(1, 2 * side + 1, dtype=np.uint64))
        edges = (np.arange(SKETCH_BITS, dtype=np.uint64) << wh.U(56)).astype(np.uint64)
        bits = wh.U(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            marks = np.zeros((n, 2), np.uint64)
            halves = np.zeros((n, 2 * side), np.uint64)
            sketch = np.zeros((n, SKETCH_BITS // 64), np.uint64)

            def flush(rows, sets, halves=halves):
                if not rows:
                    return
                flat = np.concatenate(sets)
                begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
                part = np.zeros((len(rows), 2 * side), np.uint64)
                for k, a in enumerate(scale):
                    low = np.minimum.reduceat((flat * a) >> wh.U(20), begin)
                    part[:, k // width] = part[:, k // width] * wh.U(0xC2B2AE3D27D4EB4F) + low
                halves[rows] = wh.mix(part ^ tags)

            rows, sets, held = [], [], 0
            for row, s in _row_sets(batch.column(1), size):
                if not len(s):
                    continue
                count[row] = len(s)
                marks[row] = s.sum(dtype=np.uint64), wh.mix(s ^ wh.U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                first = s[np.searchsorted(s, edges) % len(s)] & wh.U(1)
                sketch[row] = (first.reshape(-1, 64) * bits).sum(1, dtype=np.uint64)
                rows.append(row)
                sets.append(s)
                held += len(s)
                if held > 400_000:
                    flush(rows, sets)
                    rows, sets, held = [], [], 0
            flush(rows, sets)
            signed = halves.view(np.int64)
            lists = [pa.ListArray.from_arrays(np.arange(0, n * side + 1, side, dtype=np.int32), pa.array(np.ascontiguousarray(part).ravel())) for part in (signed[:, :side], signed[:, side:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), *(pa.array(marks[:, k].view(np.int64)) for k in (0, 1)), *lists, *(pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(4))],
                names=["id", "n", "h1", "h2", "a", "b", "s0", "s1", "s2", "s3"],
            )

    return sign


def _set_reader(size: int):
    def read(batches):
        for batch in batches:
            packed = [s.tobytes() for _, s in _row_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "packed"])

    return read


def _confirmer(percent: int):
    def confirm(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["u", "v"])

    return confirm


def _star_tester(percent: int, kind: pa.DataType):
    """Links between the members of one block pair of a star, from their differences to its centre.

    With d(x) the symmetric difference of x and the centre, |x ^ y| = |d(x)| + |d(y)| - 2 |d(x) & d(y)|,
    so the exact similarity of x and y follows from short lists. Emits a spanning forest of the links
    between different components: fewer rows than members.
    """

    def links(rows: list[dict]) -> list[tuple]:
        m = len(rows)
        parts = np.unique([r["part"] for r in rows], return_inverse=True)[1]
        if parts.max(initial=0) == 0:
            return []
        diffs = [np.frombuffer(r["diff"], np.uint64) for r in rows]
        size = np.array([r["n"] for r in rows], np.int64)
        away = np.array([len(d) for d in diffs], np.int64)
        values, place = np.unique(np.concatenate(diffs), return_inverse=True)
        owner = np.repeat(np.arange(m), away)
        shared = np.zeros((m, m), np.float32)
        width = max(1, 8_000_000 // m)
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for low in range(0, len(values), width):
            at = slice(*np.searchsorted(place, [low, low + width]))
            held = np.zeros((m, min(width, len(values) - low)), np.float32)
            held[owner[at], place[at] - low] = 1
            shared += held @ held.T
        apart = away[:, None] + away[None] - 2 * shared.astype(np.int64)
        both = (size[:, None] + size[None] - apart) // 2
        linked = 100 * both >= percent * (size[:, None] + size[None] - both)
        linked |= parts[:, None] == parts[None]
        left, out = np.ones(m, bool), []
        for root in range(m):
            stack = [root] if left[root] else []
            left[root] = False
            while stack:
                i = stack.pop()
                new = np.flatnonzero(linked[i] & left)
                left[new] = False
                stack += new.tolist()
                out += [(rows[i]["v"], rows[j]["v"]) for j in new if parts[i] != parts[j]]
        return out

    def test(batches):
        held, mark = [], None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                key = row["u"], row["low"], row["high"]
                if key != mark:
                    found += links(held) if held else []
                    held, mark = [], key
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], names=["u", "v"])
        found = links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], names=["u", "v"])

    return test


def _differ(batches):
    for batch in batches:
        diffs = []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            diffs.append(np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 6)), pa.array(diffs, pa.binary())], names=["u", "v", "n", "part", "home", "diff"])


def _agreeing(x: str, y: str, percent: int):
    """Whether two sketches may belong to sets of that similarity; small sets always may."""
    agree = F.lit(SKETCH_BITS)
    for k in range(4):
        agree = agree - F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}")))
    return (F.least(f"{x}n", f"{y}n") < SKETCH_LEAST) | (agree >= SKETCH_BITS * (1 + percent / 100) / 2)


def _near(x: str, y: str, percent: int):
    """Whether two classes can reach the threshold by their sizes."""
    return F.least(f"{x}n", f"{y}n") * 100 >= F.greatest(f"{x}n", f"{y}n") * percent


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, side: int = 10, half_width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = id_type.simpleString()
    signed = scratch.settle(texts.mapInArrow(_signer(id_col, shingle, side, half_width), f"id {kind}, n long, h1 long, h2 long, a array<long>, b array<long>, s0 long, s1 long, s2 long, s3 long"), batch_rows=2000)
    alike = scratch.settle(signed.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")))
    classed = scratch.settle(
        signed.where("n > 0 and id is not null").join(alike, ["n", "h1", "h2"])
        .select("id", "rep", "n", *(F.when(F.col("id") == F.col("rep"), F.col(c)).alias(c) for c in ("a", "b")), "h1", "h2", "s0", "s1", "s2", "s3")
    )
    reps = classed.where("id = rep").dropDuplicates(["rep", "n", "h1", "h2"])
    info = scratch.settle(reps.select("rep", "n", "s0", "s1", "s2", "s3"))

    keys = reps.select("rep", "b", F.explode("a").alias("x")).select("rep", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep")
    buckets = scratch.settle(keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead"))
    held = scratch.settle(keys.join(buckets, "key").select("key", "lead", "rep").distinct())
    scratch.drop(buckets)

    def with_info(pairs: DataFrame) -> DataFrame:
        for side_name in ("u", "v"):
            pairs = pairs.join(info.select(F.col("rep").alias(side_name), *(F.col(c).alias(side_name + c) for c in ("n", "s0", "s1", "s2", "s3"))), side_name)
        return pairs

    def set_table(wanted: DataFrame) -> DataFrame:
        wanted = scratch.settle(wanted.distinct())
        if isinstance(id_type, T.IntegralType) and wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return scratch.settle(texts.join(wanted, "id", "left_semi").mapInArrow(_set_reader(shingle), f"id {kind}, packed binary"), batch_rows=2000)

    def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for end in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("id").alias(end), F.col("packed").alias("p" + end)), end)
        return pairs

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The linked ones of distinct candidate pairs (u, v)."""
        return scratch.settle(with_sets(pairs, sets).select("u", "v", "pu", "pv").mapInArrow(_confirmer(percent), f"u {kind}, v {kind}"), batch_rows=200)

    stars = with_info(held.where("rep <> lead").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct())
    stars = scratch.settle(stars.withColumn("like", _agreeing("u", "v", STAR_PERCENT)).withColumn("near", _near("u", "v", percent)).select("u", "v", F.col("vn").alias("n"), "like", "near"))
    first = stars.where("near").select("u", "v")
    sets = set_table(first.select(F.explode(F.array("u", "v")).alias("id")))
    links = confirmed(first, sets)
    scratch.drop(sets)
    part = component_of(scratch, links)

    # Members of one star in different components, in blocks. Those with the centre's component need no
    # comparison with each other, so a large star costs its size times that of its other members.
    near_parts = stars.where("like").join(part.withColumnRenamed("node", "v"), "v", "left").withColumn("part", F.coalesce("component", "v")).drop("component")
    near_parts = near_parts.join(part.withColumnRenamed("node", "u"), "u", "left").withColumn("home", F.col("part") == F.coalesce("component", "u"))
    near_parts = scratch.settle(near_parts.select("u", "v", "n", "part", "home"))
    blocks = lambda at_home: F.ceil(F.count_if(F.col("home") == at_home) / STAR_BLOCK).cast("int")
    split = near_parts.groupBy("u").agg(F.min("part").alias("p"), F.max("part").alias("q"), blocks(True).alias("homes"), blocks(False).alias("others")).where("p < q")
    split = scratch.settle(split.select("u", "homes", "others"))
    members = scratch.settle(near_parts.join(split, "u"))
    sets = set_table(members.select(F.explode(F.array("u", "v")).alias("id")))
    moved = scratch.settle(with_sets(members.select("u", "v", "n", "part", "home"), sets).select("u", "v", "n", "part", "pu", "pv", "home").mapInArrow(_differ, f"u {kind}, v {kind}, n long, part {kind}, home boolean, diff binary"), batch_rows=200)
    scratch.drop(sets, members, near_parts)
    # Blocks of the centre's component have numbers below 0.
    dealt = moved.join(split, "u").withColumn("own", F.when(F.col("home"), -1 - F.pmod(F.xxhash64("v"), F.greatest("homes", F.lit(1)))).otherwise(F.pmod(F.xxhash64("v"), F.greatest("others", F.lit(1)))))
    dealt = dealt.withColumn("other", F.explode(F.filter(F.sequence(F.when(F.col("home"), F.lit(0)).otherwise(-F.col("homes")), F.col("others"), F.lit(1)), lambda i: i < F.col("others"))))
    dealt = dealt.select("u", F.least("own", "other").cast("int").alias("low"), F.greatest("own", "other").cast("int").alias("high"), "v", "n", "part", "diff")
    dealt = dealt.repartition("u", "low", "high").sortWithinPartitions("u", "low", "high", "part", "v")
    links = scratch.settle(links.unionByName(dealt.mapInArrow(_star_tester(percent, to_arrow_type(id_type)), f"u {kind}, v {kind}")), batch_rows=500)

    # Members unlike their centre, with the members of their buckets in other components.
    unlike = stars.where("not like").select(F.col("u").alias("lead"), F.col("v").alias("rep"), F.lit(True).alias("unlike"))
    crowded = held.groupBy("key").agg(F.count("*").alias("m")).where("m > 2").select("key")
    placed = held.where("rep <> lead").join(crowded, "key").join(unlike, ["lead", "rep"], "left").join(part.withColumnRenamed("node", "rep"), "rep", "left")
    placed = scratch.settle(placed.select("key", "rep", F.coalesce("unlike", F.lit(False)).alias("unlike"), F.coalesce("component", "rep").alias("part")))
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("unlike").alias("some")).where("p < q and some").select("key")
    scratch.drop(held)
    rest = scratch.settle(placed.join(scratch.settle(mixed), "key").join(info, "rep"))
    scratch.drop(placed)
    ends = {x: rest.select("key", *(F.col(c).alias(x + c) for c in ("rep", "unlike", "part", "n", "s0", "s1", "s2", "s3"))) for x in ("u", "v")}
    second = ends["u"].where("uunlike").join(ends["v"], "key").where("upart <> vpart and (not vunlike or urep < vrep)").where(_near("u", "v", percent) & _agreeing("u", "v", percent - 40))
    second = scratch.settle(second.select(F.least("urep", "vrep").alias("u"), F.greatest("urep", "vrep").alias("v")).distinct())
    scratch.drop(rest)
    if second.count():
        links = scratch.settle(links.unionByName(confirmed(second, set_table(second.select(F.explode(F.array("u", "v")).alias("id"))))))
    part = component_of(scratch, links)

    ids = classed.select("id", "rep").distinct()
    # Rows of one id with different texts join the classes of all their texts.
    clashing = ids.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("u", "v")
    if not clashing.isEmpty():
        part = component_of(scratch, scratch.settle(links.unionByName(clashing)))
    found = ids.groupBy("id").agg(F.min("rep").alias("rep")).join(part.withColumnRenamed("node", "rep"), "rep", "left")
    found = scratch.settle(found.select("id", F.coalesce("component", "rep").alias("component_id")))
    out = signed.select("id", "n").join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, all columns unchanged.

    Rows that repeat an id share its fate.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
