"""The pipeline's stages on small planted documents: decisions take effect, clean documents stay."""

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from groundwell.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    path = str(tmp_path_factory.mktemp("tables"))
    vocabulary = [f"word{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = "A box holds exactly twelve red marbles and seven blue ones so how many marbles are in five boxes"
    clean = [(i, "\n".join(prose(30) for _ in range(4))) for i in range(60)]
    near = [(100, clean[0][1].replace("word1", "other1", 1)), (101, clean[1][1])]
    one_line = prose(200)
    near += [(102, one_line), (103, " ".join(["changed", *one_line.split()[1:100], "and", "more", *one_line.split()[100:]]))]
    leaks = [(200, prose(20) + "\n" + item + "\n" + prose(20))]
    toxic = [(300 + i, prose(20) + ". you nasty horrible slur person. " + prose(20)) for i in range(40)]
    rows = clean + near + leaks + toxic + [(400, None), (401, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 300)) for d, _ in rows if d < 60 or d >= 300 and d < 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{folder}/documents.parquet").schema]
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not any(300 <= d < 400 for d in kept["toxicity"]) and set(range(60)) <= kept["toxicity"]
    assert not {100, 101} & kept["line_dedup"] and {102, 103, 400, 401} <= kept["line_dedup"]
    assert 103 not in kept["minhash_dedup"] and 102 in kept["minhash_dedup"]
    assert 200 not in kept["decontamination"] and set(range(60)) <= kept["decontamination"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.where(F.col("doc_id") == 401).first().n_tokens == 0
    assert out.count() >= 60


def test_run_against_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    from groundwell.llm import byte_bpe

    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = [(d, t) for d, t in rows if 1 - math.prod(1 - p for p in brute.sentence_scores(t, model)) < 0.5]
    lines = brute.line_dedup(rows)
    left = [(d, t, None if lines[d] is None else "\n".join(lines[d])) for d, t in rows]
    rows = [(d, new) for d, t, new in left if t is None or len(lines[d]) == len(t.split("\n")) or new.strip(" ")]
    near = brute.near_duplicates(rows, 5)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    gone = {d for d, _ in brute.leaks(rows, [(r.item_id, r.text) for r in items.collect()])}
    rows = [(d, t) for d, t in rows if d not in gone]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(want) and gone


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_tables(spark, folder, k):
    """Empty tables stay empty; nulls, repeated rows and extra columns pass with the columns of the input."""
    name, stage = corpus_pipeline.STAGES[k]
    more = COLUMNS + ", _kept string, n_removed string, id int, text_1 string"
    empty = stage(spark, spark.createDataFrame([], more), folder)
    assert empty.columns == [c.split()[0] for c in more.split(", ")] and empty.count() == 0
    rows = [(1, "a line of six words here\nand more", "en", "s", 0, "x", "y", 7, "z")] * 2 + [(None, None, None, None, None, None, None, None, None), (None, "text of a null id stays", "en", "s", 1, None, None, None, None), (2, "", "en", "s", 0, "a", "b", 1, "c")]
    out = stage(spark, spark.createDataFrame(rows, more), folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out if r.text) == [(0, "text of a null id stays"), (1, rows[0][1]), (1, rows[0][1])]
    assert len(out) == 5 and all((r._kept, r.n_removed, r.id, r.text_1) == ("x", "y", 7, "z") for r in out if r.doc_id == 1), name
