"""The training-data operators against brute force on small texts, with their edge cases."""

import collections
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import queries as llm_queries
from groundwell.llm import bit_sliced_topk, brown_lm, byte_bpe, decontaminate, license_scan, line_dedup, minhash_dedup, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string"
EDGE = [(900, None), (901, ""), (902, "  \n "), (903, "a"), (904, "Ünïcode wörds – “quoted” text 😀"), (905, "same row twice in the table here"), (905, "same row twice in the table here")]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["w" + str(i) for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 160))) for _ in range(60)]
    out = list(base)
    for text in base[:20]:
        for edits in (0, 1, 2, 4, 9):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            out.append(" ".join(w))
    hot = rng.choices(vocabulary, k=130)
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = "hot" + str(rng.randrange(50))
        out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)] + EDGE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_minhash_components(docs, rows):
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash_dedup.near_duplicates(docs, shingle=4).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id) for r in got)


def test_minhash_pairs_with_unlike_sketches(spark):
    # Pairs of 100 shingles at similarity 0.802 whose sketches agree in fewer than 198.4 of 256 bits.
    rows = []
    for k, seed in enumerate([968, 1062, 1081, 1946, 2845, 3231, 3443, 3501, 3926]):
        rng = random.Random(seed)
        text = [f"w{rng.randrange(10**6)}" for _ in range(103)]
        other = ["x" if i == 2 else "y" if i == 30 else "z" if i == 60 else w for i, w in enumerate(text)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_decontamination(spark):
    passage = "A train leaves the city Boston at 30 km per hour and reaches the town Denver after 4 hours of travel through old Boston today"
    other = passage.replace("Boston", "Paris").replace("Denver", "Lyon").replace("30", "55").replace("4 ", "7 ")
    mixed = other.replace("old Paris", "old Rome")
    docs = spark.createDataFrame([(1, "Before it. " + passage + " and after."), (2, other), (3, mixed), (4, "A clean text about other things that shares nothing at all with it"), *EDGE], SCHEMA)
    benchmark = spark.createDataFrame([(7, passage), (8, passage), (9, None), (10, "two words")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.first_item) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got[1] == (True, 7) and got[2] == (True, 7)
    assert not any(got[d][0] for d in got if d > 2)
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


def test_decontamination_of_number_heavy_and_short_items(spark):
    sums = "Compute 12 + 35 + 7 + 9 + 4 + 18 + 3 + 51"
    prose = "the quiet words of a longer text run on without any figure here. "
    half = prose + "It gives 5, 6, 8, 1, 2, 3, 4, 9, 11, 13, 17, 19, 23, 29, 31, 37"
    items = spark.createDataFrame([(1, sums), (2, half), (3, "Add 12 + 35"), (4, ""), (5, " + ")], "item_id long, text string")
    rows = [(1, prose + sums + ". And so on"), (2, sums.replace("35", "36")), (3, prose + half), (4, prose + "Add 12 + 35!"), (5, prose + "Add 12 + 36!"), *EDGE]
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), items, least_share=0.7).collect()}
    assert got == {(1, 1): 1.0, (3, 2): 1.0, (4, 3): 1.0}
    only_short = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), items.where("item_id = 3")).collect()
    assert [(r.doc_id, r.item_id) for r in only_short] == [(4, 3)]


def test_decontamination_slots_keep_their_places(spark):
    forms = ["he drove 60 km/h then went 30 km and later 40 km home", "at 5 km/hello or 7km/h, 3/4 km/h 2:30 hours.", "Near Paris it is 9 km/h/day (1,000.5 mph) in São Paulo", "no figure km/h here"]
    both = spark.createDataFrame([(t,) for t in forms], "text string").select(decontaminate.template_words(F.col("text")).alias("w"), decontaminate.template_words(F.col("text"), True).alias("v"))
    marks = (decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME)
    for r in both.collect():
        assert len(r.w) == len(r.v) and all(w == v if w[0] not in marks else w[0] == v[0] for w, v in zip(r.w, r.v, strict=True))
    item = "he drove the car at 60 km/h then went for 30 km and later another 40 km home to the old farm"
    long = " ".join(f"plain{i}" for i in range(12)) + " has 30 apples " + " ".join(f"middle{i}" for i in range(20)) + " has 30 apples " + " ".join(f"other{i}" for i in range(12))
    items = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    once = long.replace("has 30", "has 31", 1)
    rows = [(1, "before the 80 km/h zone " + item), (2, item.replace("60", "70").replace("30", "35")), (3, item.replace("30 km", "30 miles")), (4, once), (5, once.replace("has 30", "has 32"))]
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), items, least_share=0.3).collect()}
    # A changed value drops the windows that hold it if the rest is a copy.
    assert got == {(1, 1): 22, (2, 1): 22, (3, 1): 21, (4, 2): 49, (5, 2): 48}


def test_line_dedup(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\n\nx\nx\na b c d e f g"), (2, "a b z d e f\nx\n  "), (None, None), (3, ""), (4, "b c d e f\nq"), (None, "q"), (5, "a b c d e f\ta")], SCHEMA)
    got = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(1, 5): ("a b c d e f\n\nx", 2), (2, 3): ("  ", 2), (None, 0): (None, 0), (3, 1): ("", 0), (4, 2): ("q", 1), (None, 1): ("", 1), (5, 1): ("", 1)}


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    part = "".join(rng.choices("abcdefgh ü", k=700))
    texts = [part, "x" * 900, "head " + part[100:420] + " tail", part[50:249], part[300:505] + "".join(rng.choices("xyz", k=300)), "ab" * 150 + part[:230], None, "", "short", part]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for d, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, bytes(got[d].kept)) == (len(b), len(b) - len(kept), spans, kept)


def test_language_scores(docs, rows):
    count = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update([*words(t), None])
    total, distinct = sum(count.values()), len(count)
    base = class_based = 0.0
    for r in brown_lm.language_scores(docs, classes=8).collect():
        tokens = [*words(dict(rows)[r.doc_id]), None]
        want = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert r.base_score == pytest.approx(want) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(count[w] > 0 for w in tokens))
        base, class_based = base + want, class_based + r.score
    assert class_based > base


def test_exchange_keeps_the_last_classes():
    bigrams = np.random.default_rng(0).integers(0, 9, (42, 42)).astype(float)
    cls = brown_lm.exchange(bigrams, 5)
    assert set(cls[:40]) <= set(range(5)) and list(cls[40:]) == [5, 6]


@pytest.mark.parametrize("lookup", [6, 12, 1 << 18])
def test_every_word_has_a_class(spark, lookup):
    rng = random.Random(2)
    kinds = [[f"{kind}{i}" for i in range(12)] for kind in ("a", "b")]
    texts = [" ".join(rng.choices(kinds[k % 2], [70, 20, 10, *[3] * 9])[0] for k in range(40)) for _ in range(60)]
    texts += ["a11 unseen b11 unseen unseen"] * 3
    rows = list(enumerate(texts))
    trains = {d for d in range(len(rows)) if zlib.crc32(str(d).encode()) % 7 != 2 and d < 60}
    training = spark.createDataFrame([(rows[d][1],) for d in sorted(trains)], "text string")
    model, assigned = brown_lm.train(training, brown_lm.Scratch(spark, "test"), classes=2, exchange_words=6, lookup_words=lookup)
    count = collections.Counter(w for d in trains for w in [*words(texts[d]), None])
    cls = {int(np.uint64(k)): int(c) for k, c in zip(model.words.hashes, model.words.cls, strict=True)} | {r.key % (1 << 64): r.cls for r in assigned.collect()}
    assert len(cls) == len(count) - 1
    data = np.frombuffer(" ".join(sum(kinds, [])).encode(), np.uint8)
    starts, ends, _ = brown_lm.wh.word_spans(data, np.array([0, len(data)]))
    of = dict(zip(sum(kinds, []), brown_lm.wh.word_hashes(data, starts, ends).tolist(), strict=True))
    # Words of a kind share a class, also those outside the exchange.
    assert all(len({cls[of[w]] for w in kind if w in count}) == 1 for kind in kinds) and cls[of["a0"]] != cls[of["b0"]]
    # Class bigrams of all training tokens, and probabilities that sum to 1 after each class.
    table = collections.Counter()
    for d in trains:
        tokens = [3, *(cls[of[w]] for w in words(texts[d])), 3]
        table.update(zip(tokens, tokens[1:], strict=False))
    assert list(model.size) == [sum(n for (_, c), n in table.items() if c == k) for k in range(4)]
    assert np.allclose(model.next_class.sum(1)[[0, 1, 3]], 1)
    got = brown_lm.language_scores(spark.createDataFrame([(d, t) for d, t in rows], SCHEMA), classes=2, exchange_words=6, lookup_words=lookup).collect()
    # Without words beyond the lookup, scores are the same.
    want = {r.doc_id: r for r in brown_lm.language_scores(spark.createDataFrame(rows, SCHEMA), classes=2, exchange_words=6).collect()}
    assert all((r.n_known, r.score, r.base_score) == (want[r.doc_id].n_known, pytest.approx(want[r.doc_id].score), pytest.approx(want[r.doc_id].base_score)) for r in got)


def test_toxicity(spark):
    rng = random.Random(1)
    calm = [f"calm{i}" for i in range(80)]
    rows, labels = [], []
    for d in range(400):
        toxic = d % 4 == 0
        parts = [" ".join(rng.choices(calm, k=8)) for _ in range(rng.randrange(1, 8))]
        if toxic:
            parts.insert(rng.randrange(len(parts) + 1), "you are a nasty" + rng.choice(["word", "slur"]) + " person")
        rows.append((d, ". ".join(parts) + "."))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows + EDGE, SCHEMA)
    marks = spark.createDataFrame(labels + [(900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks, locate=True).collect()}
    fresh = [d for d, _ in rows if got[d].held_out]
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in fresh]) > 0.95
    assert got[901].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert any("nasty" in s for s in got[0].offending)
    assert toxicity.drop_toxic(docs, marks.limit(0)).count() == len(rows) + len(EDGE)


def test_license_scan(spark):
    docs = spark.createDataFrame([(1, "MIT License mit-license  GNU General Public License, version 3.0 Apache License 2.0"), *EDGE], SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (15, 4, 0, 11, "apache,gpl,mit")
    assert got[1].labels == "apache,apache-2.0,gpl,gpl-3,mit"
    assert (got[900].n_words, got[900].n_base, got[900].first_word, got[900].labels, got[900].score) == (0, 0, None, "", 0.0)
    assert len(license_scan.signature_rules()) > 200


def test_url_filter(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://"), (4, "HTTP://A.Example.ORG/es/x?y#z"), (5, "x://org"), (6, "https://org/en"), (7, "https://m.example.org/en/12"), (8, "ftp://a.com/de/1"), (9, "https://xorg/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[5][:3] == ("org", "", None)
    assert got[6] == ("org", "/en", "org/", "allow") and got[7][2:] == ("example.org/en/1", "block") and got[8][2:] == ("com/de/", "block") and got[9][2] is None
    seed = url_filter.judge(url_filter.seed_table(spark).select(F.col("label").alias("page_id"), "url"), rules=()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id) for r in seed]) > 0.95


def test_byte_bpe_round_trip(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*EDGE, (1, "The quick brown fox's 1234567 jumps\n\n  over"), (2, "x" * 5000), (3, "<|endoftext|> \t ñandú 漢字")]
    for r in byte_bpe.encode_decode(spark.createDataFrame(rows, SCHEMA), vocabulary=path, pattern=public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode()


def test_top_k_exact(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.2, (300, 7))
    vectors[100:160] = vectors[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(400, None), (401, [float("nan")] * 7), (402, [None] * 7), (403, [1.0] * 3), (5, [float(x) for x in vectors[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in bit_sliced_topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    q = np.floor(256 * vectors).astype(int)
    want = []
    for i in range(0, 300, 50):
        score = q @ q[i]
        rows_left = sorted((-int(score[j]), j) for j in [*range(300), 5] if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(rows_left)]
    assert got == sorted(want)


def test_top_k_with_repeated_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, -1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])] + [(3, [0.9, 0.0])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.createOrReplaceTempView("embeddings_with_copies")
    got = sorted(tuple(r) for r in bit_sliced_topk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    con = duckdb.connect()
    con.execute("create table embeddings as select * from (values " + ", ".join(f"({i}, {v}::double[])" for i, v in rows) + ") t(vec_id, embedding)")
    assert got == sorted(con.execute(llm_queries.ORACLE["op10_bit_sliced_topk"]).fetchall())
    assert [r[2] for r in got if r[0] == 0] == [1, 1, 3, 3, 3] and sum(r[0] == 50 for r in got) == 10


def test_top_k_ids_and_edges(spark):
    kinds = "vec_id int, embedding array<float>, id string, dim int, block long, queries string"
    assert bit_sliced_topk.top_k(*[spark.createDataFrame([], kinds)] * 2).count() == 0
    df = spark.createDataFrame([(0, [1.0], "x", 1, 2, "q"), (None, [1.0], "x", 1, 2, "q"), (2, [0.5], "x", 1, 2, "q"), (3, [], "x", 1, 2, "q")], kinds)
    assert sorted(tuple(r) for r in bit_sliced_topk.top_k(df, df).collect()) == [(0, 1, 2, 32768), (2, 1, 0, 32768)]
    with pytest.raises(TypeError):
        bit_sliced_topk.top_k(df.withColumn("vec_id", F.lit("a")), df)


def operators(spark):
    """Each operator over documents, with tables of its own beside them."""
    import public_tokenizers

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "some words in a row here and there again"), (2, "some words in a row here and there again"), (3, None)], "item_id long, text string")
    return {
        "minhash": minhash_dedup.near_duplicates, "leaks": lambda d: decontaminate.contamination(d, items), "lines": line_dedup.dedup_lines, "repeats": suffix_dedup.remove_repeats,
        "lm": lambda d: brown_lm.language_scores(d, classes=2), "tox": lambda d: toxicity.toxicity(d, labels), "license": license_scan.scan,
        "urls": lambda d: url_filter.judge(d, id_col="doc_id", url_col="text"),
        "bpe": lambda d: byte_bpe.encode_decode(d, vocabulary=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN),
    }


NAMES = ["minhash", "leaks", "lines", "repeats", "lm", "tox", "license", "urls", "bpe"]
#: Names that operators use inside.
CLASH = "id row doc words filled w places k n h pos line key item place at share _id _kept _lines _all _picked kept of others lines picked _text _gone low high right ranges spans offending score label priority host path rule grams best text_1 a b d1 cls".split()


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_and_extra_columns(spark, name):
    run = operators(spark)[name]
    clash = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    assert run(spark.createDataFrame([], clash)).count() == 0
    full = spark.createDataFrame([(1, "some words in a row here", *CLASH)], clash)
    out = run(full).collect()
    assert len(out) == 1 and out[0].doc_id == 1
    if name in ("lines", "bpe"):  # the others return their own columns only
        assert all(out[0][c] == c for c in CLASH) and out[0].text == "some words in a row here"


@pytest.mark.parametrize("name", NAMES)
def test_nulls_repeats_and_long_texts(spark, name):
    """One row for each row; equal rows get equal results; null ids and very long texts pass."""
    rng = random.Random(2)
    long = " ".join(rng.choice(["mit license", "apple", "Bob has 3 km", "see http://a.org/es/x"]) + str(rng.randrange(10**5)) for _ in range(3_000))
    rows = [(1, "same row. some words in a row here and there again"), (1, "same row. some words in a row here and there again"), (None, None), (None, "text of a null id"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long)]
    out = operators(spark)[name](spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in rows)
    same = [r.asDict() for r in out if r.doc_id == 1]
    assert all(v == (pytest.approx(same[1][c]) if isinstance(v, float) else same[1][c]) for c, v in same[0].items())
    if name == "leaks":
        assert [r.contaminated for r in out if r.doc_id in (1, 5)] == [True, True, False]
