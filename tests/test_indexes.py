"""Stored indexes: exact rankings, updates equal to indexes built anew, groups that stay as they are."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.operators import retrieval
from tessera.sources import grouped, lexical, vectors


def brute_bm25(asked, chunks, k):
    words = {c: re.findall(r"\w+", t.lower()) if t is not None else [] for c, t in chunks.items()}
    sizes = [len(words[c]) for c, t in chunks.items() if t is not None]
    n, mean, tf = len(chunks), sum(sizes) / max(1, len(sizes)), {c: Counter(w) for c, w in words.items()}
    df = Counter(t for w in tf.values() for t in w)
    out = set()
    for q, text in asked:
        terms, scored = set(re.findall(r"\w+", text.lower())), []
        for c, counts in tf.items():
            met = [t for t in terms if t in counts]
            parts = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(words[c]) / mean)) for t in met]
            if met:
                scored.append((-sum(int(x * 1_000_000 + 0.5) for x in parts), c))
        out |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def some_chunks(rng, n, start=0):
    words = ["the"] * 30 + ["of"] * 20 + [f"w{i}" for i in range(60)]
    return [(f"{d}-{i}", d, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for d in range(start, start + n) for i in range(rng.randint(1, 4))]


CHUNK = "chunk_id string, doc_id long, chunk_index int, content string"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 12)
    monkeypatch.setattr(lexical, "GROUP_BLOCKS", 4)


def ranked(asked, index, k, seeds=2):
    return {tuple(r) for r in retrieval.bm25(asked, index, k, seeds).select("query_id", "chunk_id", "score", "rank").collect()}


def test_lexical_index(spark, tmp_path, small_blocks):
    rng = random.Random(7)
    rows = some_chunks(rng, 120) + [("900-0", 900, 0, None), ("901-0", 901, 0, ""), ("902-0", 902, 0, "w1 W1, w1!")]
    asked = [(i, " ".join(rng.choice(["the", "of", "w1", "w2", "w7", "w33"]) for _ in range(8))) for i in range(9)] + [(50, "the of"), (51, "zzz"), (52, "w1")]
    q = spark.createDataFrame(asked, "query_id int, text string")
    index = lexical.built(spark.createDataFrame(rows, CHUNK), str(tmp_path / "a"))
    want = brute_bm25(asked, {c: t for c, _, _, t in rows}, 5)
    for seeds in (1, 3, 1000):
        assert ranked(q, index, 5, seeds) == want
    assert index.blocks > 8 and index.postings.filter("n <> size(places) or most <> array_max(tfs) or least <> array_min(lengths)").count() == 0
    # a change of few documents: groups without them keep their files
    gone, new = [r[0] for r in rows if r[1] in (3, 4, 900)], [("5-0", 5, 0, "w33 w33 the"), *some_chunks(rng, 3, start=2000)]
    names = lambda: {(r["kind"], r["group"], r["version"]) for r in grouped.manifest(spark, index.folder)}
    before = names()
    later = lexical.updated(index, spark.createDataFrame([(c,) for c in gone], "chunk_id string"), spark.createDataFrame(new, CHUNK))
    now = {c: t for c, _, _, t in rows if c not in gone} | {c: t for c, _, _, t in new}
    assert ranked(q, later, 5) == brute_bm25(asked, now, 5) == ranked(q, lexical.built(spark.createDataFrame([(c, int(c.split("-")[0]), int(c.split("-")[1]), t) for c, t in now.items()], CHUNK), str(tmp_path / "b")), 5)
    assert ranked(q, index, 5) == want  # what was opened before stays as it was
    assert before & names() and any(v == 1 for *_, v in names())
    assert ranked(q, lexical.opened(spark, index.folder), 5) == ranked(q, later, 5)
    nothing = spark.createDataFrame([], CHUNK)
    assert lexical.updated(later, nothing, nothing) is later
    emptied = lexical.updated(later, later.chunks.select("chunk_id"), nothing)
    assert emptied.chunks.count() == 0 and ranked(q, emptied, 5) == set()


def test_blocks_out_of_reach_are_not_scored(spark, tmp_path, small_blocks):
    rows = [(f"{d}-0", d, 0, "rare words here" if d == 7 else "common words of many") for d in range(300)]
    index = lexical.built(spark.createDataFrame(rows, CHUNK), str(tmp_path))
    q = spark.createDataFrame([(1, "rare words")], "query_id int, text string")
    hits = retrieval.bm25(q, index, 1, 1)
    assert [tuple(r)[:2] for r in hits.collect()] == [(1, "7-0")]
    one = index.postings.filter("term = 'words'").count()
    assert one > 15  # the bounds of 'words' alone are below the first block's best


def test_neighbours_read_their_groups_only(spark, tmp_path, small_blocks):
    rows = [(f"{d}-{i}", d, i, "x") for d in range(40) for i in (10, 12, 13)]
    index = lexical.built(spark.createDataFrame(rows, CHUNK), str(tmp_path))
    anchors = spark.createDataFrame([("q", "5-13", 5, 13, 900)], "query_id string, chunk_id string, doc_id long, chunk_index int, score long")
    out = retrieval.expand_neighbours(anchors, index, 2)
    assert [(r["chunk_id"], r["score"], r["nearest"]) for r in out.collect()] == [("5-12", 855, "5-13")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*group#\d+ (IN|=|INSET)", plan) and "NestedLoop" not in plan


def brute_cosine(asked, rows, k):
    out = set()
    for q, x in asked:
        scored = []
        for i, v in rows.items():
            lengths = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in v))
            c = sum(a * b for a, b in zip(x, v)) / lengths * 1_000_000 if lengths else 0.0
            scored.append((-int(math.copysign(math.floor(abs(c) + 0.5), c)), i))
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 8)) * 4
    rows = {i: (middles[i % 12] + rng.normal(size=8) * 0.3).astype(np.float32).tolist() for i in range(400)}
    rows |= {500: [0.0] * 8, 501: rows[7], 502: [-x for x in rows[7]]}
    schema = "vec_id long, embedding array<float>"
    index = vectors.built(spark.createDataFrame(list(rows.items()) + [(None, rows[1]), (600, None)], schema), str(tmp_path), cell_vectors=30, sample=200)
    asked = [(i, rows[i]) for i in (0, 7, 100, 399)] + [(1000, [0.0] * 8), (1001, [1.0] + [0.0] * 7)]
    q = spark.createDataFrame(asked, "query_id int, embedding array<float>")

    def found(index, k=6):
        hits, reads = retrieval.nearest_in(q, index, k)
        return {tuple(r) for r in hits.select("query_id", "vec_id", "score", "rank").collect()}, {r["query_id"]: (r["cells"], r["read"]) for r in reads.collect()}

    hits, reads = found(index)
    assert hits == brute_cosine(asked, rows, 6)
    assert reads[7][0] >= 14 and reads[7][1] <= reads[7][0] // 3 and reads[1000][1] == reads[1000][0]  # near vectors lie in few cells; without length all may
    new = {7: rng.normal(size=8).astype(np.float32).tolist(), 700: rows[100]}
    later = vectors.updated(index, spark.createDataFrame([(0,), (5,)], "vec_id long"), spark.createDataFrame(list(new.items()), schema))
    now = {i: v for i, v in rows.items() if i not in (0, 5)} | new
    assert found(later)[0] == brute_cosine(asked, now, 6) and found(index)[0] == hits
    assert found(vectors.updated(later, later.vectors.select("vec_id"), spark.createDataFrame([], schema)))[0] == set()
    with pytest.raises(Exception, match="8 numbers"):
        vectors.updated(index, spark.createDataFrame([], "vec_id long"), spark.createDataFrame([(1, [1.0])], schema))
    assert os.path.isdir(tmp_path / "centres")


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data"))


def test_a_build_leaves_no_shuffle_files(spark, tmp_path):
    """What a build and a ranking shuffle goes once it is written, so the disk of the largest step is needed, not of all together; counts and manifests, which are small, may stay."""
    rng = random.Random(2)
    chunks = [(f"{d}-0", d, 0, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for d in range(3000)]
    before = shuffle_bytes(spark)
    index = lexical.built(spark.createDataFrame(chunks, CHUNK).repartition(4), str(tmp_path))
    hits = retrieval.bm25(spark.createDataFrame([(1, chunks[5][3])], "query_id int, text string"), index, 3)
    assert shuffle_bytes(spark) - before < 0.5 * sum(len(c[3]) for c in chunks) and hits.first()["chunk_id"] == "5-0"


def test_postings_over_batches_that_cut_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    rows = [*some_chunks(rng, 60), ("77-9", 77, 9, "Ünï_1 ünï_1 你好, x-\U0001f600y"), ("78-9", 78, 9, None), ("79-9", 79, 9, " ")]
    with_size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        index = lexical.built(spark.createDataFrame(rows, CHUNK), str(tmp_path))
        got = index.postings.selectExpr("block", "term", "explode(arrays_zip(places, tfs, lengths)) as x").selectExpr("block", "term", "x.places as place", "x.tfs as tf", "x.lengths as length").join(index.chunks.select("block", "place", "chunk_id"), ["block", "place"])
        got = {(r["chunk_id"], r["term"]): (r["tf"], r["length"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_size)
    words = {c: re.findall(r"\w+", t.lower()) for c, _, _, t in rows if t is not None}
    assert got == {(c, w): (n, len(ws)) for c, ws in words.items() for w, n in Counter(ws).items()}
    assert index.chunks.filter("content is null").count() == 1 and index.postings.groupBy("block", "term").count().filter("count > 1").count() == 0
