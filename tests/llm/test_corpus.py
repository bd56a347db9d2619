"""Sharding, packing, near-duplicates, decontamination and the pipeline against brute force."""

import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, decontamination, licenses, linededup, packing, pipeline, quality, registry, sharding, simhash

from .conftest import ODD
from .test_scans import LOW, WORD, brute_code_length

SF = "/root/testdata/sf0.001"


def test_hypergeometric_matches_numpy_law():
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 5 * 10**9, 1000) for _ in range(3000)]
    assert abs(np.mean(big) - 375) < 2 and abs(np.std(big) - np.sqrt(1000 * 3 / 8 * 5 / 8)) < 1
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_matrix_sums():
    m = sharding.communication_matrix([5, 0, 17, 100], 7, 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 100] and sorted(m.sum(axis=0)) == [17] * 4 + [18] * 3


def test_shards(spark, odd, none):
    rows = registry.op1_sharding(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    got = sharding.shuffled_shards(odd, 3).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shuffled_shards(none).count() == 0
    again = sharding.shuffled_shards(odd.repartition(5), 3).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_shuffle_is_uniform(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    at = np.array(sorted((r["doc_id"], r["shard"]) for r in sharding.shuffled_shards(docs, 4).collect()))[:, 1]
    together = (at[:-1] == at[1:]).mean()
    assert abs(together - 0.25) < 0.03 and abs(np.corrcoef(np.arange(4000), at)[0, 1]) < 0.05


@pytest.mark.parametrize("capacity", [10, 64, 1024])
def test_packing_plan(capacity):
    rng = np.random.default_rng(capacity)
    counts = dict(Counter(rng.integers(1, capacity + 1, 3000).tolist()) | Counter({capacity: 500, 1: 700}))
    plan, n = packing.packing_plan(counts, capacity)
    assert len(plan) <= 4 * capacity
    used, seen = defaultdict(list), Counter()
    for length, rank, k, first, each, offset in plan:
        assert rank == seen[length]
        seen[length] += k
        for j in range(k):
            used[first + j // each].append((offset + j % each * length, length))
    assert seen == Counter(counts) and len(used) == n
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in spans) <= 2
    assert n <= 1.02 * max(sum(k * c for k, c in counts.items()) / capacity, sum(c for k, c in counts.items() if 2 * k > capacity)) + 2


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    vocabulary = registry.vocabulary()
    tokenizer = Tokenizer.from_file(vocabulary)
    words = packing.word_ids(vocabulary)
    assert words.cuts
    texts = [r["text"] for r in registry.table(spark, SF, "documents").limit(60).collect()] + [t or "" for _, t in ODD] + [" a", "a ", "a  b", "a \nb", "\n", "a\n\nb", "a\tb", "a b", "a\x00 b", "l'été n't 12a"]
    for t, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    got = packing.best_fit_packing(odd, vocabulary, 64).collect()
    lengths, ids = defaultdict(int), {}
    for i, t in ODD:
        ids.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    pieces, places = Counter(), defaultdict(list)
    for r in got:
        pieces[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, all_ids in ids.items():
        for x in all_ids:
            edges = [0, *range(len(x) % 64 or 64, len(x) + 1, 64)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                want[(i, k, a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes()))] += 1
    assert pieces == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(none, vocabulary).count() == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = [x for x in (text or "").translate(LOW).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in values}


def brute_near(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    of = components([f for _, f in fps])
    first = defaultdict(list)
    for i, f in fps:
        first[of[f]].append(i)
    name = {k: min((i for i in v if i is not None), default=None) for k, v in first.items()}
    return Counter((i, f"{f:016x}", name[of[f]]) for i, f in fps)


def test_near_duplicates(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in registry.table(spark, SF, "documents").collect()]
    assert Counter(map(tuple, registry.op5_simhash(spark, SF).collect())) == brute_near(rows)
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got) == brute_near(ODD)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [2, 64, 10**9])
def test_links_of_crowded_blocks(spark, crowd):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 12)
    values = set()
    for s in seeds:
        x = int(s)
        for _ in range(40):  # chains of near values
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4, crowd)
    roots = {r["node"]: r["root"] for r in simhash.smallest_reachable(edges).collect()}
    want = components(values)
    groups = defaultdict(set)
    for v, r in want.items():
        groups[r].add(v - (1 << 64) if v >> 63 else v)
    for g in groups.values():
        assert {roots.get(v, v) for v in g} == {min(g)}


def test_blocks_keep_chance_pairs_few():
    for n in (10, 10**4, 10**6, 10**9, 10**11):
        blocks = simhash.blocks_for(n, 4)
        assert 6 <= blocks <= 10 and (n < 2 ** (64 * (blocks - 4) / blocks + 1) or blocks == 10)


def test_smallest_reachable_on_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert simhash.smallest_reachable(edges).filter("root <> 0").count() == 0


def tasks_of(spark, group, work):
    """What work() returns, and how many tasks it ran."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        result = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    return result, sum(tracker.getStageInfo(s).numTasks for s in {s for j in jobs for s in j.stageIds})


def test_small_graphs_take_few_tasks_however_many_partitions_there_are(spark):
    """A round of a small graph ran a task, and left three files of a shuffle, for each of all shuffle partitions in each of its twelve steps."""
    edges = spark.range(1, 301).selectExpr("id as a", "0L as b").union(spark.range(1000, 1020).selectExpr("id as a", "id + 1 as b"))  # a hub and a chain
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found, tasks = tasks_of(spark, "small-graph", lambda: {r["node"]: r["root"] for r in simhash.smallest_reachable(edges).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1021)}
    assert tasks < 5000, tasks  # 20199 before


def test_shuffle_files_of_near_duplicates_go_at_once(spark):
    """They stayed until the driver collected its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*")}
    before, was = files(), spark.conf.get(name)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i // 2, i // 2 + 60))) for i in range(40)], "doc_id long, text string")
    groups = simhash.similar_documents(docs)
    assert spark.conf.get(name) == was
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert {r["component_id"] for r in groups.collect()} == {0}


def test_remembered_words_are_bounded_and_change_nothing(spark, odd):
    few, all_ = packing.WordIds(registry.vocabulary(), 3), packing.WordIds(registry.vocabulary())
    texts = [t or "" for _, t in ODD]
    assert [*few.of(texts)] == [*all_.of(texts)] and len(few) == 3 < len(all_)
    rows = lambda n: sorted(map(str, packing.best_fit_packing(odd, registry.vocabulary(), remembered=n).drop("sequence_id", "offset").collect()))
    assert rows(3) == rows(100_000)


def brute_hits(docs, items, n=10):
    runs = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            runs[tuple(w[i : i + n])] |= {str(item)} - {"None"}
    out = Counter()
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for size in {len(r) for r in runs}:
            for a in range(len(w) - size + 1):
                if (r := tuple(w[a : a + size])) in runs:
                    hit |= set(range(a, a + size))
                    found |= runs[r]
        out[(i, len(w), len(hit), ",".join(sorted(found)))] += 1
    return out


ITEMS = [(1, "general public license"), (2, "SHARED"), (3, None), (4, ""), (5, "again and again again and again again and again again and again"), (50, "a line that is shared by many no"), (6, "shared"), (7, "never there at all"), (None, "x")]


def hits(df):
    return Counter((r["doc_id"], r["_hits"]["n_words"], r["_hits"]["n_hit"], ",".join(r["_hits"]["items"])) for r in df.collect())


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.decontaminate(odd.withColumn("_n", decontamination.F.lit(1)), bench)
    assert hits(got) == brute_hits(ODD, ITEMS)
    assert all(set(r["_hits"]["items"]) <= set(r["_hits"]["near_items"]) for r in got.collect())
    assert decontamination.decontaminate(none, bench).count() == 0
    assert hits(decontamination.decontaminate(odd, bench.filter("false"))) == brute_hits(ODD, [])
    docs = [(i, " ".join(f"w{k}" for k in rng)) for i, rng in enumerate(np.random.default_rng(2).integers(0, 4, (60, 40)))]
    items = [(i, t) for i, (_, t) in enumerate(docs[:5])] + [(90 + i, t[:20]) for i, (_, t) in enumerate(docs[:3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for length, anchors in ((4, 2), (6, 3), (10, 1)):
        assert hits(decontamination.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), length, anchors)) == brute_hits(docs, items, length)


def test_shuffled_joins_find_the_same(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontamination, "small_or_not", lambda df: df)
    assert hits(decontamination.decontaminate(odd, items)) == brute_hits(ODD, ITEMS)


def test_words_are_cut_without_a_matcher_for_each(spark, odd):
    """Words as the pattern finds them, with any character between, before and after them; op2's plans over the texts don't extract match by match."""
    texts = ["", None, " ", "a", "-a-", "A b", "é\u00a0x", "𠀀😀 z", *(f"{chr(c)}x{chr(c)}{chr(c)}Y9{chr(c)}" for c in range(256)), *(t for _, t in ODD)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["a"], r["b"]) for r in frame.select("doc_id", common.words_of(common.F.col("text")).alias("a"), common.scan_words(common.F.col("text")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (re.findall(common.ANY_WORD, t or ""), WORD.findall((t or "").translate(LOW)))
    docs = odd.select("doc_id", "text")
    for df in (common.word_positions(docs, common.F.col("text"), "doc_id"), decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x y z q beta"), (3, "beta alpha"), (4, "alpha beta")], "doc_id long, text string")
    out = decontamination.decontaminate(docs, spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), 10, slack=2)
    assert {r["doc_id"]: (r["_hits"]["near_items"], r["_hits"]["n_hit"]) for r in out.collect()} == {1: (["1"], 0), 2: ([], 0), 3: (["1"], 0), 4: (["1"], 2)}


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Odd rows, documents of four languages and near copies of some, in a folder of their own, with columns whose names clash with internal ones."""
    plain = [(r["doc_id"] + 100, r["text"], r["lang"]) for r in registry.table(spark, SF, "documents").filter("length(text) between 300 and 1500").orderBy("doc_id").limit(60).collect()]
    copies = [(i + 1000, t.replace(t.split()[7], "changed", 1), x) for i, t, x in plain[:10]]
    items = [(1, " ".join(plain[20][1].split()[5:40])), (2, "general public license again"), (3, None)]
    rows = [(i, t, x, len(t or ""), "_h1", 3, "y", 5) for i, t, x in [(i, t, "en") for i, t in ODD] + plain + copies]
    folder = str(tmp_path_factory.mktemp("mixed"))
    names = "doc_id long, text string, lang string, n_chars long, _lang string, _kept int, _hits string, count int"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def brute_language(rows):
    names = sorted({r[2] for r in rows if r[2] and r[1]})
    learned = {x: [r[1].encode() for r in rows if r[2] == x and r[1] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)] for x in names}
    out = []
    for r in rows:
        if r[1] and any(c.isalpha() for c in r[1]):
            bits = np.array([brute_code_length(r[1].encode(), learned[x]) for x in names])
            if 1 / np.exp2((bits.min() - bits) / max(1, len(r[1].encode()) / 64)).sum() >= pipeline.LEAST_SCORE:
                out.append(r)
    return out


def brute_line_stage(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(r[0])
    last = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in held.items() if len(v) >= 3}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if last.get(key(x), r[0]) == r[0]]
        if len(kept) == len(lines):
            out.append(r)
        elif "".join(kept).strip(" \t\x0b\x0c\r"):
            out.append((r[0], "\n".join(kept), r[2], len("\n".join(kept)), *r[4:]))
    return out


def brute_near_stage(rows):
    stay = {i for i, first in brute_similar([r[:2] for r in rows]) if i == first}
    return [r for r in rows if r[0] in stay]


def brute_clean_stage(rows, items):
    bad = {(i, n): hit for (i, n, hit, _) in brute_hits([r[:2] for r in rows], items)}
    return [r for r in rows if not bad[r[0], len(WORD.findall((r[1] or "").translate(LOW)))]]


def check_packing(rows, out, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary())
    want, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    for spans in sequences.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= capacity
    assert len(sequences) <= 1.1 * sum(x[3] * k for x, k in want.items()) / capacity + 2


def test_pipeline_stages_against_brute_force(spark, mixed):
    """The whole rows of every stage, each on what brute force makes of the stage before, and those of run()."""
    folder, rows, items = mixed
    brute = {"language": brute_language, "line_dedup": brute_line_stage, "near_dedup": brute_near_stage, "decontaminate": lambda x: brute_clean_stage(x, items)}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, schema = docs.columns, docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, spark.createDataFrame(rows, schema), folder)
        before, rows = rows, brute[name](rows)
        assert got.columns == names and Counter(map(tuple, got.collect())) == Counter(rows) and rows != before, name
    check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, schema), folder).collect())
    check_packing(rows, corpus_pipeline.run(spark, folder).collect())


def test_pipeline_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_equal_rows_and_a_very_long_text(spark):
    """10,000 equal rows, and a text of 4 MB, go through every operator that scans texts."""
    many = spark.range(10_000).selectExpr("7L as doc_id", "'the same line of text in every row' as text")
    assert sharding.shuffled_shards(many, 4).groupBy("shard").count().filter("count = 2500").count() == 4
    assert linededup.drop_shared_lines(many).filter("_lines.dropped is not null").count() == 0
    assert simhash.near_duplicates(many).filter("component_id = 7").count() == 10_000
    long = spark.range(1).selectExpr("1L as doc_id", "repeat('a quiet line of words that ends here. ', 100000) as text")
    items = spark.createDataFrame([(1, "that ends here a quiet line of words that ends here")], "item_id long, text string")
    assert decontamination.decontaminate(long, items).first()["_hits"]["n_hit"] == 800_000 - 5
    assert quality.judge_quality(long).first()["_q"]["n_words"] == 800_000
    assert licenses.scan_licenses(long).first()["_licenses"]["n_words"] == 800_000


def brute_similar(rows, width=5, least=0.8):
    """doc_id, smallest doc_id of the group of each row, all pairs compared."""

    def shingles(text):
        w = [x for x in (text or "").translate(LOW).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    return Counter((i, first[g]) for (i, _), g in zip(rows, group))


def test_similar_documents(spark, odd, none):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):  # near copies: a few words changed, so most lie between 0.7 and 0.95 and beyond 4 bits of the fingerprint
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        rows.append((100 * i, " ".join(words)))
        for c in range(1, 5):
            for at in rng.choice(120, c, replace=False):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((100 * i + c, " ".join(words)))
    rows += [(9000 + i, "the same opening of every page here " * 2 + " ".join(f"y{k}" for k in rng.integers(0, 5000, 60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_similar(rows)
    assert Counter(map(tuple, simhash.similar_documents(docs).collect())) == want
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert sum(i != c for i, c in near) < sum(i != c for i, c in want) / 2
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {c for _, c in want}
    assert Counter(map(tuple, simhash.similar_documents(odd).collect())) == brute_similar(ODD)
    assert simhash.similar_documents(none).count() == 0


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    """The stage's near fingerprints are candidates of the exact check; what it leaves of them is found even if the prefix filter gives nothing, and the filter adds the rest."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(12):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        rows += [(100 * i, " ".join(words)), (100 * i + 1, " ".join([*words[:-1], "changed"]))]
        rows.append((100 * i + 2, " ".join("z" if k % 50 == 0 else w for k, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {i: simhash.fingerprint(t, 5) for i, t in rows}
    near = {i for i in fps if any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in fps)}
    assert 6 <= len(near) < 24
    whole = simhash.shingle_candidates
    monkeypatch.setattr(simhash, "shingle_candidates", lambda marked, least: whole(marked, least).filter("false"))
    assert {i for i, _ in rows} - {r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()} == near
    monkeypatch.setattr(simhash, "shingle_candidates", whole)
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()} == {c for _, c in brute_similar(rows)}


def test_sketches_never_bound_too_low():
    rng = np.random.default_rng(6)
    for n, m in ((0, 0), (0, 5), (1, 1), (3, 4), (100, 90), (1000, 1000), (5000, 4096)):
        for share in (0.0, 0.5, 1.0):
            a = np.unique(rng.integers(-(2**63), 2**63, n, dtype=np.int64))
            b = np.unique(np.concatenate([a[: int(share * min(n, m))], rng.integers(-(2**63), 2**63, m - int(share * min(n, m)), dtype=np.int64)]))
            bound = simhash.most_shared(simhash.sketch(a), simhash.sketch(b))
            assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
            assert n < 100 or share or bound < 0.75 * min(n, m)  # and low enough to tell unlike sets
    near = np.arange(300, dtype=np.int64)  # all in one prefix
    assert simhash.sketch(near) == b"" and simhash.most_shared(b"", simhash.sketch(near[:9])) > 300


def test_salted_candidates_find_the_same(spark):
    rng = np.random.default_rng(9)
    sets = [sorted(rng.choice(60, 40, replace=False).tolist()) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(f"s{x}" for x in s)) for i, s in enumerate(sets)], "i long, text string")
    marked = simhash.shingle_marks(docs, 1, 0.8, simhash.common_shingles(docs, 1)).withColumn("node", simhash.F.col("i"))
    want = {(i, j) for i in range(60) for j in range(i) if len(set(sets[i]) & set(sets[j])) * 9 >= 4 * 80}
    for salt_rows in (3, 512):
        assert want <= {(r["a"], r["b"]) for r in simhash.shingle_candidates(marked, 0.8, salt_rows).collect()}
