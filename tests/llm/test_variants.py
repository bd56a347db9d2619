"""Fill-in-the-middle, spelling variants and nearest neighbours against brute force."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import crosspolytope, fim, registry, spelling

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def cut(doc, text):
    """Rows of the contract by plain slicing: n, form, prefix, middle, output."""
    t, n = text or "", len(text or "")
    h = [int(sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(spark, odd, none):
    more = [(100 + i, t, "en", "", 0) for i, t in enumerate(["a<P>b", "<<S", "x<S>", "<M>", "<P", "ab\r\ncd", "é́😀" * 5, "a", "\x00<", "long line\n" * 400_000] + ["<" * k + "P>"[: k % 3] for k in range(1, 60)])]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    out = fim.fill_in_middle(docs, into="_pos")
    assert out.columns == ["doc_id", "text", "lang", "count", "_pos"]
    rows = out.withColumn("again", fim.restored(out["_pos.form"], out["_pos.output"])).collect()
    got = Counter((r["doc_id"], r["text"], *[r["_pos"][c] for c in ("n", "form", "prefix", "middle", "output")]) for r in rows)
    assert got == Counter((i, t, *cut(i, t)) for i, t in [*ODD, *[m[:2] for m in more]])
    assert all(r["again"] == (r["text"] or "") for r in rows)
    assert {r["_pos"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(none).count() == 0


def test_units_of_other_kinds(spark):
    docs = spark.createDataFrame([(i, "  One two,\tthree four  five. ") for i in range(300)], "doc_id long, text string")
    found = fim.fill_in_middle(docs, unit=r"\w+", percent=100).collect()
    ends = [0, *(m.end() for m in re.finditer(r"\w+", found[0]["text"]))]
    assert {r["_fim"]["n"] for r in found} == {5}
    assert {r["_fim"]["prefix"] for r in found} == set(ends) and {r["_fim"]["prefix"] + r["_fim"]["middle"] for r in found} <= set(ends)


def test_matches_are_counted_and_left_lazily():
    passed = []
    matches = (passed.append(m.end()) or m for m in re.finditer(".", "abcdefgh"))
    assert fim.end_after(matches, 3, 0) == 3 and fim.end_after(matches, 0, 3) == 3 and fim.end_after(matches, 2, 3) == 5
    assert passed == [1, 2, 3, 4, 5]
    assert fim.number_of(iter([])) == 0 and fim.number_of(re.finditer(".", "abc")) == 3


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def counted(docs, least_length, least_count):
    words = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def variants(words, times=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, form.get(w), len(near[w]), words[form[w]] if w in form else None, root(w)) for w, n in words.items()}


def test_spelling_variants(spark, none):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = variants(counted(docs, 6, 5))
    got = registry.op12_spelling_variants(spark, SF).select("word", "n", "form", "n_near", "form_n", "root").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(f is not None for _, _, f, *_ in want) > 10
    assert spelling.spelling_variants(none).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_lists_split_to_any_depth_find_the_same(spark, crowd):
    rng = np.random.default_rng(5)
    stem = "the same beginning of all words and".replace(" ", "")
    words = {stem[: rng.integers(3, 30)] + "".join(rng.choice(list("abéx"), rng.integers(0, 5))) + stem[: rng.integers(0, 9)] for _ in range(700)}
    words = {w: 1 + i for i, w in enumerate(sorted(w for w in words if len(w) >= 2))}
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), crowd).collect()
    pairs = {(r["a"], r["n_a"], r["b"], r["n_b"]) for r in found}
    assert len(pairs) == len(found)
    assert pairs == {(a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b)}


def test_word_counts_of_odd_rows(spark, odd):
    rows = [(None, "Straße ÀÉŸabcdefg×÷ÿabc deFGhi_jklmno"), (None, "Straße"), (7, None), (8, "İstanbul ISTANBUL istanbul")] * 5
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == counted([*ODD, *rows], 6, 5) and got["straße"] == 10 and got["abcdefg×÷ÿabc"] == 5


def nearest(asked, rows, k):
    """query_id: [(score, vec_id)] by all pairs, sums from the first number to the last."""
    out = {}
    for q, x in asked:
        scored = []
        for i, v in rows:
            if i != q and len(v) == len(x):
                s = 0.0
                for a, b in zip(x, v):
                    s += a * b
                scored.append((-s, i))
        out[q] = [(-s, i) for s, i in sorted(set(scored))[:k]]
    return out


def listed(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_neighbours_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = nearest([r for r in rows if r[0] % 20 == 0], rows, 20)
    assert listed(registry.op13_nearest_neighbours(spark, SF).collect()) == want  # so few that every bucket is looked into


def test_recall_of_tables_and_probes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20_000, 48))
    v *= rng.uniform(0.5, 1.5, (len(v), 1)) / np.linalg.norm(v, axis=1, keepdims=True)  # of unequal lengths
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 200 = 0").withColumnRenamed("vec_id", "query_id")
    got = listed(crosspolytope.nearest_neighbours(asked, vectors).collect())
    share = []
    for q, found in got.items():
        scores = v @ v[q]
        scores[q] = -np.inf
        share.append(len({i for _, i in found} & set(np.argsort(-scores)[:20].tolist())) / 20)
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[0], x[1])) and all(abs(s - scores[i]) < 1e-12 for s, i in found)
    assert len(got) == 100 and np.mean(share) >= 0.9


@pytest.mark.parametrize("cell_rows", [5, 20_000])
@pytest.mark.parametrize("bucket_rows", [4, 256])
def test_odd_vectors(spark, monkeypatch, cell_rows, bucket_rows):
    """Copies, ties, lengths, nulls and zeros; split buckets and the exact second search find all the same."""
    monkeypatch.setattr(crosspolytope, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(8)
    one = [1.0, 2.0, -1.0]
    rows = [(i, one) for i in range(60, 100)] + [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(30)]
    rows += [(200, [0.5, 0.5]), (201, [0.5, 0.25]), (202, [3.0])] + [(150, one), (150, one), (151, [0.0, 1.0, 0.0]), (151, [1.0, 0.0, 0.0])]
    bad = [(300, None), (301, []), (302, [0.0, -0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [float("nan"), 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0]), (None, one)]
    schema = "vec_id long, embedding array<double>, key string, size int"
    vectors = spark.createDataFrame([(*r, "", 0) for r in rows + bad], schema)
    rows = [(i, v) for i, v in rows if any(v)]
    asked = vectors.filter("vec_id is null or vec_id % 3 = 0 or vec_id >= 150").withColumnRenamed("vec_id", "query_id")
    found = crosspolytope.nearest_neighbours(asked, vectors, k=20, tables=2, probes=2, bucket_rows=bucket_rows).collect()
    want = nearest([r for r in rows if r[0] % 3 == 0 and r[0] != 151 or r[0] in (150, 200, 201, 202)], rows, 20)
    got = listed([r for r in found if r["query_id"] != 151])
    if bucket_rows == 256:
        assert got == {q: x for q, x in want.items() if x}
    for q, x in got.items():
        assert len(x) == len(want[q]) and x == sorted(x, key=lambda y: (-y[0], y[1]))
    assert sum(r["query_id"] == 151 for r in found) == 40 and 202 not in got and got[200] == [(0.375, 201)]
    assert crosspolytope.nearest_neighbours(asked.filter("false"), vectors).count() == 0 == crosspolytope.nearest_neighbours(asked, vectors.filter("false")).count()
