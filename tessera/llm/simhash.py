"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEY, fitted, row_key, short_shuffles, small_batches, small_or_not, stored, tabled, tidied

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's word shingles, repeats included, in parts that bound the memory for long texts.

    Words lie between ASCII white space, with A-Z lowered; a text of fewer than `width` words is one shingle, one of none has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    count = max(1, len(words) - width + 1)
    starts, ends = [0, *(stops[: count - 1] + 1).tolist()], [*stops[width - 1 : -1].tolist(), len(joined)]
    for at in range(0, count, 65536):
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])), dtype="<u8")


def majority(parts: Iterable[np.ndarray]) -> int:
    """The unsigned SimHash of hashes: a bit is set if it is set in over half of them; 0 if there are none."""
    total, count = np.zeros(BITS, dtype=np.int64), 0
    for hashes in parts:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """The unsigned SimHash of a text: a bit is set if it is set in over half the XXH64 hashes of the word shingles, repeats included. A text without words gives 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", F.pandas_udf(of, "long")("text").alias("fp"))


def blocks_for(n: int, distance: int) -> int:
    """How many blocks keep the pairs that meet by chance fewer than the fingerprints: more fingerprints need longer keys. Any number finds the same links."""
    blocks = distance + 1
    while blocks < 2 * distance + 2 and n >> int(BITS * (blocks - distance) / blocks):
        blocks += 1
    return max(blocks, distance + 2)


def block_keys(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fp, _table, _key: fingerprints cut into blocks; two that differ in at most `distance` bits agree in at least blocks - distance of them, and so in
    the key of one table, each made of so many blocks."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(c)) for c in combinations(masks, blocks - distance)]
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in tables])).alias("_table", "_key"))


def halfway_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among fingerprints of crowded blocks, without their pairs: every fingerprint names all values within half the distance; those that
    name one value are within the whole distance of each other and are linked to its smallest. Two fingerprints within the distance share such a value.

    At most 1 + 64 + 64 * 63 / 2 fingerprints can name one value, so no group is larger."""
    flips = [0, *(sum(1 << b for b in c) for k in range(1, distance // 2 + 1) for c in combinations(range(BITS), k))]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in flips])
    named = crowded.select("fp", F.explode(masks).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("_value"))
    groups = named.groupBy("_value").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("_all")).filter(F.size("_all") > 1)
    return groups.select(F.explode("_all").alias("a"), "b").filter("a <> b").distinct()


def links(fps: DataFrame, distance: int = 4, crowd: int = 64) -> DataFrame:
    """Pairs (a, b), a > b, of distinct fingerprints (fp) whose connected components are those of all pairs within the distance.

    Blocks of at most `crowd` fingerprints are joined pair by pair; fingerprints of larger ones are linked by halfway_links(), exactly too, so the work
    grows with the fingerprints and not with the square of a block. `distance` must be even for that.
    """
    keys = stored(block_keys(fps, distance, blocks_for(fps.count(), distance)))
    sizes = keys.groupBy("_table", "_key").count()
    crowded = keys.join(sizes.filter(F.col("count") > crowd), ["_table", "_key"], "left_semi").select("fp").distinct()
    quiet = keys.join(sizes.filter((F.col("count") > 1) & (F.col("count") <= crowd)), ["_table", "_key"], "left_semi")
    left, right = quiet.withColumnRenamed("fp", "a"), quiet.withColumnRenamed("fp", "b")
    near = left.join(right, ["_table", "_key"]).filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select("a", "b").distinct().unionByName(halfway_links(crowded, distance)).distinct()


def smallest_reachable(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b).

    Alternating stars: every node's larger neighbours move to its smallest neighbour, then its smaller ones do, until nothing changes; each round is
    written to the shared checkpoint folder. Components of n nodes need about log n rounds. The neighbours of a hub are met in joins that Spark can split: the
    smallest ones leave the partitioning by node of their aggregate first, else the join would take it over. A round makes no more than a few times the edges that there
    were at first, so their count sets the partitions of each step.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    fit = lambda df, rows=seen[0]: fitted(df, rows)
    now = fit(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = fit(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")))
        large = fit(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = fit(large.unionByName(low.filter("a <> low").select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        low = fit(large.groupBy("a").agg(F.min("b").alias("low")))
        small = fit(large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        now = stored(fit(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct()))
        if (found := mark(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 64) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text): the smallest doc_id reachable over links of at most `distance` differing bits.

    Equal fingerprints are one node, so copies are never paired. Null and empty texts have fingerprint 0, linked like any other. Null doc_ids get a
    component but never name one unless it has no other; rows with equal doc_id are separate documents of one name; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, width))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = smallest_reachable(links(nodes.select("fp"), distance, crowd))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    names = placed.groupBy("_root").agg(F.min("_first").alias("component_id")).hint("rebalance")  # so that Spark can split a large component in the join
    named = placed.join(names, "_root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's word shingles, as signed longs; words and short texts as in shingle_hashes()."""
    return distinct_hashes(shingle_hashes(text, width))


def distinct_hashes(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Sorted, as signed longs."""
    found = [np.unique(x) for x in parts]
    return np.unique(np.concatenate(found).view(np.int64)) if found else np.empty(0, dtype=np.int64)


def common_shingles(marked: DataFrame, width: int, most_texts: int = 4_000, most: int = 100_000) -> np.ndarray:
    """Shingles that repeat in a sample of the texts, sorted. They only set the order of the prefixes, which is free, so a sample changes the work and not the result."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(pd.Series([shingle_set(t, width) for t in texts]) for texts in batches)

    scale = 1 << 30
    few = marked.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < most_texts * scale / max(1, marked.select("text").count()))
    counts = few.distinct().select(F.explode(F.pandas_udf(of, "array<long>")("text")).alias("s")).groupBy("s").count().filter("count > 2")
    return np.array(sorted(r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(most).collect()), dtype=np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """How many of a set's hashes begin with each prefix of so many bits that there are about one or two to a prefix: a byte for each. Empty if a number doesn't fit."""
    bits = max(0, len(shingles).bit_length() - 1)
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), dtype=np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> int:
    """A bound of what two sets share: no more of each prefix than the set with fewer of it has."""
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (a, b))
    if not len(x) or not len(y):
        return 1 << 62
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())


def shingle_marks(docs: DataFrame, width: int, least: float, common: np.ndarray) -> DataFrame:
    """docs (text) with node (a hash of the text's shingle set), fp (the text's fingerprint as a signed long), n (the set's size), sketch (see sketch()) and prefix: the first n - ceil(least * n) + 1 shingles of the set in one order for all texts,
    common ones last."""
    from xxhash import xxh64_intdigest

    def prefix(x: np.ndarray) -> np.ndarray:
        often = np.zeros(len(x), dtype=bool)
        if len(common) and len(x):
            at = np.minimum(np.searchsorted(common, x), len(common) - 1)
            often = common[at] == x
        first = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1 if len(x) else 0
        return np.concatenate([x[~often], x[often]])[:first]

    def marked(texts: pd.Series) -> pd.DataFrame:
        found = []
        for parts in ([*shingle_hashes(t, width)] for t in texts):
            x = distinct_hashes(parts)
            found.append((xxh64_intdigest(x.tobytes(), SEED), majority(parts), len(x), prefix(x), sketch(x)))
        nodes, fps = (np.array([f[k] for f in found], dtype=np.uint64).view(np.int64) for k in (0, 1))
        return pd.DataFrame({"node": nodes, "fp": fps, "n": np.array([f[2] for f in found], dtype=np.int32), "prefix": [f[3] for f in found], "sketch": [f[4] for f in found]})

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(marked(texts) for texts in batches)

    return docs.withColumn("_m", F.pandas_udf(of, "node long, fp long, n int, prefix array<long>, sketch binary")("text")).select(*docs.columns, "_m.*")


def shingle_candidates(marked: DataFrame, least: float, salt_rows: int = 512) -> DataFrame:
    """Pairs (a, b), a > b, of nodes among which are all whose shingle sets have a Jaccard similarity of `least` or more; marked: node, n, prefix as in shingle_marks().

    Prefix filter: in any one order of all shingles, two such sets share one of the first n - ceil(least * n) + 1 of either. Sizes and places in
    the prefix then leave out pairs that can't reach it. Long lists of one shingle are met in salted parts of `salt_rows` rows by all.
    """
    posts = marked.select("node", "n", F.posexplode("prefix").alias("at", "s"))
    repeated = stored(posts.groupBy("s").count().filter("count > 1").select("s"))  # most shingles occur once: they go no further; copies of a text count too
    several = tabled(posts.join(small_or_not(repeated, 2_000_000), "s", "left_semi").distinct())
    lists = several.groupBy("s").count().filter("count > 1")
    met = tabled(several.join(lists, "s").withColumn("_k", F.ceil(F.col("count") / salt_rows).cast("int")))
    left = met.select("s", F.col("node").alias("a"), F.col("n").alias("_na"), F.col("at").alias("_i"), F.pmod(F.xxhash64("node"), F.col("_k")).cast("int").alias("_p"))
    right = met.select("s", F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("at").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_p"))
    shared = F.lit(least / (1 + least)) * (F.col("_na") + F.col("_nb")) - 1e-6  # what the sets must share
    able = F.least(F.col("_na") - F.col("_i"), F.col("_nb") - F.col("_j"))
    long_enough = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * least - 1e-6
    # a pair meets at its first shared shingle, where nothing before it is shared, so `able` bounds what they share
    return left.join(right, ["s", "_p"]).filter((F.col("a") > F.col("b")) & long_enough & (able >= shared)).select("a", "b").distinct()


def fingerprint_candidates(marked: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b), a > b, of nodes whose fingerprints are equal or linked by links(), one node standing for all of one fingerprint; marked: node, fp."""
    owned = stored(marked.select("fp", "node").distinct())
    first = stored(owned.groupBy("fp").agg(F.min("node").alias("_node")))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("_node").alias(f"_{c}"))
    equal = owned.join(first.hint("rebalance"), "fp").select(F.col("node").alias("a"), F.col("_node").alias("b"))
    near = links(first.select("fp"), distance).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.unionByName(near).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """doc_id, component_id for every row of docs (doc_id, text): the smallest doc_id reachable over links of texts whose sets of `width`-word shingles have a
    Jaccard similarity of `least` or more. All such pairs are found; each candidate is verified over the whole sets of both texts.

    First come SimHash fingerprints of the shingles: those within `distance` bits, found by blocks as in near_duplicates(), are candidates, and what the exact check leaves of them makes
    groups. Similar texts may differ in more bits, so a prefix filter then finds all other pairs that may be similar and lie in two groups; each text is compared with the
    one of the nearest fingerprint first, and only pairs that this hasn't joined with all the others.

    Every text goes through Python once, for its node, fingerprint and prefix, which are stored; then one text of each node that has a candidate. Both in small batches, which bounds a worker's memory.

    Texts of equal sets are one node. Null and empty texts are one group; a text of fewer words is one shingle. Null doc_ids as in near_duplicates(); an empty table
    gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession), short_shuffles(docs.sparkSession):
        return _similar_documents(docs, width, least, distance)


def _similar_documents(docs: DataFrame, width: int, least: float, distance: int) -> DataFrame:
    def reach(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def jaccard(a: str, b: str) -> bool:
            x, y = shingle_set(a, width), shingle_set(b, width)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= (len(x) + len(y) - both) * least - 1e-6

        yield from tidied(pd.Series([jaccard(a, b) for a, b in zip(left, right)], dtype=bool) for left, right in batches)

    @F.pandas_udf("boolean")
    def able(a: pd.Series, n_a: pd.Series, b: pd.Series, n_b: pd.Series) -> pd.Series:
        shared = np.array([most_shared(x, y) for x, y in zip(a, b)], dtype=np.float64)
        return pd.Series(shared >= (n_a + n_b) * (least / (1 + least)) - 1e-6)

    keyed = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    marked = tabled(shingle_marks(keyed, width, least, common_shingles(docs, width)).drop("text"))

    def ends(pairs: DataFrame) -> DataFrame:
        return stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def texts_of(asked: DataFrame) -> DataFrame:
        """A text of each node: texts of one node have one set."""
        one = stored(marked.join(small_or_not(asked), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*KEY)).alias("_k")).select("node", "_k.*"))
        return tabled(keyed.select(*KEY, "text").join(small_or_not(one), KEY).dropDuplicates(["node"]).select("node", "text"))

    def alike(asked: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs whose whole sets are alike enough. Texts move, not sets: compressed they are less than half as large."""
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("_a")).join(small_or_not(asked, 2_000_000), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_b")), "b")
        return stored(both.filter(F.pandas_udf(reach, "boolean")("_a", "_b")).select("a", "b"))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs that the links found haven't put into one group."""
        known = stored(smallest_reachable(found))
        root = lambda c: small_or_not(known.select(F.col("node").alias(c), F.col("root").alias(f"_r{c}")), 2_000_000)
        joined = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return stored(joined.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select(*pairs.columns))

    # SimHash: near fingerprints, then the exact check.
    near = stored(fingerprint_candidates(marked, distance))
    grouped = alike(near, texts_of(ends(near)))
    # What may be similar besides, whatever the fingerprints.
    candidates = apart(shingle_candidates(marked, least), grouped)
    nodes = marked.join(small_or_not(ends(candidates)), "node", "left_semi").dropDuplicates(["node"])
    nodes = tabled(nodes.select("node", "fp", "n", "sketch"))
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"_f{c}"), F.col("n").alias(f"_n{c}"), F.col("sketch").alias(f"_s{c}"))
    met = candidates.hint("rebalance").join(side("a"), "a").join(side("b"), "b")  # sketches settle most pairs, so that texts move for few
    pairs = stored(met.filter(able("_sa", "_na", "_sb", "_nb")).select("a", "b", F.bit_count(F.col("_fa").bitwiseXOR(F.col("_fb"))).alias("_bits")))
    texts = texts_of(ends(pairs))
    first = stored(pairs.groupBy("a").agg(F.min(F.struct("_bits", "b")).alias("_x")).select("a", "_x.b"))
    found = grouped.unionByName(alike(first, texts))
    rest = apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), found)
    roots = smallest_reachable(found.unionByName(alike(rest, texts)))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("_first"))
    placed = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "_first", F.coalesce("root", "node").alias("_root"))
    names = placed.groupBy("_root").agg(F.min("_first").alias("component_id")).hint("rebalance")
    return marked.select("doc_id", "node").join(placed.join(names, "_root").select("node", "component_id"), "node").select("doc_id", "component_id")
