"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEY, bind, indices, row_key, scan_words, set_apart, small_or_not, stored, tabled, word_positions, words_of


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """_item (a number), _words, _ids: the distinct word sequences of the items (item_id, text) that have words, with the ids of the items that have them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("_id"), scan_words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    return words.groupBy("_words").agg(F.array_sort(F.collect_set("_id")).alias("_ids")).select(F.xxhash64("_words").alias("_item"), "_words", "_ids")


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """_item, _window (its first word's place), _offset, _word, _term: the words of every window; an item of fewer words than `length` is one window."""
    windows = items.select("_item", "_words", F.explode(indices(F.greatest(F.size("_words") - (length - 1), F.lit(1)))).alias("_window"))
    return windows.select("_item", "_window", F.posexplode(F.slice("_words", F.col("_window") + 1, F.lit(length))).alias("_at", "_word")).select(
        "_item", "_window", (F.col("_window") + F.col("_at")).alias("_offset"), "_word", F.xxhash64("_word").alias("_term")
    )


def anchor_sets(windows: DataFrame, frequency: DataFrame, anchors: int) -> DataFrame:
    """_set, _item, _needed, _term, _offset, _bit: for every window the places in its item of its `anchors` rarest distinct words, windows that share all of them taken
    together. Windows with a word that no document has are left out."""
    counted = windows.join(small_or_not(frequency), "_term", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    each = Window.partitionBy("_item", "_window", "_term").orderBy("_offset")
    distinct = counted.withColumn("_k", F.row_number().over(each)).filter("_k = 1")
    rare = Window.partitionBy("_item", "_window").orderBy("_n", "_word")
    ranked = distinct.withColumn("_rank", F.row_number().over(rare)).withColumn("_least", F.min("_n").over(Window.partitionBy("_item", "_window")))
    chosen = ranked.filter(f"_rank <= {anchors} and _least > 0").groupBy("_item", "_window").agg(F.array_sort(F.collect_list(F.struct("_rank", "_offset", "_term"))).alias("_a"))
    sets = chosen.select("_item", "_a").distinct().withColumn("_set", F.xxhash64("_item", "_a"))
    needed = F.expr("shiftleft(1, size(_a)) - 1")
    return sets.select("_set", "_item", needed.alias("_needed"), F.explode("_a").alias("_x")).select(
        "_set", "_item", "_needed", F.col("_x._term").alias("_term"), F.col("_x._offset").alias("_offset"), F.expr("shiftleft(1, _x._rank - 1)").alias("_bit")
    )


def token_postings(docs: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """The positional index of docs for the given terms: row key, _term, _pos, stored in the shared folder."""
    return tabled(word_positions(docs, text, *KEY).join(small_or_not(terms), "_term"))


def meetings(postings: DataFrame, sets: DataFrame, anchors: int, slack: int) -> DataFrame:
    """Row key, _item, _exact (diagonals: places where the item's first word would stand), _near: where the lists of a set's anchors meet, each moved back by its offset:
    at one diagonal, or (_near) within `slack` of the first one's. Only sets all of whose anchors a document has are gathered."""
    moved = postings.join(small_or_not(sets), "_term").select(*KEY, "_set", "_item", "_needed", "_bit", (F.col("_pos") - F.col("_offset")).alias("_diagonal"))
    present = tabled(moved.groupBy(*KEY, "_set").agg(F.bit_or("_bit").alias("_has"), F.first("_needed").alias("_all")).filter("_has = _all").select(*KEY, "_set"))
    lists = [F.collect_set(F.when(F.col("_bit") == 1 << r, F.col("_diagonal"))).alias(f"_l{r}") for r in range(anchors)]
    met = moved.join(small_or_not(present), [*KEY, "_set"], "left_semi").groupBy(*KEY, "_set", "_item", "_needed").agg(*lists)
    exact = near = F.col("_l0")
    for r in range(1, anchors):
        there = F.shiftright("_needed", r) > 0
        around = F.flatten(F.transform(f"_l{r}", lambda d: F.sequence(d - slack, d + slack)))
        exact = F.when(there, F.array_intersect(exact, F.col(f"_l{r}"))).otherwise(exact)
        near = F.when(there, F.array_intersect(near, around)).otherwise(near)
    return met.select(*KEY, "_item", exact.alias("_exact"), (F.size(near) > 0).alias("_near")).filter("_near")


def covered(spans: Column) -> Column:
    """How many positions lie in at least one of the spans (start, stop)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["stop"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )


def equal_runs(words: Column, item: Column, diagonal: Column, length: int) -> Column:
    """Spans (start, stop) of words of a text that equal the item's on a diagonal, `length` words or more (or the whole item, if it is shorter)."""
    least = F.least(F.size(item), F.lit(length))
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(words) - diagonal)  # places in the item that fall into the text
    differ = F.filter(F.sequence(first, last), lambda j: (j == last) | ~F.get(words, diagonal + j).eqNullSafe(F.get(item, j)))
    ends = lambda d: F.transform(d, lambda j, k: F.struct((diagonal + F.when(k == 0, first).otherwise(F.get(d, k - 1) + 1)).alias("start"), (diagonal + j).alias("stop")))
    found = bind(differ, lambda d: F.filter(ends(d), lambda s: s["stop"] - s["start"] >= least))
    return F.when(first < last, found).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))


def contaminated(docs: DataFrame, text: Column, benchmark: DataFrame, length: int = 10, anchors: int = 2, slack: int = 3) -> DataFrame:
    """Row key, n_hit, items, near_items of the rows of docs (with their row key) that have an exact or a near match; see decontaminate()."""
    items = stored(benchmark_items(benchmark))
    windows = stored(item_windows(items, length))
    vocabulary = stored(windows.select("_term").distinct())
    frequency = stored(word_positions(docs, text).join(small_or_not(vocabulary), "_term").groupBy("_term").agg(F.count("*").alias("_n")))
    sets = stored(anchor_sets(windows, frequency, anchors))
    met = tabled(meetings(token_postings(docs, text, stored(sets.select("_term").distinct())), sets, anchors, slack))
    places = met.groupBy(*KEY, "_item").agg(F.array_distinct(F.flatten(F.collect_list("_exact"))).alias("_diagonals"))
    per_doc = tabled(
        places.join(small_or_not(items), "_item").groupBy(*KEY).agg(F.collect_list(F.struct("_words", "_ids", "_diagonals")).alias("_places"))
    )
    asked = docs.select(*KEY, text.alias("_text")).join(small_or_not(per_doc), KEY).select(*KEY, "_places", scan_words(F.col("_text")).alias("_w"))
    none = F.array().cast("array<string>")
    runs = F.transform("_places", lambda p: F.struct(p["_ids"].alias("ids"), F.flatten(F.transform(p["_diagonals"], lambda d: equal_runs(F.col("_w"), p["_words"], d, length))).alias("spans")))
    checked = asked.select(*KEY, "_places", runs.alias("_runs")).select(
        *KEY,
        covered(F.flatten(F.transform("_runs", lambda r: r["spans"]))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(none), F.transform(F.filter("_runs", lambda r: F.size(r["spans"]) > 0), lambda r: r["ids"]))))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(none), F.transform("_places", lambda p: p["_ids"]))))).alias("near_items"),
    )
    return tabled(checked.dropDuplicates(KEY))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, anchors: int = 2, slack: int = 3, into: str = "_hits") -> DataFrame:
    """All columns of docs (doc_id, text) with a struct `into`: n_words, n_hit (words inside a window's exact occurrence), items (ids with such windows, as sorted
    strings) and near_items (proximity matches: ids of items with a window whose `anchors` rarest words all stand within `slack` words of where they would beside the
    rarest one; exact matches are among them).

    Words are runs of digits, ASCII letters (lowered) and characters beyond ASCII. A window is `length` consecutive words of an item
    (item_id, text); an item of fewer words, but not none, is one window.

    Postings of the windows' rarest words are stored; the lists of a window, moved back by the words' offsets, must meet at one diagonal; there the text is compared
    word by word. Only texts with such places are looked at again, and only row keys and numbers are joined to the rest.

    Null and empty texts and items have no words; a null item_id is not listed; equal rows get equal results; an empty benchmark hits nothing; an empty table
    gives no rows; an input column of the name `into` is replaced, and no other name matters.
    """
    rows, doc_id, text, back = set_apart(docs, into)
    found = contaminated(rows.select("*", *row_key(doc_id, text)), text, benchmark, length, anchors, slack)
    left = rows.select("*", *row_key(doc_id, text), F.size(words_of(text)).cast("long").alias("_n"))
    joined = left.join(small_or_not(found), KEY, "left")
    none = F.array().cast("array<string>")
    return back(
        joined,
        F.struct(F.col("_n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")),
    )
