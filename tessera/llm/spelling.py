"""Spelling variants: words at one edit from each other, found by segments that they must share, and the common form that each leads to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_or_not, stored, tabled, tidied


def shortened(word: bytes, prefix: int, one_in: int) -> bytes | None:
    """The (Latin-1) word without one letter, if the checksum of `<doc_id>:<word>` (prefix: that of `<doc_id>:`) is divisible by one_in; else None."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode("utf-8"), prefix)
    if h % one_in:
        return None
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """word, n (long): letter runs [A-Za-z\\u00C0-\\u00FF]+ of all texts of docs (doc_id, text), with A-Z lowered, that have at least so many letters and occurrences.

    One of about `one_in` pairs of document and run (that of a checksum) loses a letter: typing errors that every run makes alike. A task sums up each batch of texts before the shuffle.
    Null texts have no words; a null doc_id counts as an empty one; equal rows count each.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length).findall  # shorter runs can't give a word that is long enough

        def counted(batch: pd.DataFrame) -> pd.DataFrame:
            total: Counter[bytes] = Counter()
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = runs(text.encode("latin-1", "replace").lower())
                total.update(words)
                prefix = crc32(f"{doc or ''}:".encode())
                for word in set(words):
                    if (short := shortened(word, prefix, one_in)) is not None:
                        times = words.count(word)
                        total[word] -= times
                        if len(short) >= least_length:
                            total[short] += times
            found = [(w.decode("latin-1"), n) for w, n in total.items() if n]
            return pd.DataFrame(found, columns=["word", "n"]).astype({"word": "object", "n": "int64"})

        yield from tidied(counted(batch) for batch in batches)

    texts = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _left(length: Column) -> Column:
    """Letters of the left one of two even segments."""
    return F.floor(length / 2).cast("int")


def _next(rows: DataFrame) -> DataFrame:
    """Two rows for each of rows (key, m, rest, passed, others): the rest's left segment joins the key and what follows it is the new rest, or its right segment does and what goes
    before it is. m is the length of the indexed rest, so a probing rest of one letter more shifts its right segment by one. `passed` collects the left segments that a right one went over."""
    left, length = _left(F.col("m")), F.char_length("rest")
    right = F.col("m") - left
    sides = F.array(
        F.struct(F.concat("key", F.lit("<"), F.substring("rest", F.lit(1), left)).alias("key"), right.alias("m"), F.substring("rest", left + 1, length).alias("rest"), F.col("passed")),
        F.struct(
            F.concat("key", F.lit(">"), F.substring("rest", length - right + 1, right)).alias("key"), left.alias("m"), F.substring("rest", F.lit(1), length - right).alias("rest"),
            F.array_append("passed", F.substring("rest", F.lit(1), left)).alias("passed"),
        ),
    )
    kept = [c for c in rows.columns if c not in ("key", "m", "rest", "passed")]
    return rows.select(*kept, F.explode(sides).alias("_s")).select(*kept, "_s.*")


def near_words(words: DataFrame, crowd: int = 32) -> DataFrame:
    """a, n_a, b, n_b: every pair of words (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, once, the shorter one (of equal length: the smaller one) first.

    Every word is indexed by its two even segments; words of equal length or of one letter more probe with the segments at their places, the right one shifted by the difference of the
    lengths: of two segments, one edit leaves one whole. A pair that shares both is met at the left one only, so candidates are distinct without a shuffle; each is verified.

    A list of more than `crowd` words of one segment isn't met pair by pair: the same step goes on in the rest of its words, which must be one edit apart in turn, until lists are
    short or the rest is one letter. So candidates are at most `crowd` times the probing rows, whatever the words share, but for lists that differ in one letter.
    """
    none = F.array().cast("array<string>")
    size = F.char_length("word")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), size.cast("string").alias("key"), size.alias("m"), F.col("word").alias("rest"), none.alias("passed"))
    lengths = F.explode(F.array(size, size - 1)).alias("m")
    probes = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), lengths, F.col("word").alias("rest"), none.alias("passed")).withColumn("key", F.col("m").cast("string"))
    pairs = None
    while True:
        index, probes = _next(index), _next(probes)
        sizes = index.groupBy("key").agg(F.count("*").alias("_n"), F.first("m").alias("_m"))
        lists = tabled(sizes.withColumn("_long", (F.col("_n") > crowd) & (F.col("_m") >= 2)))
        longer = lists.filter("_long").select("key")
        again = longer.limit(1).count() > 0
        if again:
            longer = small_or_not(longer)
            quiet = index.join(longer, "key", "left_anti"), probes.join(longer, "key", "left_anti")
            index, probes = tabled(index.join(longer, "key", "left_semi")), tabled(probes.join(longer, "key", "left_semi"))
        else:
            quiet = index, probes
        both = quiet[0].withColumnRenamed("passed", "_pa").drop("m", "rest").join(quiet[1].withColumnRenamed("passed", "_pb").drop("m", "rest"), "key")
        once = ~F.exists(F.zip_with("_pa", "_pb", lambda x, y: x == y), lambda x: x) & ((F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b")))
        found = both.filter(once).filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if not again:
            return pairs


def roots(forms: DataFrame, most_rounds: int = 30) -> DataFrame:
    """word, root: where following form from each of forms (word, form; no circles) ends. Each round doubles the steps, and is written."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        now = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return now
    raise RuntimeError(f"roots not found in {most_rounds} rounds")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, one_in: int = 199, crowd: int = 32) -> DataFrame:
    """word, n, form, n_near, form_n, root for the words of docs (doc_id, text) that word_counts() finds.

    form: the most frequent of the words one edit away (ties: the first in code-point order), if it occurs at least `times` times as often, else null, as is form_n, its number; n_near: how many
    such words there are; root: where following the forms ends (the word itself, if it has none). A form is always more frequent, so forms make no circles.

    Nulls and repeats as in word_counts(); a table without words gives no rows; other columns are ignored. A form's many variants are summed up before the shuffle.
    """
    words = tabled(word_counts(docs, least_length, least_count, one_in))
    pairs = tabled(near_words(words, crowd))
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("n_of")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("n_of")))
    best = F.min(F.struct((-F.col("n_of")).alias("n"), F.col("near")))
    found = pairs.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_b"), F.first("n").alias("_n"))
    often = -F.col("_b.n") >= times * F.col("_n")
    known = stored(found.select("word", "n_near", F.when(often, F.col("_b.near")).alias("form"), F.when(often, -F.col("_b.n")).alias("form_n")))
    ended = roots(known.filter("form is not null"))
    out = words.join(known, "word", "left").join(ended, "word", "left")
    return out.select("word", "n", "form", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n", F.coalesce("root", "word").alias("root"))
