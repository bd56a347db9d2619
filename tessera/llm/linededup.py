"""Removal of lines that many documents share, as per-document keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEY, SPACE, bind, indices, lower_ascii, row_key, set_apart, shuffle_partitions, small_or_not, tabled

WORD_BITS = 64


def text_lines(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return bind(F.btrim(line, F.lit(SPACE)), lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(lower_ascii(x)))


def keep_bitmaps(docs: DataFrame, doc_id: Column, text: Column, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Which lines of docs (with their row key) go: those whose key (trimmed, A-Z lowered) has min_chars code points and is found in min_docs documents, except
    in the largest doc_id that holds it.

    Returns a row only for texts that lose lines: the row key and _dropped, a sparse bitmap: array of (word, mask), the bits of
    whose masks are the lines 64 * word + bit that go. Words without such bits are left out.

    Keys are hashed (128 bits) once and stored. They are range-partitioned with the documents of a hash in `slices` (as many as shuffle partitions), so that even a
    line that all documents share lies in many tasks; each task sorts by hash, document (largest first) and position and streams through, giving the first
    occurrence and the number of documents of each slice. Slices are combined by hash; occurrences then look up their line's keeper, in a broadcast of the
    shared lines where those are counted small, else in a join that Spark may split where a line is frequent.

    Rows with equal doc_id count as one document; a null doc_id is one, smaller than any number.
    """
    slices = shuffle_partitions(docs.sparkSession)
    lines = docs.select(*KEY, doc_id.alias("_id"), F.posexplode(text_lines(text)).alias("_pos", "_line"))
    keyed = lines.select(*KEY, "_id", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.char_length("_key") >= min_chars)
    hashed = keyed.select(*KEY, "_id", "_pos", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit("line"), "_key").alias("_b"))
    found = tabled(hashed.withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(slices)).cast("int")))
    spread = found.select("_a", "_b", "_slice", "_id", "_pos").repartitionByRange(slices, "_a", "_b", "_slice")
    stream = Window.partitionBy("_a", "_b", "_slice").orderBy(F.desc_nulls_last("_id"), "_pos")
    firsts = spread.withColumn("_first", F.lag("_pos").over(stream).isNull() | ~F.lag("_id").over(stream).eqNullSafe(F.col("_id"))).filter("_first")
    per_slice = firsts.groupBy("_a", "_b", "_slice").agg(F.count("*").alias("_docs"), F.max("_id").alias("_last"))
    shared = tabled(
        per_slice.groupBy("_a", "_b").agg(F.sum("_docs").alias("_docs"), F.max("_last").alias("_last")).filter(F.col("_docs") >= min_docs).select("_a", "_b", "_last")
    )
    gone = found.join(small_or_not(shared), ["_a", "_b"]).filter(~F.col("_id").eqNullSafe(F.col("_last")))
    words = gone.groupBy(*KEY, F.floor(F.col("_pos") / WORD_BITS).cast("int").alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, _pos % {WORD_BITS}))").alias("_mask"))
    return tabled(words.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_mask").alias("mask"))).alias("_dropped")))


def dropped_positions(bitmap: Column) -> Column:
    """The positions whose bits are set; none for null."""
    bits = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))
    per_word = F.transform(
        F.coalesce(bitmap, F.array().cast("array<struct<word:int,mask:bigint>>")),
        lambda w: F.transform(
            F.filter(bits, lambda b: F.call_function("getbit", w["mask"], b) == 1),
            lambda b: w["word"] * WORD_BITS + b,
        ),
    )
    return F.flatten(per_word)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, into: str = "_lines") -> DataFrame:
    """All columns of docs (doc_id, text) with a struct `into`: dropped (the bitmap of keep_bitmaps, null: all stay), n_lines and kept, the lines that stay joined by \\n.

    A null text stays null in `text`; it has one empty line, and its kept is the empty string. A text all of whose lines go has an empty kept. Equal rows get equal
    results; an empty table gives no rows; an input column of the name `into` is replaced, and no other name matters.
    """
    rows, doc_id, text, back = set_apart(docs, into)
    keyed = rows.select("*", *row_key(doc_id, text))
    joined = keyed.join(small_or_not(keep_bitmaps(keyed, doc_id, text, min_chars, min_docs)), KEY, "left")
    whole = F.coalesce(text, F.lit(""))
    left = bind(text_lines(text), lambda lines: F.array_join(F.transform(F.array_except(indices(F.size(lines)), dropped_positions(F.col("_dropped"))), lambda i: lines[i]), "\n"))
    return back(
        joined,
        F.struct(
            F.col("_dropped").alias("dropped"),
            (F.regexp_count(whole, F.lit("\n")) + 1).alias("n_lines"),
            F.when(F.col("_dropped").isNull(), whole).otherwise(left).alias("kept"),
        ),
    )
