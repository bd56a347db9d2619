"""Chunkers: documents to rows of chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.operators.lineage import if_small, written


def fixed_windows(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """All other columns with chunk_index and content: windows of `size` characters, each size - overlap after the one before; blank ones are left out."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), F.lit(step))
    cut = F.filter(F.transform(starts, lambda s, i: F.struct(i.alias("i"), F.substring(F.col(text), s, F.lit(size)).alias("c"))), lambda x: F.rlike(x["c"], F.lit(r"\S")))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(cut).alias("_x")).select(*rest, F.col("_x.i").alias("chunk_index"), F.col("_x.c").alias("content"))


def sentence_windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """key, chunk_index, content: like fixed_windows(), but a window is pulled back by at most `overlap` characters to end after a newline, else after a CJK
    sentence mark, else after an ASCII one that white space or the window's end follows. Where each window starts depends on the one before, so a text is
    walked through in its row. Null and blank texts have no chunks."""
    ascii_end = re.compile(r"[.!?](?=\s|$)")

    def windows(t: str) -> Iterator[str]:
        start, n = 0, len(t)
        while start < n:
            end = min(start + size, n)
            if end < n and overlap:
                tail = t[end - overlap : end]
                cut = tail.rfind("\n") + 1 or max(tail.rfind(c) for c in "。！？") + 1 or max((m.end() for m in ascii_end.finditer(tail)), default=0)
                if cut:
                    end = end - overlap + cut
            if t[start:end].strip():
                yield t[start:end]
            if end >= n:
                return
            start = end - overlap if end - overlap > start else end

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text]) if t for i, c in enumerate(windows(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content"])

    return docs.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(cut, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_index int, content string")


def frequent_words(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, words: the k most frequent words of two characters or more, comma-joined; ties by first place. Counted within the row, one text at a time: a key of one row gives its k words, only one of several gives all of
    its words, whose counts are then put together."""
    kind = docs.schema[key].dataType.simpleString()
    several = docs.groupBy(F.col(key).alias("_several")).count().filter("count > 1").select("_several", F.lit(True).alias("_more"))
    spaced = docs.select(key, F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+", " ").alias("_t")).filter("_t is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word, n, place = [], [], [], []
            for r, (t, more) in enumerate(zip(batch.column("_t"), batch.column("_more").to_pylist())):
                words = [w for w in t.as_py().split(" ") if len(w) >= 2]
                best = Counter(words).most_common(None if more else k)  # words of equal counts in the order of their first places
                first = dict(zip(reversed(words), range(len(words) - 1, -1, -1))) if more else {w: i for i, (w, _) in enumerate(best)}
                row += [r] * len(best)
                word += [w for w, _ in best]
                n += [c for _, c in best]
                place += [first[w] for w, _ in best]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int32())), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(place, pa.int32())], [key, "word", "n", "i"])

    marked = spaced.join(if_small(written(several)), F.col(key).eqNullSafe(F.col("_several")), "left").select(key, "_t", F.coalesce("_more", F.lit(False)).alias("_more"))
    each = marked.mapInArrow(counted, f"`{key}` {kind}, word string, n bigint, i int").groupBy(key, "word").agg(F.sum("n").alias("n"), F.min("i").alias("i"))
    best = each.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "i"))).filter(F.col("k") <= k)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), ",").alias("words"))


def outline_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, kind, level, first_line, content: headings, code fences, tables, list items and paragraphs of Markdown, from line kinds and windows.

    Lines within fences are code; runs of table lines and of paragraph lines are one block, every list item and heading is its own.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n", -1)).alias("line", "content"))
    w = Window.partitionBy(key).orderBy("line")
    fence = F.rlike("content", F.lit(r"^\s*```"))
    kind = (
        F.when(fence | F.col("_in"), "CODE")
        .when(F.rlike("content", F.lit(r"^#{1,6}\s+\S")), "HEADING")
        .when(F.rlike("content", F.lit(r"^\s*\|.*\|\s*$")), "TABLE")
        .when(F.rlike("content", F.lit(r"^\s*(?:[-*+]|\d+[.)])\s+")), "LIST")
        .when(F.trim("content") == "", "BLANK")
        .otherwise("PARAGRAPH")
    )
    marked = lines.withColumn("_fences", F.sum(fence.cast("int")).over(w)).withColumn("_in", F.col("_fences") % 2 == 1).withColumn("kind", kind)
    alone = F.col("kind").isin("HEADING", "LIST")
    starts = alone | F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | (fence & F.col("_in"))
    grouped = marked.withColumn("_run", F.sum(starts.cast("int")).over(w)).filter("kind <> 'BLANK'").groupBy(key, "_run", "kind")
    blocks = grouped.agg(F.min("line").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("content"))
    level = F.when(F.col("kind") == "HEADING", F.char_length(F.regexp_extract("content", "^(#+)", 1))).otherwise(0)
    return blocks.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first_line")) - 1).alias("block"), "kind", level.alias("level"), "first_line", "content")


def table_batches(headers: Column, rows: Column, size: int = 20) -> Column:
    """Array of (first_row, content, embedding_text) of a table's rows in batches; cells are joined by |, embedding texts name the column of each full cell."""

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    def named(row: Column) -> Column:
        cells = F.filter(F.zip_with(headers, row, lambda h, c: F.when(F.trim(c) != "", F.concat(h, F.lit(": "), c))), lambda x: x.isNotNull())
        return F.array_join(cells, "; ")

    rule = line(F.transform(headers, lambda _: F.lit("---")))
    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("first_row"),
            F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(F.slice(rows, s, size), line), "\n")).alias("content"),
            F.concat_ws("\n", F.concat(F.lit("headers: "), F.array_join(headers, ", ")), F.array_join(F.transform(F.slice(rows, s, size), named), "\n")).alias("embedding_text"),
        ),
    )


#: Kinds of things that a sentence can refer to: name, numbered reference, positional reference.
REFERENCES = (("TABLE", r"(?:如?表|[Tt]able)\s*\d+", r"(?:如下表|下表|上表|(?:following|above) table)"), ("IMAGE", r"(?:如?图|[Ff]igure|[Ff]ig\.)\s*\d+", r"(?:如下图|下图|上图|(?:following|above) figure)"))


def cross_references(chunks: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """key, chunk_index (the target), context: sentences of other chunks that refer to a table or figure, for the nearest chunk of that kind within
    `reach`, forward first. chunks: key, chunk_index, kind, content. Neighbours are met by an equality join on the exploded index."""
    sentences = F.filter(F.split("content", r"(?<=[。！？.!?\n])", -1), lambda s: F.trim(s) != "")
    said = chunks.select(key, F.col("chunk_index").alias("_at"), F.posexplode(F.transform(sentences, lambda s: F.trim(s))).alias("_n", "sentence"))
    hits = None
    for kind, numbered, placed in REFERENCES:
        one = said.filter(F.rlike("sentence", F.lit(f"{numbered}|{placed}"))).withColumn("kind", F.lit(kind))
        hits = one if hits is None else hits.unionByName(one)
    near = hits.withColumn("chunk_index", F.explode(F.sequence(F.col("_at") - reach, F.col("_at") + reach))).filter("chunk_index <> _at")
    found = near.join(chunks.select(key, "chunk_index", "kind"), [key, "chunk_index", "kind"])
    first = Window.partitionBy(key, "_at", "_n", "kind").orderBy((F.col("chunk_index") < F.col("_at")), F.abs(F.col("chunk_index") - F.col("_at")))
    chosen = found.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return chosen.groupBy(key, "chunk_index").agg(
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_n", "sentence"))), lambda x: x["sentence"])), "; ").alias("context")
    )


def semantic_boundaries(paragraphs: DataFrame, key: str, order: str, embedding: str, text: str, target: int, threshold: float = 0.55) -> DataFrame:
    """paragraphs with chunk: a new one begins where the chunk holds `target` characters and the paragraph's cosine with the one before is below the threshold,
    or where it would pass 1.5 times the target. The running length restarts at each boundary, so a key's paragraphs are streamed in order, with chunk and length as the only state."""
    from tessera.functions.vectors import cosine

    def step(state: tuple, rows: pa.RecordBatch) -> tuple[tuple, tuple[list]]:
        chunk, held = state
        out = []
        for n, alike in zip(rows.column("_n").to_pylist(), rows.column("_s").to_pylist()):
            if chunk < 0 or held >= target and alike < threshold or held + n > 1.5 * target:
                chunk, held = chunk + 1, n
            else:
                held += 2 + n
            out.append(chunk)
        return (chunk, held), (out,)

    near = F.coalesce(cosine(F.col(embedding), F.lag(embedding).over(Window.partitionBy(key).orderBy(order))), F.lit(1.0))
    marked = paragraphs.withColumn("_s", near).withColumn("_n", F.coalesce(F.char_length(text), F.lit(0)))
    return folds.running(marked, key, [order], paragraphs.columns, {"chunk": "int"}, lambda: (-1, 0), step)


#: Levels of headings in Markdown and HTML.
LEVELS = 6


def outline_paths(blocks: DataFrame, key: str) -> DataFrame:
    """blocks (key, block, kind, level, content) with path: the headings that a block stands under. A heading of level n keeps the first n - 1 of the path before it and is added.

    So a heading stands no deeper than its level and at most one below the heading before it, and each place of a path holds the last heading of that depth: running windows over the blocks, without a list of a document's headings.
    """
    w = Window.partitionBy(key).orderBy("block")
    head = F.col("kind") == "HEADING"
    title = F.struct(F.regexp_replace("content", r"^#+\s+", "").alias("t"))
    counted = blocks.filter(F.col(key).isNotNull()).withColumn("_h", F.sum(head.cast("int")).over(w))
    least = F.min(F.when(head, F.greatest("level", F.lit(1)) - F.col("_h"))).over(w)
    placed = counted.withColumn("_d", (F.col("_h") + F.least(least, F.lit(0))).cast("int"))
    at = [F.last(F.when(head & (F.col("_d") == d), title), ignorenulls=True).over(w) for d in range(1, LEVELS + 1)]
    deeper = F.collect_list(F.when(head & (F.col("_d") > LEVELS), F.struct(F.col("_d").alias("d"), title["t"].alias("t")))).over(w)  # empty where headings are Markdown's
    found = placed.withColumns({"_at": F.array(*at), "_deeper": deeper})
    rest = F.transform(F.sequence(F.lit(LEVELS + 1), F.col("_d")), lambda d: F.element_at(F.filter("_deeper", lambda x: x["d"] == d), -1)["t"])
    upper = F.transform(F.slice("_at", F.lit(1), F.coalesce("_d", F.lit(0))), lambda x: x["t"])
    return found.withColumn("path", F.when(F.col("_d") > LEVELS, F.concat(upper, rest)).otherwise(upper)).drop("_h", "_d", "_at", "_deeper")


def run_numbers(rows: DataFrame, key: str, order: str, entry: Column, start: Column, step, together: bool = False) -> DataFrame:
    """rows with _run: a number for each, from a fold over a key's entries in order; step gives the next state (with field r, the row's run). together: the rows of a key already lie in one partition, by a window or
    a grouping; then they stay there and look their numbers up by their place in the key, and only the numbers are shuffled."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))).alias("_l"))
    begin = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))

    def one(a: Column, x: Column) -> Column:
        s = step(a["s"], x["e"])
        return F.struct(s.alias("s"), F.array_append(a["out"], s["r"]).alias("out"))

    runs = F.aggregate("_l", begin, one, lambda a: a["out"])
    if together:
        upto, equal = F.count("*").over(Window.partitionBy(key).orderBy(order)).cast("int"), F.count("*").over(Window.partitionBy(key, order)).cast("int")
        numbers = listed.select(key, runs.alias("_runs")).hint("rebalance", key)  # in a stage of its own, so that no task sorts both sides; a repartition by the same key would be optimized out
        met = rows.withColumns({"_upto": upto, "_equal": equal}).join(numbers, key).filter(F.col(order).isNotNull())
        return met.select(*rows.columns, F.explode(F.slice("_runs", F.col("_upto") - F.col("_equal") + 1, F.col("_equal"))).alias("_run"))
    zipped = F.arrays_zip(F.transform("_l", lambda x: x["o"]).alias("o"), runs.alias("r"))
    return rows.join(listed.select(key, F.explode(zipped).alias("_x")).select(key, F.col("_x.o").alias(order), F.col("_x.r").alias("_run")), [key, order])


def section_chunks(blocks: DataFrame, key: str, target: int = 800) -> DataFrame:
    """key, chunk_index, kind, path, content, embedding_text from blocks with paths: texts and lists of one section are put together up to `target` characters; tables, code and
    images are chunks of their own; headings only name the section, which embedding texts begin with."""
    own = F.col("kind").isin("TABLE", "CODE", "IMAGE")
    entry = F.struct(own.alias("own"), (F.col("kind") == "HEADING").alias("head"), F.char_length("content").alias("n"))
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("n"), F.lit(False).alias("fresh"))

    def step(s: Column, e: Column) -> Column:
        new = e["own"] | e["head"] | s["fresh"] | ((s["n"] > 0) & (s["n"] + e["n"] > target))
        return F.struct(F.when(new, s["r"] + 1).otherwise(s["r"]).alias("r"), F.when(e["own"] | e["head"], 0).when(new, e["n"]).otherwise(s["n"] + e["n"]).alias("n"), (e["own"] | e["head"]).alias("fresh"))

    marked = run_numbers(blocks, key, "block", entry, start, step, together=True).filter("kind <> 'HEADING'")
    parts = marked.groupBy(key, "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.first("path").alias("path"),
        F.max(F.when(own, F.col("kind")).otherwise(F.lit(""))).alias("kind"),
    )
    section = F.when(F.size("path") > 0, F.concat(F.lit("章节: "), F.array_join("path", " > "), F.lit("\n"))).otherwise("")
    number = F.row_number().over(Window.partitionBy(key).orderBy("_run")) - 1
    return parts.select(key, number.alias("chunk_index"), F.when(F.col("kind") == "", "PARAGRAPH").otherwise(F.col("kind")).alias("kind"), "path", "content", F.concat(section, F.col("content")).alias("embedding_text"))


def packed_chunks(chunks: DataFrame, key: str, least: int = 600) -> DataFrame:
    """key, chunk_index, kind, content: neighbouring paragraphs, lists and images below `least` characters put together until they reach it; others are barriers, and larger ones end a pack."""
    soft = F.col("kind").isin("PARAGRAPH", "LIST", "IMAGE")
    entry = F.struct(soft.alias("soft"), F.char_length("content").alias("n"))
    start = F.struct(F.lit(0).alias("r"), F.lit(-1).alias("n"))  # n: characters in the open pack, -1 if none is open

    def step(s: Column, e: Column) -> Column:
        small = e["soft"] & (e["n"] < least)
        joins = small & (s["n"] >= 0)
        total = F.when(joins, s["n"] + e["n"]).otherwise(e["n"])
        return F.struct(F.when(joins, s["r"]).otherwise(s["r"] + 1).alias("r"), F.when(small & (total < least), total).otherwise(-1).alias("n"))

    marked = run_numbers(chunks, key, "chunk_index", entry, start, step)
    packs = marked.groupBy(key, "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
        F.when(F.count_distinct("kind") == 1, F.max("kind")).otherwise("PARAGRAPH").alias("kind"),
    )
    return packs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_run")) - 1).alias("chunk_index"), "kind", "content")
