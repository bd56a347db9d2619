"""Chunkers that follow a text's blocks: headings, fenced code, tables, lists, images and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunking import packed_chunks, run_numbers

# How lines are told, as patterns on a line without trailing white space.
FENCE = r"^```"
HEADING = r"^#{1,6}\s+"
IMAGE = r'^!\[[^\]]*\]\([^)]+\)(?:\s*"[^"]*")?\s*$'
LINK = r"^\[[^\]]+\]\([^)]+\)\s*$"
TABLE_RULE = r"^\s*\|?\s*[-:]{3,}\s*(\|\s*[-:]{3,}\s*)+\|?\s*$"
TABLE_ROW = r"^\s*\|.+\|\s*$"
LIST_ITEM = r"^(?:[-*+] |\d+[.)、]\s)"
# Names of strategies, with the ones they had before.
STRATEGIES = {"fixed_window": "fixed_window", "fixed_size": "fixed_window", "semantic": "semantic", "structure_aware": "semantic", "block_aware": "block_aware"}


@dataclass(frozen=True)
class Sizes:
    """Characters of a chunk wanted, at most and at least, and of overlap; lines of code, list items and table rows in a chunk; headings in a path."""

    target: int = 1400
    most: int = 1800
    least: int = 600
    overlap: int = 0
    code_lines: int = 80
    list_items: int = 30
    table_rows: int = 20
    path: int = 4


def strategy(name: str, size: int | None = None, overlap: int = 0) -> tuple[str, Sizes]:
    """The strategy that a name stands for, and its sizes. Unknown and empty names are refused."""
    found = STRATEGIES.get((name or "").strip().lower().replace("-", "_"))
    if found is None:
        raise ValueError(f"unknown chunk strategy: {name!r}")
    if found == "block_aware":
        return found, Sizes(target=size or 800, least=300, overlap=overlap)
    return found, Sizes(target=size or (512 if found == "fixed_window" else 1400), overlap=overlap)


_WORD_LINK = re.compile(r"https?://")
_IN_LINK = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%")


def repaired(text: Column) -> Column:
    """A text without carriage returns, its links put together where one line break cut them, and without line breaks between two CJK characters.

    A link goes on over a break after one of / ? & = # % - _ :, after a full stop before a letter, or before one of / ? & = #; not into a numbered line. Only texts
    with a broken link leave the JVM.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "")

    def joined(link: str, rest: str) -> bool:
        if re.match(r"[ \t]*\d+[.）)]", rest):
            return False
        return (link[-1] == "." and rest[:1].isalpha()) or link[-1] in "/?&=#%-_:" or rest[:1] in tuple("/?&=#")

    def one(t: str) -> str:
        out, at = [], 0
        while m := _WORD_LINK.search(t, at):
            out.append(t[at : m.start()])
            link, i = m[0], m.end()
            while i < len(t):
                if t[i] in _IN_LINK:
                    link, i = link + t[i], i + 1
                    continue
                gap = re.compile(r"\s+").match(t, i)
                if not gap or gap[0].count("\n") != 1 or gap.end() == len(t) or not joined(link, t[gap.end() :]):
                    break
                i = gap.end()
            out.append(link)
            at = i
        return "".join([*out, t[at:]])

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(one)

    broken = F.rlike(plain, F.lit(r"https?://\S*[ \t]*\n"))
    links = F.when(broken, F.pandas_udf(of, "string")(F.when(broken, plain).otherwise(""))).otherwise(plain)
    cjk = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
    return F.regexp_replace(links, rf"(?<={cjk})\n(?={cjk})", "")


def typed_blocks(docs: DataFrame, key: str, text: str, kinds: tuple[str, ...] = ("TABLE", "LIST")) -> DataFrame:
    """key, block, kind, start, content of a text's blocks in order; start: characters before it. HEADING and IMAGE (a line with one image or link) are lines of their own, CODE is what fences
    enclose, TABLE and LIST (if asked for, else they are paragraphs) go on over blank lines, a list over one. Contents keep their line ends.

    Lines are told by patterns, and put together by windows over a text's lines.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n", -1)).alias("line", "_c"))
    w = Window.partitionBy(key).orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.rtrim("_c")
    lines = lines.withColumn("_fence", F.rlike(bare, F.lit(FENCE))).withColumn("_in", F.sum(F.col("_fence").cast("int")).over(w) % 2 == 1)
    kind = F.when(F.col("_fence") | F.col("_in"), "CODE").when(bare == "", "BLANK").when(F.rlike(bare, F.lit(HEADING)), "HEADING").when(F.rlike(bare, F.lit(f"{IMAGE}|{LINK}")), "IMAGE")
    if "TABLE" in kinds:
        kind = kind.when(F.rlike("_c", F.lit(f"{TABLE_ROW}|{TABLE_RULE}")), "TABLE")
    if "LIST" in kinds:
        kind = kind.when(F.rlike(bare, F.lit(LIST_ITEM)), "LIST")
    lines = lines.withColumn("kind", kind.otherwise("PARAGRAPH"))
    solid = F.last(F.when(F.col("kind") != "BLANK", F.struct("kind", "line")), ignorenulls=True).over(before)
    lines = lines.withColumn("_p", solid).withColumn("_gap", F.col("line") - F.col("_p.line") - 1)
    apart = (
        F.col("_p").isNull()
        | F.when(F.col("kind") == "CODE", F.col("_fence") & F.col("_in")).otherwise(F.col("_p.kind") != F.col("kind"))
        | F.col("kind").isin("HEADING", "IMAGE")
        | ((F.col("kind") == "PARAGRAPH") & (F.col("_gap") > 0))
        | ((F.col("kind") == "LIST") & (F.col("_gap") > 1))
    )
    starts = (F.col("kind") != "BLANK") & apart
    size = F.char_length("_c") + 1
    lines = lines.withColumn("_run", F.sum(starts.cast("int")).over(w)).withColumn("_start", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_final", F.lead("line").over(w).isNull())
    own = (F.col("kind") != "BLANK") | (F.col("_p.kind") == "TABLE") | ((F.col("_p.kind") == "LIST") & (F.col("_gap") == 0))
    whole = F.when(F.col("_final"), F.col("_c")).otherwise(F.concat("_c", F.lit("\n")))
    parts = lines.filter(own & (F.col("_run") > 0)).groupBy(key, "_run").agg(
        F.min_by("kind", "line").alias("kind"), F.min("_start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", whole.alias("c")))), lambda x: x["c"]), "").alias("content")
    )
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_run")) - 1).alias("block"), "kind", "start", "content")


def structure_chunks(docs: DataFrame, key: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """key, chunk_index, content: blocks put together up to sizes.most characters; a chunk below sizes.least takes one block more, whatever its length. A last chunk below both sizes.least and
    half the target goes to the one before, if both have at most twice sizes.most. With overlap, a chunk begins with the last characters of the one before.

    Blocks are typed_blocks() of headings, code and images; blank lines after a block belong to it, except at the end. What a chunk can take depends on what it
    has, so a text's block lengths (not the texts) are folded in the JVM.
    """
    w = Window.partitionBy(key).orderBy("block")
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    blocks = typed_blocks(docs, key, text, ()).withColumn("_own", F.col("start") + F.char_length("content"))
    blocks = blocks.withColumn("_stop", F.coalesce(F.lead("start").over(w), F.col("_own"))).select(key, "block", "start", "_stop")
    begin = F.struct(F.lit(0).alias("r"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("full"))

    def step(s: Column, e: Column) -> Column:
        grown = e["stop"] - s["at"]
        joins = ~s["full"] & ((grown <= sizes.most) | (s["n"] < sizes.least))
        return F.struct(
            F.when(joins, s["r"]).otherwise(s["r"] + 1).alias("r"), F.when(joins, s["at"]).otherwise(e["start"]).alias("at"), F.when(joins, grown).otherwise(e["stop"] - e["start"]).alias("n"), (joins & (grown > sizes.most)).alias("full")
        )

    entry = F.struct(F.col("start").cast("long").alias("start"), F.col("_stop").cast("long").alias("stop"))
    ranges = run_numbers(blocks, key, "block", entry, begin, step).groupBy(key, "_run").agg(F.min("start").alias("_a"), F.max("_stop").alias("_b"))
    order = Window.partitionBy(key).orderBy("_run")
    last = F.lead("_run").over(order).isNull()
    short = last & (F.col("_b") - F.col("_a") < min(sizes.least, sizes.target // 2)) & (F.col("_b") - F.lag("_a").over(order) <= 2 * sizes.most)
    merged = ranges.withColumn("_g", F.when(F.coalesce(short, F.lit(False)), F.lag("_run").over(order)).otherwise(F.col("_run"))).groupBy(key, "_g").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    placed = merged.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("_g")) - 1).withColumn("_pa", F.lag("_a").over(Window.partitionBy(key).orderBy("_g"))).withColumn("_pb", F.lag("_b").over(Window.partitionBy(key).orderBy("_g")))
    cut = placed.join(docs.select(key, plain.alias("_t")), key)
    tail = F.when(F.col("_pb").isNotNull(), F.substring("_t", F.greatest(F.col("_pa"), F.col("_pb") - sizes.overlap) + 1, F.least(F.lit(sizes.overlap), F.col("_pb") - F.col("_pa")))).otherwise("")
    body = F.substring("_t", F.col("_a") + 1, F.col("_b") - F.col("_a"))
    return cut.select(key, "chunk_index", (F.concat(F.when(F.rlike(tail, F.lit(r"\S")), tail).otherwise(""), body) if sizes.overlap else body).alias("content"))


def cut_paragraph(text: Column, target: int, most: int) -> Column:
    """A paragraph in parts: whole up to `most` characters, else cut after the first sentence end from `target` characters on and before `most`, else after a newline there, else at the target.
    Where a part begins depends on the one before; only long paragraphs leave the JVM."""
    marks = re.compile(r"[。！？.!?]")

    def ends(t: str, first: int, stop: int) -> Iterator[int]:
        """Places from `first` on, before `stop`, that follow a mark and begin a sentence: white space, a capital, or a character of a script without capitals."""
        for m in marks.finditer(t, first - 1, stop - 1):
            if (after := t[m.end()]).isspace() or after.isupper() or ord(after) > 0x2E80:
                yield m.end()

    def parts(t: str) -> Iterator[str]:
        at = 0
        while at < len(t):
            goal, limit = min(at + target, len(t)), min(at + most, len(t))
            newline = t.find("\n", goal, limit)
            end = next(ends(t, goal, limit), newline + 1 if newline >= 0 else goal)
            if t[at:end].strip():
                yield t[at:end].strip()
            at = end

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: list(parts(t)))

    long = F.char_length(text) > most
    return F.when(long, F.pandas_udf(of, "array<string>")(F.when(long, text).otherwise(""))).otherwise(F.array(text))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often body names it or an inner function runs over it."""
    return F.transform(F.array(value), body)[0]


def _batches(lines: Column, most: int, of: Callable[[Column], Column]) -> Column:
    """of() each batch of at most so many lines (one empty batch for none). The lines are computed once, not for each batch."""
    starts = lambda x: F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(most))
    return _bound(lines, lambda x: F.transform(starts(x), lambda s: of(F.slice(x, s, most))))


def _table_parts(content: Column, rows: int) -> Column:
    """A table's data rows in batches under its header, with embedding texts that name the columns of the full cells; empty cells are left out, so those after them move up.

    Every value that the batches share is bound before them, so that a table takes time in proportion to its lines."""
    solid = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rule = lambda x: F.rlike(x, F.lit(TABLE_RULE))
    cells = lambda row: F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    none = F.array().cast("array<string>")

    def said(names: Column, row: Column) -> Column:
        return F.array_join(F.transform(cells(row), lambda c, i: F.concat(F.coalesce(F.get(names, i), F.concat(F.lit("col"), (i + 1).cast("string"))), F.lit(": "), c)), "; ")

    def made(x: Column) -> Column:
        first = F.concat(x["head"], F.array(x["rule"]))
        heading = F.when(F.size(x["names"]) > 0, F.array(F.concat(F.lit("headers: "), F.array_join(x["names"], ", ")))).otherwise(none)
        both = lambda t: _batches(
            x["data"], rows, lambda b: F.struct(F.array_join(F.concat(t["first"], b), "\n").alias("content"), F.array_join(F.concat(t["heading"], F.transform(b, lambda r: said(x["names"], r))), "\n").alias("embedding_text"))
        )
        return _bound(F.struct(first.alias("first"), heading.alias("heading")), both)

    def of(x: Column) -> Column:
        head = F.slice(x["lines"], F.lit(1), F.greatest(x["at"] - 1, F.lit(0)))
        data = F.filter(F.slice(x["lines"], x["at"] + 1, F.size(x["lines"])), lambda r: ~rule(r))
        names = F.when(F.size(head) > 0, cells(head[0])).otherwise(none)
        whole = F.array(F.struct(content.alias("content"), F.lit("").alias("embedding_text")))
        known = F.struct(head.alias("head"), data.alias("data"), names.alias("names"), F.get(x["lines"], x["at"] - 1).alias("rule"))
        return F.when(x["at"] > 0, _bound(known, lambda y: F.when(F.size(y["data"]) > 0, made(y)).otherwise(whole))).otherwise(whole)

    numbered = _bound(solid, lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, rule), True).cast("int").alias("at")))
    return _bound(numbered, of)


def block_chunks(docs: DataFrame, key: str, text: str, sizes: Sizes = Sizes(target=800, least=300)) -> DataFrame:
    """key, chunk_index, kind, content: every block by its kind: tables in batches of rows, code of lines, lists of items, paragraphs cut at sentences, images whole; each begins with the
    last sizes.path headings before it, whatever their level, as [a > b]. Small neighbours are then put together by packed_chunks()."""
    parts = block_parts(docs, key, text, sizes)
    return packed_chunks(parts.select(key, "chunk_index", "kind", "content"), key, sizes.least)


def block_parts(docs: DataFrame, key: str, text: str, sizes: Sizes = Sizes(target=800, least=300)) -> DataFrame:
    """key, chunk_index, kind, path, content, embedding_text: the chunks of block_chunks() before small ones are put together."""
    blocks = typed_blocks(docs, key, text)
    body, none = F.col("content"), F.lit("")
    plain = lambda parts: F.transform(parts, lambda p: F.struct(p.alias("content"), none.alias("embedding_text")))
    lines = F.split(body, "\n", -1)
    items = F.filter(lines, lambda x: F.rlike(F.rtrim(x), F.lit(LIST_ITEM)))
    joined = lambda rows, most: _batches(rows, most, lambda b: F.array_join(b, "\n"))
    alt = F.regexp_extract(body, r"^!\[([^\]]*)\]", 1)
    cut = (
        F.when(F.col("kind") == "TABLE", _table_parts(body, sizes.table_rows))
        .when(F.col("kind") == "CODE", plain(F.when(F.size(lines) <= sizes.code_lines, F.array(body)).otherwise(joined(lines, sizes.code_lines))))
        .when(F.col("kind") == "LIST", plain(F.when(F.size(items) <= sizes.list_items, F.array(body)).otherwise(joined(items, sizes.list_items))))
        .when(F.col("kind") == "IMAGE", F.array(F.struct(body.alias("content"), F.when(alt != "", F.concat(F.lit("[图片: "), alt, F.lit("]"))).otherwise("").alias("embedding_text"))))
        .otherwise(plain(F.col("_cut")))
    )
    head = F.regexp_replace(F.btrim(body, F.lit(" \t\n\r\x0b\x0c")), r"^#+\s*", "")
    heads = blocks.filter("kind = 'HEADING'").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", head.alias("h")))), lambda x: x["h"]).alias("_heads"))
    seen = F.sum((F.col("kind") == "HEADING").cast("int")).over(Window.partitionBy(key).orderBy("block")).cast("int")
    placed = blocks.withColumn("_h", seen).filter("kind <> 'HEADING'").join(heads, key, "left")
    first = F.greatest(F.col("_h") - (sizes.path - 1), F.lit(1))
    path = F.when(F.col("_h") > 0, F.slice("_heads", first, F.col("_h") - first + 1)).otherwise(F.array().cast("array<string>"))
    placed = placed.withColumn("_cut", cut_paragraph(F.when(F.col("kind") == "PARAGRAPH", body).otherwise(""), sizes.target, sizes.most))
    each = placed.select(key, "block", "kind", path.alias("path"), F.posexplode(cut).alias("_i", "_x"))
    titled = lambda c: F.when((F.size("path") > 0) & (c != ""), F.concat(F.lit("["), F.array_join("path", " > "), F.lit("]\n"), c)).otherwise(c)
    number = F.row_number().over(Window.partitionBy(key).orderBy("block", "_i")) - 1
    return each.select(key, number.alias("chunk_index"), "kind", "path", titled(F.col("_x.content")).alias("content"), titled(F.col("_x.embedding_text")).alias("embedding_text"))
