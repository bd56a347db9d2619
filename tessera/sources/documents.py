"""Readers of documents: pages, delimited tables, evaluation sets, uploads; and the guard of user SQL."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "pre", "table", "img")
SKIPPED_TAGS = ("script", "style", "nav", "footer")
#: Tags without an end tag.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Blocks(HTMLParser):
    """Collects headings, paragraphs, list items, code, tables and images of one page, in the order in which they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED_TAGS:
            self.skipped += 1
        if self.skipped:
            return
        inside = {t for t, b in self.open if t in ("table", "pre")}
        block = None
        if tag in BLOCK_TAGS and not (inside and tag not in ("table", "pre")):
            block = {"tag": tag, "parts": [], "rows": [], "alt": dict(attrs).get("alt") or dict(attrs).get("src") or "image"}
            self.blocks.append(block)
        if tag == "tr" and (t := self._table()):
            t["rows"].append([])
        if tag in ("td", "th") and (t := self._table()) and t["rows"]:
            t["rows"][-1].append([])
        if tag not in VOID_TAGS:
            self.open.append((tag, block))

    def _table(self) -> dict | None:
        return next((b for t, b in reversed(self.open) if t == "table" and b), None)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.skipped = max(0, self.skipped - 1)
            return
        if not self.skipped and any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.skipped or not (text := " ".join(data.split())):
            return
        for _, block in self.open:
            if block and block["tag"] != "table":
                block["parts"].append(text)
        if (t := self._table()) and t["rows"] and t["rows"][-1]:
            t["rows"][-1][-1].append(text)


def page_blocks(html: str) -> list[tuple[str, int, str, list[str]]]:
    """kind, level, content and outline of the blocks of a page, in order."""
    parser, outline, out = _Blocks(), [], []
    parser.feed(html)
    parser.close()
    for b in parser.blocks:
        tag, value = b["tag"], " ".join(b["parts"])
        if tag[0] == "h":
            level = int(tag[1])
            outline = [*outline[: level - 1], value]
            out.append(("HEADING", level, value, outline))
        elif tag == "table":
            if b["rows"]:
                out.append(("TABLE", 0, "\n".join(" | ".join(" ".join(c) for c in row) for row in b["rows"]), outline))
        elif tag == "img":
            out.append(("IMAGE", 0, b["alt"], outline))
        elif value:
            out.append(({"li": "LIST", "pre": "CODE"}.get(tag, "PARAGRAPH"), 0, f"- {value}" if tag == "li" else value, outline))
    return out


def parse_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, block, kind, level, content, outline of the pages' blocks. Scripts, styles, navigation and footers are left out; null pages have no blocks."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *b) for k, h in zip(batch[key], batch[html]) if h for i, b in enumerate(page_blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "block", "kind", "level", "content", "outline"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).filter(F.col(html).isNotNull()).mapInPandas(parse, f"{key} {kind}, block int, kind string, level int, content string, outline array<string>")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """source_file, headers, row_number (the header is 0), cells of delimited files with a header line. Quoted cells may hold commas, doubled quotes and line breaks; a byte order mark is left out. White
    space in cells is collapsed, empty records are left out, short rows are padded and long ones cut. A file is one task's work."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(batch.column(c).to_pylist() for c in ("source_file", "text"))):
                found, headers = [], None
                for cells in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")):
                    cells = [" ".join(c.split()) for c in cells]
                    if not any(cells):
                        continue
                    headers = cells if headers is None else headers
                    found.append((cells + [""] * len(headers))[: len(headers)])
                rows = found[1:]
                yield pa.RecordBatch.from_pydict({"source_file": [file] * len(rows), "headers": [headers] * len(rows), "row_number": range(1, len(rows) + 1), "cells": rows}, pa.schema(_RECORDS))

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    return whole.mapInArrow(records, "source_file string, headers array<string>, row_number int, cells array<string>")


_RECORDS = [("source_file", pa.string()), ("headers", pa.list_(pa.string())), ("row_number", pa.int32()), ("cells", pa.list_(pa.string()))]
CASE_SCHEMA = "id string, question string, expected_chunk_ids array<string>, expected_doc_ids array<string>, expected_chunk_hashes array<string>, relevance_grades map<string,double>, category string, difficulty string, answerable boolean, active boolean, expected_answer string, knowledge_base_ids array<string>"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases from JSON lines, and what is wrong with them (id, problem).

    Id lists lose repetitions but keep their order; expected chunks without a grade get 1.0; active defaults to true. Problems: malformed lines, empty or repeated
    ids, missing questions, categories or answerable.
    """
    raw = spark.read.schema(CASE_SCHEMA + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    lists = {c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("expected_chunk_ids", "expected_doc_ids", "knowledge_base_ids")}
    cases = raw.withColumns(lists).withColumn("active", F.coalesce("active", F.lit(True)))
    ones = F.map_from_entries(F.transform("expected_chunk_ids", lambda i: F.struct(i, F.lit(1.0))))
    given = F.coalesce("relevance_grades", F.create_map().cast("map<string,double>"))
    missing = F.map_filter(ones, lambda k, _: ~F.map_contains_key(given, k))
    cases = cases.withColumn("relevance_grades", F.map_concat(given, missing))
    n = cases.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"))
    found = F.array_compact(
        F.array(
            F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed")),
            F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.lit("empty id")),
            F.when(F.col("_n") > 1, F.lit("repeated id")),
            F.when(F.coalesce(F.trim("question"), F.lit("")) == "", F.lit("missing question")),
            F.when(F.col("category").isNull(), F.lit("missing category")),
            F.when(F.col("answerable").isNull(), F.lit("missing answerable")),
        )
    )
    problems = cases.join(n, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", F.explode(found).alias("problem"))
    return cases.drop("_corrupt_record"), problems.distinct()


# The first bytes (hexadecimal) of files of each extension; the empty string stands for text without a signature.
SIGNATURES = {"pdf": ("25504446",), "docx": ("504b0304",), "xlsx": ("504b0304",), "pptx": ("504b0304",), "png": ("89504e47",), "jpg": ("ffd8ff",), "jpeg": ("ffd8ff",), "gif": ("47494638",), "md": ("",), "txt": ("",), "html": ("",), "csv": ("",), "json": ("",)}


def upload_problem(path: Column, content: Column, most_bytes: int) -> Column:
    """Why a file is refused, or null: unsupported extension, empty, too large, or content that isn't what the extension says (text with NUL bytes among it)."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    start = F.lower(F.hex(F.substring(content, 1, 8)))
    wrong = F.lit(False)
    for e, starts in SIGNATURES.items():
        fits = F.lit(False)
        for s in starts:
            fits = fits | F.startswith(start, F.lit(s))
        wrong = F.when(extension == e, ~fits if starts != ("",) else F.contains(F.substring(content, 1, 1024), F.unhex(F.lit("00")))).otherwise(wrong)
    size = F.octet_length(content)
    return F.when(~extension.isin(*SIGNATURES), "unsupported").when(size == 0, "empty").when(size > most_bytes, "too large").when(wrong, "content mismatch")


def import_folder(spark: SparkSession, path: str, known: DataFrame, most_bytes: int = 50_000_000) -> DataFrame:
    """path, hash, state of each file under a folder: refused (upload_problem), duplicate of a known hash or of an earlier path, or accepted.
    Spark's reader leaves out files without bytes."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    marked = files.select("path", F.sha2("content", 256).alias("hash"), upload_problem(F.col("path"), F.col("content"), most_bytes).alias("_p"))
    seen = marked.join(known.select("hash").distinct().withColumn("_k", F.lit(True)), "hash", "left")
    turn = F.row_number().over(Window.partitionBy("hash", F.col("_p").isNull()).orderBy("path"))
    state = F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_k") | (turn > 1), "duplicate").otherwise("accepted")
    return seen.select("path", "hash", state.alias("state"))


class UnsafeSQL(ValueError):
    """A statement that isn't a single bounded query of allowed tables."""


_FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|set|use|cache|refresh|load|copy|add|reset)\b", re.I)


def guarded_sql(spark: SparkSession, statement: str, allowed: set[str], tenant_id: str, most_rows: int) -> DataFrame:
    """The result of a user's query: one SELECT or WITH over the allowed tables (plain names; each has a tenant_id) that names tenant_id = :tenant_id, cut to most_rows.

    Whatever the statement's own conditions say, it sees the tenant's rows only: every allowed table is a common table expression of that name before its own ones, with the rows of the tenant. Relations are
    told from Spark's parsed plan. A common table expression may not be named like an allowed table, nor like any other one that is there, as its body could then mean that table.
    """
    text = statement.strip()
    if not re.match(r"(?is)^(select|with)\b", text) or ";" in text or "--" in text or "/*" in text or _FORBIDDEN.search(re.sub(r"'[^']*'", "''", text)):
        raise UnsafeSQL("only one plain SELECT is allowed")
    if re.match(r"(?is)^with\s+recursive\b", text):
        raise UnsafeSQL("recursion isn't allowed")
    if not re.search(r"(?i)\btenant_id\s*=\s*:tenant_id\b", text):
        raise UnsafeSQL("the query must be bound to the tenant")
    names = {a.lower() for a in allowed}
    plan = spark.sql(f"EXPLAIN EXTENDED {text}", args={"tenant_id": tenant_id}).first()[0].split("== Analyzed Logical Plan ==")[0]
    named = {".".join(y.strip() for y in x.strip("[]").split(",")).lower() for x in re.findall(r"UnresolvedRelation (\[[^\]]*\])", plan)}
    own = {x.strip().lower() for y in re.findall(r"CTE \[([^\]]*)\]", plan) for x in y.split(",")}
    if extra := named - own - names:
        raise UnsafeSQL(f"tables not allowed: {sorted(extra)}")
    if taken := {x for x in own if x in names or spark.catalog.tableExists(x)}:
        raise UnsafeSQL(f"names of tables can't be given to parts of the query: {sorted(taken)}")
    bound = ", ".join(f"`{a}` AS (SELECT * FROM `{a}` WHERE tenant_id = :tenant_id)" for a in sorted(names))
    rest = re.sub(r"(?is)^with\b", ",", text) if text[:4].lower() == "with" else f" {text}"
    return spark.sql(f"WITH {bound}{rest}", args={"tenant_id": tenant_id}).limit(most_rows)
