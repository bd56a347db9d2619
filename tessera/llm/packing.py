"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, stored, tidied

#: The pattern of byte-level pre-tokenizers; what it finds is encoded part by part.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "one two\nthree  four's 12a!? \t\u00e9t\u00e9 "
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|^\s|\s$")
#: Words a worker remembers the ids of, the first that it meets, among which are the common ones; others are looked up each time, which changes speed only.
REMEMBERED_WORDS = 400_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1 and no space, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class WordIds(dict):
    """Token ids of words and parts of words as little-endian uint32 bytes, by the model of a tokenizers file, looked up once and remembered."""

    def __init__(self, vocabulary: str, most: int = REMEMBERED_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.characters, self.split = Tokenizer.from_file(vocabulary), byte_characters(), regex.compile(PARTS).findall
        own = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(_PROBE)]
        #: Whether the file's pre-tokenizer cuts texts as PARTS does; if not, they are encoded whole.
        self.cuts = self.tokenizer.normalizer is None and own == [self.shown(p) for p in self.split(_PROBE)]

    def shown(self, part: str) -> str:
        if part.isascii() and part.isprintable():
            return part.replace(" ", self.characters[32])
        return part.encode("utf-8").decode("latin-1").translate(self.characters)

    def parts(self, word: str) -> list[str]:
        """As the pattern cuts it; letters alone, and letters before one comma or point, are known without it."""
        letters = word[1:] if word.startswith(" ") else word
        if letters.isalpha():
            return [word]
        if letters[:-1].isalpha() and letters[-1] in ",.":
            return [word[:-1], word[-1]]
        return self.split(word)

    def __missing__(self, word: str) -> bytes:
        parts = self.parts(word)
        if len(parts) == 1:
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(self.shown(word))])
            if sys.byteorder == "big":
                ids.byteswap()
            found = ids.tobytes()
        else:
            found = b"".join([self[p] for p in parts])
        if len(self) < self.most:
            self[word] = found
        return found

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. A single space or newline between other characters always begins a part, so the words between can be encoded alone; texts with other white space
        are cut into their parts, and those that may hold a special token are encoded whole."""
        for text in texts:
            if not self.cuts or "<|" in text:
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif not text or "\x00" in text or _ODD_SPACE.search(text):
                yield b"".join(map(self.__getitem__, self.split(text)))
            else:
                yield b"".join(map(self.__getitem__, text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")))


@cache
def word_ids(vocabulary: str, most: int = REMEMBERED_WORDS) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(vocabulary, most)


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with end_id, in pieces of `capacity`, the first of which may be shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = word_ids(vocabulary, remembered), np.asarray([end_id], dtype="<u4").tobytes()

        def of(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for doc, ids in zip(batch["doc_id"], words.of([t or "" for t in batch["text"]])):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            return pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": batch["doc_id"].dtype})

        yield from tidied(of(batch) for batch in batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a string keeps nulls apart from numbers
    out = texts.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the pieces of each length go, from the histogram of lengths alone: its size doesn't depend on the number of pieces.

    Rows (length, rank, n, sequence, each, offset): the n pieces of that length from that rank on go to the sequences from `sequence` on,
    `each` to a sequence, from that offset on. Lengths above a third of the capacity are matched greedily, the largest with the
    largest partner that fits, at most two to a sequence; smaller ones, in falling order, go where the least room is left that holds them.
    """
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, number)
    sequences = 0

    def put(length: int, first: int, bins: int, each: int, n: int, offset: int) -> None:
        plan.append((length, rank[length], n, first, each, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and (left[x] if x != a else left[x] - 1) > 0), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, sequences, n, 1, n, 0)
            if b is not None:
                put(b, sequences, n, 1, n, a)
            if free := capacity - a - (b or 0):
                rooms.setdefault(free, []).append((sequences, n))
            sequences += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            free = min((x for x in rooms if x >= s and rooms[x]), default=None)
            if free is None:
                n = -(-left[s] // (capacity // s))
                rooms.setdefault(capacity, []).append((sequences, n))
                sequences += n
                free = capacity
            first, bins = rooms[free].pop()
            each = free // s
            full = min(bins, left[s] // each)
            if full:
                put(s, first, full, each, full * each, capacity - free)
                if rest := free - each * s:
                    rooms.setdefault(rest, []).append((first, full))
            if full < bins and left[s]:
                n = left[s]  # fewer than would fill one more
                put(s, first + full, 1, n, n, capacity - free)
                if rest := free - n * s:
                    rooms.setdefault(rest, []).append((first + full, 1))
                full += 1
            if full < bins:
                rooms[free].append((first + full, bins - full))
    return plan, sequences


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """Pack every document of docs (doc_id, text) into sequences of at most `capacity` tokens.

    `vocabulary` is a file of the tokenizers library. Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. The plan comes from the histogram of lengths (at most
    `capacity` numbers); pieces are then numbered within their length, in parallel, and looked up in the plan.

    A null or empty text is one piece of just end_id; a null doc_id stays null; equal rows are packed one by one; an empty table gives no
    rows; other columns are ignored. Texts of any length are encoded whole. A worker remembers `remembered` words for as long as it lives, which changes speed and memory only.
    """
    spark = docs.sparkSession
    what = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = stored(
        pieces(docs, vocabulary, capacity, end_id, remembered)
        .withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_partitions(spark))).cast("int"))
    )
    parts = stored(cut.groupBy("length", "_part").count())
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("count")).collect()}  # at most `capacity` rows
    plan, _ = packing_plan(counts, capacity)
    places = spark.createDataFrame(plan, "length long, _rank long, _n long, _sequence long, _each long, _offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["length", "_part"]).withColumn("_at", F.col("_at") + F.col("_start"))
    at = F.col("_at") - F.col("_rank")
    return (
        ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_at") >= F.col("_rank")) & (at < F.col("_n")))
        .drop(places["length"])
        .select(
            *what,
            (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
        )
    )
