"""Language identification by prediction by partial matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, set_apart, tidied

ORDER = 3
UNDETERMINED = "und"
_LETTER = re.compile("[A-Za-z]")
_START = b"\n" * ORDER
#: Bytes scored at a time, which bounds a worker's memory for texts of any length.
_CHUNK = 1 << 18
#: Texts encoded at a time.
_TEXTS = 256


@dataclass(frozen=True)
class ContextTree:
    """One language's frozen tree, as sorted arrays of what it has seen. For each order k: strings of k context bytes and a next one (as numbers) with the bits of the
    next byte there, and contexts of k bytes with the bits of an escape from them."""

    grams: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of ORDER + 1 bytes, after the others: from the longest context that has it, with the escapes on the way."""
        total, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            gram = codes[left] & ((1 << 8 * (k + 1)) - 1)
            at, has = _find(self.grams[k], gram)
            total[left[has]] += self.bits[k][at[has]]
            left, gram = left[~has], gram[~has]
            at, has = _find(self.contexts[k], gram >> 8)
            total[left[has]] += self.escapes[k][at[has]]
        total[left] += 8  # below the empty context all 256 bytes are alike
        return total


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted values, and which of them are there."""
    at = np.searchsorted(sorted_values, wanted)
    if not len(sorted_values):
        return at, np.zeros(len(wanted), dtype=bool)
    at = np.minimum(at, len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


@dataclass(frozen=True)
class ContextTrees:
    languages: tuple[str, ...]
    trees: tuple[ContextTree, ...]


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, gram (bytes), n: counts of 1 to ORDER + 1 bytes in the per_language labelled documents of each language with the smallest hashes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for text in texts:
                    data = np.frombuffer(_START + text.encode("utf-8"), dtype=np.uint8).astype(np.uint32)
                    code = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                    grams, n = np.unique(code, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n.astype(np.int64)})

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sample = bounded_sample(labelled, "lang", per_language, "doc_id", "text")
    return sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = 300) -> ContextTrees:
    """Context trees of the languages of docs (doc_id, text, lang), from at most per_language whole documents of each.

    Escape probabilities are those of method C: in a context seen n times with d different bytes, a byte seen c times has c / (n + d), and the
    escape to the next shorter context d / (n + d); the order below the empty context is uniform over 256 bytes. A tree holds what its language's sample has
    and nothing else, so the model grows with the languages' samples only; what is collected is bounded by them.
    """
    table = gram_counts(docs, per_language).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    return ContextTrees(languages, tuple(tree(own["gram"].to_numpy(dtype=np.int64), own["n"].to_numpy(dtype=np.float64)) for own in (table[table["lang"] == x] for x in languages)))


def tree(grams: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The tree of one language, from counts of its strings of ORDER + 1 bytes."""
    levels = []
    for k in range(ORDER + 1):
        keys, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        seen = np.bincount(at, weights=counts, minlength=len(keys))
        contexts, of, kinds = np.unique(keys >> 8, return_inverse=True, return_counts=True)
        total = np.bincount(of, weights=seen, minlength=len(contexts)) + kinds
        levels.append((keys, -np.log2(seen / total[of]), contexts, -np.log2(kinds / total)))
    return ContextTree(*zip(*levels))


def code_lengths(texts: list[bytes], trees: ContextTrees) -> np.ndarray:
    """Exact code length in bits of each text under each language, _CHUNK bytes at a time: each distinct string of a chunk is looked up once."""
    total = np.zeros((len(texts), len(trees.languages)))
    waiting: list[tuple[int, bytes]] = []

    def score() -> None:
        data = np.frombuffer(b"".join(x for _, x in waiting), dtype=np.uint8).astype(np.int64)
        codes, at = np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:], return_inverse=True)
        ends = np.cumsum([len(x) for _, x in waiting])
        starts = np.concatenate([[0], ends[:-1]])
        # The last ORDER places before a text's end would look into the next text.
        edges, owner = np.stack([starts, ends - ORDER], axis=1).ravel()[: 2 * len(waiting) - 1], [i for i, _ in waiting]
        for k, language in enumerate(trees.trees):
            np.add.at(total[:, k], owner, np.add.reduceat(language.code_lengths(codes)[at], edges)[::2])
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        text = _START + text
        for at in range(0, len(text) - ORDER, _CHUNK):
            waiting.append((i, text[at : at + _CHUNK + ORDER]))
            held += len(waiting[-1][1])
            if held >= _CHUNK:
                score()
                held = 0
    if waiting:
        score()
    return total


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def predict(texts: list[str | None], trees: ContextTrees) -> tuple[list[str], np.ndarray]:
    """The language with the shortest code, and its share of the probability when code lengths are taken per 64 bytes."""
    usable = [i for i, t in enumerate(texts) if t and has_letter(t)] if trees.languages else []
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if usable:
        parts, sizes = [], []
        for at in range(0, len(usable), _TEXTS):
            data = [texts[i].encode("utf-8") for i in usable[at : at + _TEXTS]]
            parts.append(code_lengths(data, trees))
            sizes += map(len, data)
        lengths = np.concatenate(parts)
        best = lengths.argmin(axis=1)
        excess = (lengths - lengths.min(axis=1, keepdims=True)) / np.maximum(1, np.array(sizes) / 64)[:, None]
        scores[usable] = 1 / np.exp2(-excess).sum(axis=1)
        for i, b in zip(usable, best):
            names[i] = trees.languages[b]
    return names, scores


def identify_languages(docs: DataFrame, trees: ContextTrees, into: str = "_lang") -> DataFrame:
    """All columns of docs (text) with `into`: struct of pred and score (0 to 1).

    `und` with score 0 for a null text or one without letters, or if nothing was learned. Any text is scored whole; lang, source and doc_id
    play no part. Equal rows get equal results; an empty table gives no rows; an input column of the name `into` is replaced, and no other name matters.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)  # sparse, and bounded by the training sample

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(judged(texts) for texts in batches)

    def judged(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(texts.tolist(), model.value)
        return pd.DataFrame({"pred": names, "score": scores})

    rows, _, text, back = set_apart(docs, into)
    return back(rows, F.pandas_udf(of, "pred string, score double")(text))
