"""Fill-in-the-middle: texts cut in three at drawn units and put together around sentinels."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, islice
from struct import unpack

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import set_apart

#: A unit is a code point, unless another pattern is given (words, lines).
CODE_POINT = r"(?s)."
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
_KIND = "form string, n long, prefix long, middle long, output string"


def draws(seed: int, doc_id: str | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that a document's id decides; a null id counts as an empty one."""
    return unpack(">4I", sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def number_of(matches: Iterator[re.Match]) -> int:
    """How many matches there are; none is kept."""
    seen = count()
    deque(zip(matches, seen), maxlen=0)
    return next(seen)


def end_after(matches: Iterator[re.Match], ahead: int, here: int) -> int:
    """Where the match that lies so many ahead ends; `here`, if that is the last one taken."""
    return next(islice(matches, ahead - 1, None)).end() if ahead else here


def transformed(text: str, doc_id: str | None, unit: re.Pattern, seed: int, percent: int, spm_percent: int) -> tuple[str, int, int | None, int | None, str]:
    """form, number of units, length of prefix and of middle in characters, output.

    Two passes over the text by lazy matches: one counts the units, the other one moves on to the two drawn ranks. What lies between units belongs to the part
    before the next one; what lies behind the last one, to the suffix. Besides text and output, memory doesn't grow with the text.
    """
    first, second, whether, order = draws(seed, doc_id)
    n = number_of(unit.finditer(text))
    if not text or any(s in text for s in SENTINELS) or whether % 100 >= percent:
        return "plain", n, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = unit.finditer(text)
    a = end_after(matches, low, 0)
    b = end_after(matches, high - low, a)
    if order % 100 < spm_percent:
        return "spm", n, a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return "psm", n, a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(docs: DataFrame, into: str = "_fim", unit: str = CODE_POINT, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs (doc_id, text, others kept) with a struct `into`: form (plain, psm, spm), n (units), prefix and middle (their code points; null if plain), output (the text to train on).

    `percent` of the texts are cut, `spm_percent` of those in the order suffix, prefix, middle. The cuts depend on seed, doc_id and number of units only, so equal rows get equal results,
    wherever they are run (again). A null text counts as empty; empty texts and those that hold a sentinel stay plain; a null doc_id draws like an empty one; an empty table gives
    no rows; a column named as `into` is replaced. Texts of any length are cut whole.
    """
    own, doc_id, text, back = set_apart(docs, into)

    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(unit)
        for texts, ids in batches:
            yield pd.DataFrame([transformed(t, i, pattern, seed, percent, spm_percent) for t, i in zip(texts, ids)], columns=["form", "n", "prefix", "middle", "output"]).astype({"n": "int64", "prefix": "Int64", "middle": "Int64"})

    return back(own, F.pandas_udf(of, _KIND)(F.coalesce(text, F.lit("")), doc_id.cast("string")))


def restored(form: Column, output: Column) -> Column:
    """The exact text again, from output and form alone: a cut text holds no sentinel, so each stands once in its output."""
    before, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring(F.substring_index(before, SUFFIX, 1), len(PREFIX) + 1, 1 << 30), middle, F.substring_index(before, SUFFIX, -1))
    spm = F.concat(F.substring_index(before, PREFIX, -1), middle, F.substring(F.substring_index(before, PREFIX, 1), len(SUFFIX) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
