"""What is remembered of users: each fact judged against what earlier facts left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.streaming.ordered import in_order

# A fact as like a memory as that says nothing new; memories of a user that are looked at.
SAME, MOST = 0.92, 200


def _alike(a: str, b: str) -> float:
    """1 if one holds the other, else the Jaccard similarity of their pairs of neighbouring characters."""
    if a in b or b in a:
        return 1.0
    x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def merged(facts: DataFrame, key: str, order: str, fact: str, ts: str | None = None, supersedes: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """key, order, action, replaced for facts (key, order, fact) in order: NOOP if a memory is alike by more than SAME (or one holds the other), else UPDATE if the one that is most alike is by
    `supersedes` or more (ties: the oldest), whose order value is `replaced`: it goes, and the fact is remembered in its place; else ADD. A key's newest MOST memories are kept.

    Whether a fact is new depends on what the earlier ones left, so each key's facts are folded in order, with its memories as the only state. On a stream (ts: the facts' times) facts wait until the watermark has
    passed them, and a user's memories stay. Null and empty facts are NOOP; of facts with equal order the smaller text comes first.
    """

    def step(memories: list, rows: pa.RecordBatch) -> tuple[list, tuple[list, list]]:
        actions, replaced = [], []
        for at, text in zip(rows.column(order).to_pylist(), rows.column("_f").to_pylist()):
            scores = [_alike(text, m) for _, m in memories] if text else [1.0]
            best = max(scores, default=0.0)
            gone = None
            if best > SAME:
                actions.append("NOOP")
            elif best >= supersedes:
                actions.append("UPDATE")
                gone = memories[scores.index(best)][0]
                memories = [m for i, m in enumerate(memories) if i != scores.index(best)]
            else:
                actions.append("ADD")
            if actions[-1] != "NOOP":
                memories = [*memories, [at, text]][-MOST:]
            replaced.append(gone)
        return memories, (actions, replaced)

    kind = facts.schema[order].dataType.simpleString()
    new = {"action": "string", "replaced": kind}
    if facts.isStreaming:
        rows = facts.select(key, order, F.col(fact).alias("_f"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
        return in_order(rows, key, late, ["_t", order], [order], new, list, step, lambda memories, _: (memories or None, None))
    return folds.running(facts.select(key, order, F.col(fact).alias("_f")), key, [order, "_f"], [key, order], new, list, step)
