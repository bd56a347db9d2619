"""Scalar rules of queries, settings, schedules and records."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a question about code or documents holds.
CODE_TERMS = ("代码", "函数", "class ", "def ", "api", "报错", "编程")
DOCUMENT_TERMS = ("文档", "说明", "怎么用", "指南", "流程", "配置")


def normalized_query(question: Column, mappings: list[tuple[str, str]]) -> Column:
    """White space collapsed, and each source term replaced by its target, the longest source first, unless the target is there already. ASCII sources match in any case.
    mappings is a short configured list."""
    q = F.btrim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    for source, target in sorted((m for m in mappings if all(m)), key=lambda m: -len(m[0])):
        pattern = ("(?i)" if source.isascii() else "") + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", source)
        q = F.when(F.contains(q, F.lit(target)), q).otherwise(F.regexp_replace(q, pattern, target.replace("\\", "\\\\").replace("$", "\\$")))
    return q


def question_kind(question: Column) -> Column:
    """code_search, document_qa or general, by which terms a question holds more of."""
    low = F.lower(question)
    n = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.when(n(CODE_TERMS) > n(DOCUMENT_TERMS), "code_search").when(n(DOCUMENT_TERMS) > 0, "document_qa").otherwise("general")


def with_citations(answer: Column, n_sources: Column) -> Column:
    """The answer with marks of all sources at its end if it has no valid one."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\](?!\()"), 1), lambda n: n.try_cast("int"))
    valid = F.exists(marks, lambda n: n.between(1, n_sources))
    every = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n_sources, F.lit(1))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    return F.when((n_sources < 1) | valid, answer).otherwise(F.concat(F.rtrim(answer), F.lit("\n\n"), every))


def map_changes(before: Column, after: Column) -> Column:
    """Map of the keys whose values differ to (before, after); null if either side is null or nothing differs."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("k"), F.struct(F.try_element_at(before, k).alias("before"), F.try_element_at(after, k).alias("after")).alias("v")))
    out = F.map_from_entries(F.filter(pairs, lambda p: ~p["v"]["before"].eqNullSafe(p["v"]["after"])))
    return F.when(before.isNotNull() & after.isNotNull() & (F.size(out) > 0), out)


def mention_excerpt(name: Column, content: Column, before: int = 100, size: int = 360) -> Column:
    """`size` characters of the content from `before` characters ahead of the first mention of the name, or from the start."""
    flat = F.btrim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    place = F.position(F.lower(name), F.lower(flat))
    start = F.greatest(F.lit(1), place - before)
    return F.substring(flat, F.when(place > 0, start).otherwise(1), F.lit(size))


def typed_setting(raw: Column, default: int | float | bool | str) -> Column:
    """An override as the default's type; the default where it is null or can't be read."""
    if isinstance(default, bool):
        return F.when(raw.isNull(), F.lit(default)).otherwise(F.lower(F.trim(raw)).isin("true", "1", "yes", "on"))
    kind = {int: "bigint", float: "double", str: "string"}[type(default)]
    return F.coalesce(F.trim(raw).try_cast(kind) if kind != "string" else raw, F.lit(default))


def retrieval_budget(top_k: Column, candidates: Column, expert: Column, analysis_share: Column) -> tuple[Column, Column]:
    """Final and candidate numbers, raised for experts (3, 10) and for users who mostly analyse (2, at most 10)."""
    k = top_k + F.when(expert, 3).otherwise(0)
    k = F.when(analysis_share > 0.3, F.greatest(k, F.least(F.lit(10), k + 2))).otherwise(k)
    return k, candidates + F.when(expert, 10).otherwise(0)


def evidence_tokens(configured: Column, window: Column, reserved: Column, k: Column) -> Column:
    """Tokens for evidence: what is configured but within the window, at least 450 a source, never more than the window leaves."""
    room = F.greatest(F.lit(0), window - reserved)
    return F.least(room, F.greatest(F.least(configured, room), k * 450))


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if a == "*" else (int(a), int(b) if b else high if step else int(a))
        if not low <= first <= last <= high:
            raise ValueError(f"{spec} is outside {low}-{high}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def next_run(expression: str, now: datetime, zone: str = "UTC") -> datetime:
    """The next time (naive UTC) after now (naive UTC) of whole seconds or of five fields (minute, hour, day, month, weekday with 0 = Monday) in the zone. A control rule, one schedule at a time."""
    if expression.strip().lstrip("-").isdigit():
        return now + timedelta(seconds=int(expression))
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("five fields or seconds are required")
    minutes, hours, days, months, weekdays = (_field(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))))
    local = now.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone))
    t = (local + timedelta(minutes=1)).replace(second=0, microsecond=0)
    for _ in range(4 * 366 * 24 * 60):
        if t.month not in months or t.day not in days or t.weekday() not in weekdays:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in hours:
            t = (t + timedelta(hours=1)).replace(minute=0)
        elif t.minute not in minutes:
            t += timedelta(minutes=1)
        else:
            return t.astimezone(timezone.utc).replace(tzinfo=None)
    raise ValueError(f"{expression} has no next time")
