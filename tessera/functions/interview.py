"""Scores of interview answers and signals of resumes, as Column expressions. Scores are in hundredths, so that they round alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that count as structure, decisions, evidence and technology.
STRUCTURE = ("首先", "其次", "最后", "because", "trade-off", "指标", "监控", "回滚", "验证", "风险")
DECISION = ("取舍", "权衡", "成本", "边界", "故障")
EVIDENCE = ("项目", "负责", "设计", "实现", "搭建", "开发", "优化", "主导", "架构", "上线", "提升", "降低", "减少", "built", "designed", "implemented", "developed", "optimized", "led", "improved", "reduced")
TECHNOLOGY = r"(?i)\b(?:agent|rag|llm|python|java|go|rust|fastapi|spring|react|postgresql|mysql|redis|kafka|docker|kubernetes|k8s)\b"
NUMBERS = r"(?i)\d+(?:\.\d+)?\s*%|\d+\s*(?:倍|ms|秒|万|亿)"
CONTACT = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+|(?<!\d)1[3-9]\d{9}(?!\d)"
STOP = ("一个", "以及", "如何", "什么", "进行", "可以", "需要", "说明")


def held(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def terms(text: Column, most: int = 100) -> Column:
    """Latin terms of three characters or more, lowered, then CJK runs of two to six, without stop words; at most so many."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z][a-z0-9_+.#/-]{2,}"), 0), F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,6}"), 0))
    return F.slice(F.filter(found, lambda w: ~w.isin(*STOP)), 1, most)


def flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def answer_score(answer: Column, evidence: Column) -> Column:
    """0 to 1000: 100, and parts for length (to 350), structure (to 200), terms shared with the evidence (to 300) and decisions (150 or 50); 0 for an empty answer."""
    a = flat(answer)
    length = F.least(F.lit(3.5), F.log2(F.greatest(F.lit(2), F.char_length(a)).cast("double")) * 0.55)
    structure = F.least(F.lit(2.0), held(F.lower(a), STRUCTURE) * 0.35)
    e = F.array_distinct(terms(evidence))
    shared = F.size(F.array_intersect(e, terms(a))) / F.greatest(F.lit(1), F.least(F.lit(12), F.size(e)))
    total = 1.0 + length + structure + F.least(F.lit(3.0), shared * 6.0) + F.when(held(a, DECISION) > 0, 1.5).otherwise(0.5)
    return F.when(a == "", 0).otherwise(F.floor(F.least(F.lit(10.0), total) * 100 + 0.001)).cast("long")


def code_score(code: Column, function_name: Column, rubric: Column) -> Column:
    """0 to 850: 200, and parts for the function (200 or 50), control flow, a return, balanced brackets and terms of the rubric; 0 for an empty answer."""
    c = F.trim(F.coalesce(code, F.lit("")))
    named = F.coalesce(function_name, F.lit(""))
    has_function = F.when(named != "", F.contains(F.regexp_replace(c, r"\s+", ""), F.concat(named, F.lit("(")))).otherwise(F.rlike(c, F.lit(r"\bfunction\b|=>|\bdef\b")))
    count = lambda x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    balanced = (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))
    score = F.lit(200) + F.when(has_function, 200).otherwise(50) + F.when(F.rlike(c, F.lit(r"\b(?:for|while|if|reduce|map|filter|return)\b")), 150).otherwise(0)
    score = score + F.when(F.rlike(c, F.lit(r"\breturn\b")), 150).otherwise(0) + F.when(balanced, 100).otherwise(0)
    score = score + F.least(F.lit(150), F.size(F.array_intersect(terms(rubric), terms(c))) * 30)
    return F.when(c == "", 0).otherwise(F.least(F.lit(850), score)).cast("long")


def resume_signals(resumes: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """key, signal, rank: the first `most` different segments of 6 to 220 characters that speak of work, numbers or technology and hold no contact data, cut to 180."""
    cut = resumes.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[。！？!?；;])\s*", -1)).alias("_p", "_s"))
    clean = cut.select(key, "_p", F.btrim(F.regexp_replace("_s", r"\s+", " "), F.lit(" •·●○-\t，,。.;；")).alias("s"))
    good = F.char_length("s").between(6, 220) & ~F.rlike("s", F.lit(CONTACT)) & ((held(F.lower("s"), EVIDENCE) > 0) | F.rlike("s", F.lit(NUMBERS)) | F.rlike("s", F.lit(TECHNOLOGY)))
    first = clean.filter(good).withColumn("_d", F.row_number().over(Window.partitionBy(key, F.lower("s")).orderBy("_p"))).filter("_d = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).filter(F.col("rank") <= most)
    return ranked.select(key, F.substring("s", 1, 180).alias("signal"), "rank")


def interview_scores(reviews: DataFrame, key: str) -> DataFrame:
    """key and dimensions (hundredths) from reviews (key, category, score, n_terms): means per category, falling back to the mean of all, mixed by fixed weights."""
    mean = lambda c: F.avg(F.when(F.col("category") == c, F.col("score")))
    m = reviews.groupBy(key).agg(
        F.avg("score").alias("base"), *[mean(c).alias(c) for c in ("knowledge", "scenario", "profile", "algorithm")], (F.sum("n_terms") / F.count("*")).alias("terms")
    )
    k, s, p, a = (F.coalesce(c, "base") for c in ("knowledge", "scenario", "profile", "algorithm"))
    has = F.col("algorithm").isNotNull()
    whole = lambda c: F.floor(c + 0.001).cast("long")
    return m.select(
        key,
        whole(k).alias("knowledge_accuracy"),
        whole(F.when(has, k * 0.45 + s * 0.35 + a * 0.20).otherwise(k * 0.55 + s * 0.45)).alias("technical_depth"),
        whole(s * 0.65 + p * 0.35).alias("practical_application"),
        whole(F.when(has, a * 0.55 + s * 0.30 + k * 0.15).otherwise(s * 0.75 + k * 0.25)).alias("problem_solving"),
        whole(F.least(F.lit(1000.0), F.col("base") * 0.75 + F.least(F.lit(250.0), F.col("terms") * 45))).alias("communication"),
    )
