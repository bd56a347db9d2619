"""Citations in answers, answers from tables, and the rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import answer_terms


def cited(answer: Column) -> Column:
    """The numbers of an answer's citation marks, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\](?!\()"), 1), lambda n: n.cast("int"))


def checked_citations(answers: DataFrame, sources: DataFrame, least: float = 0.15) -> DataFrame:
    """answer_id, sentence_no, refs, attached, unsupported, invalid for every sentence with terms of answers (answer_id, answer), against sources (answer_id, ref, content).

    A claim is supported by a source that shares two of its terms (one, if it has at most two) and at least `least` of them. Marks of other sources are invalid;
    a sentence without a supported mark is given its best source (ties: the first), or is unsupported.
    """
    sentences = F.filter(F.split("answer", r"(?<=[。！？.!?\n])(?!\[\d+\])", -1), lambda s: F.size(answer_terms(F.regexp_replace(s, r"\[\d+\]", ""))) > 0)
    said = answers.select("answer_id", F.posexplode(sentences).alias("sentence_no", "s"))
    claims = said.select("answer_id", "sentence_no", answer_terms(F.regexp_replace("s", r"\[\d+\]", "")).alias("c"), cited(F.col("s")).alias("marks"))
    known = sources.select("answer_id", "ref", answer_terms(F.col("content")).alias("e"))
    shared = F.size(F.array_intersect("c", "e"))
    support = F.when(shared >= F.when(F.size("c") <= 2, 1).otherwise(2), shared.cast("double") / F.size("c")).otherwise(F.lit(0.0))
    judged = claims.join(known, "answer_id", "left").withColumn("_s", F.coalesce(support, F.lit(0.0)))
    good = F.collect_set(F.when((F.col("_s") >= least) & F.array_contains("marks", F.col("ref")), F.col("ref")))
    best = F.max_by(F.when(F.col("_s") >= least, F.col("ref")), F.struct("_s", -F.col("ref")))
    grouped = judged.groupBy("answer_id", "sentence_no").agg(F.first("marks").alias("marks"), F.array_sort(good).alias("good"), best.alias("best"))
    attached = (F.size("good") == 0) & F.col("best").isNotNull()
    refs = F.when(F.size("good") > 0, F.col("good")).when(F.col("best").isNotNull(), F.array("best")).otherwise(F.array().cast("array<int>"))
    invalid = F.size(F.filter("marks", lambda m: ~F.array_contains(F.col("good"), m)))
    return grouped.select("answer_id", "sentence_no", refs.alias("refs"), attached.alias("attached"), ((F.size("good") == 0) & F.col("best").isNull()).alias("unsupported"), invalid.alias("invalid"))


# What a question about a table asks for, tried in this order.
AGGREGATIONS = (
    ("sum", r"(总和|合计|总计|总共|总额|求和|加起来|\bsum\b|\btotal\b)"),
    ("max", r"(最大|最高|最多|\bmax\b|\bhighest\b)"),
    ("min", r"(最小|最低|最少|\bmin\b|\blowest\b)"),
    ("avg", r"(平均|均值|\baverage\b|\bavg\b|\bmean\b)"),
    ("count", r"(多少[条个名位人]|一共[有几]多少|数量|多少|几[个条名位人]|一共|\bhow many\b)"),
)


def asked_aggregation(question: Column) -> Column:
    out = F.lit("lookup")
    for name, pattern in reversed(AGGREGATIONS):
        out = F.when(F.rlike(F.lower(question), F.lit(pattern)), name).otherwise(out)
    return out


def table_answers(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """question_id, aggregation, column_name, value: the answer of the first table (question_id, table_no, headers, rows) that has one for each question (question_id, question).

    The column is one that speaks of quantities if the question asks how many, else one whose whole name the question holds, else the one that shares most of its
    characters (two at least). A row is named by a cell of two characters or more that the question holds. Numbers lose their thousands separators; what isn't a number is skipped.
    """
    q = questions.withColumn("asked", asked_aggregation(F.col("question")))
    t = tables.filter((F.size("headers") > 0) & (F.size("rows") > 0)).join(q, "question_id")
    held = lambda h: F.size(F.filter(F.split(h, ""), lambda c: F.contains(F.col("question"), c)))
    numbered = F.transform("headers", lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    first = lambda a: F.get(F.transform(a, lambda x: x["i"]), F.lit(0))
    quantity = F.when(F.rlike("question", F.lit("(多少|几[个条名位人])")), first(F.filter(numbered, lambda x: F.rlike(x["h"], F.lit("[人数量金额]")))))
    whole = first(F.filter(numbered, lambda x: (F.char_length(x["h"]) >= 2) & F.contains(F.col("question"), x["h"])))
    scored = F.array_max(F.transform(numbered, lambda x: F.when((F.char_length(x["h"]) >= 2) & (held(x["h"]) >= 2), F.struct(held(x["h"]).alias("n"), (-x["i"]).alias("i")))))
    column = F.coalesce(quantity, whole, -scored["i"])
    row = F.get(F.filter(F.transform("rows", lambda r, i: F.when(F.exists(r, lambda c: (F.char_length(c) >= 2) & F.contains(F.col("question"), c)), i)), lambda i: i.isNotNull()), F.lit(0))
    t = t.withColumn("_c", column).withColumn("_r", row).withColumn("asked", F.when((F.col("asked") == "count") & F.col("_c").isNotNull() & F.col("_r").isNotNull(), "lookup").otherwise(F.col("asked")))
    numbers = F.filter(F.transform("rows", lambda r: F.regexp_replace(F.get(r, F.col("_c")), "[,，]", "").try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    t = t.withColumn("_n", numbers)
    total = F.aggregate("_n", F.lit(0.0), lambda a, x: a + x)
    number = F.when(F.col("asked") == "sum", total).when(F.col("asked") == "max", F.array_max("_n")).when(F.col("asked") == "min", F.array_min("_n")).when(F.col("asked") == "avg", F.try_divide(total, F.size("_n")))
    shown = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(F.format_string("%.2f", number))
    value = (
        F.when(F.col("asked") == "count", F.size("rows").cast("string"))
        .when(F.col("asked") == "lookup", F.get(F.get("rows", F.col("_r")), F.col("_c")))
        .when(F.size("_n") > 0, shown)
    )
    answered = t.withColumn("value", value).filter("value is not null").withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy("table_no")))
    return answered.filter("_k = 1").select("question_id", F.col("asked").alias("aggregation"), F.coalesce(F.get("headers", F.col("_c")), F.lit("*")).alias("column_name"), "value")
