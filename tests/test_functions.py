"""Scalar rules and interview scores."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import interview, rules


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_rules(spark):
    q = rules.normalized_query(F.lit("  use  K8S.x and k8s "), [("k8s", "kubernetes"), ("k8s.x", "$cost")])
    assert one(spark, q) == "use $cost and kubernetes"
    assert one(spark, rules.normalized_query(F.lit("kubernetes k8s"), [("k8s", "kubernetes")])) == "kubernetes k8s"
    assert one(spark, rules.question_kind(F.lit("这个函数报错"))) == "code_search" and one(spark, rules.question_kind(F.lit("配置说明"))) == "document_qa" and one(spark, rules.question_kind(F.lit("hi"))) == "general"
    assert one(spark, rules.with_citations(F.lit("text "), F.lit(2))) == "text\n\n[1][2]" and one(spark, rules.with_citations(F.lit("text [2]"), F.lit(2))) == "text [2]" and one(spark, rules.with_citations(F.lit("t [9]"), F.lit(1))) == "t [9]\n\n[1]"
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    assert {k: tuple(v) for k, v in one(spark, rules.map_changes(m(a="1", b="2"), m(b="3", c="4"))).items()} == {"a": ("1", None), "b": ("2", "3"), "c": (None, "4")}
    assert one(spark, rules.map_changes(m(a="1"), m(a="1"))) is None
    assert one(spark, rules.mention_excerpt(F.lit("Name"), F.lit("x" * 150 + " name " + "y" * 400))).startswith("x" * 99 + " name")
    assert one(spark, rules.typed_setting(F.lit("oops"), 0.5)) == 0.5 and one(spark, rules.typed_setting(F.lit(" Yes"), False)) is True and one(spark, rules.typed_setting(F.lit("7"), 1)) == 7
    assert one(spark, rules.evidence_tokens(F.lit(1000), F.lit(8000), F.lit(3000), F.lit(4))) == 1800
    assert one(spark, F.array(*rules.retrieval_budget(F.lit(8), F.lit(40), F.lit(True), F.lit(0.5)))) == [11, 50]


def test_next_run():
    now = datetime(2024, 2, 28, 23, 59, 30)
    assert rules.next_run("90", now) == datetime(2024, 2, 29, 0, 1)
    assert rules.next_run("*/15 * * * *", now) == datetime(2024, 2, 29)
    assert rules.next_run("30 9 29 2 *", now) == datetime(2024, 2, 29, 9, 30)
    assert rules.next_run("0 9 * * 0", now) == datetime(2024, 3, 4, 9)
    assert rules.next_run("0 9 * * *", now, "Asia/Shanghai") == datetime(2024, 2, 29, 1)
    with pytest.raises(ValueError):
        rules.next_run("61 * * * *", now)


def test_interview(spark):
    assert one(spark, interview.answer_score(F.lit(" "), F.lit("x"))) == 0
    full = "首先 说明 because 指标 监控 回滚 验证 风险 取舍 " + "kafka redis " * 80
    assert one(spark, interview.answer_score(F.lit(full), F.lit("kafka redis"))) == 1000
    assert one(spark, interview.code_score(F.lit("function solve(x) { return x.map(y => y) }"), F.lit("solve"), F.lit("map"))) == 800
    assert one(spark, interview.code_score(F.lit("x ((("), F.lit(None).cast("string"), F.lit(""))) == 250
    df = spark.createDataFrame([(1, "张三 zhang@x.com python\n负责支付系统设计。提升 30%\n负责支付系统设计\n爱好\nUsed Kafka daily")], "id int, t string")
    assert [r["signal"] for r in interview.resume_signals(df, "id", "t").orderBy("rank").collect()] == ["负责支付系统设计", "提升 30%", "Used Kafka daily"]
    reviews = spark.createDataFrame([(1, "knowledge", 800, 10), (1, "scenario", 600, 0)], "id int, category string, score int, n_terms int")
    r = interview.interview_scores(reviews, "id").first()
    assert (r["knowledge_accuracy"], r["technical_depth"], r["practical_application"], r["problem_solving"], r["communication"]) == (800, 710, 635, 650, 750)
