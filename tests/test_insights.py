from pyspark.sql import functions as F

from pathlens import config
from pathlens.operators import insights as INS


def test_routing_first_topic_wins(spark):
    q = spark.createDataFrame([
        ("Which CHANNEL performs best?",), ("Which segment is most valuable?",),
        ("Show me the journey path",), ("How is revenue trending?",),
        ("What do you recommend?",), ("customer journey conversion",),   # two topics: segments first
        ("hello there",)], "question string")
    got = [r.topic for r in INS.route_questions(q).collect()]
    assert got == ["touchpoint_performance", "customer_segments", "journey_patterns",
                   "revenue_trends", "recommendations", "customer_segments", "comprehensive"]


def test_touchpoint_insight_text(spark):
    df = spark.createDataFrame([
        ("website", 1234, 98765.432, 80.03, 5.0, 10, 12.25),
        ("email", 10, 5.0, 0.5, 5.0, 3, 40.0)],
        "touchpoint string, total_interactions long, total_revenue double, "
        "avg_revenue_per_interaction double, avg_session_duration double, unique_customers long, "
        "conversion_rate double")
    text = INS.insight_touchpoints(df).first().answer
    assert "Most revenue: website ($98,765.43 from 1,234 interactions, 12.2% of them conversions)." in text
    # 12.25 -> half-even
    assert "Highest conversion rate: email (40.0%, $0.50 per interaction)." in text


def test_empty_inputs_give_no_data_messages(spark):
    empty = spark.createDataFrame([], "touchpoint string, total_interactions long, "
                                      "total_revenue double, avg_revenue_per_interaction double, "
                                      "avg_session_duration double, unique_customers long, "
                                      "conversion_rate double")
    assert INS.insight_touchpoints(empty).first().answer == config.NO_DATA["touchpoint_performance"]


def test_answer_questions_joins_answers(spark):
    q = spark.createDataFrame([("what do you recommend",), ("hi",)], "question string")
    answers = spark.createDataFrame([("recommendations", "R"), ("comprehensive", "C")],
                                    "topic string, answer string")
    got = {r.question: r.answer for r in INS.answer_questions(q, answers).collect()}
    assert got == {"what do you recommend": "R", "hi": "C"}
