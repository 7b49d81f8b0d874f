import json

import pytest
from pyspark.sql import functions as F

from curbflow import labels as L
from curbflow.operators import marts, recommend, reports


def test_fallback_only_when_no_row_meets_the_rule(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, s double")
    order = [F.col("s").desc()]

    def pick(limit):
        rows = recommend.top_k_or_fallback(
            df, F.col("s") > limit, order, 2, F.col("s") >= 0, order, 3
        )
        return sorted(r.id for r in rows.collect())

    assert pick(3.5) == [4, 5]
    assert pick(4.5) == [5]
    assert pick(99.0) == [3, 4, 5]


def test_labels(spark):
    df = spark.createDataFrame(
        [(0.75, 200.0), (0.45, 199.0), (0.449, 49.0)], "score double, n double"
    )
    rows = df.select(
        recommend.priority("score"), recommend.confidence(F.col("n"), 3),
        recommend.confidence(F.col("n"), 2), recommend.confidence(F.col("n"), 1),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("High", "High", "Medium", "Low"), ("Medium", "Medium", "Medium", "Low"),
        ("Low", "Low", "Low", "Low"),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"demand_gap_rate":0.156,"spillover_score":3.421}', "需求缺口率：15.6%；外溢评分：3.421"),
        ("{'post_policy_order_count': 47, 'x': 1.0}", "政策后订单量：47；x：1.000"),
        ("not json at all", "not json at all"),
        ("[1, 2]", L.NO_EVIDENCE),
        (None, L.NO_EVIDENCE),
    ],
)
def test_evidence_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "e string")
    assert df.select(recommend.evidence_text("e")).first()[0] == expected


def test_scores_stay_in_range_and_blend(chain):
    rows = chain.stored_zone_scores.collect()
    assert rows
    for r in rows:
        parts = (
            r.demand_gap_score, r.driver_pressure_score, r.passenger_price_pressure_score,
            r.spillover_score_normalized,
        )
        assert all(0 <= p <= 1 for p in parts)
        blend = sum(w * p for w, p in zip((0.35, 0.25, 0.20, 0.20), parts))
        assert r.final_action_score == pytest.approx(blend)


def test_cards_are_numbered_and_carry_json(chain):
    cards = chain.cards.orderBy("strategy_id").collect()
    assert [c.strategy_id for c in cards] == [f"STRAT_{i:04d}" for i in range(1, len(cards) + 1)]
    assert all(isinstance(json.loads(c.evidence_metric), dict) for c in cards)
    ranked = recommend.rank_cards(chain.cards).collect()
    ranks = [(c.priority_rank, -c.final_action_score) for c in ranked]
    assert ranks == sorted(ranks)
    assert "created_at" in recommend.stamped(chain.cards).columns


def test_top_k_puts_missing_measures_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("d", 0.5)], "k string, m double")
    assert [r.k for r in marts.top_k(df, "m", ["k"], 3).collect()] == ["a", "c", "d"]
    assert [r.k for r in marts.top_k(df, "m", ["k"], 1, smallest=True).collect()] == ["d"]


def test_display_text(spark):
    df = spark.createDataFrame([(0.1234, 1234567), (None, 5)], "r double, n bigint")
    rows = df.select(
        reports.display_rate("r"), reports.display_number("r"), reports.display_count("n")
    ).collect()
    assert tuple(rows[0]) == ("12.3%", "0.12", "1,234,567")
    assert tuple(rows[1]) == ("暂无可用结果", "暂无可用结果", "5")


def test_histogram_counts_every_finite_value(spark):
    df = spark.createDataFrame(
        [(x,) for x in (0.0, 1.0, 0.5, None, float("nan"), float("inf"))],
        "driver_pay_per_minute_change_rate double",
    )
    rows = reports.pay_change_histogram(df).collect()
    assert sum(r.routes for r in rows) == 3
    assert {r.bin for r in rows} == {0, 15, 29}
    same = df.where("driver_pay_per_minute_change_rate = 1.0")
    assert reports.pay_change_histogram(same).first().routes == 1
