import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrascore.functions import numbers
from terrascore.plans import composite, dashboard, second
from terrascore.plans.composite import COMPONENTS, WEIGHTS, IndexSettings
from terrascore.plans.roles import IndexRoles
from terrascore.workloads.index import index_frame


def roles(spark, consumption=((1, 30000.0), (2, 90000.0))):
    """Five entities in two regions; region 2 has no data at all."""

    def f(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return IndexRoles(
        settlements=f([(i, f"e{i}", "село", 1 if i < 4 else 2, f"t{i}" if i != 3 else None) for i in range(1, 6)], "entity_id bigint, entity_name string, entity_type string, region_id int, territory_id string"),
        regions=f([(1, "North"), (2, "South")], "region_id int, region_name string"),
        territories=f([("t1", " Alpha "), ("t2", "BETA"), ("t4", "gamma"), ("t5", "delta")], "territory_id string, territory_name string"),
        attributes=f([(1, True, None, False, True)], "entity_id bigint, is_zone boolean, is_remote boolean, is_special boolean, is_suburb boolean"),
        quality=f([(1, 0.8), (2, 0.2)], "entity_id bigint, quality_scaled double"),
        market=f([("t1", 10.0, 2024), ("t2", 30.0, 2024), ("t2", 99.0, 2023)], "territory_id string, market_access double, year int"),
        consumption=f([(e, dt.date(2024, 8, 1), v) for e, v in consumption] + [(1, dt.date(2023, 8, 1), 1.0)], "entity_id bigint, date date, consumption double"),
        access=f([(1, 1.0)], "entity_id bigint, access_scaled double"),
        climate_monthly=f([(1, 2024, 1, -20.0), (1, 2024, 7, 10.0), (1, 2023, 1, -10.0), (2, 2024, 1, 0.0), (2, 2022, 1, 50.0)], "entity_id bigint, year int, month int, temperature double"),
        climate_yearly=f([(1, 2024, 6000.0), (1, 2023, 9000.0), (2, 2024, 4500.0)], "entity_id bigint, year int, degree_days double"),
        mobility=f([("alpha", 2024, 4.0), ("ALPHA ", 2024, 6.0), ("beta", 2024, 15.0)], "territory_label string, year int, mobility_km double"),
    )


@pytest.fixture(scope="module")
def scored(spark):
    return {r.entity_id: r for r in composite.composite_index(roles(spark)).collect()}


def test_no_entity_is_lost_or_repeated(scored):
    assert sorted(scored) == [1, 2, 3, 4, 5]


def test_repeated_territory_name_is_averaged(scored):
    assert scored[1].mobility_km == 5.0 and scored[2].mobility_km == 15.0


def test_gaps_take_the_regional_mean_then_neutral(scored):
    # entity 3 has no territory: the mean of 10 and 30 lies half way
    assert scored[3].market_score == 0.5 and scored[3].mobility_km == 10.0
    assert scored[4].market_score == 0.5 and scored[4].mobility_km is None
    assert scored[5].quality_score == scored[5].climate_score == 0.5


def test_region_without_consumption_scores_one_unless_asked(spark, scored):
    assert scored[4].consumption_score == 1.0
    neutral = composite.composite_index(roles(spark), IndexSettings(null_neutral=True))
    assert neutral.filter("entity_id = 4").head().consumption_score == 0.5


def test_welfare_is_capped_and_relative_to_the_level(scored):
    assert scored[1].consumption_score == round(30000 / 27000 / 2, 4) and scored[2].consumption_score == 1.0


def test_degree_days_are_weighted_by_months(scored):
    assert scored[1].degree_days == 7000.0 and scored[1].heating_over_baseline == round(2500 / 4500 * 100)
    assert (scored[1].temp_winter, scored[1].temp_summer, scored[1].temp_amplitude) == (-15.0, 10.0, 25.0)
    assert scored[1].climate_score == 0.0 and scored[2].climate_score == 1.0


def test_climate_band_of_unknown_degree_days(spark, scored):
    assert (scored[1].climate_band, scored[2].climate_band, scored[5].climate_band) == ("Очень холодный", "Мягкий", "Экстремальный")
    kept = composite.composite_index(roles(spark), IndexSettings(keep_null_band=True))
    assert kept.filter("entity_id = 5").head().climate_band is None


def test_missing_flags_are_false(scored):
    assert scored[1].is_zone and scored[1].is_suburb and not scored[1].is_remote and not scored[2].is_zone


def test_known_record():
    assert sum(WEIGHTS.values()) == pytest.approx(1.0)


def test_known_record_score(spark):
    values = dict(zip(COMPONENTS, (0.6532, 1.0, 0.6579, 0.4564, 0.8872, 0.5)))
    s = numbers.weighted_score({c: F.lit(v) for c, v in values.items()}, WEIGHTS)
    row = spark.range(1).select(numbers.round_half_up(s, 4).alias("a"), numbers.round_half_up(s * 10, 2).alias("b")).head()
    assert (row.a, row.b) == (0.7095, 7.09)


def test_rounding_goes_away_from_zero(spark):
    row = spark.range(1).select(*[numbers.round_half_up(F.lit(x), d).alias(f"c{i}") for i, (x, d) in enumerate([(2.5, 0), (-2.5, 0), (0.285, 2), (0.12345, 4)])]).head()
    assert tuple(row) == (3.0, -3.0, 0.29, 0.1235)


def test_rank_is_one_plus_the_number_of_better_entities(spark, small):
    rows = composite.competition_rank(index_frame(spark, small).select("entity_id", "index_score"), "index_score").collect()
    assert all(r["rank"] == 1 + sum(o.index_score > r.index_score for o in rows) for r in rows)


def test_waterfall_steps_add_up(spark, small):
    index = index_frame(spark, small)
    for mode in ("national", "regional"):
        steps = dashboard.waterfall(index, mode).groupBy("entity_id").agg(
            F.sum(F.when(F.col("label") != "total", F.col("value"))).alias("s"), F.max(F.when(F.col("label") == "total", F.col("value"))).alias("t")
        )
        assert steps.filter(F.abs(F.col("s") - F.col("t")) > 0.011).count() == 0


def test_index_plan_broadcasts_only_small_tables_and_has_no_python(spark, small):
    plan = index_frame(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "NestedLoop" not in plan


def test_scan_reads_only_needed_columns_and_pushes_the_period(spark, small):
    from terrascore.plans import roles as bound

    plan = composite.consumption_mean(bound.consumption(spark, small), "entity_id", bound.HALF_YEAR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-07-01T00:00)" in plan and "o_orderstatus" not in plan


def test_second_index_ranks_and_constant_first_index(spark):
    entities = spark.createDataFrame([(1, "село"), (2, "город"), (3, "x")], "entity_id bigint, entity_type string")
    first = spark.createDataFrame([(i, 5.0) for i in (1, 2, 3)], "entity_id bigint, index_v1 double")
    access = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 9.0)], "entity_id bigint, access_score double, hub_km double")
    out = {r.entity_id: r for r in second.second_index(entities, first, access).collect()}
    assert out[1].first_scaled == 0.5 and out[1].index_v2 == pytest.approx(0.3 + 0.3 + 0.07)
    assert (out[1].rank_old, out[2].rank_old, out[1].rank_new, out[2].rank_new) == (1, 1, 1, 2)
    assert out[3].index_v2 is None and out[3].rank_new is None
