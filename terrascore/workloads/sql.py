"""SQL fragments shared by the oracles."""

from __future__ import annotations


def rnd(expr: str, digits: int = 6) -> str:
    """The same decimal rounding as ``round_half_up``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


ENTITIES = """
entities AS (
  SELECT c_custkey AS entity_id, c_name AS entity_name, c_mktsegment AS entity_type,
         n_regionkey AS region_id, r_name AS region_name, CAST(n_nationkey AS VARCHAR) AS territory_id,
         lower(trim(n_name)) AS territory_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

ATTRIBUTES = """
attributes AS (
  SELECT c_custkey AS entity_id, c_nationkey % 3 = 0 AS is_zone, c_custkey % 7 = 0 AS is_remote,
         c_custkey % 10 = 0 AS is_special, c_custkey % 4 = 1 AS is_suburb
  FROM customer
)"""

MARKET = """
market AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS territory_id, sum(s_acctbal) AS market_access
  FROM supplier GROUP BY 1
)"""

CLIMATE = """
monthly AS (
  SELECT l_suppkey AS entity_id, year(l_shipdate) AS year, month(l_shipdate) AS month, avg(l_quantity) - 25 AS temperature
  FROM lineitem GROUP BY 1, 2, 3
),
daily AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) - 25 AS temperature
  FROM lineitem GROUP BY 1, 2
),
yearly AS (
  SELECT entity_id, year(date) AS year, sum(greatest(0, 18 - temperature)) AS degree_days FROM daily GROUP BY 1, 2
),
climate AS (
  SELECT m.entity_id, avg(temperature) AS temp_mean,
         avg(CASE WHEN month IN (12, 1, 2) THEN temperature END) AS temp_winter,
         avg(CASE WHEN month IN (6, 7, 8) THEN temperature END) AS temp_summer,
         avg(CASE WHEN month IN (6, 7, 8) THEN temperature END) - avg(CASE WHEN month IN (12, 1, 2) THEN temperature END) AS temp_amplitude,
         avg(degree_days) AS degree_days
  FROM monthly m LEFT JOIN yearly y ON m.entity_id = y.entity_id AND m.year = y.year
  WHERE m.year IN (1996, 1997) GROUP BY 1
)"""

_FILL = "coalesce({c}, avg({c}) OVER (PARTITION BY region_id))"
_SCALE = "({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)"

SCORED = f"""
WITH {ENTITIES}, {ATTRIBUTES}, {MARKET}, {CLIMATE},
mobility AS (
  SELECT lower(trim('  ' || n_name || ' ')) AS territory_key, avg(CAST(n_nationkey * 3 % 11 AS DOUBLE)) AS mobility_km
  FROM nation GROUP BY 1
),
spending AS (
  SELECT o_custkey AS entity_id, avg(o_totalprice) AS consumption FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-07-01' AND DATE '1996-12-31' GROUP BY 1
),
raw AS (
  SELECT e.*, market_access, consumption, mobility_km,
         (c_acctbal + 1000) / 11000 AS quality_scaled,
         ((c_custkey * 17 % 101) / 100.0)::DOUBLE AS access_scaled,
         temp_mean, temp_winter, temp_summer, temp_amplitude, degree_days,
         coalesce(is_zone, false) AS is_zone, coalesce(is_remote, false) AS is_remote,
         coalesce(is_special, false) AS is_special, coalesce(is_suburb, false) AS is_suburb,
         CASE region_id WHEN 0 THEN 280000.0 WHEN 1 THEN 200000.0 WHEN 2 THEN 320000.0 WHEN 3 THEN 350000.0 ELSE 270000.0 END::DOUBLE AS level
  FROM entities e JOIN customer ON c_custkey = e.entity_id
  LEFT JOIN market USING (territory_id) LEFT JOIN mobility USING (territory_key)
  LEFT JOIN spending USING (entity_id) LEFT JOIN climate USING (entity_id) LEFT JOIN attributes USING (entity_id)
),
filled AS (
  SELECT *, {_FILL.format(c='market_access')} AS market_filled, {_FILL.format(c='consumption')} AS consumption_filled,
         {_FILL.format(c='mobility_km')} AS mobility_filled FROM raw
),
components AS (
  SELECT *, coalesce(quality_scaled, 0.5) AS quality, coalesce({_SCALE.format(c='market_filled')}, 0.5) AS market,
         coalesce(least(consumption_filled / level, 2.0) / 2.0, 0.5) AS consumption_s, coalesce(access_scaled, 0.5) AS access,
         coalesce(1 - {_SCALE.format(c='degree_days')}, 0.5) AS climate, coalesce({_SCALE.format(c='mobility_filled')}, 0.5) AS mobility
  FROM filled
),
scored AS (
  SELECT *, 0.35 * quality + 0.20 * market + 0.15 * consumption_s + 0.15 * access + 0.10 * climate + 0.05 * mobility AS score
  FROM components
),
ranked AS (
  SELECT *, round(score, 12) AS rank_score, rank() OVER (ORDER BY round(score, 12) DESC) AS index_rank FROM scored
)"""

_COMPONENTS = [("quality", "quality"), ("market", "market"), ("consumption", "consumption_s"), ("access", "access"), ("climate", "climate"), ("mobility", "mobility")]

INDEX_SELECT = f"""
  SELECT entity_id, entity_name, entity_type, region_name, is_zone, is_remote, is_special, is_suburb,
    {', '.join(f'{rnd(x, 4)} AS {c}_score' for c, x in _COMPONENTS)},
    {', '.join(f'{rnd(x + " * 100", 2)} AS {c}_score_100' for c, x in _COMPONENTS)},
    {rnd('score', 4)} AS index_score, {rnd('score * 100', 2)} AS index_score_100, {rnd('score * 10', 2)} AS index_10,
    CASE WHEN rank_score * 10 < 3.0 THEN '#d32f2f' WHEN rank_score * 10 < 4.5 THEN '#f57c00'
         WHEN rank_score * 10 < 6.5 THEN '#fbc02d' ELSE '#388e3c' END AS index_colour,
    CAST(index_rank AS BIGINT) AS index_rank,
    {', '.join(f'{rnd(c, 1)} AS {c}' for c in ('temp_mean', 'temp_winter', 'temp_summer', 'temp_amplitude'))},
    {rnd('degree_days', 4)} AS degree_days, {rnd('mobility_filled', 2)} AS mobility_km,
    CASE WHEN degree_days < 400 THEN 'Мягкий' WHEN degree_days < 500 THEN 'Холодный' WHEN degree_days < 600 THEN 'Очень холодный'
         WHEN degree_days < 700 THEN 'Арктический' ELSE 'Экстремальный' END AS climate_band,
    {rnd('(degree_days - 450.0) / 450.0 * 100.0', 0)} AS heating_over_baseline
  FROM ranked"""

INDEX = f"{SCORED}, index_view AS ({INDEX_SELECT})"
