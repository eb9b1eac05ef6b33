"""DuckDB SQL that computes, independently of Spark, what each registered query returns.

Views ``events customer nation orders documents conversations`` are the supplied
parquet tables. ``BASE`` maps them onto the application's tables exactly as the
Spark side does (see ``pathlens.sources.fixtures``).
"""

from __future__ import annotations

import re as _re

from .. import config

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

_TP_CASE = "case k % 6 " + " ".join(
    f"when {i} then '{tp}'" for i, tp in enumerate(config.TOUCHPOINTS[:-1])
) + f" else '{config.TOUCHPOINTS[-1]}' end"

INTERACTIONS = f"""
interactions as (
  select cast(event_id as varchar) interaction_id, user_id customer_id,
         {_TP_CASE} touchpoint,
         cast(ts as timestamp) "timestamp",
         cast(1 + k as bigint) session_duration_minutes,
         case when k % 6 < 2 then cast(1 + k % 15 as bigint) end pages_viewed,
         event_type action_taken,
         case when event_type = 'purchase' then value else 0.0 end revenue,
         case when event_id % 5 < 2 then concat('CAMP_', cast(event_id % 50 as varchar)) end campaign_id
  from (select *, cast(json_extract_string(props, '$.k') as int) k from events) e)"""

_CITY = "case n_nationkey " + " ".join(
    f"when {k} then '{name}'" for k, (name, *_) in enumerate(config.CITY_FACTS)) + " else n_name end"

CUSTOMERS = f"""
customers as (
  select c_custkey customer_id, c_name, {_CITY} city, c_mktsegment customer_segment,
         c_acctbal lifetime_value, f.registration_date
  from customer join nation on c_nationkey = n_nationkey
  left join (select o_custkey, cast(min(o_orderdate) as date) registration_date
             from orders group by o_custkey) f on c_custkey = o_custkey)"""

TOUCHPOINT_ANALYSIS = """
touchpoint_analysis as (
  select touchpoint, count(interaction_id) total_interactions,
         coalesce(sum(revenue), 0.0) total_revenue,
         avg(revenue) avg_revenue_per_interaction,
         avg(session_duration_minutes) avg_session_duration,
         count(distinct customer_id) unique_customers,
         coalesce(count(case when revenue > 0 then interaction_id end) * 100.0
                  / nullif(count(interaction_id), 0), 0.0) conversion_rate
  from interactions where touchpoint is not null group by touchpoint)"""

CUSTOMER_JOURNEYS = """
tp_tally as (
  select customer_id, touchpoint, count(*) n,
         min({'t': "timestamp", 'k': interaction_id}) seen
  from interactions where customer_id is not null and touchpoint is not null
  group by customer_id, touchpoint),
tp_json as (
  select customer_id, count(*) unique_touchpoints,
         '{' || string_agg('"' || touchpoint || '": ' || cast(n as varchar), ', '
                           order by n desc, seen) || '}' touchpoint_counts
  from tp_tally group by customer_id),
customer_journeys as (
  select j.customer_id, journey_path, total_interactions, total_revenue,
         journey_duration_days, first_touchpoint, last_touchpoint,
         coalesce(unique_touchpoints, 0) unique_touchpoints,
         coalesce(total_revenue > 0 and not isnan(total_revenue), false) conversion_occurred,
         coalesce(touchpoint_counts, '{}') touchpoint_counts
  from (select customer_id,
               string_agg(touchpoint, ' -> ' order by "timestamp", interaction_id) journey_path,
               count(*) total_interactions,
               sum(revenue) total_revenue,
               case when count(*) > 1 then cast(floor((epoch_us(max("timestamp"))
                    - epoch_us(min("timestamp"))) / 86400000000.0) as bigint) else 0 end
                 journey_duration_days,
               first(touchpoint order by "timestamp", interaction_id) first_touchpoint,
               first(touchpoint order by "timestamp" desc, interaction_id desc) last_touchpoint
        from interactions where customer_id is not null group by customer_id) j
  left join tp_json t on j.customer_id = t.customer_id)"""

CUSTOMER_BEHAVIOR = f"""
customer_behavior as (
  select customer_id, count(interaction_id) total_interactions,
         coalesce(sum(revenue), 0.0) total_revenue,
         count(distinct touchpoint) unique_touchpoints_used,
         avg(session_duration_minutes) avg_session_duration,
         min("timestamp") first_interaction, max("timestamp") last_interaction,
         cast(floor((epoch_us({AS_OF}) - epoch_us(max("timestamp"))) / 86400000000.0) as bigint)
           recency_days
  from interactions where customer_id is not null group by customer_id),
behavior_cuts as (
  select quantile_cont(total_interactions, [1.0/3, 2.0/3]) f,
         quantile_cont(total_revenue, [1.0/3, 2.0/3]) m,
         quantile_cont(recency_days, [1.0/3, 2.0/3]) r
  from customer_behavior),
scored_behavior as (
  select b.*,
    case when total_interactions <= f[1] then 'Low' when total_interactions <= f[2] then 'Medium'
         else 'High' end frequency_score,
    case when total_revenue <= m[1] then 'Low' when total_revenue <= m[2] then 'Medium'
         else 'High' end monetary_score,
    case when recency_days <= r[1] then 'Recent' when recency_days <= r[2] then 'Moderate'
         else 'Distant' end recency_score
  from customer_behavior b, behavior_cuts),
customer_segments as (
  select c.*, s.* exclude (customer_id)
  from customers c left join scored_behavior s on c.customer_id = s.customer_id)"""

_TP_COUNTS = ",\n".join(
    f"         count(case when touchpoint = '{tp}' then interaction_id end) daily_{tp}_interactions"
    for tp in config.TOUCHPOINTS)

TIME_SERIES = f"""
time_series_data as (
  select cast("timestamp" as date) date, count(interaction_id) daily_interactions,
         count(distinct customer_id) daily_unique_customers,
         coalesce(sum(revenue), 0.0) daily_revenue,
         avg(session_duration_minutes) avg_session_duration,
{_TP_COUNTS}
  from interactions where "timestamp" is not null group by 1)"""

BASE = ",".join([INTERACTIONS, CUSTOMERS, TOUCHPOINT_ANALYSIS, CUSTOMER_JOURNEYS,
                 CUSTOMER_BEHAVIOR, TIME_SERIES])


def with_base(select_sql: str, *extra_ctes: str) -> str:
    ctes = BASE + ("," + ",".join(extra_ctes) if extra_ctes else "")
    return f"with {ctes}\n{select_sql}"

_PH = _re.compile(r"\{(\w+)\}")


def render_sql(template: str, **exprs: str) -> str:
    """SQL concatenation filling ``{name}`` placeholders with SQL expressions."""
    parts, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        parts.append(f"coalesce(cast(({exprs[m.group(1)]}) as varchar), 'None')")
        pos = m.end()
    if pos < len(template):
        parts.append("'" + template[pos:].replace("'", "''") + "'")
    return " || ".join(parts)


def money(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def grouped_int(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def one_decimal(x: str) -> str:
    return f"format('{{:.1f}}', {x})"


def two_decimals(x: str) -> str:
    return f"format('{{:.2f}}', {x})"
