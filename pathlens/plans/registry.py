"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the supplied tables at ``sf_dir`` (through the fixture mapping)
and runs over them whole. Results keep full precision; rounding for display is
a parameter of the operators (``round_to``) and is left off here, so engines
are compared on exact values (H2).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as X
from ..functions import text as TX
from ..functions.columns import coerce_numeric
from ..operators import clean as CL
from ..operators import derive
from ..operators import enrich as EN
from ..operators import impact
from ..operators import insights as INS
from ..operators import realtime as rt
from ..operators import reports
from ..sources import factors as FA
from ..sources import fixtures as fx
from ..streaming import jobs as ST
from ..session import scratch_path, written
from ..sources import io
from . import incremental as INC
from . import oracle_sql as O
from .batch import build_warehouse
from .snapshot import snapshot

AS_OF = "2024-01-31 00:00:00"

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ----------------------------------------------------------------- derived ----

def _i(spark, sf):
    return fx.interactions(spark, sf)


@register("touchpoint_analysis", O.with_base("select * from touchpoint_analysis"))
def q_touchpoint_analysis(spark, sf):
    return derive.touchpoint_analysis(_i(spark, sf), round_to=None)


@register("customer_journeys", O.with_base("select * from customer_journeys"))
def q_customer_journeys(spark, sf):
    return derive.customer_journeys(_i(spark, sf))


@register("customer_behavior", O.with_base(
    "select * exclude (recency_days) from customer_behavior"))
def q_customer_behavior(spark, sf):
    return derive.customer_behavior(_i(spark, sf), round_to=None)


@register("customer_segments", O.with_base("select * from customer_segments"))
def q_customer_segments(spark, sf):
    return derive.customer_segments(fx.customers(spark, sf), _i(spark, sf), AS_OF, round_to=None)


@register("time_series", O.with_base("select * from time_series_data"))
def q_time_series(spark, sf):
    return derive.time_series(_i(spark, sf), round_to=None)


# ----------------------------------------------------------------- reports ----


def _segments(spark, sf):
    # the reports read no scores: the cut points are pruned, so nothing need run beforehand
    return derive.customer_segments(fx.customers(spark, sf), _i(spark, sf), AS_OF, round_to=None, checkpoint=False)


def _journeys(spark, sf):
    return derive.customer_journeys(_i(spark, sf))


def _analysis(spark, sf):
    return derive.touchpoint_analysis(_i(spark, sf), round_to=None)


def _series(spark, sf):
    return derive.time_series(_i(spark, sf), round_to=None)


register("segment_summary", O.with_base("""
select customer_segment, count(*) customer_count, avg(total_revenue) avg_revenue,
       avg(total_interactions) avg_interactions
from customer_segments group by customer_segment order by avg_revenue desc"""))(
    lambda spark, sf: reports.segment_summary(_segments(spark, sf)))

register("segment_counts", O.with_base("""
select customer_segment, count(*) "count", avg(total_revenue) avg_revenue
from customer_segments group by customer_segment order by avg_revenue desc"""))(
    lambda spark, sf: reports.segment_counts(_segments(spark, sf)))

register("overview_metrics", O.with_base("""
select count(distinct customer_id) total_customers, sum(total_revenue) total_revenue,
       cast(sum(total_interactions) as bigint) total_interactions,
       avg(total_revenue) avg_customer_value
from customer_segments"""))(lambda spark, sf: reports.overview_metrics(_segments(spark, sf)))

register("segment_stats", O.with_base("""
select customer_segment, count(total_revenue) customer_count, avg(total_revenue) avg_revenue,
       coalesce(sum(total_revenue), 0.0) total_revenue, avg(total_interactions) avg_interactions,
       avg(unique_touchpoints_used) avg_touchpoints
from customer_segments where customer_segment is not null group by customer_segment"""))(
    lambda spark, sf: reports.segment_stats(_segments(spark, sf)))

_SEG_STATS = """
seg_stats as (
  select customer_segment, count(total_revenue) customer_count, avg(total_revenue) avg_revenue,
         coalesce(sum(total_revenue), 0.0) total_revenue, avg(total_interactions) avg_interactions,
         avg(unique_touchpoints_used) avg_touchpoints
  from customer_segments where customer_segment is not null group by customer_segment)"""

register("best_segments", O.with_base("""
select * from (select 'best_segment' metric, * from seg_stats
               order by total_revenue desc, customer_segment limit 1)
union all
select * from (select 'most_customers' metric, * from seg_stats
               order by customer_count desc, customer_segment limit 1)""", _SEG_STATS))(
    lambda spark, sf: reports.best_segments(reports.segment_stats(_segments(spark, sf))))

register("journey_summary", O.with_base("""
select first_touchpoint, last_touchpoint, count(*) journey_count, avg(total_revenue) avg_revenue,
       avg(journey_duration_days) avg_duration
from customer_journeys group by first_touchpoint, last_touchpoint
order by journey_count desc, first_touchpoint, last_touchpoint limit 10"""))(
    lambda spark, sf: reports.journey_summary(_journeys(spark, sf)))

register("journey_stats", O.with_base("""
select avg(total_interactions) avg_length, avg(journey_duration_days) avg_duration,
       sum(cast(conversion_occurred as bigint)) * 100.0 / count(*) conversion_rate
from customer_journeys"""))(lambda spark, sf: reports.journey_stats(_journeys(spark, sf)))

for _col in ("first_touchpoint", "last_touchpoint"):
    register(f"top_{_col.split('_')[0]}_touchpoints", O.with_base(f"""
select {_col} touchpoint, count(*) customers from customer_journeys
where {_col} is not null group by {_col}
order by customers desc, min(customer_id) limit 3"""))(
        (lambda c: lambda spark, sf: reports.top_touchpoint_counts(_journeys(spark, sf), c))(_col))

register("high_value_journeys", O.with_base("""
select * from customer_journeys
where total_revenue > (select quantile_cont(total_revenue, 0.8) from customer_journeys)"""))(
    lambda spark, sf: reports.high_value_journeys(_journeys(spark, sf), revenue=derive.customer_revenue(_i(spark, sf))))

register("touchpoint_ranking", O.with_base("""
select touchpoint, total_revenue, conversion_rate from touchpoint_analysis
order by total_revenue desc"""))(lambda spark, sf: reports.touchpoint_ranking(_analysis(spark, sf)))

register("top_touchpoints", O.with_base("""
select touchpoint, total_interactions, total_revenue, conversion_rate from touchpoint_analysis
order by total_revenue desc, touchpoint limit 5"""))(
    lambda spark, sf: reports.top_touchpoints(_analysis(spark, sf)))

register("best_touchpoints", O.with_base("""
select * from (select 'best_revenue' metric, * from touchpoint_analysis
               order by total_revenue desc, touchpoint limit 1)
union all
select * from (select 'best_conversion' metric, * from touchpoint_analysis
               order by conversion_rate desc, touchpoint limit 1)
union all
select * from (select 'most_interactions' metric, * from touchpoint_analysis
               order by total_interactions desc, touchpoint limit 1)"""))(
    lambda spark, sf: reports.best_touchpoints(_analysis(spark, sf)))

register("revenue_trend", O.with_base("""
select sum(daily_revenue) total_revenue, avg(daily_revenue) avg_daily_revenue,
  (select date from time_series_data order by daily_revenue desc, date limit 1) peak_date,
  max(daily_revenue) peak_revenue,
  (select daily_interactions from time_series_data order by daily_revenue desc, date limit 1)
    peak_interactions,
  case when (select avg(daily_revenue) from (select daily_revenue from time_series_data
                                             order by date desc limit 5))
          > (select avg(daily_revenue) from (select daily_revenue from time_series_data
                                             order by date limit 5))
       then 'increasing' else 'decreasing' end trend
from time_series_data"""))(lambda spark, sf: reports.revenue_trend(_series(spark, sf)))

register("time_series_long", O.with_base("""
select date, regexp_replace(regexp_replace(col, '^daily_', ''), '_interactions$', '') touchpoint,
       cast(v as bigint) interactions
from (unpivot (select date, daily_interactions, """ + ", ".join(
    f"daily_{tp}_interactions" for tp in config.TOUCHPOINTS) + """
      from time_series_data) on columns(* exclude (date)) into name col value v)"""))(
    lambda spark, sf: derive.time_series_long(_series(spark, sf)))

register("table_counts", O.with_base("""
select (select count(*) from customers) customer_count,
       (select count(*) from interactions) interaction_count"""))(
    lambda spark, sf: reports.table_counts(fx.customers(spark, sf), _i(spark, sf)))


# ----------------------------------------------------------------- real time --
# Replay: the real-time table is the interactions with processing time = event time.

AS_OF_MID = "2024-01-15 12:00:00"


def _buffer(spark, sf):
    i = _i(spark, sf)
    return i.withColumn("processed_timestamp", F.col("timestamp"))


def _realtime(spark, sf, with_segment=False):
    return rt.to_realtime(_i(spark, sf), fx.customers(spark, sf) if with_segment else None,
                          processed_at=F.col("timestamp"))


_RT = """
realtime as (
  select i.interaction_id, i.customer_id, touchpoint, "timestamp", revenue, action_taken,
         coalesce(c.customer_segment, '') customer_segment, "timestamp" processed_timestamp
  from interactions i left join customers c on i.customer_id = c.customer_id)"""

register("realtime_interactions", O.with_base("select * from realtime", _RT))(
    lambda spark, sf: _realtime(spark, sf, with_segment=True))

for _suffix, _asof in (("", AS_OF), ("_mid", AS_OF_MID)):
    _lh = f"\"timestamp\" >= TIMESTAMP '{_asof}' - INTERVAL 1 HOUR and \"timestamp\" <= TIMESTAMP '{_asof}'"
    register(f"last_hour_summary{_suffix}", O.with_base(f"""
select count(*) interactions, sum(revenue) total_revenue,
       count(distinct customer_id) unique_customers, avg(revenue) avg_revenue
from interactions where {_lh}"""))(
        (lambda a: lambda spark, sf: rt.last_hour_summary(_realtime(spark, sf), a))(_asof))
    register(f"last_hour_touchpoints{_suffix}", O.with_base(f"""
select touchpoint, count(*) interactions, sum(revenue) revenue,
       count(distinct customer_id) unique_customers
from interactions where {_lh} group by touchpoint order by revenue desc"""))(
        (lambda a: lambda spark, sf: rt.last_hour_touchpoints(_realtime(spark, sf), a))(_asof))
    register(f"minute_trends{_suffix}", O.with_base(f"""
select date_trunc('minute', "timestamp") as "minute", count(*) interactions, sum(revenue) revenue
from interactions where {_lh} group by 1 order by 1"""))(
        (lambda a: lambda spark, sf: rt.minute_trends(_realtime(spark, sf), a))(_asof))

register("recent_minute_trends", O.with_base(f"""
select date_trunc('minute', "timestamp") as "minute", count(interaction_id) interactions,
       sum(revenue) revenue, count(distinct customer_id) unique_customers
from interactions where "timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE and "timestamp" <= TIMESTAMP '{AS_OF}' group by 1"""))(
    lambda spark, sf: rt.recent_minute_trends(_buffer(spark, sf), AS_OF))

register("recent_touchpoints", O.with_base(f"""
select touchpoint, count(interaction_id) interactions, sum(revenue) revenue,
       count(distinct customer_id) unique_customers
from interactions where "timestamp" > TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE and "timestamp" <= TIMESTAMP '{AS_OF}'
group by touchpoint"""))(lambda spark, sf: rt.recent_touchpoints(_buffer(spark, sf), AS_OF))

register("conversion_window", O.with_base(f"""
select count(*) interactions,
       count(case when revenue > 0 then 1 end) * 100.0 / nullif(count(*), 0) conversion_rate,
       avg(session_duration_minutes) avg_session_duration
from interactions where "timestamp" > TIMESTAMP '{AS_OF_MID}' - INTERVAL 5 MINUTE
  and "timestamp" <= TIMESTAMP '{AS_OF_MID}'"""))(
    lambda spark, sf: rt.conversion_window(_buffer(spark, sf), AS_OF_MID))

register("latest_interactions", O.with_base("""
select * from realtime order by processed_timestamp desc, interaction_id desc limit 20""", _RT))(
    lambda spark, sf: rt.latest_interactions(_realtime(spark, sf, with_segment=True)))


# ----------------------------------------------------------------- factors ----


# Word pieces common in the test corpus (the default keywords never occur in it).
PIECES_POSITIVE = ("thble", "ering", "oning")
PIECES_NEGATIVE = ("thing", "attion", "erble")


def _news(spark, sf):
    return FA.news_readings(fx.articles(spark, sf), PIECES_POSITIVE, PIECES_NEGATIVE)


def _tables(spark, sf):
    """The arguments of ``enrich``, read from the supplied tables."""
    return {"customers": fx.customers(spark, sf), "weather": fx.weather_readings(spark, sf),
            "market": fx.market_readings(spark, sf), "news": _news(spark, sf),
            "economic": fx.economic_readings(spark, sf), "facts": FA.city_facts(spark)}


def _enriched(spark, sf):
    return EN.enrich(_i(spark, sf), **_tables(spark, sf))


_START = f"TIMESTAMP '{fx.FACTOR_START}'"
_FACTOR_CTES = ["""
weather as (
  select city, cast(ts as timestamp) + to_seconds((event_id % 7 - 3) * 100) factor_time, value temperature, cast(40 + k % 41 as bigint) humidity,
         ['Clear', 'Clouds', 'Rain', 'Snow'][k % 4 + 1] weather_condition,
         lower(['Clear', 'Clouds', 'Rain', 'Snow'][k % 4 + 1]) weather_description,
         (k % 5) * cast(1.5 as double) wind_speed, cast(1000 + k % 21 as bigint) pressure,
         case when event_id % 7 <> 0 then cast(8 + k % 3 as double) end visibility
  from (select *, cast(json_extract_string(props, '$.k') as int) k from events) e
  join customers c on e.user_id = c.customer_id)""", f"""
order_days as (
  select cast(o_orderdate as date) d, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) cents, count(*) volume
  from orders group by 1),
order_steps as (
  select *, row_number() over (order by d) r, lag(cents) over (order by d) as before from order_days),
market as (
  select 'ORDERS' symbol, {_START} + (r - 1) * interval 15 minute factor_time,
         cents / cast(100 as double) price,
         coalesce((cents - before) / cast(100 as double), 0.0) change,
         coalesce((cents - before) * cast(100 as double) / before, 0.0) change_percent, volume,
         case when coalesce(cents - before, 0) > 0 then 'positive' else 'negative' end market_sentiment
  from order_steps)""", f"""
ship_days as (
  select cast(l_shipdate as date) d, count(*) n, sum(cast(round(l_tax * 100) as bigint)) tax,
         sum(cast(round(l_discount * 100) as bigint)) discount, sum(cast(l_quantity as bigint)) quantity,
         count(case when l_returnflag = 'R' then 1 end) returned, count(case when l_linestatus = 'F' then 1 end) finished
  from lineitem group by 1),
economic as (
  select {_START} + (row_number() over (order by d) - 1) * interval 20 minute factor_time,
         cast(tax as double) / n inflation_rate, cast(discount as double) / n unemployment_rate,
         cast(quantity as double) / n consumer_confidence, returned * cast(100 as double) / n gdp_growth,
         finished * cast(100 as double) / n interest_rate
  from ship_days)"""]


def _kw_sql(text, words):
    return " + ".join(f"cast(contains(lower({text}), '{w}') as integer)" for w in dict.fromkeys(words))


def _news_sql(name, query_expr, positive, negative, round_digits=2):
    score = f"round_even(avg(s), {round_digits})" if round_digits is not None else "avg(s)"
    return f"""
{name} as (
  select query, {score} sentiment_score,
         case when avg(s) > 0 then 'positive' when avg(s) < 0 then 'negative' else 'neutral' end
           sentiment_label,
         count(*) articles_analyzed
  from (select {query_expr} query,
               cast(sign(({_kw_sql('text', positive)}) - ({_kw_sql('text', negative)})) as integer) s
        from documents where lang = 'en') a
  group by query)"""


_NEWS_DAYS = f"""
news_days as (
  select cast(query as timestamp) + interval 1 day factor_time, round_even(avg(s), 2) sentiment_score,
         case when avg(s) > 0 then 'positive' when avg(s) < 0 then 'negative' else 'neutral' end sentiment_label,
         count(*) articles_analyzed
  from (select cast({_START} + ((doc_id * 2609) % 43200) * interval 1 minute as date) query,
               cast(sign(({_kw_sql('text', PIECES_POSITIVE)}) - ({_kw_sql('text', PIECES_NEGATIVE)})) as integer) s
        from documents where lang = 'en') a
  group by query)"""

_CITY_FACTS = "city_facts as (select * from (values " + ", ".join(
    f"('{c}', {p}, {m})" for c, p, m, _ in config.CITY_FACTS) + ") t(city, population, median_income))"

_EV_CITY = f"""
ev_city as (
  select i.*, coalesce(c.city, '{config.DEFAULT_CITY}') city
  from interactions i left join customers c on i.customer_id = c.customer_id)"""

_T = config.FACTOR_TOLERANCE_SECONDS
_ENRICHED = f"""
enriched as (
  select e.*,
    case when e."timestamp" - w.factor_time <= interval {_T} second then w.temperature end
      weather_temperature,
    case when e."timestamp" - w.factor_time <= interval {_T} second then w.weather_condition end
      weather_condition,
    case when e."timestamp" - w.factor_time <= interval {_T} second then w.humidity end
      weather_humidity,
    case when e."timestamp" - m.factor_time <= interval {_T} second then m.market_sentiment end
      market_sentiment,
    case when e."timestamp" - m.factor_time <= interval {_T} second then m.change_percent end
      market_change_percent,
    case when e."timestamp" - n.factor_time <= interval {EN.NEWS_TOLERANCE_SECONDS} second then n.sentiment_label end
      news_sentiment,
    case when e."timestamp" - n.factor_time <= interval {EN.NEWS_TOLERANCE_SECONDS} second then n.sentiment_score end
      news_sentiment_score,
    case when e."timestamp" - x.factor_time <= interval 3600 second then x.inflation_rate end
      inflation_rate,
    case when e."timestamp" - x.factor_time <= interval 3600 second then x.consumer_confidence end
      consumer_confidence,
    cast(coalesce(f.population, {config.CITY_DEFAULT[0]}) as bigint) city_population,
    cast(coalesce(f.median_income, {config.CITY_DEFAULT[1]}) as bigint) city_median_income
  from ev_city e
  asof left join weather w on e.city = w.city and e."timestamp" >= w.factor_time
  asof left join market m on e."timestamp" >= m.factor_time
  asof left join news_days n on e."timestamp" >= n.factor_time
  asof left join economic x on e."timestamp" >= x.factor_time
  left join city_facts f on e.city = f.city)"""

_ENRICH_CTES = (*_FACTOR_CTES, _NEWS_DAYS, _CITY_FACTS, _EV_CITY, _ENRICHED)

register("enrich_weather", O.with_base(f"""
select e.*,
  case when e."timestamp" - w.factor_time <= interval {_T} second then w.temperature end
    weather_temperature,
  case when e."timestamp" - w.factor_time <= interval {_T} second then w.weather_condition end
    weather_condition,
  case when e."timestamp" - w.factor_time <= interval {_T} second then w.humidity end
    weather_humidity
from ev_city e asof left join weather w on e.city = w.city and e."timestamp" >= w.factor_time""",
    *_FACTOR_CTES, _EV_CITY))(
    lambda spark, sf: EN.enrich_weather(EN.with_city(_i(spark, sf), fx.customers(spark, sf)),
                                        fx.weather_readings(spark, sf)))

register("enrich_market", O.with_base(f"""
select e.*,
  case when e."timestamp" - m.factor_time <= interval {_T} second then m.market_sentiment end
    market_sentiment,
  case when e."timestamp" - m.factor_time <= interval {_T} second then m.change_percent end
    market_change_percent
from interactions e asof left join market m on e."timestamp" >= m.factor_time""", *_FACTOR_CTES))(
    lambda spark, sf: EN.enrich_market(_i(spark, sf), fx.market_readings(spark, sf)))

register("enrich_economic", O.with_base("""
select e.*,
  case when e."timestamp" - x.factor_time <= interval 3600 second then x.inflation_rate end
    inflation_rate,
  case when e."timestamp" - x.factor_time <= interval 3600 second then x.consumer_confidence end
    consumer_confidence
from interactions e asof left join economic x on e."timestamp" >= x.factor_time""",
    *_FACTOR_CTES))(lambda spark, sf: EN.enrich_economic(_i(spark, sf), fx.economic_readings(spark, sf)))

register("enrich_news", O.with_base(f"""
select e.*,
  case when e."timestamp" - n.factor_time <= interval {EN.NEWS_TOLERANCE_SECONDS} second then n.sentiment_label end
    news_sentiment,
  case when e."timestamp" - n.factor_time <= interval {EN.NEWS_TOLERANCE_SECONDS} second then n.sentiment_score end
    news_sentiment_score
from interactions e asof left join news_days n on e."timestamp" >= n.factor_time""", _NEWS_DAYS))(
    lambda spark, sf: EN.enrich_news(_i(spark, sf), _news(spark, sf)))

register("enrich_geo", O.with_base(f"""
select e.*, cast(coalesce(f.population, {config.CITY_DEFAULT[0]}) as bigint) city_population,
       cast(coalesce(f.median_income, {config.CITY_DEFAULT[1]}) as bigint) city_median_income
from ev_city e left join city_facts f on e.city = f.city""", _CITY_FACTS, _EV_CITY))(
    lambda spark, sf: EN.enrich_geo(EN.with_city(_i(spark, sf), fx.customers(spark, sf)),
                                    FA.city_facts(spark)))

register("enrich", O.with_base("select * from enriched", *_ENRICH_CTES))(_enriched)

register("news_sentiment", O.with_base("select * from news", _news_sql(
    "news", "source", config.POSITIVE_KEYWORDS, config.NEGATIVE_KEYWORDS, None)))(
    lambda spark, sf: FA.news_sentiment(fx.english_documents(spark, sf), round_to=None))

register("news_sentiment_pieces", O.with_base("select * from news", _news_sql(
    "news", "source", PIECES_POSITIVE, PIECES_NEGATIVE, None)))(
    lambda spark, sf: FA.news_sentiment(fx.english_documents(spark, sf), PIECES_POSITIVE,
                                        PIECES_NEGATIVE, round_to=None))

# ----------------------------------------------------------------- impact -----

register("weather_impact", O.with_base("""
select coalesce(weather_condition, 'Unknown') weather_condition, sum(revenue) total_revenue,
       count(*) interaction_count, sum(revenue) / count(*) avg_revenue
from enriched group by 1""", *_ENRICH_CTES))(
    lambda spark, sf: impact.weather_impact(_enriched(spark, sf)))

register("best_weather", O.with_base("""
select coalesce(max(c), 'Unknown') best_condition, coalesce(max(a), 0.0) best_avg_revenue from (
  select c, round_even(avg_rev, 2) a from (
    select coalesce(weather_condition, 'Unknown') c, sum(revenue) / count(*) avg_rev,
           min({'t': "timestamp", 'k': interaction_id}) seen
    from enriched group by 1) order by round_even(avg_rev, 2) desc, seen limit 1)""",
    *_ENRICH_CTES))(lambda spark, sf: impact.best_weather(_enriched(spark, sf)))

register("market_score", O.with_base("""
select count(*) matches, count(*) * cast(0.1 as double) correlation_score,
       case when count(*) > 50 then 'Strong positive correlation'
            when count(*) > 20 then 'Moderate correlation' else 'Weak correlation' end
         interpretation
from enriched where (market_sentiment = 'positive' and revenue > 0)
                 or (market_sentiment = 'negative' and revenue = 0)""", *_ENRICH_CTES))(
    lambda spark, sf: impact.market_score(_enriched(spark, sf)))

register("sentiment_impact", O.with_base("""
select coalesce(news_sentiment, 'neutral') sentiment, count(*) "count", avg(revenue) avg_revenue,
       count(case when revenue > 0 then 1 end) * cast(100 as double) / count(*) conversion_rate
from enriched group by 1""", *_ENRICH_CTES))(
    lambda spark, sf: impact.sentiment_impact(_enriched(spark, sf)))

register("conversion_by_market", O.with_base("""
select market_sentiment, avg(cast(revenue > 0 as double)) * 100 conversion_rate
from enriched where market_sentiment is not null group by 1""", *_ENRICH_CTES))(
    lambda spark, sf: impact.conversion_by_market(_enriched(spark, sf)))

register("revenue_temperature_ols", O.with_base("""
select weather_condition, count(*) n, regr_slope(revenue, weather_temperature) slope,
       regr_intercept(revenue, weather_temperature) intercept,
       regr_r2(revenue, weather_temperature) r2
from enriched where weather_condition is not null and weather_temperature is not null
  and revenue is not null group by 1""", *_ENRICH_CTES))(
    lambda spark, sf: impact.revenue_temperature_ols(_enriched(spark, sf)))


# ----------------------------------------------------------------- text -------


def _weather_payloads(spark, sf):
    """Stored answers of a provider, as text: at one hour of the day an error in place of JSON, at
    another one without the station's list of conditions."""
    answers = FA.weather_payloads(fx.weather_readings(spark, sf))
    hour = F.hour("factor_time")
    text = (F.when(hour == 3, F.lit("503 Service Unavailable"))
            .when(hour == 5, F.regexp_replace("payload", r'"weather":\[[^\]]*\]', '"weather":[]')).otherwise(F.col("payload")))
    return written(answers.select("city", "factor_time", text.alias("payload")), "payloads")


_ANSWERED = lambda c, at="3": f"case when hour(factor_time) not in ({at}) then {c} end {c}"
register("parse_weather", O.with_base(f"""
select city, factor_time, {_ANSWERED('temperature')}, {_ANSWERED('humidity')}, {_ANSWERED('weather_condition', '3, 5')},
       {_ANSWERED('weather_description', '3, 5')}, {_ANSWERED('wind_speed')}, {_ANSWERED('pressure')},
       case when hour(factor_time) = 3 then 0.0 else coalesce(visibility, 0.0) end visibility from weather""", *_FACTOR_CTES))(
    lambda spark, sf: _weather_payloads(spark, sf).select(
        "city", "factor_time", TX.parse_weather(F.col("payload")).alias("w")).select(
        "city", "factor_time", "w.*"))

# at one hour of the day the provider answers without a quote
register("parse_quote", O.with_base("""
select symbol, factor_time, case when hour(factor_time) = 3 then 0.0 else price end price,
       case when hour(factor_time) = 3 then 0.0 else change end change,
       case when hour(factor_time) = 3 then 0.0 else change_percent end change_percent,
       case when hour(factor_time) = 3 then 0 else volume end volume,
       case when hour(factor_time) = 3 then 'negative' else market_sentiment end market_sentiment
from market""", *_FACTOR_CTES))(
    lambda spark, sf: FA.quote_payloads(fx.market_readings(spark, sf)).select(
        "symbol", "factor_time", TX.parse_quote(F.when(F.hour("factor_time") == 3, F.lit("{}"))
                                                .otherwise(F.col("payload"))).alias("q")).select(
        "symbol", "factor_time", "q.*"))

register("market_advice", O.with_base(f"""
select symbol, factor_time, change_percent,
       case when change_percent > 0 then '{config.ADVICE_UP}' else '{config.ADVICE_DOWN}' end
         market_direction,
       case when change_percent > {config.ADVICE_PREMIUM_ABOVE} then '{config.ADVICE_PREMIUM}'
            when change_percent < {config.ADVICE_VALUE_BELOW} then '{config.ADVICE_VALUE}' end
         market_advice
from market""", *_FACTOR_CTES))(
    lambda spark, sf: fx.market_readings(spark, sf).select(
        "symbol", "factor_time", "change_percent",
        X.market_direction("change_percent").alias("market_direction"),
        X.market_advice("change_percent").alias("market_advice")))


# Word pieces of the test corpus, which hardly has the default keywords.
CORPUS_TOPICS = (
    ("touchpoint_performance", ("thing", "erre")),
    ("customer_segments", ("hahe", "anti")),
    ("journey_patterns", ("onre", "que")),
    ("revenue_trends", ("thes", "sch")),
    ("recommendations", ("that", "was")),
)


def _route_sql(col, topics=config.QUESTION_TOPICS):
    cases = " ".join(
        "when " + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + f" then '{t}'"
        for t, words in topics)
    return f"case {cases} else '{config.DEFAULT_TOPIC}' end"


_QUESTIONS = """
questions as (select conv_id, turn, text question from conversations where role = 'user')"""

register("route_questions", O.with_base(f"""
select conv_id, turn, question, {_route_sql('question')} topic from questions""", _QUESTIONS))(
    lambda spark, sf: INS.route_questions(fx.user_questions(spark, sf)))

register("route_questions_corpus", O.with_base(f"""
select conv_id, turn, question, {_route_sql('question', CORPUS_TOPICS)} topic from questions""", _QUESTIONS))(
    lambda spark, sf: INS.route_questions(fx.user_questions(spark, sf), topics=CORPUS_TOPICS))

_INSIGHT_TP = f"""
ins_tp as (
  select 'touchpoint_performance' topic, coalesce(max({O.render_sql(
      config.INSIGHT_TOUCHPOINTS,
      best_touchpoint="r.touchpoint", best_revenue=O.money("r.total_revenue"),
      best_interactions=O.grouped_int("r.total_interactions"),
      best_rate=O.one_decimal("r.conversion_rate"), conv_touchpoint="c.touchpoint",
      conv_rate=O.one_decimal("c.conversion_rate"),
      conv_avg_revenue=O.two_decimals("coalesce(c.avg_revenue_per_interaction, 0.0)"))}),
      '{config.NO_DATA["touchpoint_performance"]}') answer
  from (select * from touchpoint_analysis order by total_revenue desc, touchpoint limit 1) r,
       (select * from touchpoint_analysis order by conversion_rate desc, touchpoint limit 1) c)"""

_INSIGHT_SEG = f"""
ins_seg as (
  select 'customer_segments' topic, coalesce(max({O.render_sql(
      config.INSIGHT_SEGMENTS, segment="customer_segment",
      total_revenue=O.money("total_revenue"), customer_count=O.grouped_int("customer_count"),
      avg_revenue=O.money("avg_revenue"),
      avg_interactions="format('{:,.1f}', avg_interactions)")}),
      '{config.NO_DATA["customer_segments"]}') answer
  from (select * from seg_stats where total_revenue is not null
        order by total_revenue desc, customer_segment limit 1))"""

_INSIGHT_JOUR = f"""
ins_jour as (
  select 'journey_patterns' topic, coalesce(max({O.render_sql(
      config.INSIGHT_JOURNEYS, avg_length=O.one_decimal("avg_length"),
      avg_duration=O.one_decimal("avg_duration"),
      conversion_rate=O.one_decimal("conversion_rate"),
      top_first="coalesce(f.touchpoint, 'Unknown')",
      top_first_count="coalesce(cast(f.customers as varchar), '0')",
      top_last="coalesce(l.touchpoint, 'Unknown')",
      top_last_count="coalesce(cast(l.customers as varchar), '0')")}),
      '{config.NO_DATA["journey_patterns"]}') answer
  from (select avg(total_interactions) avg_length, avg(journey_duration_days) avg_duration,
               sum(cast(conversion_occurred as bigint)) * 100.0 / count(*) conversion_rate
        from customer_journeys) s
  left join (select first_touchpoint touchpoint, count(*) customers from customer_journeys
             group by 1 order by 2 desc, min(customer_id) limit 1) f on true
  left join (select last_touchpoint touchpoint, count(*) customers from customer_journeys
             group by 1 order by 2 desc, min(customer_id) limit 1) l on true
  where avg_length is not null)"""

_INSIGHT_TREND = f"""
trend as (
  select sum(daily_revenue) total_revenue, avg(daily_revenue) avg_daily_revenue,
    (select date from time_series_data order by daily_revenue desc, date limit 1) peak_date,
    max(daily_revenue) peak_revenue,
    (select daily_interactions from time_series_data order by daily_revenue desc, date limit 1)
      peak_interactions,
    case when (select avg(daily_revenue) from (select daily_revenue from time_series_data
                                               order by date desc limit 5))
            > (select avg(daily_revenue) from (select daily_revenue from time_series_data
                                               order by date limit 5))
         then 'increasing' else 'decreasing' end trend
  from time_series_data),
ins_trend as (
  select 'revenue_trends' topic, coalesce(max({O.render_sql(
      config.INSIGHT_TRENDS, total_revenue=O.money("total_revenue"),
      avg_daily_revenue=O.money("avg_daily_revenue"),
      trend_title="upper(substr(trend, 1, 1)) || substr(trend, 2)", trend="trend",
      peak_date="strftime(peak_date, '%Y-%m-%d')", peak_revenue=O.money("peak_revenue"),
      peak_interactions=O.grouped_int("peak_interactions"))}),
      '{config.NO_DATA["revenue_trends"]}') answer
  from trend where peak_date is not null)"""

_REC = config.INSIGHT_RECOMMENDATIONS.replace("'", "''")
_INSIGHTS = f"""
insights as (
  select * from ins_tp union all select * from ins_seg union all select * from ins_jour
  union all select * from ins_trend union all select 'recommendations', '{_REC}'
  union all select '{config.DEFAULT_TOPIC}',
    (select answer from ins_tp) || '{config.COMPREHENSIVE_SEPARATOR}' || (select answer from ins_seg)
    || '{config.COMPREHENSIVE_SEPARATOR}' || (select answer from ins_jour))"""

_INSIGHT_CTES = (_SEG_STATS, _INSIGHT_TP, _INSIGHT_SEG, _INSIGHT_JOUR, _INSIGHT_TREND, _INSIGHTS)


def _insights(spark, sf):
    return INS.insight_table(_analysis(spark, sf), reports.segment_stats(_segments(spark, sf)),
                             _journeys(spark, sf), _series(spark, sf))


register("insight_touchpoints", O.with_base("select * from ins_tp", *_INSIGHT_CTES))(
    lambda spark, sf: INS.insight_touchpoints(_analysis(spark, sf)))
register("insight_segments", O.with_base("select * from ins_seg", *_INSIGHT_CTES))(
    lambda spark, sf: INS.insight_segments(reports.segment_stats(_segments(spark, sf))))
register("insight_journeys", O.with_base("select * from ins_jour", *_INSIGHT_CTES))(
    lambda spark, sf: INS.insight_journeys(_journeys(spark, sf)))
register("insight_trends", O.with_base("select * from ins_trend", *_INSIGHT_CTES))(
    lambda spark, sf: INS.insight_trends(_series(spark, sf)))
register("insights", O.with_base("select * from insights", *_INSIGHT_CTES))(_insights)
register("answer_questions", O.with_base(f"""
select q.topic, q.conv_id, q.turn, q.question, i.answer, true success
from (select conv_id, turn, question, {_route_sql('question', CORPUS_TOPICS)} topic from questions) q
left join insights i on q.topic = i.topic""", _QUESTIONS, *_INSIGHT_CTES))(
    lambda spark, sf: INS.answer_questions(fx.user_questions(spark, sf), _insights(spark, sf),
                                               topics=CORPUS_TOPICS))


# ----------------------------------------------------------------- cleaning ---


def _as_text(df, cols=None):
    return df.select(*[F.col(c).cast("string").alias(c) if cols is None or c in cols else F.col(c)
                       for c in df.columns])


def _raw_interactions(spark, sf):
    """Interactions as raw text with faults by a rule on the id."""
    n = F.col("interaction_id").cast("long")
    text = lambda c: F.col(c).cast("string")
    return _i(spark, sf).withColumns({
        "session_duration_minutes": F.when(n % 10 == 0, "abc").when(n % 10 == 1, "")
            .when(n % 10 == 2, F.concat(text("session_duration_minutes"), F.lit(".9"))).otherwise(text("session_duration_minutes")),
        "pages_viewed": F.when(n % 7 == 0, "n/a").otherwise(text("pages_viewed")),
        "revenue": F.when(n % 11 == 0, "bad").when(n % 13 == 0, "NaN").otherwise(text("revenue")),
        "timestamp": F.when(n % 17 == 0, "not a time").otherwise(text("timestamp")),
        "device_type": F.when(n % 3 != 0, "mobile"), "referrer_source": F.when(n % 5 == 0, "search")})


register("clean_interactions", O.with_base("""
select interaction_id, customer_id, touchpoint,
       case when n % 17 <> 0 then "timestamp" end "timestamp",
       case when n % 10 < 2 then 0 else session_duration_minutes end session_duration_minutes,
       case when n % 7 = 0 then 0 else coalesce(pages_viewed, 0) end pages_viewed, action_taken,
       case when n % 11 = 0 or n % 13 = 0 then 0.0 else revenue end revenue,
       coalesce(campaign_id, '') campaign_id,
       case when n % 3 <> 0 then 'mobile' else '' end device_type,
       case when n % 5 = 0 then 'search' else '' end referrer_source
from (select *, cast(interaction_id as bigint) n from interactions) i"""))(
    lambda spark, sf: CL.clean_interactions(_raw_interactions(spark, sf)))


def _raw_customers(spark, sf):
    n = F.col("customer_id")
    return fx.customers(spark, sf).withColumns({
        "age": F.when(n % 5 == 0, "x").when(n % 5 == 1, "41.7").otherwise((F.lit(20) + n % 60).cast("string")),
        "phone": F.when(n % 4 != 0, F.concat(F.lit("555-"), n.cast("string"))),
        "state": F.when(n % 3 == 0, "NY"), "country": F.when(n % 2 == 0, "US"),
        "city": F.when(n % 6 != 0, F.col("city")),
        "lifetime_value": F.when(n % 9 == 0, "bad").otherwise(F.col("lifetime_value").cast("string")),
        "registration_date": F.when(n % 8 == 0, "never").otherwise(F.col("registration_date").cast("string"))})


register("clean_customers", O.with_base("""
select customer_id, c_name, case when customer_id % 6 <> 0 then city else '' end city, customer_segment,
       case when customer_id % 9 = 0 then 0.0 else lifetime_value end lifetime_value,
       case when customer_id % 8 <> 0 then registration_date end registration_date,
       cast(case customer_id % 5 when 0 then 0 when 1 then 41 else 20 + customer_id % 60 end as bigint) age,
       case when customer_id % 4 <> 0 then '555-' || customer_id else '' end phone,
       case when customer_id % 3 = 0 then 'NY' else '' end state,
       case when customer_id % 2 = 0 then 'US' else '' end country
from customers"""))(
    lambda spark, sf: CL.clean_customers(_raw_customers(spark, sf)))

register("coerce_touchpoint_analysis", O.with_base("select * from touchpoint_analysis"))(
    lambda spark, sf: coerce_numeric(_as_text(_analysis(spark, sf))))

register("coerce_time_series", O.with_base("select * from time_series_data"))(
    lambda spark, sf: coerce_numeric(_as_text(_series(spark, sf))))


# ----------------------------------------------------------------- streaming --


def _stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from ..session import SESSION_DEFAULTS
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, SESSION_DEFAULTS[key])
    return ST.read_interactions_stream(spark, sf, file_glob="events.parquet")


def _minutes(spark, sf):
    return ST.run_minutes(_stream(spark, sf))


_TP_STREAM = ", ".join(f"count(case when touchpoint = '{tp}' then 1 end) {tp}_interactions"
                       for tp in config.TOUCHPOINTS)

register("stream_daily_totals", O.with_base(f"""
select date_trunc('day', "timestamp") window_start,
       date_trunc('day', "timestamp") + interval 1 day window_end,
       count(*) interactions, sum(revenue) revenue, count(distinct customer_id) active_customers, {_TP_STREAM}
from interactions group by 1, 2"""))(lambda spark, sf: ST.daily_totals(_minutes(spark, sf)))

_SLIDE = """
slid as (
  select i.*, date_trunc('minute', "timestamp") - k * interval 1 minute window_start
  from interactions i, (select unnest(generate_series(0, {last})) k) ks)"""

register("stream_conversion_window", O.with_base("""
select window_start, window_start + interval 5 minute window_end, count(*) interactions,
       count(case when revenue > 0 then 1 end) * 100.0 / count(*) conversion_rate,
       avg(session_duration_minutes) avg_session_duration
from slid group by 1, 2""", _SLIDE.format(last=4)))(lambda spark, sf: ST.conversion_windows(_minutes(spark, sf)))

register("stream_minute_trends", O.with_base("""
select date_trunc('minute', "timestamp") window_start,
       date_trunc('minute', "timestamp") + interval 1 minute window_end,
       count(*) interactions, sum(revenue) revenue, count(distinct customer_id) unique_customers
from interactions group by 1, 2"""))(lambda spark, sf: ST.minute_totals(_minutes(spark, sf)))

register("stream_touchpoints", O.with_base("""
select window_start, window_start + interval 30 minute window_end, touchpoint,
       count(*) interactions, sum(revenue) revenue, count(distinct customer_id) unique_customers
from slid group by 1, 2, 3""", _SLIDE.format(last=29)))(lambda spark, sf: ST.touchpoint_windows(_minutes(spark, sf)))

register("stream_active_customers", O.with_base("""
select date_trunc('day', "timestamp") window_start,
       date_trunc('day', "timestamp") + interval 1 day window_end,
       count(distinct customer_id) active_customers, count(*) interactions
from interactions group by 1, 2"""))(lambda spark, sf: ST.active_customers(_minutes(spark, sf)))


def _run_enriched(spark, sf):
    return ST.run_enriched(_stream(spark, sf), lambda: _tables(spark, sf))


register("stream_enrich", O.with_base("select * from enriched", *_ENRICH_CTES))(
    lambda spark, sf: ST.enriched_table(spark, _run_enriched(spark, sf)[0]))


# ----------------------------------------------------------------- H5 ---------

def _running_sql(source, label_expr):
    """The rule itself, row by row: at the k-th row the rate becomes ((k-1) r + 1) / k if it converts."""
    return f"""
rr as (
  select {label_expr} label, count(*) n, count(case when revenue > 0 then 1 end) conversions,
         list(case when coalesce(revenue > 0, false) then cast(1 as double) else cast(0 as double) end
              order by "timestamp", interaction_id) flags
  from {source} group by 1)"""


_RR_SELECT = """
select label sentiment, n "count", conversions,
       list_reduce(list_concat([cast(0 as double)], flags),
                   lambda r, x, i: case when x = 1 then (r * (i - 2) + 1) / (i - 1) else r end) running_rate
from rr"""

register("sentiment_running_rate", O.with_base(
    _RR_SELECT, *_ENRICH_CTES, _running_sql("enriched", "coalesce(news_sentiment, 'neutral')")))(
    lambda spark, sf: impact.running_conversion_rate(_enriched(spark, sf)))

register("touchpoint_running_rate", O.with_base(
    _RR_SELECT, _running_sql("interactions", "coalesce(touchpoint, 'neutral')")))(
    lambda spark, sf: impact.running_conversion_rate(_i(spark, sf), label="touchpoint"))

register("enriched_recent", O.with_base("""
select interaction_id, touchpoint, revenue, weather_condition, weather_temperature,
       market_sentiment, news_sentiment
from enriched order by "timestamp" desc, interaction_id desc limit 10""", *_ENRICH_CTES))(
    lambda spark, sf: rt.recent_enriched(_i(spark, sf), lambda e: EN.enrich(e, **_tables(spark, sf))))


# ----------------------------------------------------------------- T6 ---------

def _stream_impact(metric):
    return lambda spark, sf: ST.factor_impact(spark, _run_enriched(spark, sf)[1])[metric]


for _metric in ("weather_impact", "sentiment_impact", "market_score"):
    register(f"stream_{_metric}", ORACLES[_metric])(_stream_impact(_metric))

_SUMMARY_PARTS = " || ".join(
    f"(select answer from insights where topic = '{t}') || '\n\n'" for t in config.SUMMARY_TOPICS)
register("insights_summary", O.with_base(
    f"select '{config.SUMMARY_HEADER}' || {_SUMMARY_PARTS} summary", *_INSIGHT_CTES))(
    lambda spark, sf: INS.insights_summary(_insights(spark, sf)))

register("journey_segments", O.with_base("""
select customer_id, make_timestamp(cast(floor(epoch_us("timestamp") / 3600000000.0) as bigint)
                                   * 3600000000) segment_start,
       string_agg(touchpoint, ' -> ' order by "timestamp", interaction_id) segment_path,
       count(*) interactions, sum(revenue) revenue,
       first(touchpoint order by "timestamp", interaction_id) first_touchpoint,
       first(touchpoint order by "timestamp" desc, interaction_id desc) last_touchpoint
from interactions where customer_id is not null group by 1, 2"""))(
    lambda spark, sf: derive.journey_segments(_i(spark, sf)))


# ----------------------------------------------------------------- warehouse --
# The supplied tables go out as raw CSV files and come back through the batch job.

def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _raw_csv(spark, sf):
    raw = _folder(spark, "raw")
    for name, df in (("customers", fx.customers(spark, sf)), ("interactions", _i(spark, sf))):
        io.write_csv(df, f"{raw}/{name}.csv")
    return raw


def _processed_csv(spark, sf):
    out = _folder(spark, "processed")
    for name, make in (("customer_journeys", _journeys), ("touchpoint_analysis", _analysis),
                       ("customer_segments", _segments), ("time_series_data", _series)):
        io.write_csv(make(spark, sf), f"{out}/{name}.csv")
    return out


def _loaded(name):
    def run(spark, sf):
        target = _folder(spark, "loaded")
        base = name in ("customers", "interactions")
        raw, processed = (_raw_csv(spark, sf), f"{target}/none") if base else (f"{target}/none", _processed_csv(spark, sf))
        loaded = io.load_all(spark, raw, processed, target=target, rejects=f"{target}/rejects")
        assert name in loaded and io.rejected_counts(spark, f"{target}/rejects").isEmpty()
        return io.read_derived(spark, target, name)
    return run


_LOADED_CUSTOMERS = """
select cast(customer_id as varchar) customer_id, city, registration_date, customer_segment, lifetime_value"""
register("load_all_customers", O.with_base(_LOADED_CUSTOMERS + " from customers"))(_loaded("customers"))
_LOADED_INTERACTIONS = """
select interaction_id, cast(customer_id as varchar) customer_id, touchpoint, "timestamp", session_duration_minutes,
       pages_viewed, action_taken, revenue, campaign_id"""
register("load_all_interactions", O.with_base(_LOADED_INTERACTIONS + " from interactions"))(_loaded("interactions"))
register("load_all_journeys", O.with_base(
    "select * replace (cast(customer_id as varchar) as customer_id) from customer_journeys"))(_loaded("customer_journeys"))
register("load_all_touchpoint_analysis", O.with_base("select * from touchpoint_analysis"))(_loaded("touchpoint_analysis"))
register("load_all_time_series", O.with_base("select * from time_series_data"))(_loaded("time_series_data"))
register("load_all_segments", O.with_base(
    _LOADED_CUSTOMERS + """, total_interactions, total_revenue, unique_touchpoints_used, avg_session_duration,
       first_interaction, last_interaction, recency_days, frequency_score, monetary_score, recency_score
from customer_segments"""))(_loaded("customer_segments"))


def _derived_csv(spark, sf):
    """A derived table kept as CSV."""
    base = _folder(spark, "derived")
    io.write_csv(_journeys(spark, sf), f"{base}/customer_journeys")
    return io.read_derived(spark, base, "customer_journeys", fmt="csv")


register("read_derived_journeys", O.with_base(
    "select * replace (cast(customer_id as varchar) as customer_id) from customer_journeys"))(_derived_csv)


register("read_raw_interactions", O.with_base(_LOADED_INTERACTIONS + " from interactions"))(
    lambda spark, sf: io.read_raw(spark, _raw_csv(spark, sf))[1])


def _warehouse(name):
    def run(spark, sf):
        out = _folder(spark, "warehouse")
        build_warehouse(spark, _raw_csv(spark, sf), out, AS_OF, round_to=None, only=[name])
        return io.read_derived(spark, out, name)
    return run


register("warehouse_customer_journeys", O.with_base(
    "select * replace (cast(customer_id as varchar) as customer_id) from customer_journeys"))(_warehouse("customer_journeys"))
register("warehouse_touchpoint_analysis", O.with_base("select * from touchpoint_analysis"))(_warehouse("touchpoint_analysis"))
register("warehouse_time_series", O.with_base("select * from time_series_data"))(_warehouse("time_series_data"))
register("warehouse_customer_segments", O.with_base(
    _LOADED_CUSTOMERS + """, total_interactions, total_revenue, unique_touchpoints_used, avg_session_duration,
       first_interaction, last_interaction, recency_days, frequency_score, monetary_score, recency_score
from customer_segments"""))(_warehouse("customer_segments"))


def _created(spark, sf):
    """Fixed-schema tables made in a database, one filled by an append."""
    database = f"pathlens_{uuid.uuid4().hex[:8]}"
    io.create_tables(spark, database, ["touchpoint_analysis", "realtime_interactions"])
    io.write_table(_analysis(spark, sf), f"{database}.touchpoint_analysis", "WRITE_APPEND")
    return spark.table(f"{database}.touchpoint_analysis")


register("create_tables_touchpoints", O.with_base("select * from touchpoint_analysis"))(_created)


def _warehouse_sql(spark, sf):
    """SQL over the tables that the batch job registered in a catalog database."""
    database = f"pathlens_{uuid.uuid4().hex[:8]}"
    build_warehouse(spark, _raw_csv(spark, sf), _folder(spark, "warehouse"), AS_OF, None, database, only=["touchpoint_analysis"])
    return io.run_sql(spark, f"""
        select i.touchpoint, count(*) interactions, count(distinct i.date) n_days, max(t.total_revenue) total_revenue
        from {database}.interactions i join {database}.touchpoint_analysis t on i.touchpoint = t.touchpoint
        group by i.touchpoint""")


register("warehouse_sql", O.with_base("""
select i.touchpoint, count(*) interactions, count(distinct cast(i."timestamp" as date)) n_days, max(t.total_revenue) total_revenue
from interactions i join touchpoint_analysis t on i.touchpoint = t.touchpoint group by i.touchpoint"""))(_warehouse_sql)


def _sink(spark, sf):
    """The real-time sink over everything available, read back."""
    out = _folder(spark, "realtime")
    ST.finish(ST.write_realtime(_stream(spark, sf), out, _folder(spark, "realtime-ckpt"), customers=fx.customers(spark, sf),
                                available_now=True))
    return (ST.live.realtime_table(spark, out).withColumn("processed_timestamp", F.col("processed_timestamp").isNotNull())
            .withColumnRenamed("processed_timestamp", "processed").drop("batch_id", "is_late"))


register("sink_realtime", O.with_base("""
select interaction_id, customer_id, touchpoint, "timestamp", revenue, action_taken, customer_segment, true processed,
       cast("timestamp" as date) date from realtime""", _RT))(_sink)


# ----------------------------------------------------------------- incremental -

def _incremental(name):
    """The derived table from partials that were added in three steps of ten days."""
    def run(spark, sf):
        base = _folder(spark, "incremental")
        day = F.to_date("timestamp")
        for first in (0, 10, 20):
            start = F.date_add(F.lit("2024-01-01").cast("date"), first)
            upto = (day < F.date_add(start, 10)) if first < 20 else F.lit(True)
            INC.add_days(spark, base, _i(spark, sf).where((day >= start) & upto if first else upto))
        return INC.derived(spark, base, fx.customers(spark, sf), AS_OF, None)[name]
    return run


for _name in ("customer_journeys", "touchpoint_analysis", "customer_segments", "time_series_data"):
    register(f"incremental_{_name}", O.with_base(f"select * from {_name}"))(_incremental(_name))


# ----------------------------------------------------------------- live -------
# The live job over the events in four parts, a batch each: in order of time, but for every 50th event,
# which comes with the last part and so behind the watermark. A part is as many files as tasks read it.

def _stored_tables(spark, sf):
    """The factor tables as a live job finds them: stored, readings by date. Each call of the result
    reads them as they are then."""
    base = _folder(spark, "factors")
    for name, rows in _tables(spark, sf).items():
        if name in EN.TOLERANCES:
            rows = rows.withColumn("date", F.to_date("factor_time"))
            ST.live.by_folder(rows, "date").write.partitionBy("date").parquet(f"{base}/{name}")
        else:
            rows.write.parquet(f"{base}/{name}")
    return lambda: {name: spark.read.parquet(f"{base}/{name}") for name in ("customers", *EN.TOLERANCES, "facts")}


def _live(spark, sf, factors=False):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = _stored_tables(spark, sf) if factors else None
    base, src = _folder(spark, "live"), _folder(spark, "live-events")
    late = F.col("event_id") % 50 == 0
    rows = fx.table(spark, sf, "events")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ends["a"]).cast("timestamp"))) * 4
                   / (F.unix_micros(F.lit(ends["b"]).cast("timestamp")) - F.unix_micros(F.lit(ends["a"]).cast("timestamp")) + 1))
    rows.withColumn("n", F.when(late, 3).otherwise(part)).write.partitionBy("n").parquet(f"{src}/parts")
    for n in range(4):
        spark.read.parquet(f"{src}/parts/n={n}").write.mode("append").parquet(f"{src}/events")
        ST.live.start_live(ST.read_interactions_stream(spark, f"{src}/events", file_glob="*.parquet", watermark=None), base, f"{base}-ckpt",
                           factors=tables, available_now=True).awaitTermination()
    return base


def _live_events(spark, sf):
    base = _live(spark, sf)
    late = ST.live.late_events(spark, base).select("interaction_id", F.lit(True).alias("is_late"))
    return ST.live.events(spark, base).join(late, "interaction_id", "left").select(
        "interaction_id", "customer_id", "touchpoint", "timestamp", "revenue", F.coalesce("is_late", F.lit(False)).alias("is_late"))


_LIVE_PART = """
placed as (
  select i.*, case when cast(interaction_id as bigint) % 50 = 0 then 3 else
    cast(floor((epoch_us("timestamp") - lo) * 4 / (hi - lo + 1)) as bigint) end part
  from interactions i, (select min(epoch_us("timestamp")) lo, max(epoch_us("timestamp")) hi from interactions)),
marks as (
  select p.part, max(case when q.part < p.part then q."timestamp" end) - interval 1 hour mark
  from (select distinct part from placed) p, (select part, max("timestamp") "timestamp" from placed group by part) q group by p.part)"""
register("live_events", O.with_base("""
select p.interaction_id, p.customer_id, p.touchpoint, p."timestamp", p.revenue, coalesce(p."timestamp" < m.mark, false) is_late
from placed p join marks m on p.part = m.part""", _LIVE_PART))(_live_events)


register("live_daily_totals", ORACLES["stream_daily_totals"])(
    lambda spark, sf: ST.live.live_views(spark, _live(spark, sf))["daily_totals"])
register("live_weather_impact", ORACLES["weather_impact"])(
    lambda spark, sf: ST.live.live_snapshot(spark, _live(spark, sf, factors=True), AS_OF_MID)["weather_impact"])


# ----------------------------------------------------------------- snapshot ---

def _snapshot(part, factors=False):
    return lambda spark, sf: snapshot(_buffer(spark, sf), _enriched(spark, sf) if factors else None, AS_OF_MID)[part]


for _part, _as in (("weather_impact", "weather_impact"), ("best_weather", "best_weather"), ("market_score", "market_score"),
                   ("sentiment_impact", "sentiment_impact"), ("sentiment_running_rate", "sentiment_running_rate"),
                   ("enriched_interactions", "enriched_recent")):
    register(f"snapshot_{_part}", ORACLES[_as].replace("limit 10", f"limit {config.LATEST_INTERACTIONS}"))(_snapshot(_part, factors=True))
register("snapshot_conversion_window", ORACLES["conversion_window"])(_snapshot("conversion_window"))

_MID = f"\"timestamp\" <= TIMESTAMP '{AS_OF_MID}' and \"timestamp\" > TIMESTAMP '{AS_OF_MID}' - INTERVAL"
register("snapshot_minute_trends", O.with_base(f"""
select date_trunc('minute', "timestamp") as "minute", count(interaction_id) interactions, sum(revenue) revenue,
       count(distinct customer_id) unique_customers from interactions where {_MID} 60 MINUTE group by 1"""))(
    _snapshot("minute_trends"))
register("snapshot_touchpoints", O.with_base(f"""
select touchpoint, count(interaction_id) interactions, sum(revenue) revenue, count(distinct customer_id) unique_customers
from interactions where {_MID} 30 MINUTE group by touchpoint"""))(_snapshot("touchpoint_performance"))
register("snapshot_latest", O.with_base(f"""
select *, "timestamp" processed_timestamp from interactions where {_MID} 60 MINUTE
order by "timestamp" desc, interaction_id desc limit 20"""))(_snapshot("recent_interactions"))
