"""Account KPIs, series, recommendations, rankings (sections 2.5 to 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorametrics.functions import metric as M
from agorametrics.functions import timeparse as T
from agorametrics.functions.metric import round_dp
from agorametrics.operators import history as H
from agorametrics.operators import ingest as I
from agorametrics.operators import kpi as K
from agorametrics.operators import ordered as O
from agorametrics.operators import posts as P
from agorametrics.operators import recommend as R
from agorametrics.operators import series as SR
from agorametrics.plans.fixtures import EVENTS_AS_OF, ORDERS_AS_OF
from agorametrics.plans.post_queries import metrics
from agorametrics.plans.registry import (
    FACTS, POST_METRICS, basis_sql, bounds, delta_sql, isum, kpi_select, query, rd,
)
from agorametrics.session import materialize
from agorametrics.vocab import DAY_NAMES

O_UNTIL, O_SINCE, O_PREV = bounds(ORDERS_AS_OF, "730d")
E_UNTIL, E_SINCE, E_PREV = bounds(EVENTS_AS_OF, "14d")


def order_window(fx):
    """Post facts of the orders window."""
    until = P.moment(ORDERS_AS_OF)
    return K.with_primary_er(metrics(fx, since=until - P.parse_window("730d"), until=until))


WINDOW = f"{FACTS}, w as (select * from facts where published_at >= {O_SINCE} and published_at < {O_UNTIL})"
MEAN = f"case when count(er) > 0 then {rd('sum(cast(round(er * 100) as bigint)) / 100.0 / count(er)')} end"
MEDIAN = rd("median(er)")


# --- single account statistics ---------------------------------------------------------------
@query("mean_metric", f"""with {WINDOW} select account_id, count(er) as n, {MEAN} as mean,
 case when count(er) = 0 then 'insufficient_data' end as mean_reason from w group by 1""")
def _(fx):
    return K.mean_metric(order_window(fx), ["account_id"])


@query("median_metric", f"""with {WINDOW} select account_id, count(er) as n, {MEDIAN} as median,
 case when count(er) = 0 then 'insufficient_data' end as median_reason from w group by 1""")
def _(fx):
    # counted and ordered in two branches
    facts = materialize(order_window(fx).select("account_id", "er"), "median-facts")
    return K.median_metric(facts, ["account_id"])


@query("posting_frequency_per_week", f"""select account_id, count(*) as n_posts,
 {rd('count(*) / (730.0::double / 7.0::double)')} as posting_frequency_per_week from fx_posts
 where published_at >= {O_SINCE} and published_at < {O_UNTIL} group by 1""")
def _(fx):
    posts = P.window_filter(fx["fx_posts"], "published_at", ORDERS_AS_OF, "730d")
    counts = posts.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_posts"))
    freq = K.posting_frequency(F.col("n_posts"), 730.0)
    return M.select_metrics(counts, [F.col("account_id"), F.col("n_posts")],
                            {"posting_frequency_per_week": freq}, reasons=False)


_GAPS = """gaps as (select account_id, post_id, published_at, (epoch_us(published_at) -
 epoch_us(lag(published_at) over (partition by account_id order by published_at, post_id))) / 3600000000.0::double as gap
 from {table} {where})"""


@query("posting_consistency", f"""with {_GAPS.format(table='fx_timed_posts', where='')}
 select account_id, count(*) as n_posts, case when count(*) >= 3 then {rd('stddev_samp(gap)')} end as posting_consistency_hours,
 case when count(*) < 3 then 'insufficient_data' end as posting_consistency_hours_reason from gaps group by 1""")
def _(fx):
    return K.posting_consistency(fx["fx_timed_posts"])


@query("post_gap_hours", f"""with {_GAPS.format(table='fx_timed_posts', where='')}
 select account_id, post_id, {rd('gap', 4)} as gap_hours from gaps""")
def _(fx):
    posts = fx["fx_timed_posts"].select("account_id", "post_id", "published_at")
    gapped = O.with_previous(posts, ["account_id"], "published_at", "post_id", "_previous")
    hours = (F.unix_micros("published_at") - F.unix_micros("_previous")) / F.lit(3_600_000_000.0)
    return gapped.withColumn("_gap", hours).select(
        "account_id", "post_id", round_dp("_gap", 4).alias("gap_hours"))


_FOLLOWERS = f"""g as (select account_id, arg_min(followers_count, captured_at) as f_start,
 arg_max(followers_count, captured_at) as f_end from fx_follower_snapshots
 where captured_at >= {E_SINCE} and captured_at < {E_UNTIL} group by 1)"""


def _followers(fx):
    until = P.moment(EVENTS_AS_OF)
    return K.follower_change(fx["fx_follower_snapshots"], until - P.parse_window("14d"), until)


@query("follower_growth_rate", f"""with {_FOLLOWERS} select account_id, f_start, f_end,
 case when f_start > 0 then {rd('(f_end - f_start) / f_start * 100')} end as follower_growth_rate,
 case when f_start <= 0 then 'non_positive_denominator' end as follower_growth_rate_reason from g""")
def _(fx):
    return _followers(fx).drop("net_follower_change", "net_follower_change_reason")


@query("net_follower_change", f"""with {_FOLLOWERS} select account_id, f_start, f_end,
 cast(f_end - f_start as double) as net_follower_change, cast(null as varchar) as net_follower_change_reason from g""")
def _(fx):
    return _followers(fx).drop("follower_growth_rate", "follower_growth_rate_reason")


_DELTA = delta_sql("cur", "prev")


@query("delta_pct", f"""with {POST_METRICS}, g as (select account_id,
  {isum(f'case when published_at >= {O_SINCE} then engagement else 0 end')} as cur,
  {isum(f'case when published_at < {O_SINCE} then engagement else 0 end')} as prev
  from pm where published_at >= {O_PREV} and published_at < {O_UNTIL} group by 1)
 select account_id, cur, prev, {_DELTA[0]} as delta_pct, {_DELTA[1]} as delta_pct_reason from g""")
def _(fx):
    until, delta = P.moment(ORDERS_AS_OF), P.parse_window("730d")
    tagged = P.period_tag(metrics(fx, since=until - 2 * delta, until=until), "published_at", ORDERS_AS_OF, "730d")
    sides = tagged.groupBy("account_id").agg(*[
        F.sum(F.when(F.col("period") == p, F.col("engagement")).otherwise(0)).alias(p) for p in ("cur", "prev")])
    return M.select_metrics(sides, [F.col(c) for c in ("account_id", "cur", "prev")],
                            {"delta_pct": M.delta_pct(F.col("cur"), F.col("prev"))})


@query("dominant_basis", f"""with {WINDOW} select account_id, {basis_sql("count(*) filter (er_basis = 'err')",
 "count(*) filter (er_basis = 'erf')")} as basis from w group by 1""")
def _(fx):
    counts = order_window(fx).groupBy("account_id").agg(*K.basis_counts())
    return counts.select("account_id", K.dominant_basis(F.col("n_err"), F.col("n_erf")).alias("basis"))


@query("denominator_basis", f"""with {POST_METRICS} select account_id,
 case when count(*) filter (reach > 0) > 0 then 'reach' else 'followers' end as denominator_basis from pm group by 1""")
def _(fx):
    return K.denominator_basis(metrics(fx))


_BEST = f"""best as (select account_id, post_id as best_post_id, er as best_er, permalink as best_permalink from w
  where er is not null qualify row_number() over (partition by account_id order by er desc, post_id) = 1),
 worst as (select account_id, post_id as worst_post_id, er as worst_er, permalink as worst_permalink from w
  where er is not null qualify row_number() over (partition by account_id order by er, post_id) = 1)"""


@query("best_worst_post", f"with {WINDOW}, {_BEST} select * from best join worst using (account_id)")
def _(fx):
    return K.best_worst(order_window(fx))


_D = {
    "total_engagement_pct": delta_sql("e", "pe"), "avg_engagement_rate_pct": delta_sql("m", "pm_"),
    "n_posts_pct": delta_sql("n", "pn"),
}


# facts and owners with the followers known at the report date
_OWNED = f"""owners as (select a.* exclude (followers_count), coalesce(n.followers_count, a.followers_count) as followers_count,
  case when n.followers_count is not null then 'snapshot' when a.followers_count is null then 'unavailable' else 'account_latest' end as followers_basis
  from fx_accounts a left join (select account_id, arg_max(followers_count, captured_at) as followers_count from fx_order_followers
   where captured_at between {O_UNTIL} - interval 7 day and {O_UNTIL} group by 1) n on n.account_id = a.account_id),
 {WINDOW.replace("join fx_accounts a", "join owners a")}"""


@query("kpi_overview", f"""with {_OWNED}, {_BEST},
 gaps as (select account_id, (epoch_us(published_at) -
  epoch_us(lag(published_at) over (partition by account_id order by published_at, post_id))) / 3600000000.0::double as gap from w),
 c as (select account_id, count(*) as n, {isum('engagement')} as e, {MEAN} as m, {MEDIAN} as med,
  {basis_sql("count(*) filter (er_basis = 'err')", "count(*) filter (er_basis = 'erf')")} as basis from w group by 1),
 s as (select account_id, {rd('stddev_samp(gap)')} as sd from gaps group by 1),
 p as (select account_id, count(*) as pn, {isum('engagement')} as pe, {MEAN} as pm_ from facts
  where published_at >= {O_PREV} and published_at < {O_SINCE} group by 1),
 j as (select a.account_id, a.handle, a.platform, a.followers_count as followers,
  a.followers_basis, coalesce(n, 0) as n, coalesce(e, 0) as e, m, med, coalesce(basis, 'none') as basis, sd,
  coalesce(pn, 0) as pn, coalesce(pe, 0) as pe, pm_
  from owners a left join c using (account_id) left join s using (account_id) left join p using (account_id))
 select j.account_id, handle, platform, followers, followers_basis, n as n_posts, e as total_engagement,
  basis as engagement_rate_basis, m as avg_engagement_rate, case when m is null then 'insufficient_data' end as avg_engagement_rate_reason,
  case when n >= 3 then sd end as posting_consistency_hours, case when n < 3 then 'insufficient_data' end as posting_consistency_hours_reason,
  best_post_id, best_er, best_permalink, worst_post_id, worst_er, worst_permalink,
  med as median_engagement_rate, case when med is null then 'insufficient_data' end as median_engagement_rate_reason,
  {rd('n / (730.0::double / 7.0::double)')} as posting_frequency_per_week, cast(null as varchar) as posting_frequency_per_week_reason,
  {', '.join(f'{v} as {k}, {r} as {k}_reason' for k, (v, r) in _D.items())}
 from j left join best using (account_id) left join worst using (account_id)""")
def _(fx):
    until, delta = P.moment(ORDERS_AS_OF), P.parse_window("730d")
    accounts, followers = fx["fx_accounts"], fx["fx_order_followers"]
    facts = materialize(K.post_facts(fx["fx_posts"], fx["fx_snapshots"], accounts, followers, ORDERS_AS_OF,
                                     until - 2 * delta, until), "post-facts")
    owners = P.resolve_followers(accounts, followers, ORDERS_AS_OF)
    return K.kpi_overview(facts, owners, ORDERS_AS_OF, "730d")


# --- series ----------------------------------------------------------------------------------
# DuckDB's wall-clock time in the display zone
_LOCAL = "timezone('Africa/Tunis', timezone('UTC', published_at))"
_FORMATS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m"}
_STEPS = {"hour": "1 hour", "day": "1 day", "week": "7 day", "month": "1 month"}


def series_sql(source: str, value: str, g: str, extra: str = "", name: str = "") -> str:
    """CTEs: sums per local bucket and a gap-filled series ``filled``, by a calendar join."""
    keys = "account_id" + (f", {extra}" if extra else "")
    return f"""b as (select {keys}, date_trunc('{g}', {_LOCAL})::timestamp as bucket, {value} as v
   from {source} group by all),
  span as (select {keys}, min(bucket) as lo, max(bucket) as hi from b group by all),
  cal as (select {keys}, unnest(generate_series(lo, hi, interval {_STEPS[g]})) as bucket from span),
  filled as (select {', '.join('cal.' + k.strip() for k in keys.split(','))}, cal.bucket, coalesce(b.v, 0.0::double) as value,
   strftime(cal.bucket, '{_FORMATS[g]}') as label from cal left join b on b.account_id = cal.account_id and b.bucket = cal.bucket)"""


_SUM = f"{rd('coalesce(sum(engagement), 0)')}"


@query("sum_timeseries", f"""with {POST_METRICS}, {series_sql('pm', _SUM, 'month')}
 select account_id, bucket, label, value from filled""")
def _(fx):
    return SR.sum_timeseries(metrics(fx), "engagement", "month").select("account_id", "bucket", "label", "value")


@query("gap_fill", f"""with {series_sql('fx_timed_posts', rd('sum(round(er * 100)) / 100'), 'hour')}
 select account_id, bucket, value from filled""")
def _(fx):
    sums = fx["fx_timed_posts"].groupBy("account_id", T.bucket(F.col("published_at"), "hour").alias("bucket")).agg(
        (F.sum(M.cents(F.col("er"))) / 100.0).alias("_v"))
    series = sums.select("account_id", "bucket", round_dp("_v").alias("value"))
    return SR.gap_fill(series, ["account_id"], "hour", ["value"])


@query("bucket_label", "select post_id, " + ", ".join(
    f"strftime(date_trunc('{g}', {_LOCAL}), '{f}') as {g}_label" for g, f in _FORMATS.items()) + " from fx_timed_posts")
def _(fx):
    labels = [T.bucket_label(T.bucket(F.col("published_at"), g), g).alias(f"{g}_label") for g in _FORMATS]
    return fx["fx_timed_posts"].select("post_id", *labels)


_POOLED = f"case when sum(reach) > 0 then {rd('sum(engagement) / sum(reach) * 100')} else 0 end"


@query("engagement_rate_timeseries", f"""with {WINDOW}, {series_sql('w', _POOLED, 'week')}
 select account_id, bucket, label, value from filled""")
def _(fx):
    return SR.engagement_rate_timeseries(order_window(fx), "week").select("account_id", "bucket", "label", "value")


_ROLL = """avg(value) over (partition by account_id order by bucket rows between {p} preceding and current row)"""


def _rolled(w: int) -> str:
    exact = (f"sum(cast(round(value * 100) as bigint)) over (partition by account_id order by bucket "
             f"rows between {w - 1} preceding and current row) / 100.0 / {w}")
    return f"case when row_number() over (partition by account_id order by bucket) >= {w} then {rd(exact)} end"


@query("rolling_mean", f"""with {series_sql('fx_timed_posts', rd('sum(round(er * 100)) / 100'), 'day')}
 select account_id, bucket, value, {_rolled(7)} as rolling from filled""")
def _(fx):
    sums = fx["fx_timed_posts"].groupBy("account_id", T.bucket(F.col("published_at"), "day").alias("bucket")).agg(
        (F.sum(M.cents(F.col("er"))) / 100.0).alias("_v"))
    series = sums.select("account_id", "bucket", round_dp("_v").alias("value"))
    return SR.rolling_mean(SR.gap_fill(series, ["account_id"], "day", ["value"]), 7)


@query("kpi_timeseries", f"""with {WINDOW}, basis as (select account_id,
  case when max(reach) > 0 then 'engagement_rate_by_reach' else 'engagement_rate_by_followers' end as name from w group by 1),
 src as (select w.*, basis.name, case when basis.name = 'engagement_rate_by_reach' then reach else followers end as den
  from w join basis using (account_id)),
 {series_sql('src', f"case when sum(den) > 0 then {rd('sum(engagement) / sum(den) * 100')} else 0 end", 'month', 'name')}
 select account_id, name, bucket, label, value, {_rolled(3)} as rolling from filled""")
def _(fx):
    return SR.kpi_timeseries(order_window(fx), "err", "month", rolling=3)


_PLATFORM_DAYS = f"""days as (select platform, cast(published_at as date) as day,
  {rd('sum(cast(round(er * 100) as bigint)) / 100.0 / count(er)')} as day_mean from facts
  where published_at >= {O_UNTIL} - interval 90 day and published_at < {O_UNTIL} and er is not null group by 1, 2)"""


@query("kpi_by_platform", f"""with {WINDOW}, {_PLATFORM_DAYS},
 base as (select platform, avg(day_mean) as mu, stddev_samp(day_mean) as sd, count(*) as n_days from days group by 1),
 cur as (select platform, count(*) as n_posts, {isum('engagement')} as total_engagement, {MEAN} as m, {MEDIAN} as med,
  {basis_sql("count(*) filter (er_basis = 'err')", "count(*) filter (er_basis = 'erf')")} as basis from w group by 1)
 select cur.platform, n_posts, total_engagement, basis as engagement_rate_basis, m as avg_engagement_rate,
  case when m is null then 'insufficient_data' end as avg_engagement_rate_reason, med as median_engagement_rate,
  case when med is null then 'insufficient_data' end as median_engagement_rate_reason,
  case when m is not null and n_days >= 2 and sd <> 0 then {rd('(m - mu) / sd')} end as zscore_vs_90d_baseline,
  case when m is null or coalesce(n_days, 0) < 2 then 'insufficient_data' when sd = 0 then 'non_positive_denominator' end
   as zscore_vs_90d_baseline_reason
 from cur left join base on base.platform = cur.platform""")
def _(fx):
    until = P.moment(ORDERS_AS_OF)
    facts = materialize(K.with_primary_er(metrics(fx, since=until - P.parse_window("730d"), until=until)).select(
        "platform", "published_at", "engagement", "er", "er_basis"), "platform-facts")
    return SR.kpi_by_platform(facts, ORDERS_AS_OF, "730d")


@query("zscore", f"""with d as (select account_id, cast(published_at as date) as day,
  {rd('sum(cast(round(er * 100) as bigint)) / 100.0 / count(er)')} as day_mean from fx_timed_posts group by 1, 2),
 b as (select account_id, avg(day_mean) as mu, stddev_samp(day_mean) as sd, count(*) as baseline_days from d group by 1),
 c as (select account_id, {MEAN} as current_mean from fx_timed_posts where published_at >= {E_SINCE} group by 1)
 select b.account_id, current_mean, baseline_days,
  case when current_mean is not null and baseline_days >= 2 and sd <> 0 then {rd('(current_mean - mu) / sd')} end as zscore,
  case when current_mean is null or baseline_days < 2 then 'insufficient_data' when sd = 0 then 'non_positive_denominator' end as zscore_reason
 from b left join c on c.account_id = b.account_id""")
def _(fx):
    since = P.moment(EVENTS_AS_OF) - P.parse_window("14d")
    return SR.zscore_per_key(fx["fx_timed_posts"], ["account_id"], current_since=since)


# --- recommendations -------------------------------------------------------------------------
_CONF = "case when n >= 8 then 'high' when n >= 4 then 'medium' when n >= 2 then 'low' end"
_RULES = {"content_type": (2, None), "hashtags": (2, 10), "best_time": (2, 5),
          "best_time_day": (1, None), "best_time_hour": (1, None), "category": (2, None)}
_KEYS = {
    "content_type": "select account_id, 'content_type' as kind, coalesce(content_type, 'unknown') as key, er from {f}",
    "hashtags": "select account_id, 'hashtags', unnest(list_distinct(list_transform("
                "regexp_extract_all(text_content, '#([\\p{{L}}\\p{{N}}_]+)', 1), lambda t: lower(t)))), er from {f}",
    "best_time": "select account_id, 'best_time', concat(isodow(" + _LOCAL + ") - 1, ':', lpad(cast(hour("
                 + _LOCAL + ") as varchar), 2, '0')), er from {f}",
    "best_time_day": "select account_id, 'best_time_day', cast(isodow(" + _LOCAL + ") - 1 as varchar), er from {f}",
    "best_time_hour": "select account_id, 'best_time_hour', lpad(cast(hour(" + _LOCAL + ") as varchar), 2, '0'), er from {f}",
}


def rank_sql(facts: str, kinds: list[str], obs: str | None = None, rules=None) -> str:
    """CTEs ending in ``ranked``: ranked keys and reason rows, written window by window."""
    rules = {**_RULES, **(rules or {})}
    obs = obs or " union all ".join(_KEYS[k].format(f=facts) for k in kinds)
    listed = ", ".join(f"('{k}', {rules[k][0]}, {rules[k][1] or 'null::int'})" for k in kinds)
    return f"""obs(account_id, kind, key, er) as ({obs}),
 kinds(kind, min_n, top) as (values {listed}),
 who as (select account_id, {basis_sql("count(*) filter (er_basis = 'err')", "count(*) filter (er_basis = 'erf')")} as er_basis
  from {facts} group by 1),
 tot as (select who.account_id, who.er_basis, kinds.kind, kinds.min_n, kinds.top, count(obs.er) as n_total,
   sum(cast(round(obs.er * 100) as bigint)) / 100.0 / count(obs.er) as base
  from who cross join kinds left join obs on obs.account_id = who.account_id and obs.kind = kinds.kind group by all),
 g as (select account_id, kind, key, count(er) as n, sum(cast(round(er * 100) as bigint)) / 100.0 as s
  from obs group by 1, 2, 3),
 scored as (select tot.*, g.key, g.n, {rd('g.s / g.n', 4)} as mean_er, {rd('(g.s + 5.0::double * tot.base) / (g.n + 5)', 4)} as shrunk_score
  from tot join g on g.account_id = tot.account_id and g.kind = tot.kind
  where g.n >= tot.min_n and tot.n_total >= 2 and tot.base > 0),
 placed as (select *, row_number() over (partition by account_id, kind order by shrunk_score desc, key) as rank from scored),
 ranked as (select account_id, kind, er_basis, rank, key, n, mean_er, shrunk_score, {rd('mean_er / base')} as lift,
   {_CONF} as confidence, {rd('base', 4)} as baseline_er, n_total, cast(null as varchar) as reason
  from placed where top is null or rank <= top
  union all
  select account_id, kind, er_basis, null, null, null, null, null, null, null,
   case when n_total >= 2 then {rd('base', 4)} end, n_total,
   case when kind = 'hashtags' and n_total = 0 then 'no_hashtags' when n_total < 2 then 'insufficient_data'
    when base <= 0 then 'no_engagement_signal' else 'insufficient_data' end
  from tot where kind not in ('best_time_day', 'best_time_hour') and not exists (
   select 1 from scored where scored.account_id = tot.account_id and scored.kind = tot.kind))"""


_DAYS = "[" + ", ".join(f"'{d}'" for d in DAY_NAMES) + "]"
_TIMES = f"""*, case when kind in ('best_time', 'best_time_day') then cast(split_part(key, ':', 1) as bigint) end as day_of_week,
 case when kind in ('best_time', 'best_time_day') then ({_DAYS})[cast(split_part(key, ':', 1) as int) + 1] end as day,
 case when kind = 'best_time' then cast(split_part(key, ':', 2) as bigint) when kind = 'best_time_hour' then cast(key as bigint) end as hour"""


@query("rank_categories", f"""with {rank_sql("(select *, 'err' as er_basis from fx_timed_posts)", ["category"],
 "select account_id, 'category', content_type, er from fx_timed_posts")} select * exclude (kind, er_basis) from ranked""")
def _(fx):
    return R.rank_categories(fx["fx_timed_posts"].select("account_id", F.col("content_type").alias("key"), "er"))


@query("recommend_content_types", f"with {WINDOW}, {rank_sql('w', ['content_type'])} select * from ranked")
def _(fx):
    return R.recommend_content_types(order_window(fx))


@query("recommend_hashtags", f"with {WINDOW}, {rank_sql('w', ['hashtags'])} select * from ranked")
def _(fx):
    return R.recommend_hashtags(order_window(fx))


_TIME_KINDS = ["best_time", "best_time_day", "best_time_hour"]


@query("recommend_best_time", f"with {rank_sql('fx_facts', _TIME_KINDS)} select {_TIMES} from ranked")
def _(fx):
    return R.recommend_best_time(fx["fx_facts"])


@query("all_recommendations", f"with {rank_sql('fx_facts', list(R.RULES))} select {_TIMES} from ranked")
def _(fx):
    return R.all_recommendations(fx["fx_facts"])


@query("rank_topk_per_account", f"""with {rank_sql('fx_facts', ['hashtags'], rules={'hashtags': (2, 3)})}
 select account_id, rank, key, shrunk_score from ranked where key is not null""")
def _(fx):
    return R.recommend_hashtags(fx["fx_facts"], top_k=3).filter(F.col("key").isNotNull()).select(
        "account_id", "rank", "key", "shrunk_score")


_GROUPS = """g as (select account_id, content_type, count(*) as n, sum(cast(round(er * 100) as bigint)) / 100.0 as s
  from fx_timed_posts group by 1, 2),
 b as (select account_id, sum(cast(round(er * 100) as bigint)) / 100.0 / count(*) as base from fx_timed_posts group by 1)"""


def _groups(fx):
    cells = fx["fx_timed_posts"].groupBy("account_id", "content_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(M.cents(F.col("er"))).alias("_c"))
    base = cells.groupBy("account_id").agg(F.sum("_c").alias("_bc"), F.sum("n").alias("_bn"))
    return cells.join(base, "account_id").select(
        "account_id", "content_type", "n", (F.col("_c") / 100.0).alias("s"),
        (F.col("_bc") / 100.0 / F.col("_bn")).alias("base"))


@query("confidence_for", f"with {_GROUPS} select account_id, content_type, n, {_CONF} as confidence from g")
def _(fx):
    return _groups(fx).select("account_id", "content_type", "n", R.confidence_for(F.col("n")).alias("confidence"))


@query("lift", f"""with {_GROUPS} select g.account_id, content_type,
 case when base > 0 then {rd(rd('s / n', 4) + ' / base')} end as lift from g join b on b.account_id = g.account_id""")
def _(fx):
    rounded = _groups(fx).withColumn("_raw", F.col("s") / F.col("n")).withColumn("_m", round_dp("_raw", 4))
    return rounded.select("account_id", "content_type", R.lift(F.col("_m"), F.col("base")).alias("lift"))


@query("shrunk_mean", f"""with {_GROUPS} select g.account_id, content_type,
 {rd('(s + 5.0::double * base) / (n + 5)', 4)} as shrunk_mean from g join b on b.account_id = g.account_id""")
def _(fx):
    shrunk = _groups(fx).withColumn("_m", R.shrunk_mean(F.col("s"), F.col("n"), F.col("base")))
    return shrunk.select("account_id", "content_type", round_dp("_m", 4).alias("shrunk_mean"))


# --- top lists -------------------------------------------------------------------------------
_KPIS = kpi_select()


@query("top_posts", f"""with {FACTS} select account_id, row_number() over (partition by account_id order by er desc, post_id) as rank,
 post_id, published_at, content_type, permalink, er as score, er_basis as score_basis, engagement, {_KPIS}
 from facts where er is not null qualify rank <= 10""")
def _(fx):
    return K.top_posts(metrics(fx), "err", 10)


@query("comment_fetch_cap", """select account_id, post_id, row_number() over (partition by account_id
 order by published_at desc, post_id) as rank from fx_timed_posts qualify rank <= 25""")
def _(fx):
    return I.comment_fetch_cap(fx["fx_timed_posts"], cap=25).select("account_id", "post_id", "rank")


@query("brand_context", """with l as (select account_id, text_content, row_number() over (partition by account_id
  order by published_at desc, post_id desc) as rank from stg where text_content is not null qualify rank <= 3)
 select account_id, string_agg('- ' || trim(text_content), chr(10) order by rank) as context from l
 where trim(text_content) <> '' group by 1""".replace("from stg ", """from (select o_custkey as account_id, o_orderkey as post_id,
  o_orderdate as published_at, case when o_orderkey % 4 = 0 then null when o_orderkey % 5 = 0 then '   '
  else concat('  caption ', cast(o_orderkey as string)) end as text_content from orders) """))
def _(fx):
    posts = fx.sql("""select o_custkey as account_id, o_orderkey as post_id, o_orderdate as published_at,
     case when o_orderkey % 4 = 0 then null when o_orderkey % 5 = 0 then '   '
     else concat('  caption ', cast(o_orderkey as string)) end as text_content from orders""")
    return H.brand_context(posts)


# agent runs and calls: events in their shape
_RUNS = """select event_id as id, user_id as account_id, concat('q ', cast(event_id as string)) as question,
 case when event_id % 3 = 0 then null else concat('{"tool_calls":["kpi_overview","', event_type, '"]}') end as reasoning_trace
 from events"""


@query("recent_runs", f"""select id, account_id, question, case when reasoning_trace is null then ''
 else concat('kpi_overview,', json_extract_string(reasoning_trace, '$.tool_calls[1]')) end as trace
 from ({_RUNS}) order by id desc limit 500""")
def _(fx):
    runs = H.recent_runs(fx.sql(_RUNS), limit=500)
    return runs.withColumn("trace", F.array_join("trace", ","))


_CALLS = """select event_id as id, concat('provider', cast(event_id % 3 as string)) as provider, event_type as model,
 case when event_id % 4 = 0 then 'error' else 'ok' end as status, event_id % 3 as fallback_depth,
 case when event_id % 4 = 0 then concat(repeat('long error text ', 40), cast(event_id as string)) else null end as error from events"""


@query("recent_llm_calls", f"""select id, provider, model, status, fallback_depth, left(error, 60) as error
 from ({_CALLS}) order by id desc limit 5""")
def _(fx):
    return H.recent_llm_calls(fx.sql(_CALLS))


@query("attempt_depth", f"""select user_id, call, row_number() over (partition by user_id, call order by id) - 1 as fallback_depth,
 provider, model, status, left(error, 500) as error from (select c.*, e.user_id, cast(e.event_id // 4 as bigint) as call from ({_CALLS}) c
 join events e on e.event_id = c.id)""")
def _(fx):
    calls = fx.sql(_CALLS).join(fx.table("events").select(F.col("event_id").alias("id"), "user_id"), "id")
    # a call has at most four attempts
    attempt = F.struct("id", "provider", "model", "status", "error")
    grouped = calls.groupBy("user_id", F.floor(F.col("id") / 4).alias("call")).agg(
        F.array_sort(F.collect_list(attempt)).alias("attempts"))
    return H.attempt_depth(grouped, error_chars=500)
