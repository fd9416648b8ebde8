"""Filters, joins and post KPIs (sections 2.2 to 2.4 of the blueprint)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorametrics.operators import ingest as I
from agorametrics.operators import kpi as K
from agorametrics.operators import posts as P
from agorametrics.operators import sentiment as S
from agorametrics.operators import topics as TP
from agorametrics.plans.fixtures import EVENTS_AS_OF, ORDERS_AS_OF, TEXTS
from agorametrics.plans.registry import (
    FACTS, KPI_SQL, LATEST, POST_METRICS, bounds, isum, kpi_select, query, rd, ts,
)
from agorametrics.session import shared_dir
from agorametrics.sources import layout as LY

O_UNTIL, O_SINCE, O_PREV = bounds(ORDERS_AS_OF, "730d")
E_UNTIL, E_SINCE, E_PREV = bounds(EVENTS_AS_OF, "14d")
GATE_AS_OF = "2000-06-01 00:00:00"


def metrics(fx, **kw):
    return P.post_metrics(fx["fx_posts"], fx["fx_snapshots"], fx["fx_accounts"], as_of=ORDERS_AS_OF, **kw)


# --- filters ---------------------------------------------------------------------------------
@query("window_filter", f"""select post_id, account_id, published_at from fx_posts
 where published_at >= {O_SINCE} and published_at < {O_UNTIL}""")
def _(fx):
    return P.window_filter(fx["fx_posts"], "published_at", ORDERS_AS_OF, "730d").select(
        "post_id", "account_id", "published_at")


@query("prior_window_filter", f"""select account_id, count(*) filter (published_at >= {O_SINCE}) as n_cur,
 count(*) filter (published_at < {O_SINCE}) as n_prev from fx_posts
 where published_at >= {O_PREV} and published_at < {O_UNTIL} group by 1""")
def _(fx):
    tagged = P.period_tag(fx["fx_posts"], "published_at", ORDERS_AS_OF, "730d")
    return tagged.groupBy("account_id").agg(
        F.count_if(F.col("period") == "cur").alias("n_cur"),
        F.count_if(F.col("period") == "prev").alias("n_prev"))


@query("account_platform_filter", f"""with {POST_METRICS} select post_id, account_id, platform, engagement from pm
 where platform in ('AUTOMOBILE', 'BUILDING')""")
def _(fx):
    return metrics(fx, platforms=["AUTOMOBILE", "BUILDING"]).select(
        "post_id", "account_id", "platform", "engagement")


@query("synthetic_filter", "select post_id, account_id from fx_posts where not is_synthetic")
def _(fx):
    return P.synthetic_filter(fx["fx_posts"], include_synthetic=False).select("post_id", "account_id")


@query("post_quality_gate", f"""select external_id, case
  when published_at > {ts(GATE_AS_OF)} + interval 5 minute then 'future_timestamp'
  when media_count < 0 then 'negative_media_count' end as reject_reason from stg_posts""")
def _(fx):
    return I.post_quality_gate(fx["stg_posts"], GATE_AS_OF).select("external_id", "reject_reason")


_NEGATIVE = " ".join(f"when {c} < 0 then 'negative_{c}'" for c in (
    "likes", "comments_count", "shares", "saves", "reach", "impressions", "video_views", "clicks"))


@query("metric_quality_gate", f"""select post_external_id, captured_at, _ord as ord, case
  when captured_at > {ts(GATE_AS_OF)} + interval 5 minute then 'future_timestamp' {_NEGATIVE} end as reject_reason
 from stg_metrics""")
def _(fx):
    return I.metric_quality_gate(fx["stg_metrics"], GATE_AS_OF).select(
        "post_external_id", "captured_at", F.col("_ord").alias("ord"), "reject_reason")


@query("reach_anomaly_flag", """select post_id, captured_at,
 case when reach < likes + comments_count + shares + saves then 'reach_lt_engagement' else '' end as flags
 from (select * replace (reach % 100 as reach) from fx_snapshots)""")
def _(fx):
    low = fx["fx_snapshots"].withColumn("reach", F.col("reach") % 100)
    return I.reach_anomaly_flag(low).select("post_id", "captured_at", F.array_join("flags", ",").alias("flags"))


# one cursor per source and kind, for half of them
_CURSORS = f"""select source, entity_type, max(captured_at) - interval 5 day as cursor_value
 from fx_raw_events where entity_type <> 'comment' group by source, entity_type"""


@query("cursor_filter", f"""with c as ({_CURSORS})
 select e.id, e.source, e.entity_type, e.captured_at from fx_raw_events e
 left join c on c.source = e.source and c.entity_type = e.entity_type
 where e.captured_at > coalesce(c.cursor_value, timestamp '2024-04-10 00:00:00' - interval 90 day)""")
def _(fx):
    events = fx["fx_raw_events"].select("id", "source", "entity_type", "captured_at")
    cursors = fx.sql(_CURSORS)
    return I.cursor_filter(events, cursors, ["source", "entity_type"], "captured_at", "2024-04-10 00:00:00", first_sync_days=90)


@query("retention_purge", f"""select count(*) filter (captured_at < {ts('2024-02-10 00:00:00')} - interval 30 day) as deleted,
 count(*) filter (captured_at >= {ts('2024-02-10 00:00:00')} - interval 30 day) as remaining,
 min(captured_at) filter (captured_at >= {ts('2024-02-10 00:00:00')} - interval 30 day) as oldest_remaining
 from fx_raw_events""")
def _(fx):
    return I.retention_report(fx["fx_raw_events"], "2024-02-10 00:00:00", 30)


@query("unlabeled_filter", "select comment_id, account_id from fx_comments where sentiment is null")
def _(fx):
    return fx["fx_comments"].filter(F.col("sentiment").isNull()).select("comment_id", "account_id")


@query("nonblank_text_filter", f"select text_id, text_content from ({TEXTS}) where trim(text_content, ' ' || chr(10) || chr(9) || chr(13)) <> ''")
def _(fx):
    return P.nonblank_text(fx.sql(TEXTS))


@query("min_sample_filter", """select account_id, content_type, count(*) as n from fx_timed_posts
 group by 1, 2 having count(*) >= 10""")
def _(fx):
    return fx["fx_timed_posts"].groupBy("account_id", "content_type").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 10)


# clusters of a fixed rule stand in for a model's answer
ASSIGNED = """select comment_id, account_id, published_at, text_content, language, sentiment,
 cast(case when comment_id % 7 = 0 then -1 when comment_id % 97 = 1 then 50 + comment_id else comment_id % 5 end as bigint)
 as cluster_id from fx_comments"""


@query("usable_cluster_filter", f"""with assigned as ({ASSIGNED}),
 sizes as (select account_id, cluster_id, count(*) as size from assigned group by 1, 2),
 docs as (select account_id, {isum('size')} as n_docs from sizes group by 1)
 select s.account_id, s.cluster_id, s.size, d.n_docs, cast(null as varchar) as reason
 from sizes s join docs d on d.account_id = s.account_id where d.n_docs >= 20 and s.cluster_id <> -1 and s.size >= 3
 union all select account_id, null, null, n_docs, 'insufficient_data' from docs where n_docs < 20""")
def _(fx):
    return TP.usable_clusters(fx.sql(ASSIGNED))


@query("post_projection", f"""with {POST_METRICS} select post_id, account_id, published_at, content_type, permalink,
 text_content, is_synthetic, platform, likes, comments_count as comments, shares, saves, reach, impressions,
 video_views, clicks, engagement, followers from pm""")
def _(fx):
    return P.post_projection(metrics(fx))


# --- joins -----------------------------------------------------------------------------------
@query("latest_snapshot_join", f"""with {LATEST} select p.post_id, p.account_id, l.captured_at, l.likes,
 l.comments_count, l.shares, l.saves, l.reach, l.impressions, l.video_views, l.clicks
 from fx_posts p join latest l on l.post_id = p.post_id""")
def _(fx):
    newest = P.latest_snapshot(fx["fx_snapshots"], ORDERS_AS_OF)
    return fx["fx_posts"].select("post_id", "account_id").join(newest, "post_id")


@query("bucketed_snapshot_join", f"""with {LATEST} select p.post_id, p.account_id, l.captured_at, l.likes,
 l.comments_count, l.shares, l.saves, l.reach, l.impressions, l.video_views, l.clicks
 from fx_posts p join latest l on l.post_id = p.post_id""")
def _(fx):
    # as stored tables hold them: no shuffle on post_id in the join or in the aggregation below it
    held, names = {}, ("fx_posts", "fx_snapshots")
    for name in names:
        fx.keep(name)
    buckets = LY.bucket_count(*[fx[name] for name in names])
    for name in names:
        path = shared_dir(fx.spark, name)
        held[name] = LY.write_bucketed(fx[name], path, path.rsplit("/", 1)[1].replace("-", "_"), ["post_id"], buckets)
    newest = P.latest_snapshot(held["fx_snapshots"], ORDERS_AS_OF)
    return held["fx_posts"].select("post_id", "account_id").join(newest, "post_id")


@query("clustered_window_filter", f"""select post_id, account_id, published_at from fx_posts
 where published_at >= {O_SINCE} and published_at < {O_UNTIL} and account_id in (4, 7, 10, 13)""")
def _(fx):
    path = shared_dir(fx.spark, "clustered")
    LY.write_clustered(fx["fx_posts"].select("post_id", "account_id", "published_at"), path, ["account_id", "published_at"], files=16)
    posts = P.scope_filter(fx.spark.read.parquet(path), account_ids=[4, 7, 10, 13])
    return P.window_filter(posts, "published_at", ORDERS_AS_OF, "730d")


# platform ids by the name's place, as a seeded lookup table would hold them
_PLATFORMS = """select distinct c_mktsegment as name, cast(length(c_mktsegment) * 100 + ascii(c_mktsegment) as bigint) as id
 from customer"""
_ACCOUNTS = """select c_custkey as account_id, c_name as handle, concat('Mr ', c_name) as display_name,
 cast(floor(c_acctbal) as bigint) as followers_count,
 cast(length(c_mktsegment) * 100 + ascii(c_mktsegment) as bigint) as platform_id from customer"""


@query("post_account_platform_join", f"""with a as ({_ACCOUNTS}), pf as ({_PLATFORMS})
 select p.post_id, p.account_id, a.handle, pf.name as platform from fx_posts p
 join a on a.account_id = p.account_id join pf on pf.id = a.platform_id""")
def _(fx):
    named = P.list_accounts(fx.sql(_ACCOUNTS), fx.sql(_PLATFORMS))
    return fx["fx_posts"].select("post_id", "account_id").join(
        named.select("account_id", "handle", "platform"), "account_id")


@query("list_accounts", f"""with a as ({_ACCOUNTS}), pf as ({_PLATFORMS})
 select a.account_id, a.handle, a.display_name, a.followers_count as followers, pf.name as platform
 from a join pf on pf.id = a.platform_id""")
def _(fx):
    return P.list_accounts(fx.sql(_ACCOUNTS), fx.sql(_PLATFORMS))


@query("resolve_followers", f"""with near as (
  select account_id, followers_count, row_number() over (partition by account_id
   order by abs(epoch_us(captured_at) - epoch_us({E_UNTIL})), captured_at) as rn
  from fx_follower_snapshots
  where captured_at between {E_UNTIL} - interval 7 day and {E_UNTIL})
 select a.account_id, coalesce(n.followers_count, a.followers_count) as followers,
  case when n.followers_count is not null then 'snapshot' when a.followers_count is not null then 'account_latest'
   else 'unavailable' end as followers_basis
 from fx_accounts a left join near n on n.account_id = a.account_id and n.rn = 1""")
def _(fx):
    return P.resolve_followers(fx["fx_accounts"], fx["fx_follower_snapshots"], EVENTS_AS_OF).select(
        "account_id", "followers", "followers_basis")


@query("followers_asof_publish", """with b as (
  select p.post_id, s.followers_count, s.captured_at from fx_timed_posts p
  asof join fx_follower_snapshots s on s.account_id = p.account_id and s.captured_at <= p.published_at),
 f as (select p.post_id, s.followers_count, s.captured_at from fx_timed_posts p
  asof join fx_follower_snapshots s on s.account_id = p.account_id and s.captured_at >= p.published_at),
 j as (select p.*, b.followers_count as bc, epoch_us(p.published_at) - epoch_us(b.captured_at) as bd,
  f.followers_count as fc, epoch_us(f.captured_at) - epoch_us(p.published_at) as fd
  from fx_timed_posts p left join b on b.post_id = p.post_id left join f on f.post_id = p.post_id),
 n as (select *, case when bd is not null and (fd is null or bd <= fd) then case when bd <= 604800000000 then bc end
  when fd <= 604800000000 then fc end as near from j)
 select n.post_id, n.account_id, n.published_at, coalesce(n.near, a.followers_count) as followers,
  case when n.near is not null then 'snapshot' when a.followers_count is not null then 'account_latest'
   else 'unavailable' end as followers_basis
 from n left join fx_accounts a on a.account_id = n.account_id""")
def _(fx):
    posts = fx["fx_timed_posts"].select("post_id", "account_id", "published_at")
    return P.followers_asof_publish(posts, fx["fx_follower_snapshots"], fx["fx_accounts"])


_LABELED = "select comment_id, language, sentiment from fx_comments where sentiment is not null"


@query("unlabeled_comments_anti", f"""with a as ({_LABELED}) select comment_id, account_id, text_content
 from fx_comments c where not exists (select 1 from a where a.comment_id = c.comment_id)""")
def _(fx):
    comments = fx["fx_comments"].select("comment_id", "account_id", "text_content")
    return S.unlabeled_comments(comments, fx.sql(_LABELED))


# comments of a post: events stand in, their post is an order
_POST_COMMENTS = """select event_id as comment_id, event_id % 700 as post_id, ts as published_at,
 case when event_id % 40 = 0 then '  ' else concat('comment ', cast(event_id as string)) end as text_content from events"""
_ANALYSES = """select event_id as comment_id, event_type as sentiment, cast(value as double) as sentiment_score
 from events where event_type <> 'purchase'"""


@query("comment_post_analysis_join", f"""with c as ({_POST_COMMENTS}), a as ({_ANALYSES})
 select c.comment_id, p.account_id, c.published_at, a.sentiment, a.sentiment_score
 from c join fx_posts p on p.post_id = c.post_id left join a on a.comment_id = c.comment_id
 where c.published_at >= {E_SINCE} and c.published_at < {E_UNTIL} and trim(c.text_content) <> ''""")
def _(fx):
    until = P.moment(EVENTS_AS_OF)
    rows = S.labeled_rows(fx.sql(_POST_COMMENTS), fx.sql(_ANALYSES), fx["fx_posts"],
                          until - P.parse_window("14d"), until, keep_unlabeled=True)
    return rows.select("comment_id", "account_id", "published_at", "sentiment", "sentiment_score")


@query("topic_comment_link", f"""with assigned as ({ASSIGNED}), a as ({_LABELED}),
 sizes as (select account_id, cluster_id, count(*) as size, sum(count(*)) over (partition by account_id) as docs
  from assigned group by 1, 2),
 ok as (select * from sizes where docs >= 20 and size >= 3 and cluster_id <> -1)
 select a.comment_id, a.language, a.sentiment, ok.cluster_id as topic_id from a
 left join assigned s on s.comment_id = a.comment_id
 left join ok on ok.account_id = s.account_id and ok.cluster_id = s.cluster_id""")
def _(fx):
    assigned = fx.sql(ASSIGNED)
    return TP.topic_comment_link(fx.sql(_LABELED), assigned, TP.usable_clusters(assigned))


@query("baseline_join", f"""with {FACTS}, g as (select account_id, coalesce(content_type, 'unknown') as key,
  count(er) as n, {isum('round(er * 100)')} as s from facts group by 1, 2),
 b as (select account_id, sum(s) / 100.0 / sum(n) as baseline from g group by 1 having sum(n) > 0)
 select g.account_id, g.key, g.n, {rd('g.s / 100.0 / g.n', 4)} as mean_er, {rd('b.baseline', 4)} as baseline_er,
  case when b.baseline > 0 then {rd(rd('g.s / 100.0 / g.n', 4) + ' / b.baseline')} end as lift
 from g join b on b.account_id = g.account_id where g.n > 0""")
def _(fx):
    from agorametrics.functions.metric import cents, round_dp
    from agorametrics.operators.recommend import lift

    facts = K.with_primary_er(metrics(fx))
    groups = facts.groupBy("account_id", F.coalesce("content_type", F.lit("unknown")).alias("key")).agg(
        F.count("er").alias("n"), F.sum(cents(F.col("er"))).alias("s"))
    base = groups.groupBy("account_id").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s")).filter(
        F.col("_n") > 0).withColumn("_base", F.col("_s") / 100.0 / F.col("_n"))
    joined = groups.filter(F.col("n") > 0).join(base, "account_id").withColumn(
        "_mean", F.col("s") / 100.0 / F.col("n")).withColumn("mean_er", round_dp("_mean", 4))
    return joined.select("account_id", "key", "n", "mean_er", round_dp("_base", 4).alias("baseline_er"),
                         lift(F.col("mean_er"), F.col("_base")).alias("lift"))


# --- post KPIs -------------------------------------------------------------------------------
@query("engagement", f"with {POST_METRICS} select post_id, engagement from pm")
def _(fx):
    return metrics(fx).select("post_id", "engagement")


def _kpi(name: str):
    value, reason = KPI_SQL[name]

    @query(name, f"with {POST_METRICS} select post_id, {value} as {name}, {reason} as {name}_reason from pm")
    def _(fx):
        return K.compute_post_kpis(metrics(fx), [name])


for _name in KPI_SQL:
    _kpi(_name)


@query("compute_post_kpis", f"with {POST_METRICS} select post_id, {kpi_select()} from pm")
def _(fx):
    return K.compute_post_kpis(metrics(fx))


@query("primary_engagement_rate", f"with {FACTS} select post_id, er, er_basis, er_reason from facts")
def _(fx):
    return K.with_primary_er(metrics(fx)).select("post_id", "er", "er_basis", "er_reason")


@query("engagement_velocity", f"""with life as (select s.post_id, s.captured_at, p.published_at,
  s.likes + s.comments_count + s.shares + s.saves as e from fx_snapshots s join fx_posts p on p.post_id = s.post_id
  where s.captured_at >= p.published_at),
 g as (select post_id, count(*) as n_snapshots, arg_max(e, captured_at) as total_engagement,
  case when count(*) >= 2 then arg_max(e, captured_at) filter (captured_at <= published_at + interval 24 hour) end
   as first_24h_engagement from life group by 1)
 select post_id, n_snapshots, first_24h_engagement, total_engagement,
  case when total_engagement > 0 then {rd('first_24h_engagement / total_engagement', 4)} end as engagement_velocity,
  case when total_engagement is null or total_engagement <= 0 then 'non_positive_denominator'
   when first_24h_engagement is null then 'insufficient_snapshots' end as engagement_velocity_reason from g""")
def _(fx):
    return K.engagement_velocity(fx["fx_posts"], fx["fx_snapshots"])
