"""Sources, sinks, upserts, incremental and streaming jobs (sections 2.1, 2.3, 2.10, 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics import vocab
from agorametrics.functions import text as X
from agorametrics.operators import ingest as I
from agorametrics.operators import posts as P
from agorametrics.operators import recommend as R
from agorametrics.operators import rollup as RU
from agorametrics.operators import sentiment as S
from agorametrics.operators import topics as TP
from agorametrics.plans.account_queries import rank_sql
from agorametrics.plans.fixtures import EVENTS_AS_OF
from agorametrics.plans.post_queries import _CURSORS, _NEGATIVE, ASSIGNED, GATE_AS_OF
from agorametrics.plans.registry import isum, query, rd, ts
from agorametrics.plans.text_queries import _LABEL_MAP, _MAPPED, _ROLLUP, NEGATIVE_ALERTS, _ordered_distinct, scored_sql
from agorametrics.schemas import COUNT_COLUMNS
from agorametrics.session import materialize, scratch, shared_dir
from agorametrics.sources import csv_export as C
from agorametrics.sources import payloads as PL
from agorametrics.sources import sinks as SK
from agorametrics.sources import store as ST
from agorametrics.sources.keyed import KeyedTable
from agorametrics.streaming import jobs as J

EXPORT_AS_OF = "2026-07-10 00:00:00"
EXPORT_ROWS = 200_000  # of a file


# --- CSV exports -----------------------------------------------------------------------------
def _export(fx) -> DataFrame:
    """The export as CSV files in order; every other one has its columns the other way round. Files have a bounded size."""
    path = shared_dir(fx.spark, "export")
    parts = max(4, -(-fx.table("orders").count() // EXPORT_ROWS))
    rows = fx["fx_export"].drop("order_key").repartitionByRange(parts, "_ord").sortWithinPartitions("_ord")
    rows = materialize(rows.withColumn("_half", F.spark_partition_id() % 2), "export")
    for half, columns in enumerate((rows.columns[:-1], rows.columns[-2::-1])):
        rows.filter(F.col("_half") == half).sortWithinPartitions("_ord").select(*columns).write.csv(
            f"{path}/half={half}", header=True, escape='"')
    return C.csv_profile_scan(fx.spark, f"{path}/half=*")


_MAPPED_EXPORT = """select _ord, "Post ID" as external_id, "Page ID" as account_external_id, "Page name" as account_name,
 "Publish time" as published_at, "Post type" as content_type, "Title" as text_content, "Permalink" as permalink,
 "Reactions" as likes, "Comments" as comments_count, "Shares" as shares, "Reach" as reach, "Link clicks" as clicks
 from fx_export where "Page ID" is not null"""
_TUNIS = "timezone('UTC', timezone('Africa/Tunis', try_cast(published_at as timestamp)))"
_PUBLISHED = f"""case _ord % 6 when 1 then {_TUNIS} when 3 then {_TUNIS} when 4 then {_TUNIS}
 when 2 then try_cast(left(published_at, 19) as timestamp) - interval 3 hour
 when 5 then try_cast(left(published_at, 19) as timestamp) end"""
_TIMED_EXPORT = f"""timed as (select *, coalesce(external_id, account_external_id || ':' ||
  strftime(utc, '%Y-%m-%dT%H:%M:%S+00:00')) as post_external_id
 from (select *, {_PUBLISHED} as utc from ({_MAPPED_EXPORT})) where utc is not null)"""


@query("csv_profile_scan", f"""select _ord as ord, 'facebook' as platform, external_id, account_external_id, account_name, published_at,
 content_type, text_content, permalink, likes, comments_count, shares, reach, clicks,
 cast(null as varchar) as saves, cast(null as varchar) as impressions from ({_MAPPED_EXPORT})""")
def _(fx):
    mapped = _export(fx)
    return mapped.select(F.col("_ord").cast("bigint").alias("ord"), "platform", "external_id", "account_external_id",
                         "account_name", "published_at", "content_type", "text_content", "permalink", "likes",
                         "comments_count", "shares", "reach", "clicks", "saves", "impressions")


@query("csv_to_accounts", f"""select 'facebook' as platform, account_external_id as external_id, cast(null as varchar) as handle,
 arg_min(account_name, _ord) as display_name, cast(null as bigint) as followers_count, false as is_competitor
 from ({_MAPPED_EXPORT}) group by 2""")
def _(fx):
    return C.csv_to_accounts(_export(fx).withColumn("_ord", F.col("_ord").cast("bigint")), order="_ord")


@query("csv_to_posts", f"""with {_TIMED_EXPORT} select _ord as ord, account_external_id, 'facebook' as platform, post_external_id as external_id,
 utc as published_at, content_type, text_content, permalink, cast(0 as bigint) as media_count, false as is_synthetic from timed""")
def _(fx):
    return C.csv_to_posts(_export(fx)).withColumn("ord", F.col("_ord").cast("bigint")).drop("_ord", "_place")


@query("csv_to_snapshots", f"""with {_TIMED_EXPORT} select _ord as ord, post_external_id, account_external_id, 'facebook' as platform,
 {ts(EXPORT_AS_OF)} as captured_at, cast(coalesce(trunc(try_cast(likes as double)), 0) as bigint) as likes,
 cast(comments_count as bigint) as comments_count, cast(shares as bigint) as shares, cast(0 as bigint) as saves,
 cast(reach as bigint) as reach, cast(null as bigint) as impressions, cast(null as bigint) as video_views,
 cast(clicks as bigint) as clicks from timed""")
def _(fx):
    return C.csv_to_snapshots(_export(fx), EXPORT_AS_OF).withColumn("ord", F.col("_ord").cast("bigint")).drop("_ord", "_place")


_LABELED = """select case when event_id % 10 = 0 then '  ' else concat(' text, "', cast(event_id as string), '" ') end as text,
 case event_id % 6 when 0 then 'POS' when 1 then 'neg ' when 2 then '2' when 3 then 'unheard' when 4 then null else 'mixed' end as label
 from events"""


@query("labeled_csv_scan", f"""select trim(text) as text, {_LABEL_MAP}[lower(trim(label))] as label from ({_LABELED})
 where trim(text) <> '' and {_LABEL_MAP}[lower(trim(label))] is not null""")
def _(fx):
    path = shared_dir(fx.spark, "labeled")
    # blanks around a value are part of it, as in the files people keep
    fx.sql(_LABELED).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
                               ignoreTrailingWhiteSpace=False)
    return C.labeled_csv_scan(fx.spark, path)


# --- payloads --------------------------------------------------------------------------------
def _j(path: str) -> str:
    return f"json_extract_string(payload, '$.{path}')"


_VIDEO = "source = 'youtube'"
_BAD = """case when source = 'elsewhere' then 'unknown_source'
 when _ord % 37 = 0 or _ord % 43 = 0 or _ord % 47 = 0 then 'malformed_payload' end"""
_READ = f"(select * from fx_landing where {_BAD} is null)"
_POSTS = f"""select _ord, account_external_id, source as platform, external_id,
 case when {_VIDEO} then cast(replace({_j('contentDetails.videoPublishedAt')}, 'Z', '') as timestamp)
  else cast(left({_j('created_time')}, 19) as timestamp) end as published_at,
 case when {_VIDEO} then case when {_j('contentDetails.duration')} in ('PT45S', 'PT1M') then 'short' else 'video' end
  else case {_j('status_type')} when 'added_photos' then 'photo' when 'shared_story' then 'link' when 'mobile_status_update' then 'text'
   else {_j('status_type')} end end as content_type,
 case when {_VIDEO} then {_j('snippet.title')} || case when {_j('snippet.description')} = '' then '' else chr(10) || {_j('snippet.description')} end
  else {_j('message')} end as text_content,
 case when {_VIDEO} then 'https://www.youtube.com/watch?v=' || external_id else {_j('permalink_url')} end as permalink,
 cast(0 as bigint) as media_count, false as is_synthetic from {_READ} where entity_type = 'post'"""
_ACCOUNTS = f"""select _ord, source as platform, external_id,
 case when {_VIDEO} then coalesce(nullif({_j('snippet.customUrl')}, ''), {_j('snippet.title')}) else {_j('username')} end as handle,
 case when {_VIDEO} then {_j('snippet.title')} else {_j('name')} end as display_name,
 case when {_VIDEO} then cast({_j('statistics.subscriberCount')} as bigint)
  else coalesce(cast({_j('followers_count')} as bigint), cast({_j('fan_count')} as bigint)) end as followers_count,
 false as is_competitor from {_READ} where entity_type = 'account'"""
_METRICS = f"""select _ord, external_id as post_external_id, account_external_id, source as platform, captured_at,
 cast(case when {_VIDEO} then {_j('statistics.likeCount')} else {_j('engagement.likes.summary.total_count')} end as bigint) as likes,
 cast(case when {_VIDEO} then coalesce({_j('statistics.commentCount')}, '0') else {_j('engagement.comments.summary.total_count')} end as bigint) as comments_count,
 cast(case when {_VIDEO} then '0' else coalesce({_j('engagement.shares.count')}, '0') end as bigint) as shares, cast(0 as bigint) as saves,
 cast({_j('insights.data[1].values[0].value')} as bigint) as reach, cast({_j('insights.data[0].values[0].value')} as bigint) as impressions,
 cast({_j('statistics.viewCount')} as bigint) as video_views, cast({_j('insights.data[2].values[0].value')} as bigint) as clicks
 from {_READ} where entity_type = 'metric'"""
_COMMENTS = f"""select _ord, post_external_id, account_external_id, source as platform,
 case when {_VIDEO} then {_j('snippet.topLevelComment.id')} else {_j('id')} end as external_id,
 case when {_VIDEO} then {_j('snippet.topLevelComment.snippet.textDisplay')} else {_j('message')} end as text_content,
 case when {_VIDEO} then timestamp '2024-01-02 09:00:00' else timestamp '2024-01-03 09:00:00' end as published_at,
 cast(case when {_VIDEO} then {_j('snippet.topLevelComment.snippet.likeCount')} else {_j('like_count')} end as bigint) as like_count,
 case when {_VIDEO} then {_j('snippet.topLevelComment.snippet.authorChannelId.value')} else {_j('from.id')} end as author_external_id,
 false as is_synthetic from {_READ} where entity_type = 'comment'"""


@query("payload_accounts", f"select * exclude (_ord), _ord as ord from ({_ACCOUNTS})")
def _(fx):
    return PL.payload_accounts(fx["fx_landing"]).withColumnRenamed("_ord", "ord")


@query("payload_posts", f"select * exclude (_ord), _ord as ord from ({_POSTS})")
def _(fx):
    return PL.payload_posts(fx["fx_landing"]).withColumnRenamed("_ord", "ord")


@query("payload_snapshots", f"select * exclude (_ord), _ord as ord from ({_METRICS})")
def _(fx):
    return PL.payload_snapshots(fx["fx_landing"]).withColumnRenamed("_ord", "ord")


@query("payload_comments", f"select * exclude (_ord), _ord as ord from ({_COMMENTS})")
def _(fx):
    return PL.payload_comments(fx["fx_landing"]).withColumnRenamed("_ord", "ord")


_ENTITY_NAMES = "case entity_type when 'account' then 'accounts' when 'post' then 'posts' when 'metric' then 'metrics' else 'comments' end"


@query("payload_rejects", f"""select _ord as ord, source, {_ENTITY_NAMES} as entity, {_BAD} as reason from fx_landing where {_BAD} is not null""")
def _(fx):
    return PL.payload_rejects(fx["fx_landing"]).select(F.col("_ord").alias("ord"), "source", "entity", "reason")


@query("payload_field_extract", "select id, source, entity_type, cast(json_extract(payload, '$.k') as bigint) as k from fx_raw_events")
def _(fx):
    return PL.payload_field(fx["fx_raw_events"], "$.k", "bigint", "k").select("id", "source", "entity_type", "k")


# --- sinks -----------------------------------------------------------------------------------
@query("raw_archive_sink", f"""select id, source, entity_type, external_id, payload, captured_at from fx_raw_events
 where captured_at >= {ts(EVENTS_AS_OF)} - interval 10 day""")
def _(fx):
    path = shared_dir(fx.spark, "archive")
    for _ in range(2):  # the second is a retry
        SK.archive_raw(fx["fx_raw_events"], path, "daily")
    return SK.read_archive(fx.spark, path, EVENTS_AS_OF, 10).drop("captured_date")


@query("daily_retention", f"""select cast(captured_at as date) as captured_date, count(*) as n from fx_raw_events
 where captured_at >= {ts(EVENTS_AS_OF)} - interval 7 day group by 1""")
def _(fx):
    path = shared_dir(fx.spark, "archive")
    SK.archive_raw(fx["fx_raw_events"], path, "daily")
    SK.purge_archive(fx.spark, path, EVENTS_AS_OF, 7)
    # what is left on disk, and nothing older among it
    left = I.retained(fx.spark.read.parquet(path), EVENTS_AS_OF, 365)
    return left.groupBy("captured_date").agg(F.count(F.lit(1)).alias("n"))


# every line is a snapshot on its own: several share post and time
# some have no time, some no post
_LINES = """select case when l_partkey % 50 = 7 then null else l_orderkey end as post_id,
 case when l_suppkey % 40 = 3 then null else l_shipdate end as captured_at, cast(l_quantity as bigint) as likes,
 cast(l_linenumber as bigint) as comments_count, cast(1 as bigint) as shares, cast(0 as bigint) as saves,
 cast(floor(l_extendedprice) as bigint) as reach, cast(null as bigint) as impressions, cast(null as bigint) as video_views,
 cast(l_partkey as bigint) as clicks, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey as _ord from lineitem"""
_STORED = "select * from fx_snapshots where reach is null"
_COUNTS = ", ".join(COUNT_COLUMNS)


_LOST = "case when captured_at is null then 'missing_capture_time' when post_id is null then 'missing_post' end"


@query("snapshot_append_sink", f"""with stored as ({_STORED}), lines as (select *, {_LOST} as reason from ({_LINES}))
 select post_id, captured_at, {_COUNTS}, cast(null as varchar) as reason from stored
 union all (select post_id, captured_at, {_COUNTS}, reason from lines where reason is null and not exists (
  select 1 from stored where stored.post_id = lines.post_id and stored.captured_at = lines.captured_at)
 qualify row_number() over (partition by post_id, captured_at order by _ord) = 1)
 union all select post_id, captured_at, {_COUNTS}, reason from lines where reason is not null""")
def _(fx):
    path = shared_dir(fx.spark, "snapshots")
    columns = ["post_id", "captured_at", *COUNT_COLUMNS]
    stored = materialize(fx.sql(_STORED).select(*columns), "stored-snapshots")  # read several times
    SK.append_snapshots(stored.withColumn("_ord", F.lit(0)), path, unit="month", run="stored")
    for _ in range(2):  # the second is a retry
        SK.append_snapshots(fx.sql(_LINES).select(*columns, "_ord"), path, unit="month", run="lines")
    kept = fx.spark.read.parquet(path).select(*columns, F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(SK.rejected_snapshots(fx.spark, path).select(*columns, "reason"))


@query("recommendation_sink", f"""with {rank_sql('fx_facts', list(R.RULES))}
 select account_id, kind, max(case when rank = 1 then confidence end) as confidence, max(case when rank = 1 then key end) as top_key,
  count(key) as n_ranked, max(baseline_er) as baseline_er, max(reason) as reason from ranked group by 1, 2""")
def _(fx):
    path = shared_dir(fx.spark, "recommendations")
    for _ in range(2):  # the second is a retry
        SK.append_recommendations(R.all_recommendations(fx["fx_facts"]), path, EVENTS_AS_OF, "90d")
    stored = fx.spark.read.parquet(path)
    payload = F.from_json("payload", "ranked array<struct<key:string>>, reason string")
    evidence = F.from_json("evidence", "baseline_er double")
    return stored.select(
        "account_id", "kind", "confidence", F.get(payload["ranked"], 0)["key"].alias("top_key"),
        F.size(payload["ranked"]).alias("n_ranked"), evidence["baseline_er"].alias("baseline_er"),
        payload["reason"].alias("reason"))


@query("topic_replace_sink", f"""with assigned as ({ASSIGNED}), {_ROLLUP}
 select account_id, cluster_id, case when account_id = 1 then comment_count + 1000 else comment_count end as comment_count,
  date '2024-01-01' as window_start, date '2024-01-31' as window_end from topics""")
def _(fx):
    path = shared_dir(fx.spark, "topics")
    topics = materialize(TP.topic_rollup(fx.sql(ASSIGNED)).select("account_id", "cluster_id", "comment_count"), "rollup")
    window = ("2024-01-01", "2024-01-31")
    SK.replace_topics(topics, None, topics, path, *window)
    # a second run for one account replaces that account's topics only
    again = topics.filter(F.col("account_id") == 1).withColumn("comment_count", F.col("comment_count") + 1000)
    SK.replace_topics(again, fx.spark.read.parquet(path), again, path, *window)
    return fx.spark.read.parquet(path)


# --- upserts ---------------------------------------------------------------------------------
def upsert_sql(target: str, batch: str, keys: list[str], updates, columns: list[str]) -> str:
    """The upsert as last and first row per key of the batch, full-joined with the target."""
    k = ", ".join(keys)
    whole = " and ".join(f"{c} is not null" for c in keys)
    same = " and ".join(f"t.{c} = l.{c}" for c in keys)
    same_f = " and ".join(f"f.{c} = l.{c}" for c in keys)
    picks = []
    for c in columns:
        if c in keys:
            picks.append(f"coalesce(t.{c}, l.{c}) as {c}")
        elif c in updates:
            picks.append(f"case when l.{keys[0]} is not null then l.{c} else t.{c} end as {c}")
        else:
            picks.append(f"case when t.{keys[0]} is not null then t.{c} else f.{c} end as {c}")
    listed = ", ".join(columns)
    return f"""with t as ({target}), b as ({batch}),
 l as (select * from b where {whole} qualify row_number() over (partition by {k} order by _ord desc) = 1),
 f as (select * from b where {whole} qualify row_number() over (partition by {k} order by _ord) = 1)
 select {', '.join(picks)} from t full join l on {same} left join f on {same_f}
 union all select {listed} from b where not ({whole})"""


def _upserted(fx, entity: str, old: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The table after the batch, which comes in two parts by order, each of them twice, with the first folded into the base."""
    table = KeyedTable(shared_dir(fx.spark, entity), tuple(keys), tuple(I.UPDATES[entity])).create(fx.spark, old.select(*columns).schema)
    table.append(old.select(*columns, F.lit(0).alias("_ord")), 0)
    batch = materialize(batch.select(*columns, "_ord"), "batch")
    cut = batch.agg(F.percentile_approx("_ord", 0.5).alias("cut")).first().cut
    for version, part in ((1, F.col("_ord") <= cut), (3, F.col("_ord") > cut)):
        for _ in range(2):  # the second is a retry
            table.append(batch.filter(part), version)
        table.compact(fx.spark, version + 1, share=0.0 if version == 1 else 100.0)
    return table.read(fx.spark).select(*columns)


_ACCOUNT_COLUMNS = ["account_id", "platform", "external_id", "handle", "display_name", "followers_count", "is_competitor"]


@query("upsert_accounts", upsert_sql("select * from stg_accounts_old", "select * from stg_accounts", ["platform", "external_id"],
                                     I.UPDATES["accounts"], _ACCOUNT_COLUMNS))
def _(fx):
    return _upserted(fx, "accounts", fx["stg_accounts_old"], fx["stg_accounts"], ["platform", "external_id"], _ACCOUNT_COLUMNS)


_POST_TARGET = """select o_orderkey as post_id, o_custkey as account_id, cast(o_orderkey as string) as external_id,
 o_orderdate as published_at, 'photo' as content_type, 'old' as text_content, '#old' as hashtags, cast(1 as bigint) as media_count,
 'old' as permalink, false as is_synthetic from orders where o_orderstatus <> 'F'"""
# lines of an order may share number, part and supplier: the date is needed for an order without ties
_POST_BATCH = """select o_orderkey as post_id, o_custkey as account_id, cast(o_orderkey as string) as external_id,
 l_shipdate as published_at, l_returnflag as content_type,
 case when l_linestatus = 'O' then null else concat('line ', cast(l_linenumber as string)) end as text_content,
 l_linestatus as hashtags, cast(l_linenumber as bigint) as media_count, cast(l_partkey as string) as permalink, true as is_synthetic,
 l_linenumber * 1000000000000000000 + l_partkey * 10000000000
  + cast(extract(year from l_shipdate) * 400 + extract(doy from l_shipdate) as bigint) * 10000 + l_suppkey as _ord
 from lineitem join orders on o_orderkey = l_orderkey"""
_POST_COLUMNS = ["post_id", "account_id", "external_id", "published_at", "content_type", "text_content", "hashtags",
                 "media_count", "permalink", "is_synthetic"]


@query("upsert_posts", upsert_sql(_POST_TARGET, _POST_BATCH, ["account_id", "external_id"], I.UPDATES["posts"], _POST_COLUMNS))
def _(fx):
    return _upserted(fx, "posts", fx.sql(_POST_TARGET), fx.sql(_POST_BATCH), ["account_id", "external_id"], _POST_COLUMNS)


_COMMENT_BATCH = """select cast(post_external_id as bigint) as post_id, external_id, text_content, published_at, like_count,
 is_synthetic, _ord from stg_comments"""
_COMMENT_TARGET = """select event_id % 100 as post_id, concat('c', cast(event_id % 37 as string)) as external_id,
 min(concat('old ', event_type)) as text_content, min(ts) as published_at, cast(0 as bigint) as like_count, true as is_synthetic
 from events where event_type = 'view' group by 1, 2"""
_COMMENT_COLUMNS = ["post_id", "external_id", "text_content", "published_at", "like_count", "is_synthetic"]


@query("upsert_comments", upsert_sql(_COMMENT_TARGET, _COMMENT_BATCH, ["post_id", "external_id"], I.UPDATES["comments"],
                                     _COMMENT_COLUMNS))
def _(fx):
    return _upserted(fx, "comments", fx.sql(_COMMENT_TARGET), fx.sql(_COMMENT_BATCH), ["post_id", "external_id"], _COMMENT_COLUMNS)


_ANALYSIS_TARGET = """select comment_id, language, sentiment, sentiment_score, 'old' as model_name, '0' as model_version,
 cast(null as timestamp) as analyzed_at, cast(7 as bigint) as topic_id from fx_day_sentiment where sentiment <> 'neutral'"""
_ANALYSIS_BATCH = """select comment_id % 3000 as comment_id, language, sentiment, sentiment_score, 'new' as model_name,
 '1' as model_version, published_at as analyzed_at, cast(null as bigint) as topic_id, comment_id as _ord from fx_day_sentiment"""
_ANALYSIS_COLUMNS = ["comment_id", "language", "sentiment", "sentiment_score", "model_name", "model_version", "analyzed_at",
                     "topic_id"]


@query("upsert_analyses", upsert_sql(_ANALYSIS_TARGET, _ANALYSIS_BATCH, ["comment_id"], I.UPDATES["analyses"], _ANALYSIS_COLUMNS))
def _(fx):
    return _upserted(fx, "analyses", fx.sql(_ANALYSIS_TARGET), fx.sql(_ANALYSIS_BATCH), ["comment_id"], _ANALYSIS_COLUMNS)


# --- resolution and reports ------------------------------------------------------------------
_POST_TABLE = "select post_id, account_id, cast(post_id as string) as external_id from fx_posts"
_POST_GATE = f"""case when published_at > {ts(GATE_AS_OF)} + interval 5 minute then 'future_timestamp'
 when media_count < 0 then 'negative_media_count' end"""
_METRIC_GATE = f"""case when captured_at > {ts(GATE_AS_OF)} + interval 5 minute then 'future_timestamp' {_NEGATIVE} end"""
_REASONS = f"""reasons as (
 select 'posts' as entity, s.external_id, cast(null as timestamp) as captured_at,
  coalesce({_POST_GATE}, case when a.account_id is null then 'unknown_account' end) as reason
 from stg_posts s left join stg_accounts_old a on a.external_id = s.account_external_id and a.platform = s.platform
 union all select 'metrics', m.post_external_id, m.captured_at,
  coalesce({_METRIC_GATE}, case when p.post_id is null then 'unknown_post' end)
 from stg_metrics m left join stg_accounts_old a on a.external_id = m.account_external_id and a.platform = m.platform
 left join ({_POST_TABLE}) p on p.account_id = a.account_id and p.external_id = m.post_external_id)"""


def _staged(fx) -> DataFrame:
    accounts = fx["stg_accounts_old"]
    posts = I.stage_posts(fx["stg_posts"], accounts, GATE_AS_OF)
    metrics = I.stage_metrics(fx["stg_metrics"], accounts, fx.sql(_POST_TABLE), GATE_AS_OF)
    return posts.select(F.lit("posts").alias("entity"), "external_id", F.lit(None).cast("timestamp").alias("captured_at"),
                        "reason").unionByName(metrics.select(
                            F.lit("metrics").alias("entity"), F.col("post_external_id").alias("external_id"), "captured_at", "reason"))


@query("key_resolution_skips", f"with {_REASONS} select * from reasons")
def _(fx):
    return _staged(fx)


@query("ingest_skip_report", f"with {_REASONS} select entity, reason, count(*) as n from reasons where reason is not null group by 1, 2")
def _(fx):
    return I.skip_report(_staged(fx))


_STATUS = {"accounts": "fx_accounts", "posts": "fx_posts", "post_metric_snapshots": "fx_snapshots", "comments": "fx_comments"}


@query("ingestion_status", " union all ".join(
    f"select '{name}' as table_name, count(*) as n_rows from {view}" for name, view in _STATUS.items()))
def _(fx):
    return I.ingestion_status({name: fx[view] for name, view in _STATUS.items()})


@query("advance_cursors", f"""with c as ({_CURSORS}), s as (select distinct source, entity_type from fx_raw_events where entity_type <> 'metric')
 select source, entity_type, case when s.source is not null then {ts(EVENTS_AS_OF)} else c.cursor_value end as cursor_value
 from c full join s using (source, entity_type)""")
def _(fx):
    seen = fx["fx_raw_events"].filter(F.col("entity_type") != "metric").select("source", "entity_type").distinct()
    return I.advance_cursors(fx.sql(_CURSORS), seen, ["source", "entity_type"], EVENTS_AS_OF)


# a resend of part of the snapshots inside one batch
_METRIC_BATCH = """select * from stg_metrics union all
 select post_external_id, account_external_id, platform, captured_at, likes, comments_count, shares, saves, reach, impressions,
 video_views, clicks, _ord + 1000000 as _ord from stg_metrics where comments_count >= 5"""


_STORED_COLUMNS = {
    "accounts": "account_id string, platform string, external_id string, handle string, display_name string, followers_count bigint, is_competitor boolean",
    "posts": "post_id string, account_id string, external_id string, published_at timestamp, content_type string, text_content string, "
             "hashtags array<string>, media_count bigint, permalink string, is_synthetic boolean",
    "snapshots": "post_id string, captured_at timestamp, " + ", ".join(f"{c} bigint" for c in COUNT_COLUMNS),
    "comments": "comment_id string, post_id string, external_id string, author_hash string, text_content string, published_at timestamp, "
                "like_count bigint, is_synthetic boolean",
}


@query("normalize_and_store", f"""with acc as (select distinct platform, external_id from stg_accounts),
 p as (select s.*, coalesce({_POST_GATE}, case when a.external_id is null then 'unknown_account' end) as reason
  from stg_posts s left join acc a on a.external_id = s.account_external_id),
 ok as (select distinct account_external_id, external_id from p where reason is null),
 m as (select b.*, coalesce({_METRIC_GATE}, case when ok.external_id is null then 'unknown_post' end) as reason
  from ({_METRIC_BATCH}) b left join ok on ok.account_external_id = b.account_external_id and ok.external_id = b.post_external_id),
 c as (select case when ok.external_id is null then 'unknown_post' end as reason from stg_comments s
  left join ok on ok.account_external_id = s.account_external_id and ok.external_id = s.post_external_id)
 select 'accounts' as entity, 'stored' as reason, count(*) as n from stg_accounts
 union all select 'posts', coalesce(reason, 'stored'), count(*) from p group by 2
 union all select 'metrics', reason, count(*) from m where reason is not null group by 2
 union all select 'metrics', 'stored', count(*) from (select distinct post_external_id, captured_at from m where reason is null)
 union all select 'metrics', 'duplicate_snapshot', count(*) - count(distinct (post_external_id, captured_at)) from m where reason is null
  having count(*) > count(distinct (post_external_id, captured_at))
 union all select 'comments', coalesce(reason, 'stored'), count(*) from c group by 2""")
def _(fx):
    with scratch():
        return ST.store_batch(_batch(fx), _store(fx, {}), GATE_AS_OF, 1)


def _batch(fx) -> dict[str, DataFrame]:
    with scratch() as keep:
        keep(fx.keep("stg_metrics"))  # the batch reads it twice
        frames = {"accounts": fx["stg_accounts"].drop("account_id"), "posts": fx["stg_posts"], "comments": fx["stg_comments"]}
        out = {name: keep(materialize(df, f"batch-{name}", "zstd")) for name, df in frames.items()}
        return out | {"metrics": fx.sql(_METRIC_BATCH)}  # of stored rows


def _store(fx, old: dict[str, DataFrame]) -> dict[str, KeyedTable]:
    """Keyed tables that hold these rows."""
    tables = ST.keyed_tables(shared_dir(fx.spark, "store"))
    for name, columns in _STORED_COLUMNS.items():
        tables[name].create(fx.spark, columns)
        if name in old:
            with scratch():
                tables[name].append(old[name].withColumn("_ord", F.lit(0)), 0)
    return tables


# --- the four stored tables after a batch on tables that hold rows already -------------------
def id_sql(*keys: str) -> str:
    parts = ", ".join(f"coalesce(length(cast({k} as string)) || ':' || cast({k} as string), '-')" for k in keys)
    return f"md5(concat_ws('|', {parts}))"


_OLD_ACCOUNTS = "select platform, external_id, handle, display_name, followers_count, is_competitor from stg_accounts_old"
_OLD_POSTS = """select 'facebook' as platform, cast(o_custkey as string) as account_external_id, cast(o_orderkey as string) as external_id,
 o_orderdate as published_at, 'old' as content_type, 'kept text' as text_content, cast(3 as bigint) as media_count, 'old link' as permalink,
 false as is_synthetic from orders where o_orderkey % 3 = 0"""
_OLD_SNAPSHOTS = """select post_external_id, account_external_id, captured_at, likes + 1000 as likes, comments_count, shares, saves, reach,
 impressions, video_views, clicks from stg_metrics where _ord > 20 and post_external_id <> 'gone' and cast(post_external_id as bigint) % 3 = 0"""
_OLD_COMMENTS = """select cast(o_orderkey as string) as post_external_id, cast(o_custkey as string) as account_external_id,
 concat('c', cast(o_orderkey % 40 as string)) as external_id, 'old hash' as author_hash, 'old comment' as text_content,
 o_orderdate as published_at, cast(1 as bigint) as like_count, true as is_synthetic from orders where o_orderkey < 100 and o_orderkey % 3 = 0"""
_ACC_ID = id_sql("'facebook'", "account_external_id")
_POST_ID = id_sql(_ACC_ID, "post_external_id")
_TABLES = {
    "accounts": ("account_id", ["account_id", "platform", "external_id", "handle", "display_name", "followers_count", "is_competitor"]),
    "posts": ("post_id", ["post_id", "account_id", "external_id", "published_at", "content_type", "text_content", "hashtags",
                          "media_count", "permalink", "is_synthetic"]),
    "snapshots": ("post_id", ["post_id", "captured_at", *COUNT_COLUMNS]),
    "comments": ("comment_id", ["comment_id", "post_id", "external_id", "author_hash", "text_content", "published_at", "like_count",
                                "is_synthetic"]),
}


def _flat_sql(entity: str, source: str) -> str:
    key, columns = _TABLES[entity]
    text = ", ".join(f"coalesce(cast({f'epoch_us({c})' if c.endswith('_at') else c} as varchar), '~')" for c in columns if c != key)
    return f"select '{entity}' as entity, {key} as id, concat_ws('|', {text}) as content from ({source})"


_STORED_ACCOUNTS = upsert_sql(
    f"select {id_sql('platform', 'external_id')} as account_id, * from ({_OLD_ACCOUNTS})",
    f"select * exclude (account_id), {id_sql('platform', 'external_id')} as account_id from stg_accounts",
    ["platform", "external_id"], I.UPDATES["accounts"], _TABLES["accounts"][1])
_TAGS = r"list_transform(regexp_extract_all(coalesce(text_content, ''), '#[\p{L}\p{N}_\x{600}-\x{6ff}]+'), lambda x: lower(x))"
_STORED_POSTS = upsert_sql(
    f"""select {id_sql(_ACC_ID, 'external_id')} as post_id, {_ACC_ID} as account_id, external_id, published_at, content_type, text_content,
 '#old' as hashtags, media_count, permalink, is_synthetic from ({_OLD_POSTS})""",
    f"""select {id_sql(_ACC_ID, 'external_id')} as post_id, {_ACC_ID} as account_id, external_id, published_at, {_MAPPED} as content_type, text_content,
 {_ordered_distinct(_TAGS)} as hashtags, media_count, permalink, is_synthetic, _ord from stg_posts
 where {_POST_GATE} is null and {_ACC_ID} in (select account_id from acc)""",
    ["account_id", "external_id"], I.UPDATES["posts"], _TABLES["posts"][1])
_STORED_SNAPSHOTS = f"""with old as (select {_POST_ID} as post_id, captured_at, {_COUNTS} from ({_OLD_SNAPSHOTS}))
 select * from old union all select post_id, captured_at, {_COUNTS} from (select {_POST_ID} as post_id, * from ({_METRIC_BATCH}))
 where {_METRIC_GATE} is null and post_id in (select post_id from posts_now)
  and (post_id, captured_at) not in (select (post_id, captured_at) from old)
 qualify row_number() over (partition by post_id, captured_at order by _ord) = 1"""
_KEYLESS = "length(cast(published_at as string)) || ':' || cast(published_at as string), length(text_content) || ':' || text_content, length(cast(_ord as string)) || ':' || cast(_ord as string)"
_STORED_COMMENTS = upsert_sql(
    f"""select {id_sql('post_id', 'external_id')} as comment_id, * from (select {_POST_ID} as post_id, external_id, author_hash, text_content, published_at,
 like_count, is_synthetic from ({_OLD_COMMENTS}))""",
    f"""select case when external_id is null then md5(concat_ws('|', length(post_id) || ':' || post_id, '-', {_KEYLESS})) else {id_sql('post_id', 'external_id')} end as comment_id, *
 from (select {_POST_ID} as post_id, external_id, case when author_external_id <> '' then sha256(author_external_id) end as author_hash,
  text_content, published_at, like_count, is_synthetic, _ord from stg_comments) where post_id in (select post_id from posts_now)""",
    ["post_id", "external_id"], I.UPDATES["comments"], _TABLES["comments"][1])


@query("normalized_tables", f"""with acc as ({_STORED_ACCOUNTS}), posts_now as ({_STORED_POSTS})
 {_flat_sql('accounts', 'select * from acc')} union all {_flat_sql('posts', 'select * from posts_now')}
 union all {_flat_sql('snapshots', _STORED_SNAPSHOTS)} union all {_flat_sql('comments', _STORED_COMMENTS)}""")
def _(fx):
    with scratch():  # what is left are the tables
        stored = _after_batch(fx)
    out = None
    for name, (key, columns) in _TABLES.items():
        texts = [F.unix_micros(c) if c.endswith("_at") else F.array_join(c, " ") if c == "hashtags" else F.col(c) for c in columns if c != key]
        part = stored[name].read(fx.spark).select(F.lit(name).alias("entity"), F.col(key).alias("id"),
                                   F.concat_ws("|", *[F.coalesce(t.cast("string"), F.lit("~")) for t in texts]).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def _after_batch(fx) -> dict[str, KeyedTable]:
    """Tables with rows, after a batch and its retry."""
    def owned(df):
        return df.withColumn("account_id", I.new_ids(df, ["platform", "account_external_id"]))

    def of_post(df):
        with_account = owned(df.withColumn("platform", F.lit("facebook")))
        return with_account.withColumn("post_id", I.new_ids(with_account, ["account_id", "post_external_id"]))

    with scratch() as keep:
        keep(fx.keep("stg_metrics"))  # the stored rows and the batch are made of it
    accounts = fx.sql(_OLD_ACCOUNTS)
    posts = owned(fx.sql(_OLD_POSTS)).withColumn("hashtags", F.array(F.lit("#old")))
    comments = of_post(fx.sql(_OLD_COMMENTS))
    tables = {
        "accounts": accounts.withColumn("account_id", I.new_ids(accounts, ["platform", "external_id"])),
        "posts": posts.withColumn("post_id", I.new_ids(posts, ["account_id", "external_id"])),
        "snapshots": of_post(fx.sql(_OLD_SNAPSHOTS)),
        "comments": comments.withColumn("comment_id", I.new_ids(comments, ["post_id", "external_id"])),
    }
    stored = _store(fx, {name: df.select(*_TABLES[name][1]) for name, df in tables.items()})
    batch = _batch(fx)
    ST.store_batch(batch, stored, GATE_AS_OF, 1)
    stored["posts"].compact(fx.spark, 2, share=0.0)
    ST.store_batch(batch, stored, GATE_AS_OF, 1)  # a retry, even after the log was folded
    return stored


_GIVEN = """select comment_id, language, sentiment, cast(1.0 as double) as sentiment_score, 'given' as model_name, '1' as model_version,
 cast(null as timestamp) as analyzed_at from fx_comments where sentiment is not null"""


def _labels(fresh: DataFrame, as_of, backend) -> DataFrame:
    return S.score_sentiment(fresh.select("comment_id", "text_content"), backend).withColumns(
        {"analyzed_at": P.timestamp(as_of), "_ord": F.lit(0)})


def analyze_new_comments(comments: DataFrame, analyses: DataFrame, as_of, backend=None) -> DataFrame:
    """Label the comments that lack an analysis and upsert the result."""
    labels = _labels(S.unlabeled_comments(comments, analyses), as_of, backend)
    return I.upsert(analyses, labels, ["comment_id"], I.UPDATES["analyses"], "_ord")


def store_new_analyses(comments: DataFrame, analyses: KeyedTable, as_of, version: int, backend=None) -> None:
    """The same into a stored history, of which only files are read that may hold a comment's key."""
    analyses.append(_labels(analyses.missing(comments), as_of, backend), version)


@query("analyze_new_comments", f"""with src as (select comment_id, coalesce(text_content, '') as t from fx_comments), {scored_sql('src', 'comment_id')}
 select comment_id, case when g.comment_id is not null then g.language else d.language end as language,
  case when g.comment_id is not null then g.sentiment else d.sentiment end as sentiment,
  case when g.comment_id is not null then g.sentiment_score else d.sentiment_score end as sentiment_score,
  coalesce(g.model_name, 'lexicon') as model_name from scored d left join ({_GIVEN}) g using (comment_id)""")
def _(fx):
    given = fx.sql(_GIVEN)
    analyses = KeyedTable(shared_dir(fx.spark, "analyses"), ("comment_id",), tuple(I.UPDATES["analyses"])).create(fx.spark, given.schema)
    analyses.append(given.withColumn("_ord", F.lit(0)), 0)
    for _ in range(2):  # the second is a retry
        store_new_analyses(fx["fx_comments"], analyses, EVENTS_AS_OF, 1)
    return analyses.read(fx.spark).select("comment_id", "language", "sentiment", "sentiment_score", "model_name")


# --- rollups kept current --------------------------------------------------------------------
_ROLLED = """select user_id as account_id, case when user_id % 2 = 0 then 'facebook' else 'youtube' end as platform, ts,
 cast(floor(value * 100) as bigint) / 100 as value, event_id from events"""


@query("rollup_summary", f"""with v as ({_ROLLED}) select account_id, platform, count(*) as n, {rd('sum(cast(round(value * 100) as bigint)) / count(*) / 100.0', 4)} as mean,
 {rd('median(cast(round(value * 100) as bigint)) / 100', 4)} as median,
 {rd('sum(cast(round(value * 100) as bigint) * cast(round(value * 100) as bigint)) / count(*) / 10000.0', 4)} as second_moment
 from v where value is not null group by 1, 2""")
def _(fx):
    path, day = shared_dir(fx.spark, "rollup"), F.to_date("ts")
    rows = materialize(fx.sql(_ROLLED), "rolled")
    wrong = rows.withColumn("value", F.col("value") + 5)
    late = F.col("event_id") % 3 == 0
    # the later half first, with values that a second batch replaces; the earlier half comes last, one batch twice
    RU.log_changes(RU.changes(None, wrong.filter(~late), "value", day), path, 0)
    RU.log_changes(RU.changes(wrong.filter(~late), rows.filter(~late), "value", day), path, 1)
    RU.compact_rollup(fx.spark, path, f"{path}-folded")
    for _ in range(2):
        RU.log_changes(RU.changes(None, rows.filter(late), "value", day), f"{path}-folded", 2)
    return RU.summary(RU.read_rollup(fx.spark, f"{path}-folded"))


# --- streams ---------------------------------------------------------------------------------
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


@query("stream_ingest_payloads", f"""with a as ({_ACCOUNTS}), p as ({_POSTS}), m as ({_METRICS}), c as ({_COMMENTS}),
 la as (select * from a qualify row_number() over (partition by platform, external_id order by _ord desc) = 1)
 select 'accounts' as entity, count(*) as n, {isum('followers_count')} as total from la
 union all select 'posts', count(*), count(*) filter (content_type = 'short') from p
 union all select 'snapshots', count(*), {isum('likes')} from m
 union all select 'comments', count(*), {isum('like_count')} from c
 union all select 'cursors', 2 * count(*), count(*) from (select distinct source, account_external_id from fx_landing)
 union all select 'rejected', count(*), count(*) filter ({_BAD} = 'unknown_source') from fx_landing where {_BAD} is not null""")
def _(fx):
    spark, root = fx.spark, shared_dir(fx.spark, "ingest")
    fx["fx_landing"].drop("_ord").write.json(f"{root}/landing", timestampFormat=_STAMP)
    landing = spark.readStream.schema(J.LANDING).option("timestampFormat", _STAMP).json(f"{root}/landing")
    J.ingest_payloads(landing, f"{root}/log", f"{root}/checkpoint", EVENTS_AS_OF).awaitTermination()
    totals = {
        "accounts": F.sum("followers_count"), "posts": F.count_if(F.col("content_type") == "short"),
        "snapshots": F.sum("likes"), "comments": F.sum("like_count"),
        "cursors": F.count_if(F.col("entity_type") == "posts"),
    }
    out = None
    for entity, total in totals.items():
        part = J.folded(spark, f"{root}/log", entity).agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(
            F.lit(entity).alias("entity"), "n", "total")
        out = part if out is None else out.unionByName(part)
    rejected = spark.read.parquet(f"{root}/log/rejected")
    return out.unionByName(rejected.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "unknown_source").alias("total")).select(
        F.lit("rejected").alias("entity"), "n", "total"))


@query("stream_snapshot_dedupe", f"""with lines as (select *, {_LOST} as reason from ({_LINES}))
 (select post_id, captured_at, {_COUNTS}, reason from lines where reason is null
 qualify row_number() over (partition by post_id, captured_at order by _ord) = 1)
 union all select post_id, captured_at, {_COUNTS}, reason from lines where reason is not null""")
def _(fx):
    root = shared_dir(fx.spark, "dedupe")
    fx.stream("lineitem").createOrReplaceTempView("lineitem")
    J.dedupe_snapshots(fx.spark.sql(_LINES), f"{root}/table", f"{root}/checkpoint", f"{root}/rejected", unit="month").awaitTermination()
    columns = ["post_id", "captured_at", *COUNT_COLUMNS]
    kept = fx.spark.read.parquet(f"{root}/table").select(*columns, F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(fx.spark.read.parquet(f"{root}/rejected").select(*columns, "reason"))


@query("stream_score_comments", f"""with src as (select doc_id as comment_id, coalesce(text, '') as t from documents), {scored_sql('src', 'comment_id')}
 select comment_id, language, sentiment, sentiment_score, model_name, model_version from scored""")
def _(fx):
    root = shared_dir(fx.spark, "scores")
    comments = fx.stream("documents").select(F.col("doc_id").alias("comment_id"), F.col("text").alias("text_content"))
    J.score_comments(comments, f"{root}/analyses", f"{root}/checkpoint").awaitTermination()
    return fx.spark.read.parquet(f"{root}/analyses").select("comment_id", "language", "sentiment", "sentiment_score", "model_name", "model_version")


@query("stream_negative_alerts", NEGATIVE_ALERTS)
def _(fx):
    root, half = shared_dir(fx.spark, "alerts"), F.lit("2024-01-16 00:00:00").cast("timestamp")
    rows = fx["fx_day_sentiment"].select("account_id", "published_at", "sentiment")
    # the earlier half arrives in a second run, days to weeks late
    for name, part in (("a", F.col("published_at") >= half), ("b", ~(F.col("published_at") >= half))):
        rows.filter(part).write.parquet(f"{root}/in/{name}")
        stream = fx.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        J.count_negatives(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return J.current_alerts(fx.spark, f"{root}/log", EVENTS_AS_OF, "30d")


@query("stream_timeseries", """select user_id as account_id, date_trunc('hour', timezone('Africa/Tunis', timezone('UTC', ts)))::timestamp as bucket,
 cast(sum(cast(floor(value) as bigint)) as double) as value, strftime(bucket, '%Y-%m-%d %H:00') as label from events group by 1, 2""")
def _(fx):
    root = shared_dir(fx.spark, "series")
    # the earlier half of the events arrives in a second run, days to weeks late
    events, half = fx.table("events"), F.lit("2024-01-16 00:00:00").cast("timestamp")
    for name, part in (("a", F.col("ts") >= half), ("b", ~(F.col("ts") >= half))):
        events.filter(part).select(F.col("user_id").alias("account_id"), F.col("ts").alias("published_at"),
                                   F.floor("value").cast("bigint").alias("likes")).write.parquet(f"{root}/in/{name}")
        rows = fx.spark.readStream.schema("account_id bigint, published_at timestamp, likes bigint").option(
            "recursiveFileLookup", "true").parquet(f"{root}/in")
        J.timeseries(rows, "likes", f"{root}/log", f"{root}/checkpoint").awaitTermination()
    J.compact_timeseries(fx.spark, f"{root}/log", f"{root}/folded")
    return J.timeseries_state(fx.spark, f"{root}/folded")
