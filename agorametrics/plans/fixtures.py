"""Adapter views: the social-media model over the given tables, the same SQL on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from agorametrics.session import configure, materialize

# Read with fixed schemas: no inference pass, and timestamps arrive as UTC instants.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}

ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "fx_accounts": """
select c_custkey as account_id, c_mktsegment as platform, c_name as handle,
 case when c_custkey % 10 = 0 then null else cast(floor(c_acctbal) as bigint) end as followers_count,
 c_custkey % 4 = 0 as is_competitor from customer""",
    "fx_posts": """
select o_orderkey as post_id, o_custkey as account_id, o_orderdate as published_at,
 case when o_orderkey % 11 = 0 then null else o_orderpriority end as content_type,
 concat('Demo post ', case o_orderkey % 7 when 0 then '#Promo #tunis' when 1 then '#promo #PROMO' when 2 then '#نجاح'
  when 3 then 'no tags' when 4 then '#food, #offre!' when 5 then '#café_1' else '' end) as text_content,
 concat('https://example.com/', cast(o_orderkey as varchar(20))) as permalink,
 o_orderkey % 5 = 0 as is_synthetic from orders""",
    "fx_snapshots": """
select l_orderkey as post_id, l_shipdate as captured_at,
 cast(sum(l_quantity) as bigint) as likes, cast(max(l_linenumber) as bigint) as comments_count,
 count(*) as shares, cast(min(l_linenumber) - 1 as bigint) as saves,
 case when max(l_returnflag) = 'R' then null when max(l_linenumber) = 7 then cast(0 as bigint) else cast(floor(max(l_extendedprice)) as bigint) end as reach,
 case when max(l_returnflag) = 'R' then null else cast(floor(max(l_extendedprice) * 1.5) as bigint) end as impressions,
 case when max(l_linestatus) = 'O' then null else cast(floor(max(l_extendedprice) * 0.25) as bigint) end as video_views,
 case when max(l_linenumber) = 3 then null else cast(floor(max(l_quantity)) as bigint) end as clicks
 from lineitem group by l_orderkey, l_shipdate""",
    "fx_follower_snapshots": """
select user_id as account_id, ts as captured_at, cast(floor(value * 100) as bigint) as followers_count
 from events where event_type = 'signup'""",
    "fx_order_followers": f"""
select c_custkey as account_id, timestamp '{ORDERS_AS_OF}' - interval '1' day * cast(c_custkey % 12 as int) + interval '1' day * 2 as captured_at,
 c_custkey * 7 % 5000 as followers_count from customer where c_custkey % 4 <> 1""",
    "fx_timed_posts": """
select event_id as post_id, user_id as account_id, ts as published_at, event_type as content_type, value as er from events""",
    "fx_comments": """
select d.doc_id as comment_id, e.user_id % 3 + 1 as account_id, e.ts as published_at, d.text as text_content,
 case d.lang when 'fr' then 'fr' when 'en' then 'en' else 'other' end as language,
 case when l.doc_id is null then null when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive' else 'neutral' end as sentiment
 from documents d join events e on e.event_id = d.doc_id * 5 left join labels l on l.doc_id = d.doc_id""",
    "fx_raw_events": """
select event_id as id, case when user_id % 2 = 0 then 'youtube' else 'facebook' end as source,
 case event_type when 'view' then 'metric' when 'click' then 'post' when 'signup' then 'account' else 'comment' end as entity_type,
 cast(event_id as varchar(20)) as external_id, props as payload, ts as captured_at from events""",
    "fx_text": """
select doc_id as text_id, case doc_id % 12
 when 0 then 'tawa nheb el photo hedhi barcha, 3aychek' when 1 then 'mrigel yesser, labes' when 2 then 'chnowa hedha, el colis mouch 3adi'
 when 3 then 'Merci pour la commande, vous avez bien fait' when 4 then 'This is the map for the harbour, and it was very good'
 when 5 then 'الصورة واضحة جدا اليوم' when 6 then 'جميلَة أهلا إسلام #نجاح' when 7 then 'the book has 12 maps and 3 notes for you'
 when 8 then '@ali barchaaaa!!! 😍 https://x.com now' when 9 then 'awful 😡 visit www.site.tn #Tunis #tunis #Café_1'
 when 10 then '   ' else 'hmm 🤔 😍😡 déçu' end as text_content from documents""",
    "fx_day_sentiment": """
select event_id as comment_id, user_id % 3 + 1 as account_id, ts as published_at,
 case user_id % 4 when 0 then 'fr' when 1 then 'en' when 2 then 'aeb-latn' else null end as language,
 case when event_type = 'error' or (event_type = 'click' and extract(day from ts) = 15) then 'negative'
  when event_type = 'view' then 'neutral' else 'positive' end as sentiment,
 value / 100 as sentiment_score, concat('comment ', cast(event_id as varchar(20))) as text_content from events""",
    # --- views of our own: inputs with the edge cases the ingestion operators are for -----------
    "fx_facts": """
select event_id as post_id, user_id as account_id, ts as published_at,
 case when event_id % 11 = 0 then null else event_type end as content_type,
 concat('Demo ', case event_id % 7 when 0 then '#Promo #tunis' when 1 then '#promo #PROMO' when 2 then '#نجاح'
  when 3 then 'no tags' when 4 then '#food, #offre!' when 5 then '#café_1' else '' end) as text_content,
 case when event_id % 17 = 0 then null else value end as er,
 case when event_id % 17 = 0 then 'none' when event_id % 3 = 0 then 'erf' else 'err' end as er_basis
 from events""",
    "stg_accounts_old": """
select c_custkey as account_id, 'facebook' as platform, cast(c_custkey as string) as external_id,
 c_name as handle, c_mktsegment as display_name,
 case when c_custkey % 10 = 0 then null else cast(floor(c_acctbal) as bigint) end as followers_count,
 c_custkey % 4 = 0 as is_competitor from customer""",
    "stg_accounts": """
select case when o_orderkey % 50 = 0 then o_custkey + 10000000 else o_custkey end as account_id,
 'facebook' as platform,
 cast(case when o_orderkey % 50 = 0 then o_custkey + 10000000 else o_custkey end as string) as external_id,
 concat('handle ', cast(o_orderkey as string)) as handle, o_orderpriority as display_name,
 case when o_orderkey % 10 = 0 then null else o_orderkey end as followers_count,
 o_orderkey % 6 = 0 as is_competitor, o_orderkey as _ord from orders""",
    "stg_posts": """
select case when o_orderkey % 13 = 0 then 'nobody' else cast(o_custkey as string) end as account_external_id,
 'facebook' as platform, cast(o_orderkey as string) as external_id, o_orderdate as published_at,
 case o_orderkey % 8 when 0 then 'Photos' when 1 then 'VIDEO' when 2 then ' reels ' when 3 then 'Carousel_Album'
  when 4 then 'IMAGE' when 5 then 'Some New Type' when 6 then '' else null end as content_type,
 case when o_orderkey % 12 = 0 then null else concat('Demo post ', case o_orderkey % 7 when 0 then '#Promo #tunis'
  when 1 then '#promo #PROMO' when 2 then '#نجاح' when 4 then '#food, #offre!' when 5 then '#café_1' else '' end)
  end as text_content,
 concat('https://example.com/', cast(o_orderkey as string)) as permalink,
 o_orderkey % 9 - 1 as media_count, o_orderkey % 5 = 0 as is_synthetic, o_orderkey as _ord from orders""",
    "stg_metrics": """
select case when s.post_id % 19 = 0 then 'gone' else cast(s.post_id as string) end as post_external_id,
 cast(p.account_id as string) as account_external_id, 'facebook' as platform, s.captured_at,
 case when s.post_id % 17 = 0 then 0 - s.likes else s.likes end as likes, s.comments_count,
 case when s.post_id % 31 = 0 then 0 - s.shares else s.shares end as shares, s.saves,
 case when s.post_id % 23 = 0 then -1 else s.reach % 100 end as reach,
 s.impressions, s.video_views, s.clicks, s.likes as _ord
 from fx_snapshots s join fx_posts p on p.post_id = s.post_id""",
    "stg_comments": """
select cast(o.o_orderkey as string) as post_external_id, cast(o.o_custkey as string) as account_external_id,
 'facebook' as platform,
 case when e.event_id % 20 = 0 then null else concat('c', cast(e.event_id % 37 as string)) end as external_id,
 concat('comment ', cast(e.event_id as string)) as text_content, e.ts as published_at,
 cast(floor(e.value) as bigint) as like_count,
 case when e.event_id % 9 = 0 then '' else cast(e.user_id as string) end as author_external_id,
 false as is_synthetic, e.event_id as _ord
 from events e join orders o on o.o_orderkey = e.event_id % 100""",
    "fx_landing": """
select case when event_id % 41 = 0 then 'elsewhere' when user_id % 2 = 0 then 'youtube' else 'facebook' end as source,
 case event_type when 'view' then 'metric' when 'click' then 'post' when 'signup' then 'account' else 'comment' end as entity_type,
 case when event_type = 'signup' then concat('acc', cast(user_id as string)) else cast(event_id as string) end as external_id,
 concat('acc', cast(user_id as string)) as account_external_id,
 case when event_type in ('signup', 'click') then null else concat('p', cast(event_id % 500 as string)) end as post_external_id,
 ts as captured_at, event_id as _ord,
 case when event_id % 37 = 0 then '{"id":"cut off' when event_id % 43 = 0 then '[1, 2]' when event_id % 47 = 0 then null
 when event_type = 'signup' and user_id % 2 = 0 then
  concat('{"id":"acc', cast(user_id as string), '","snippet":{"title":"Title ', cast(event_id as string), '"',
   case when user_id % 3 = 0 then ',"customUrl":""' else concat(',"customUrl":"@u', cast(event_id as string), '"') end,
   '},"statistics":{"subscriberCount":"', cast(event_id as string), '"}}')
 when event_type = 'signup' then
  concat('{"name":"Name ', cast(event_id as string), '","username":"user', cast(event_id as string), '"',
   case when user_id % 3 = 0 then ',"followers_count":null' else concat(',"followers_count":', cast(event_id as string)) end,
   ',"fan_count":', cast(event_id * 2 as string), '}')
 when event_type = 'click' and user_id % 2 = 0 then
  concat('{"id":"', cast(event_id as string), '","snippet":{"title":"Video ', cast(event_id as string), '","description":"',
   case when event_id % 3 = 0 then '' else 'about #food' end, '"},"contentDetails":{"duration":"PT',
   case event_id % 4 when 0 then '45S' when 1 then '1M' when 2 then '1M1S' else '2H3M' end,
   '","videoPublishedAt":"2024-01-1', cast(event_id % 10 as string), 'T10:00:00Z"}}')
 when event_type = 'click' then
  concat('{"id":"', cast(event_id as string), '","message":"Post ', cast(event_id as string),
   '","created_time":"2024-01-0', cast(event_id % 9 + 1 as string), 'T08:30:00+0000","status_type":"',
   case event_id % 4 when 0 then 'added_photos' when 1 then 'shared_story' when 2 then 'mobile_status_update' else 'other_kind' end, '"',
   case when event_id % 5 = 0 then '' else concat(',"permalink_url":"https://fb.example/', cast(event_id as string), '"') end, '}')
 when event_type = 'view' and user_id % 2 = 0 then
  concat('{"statistics":{"likeCount":"', cast(event_id % 90 as string), '","viewCount":"', cast(event_id as string), '"',
   case when event_id % 3 = 0 then '' else ',"commentCount":"7"' end, '}}')
 when event_type = 'view' then
  concat('{"engagement":{"likes":{"summary":{"total_count":', cast(event_id % 80 as string), '}},"comments":{"summary":{"total_count":3}}',
   case when event_id % 4 = 0 then '' else ',"shares":{"count":2}' end, '}',
   case when event_id % 5 = 0 then '' else concat(',"insights":{"data":[{"name":"post_impressions","values":[{"value":', cast(event_id * 3 as string),
    '}]},{"name":"post_impressions_unique","values":[{"value":', cast(event_id * 2 as string), '}]},{"name":"post_clicks","values":[{"value":9}]}]}') end, '}')
 when user_id % 2 = 0 then
  concat('{"snippet":{"topLevelComment":{', case when event_id % 7 = 0 then '' else concat('"id":"c', cast(event_id as string), '",') end, '"snippet":{"textDisplay":"behi barcha ', cast(event_id as string),
   '","likeCount":', cast(event_id % 6 as string), ',"publishedAt":"2024-01-02T09:00:00Z"',
   case when event_id % 3 = 0 then '' else concat(',"authorChannelId":{"value":"UC', cast(user_id as string), '"}') end, '}}}}')
 else
  concat('{', case when event_id % 7 = 0 then '' else concat('"id":"c', cast(event_id as string), '",') end, '"created_time":"2024-01-03T09:00:00+0000","message":"merci ', cast(event_id as string), '"',
   case when event_id % 3 = 0 then '' else concat(',"from":{"id":"u', cast(user_id as string), '"}') end, ',"like_count":1}')
 end as payload
 from events""",
    "fx_export": """
select cast(o_orderkey as string) as order_key, o_orderkey as _ord,
 case when o_orderkey % 10 = 0 then null else cast(o_orderkey as string) end as "Post ID",
 case when o_orderkey % 21 = 0 then null else concat('page', cast(o_custkey as string)) end as "Page ID",
 concat('Page ', cast(o_orderkey as string)) as "Page name",
 case o_orderkey % 6 when 0 then 'not a time' when 1 then concat('2026-07-0', cast(o_orderkey % 9 + 1 as string), ' 19:30:00')
  when 2 then concat('2026-01-0', cast(o_orderkey % 9 + 1 as string), 'T08:15:00+03:00') when 3 then '2026-02-03'
  when 4 then concat('2026-03-1', cast(o_orderkey % 10 as string), ' 23:30') else '2026-07-03T10:00:00Z' end as "Publish time",
 case o_orderkey % 4 when 0 then 'Photo' when 1 then 'Reels' when 2 then 'Link' else null end as "Post type",
 concat('Title "quoted", #tag', cast(o_orderkey as string)) as "Title",
 concat('https://example.com/', cast(o_orderkey as string)) as "Permalink",
 case o_orderkey % 5 when 0 then '12.7' when 1 then 'n/a' when 2 then '1e3' when 3 then null else cast(o_orderkey as string) end as "Reactions",
 cast(o_orderkey % 40 as string) as "Comments", cast(o_orderkey % 7 as string) as "Shares",
 case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 5000 as string) end as "Reach",
 cast(o_orderkey % 30 as string) as "Link clicks" from orders""",
}


# both the planted edge cases and the long documents
TEXTS = """select text_id, text_content from fx_text
 union all select doc_id + 1000000000 as text_id, text as text_content from documents"""


def _names(sql: str, known) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in known if n in words]


class Fixtures:
    """Tables and adapter views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark, short_rows=True)
        self.sf_dir = sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        # a pattern, as a stream takes no single file; it finds a table that is a folder of files as well
        return self.spark.readStream.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views by name."""
        for name in _names(text, TABLES):
            self.table(name).createOrReplaceTempView(name)
        for name in _names(text, VIEWS):
            self.view(name).createOrReplaceTempView(name)
        # a quoted name is an identifier in ANSI SQL; Spark quotes those with backticks
        return self.spark.sql(re.sub(r' as "([^"]+)"', r" as `\1`", text))

    def keep(self, name: str) -> DataFrame:
        """Store a view's rows once; all SQL that names it from now on reads them."""
        if name not in self._kept:
            self._kept[name] = materialize(self.view(name), name.replace("_", "-"), "zstd")
        return self._kept[name]

    def view(self, name: str) -> DataFrame:
        return self._kept[name] if name in self._kept else self.sql(VIEWS[name])

    __getitem__ = view


def with_views(sql: str) -> str:
    """The SQL for DuckDB, the views it names (and those they name) put in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _names(text, VIEWS):
            if name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in order]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts + [body[5:]])
    return ("with " + ",\n".join(parts) + "\n" + body) if parts else body
