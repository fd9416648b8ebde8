"""Archived platform payloads to staging records.

A landing event is (source, entity_type, external_id, account_external_id, post_external_id,
payload, captured_at): the payload is the platform's JSON as fetched, the ids beside it say for
which account and post it was fetched. ``source`` is ``youtube`` or ``facebook``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics import schemas, vocab
from agorametrics.functions.text import _lookup
from agorametrics.functions.timeparse import iso_duration_seconds, parse_iso_dt, to_int


SOURCES = ("youtube", "facebook")
_SCHEMAS = {"account": schemas.ACCOUNT_PAYLOAD, "post": schemas.POST_PAYLOAD, "metric": schemas.METRIC_PAYLOAD,
            "comment": schemas.COMMENT_PAYLOAD}
_ENTITIES = {"account": "accounts", "post": "posts", "metric": "metrics", "comment": "comments"}


def _read(events: DataFrame, entity: str) -> DataFrame:
    """Events of a kind with their payload ``p`` and ``_reason``, null for those that can be read."""
    kind = events.filter(F.col("entity_type") == entity)
    broken = F.try_parse_json("payload").isNull() | (F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT") == F.lit(False))
    reason = F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown_source").when(
        F.coalesce(broken, F.lit(True)), "malformed_payload")
    return kind.withColumn("p", F.from_json("payload", _SCHEMAS[entity])).withColumn(
        "_video", F.col("source") == "youtube").withColumn("_reason", reason)


def _parsed(events: DataFrame, entity: str) -> DataFrame:
    return _read(events, entity).filter(F.col("_reason").isNull()).drop("_reason")


def payload_rejects(events: DataFrame) -> DataFrame:
    """Events no record is made of, with ``entity`` and ``reason``: an unknown source or kind, a
    payload that is no JSON object, a post without a readable time."""
    kept = [c for c in events.columns]
    out = events.filter(~F.coalesce(F.col("entity_type").isin(*_SCHEMAS), F.lit(False))).select(
        *kept, F.coalesce("entity_type", F.lit("none")).alias("entity"), F.lit("unknown_entity").alias("reason"))
    for entity, name in _ENTITIES.items():
        rows = _read(events, entity)
        reason = F.col("_reason")
        if entity == "post":
            reason = F.coalesce(reason, F.when(_post_time(rows).isNull(), "missing_publish_time"))
        out = out.unionByName(rows.select(*kept, F.lit(name).alias("entity"), reason.alias("reason")).filter(
            F.col("reason").isNotNull()))
    return out


def _post_time(parsed: DataFrame) -> Column:
    p = parsed["p"]
    published = F.coalesce(p["contentDetails"]["videoPublishedAt"], p["snippet"]["publishedAt"])
    return parse_iso_dt(_either(published, p["created_time"]))


def _either(video: Column, page: Column) -> Column:
    return F.when(F.col("_video"), video).otherwise(page)


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def _kept(events: DataFrame) -> list[str]:
    return [c for c in events.columns if c.startswith("_") and c not in ("_video", "_reason")]


def payload_accounts(events: DataFrame) -> DataFrame:
    parsed = _parsed(events, "account")
    p = F.col("p")
    handle = F.coalesce(_nonempty(p["snippet"]["customUrl"]), p["snippet"]["title"])
    followers = F.coalesce(to_int(p["followers_count"]), to_int(p["fan_count"]))
    return parsed.select(
        *_kept(events), F.col("source").alias("platform"), "external_id",
        _either(handle, p["username"]).alias("handle"),
        _either(p["snippet"]["title"], p["name"]).alias("display_name"),
        _either(to_int(p["statistics"]["subscriberCount"]), followers).alias("followers_count"),
        F.lit(False).alias("is_competitor"))


def payload_posts(events: DataFrame) -> DataFrame:
    """Posts; those whose time cannot be read are among ``payload_rejects``."""
    parsed = _parsed(events, "post")
    p = F.col("p")
    seconds = iso_duration_seconds(p["contentDetails"]["duration"])
    video_type = F.when(seconds <= vocab.SHORT_MAX_SECONDS, "short").otherwise("video")
    status = p["status_type"]
    title = F.coalesce(p["snippet"]["title"], F.lit(""))
    description = F.coalesce(p["snippet"]["description"], F.lit(""))
    both = F.when(description != "", F.trim(F.concat(title, F.lit("\n"), description))).otherwise(title)
    rows = parsed.select(
        *_kept(events), "account_external_id", F.col("source").alias("platform"), "external_id",
        _post_time(parsed).alias("published_at"),
        _either(video_type, F.coalesce(_lookup(status, vocab.PAGE_STATUS_MAP), status)).alias("content_type"),
        _either(_nonempty(both), p["message"]).alias("text_content"),
        _either(F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("external_id")),
                p["permalink_url"]).alias("permalink"),
        F.lit(0).cast("bigint").alias("media_count"), F.lit(False).alias("is_synthetic"))
    return rows.filter(F.col("published_at").isNotNull())


def payload_snapshots(events: DataFrame) -> DataFrame:
    parsed = _parsed(events, "metric")
    p = F.col("p")
    stats, shown = p["statistics"], p["engagement"]
    named = F.transform(
        F.coalesce(p["insights"]["data"], F.array().cast("array<struct<name:string,values:array<struct<value:string>>>>")),
        lambda row: F.struct(row["name"].alias("name"), F.get(row["values"], 0)["value"].alias("value")))

    def insight(column: str) -> Column:
        rows = F.filter(named, lambda r: r["name"] == vocab.INSIGHT_NAMES[column])
        return _either(F.lit(None).cast("bigint"), to_int(F.element_at(F.concat(
            F.array(F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("value"))), rows), -1)["value"]))

    def zero(value: Column) -> Column:
        return F.coalesce(to_int(value), F.lit(0))

    none = F.lit(0).cast("bigint")
    return parsed.select(
        *_kept(events), F.col("external_id").alias("post_external_id"), "account_external_id",
        F.col("source").alias("platform"), "captured_at",
        _either(zero(stats["likeCount"]), zero(shown["likes"]["summary"]["total_count"])).alias("likes"),
        _either(zero(stats["commentCount"]), zero(shown["comments"]["summary"]["total_count"])).alias("comments_count"),
        _either(none, zero(shown["shares"]["count"])).alias("shares"), none.alias("saves"),
        insight("reach").alias("reach"), insight("impressions").alias("impressions"),
        _either(to_int(stats["viewCount"]), F.lit(None).cast("bigint")).alias("video_views"),
        insight("clicks").alias("clicks"))


def payload_comments(events: DataFrame) -> DataFrame:
    parsed = _parsed(events, "comment")
    p = F.col("p")
    top = p["snippet"]["topLevelComment"]
    body = top["snippet"]
    return parsed.select(
        *_kept(events), "post_external_id", "account_external_id", F.col("source").alias("platform"),
        _either(top["id"], p["id"]).alias("external_id"),
        F.coalesce(_either(body["textDisplay"], p["message"]), F.lit("")).alias("text_content"),
        parse_iso_dt(_either(body["publishedAt"], p["created_time"])).alias("published_at"),
        F.coalesce(to_int(_either(body["likeCount"], p["like_count"])), F.lit(0)).alias("like_count"),
        _either(body["authorChannelId"]["value"], p["from"]["id"]).alias("author_external_id"),
        F.lit(False).alias("is_synthetic"))


def payload_field(events: DataFrame, path: str, kind: str, name: str) -> DataFrame:
    """One typed field out of every payload; null where it is absent or of another type."""
    return events.withColumn(name, F.try_variant_get(F.try_parse_json("payload"), path, kind))
