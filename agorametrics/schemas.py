"""Count columns, and the shapes of archived payloads."""

from __future__ import annotations

COUNT_DEFAULT_ZERO = ("likes", "comments_count", "shares", "saves")
COUNT_NULLABLE = ("reach", "impressions", "video_views", "clicks")
COUNT_COLUMNS = COUNT_DEFAULT_ZERO + COUNT_NULLABLE

# JSON shapes inside archived payloads, video platform and page platform in one superset each.
ACCOUNT_PAYLOAD = (
    "id string, snippet struct<title:string,customUrl:string>, "
    "statistics struct<subscriberCount:string>, "
    "name string, username string, followers_count string, fan_count string"
)
POST_PAYLOAD = (
    "id string, videoId string, "
    "snippet struct<title:string,description:string,publishedAt:string,channelId:string>, "
    "contentDetails struct<duration:string,videoPublishedAt:string>, "
    "message string, created_time string, permalink_url string, status_type string, "
    "account_id string"
)
METRIC_PAYLOAD = (
    "statistics struct<likeCount:string,commentCount:string,viewCount:string>, "
    "engagement struct<likes:struct<summary:struct<total_count:string>>,"
    "comments:struct<summary:struct<total_count:string>>,shares:struct<count:string>>, "
    "insights struct<data:array<struct<name:string,values:array<struct<value:string>>>>>, "
    "account_id string"
)
COMMENT_PAYLOAD = (
    "snippet struct<videoId:string,topLevelComment:struct<id:string,"
    "snippet:struct<textDisplay:string,authorChannelId:struct<value:string>,"
    "likeCount:string,publishedAt:string>>>, "
    "id string, message string, created_time string, `from` struct<id:string,name:string>, "
    "like_count string, post_id string, account_id string"
)
