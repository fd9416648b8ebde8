import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agorametrics.operators import history as H
from agorametrics.operators import ingest as I
from agorametrics.schemas import COUNT_COLUMNS
from agorametrics.session import materialize, scratch, shared_dir
from agorametrics.sources import csv_export as C
from agorametrics.sources import payloads as PL
from agorametrics.sources import sinks as SK
from agorametrics.streaming import jobs as J

NOW = "2026-07-10 00:00:00"
COUNTS = ",".join(f"{c} long" for c in COUNT_COLUMNS)


def snapshot(**given):
    row = {"likes": 1, "comments_count": 0, "shares": 0, "saves": 0, "reach": None, "impressions": None, "video_views": None, "clicks": None}
    return tuple({**row, **given}.values())


def test_post_gate(table):
    df = table([(1, "2026-07-10 01:00:00", 0), (2, "2026-07-10 00:03:00", 0), (3, "2026-07-01 00:00:00", -1),
                (4, "2026-07-10 01:00:00", -1)], "id long,published_at timestamp,media_count long")
    got = {r.id: r.reject_reason for r in I.post_quality_gate(df, NOW).collect()}
    assert got == {1: "future_timestamp", 2: None, 3: "negative_media_count", 4: "future_timestamp"}


def test_metric_gate_and_flag(table):
    rows = [(1, NOW, *snapshot(likes=-5, shares=-1)), (2, NOW, *snapshot(likes=100, reach=40)), (3, NOW, *snapshot(likes=100)),
            (4, "2026-07-11 00:00:00", *snapshot(likes=-5)), (5, NOW, *snapshot(clicks=-1))]
    df = table(rows, "id long,captured_at timestamp," + COUNTS)
    got = {r.id: r.reject_reason for r in I.metric_quality_gate(df, NOW).collect()}
    assert got == {1: "negative_likes", 2: None, 3: None, 4: "future_timestamp", 5: "negative_clicks"}
    flags = {r.id: r.flags for r in I.reach_anomaly_flag(df).collect()}
    assert flags[2] == ["reach_lt_engagement"] and flags[3] == []


COMMENTS = "post_id long,external_id string,text_content string,like_count long,author_hash string"


def test_upsert_updates_only_listed_columns_and_appends_null_keys(table):
    target = table([(1, "a", "old", 1, "h1"), (1, None, "n0", 0, "h0")], COMMENTS)
    batch = table([(1, "a", "new", 2, "h2", 1), (1, "a", "newest", None, "h3", 2), (2, "b", "first", 5, "h4", 1),
                   (2, "b", "second", 6, "h5", 2), (1, None, "n1", 0, "h6", 3)], COMMENTS + ",_ord long")
    keys, updates = ["post_id", "external_id"], I.UPDATES["comments"]
    got = {tuple(r) for r in I.upsert(target, batch, keys, updates, "_ord").collect()}
    assert got == {(1, "a", "newest", None, "h1"), (2, "b", "second", 6, "h4"), (1, None, "n0", 0, "h0"), (1, None, "n1", 0, "h6")}
    kept = {tuple(r) for r in I.upsert(target, batch, keys, updates, "_ord", overwrite_nulls=False).collect()}
    assert (1, "a", "newest", 2, "h1") in kept
    twice = I.upsert(I.upsert(target, batch.filter("external_id is not null"), keys, updates, "_ord"),
                     batch.filter("external_id is not null"), keys, updates, "_ord")
    assert twice.count() == 3


def test_known_followers_survive_on_request(table):
    schema = "platform string,external_id string,handle string,display_name string,followers_count long,is_competitor boolean,account_id long"
    target = table([("x", "1", "h", "d", 500, False, 9)], schema)
    batch = table([("x", "1", "h2", "d", None, False, 9, 1)], schema + ",_ord long")
    args = (target, batch, ["platform", "external_id"], I.UPDATES["accounts"], "_ord")
    assert I.upsert(*args).first().followers_count is None
    row = I.upsert(*args, overwrite_nulls=False).first()
    assert (row.followers_count, row.handle) == (500, "h2")


def test_insert_new_keeps_the_first(table):
    target = table([(1, NOW, 5)], "post_id long,captured_at timestamp,likes long")
    batch = table([(1, NOW, 9, 1), (2, NOW, 7, 2), (2, NOW, 6, 1)], "post_id long,captured_at timestamp,likes long,_ord long")
    assert [(r.post_id, r.likes) for r in I.insert_new(target, batch, ["post_id", "captured_at"], "_ord").collect()] == [(2, 6)]


CSV = ("Post ID,Page ID,Page name,Publish time,Post type,Title,Reactions,Comments,Shares,Reach,Extra\n"
       '1,p1,Demo,2026-07-03 19:30:00,Photo,"Hello, #Promo\nline two",12,3,1,400,x\n'
       "2,p1,Renamed,not a time,Reels,Two,1,1,1,,x\n,p1,Demo,2026-07-04 10:00:00,Link,Three,7.9,,1,n/a,x\n"
       "4,,None,2026-07-04 10:00:00,Link,Four,1,1,1,5,x\n")


@pytest.fixture
def export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(CSV, encoding="utf-8")
    return C.csv_profile_scan(spark, str(path), multiline=True).withColumn("_ord", F.col("_place.row")).drop("_place")


def test_csv_records(export):
    posts = {r.text_content: r for r in C.csv_to_posts(export).collect()}
    assert set(posts) == {"Hello, #Promo\nline two", "Three"}
    first = posts["Hello, #Promo\nline two"]
    assert first.published_at == dt.datetime(2026, 7, 3, 18, 30) and first.external_id == "1"
    assert posts["Three"].external_id == "p1:2026-07-04T09:00:00+00:00"
    snaps = {r.post_external_id: r for r in C.csv_to_snapshots(export, NOW).collect()}
    assert (snaps["1"].likes, snaps["1"].saves, snaps["1"].reach, snaps["1"].impressions) == (12, 0, 400, None)
    made = snaps["p1:2026-07-04T09:00:00+00:00"]
    assert (made.likes, made.comments_count, made.reach) == (7, 0, None)
    accounts = C.csv_to_accounts(export, order="_ord").collect()
    assert [(r.external_id, r.display_name, r.followers_count) for r in accounts] == [("p1", "Demo", None)]


def test_files_with_other_headers(spark, tmp_path):
    """Columns go by name in each file; rows keep their order over splits and files."""
    (tmp_path / "a.csv").write_text("Post ID,Page ID,Page name,Publish time,Reactions,Reach,Extra\n1,p,First,2026-07-01,6,200,x\n2,p,Second,2026-07-02,7,210,x\n")
    (tmp_path / "b.csv").write_text("Reach,Mystery,Reactions,Publish time,Page name,Page ID,Post ID\n300,?,9,2026-07-03,Third,p,3\n")
    scan = C.csv_profile_scan(spark, str(tmp_path))
    assert {(r.external_id, r.likes, r.reach) for r in scan.collect()} == {("1", "6", "200"), ("2", "7", "210"), ("3", "9", "300")}
    assert [r.external_id for r in scan.orderBy("_place").collect()] == ["1", "2", "3"]
    assert C.csv_to_accounts(scan).first().display_name == "First"
    assert {(r.file[-5:], r.header) for r in C.unmapped_headers(spark, str(tmp_path)).collect()} == {("a.csv", "Extra"), ("b.csv", "Mystery")}


def test_line_breaks_are_found(spark, tmp_path):
    """Quoted line breaks are found without being told so."""
    (tmp_path / "a.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "b.csv").write_text(CSV.replace("\nline two", '""\r\n""line two').replace("1,p1", "9,p1"), encoding="utf-8", newline="")
    (tmp_path / "c.csv").write_text(CSV.split("\n")[0] + '\n7,p1,Demo,2026-07-05 10:00:00,Link,"say ""so"", now",1,1,1,1,x\n', encoding="utf-8")
    posts = {r.external_id: r.text_content for r in C.csv_to_posts(C.csv_profile_scan(spark, str(tmp_path))).collect()}
    assert posts.pop("9").replace("\r", "") == 'Hello, #Promo"\n"line two'
    assert posts == {"1": "Hello, #Promo\nline two", "7": 'say "so", now', "p1:2026-07-04T09:00:00+00:00": "Three"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "l.csv").write_text('"te\nxt",text,label\n1,"two\nlines",pos\n2,bad,0\n', encoding="utf-8")
    assert {tuple(r) for r in C.labeled_csv_scan(spark, str(tmp_path / "l")).collect()} == {("two\nlines", "positive"), ("bad", "negative")}


@pytest.mark.parametrize("line, outside, inside", [
    ('a,b', False, True), ('"a","b"', False, False), ('"a, ""b"" c",""', False, False), ('a,"""x"""', False, False), ('""""', False, True), ('a,""",",b', False, True),
    ('a,"open', True, False), ('a,"open ""', True, False), ('a,",""', True, False), ('close",b', False, False), ('5" wide,"open', True, True), ('', False, True),
    ('close","open', True, True), ('""', False, True), ('"', True, False)])
def test_lines_with_open_quotes(spark, tmp_path, line, outside, inside):
    (tmp_path / "l.txt").write_text(line + "\n")
    assert tuple(C._lines(spark, str(tmp_path)).select("outside", "inside").first()) == (outside, inside)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _whole(spark, path, names):
    """The file as one task reads it."""
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(str(path), header=True, multiLine=True, escape='"', enforceSchema=True).collect()
    return [tuple(r) for r in rows]


def test_split_files_equal_whole_ones(spark, tmp_path, small_splits):
    """Quoted line breaks, values longer than splits, stray and doubled quotes, blank lines; many tasks a file."""
    r = random.Random(11)
    cells = ["", "x", "plain", '"a, b"', '"two\nlines"', '"say ""so"""', '5" wide', 'a"b"c', '""', '"long ' + "\n".join("line,%d" % i for i in range(30)) + '"', '"\n"', '"\n\n"', '"""\n"""', '"x"y']
    for k in range(3):
        rows = [",".join(r.choice(cells) for _ in range(3)) for _ in range(60)]
        rows[r.randrange(60)] = ""
        (tmp_path / f"{k}.csv").write_text('p,"q\nq",s\n' + "\n".join(rows) + ("\n" if k % 2 else ""), encoding="utf-8")
    got = []
    for raw in C.read_export(spark, str(tmp_path)):
        assert raw.columns[:3] == ["p", "q\nq", "s"]
        got += [tuple(row)[:3] for row in raw.collect()]
        places = [(x._place.file, x._place.block, x._place.row) for x in raw.orderBy("_place").collect()]
        assert len(set(places)) == len(places)
        in_order = [tuple(x)[:3] for x in raw.orderBy("_place").collect() if x._place.file.endswith("0.csv")]
        assert in_order == [tuple(x) for x in spark.read.schema("p string, q string, s string").csv(str(tmp_path / "0.csv"), header=True, multiLine=True, escape='"').collect()]
    assert sorted(map(str, got)) == sorted(map(str, _whole(spark, tmp_path, "pqs")))
    lines = C._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 30
    assert C._inside(C._splits(lines)).count() > 10


def test_a_quote_that_is_never_closed(spark, tmp_path, small_splits):
    """The rest of its split is a record, and so is every further split; nothing vanishes, rows before it stay."""
    body = "".join(f"{i},pos,{i}\n" for i in range(20))
    (tmp_path / "a.csv").write_text('text,label,more\n1,pos,1\n"2,neg,2\n' + body)
    rows = [tuple(x)[:3] for raw in C.read_export(spark, str(tmp_path)) for x in raw.orderBy("_place").collect()]
    assert rows[0] == ("1", "pos", "1") and rows[1][0].startswith("2,neg,2\n0,pos")
    bad = C.malformed_rows(spark, str(tmp_path)).collect()
    assert [x.record for x in bad if x.reason == "quote_left_open"][0].startswith('"2,neg,2\n0,pos')
    assert sum(x.record.count("pos") for x in bad) == 20


def test_other_line_ends(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfp,q\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    (tmp_path / "b.csv").write_bytes(b'p,q\r3,"u\rv"\r4,w\r')
    got = sorted((x.p, x.q.replace("\r\n", "\n")) for raw in C.read_export(spark, str(tmp_path)) for x in raw.collect())
    assert got == [("1", "x\ny"), ("2", "z"), ("3", "u\nv"), ("4", "w")]
    one = [tuple(x)[:2] for raw in C.read_export(spark, str(tmp_path / "a.csv"), multiline=False) for x in raw.orderBy("_place").collect()]
    assert len(one) == 3


def test_malformed_rows_have_a_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label,more\na,pos,1\nb,neg\nc,pos,1,2\nd,,\n")
    (tmp_path / "b.csv").write_text('text,label,more\na,pos,1\n"b,neg,2\nc,pos,3\n')
    found = {(r.file[-5:], r.record.strip(), r.reason) for r in C.malformed_rows(spark, str(tmp_path)).collect()}
    assert found == {("a.csv", "b,neg", "column_count"), ("a.csv", "c,pos,1,2", "column_count"), ("b.csv", '"b,neg,2\nc,pos,3', "quote_left_open")}


def test_wide_exports(spark, tmp_path):
    """Columns behind the 512th are columns like others."""
    names = ["Post ID", "Page ID", "Publish time", *(f"x{i}" for i in range(700)), "Title"]
    (tmp_path / "w.csv").write_text(",".join(names) + "\n1,p,2026-07-01," + "0," * 700 + "Last\n")
    assert C.csv_profile_scan(spark, str(tmp_path)).first().text_content == "Last"
    assert C.unmapped_headers(spark, str(tmp_path)).count() == 700


def test_csv_headers(spark):
    profile = C.get_profile()
    found, unmapped = C.resolve_columns(["Post ID", "Publish time", "Mystery"], profile)
    assert found == {"external_id": "Post ID", "published_at": "Publish time"} and unmapped == ["Mystery"]
    with pytest.raises(C.MissingColumn, match="published_at"):
        C.resolve_columns(["Post ID"], profile)
    with pytest.raises(KeyError):
        C.get_profile("nope")
    raw = spark.createDataFrame([("1", "2026-07-01")], "id string, date string")
    with pytest.raises(ValueError, match="platform"):
        C.map_export(raw, "kaggle_engagement_generic", default_account="a")
    mapped = C.map_export(raw, "kaggle_engagement_generic", platform="x", default_account="a", default_name="n")
    assert (mapped.first().account_external_id, mapped.first().account_name) == ("a", "n")
    assert C.map_export(raw, "kaggle_engagement_generic", platform="x").count() == 0


def test_labeled_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("text,label\n good ,pos\nbad,0\n,pos\nx,unheard\n", encoding="utf-8")
    assert {tuple(r) for r in C.labeled_csv_scan(spark, str(tmp_path / "l.csv")).collect()} == {("good", "positive"), ("bad", "negative")}


EVENT = "source string,entity_type string,external_id string,account_external_id string,post_external_id string,payload string,captured_at timestamp"


def events(table, *rows):
    return table([(s, k, e, a, p, payload, NOW) for s, k, e, a, p, payload in rows], EVENT)


def test_video_payloads(table):
    df = events(
        table,
        ("youtube", "account", "UCown77", None, None,
         '{"id":"UCown77","snippet":{"title":"Harbour Notes","customUrl":"@harbournotes"},"statistics":{"subscriberCount":"8150"}}'),
        ("youtube", "post", "clipA", "UCown77", None,
         '{"id":"clipA","snippet":{"title":"Morning ferry","description":"from the old quay"},"contentDetails":{"duration":"PT7M5S","videoPublishedAt":"2026-07-03T06:15:00Z"}}'),
        ("youtube", "post", "clipB", "UCown77", None,
         '{"id":"clipB","snippet":{"title":"Gulls","description":""},"contentDetails":{"duration":"PT45S","videoPublishedAt":"2026-06-20T08:00:00Z"}}'),
        ("youtube", "post", "clipC", "UCown77", None, '{"id":"clipC","snippet":{"title":"Undated"}}'),
        ("youtube", "metric", "clipA", "UCown77", None, '{"statistics":{"viewCount":"731","likeCount":"64","commentCount":"9"}}'),
        ("youtube", "comment", "c1", "UCown77", "clipA",
         '{"snippet":{"topLevelComment":{"id":"c1","snippet":{"textDisplay":"good light","authorChannelId":{"value":"UCreader5"},"likeCount":2,"publishedAt":"2026-07-02T09:00:00Z"}}}}'))
    account = PL.payload_accounts(df).first()
    assert (account.handle, account.display_name, account.followers_count) == ("@harbournotes", "Harbour Notes", 8150)
    posts = {r.external_id: r for r in PL.payload_posts(df).collect()}
    assert {k: r.content_type for k, r in posts.items()} == {"clipA": "video", "clipB": "short"}
    assert posts["clipA"].text_content == "Morning ferry\nfrom the old quay" and posts["clipB"].text_content == "Gulls"
    assert posts["clipA"].permalink.endswith("watch?v=clipA")
    snap = PL.payload_snapshots(df).first()
    assert (snap.likes, snap.comments_count, snap.video_views, snap.reach, snap.shares) == (64, 9, 731, None, 0)
    comment = PL.payload_comments(df).first()
    assert (comment.text_content, comment.author_external_id, comment.like_count, comment.post_external_id) == (
        "good light", "UCreader5", 2, "clipA")


def test_unreadable_events_are_told(table):
    df = events(table, ("youtube", "metric", "m1", "a", None, '{"statistics":{"likeCount":"4"'), ("youtube", "metric", "m2", "a", None, "[]"),
                ("facebook", "comment", "c1", "a", "p", None), ("other", "post", "p1", "a", None, '{"id":"p1"}'),
                ("youtube", "account", "a", None, None, "not json"), ("youtube", "post", "p2", "a", None, '{"snippet":{"title":"t"}}'),
                ("youtube", "story", "s", "a", None, "{}"), ("youtube", "metric", "m3", "a", None, '{"statistics":{"likeCount":"4"}}'))
    assert [(r.post_external_id, r.likes) for r in PL.payload_snapshots(df).collect()] == [("m3", 4)]
    assert PL.payload_accounts(df).count() == PL.payload_comments(df).count() == PL.payload_posts(df).count() == 0
    assert {(r.external_id, r.entity, r.reason) for r in PL.payload_rejects(df).collect()} == {
        ("m1", "metrics", "malformed_payload"), ("m2", "metrics", "malformed_payload"), ("c1", "comments", "malformed_payload"),
        ("p1", "posts", "unknown_source"), ("a", "accounts", "malformed_payload"), ("p2", "posts", "missing_publish_time"),
        ("s", "story", "unknown_entity")}


def test_page_payloads(table):
    df = events(
        table,
        ("facebook", "account", "q8", None, None, '{"name":"Quay","username":"quay.page","fan_count":412}'),
        ("facebook", "post", "q8_1", "q8", None,
         '{"id":"q8_1","message":"Boats in #sfax","created_time":"2026-07-01T10:00:00+0000","status_type":"added_photos"}'),
        ("facebook", "metric", "q8_1", "q8", None,
         '{"engagement":{"likes":{"summary":{"total_count":37}},"comments":{"summary":{"total_count":6}},"shares":{"count":5}},"insights":{"data":[{"name":"post_impressions","values":[{"value":1830}]},{"name":"post_impressions_unique","values":[{"value":1240}]},{"name":"post_clicks","values":[]}]}}'),
        ("facebook", "metric", "q8_2", "q8", None, '{"engagement":{"likes":{"summary":{"total_count":1}}}}'),
        ("facebook", "comment", "c9", "q8", "q8_1", '{"id":"c9","message":"well seen","created_time":"2026-07-01T11:00:00+0000"}'))
    account = PL.payload_accounts(df).first()
    assert (account.handle, account.display_name, account.followers_count) == ("quay.page", "Quay", 412)
    post = PL.payload_posts(df).first()
    assert (post.content_type, post.published_at, post.permalink) == ("photo", dt.datetime(2026, 7, 1, 10), None)
    snaps = {r.post_external_id: r for r in PL.payload_snapshots(df).collect()}
    assert (snaps["q8_1"].shares, snaps["q8_1"].reach, snaps["q8_1"].impressions, snaps["q8_1"].clicks) == (5, 1240, 1830, None)
    assert (snaps["q8_2"].likes, snaps["q8_2"].comments_count, snaps["q8_2"].reach) == (1, 0, None)
    assert PL.payload_comments(df).first().author_external_id is None


def staged(export):
    return {
        "accounts": C.csv_to_accounts(export, order="_ord").withColumn("_ord", F.lit(0)),
        "posts": C.csv_to_posts(export), "metrics": C.csv_to_snapshots(export, NOW),
        "comments": export.sparkSession.createDataFrame(
            [("1", "p1", "facebook", None, "nice", None, 1, "u1", False, 1), ("77", "p1", "facebook", "c", "lost", None, 1, "", False, 2)],
            "post_external_id string, account_external_id string, platform string, external_id string, text_content string, "
            "published_at timestamp, like_count long, author_external_id string, is_synthetic boolean, _ord long"),
    }


def empty(spark):
    return {
        "accounts": spark.createDataFrame([], "account_id string, platform string, external_id string, handle string, display_name string, followers_count long, is_competitor boolean"),
        "posts": spark.createDataFrame([], "post_id string, account_id string, external_id string, published_at timestamp, content_type string, text_content string, hashtags array<string>, media_count long, permalink string, is_synthetic boolean"),
        "snapshots": spark.createDataFrame([], "post_id string, captured_at timestamp, " + COUNTS),
        "comments": spark.createDataFrame([], "comment_id string, post_id string, external_id string, author_hash string, text_content string, published_at timestamp, like_count long, is_synthetic boolean"),
    }


def test_same_file_twice_stores_once(spark, export):
    first, report = I.normalize_and_store(staged(export), empty(spark), NOW, keep=materialize)
    again, second = I.normalize_and_store(staged(export), first, NOW, keep=materialize)
    assert {name: df.count() for name, df in first.items()} == {"accounts": 1, "posts": 2, "snapshots": 2, "comments": 1}
    # the comment without an external id has no key and is appended again
    assert {name: df.count() for name, df in again.items()} == {"accounts": 1, "posts": 2, "snapshots": 2, "comments": 2}
    assert {tuple(r) for r in report.collect()} == {
        ("accounts", "stored", 1), ("posts", "stored", 2), ("metrics", "stored", 2), ("comments", "stored", 1), ("comments", "unknown_post", 1)}
    assert ("metrics", "duplicate_snapshot", 2) in {tuple(r) for r in second.collect()}
    post = first["posts"].filter("external_id = '1'").first()
    assert (post.content_type, post.hashtags) == ("photo", ["#promo"])
    assert len(first["comments"].first().author_hash) == 64


def test_keyless_comments_stay_two(spark, export):
    batch = staged(export)
    two = batch["comments"].filter("external_id is null")
    batch["comments"] = two.unionByName(two.withColumn("_ord", F.lit(7).cast("long")))
    out, _ = I.normalize_and_store(batch, empty(spark), NOW, keep=materialize)
    ids = [r.comment_id for r in out["comments"].collect()]
    assert len(ids) == len(set(ids)) == 2 and all(len(i) == 32 for i in ids)
    from agorametrics.plans.ingest_queries import analyze_new_comments

    none = spark.createDataFrame([], "comment_id string, language string, sentiment string, sentiment_score double, model_name string, "
                                     "model_version string, analyzed_at timestamp")
    done = analyze_new_comments(out["comments"], none, NOW)
    assert {r.comment_id for r in done.collect()} == set(ids)
    assert analyze_new_comments(out["comments"], done, NOW).count() == 2


def test_cursors(table):
    rows = table([("y", "a", "2026-07-05 00:00:00"), ("y", "a", "2026-07-06 00:00:00"), ("y", "b", "2026-05-01 00:00:00"),
                  ("y", "b", "2026-03-01 00:00:00")], "source string,account string,t timestamp")
    cursors = table([("y", "a", "2026-07-05 00:00:00"), ("z", "c", "2026-01-01 00:00:00")], "source string,account string,cursor_value timestamp")
    keys = ["source", "account"]
    assert {str(r.t) for r in I.cursor_filter(rows, cursors, keys, "t", NOW).collect()} == {
        "2026-07-06 00:00:00", "2026-05-01 00:00:00", "2026-03-01 00:00:00"}
    # without a window of the caller's a first sync takes all
    first = I.cursor_filter(rows, cursors, keys, "t", NOW, first_sync_days=90).collect()
    assert {str(r.t) for r in first} == {"2026-07-06 00:00:00", "2026-05-01 00:00:00"}
    moved = {(r.source, r.account): str(r.cursor_value) for r in I.advance_cursors(cursors, rows.select(*keys).distinct(), keys, NOW).collect()}
    assert moved == {("y", "a"): NOW, ("y", "b"): NOW, ("z", "c"): "2026-01-01 00:00:00"}


def test_retention(table):
    ages = table([(str(dt.datetime(2026, 7, 10) - dt.timedelta(days=d)),) for d in (45, 31, 10, 0)], "captured_at timestamp")
    row = I.retention_report(ages, NOW, 30).first()
    assert (row.deleted, row.remaining, str(row.oldest_remaining)) == (2, 2, "2026-06-30 00:00:00")
    assert I.retained(ages, NOW, 30).count() == 2
    with pytest.raises(ValueError):
        I.retention_cutoff(NOW, 0)


def test_archive_and_topics(spark, table):
    path = shared_dir(spark, "archive")
    rows = events(table, ("youtube", "post", "1", None, None, "{}"), ("youtube", "post", "2", None, None, "{}"))
    for run, part in (("a", rows), ("b", rows.withColumn("captured_at", F.lit("2026-01-01").cast("timestamp"))), ("a", rows)):
        SK.archive_raw(part, path, run)  # run a is tried twice
    assert SK.read_archive(spark, path).count() == 4
    kept = SK.read_archive(spark, path, NOW, 30)
    assert kept.count() == 2
    assert "captured_date" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    path = shared_dir(spark, "topics")
    topics = table([(1, 0, 5), (2, 0, 7)], "account_id long,cluster_id long,comment_count long")
    window = ("2026-06-10", "2026-07-10")
    SK.replace_topics(topics, None, topics, path, *window)
    # account 1 ran again and has no topic any more
    SK.replace_topics(topics.filter("false"), spark.read.parquet(path), topics.filter("account_id = 1"), path, *window)
    assert [(r.account_id, r.comment_count) for r in spark.read.parquet(path).collect()] == [(2, 7)]


def test_purge_deletes_from_disk(spark, table):
    path = shared_dir(spark, "archive")
    base = events(table, ("youtube", "post", "1", None, None, "{}"))
    for at in ("2026-05-26 00:00:00", "2026-06-09 23:00:00", "2026-06-10 05:00:00", "2026-06-10 15:00:00", "2026-07-10 00:00:00"):
        SK.archive_raw(base.withColumn("captured_at", F.lit(at).cast("timestamp")), path, "r" + at[8:13].replace(" ", "-"))
    report = SK.purge_archive(spark, path, "2026-07-10 12:00:00", 30).first()
    assert (report.deleted, report.remaining, str(report.oldest_remaining)) == (3, 2, "2026-06-10 15:00:00")
    left = spark.read.parquet(path).collect()
    assert sorted(str(r.captured_at) for r in left) == ["2026-06-10 15:00:00", "2026-07-10 00:00:00"]


def test_undated_snapshots_are_rejected_once(spark, table):
    path = shared_dir(spark, "snaps")
    schema = "post_id long,captured_at timestamp,likes long,_ord long"
    batch = table([(1, "2026-07-01 00:00:00", 5, 1), (1, None, 6, 2), (1, None, 7, 3), (None, "2026-07-01 00:00:00", 8, 4)], schema)
    for _ in range(2):
        SK.append_snapshots(batch, path, run="r1")
    SK.append_snapshots(table([(2, None, 9, 1)], schema), path, run="r2")
    assert [(r.post_id, r.likes) for r in spark.read.parquet(path).collect()] == [(1, 5)]
    assert sorted((r.likes, r.reason) for r in SK.rejected_snapshots(spark, path).collect()) == [
        (6, "missing_capture_time"), (7, "missing_capture_time"), (8, "missing_post"), (9, "missing_capture_time")]


def test_history(table):
    posts = table([(1, i, f"2026-07-0{i} 00:00:00", t) for i, t in enumerate(["a", " b ", None, "  ", "c"], 1)],
                  "account_id long,post_id long,published_at timestamp,text_content string")
    assert H.brand_context(posts).first().context == "- c\n- b"
    runs = table([(i, 1 + i % 2, '{"tool_calls":["x"]}' if i else None) for i in range(5)], "id long,account_id long,reasoning_trace string")
    assert [(r.id, r.trace) for r in H.recent_runs(runs, 2, account_id=1).collect()] == [(4, ["x"]), (2, ["x"])]
    calls = table([(1, [("p", "m", "error", "e" * 700), ("q", "m", "ok", None)])],
                  "id long,attempts array<struct<provider:string,model:string,status:string,error:string>>")
    rows = H.attempt_depth(calls).orderBy("fallback_depth").collect()
    assert [(r.fallback_depth, r.provider, r.error and len(r.error)) for r in rows] == [(0, "p", 700), (1, "q", None)]
    assert len(H.attempt_depth(calls, error_chars=50).orderBy("fallback_depth").first().error) == 50


def test_stream_dedupe_is_exact_across_batches(spark, table):
    root = shared_dir(spark, "stream")
    schema = "post_id long,captured_at timestamp,likes long,_ord long"
    first = table([(1, "2026-07-01 00:00:00", 5, 1), (1, "2026-07-01 00:00:00", 6, 2), (2, "2026-07-02 00:00:00", 7, 3)], schema)
    # months later the first snapshot arrives once more
    late = table([(1, "2026-07-01 00:00:00", 99, 9), (3, "2026-12-01 00:00:00", 1, 10), (4, None, 8, 11)], schema)
    undated = table([(5, None, 8, 12)], schema)

    def run():
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/in")
        J.dedupe_snapshots(stream, f"{root}/out", f"{root}/ck", f"{root}/rejected").awaitTermination()
        return {(r.post_id, r.likes) for r in spark.read.parquet(f"{root}/out").collect()}

    first.write.parquet(f"{root}/in")
    assert run() == {(1, 5), (2, 7)}
    late.write.mode("append").parquet(f"{root}/in")
    assert run() == {(1, 5), (2, 7), (3, 1)}
    undated.write.mode("append").parquet(f"{root}/in")
    assert run() == {(1, 5), (2, 7), (3, 1)}
    assert {(r.post_id, r.reason) for r in spark.read.parquet(f"{root}/rejected").collect()} == {
        (4, "missing_capture_time"), (5, "missing_capture_time")}


def test_stream_ingest_folds_batches(spark, table):
    root = shared_dir(spark, "stream")

    def land(account, title, day):
        rows = [("youtube", "account", account, account, None, '{"snippet":{"title":"%s"},"statistics":{"subscriberCount":"7"}}' % title,
                 f"2026-07-0{day} 00:00:00")]
        rows.append(("youtube", "post", "v1", account, None,
                     '{"snippet":{"title":"%s"},"contentDetails":{"duration":"PT10S","videoPublishedAt":"2026-07-01T00:00:00Z"}}' % title,
                     f"2026-07-0{day} 00:00:00"))
        rows.append(("youtube", "metric", "v1", account, None, '{"statistics":{"likeCount":"-4"}}', f"2026-07-0{day} 00:00:00"))
        table(rows, EVENT).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema(J.LANDING).json(f"{root}/in")
        J.ingest_payloads(stream, f"{root}/log", f"{root}/ck", NOW).awaitTermination()

    land("a", "old", 1)
    land("a", "new", 2)
    account = J.folded(spark, f"{root}/log", "accounts").collect()
    assert [(r.handle, r.followers_count) for r in account] == [("new", 7)]
    assert [r.text_content for r in J.folded(spark, f"{root}/log", "posts").collect()] == ["new"]
    assert J.folded(spark, f"{root}/log", "snapshots").count() == 0
    assert J.folded(spark, f"{root}/log", "cursors").count() == 2
    assert [r.reason for r in spark.read.parquet(f"{root}/log/rejected").collect()] == ["negative_likes"] * 2


def test_stream_keeps_comments_without_an_id(spark, table):
    root = shared_dir(spark, "stream")
    text = '{"created_time":"2026-07-01T09:00:00+0000","message":"%s","like_count":%d%s}'
    rows = [("facebook", "comment", None, "a", "p", text % (f"t{i}", i, ""), "2026-07-01 00:00:00") for i in range(5)]
    rows += [("facebook", "comment", None, "a", "p", text % (t, 0, ',"id":"c1"'), "2026-07-01 00:00:00") for t in ("one", "two")]
    table(rows, EVENT).write.json(f"{root}/in")

    def folded():
        stream = spark.readStream.schema(J.LANDING).json(f"{root}/in")
        J.ingest_payloads(stream, f"{root}/log", f"{root}/ck", NOW).awaitTermination()
        return sorted((r.external_id or "", r.text_content) for r in J.folded(spark, f"{root}/log", "comments").collect())

    first = folded()
    assert first[:5] == [("", f"t{i}") for i in range(5)] and len(first) == 6
    assert folded() == first  # nothing new arrived
    table(rows[:1], EVENT).write.mode("append").json(f"{root}/in")
    assert len(folded()) == 7  # another comment, as far as anyone can tell
    J.compact(spark, f"{root}/log", "comments", f"{root}/folded")
    assert J.folded(spark, f"{root}/folded", "comments").count() == 7


def test_ties_of_a_batch_are_broken_by_content(spark, table):
    """Two payloads of one account at one time: the same one wins in whatever order they come."""
    rows = [("p", "a", f"h{i}", "n", i, False, 0, 7) for i in range(6)]
    schema = "platform string,external_id string,handle string,display_name string,followers_count long,is_competitor boolean,batch_id long,_ord long"
    won = {J._fold(table(order, schema), "accounts").first().handle for order in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(won) == 1


def test_stream_series_follow_late_rows(spark, table):
    root = shared_dir(spark, "stream")
    schema = "account_id long,published_at timestamp,likes long"

    def run(rows):
        table(rows, schema).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(table(rows, schema).schema).parquet(f"{root}/in")
        J.timeseries(stream, "likes", f"{root}/log", f"{root}/ck").awaitTermination()
        return {(r.label, r.value) for r in J.timeseries_state(spark, f"{root}/log").collect()}

    assert run([(1, "2026-07-01 10:10:00", 5), (1, "2026-07-01 10:50:00", 6)]) == {("2026-07-01 11:00", 11.0)}
    assert run([(1, "2026-07-01 10:55:00", 1), (1, "2026-07-01 12:00:00", 2)]) == {("2026-07-01 11:00", 12.0), ("2026-07-01 13:00", 2.0)}
    late = run([(1, "2026-06-20 10:10:00", 100)])
    assert late == {("2026-06-20 11:00", 100.0), ("2026-07-01 11:00", 12.0), ("2026-07-01 13:00", 2.0)}
    J.compact_timeseries(spark, f"{root}/log", f"{root}/folded")
    assert {(r.label, r.value) for r in J.timeseries_state(spark, f"{root}/folded").collect()} == late


def test_scratch_gives_its_space_back(spark):
    with scratch():
        kept = materialize(spark.range(100), "t")
        assert kept.count() == 100
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(path).count() == 0
