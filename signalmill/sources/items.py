"""Landed scrape items: reading, normalising to signals, interest series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.measures import author_tier, clamp_interest, engagement, to_day


def read_items(spark: SparkSession, path: str, platform: str) -> DataFrame:
    """A1: one JSON item per line: (platform, raw, item variant); lines that are no objects have a null item."""
    return parse_items(spark.read.text(path).select(F.lit(platform).alias("platform"), F.col("value").alias("raw")))


def parse_items(df: DataFrame) -> DataFrame:
    v = F.try_parse_json("raw")
    return df.withColumn("item", F.when(F.ltrim(F.col("raw")).startswith("{"), v))


def item_stats(items: DataFrame) -> DataFrame:
    """A1: items and dropped non-objects per platform."""
    return items.groupBy("platform").agg(F.count("*").alias("items"), F.count_if(F.col("item").isNull()).alias("dropped"))


BENCHMARK = "name string, growth string, description string, sheets array<string>, expected string"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A2: a multi-line JSON array of benchmark entries."""
    return spark.read.option("multiLine", True).schema(BENCHMARK).json(path)


def explode_payload(candidates: DataFrame) -> DataFrame:
    """Draft payloads to seed rows, without killed ones, one per language query."""
    kind = "array<struct<topic:string,status:string,queries:array<struct<language:string,keywords:array<string>>>>>"
    c = candidates.select("candidate_id", F.posexplode(F.from_json("payload", kind)).alias("place", "t")).where("t.status is null or t.status <> 'killed'")
    return c.select("candidate_id", "place", F.col("t.topic").alias("topic"), F.inline("t.queries"))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("item", f"$.{path}", kind)


def _first(paths: list[str], kind: str) -> Column:
    """First path that holds something."""
    return F.coalesce(*[_get(p, kind) for p in paths]) if paths else F.lit(None).cast(kind)


def _stamp(iso: list[str], seconds: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_get(p, "string")) for p in iso], *[F.timestamp_seconds(_get(p, "double")) for p in seconds], F.lit(None).cast("timestamp"))


def _strings(path: str) -> Column:
    """Array of plain strings, or of objects with a name."""
    plain, named = _get(path, "array<string>"), _get(path, "array<struct<name:string>>")
    of_objects = F.when(F.exists(named, lambda x: x.isNotNull()), F.transform(named, lambda x: x["name"]))
    return F.coalesce(of_objects, plain, F.array().cast("array<string>"))


#: Field chains of each platform's items, in order of precedence.
FIELDS = {
    "instagram": dict(id=["id", "shortCode"], text=["caption", "text"], iso=["timestamp"], author=["ownerUsername"], followers=["ownerFollowersCount"], verified=["verified"], url=["url"],
                      likes=["likesCount"], comments=["commentsCount"], shares=["sharesCount", "reposts"], views=["videoViewCount"], tags="hashtags", tier=True),
    "tiktok": dict(id=["id"], text=["text", "desc"], seconds=["createTime"], iso=["createTimeISO"], author=["authorMeta.name"], followers=["authorMeta.fans", "authorFollowers"],
                   verified=["authorMeta.verified"], url=["webVideoUrl"], likes=["diggCount", "likesCount"], comments=["commentCount", "commentsCount"], shares=["shareCount", "sharesCount"],
                   views=["playCount", "videoViewCount"], tags="hashtags", tier=True),
    "reddit": dict(id=["id"], join=[["title"], ["body", "selftext"]], iso=["createdAt", "created_iso"], seconds=["created", "created_utc"], author=["username", "author"], url=["link", "url"],
                   likes=["upVotes", "score", "ups"], comments=["numberOfComments", "numComments", "num_comments"]),
    "x": dict(id=["id"], text=["text", "full_text"], iso=["createdAt"], author=["author.username", "authorUsername"], followers=["author.followers", "authorFollowers"],
              verified=["author.verified", "verified"], url=["url", "tweetUrl"], likes=["likeCount", "favoriteCount"], comments=["replyCount"], shares=["retweetCount"], views=["viewCount"]),
    "youtube": dict(id=["id"], join=[["title"], ["text", "description"]], iso=["date"], author=["channelName"], followers=["numberOfSubscribers"], url=["url"],
                    likes=["likes", "likeCount"], comments=["commentsCount", "commentCount"], views=["viewCount", "views"]),
    "xiaohongshu": dict(id=["id", "noteId"], text=["title", "desc", "content"], seconds=["time"], author=["user.nickname"], followers=["user.fans", "authorFollowers"], verified=["user.verified"],
                        url=["url"], likes=["likes", "likedCount"], comments=["comments", "commentCount"], shares=["shares", "shareCount"], saves=["collected", "collectedCount", "saves"],
                        tags="tagList", geography="CN", tier=True),
}


def _signal(platform: str) -> list[Column]:
    """The columns of a platform's signal."""
    f = FIELDS[platform]
    empty = lambda c: F.when(c != "", c)
    if "join" in f:
        text = F.concat_ws(" ", *[empty(_first(p, "string")) for p in f["join"]])
    else:
        text = _first(f["text"], "string")
    url = empty(_first(f["url"], "string"))
    if platform == "reddit":
        link = empty(_get("permalink", "string"))
        url = F.coalesce(url, F.when(link.startswith("http"), link).otherwise(F.concat(F.lit("https://www.reddit.com"), link)))
    counts = {k: _first(f.get(k, []), "double") for k in ("likes", "comments", "shares", "views", "saves")}
    e = engagement(F.lit(platform), counts)
    zero = lambda c: F.nullif(c, F.lit(0.0))
    followers = zero(_first(f.get("followers", []), "double")).cast("long")
    return [
        F.lit(platform).alias("platform"), empty(_first(f["id"], "string")).alias("source_id"), url.alias("source_url"), _stamp(f.get("iso", []), f.get("seconds", [])).alias("posted_at"),
        empty(_first(f["author"], "string")).alias("author"), followers.alias("followers"), (author_tier(followers) if f.get("tier") else F.lit("nano")).alias("author_tier"),
        F.coalesce(_first(f.get("verified", []), "boolean"), F.lit(False)).alias("verified"), empty(text).alias("text"),
        (_strings(f["tags"]) if "tags" in f else F.array().cast("array<string>")).alias("hashtags"), F.lit(f.get("geography")).cast("string").alias("geography"),
        *[zero(c).cast("long").alias(k) for k, c in counts.items()], e["score"].alias("score"), e["composite"].alias("composite"),
    ]


def normalize_platform(items: DataFrame, platform: str, carry: tuple = ()) -> DataFrame:
    """Signals of one platform; items without an id are dropped. `carry` names columns of items that signals keep."""
    return items.where(F.col("platform") == platform).select(*carry, *_signal(platform)).where("source_id is not null")


def normalize(items: DataFrame, carry: tuple = ()) -> DataFrame:
    """Signals of all known platforms; others, and items without an id, are dropped.

    Each branch filters its platform before the JSON is parsed, so an item is parsed once;
    landed by platform, its files are read once too. One CASE over all platforms would be
    one pass, but more code than Spark compiles for a stage.
    """
    return reduce(DataFrame.unionByName, [normalize_platform(items, p, carry) for p in FIELDS])


def interest_flat(items: DataFrame) -> DataFrame:
    """(item_id, keyword, geo, bucket_date, interest_value) of items that are one point themselves."""
    keyword = F.trim(_first(["keyword", "searchTerm", "term"], "string"))
    value = _first(["value", "extractedValue"], "double")
    day = to_day(_first(["date", "formattedTime", "time"], "string"))
    out = items.select("item_id", keyword.alias("keyword"), F.coalesce(_first(["geo", "country"], "string"), F.lit("")).alias("geo"), day.alias("bucket_date"), value.alias("v"))
    out = out.where("keyword <> '' and bucket_date is not null and v is not null")
    return out.select("item_id", "keyword", "geo", "bucket_date", clamp_interest(F.col("v")).alias("interest_value"))


def interest_series(items: DataFrame) -> DataFrame:
    """The same columns of items with a list of points.

    A point's shape decides, in order: tagged objects, `values` in parallel with the item's
    keywords (or all of its one keyword), `value` in parallel, one value, or a map by keyword.
    """
    flat = interest_flat(items).select("item_id").distinct()
    points = F.coalesce(*[_get(p, "array<variant>") for p in ("interestOverTime", "interest_over_time", "timelineData", "data")])
    one = F.trim(_first(["keyword", "searchTerm", "term"], "string"))
    many = F.coalesce(_get("keywords", "array<string>"), _get("queries", "array<string>"))
    p = items.join(flat, "item_id", "left_anti").select(
        "item_id", F.when(one != "", one).alias("one"), F.filter(F.transform(many, F.trim), lambda x: x != "").alias("many"),
        F.coalesce(_first(["geo", "country"], "string"), F.lit("")).alias("geo"), F.explode(points).alias("p"),
    )
    at = lambda path, kind: F.try_variant_get("p", f"$.{path}", kind)
    day = to_day(F.coalesce(at("date", "string"), at("formattedTime", "string"), at("time", "string")))
    tagged = at("values", "array<struct<keyword:string,query:string,value:double,extractedValue:double>>")
    several = F.coalesce(at("values", "array<double>"), at("value", "array<double>"))
    names = F.when(F.size("many") == F.size(several), F.col("many")).when(F.col("one").isNotNull(), F.transform(several, lambda _: F.col("one")))
    single = F.coalesce(at("value", "double"), at("extractedValue", "double"))
    keyed = F.map_filter(F.try_variant_get("p", "$", "map<string,double>"), lambda k, v: ~k.isin("date", "formattedTime", "time", "value", "values", "extractedValue") & v.isNotNull())
    pair = lambda k, v: F.struct(F.trim(k).alias("keyword"), v.alias("v"))
    rows = (
        F.when(F.exists(tagged, lambda x: x.isNotNull()), F.transform(tagged, lambda x: pair(F.coalesce(x["keyword"], x["query"], F.col("one")), F.coalesce(x["value"], x["extractedValue"]))))
        .when(several.isNotNull(), F.zip_with(names, several, pair))
        .when(single.isNotNull() & F.col("one").isNotNull(), F.array(pair(F.col("one"), single)))
        .otherwise(F.transform(F.map_entries(keyed), lambda x: pair(x["key"], x["value"])))
    )
    out = p.select("item_id", "geo", day.alias("bucket_date"), F.explode(rows).alias("r")).where("bucket_date is not null and r.keyword <> '' and r.v is not null")
    return out.select("item_id", F.col("r.keyword").alias("keyword"), "geo", "bucket_date", clamp_interest(F.col("r.v")).alias("interest_value"))
