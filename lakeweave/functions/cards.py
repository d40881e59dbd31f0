"""Text cards of platform payloads: each a column of JSON in, a struct of text and media (kind, url) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.media import best_video_variant, over_cap
from lakeweave.functions.urls import let

SHORT_LINK = r"https?://t\.co/\S+"  # fixed value
BLANK_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
DAY, MINUTE = "MMMM dd, yyyy", "MMMM dd, yyyy 'at' HH:mm"
MEDIA = "array<struct<kind:string,url:string>>"


def _lines(*lines: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in lines))


def _text(*parts: str | Column) -> Column:
    """Parts side by side; a null one reads None."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def _media(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda m: m["url"].isNotNull() & (m["url"] != ""))


def _medium(kind: str, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), url.alias("url"))


def _card(text: Column, media: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.array().cast(MEDIA) if media is None else media.cast(MEDIA)).alias("media"))


def _truthy(*options: Column) -> Column:
    """The first that is neither null, nor empty, nor 0."""
    return F.coalesce(*(F.when(~F.coalesce(o.cast("string"), F.lit("")).isin("", "0", "0.0"), o.cast("string")) for o in options))


def _thousands(n: Column) -> Column:
    return F.format_number(F.coalesce(n, F.lit(0).cast("long")), 0)


X_POST = "struct<text:string,created_at:timestamp,author:struct<name:string,username:string>,metrics:struct<like_count:long,retweet_count:long,reply_count:long,impression_count:long>,media:array<struct<type:string,url:string,variants:array<struct<content_type:string,bit_rate:long,url:string>>>>>"


def x_post_card(payload: Column, media_number: Column | None = None) -> Column:
    """A post: text without short links, then photos and best video variants. A media number picks one distinct medium, from 1. Media of unknown type give a null card."""
    return let(F.from_json(payload, X_POST), lambda p: _x_post_card(p, media_number))


def _x_post_card(p: Column, media_number: Column | None) -> Column:
    found = F.transform(F.coalesce(p["media"], F.array()), lambda m: F.when(m["type"] == "photo", F.struct(F.lit("image").alias("kind"), m["url"].alias("url"))).when(m["type"].isin("video", "animated_gif"), F.struct(F.lit("video").alias("kind"), best_video_variant(m["variants"]).alias("url"))))
    odd = F.exists(F.coalesce(p["media"], F.array()), lambda m: ~F.coalesce(m["type"].isin("photo", "video", "animated_gif"), F.lit(False)))
    media = F.array_distinct(F.filter(found, lambda m: m["url"].isNotNull()))
    if media_number is not None:
        one = F.try_element_at(media, media_number)
        media = F.when(media_number.isNull(), media).otherwise(F.filter(F.array(one), lambda m: m.isNotNull()))
    m = p["metrics"]
    text = _lines(
        "**Post on X**",
        _text("Author: ", p["author"]["name"], ", @", p["author"]["username"]),
        _text("Posted on: ", F.date_format(p["created_at"], MINUTE)),
        _text("Likes: ", m["like_count"], " - Retweets: ", m["retweet_count"], " - Replies: ", m["reply_count"], " - Views: ", m["impression_count"]),
        "",
        F.regexp_replace(F.regexp_replace(p["text"], SHORT_LINK, ""), BLANK_ENDS, ""),
    )
    return F.when(p.isNotNull() & ~odd, _card(text, media))


X_USER = "struct<name:string,username:string,created_at:timestamp,profile_image_url:string,profile_banner_url:string,url:string,location:string,description:string,verified:boolean,verified_type:string,protected:boolean,withheld:string,parody:boolean,verified_followers_count:long,public_metrics:map<string,long>>"


def x_profile_card(payload: Column) -> Column:
    """A profile with its metrics and account properties."""
    return let(F.from_json(payload, X_USER), lambda p: _x_profile_card(p))


def _x_profile_card(p: Column) -> Column:
    image = F.replace(p["profile_image_url"], F.lit("_normal"), F.lit(""))
    verified = F.coalesce(p["verified"], F.lit(False))
    name = lambda k: F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.replace(F.substring(k, F.lit(2), F.length(k)), F.lit("_"), F.lit(" "))))
    metrics = F.transform(F.map_entries(p["public_metrics"]), lambda e: F.concat(F.lit(" - "), name(e["key"]), F.lit(": "), e["value"].cast("string")))
    metrics = F.concat(metrics, F.when(p["verified_followers_count"].isNotNull(), F.array(F.concat(F.lit(" - Verified followers count: "), p["verified_followers_count"].cast("string")))).otherwise(F.array().cast("array<string>")))
    properties = F.array_compact(F.array(
        F.when(verified, _text("- Verified (", p["verified_type"], ")")).otherwise("- Not verified"),
        F.when(p["protected"], "- Protected"), F.when(F.coalesce(p["withheld"], F.lit("")) != "", "- Withheld"), F.when(p["parody"], "- Marked as parody"),
    ))
    text = _lines(
        "**Profile on X**", _text("User: ", p["name"], ", @", p["username"]), _text("Joined: ", F.coalesce(F.date_format(p["created_at"], DAY), F.lit("Unknown"))),
        _text("Profile image: ", F.nullif(image, F.lit(""))), _text("Profile banner: ", F.nullif(p["profile_banner_url"], F.lit(""))), "",
        _text("URL: ", p["url"]), _text("Location: ", p["location"]), _text("Description: ", p["description"]), "",
        "Metrics:", F.array_join(metrics, "\n"), "", "Account properties:", F.array_join(properties, "\n"),
    )
    return F.when(p.isNotNull(), _card(text, _media(_medium("image", image), _medium("image", p["profile_banner_url"]))))


BLUESKY_FEATURES = "array<struct<features:array<struct<`$type`:string,tag:string,did:string,uri:string>>>>"
BLUESKY_POST = f"struct<`$type`:string,post:struct<uri:string,like_count:long,reply_count:long,repost_count:long,author:struct<handle:string,display_name:string>,record:struct<text:string,created_at:string,facets:{BLUESKY_FEATURES},reply:struct<parent:struct<uri:string>>>,embed:struct<`$type`:string,playlist:string,images:array<struct<fullsize:string>>>>>"


def bluesky_error(payload: Column) -> Column:
    """Why a post can't be shown; null if it can."""
    return _bluesky_error(F.get_json_object(payload, "$['$type']"))


def _bluesky_error(kind: Column) -> Column:
    return F.when(kind == "app.bsky.feed.defs#notFoundPost", "not found").when(kind == "app.bsky.feed.defs#blockedPost", "blocked")


def bluesky_post_card(payload: Column, parent_handle: Column | None = None) -> Column:
    """A post with images or a video; ``parent_handle`` is the author of the post that it replies to. Missing and blocked posts give null."""
    return let(F.from_json(payload, BLUESKY_POST), lambda whole: let(whole["post"], lambda p: _bluesky_post_card(whole["$type"], p, parent_handle)))


def _bluesky_post_card(kind: Column, p: Column, parent_handle: Column | None) -> Column:
    record, author, embed = p["record"], p["author"], p["embed"]
    parent = record["reply"]["parent"]["uri"]
    handle = F.lit(None).cast("string") if parent_handle is None else parent_handle
    reply = F.when(parent.isNotNull() & handle.isNotNull(), F.concat(F.lit("Reply to: https://bsky.app/profile/"), handle, F.lit("/post/"), F.element_at(F.split(parent, "/"), -1)))
    zero, blank = F.lit(0), F.lit("")
    text = _lines(
        "**Post on Bluesky**",
        _text("Author: ", F.coalesce(author["display_name"], blank), " (@", F.coalesce(author["handle"], blank), ")"),
        _text("Posted on: ", F.left(record["created_at"], F.length(record["created_at"]) - 1)),
        _text("Likes: ", F.coalesce(p["like_count"], zero), " - Comments: ", F.coalesce(p["reply_count"], zero), " - Shares: ", F.coalesce(p["repost_count"], zero)),
        reply,
        record["text"],
    )
    images = F.transform(F.coalesce(embed["images"], F.array()), lambda i: _medium("image", i["fullsize"]))
    media = F.when(embed["$type"] == "app.bsky.embed.images#view", F.filter(images, lambda m: m["url"].isNotNull())).when(embed["$type"] == "app.bsky.embed.video#view", _media(_medium("video", embed["playlist"]))).otherwise(F.array().cast(MEDIA))
    return F.when(p.isNotNull() & _bluesky_error(kind).isNull(), _card(text, media))


def with_reply_authors(posts: DataFrame) -> DataFrame:
    """Add parent_handle to posts (uri, payload), from the rows of the posts replied to."""
    p = F.from_json("payload", BLUESKY_POST)["post"]
    at = posts.withColumn("__parent", p["record"]["reply"]["parent"]["uri"])
    of = posts.select(F.col("uri").alias("__parent"), p["author"]["handle"].alias("parent_handle"))
    return at.join(of, "__parent", "left").drop("__parent")


def bluesky_facets(payload: Column) -> Column:
    """Struct of hashtags, mentions and links."""
    return let(F.from_json(payload, BLUESKY_POST)["post"]["record"]["facets"], _bluesky_facets)


def _bluesky_facets(facets: Column) -> Column:
    features = F.coalesce(F.flatten(F.transform(facets, lambda f: F.coalesce(f["features"], F.array()))), F.array())
    pick = lambda kind, field: F.transform(F.filter(features, lambda x: x["$type"] == f"app.bsky.richtext.facet#{kind}"), lambda x: F.coalesce(x[field], F.lit("")))
    return F.struct(pick("tag", "tag").alias("hashtags"), pick("mention", "did").alias("mentions"), pick("link", "uri").alias("links"))


BLUESKY_USER = "struct<handle:string,display_name:string,created_at:string,avatar:string,banner:string,description:string,followers_count:long,follows_count:long,posts_count:long>"


def bluesky_profile_card(payload: Column, url: Column) -> Column:
    return let(F.from_json(payload, BLUESKY_USER), lambda p: _bluesky_profile_card(p, url))


def _bluesky_profile_card(p: Column, url: Column) -> Column:
    avatar, banner = F.nullif(p["avatar"], F.lit("")), F.nullif(p["banner"], F.lit(""))
    text = _lines(
        "**Profile on Bluesky**", _text("User: ", p["display_name"], " (@", p["handle"], ")"), _text("Created on: ", p["created_at"]),
        _text("Profile image: ", avatar), _text("Profile banner: ", banner), "", _text("URL: ", url),
        _text("Description: ", F.coalesce(F.nullif(p["description"], F.lit("")), F.lit("No description provided"))), "", "Metrics:",
        _text("- Follower count: ", p["followers_count"]), _text("- Following count: ", p["follows_count"]), _text("- Post count: ", p["posts_count"]),
    )
    return F.when(p.isNotNull(), _card(text, _media(_medium("image", avatar), _medium("image", banner))))


TIKTOK_VIDEO = "struct<username:string,uploader:string,video_description:string,description:string,create_time:string,upload_date:string,video_duration:long,duration:long,view_count:long,like_count:long,comment_count:long,share_count:long,hashtag_names:array<string>,voice_to_text:string,region_code:string,video_url:string,thumbnail_url:string>"


def tiktok_video_card(payload: Column) -> Column:
    """A video from API fields, with those of the fallback where they are empty; the video, else its thumbnail."""
    return let(F.from_json(payload, TIKTOK_VIDEO), lambda p: _tiktok_video_card(p))


def _tiktok_video_card(p: Column) -> Column:
    unknown = F.lit("Unknown")
    tags = F.when(F.size(p["hashtag_names"]) > 0, F.concat(F.lit("Hashtags: "), F.array_join(F.transform(p["hashtag_names"], lambda t: F.concat(F.lit("#"), t)), ", ")))
    voice = F.when(F.coalesce(p["voice_to_text"], F.lit("")) != "", F.concat(F.lit("Voice transcription: "), p["voice_to_text"]))
    text = _lines(
        "**TikTok Video** (API data)",
        _text("Author: @", F.coalesce(_truthy(p["username"]), p["uploader"], unknown)),
        _text("Posted: ", F.coalesce(_truthy(p["create_time"]), p["upload_date"], unknown)),
        _text("Duration: ", F.coalesce(_truthy(p["video_duration"]), p["duration"].cast("string"), F.lit("0")), "s"),
        _text("Region: ", F.coalesce(p["region_code"], unknown)),
        _text("Views: ", _thousands(p["view_count"]), " - Likes: ", _thousands(p["like_count"]), " - Comments: ", _thousands(p["comment_count"]), " - Shares: ", _thousands(p["share_count"])),
        tags, "", F.coalesce(_truthy(p["video_description"]), p["description"]), "", voice,
    )
    video = F.nullif(p["video_url"], F.lit(""))
    return F.when(p.isNotNull(), _card(text, F.when(video.isNotNull(), _media(_medium("video", video))).otherwise(_media(_medium("image", p["thumbnail_url"])))))


TIKTOK_USER = "struct<display_name:string,bio_description:string,follower_count:long,following_count:long,likes_count:long,video_count:long,is_verified:boolean,avatar_url:string>"


def tiktok_profile_card(payload: Column, username: Column, url: Column) -> Column:
    return let(F.from_json(payload, TIKTOK_USER), lambda p: _tiktok_profile_card(p, username, url))


def _tiktok_profile_card(p: Column, username: Column, url: Column) -> Column:
    avatar = F.nullif(p["avatar_url"], F.lit(""))
    text = _lines(
        "**TikTok Profile**", _text("User: ", F.coalesce(p["display_name"], F.lit("")), " (@", username, ")"), F.when(p["is_verified"], "Verified").otherwise("Not verified"),
        _text("Profile image: ", avatar), "", _text("URL: ", url), _text("Bio: ", F.coalesce(p["bio_description"], F.lit(""))), "", "Metrics:",
        *(_text(f"- {n}: ", _thousands(p[c])) for n, c in (("Followers", "follower_count"), ("Following", "following_count"), ("Likes", "likes_count"), ("Videos", "video_count"))),
    )
    return F.when(p.isNotNull(), _card(text, _media(_medium("image", avatar))))


def _count(v: Column, key: str) -> Column:
    """A whole number with separators; a missing key is 0, null and anything else Unknown."""
    return let(F.try_variant_get(v, f"$.{key}", "variant"), lambda x: F.when(x.isNull(), "0").when(F.schema_of_variant(x) == "BIGINT", F.format_number(F.try_variant_get(x, "$", "long"), 0)).otherwise("Unknown"))


def generic_video_card(payload: Column, platform: Column, max_video_size: Column | None = None) -> Column:
    """A video of any platform. Fields that are missing have defaults, those that are null read None. Dates of eight digits become ISO dates, impossible ones stay. A video that is absent or over the cap gives way to its thumbnail."""
    return let(F.try_parse_json(payload), lambda v: _generic_video_card(v, platform, max_video_size))


def _generic_video_card(v: Column, platform: Column, max_video_size: Column | None) -> Column:
    get = lambda k, kind="string": F.try_variant_get(v, f"$.{k}", kind)
    # a missing key has a default, one that is null reads None
    said = lambda k, default: F.when(get(k, "variant").isNull(), default).otherwise(F.coalesce(get(k), F.lit("None")))
    day = let(said("upload_date", ""), lambda r: F.coalesce(F.date_format(F.try_to_timestamp(F.when(r.rlike(r"^\d{8}$"), r), F.lit("yyyyMMdd")), "yyyy-MM-dd"), r))
    text = _lines(
        _text("**", platform, " Video**"), _text("Author: @", said("uploader", "Unknown")), _text("Posted: ", day),
        _text("Duration: ", said("duration", "0"), "s"),
        _text("Views: ", _count(v, "view_count"), " - Likes: ", _count(v, "like_count"), " - Comments: ", _count(v, "comment_count")), "", said("description", ""),
    )
    over = F.lit(False) if max_video_size is None else over_cap(get("filesize", "long"), max_video_size)
    media = let(F.when(~over, get("video_url")), lambda video: F.when(video.isNotNull(), _media(_medium("video", video))).otherwise(_media(_medium("image", get("thumbnail")))))
    return F.when(v.isNotNull(), _card(text, media))


TELEGRAM = "struct<author:struct<type:string,title:string,username:string,first_name:string,last_name:string,bot:boolean,phone:string,verified:boolean>,date:timestamp,edit_date:timestamp,views:long,forwards:long,reactions:string,text:string,media:array<string>>"


def telegram_post_card(payload: Column) -> Column:
    """A post with its sender, a channel or a user, and the references of its media."""
    return let(F.from_json(payload, TELEGRAM), lambda p: _telegram_post_card(p))


def _telegram_post_card(p: Column) -> Column:
    a = p["author"]
    blank = F.lit("")
    at = F.when(F.coalesce(a["username"], blank) != "", F.concat(F.lit(" (@"), a["username"], F.lit(")"))).otherwise(blank)
    person = F.concat(
        F.concat_ws(" ", a["first_name"], F.nullif(a["last_name"], blank)), at,
        F.when(F.coalesce(a["phone"], blank) != "", F.concat(F.lit(", Phone: "), a["phone"])).otherwise(blank), F.when(a["verified"], " (Verified)").otherwise(blank),
    )
    name = F.when(a["type"] == "Channel", F.concat(F.lit('"'), a["title"], F.lit('"'), at)).when(a["type"] == "User", person).otherwise("Unknown")
    kind = F.when((a["type"] == "User") & F.coalesce(a["bot"], F.lit(False)), "Bot").otherwise(F.coalesce(a["type"], F.lit("NoneType")))
    edited = F.when(p["edit_date"].isNotNull(), F.concat(F.lit("\nEdit date: "), F.date_format(p["edit_date"], MINUTE))).otherwise(blank)
    reacted = F.when(F.coalesce(p["reactions"], blank) != "", F.concat(F.lit("\nReactions: "), p["reactions"])).otherwise(blank)
    text = _lines(
        "**Telegram Post**", _text("Author: ", kind, " ", name), F.concat(_text("Date: ", F.date_format(p["date"], MINUTE)), edited),
        _text("Views: ", p["views"]), F.concat(_text("Forwards: ", p["forwards"]), reacted), "", F.array_join(F.coalesce(p["media"], F.array()), " "), _text(p["text"]),
    )
    return F.when(p.isNotNull(), _card(text))
