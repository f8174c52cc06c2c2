"""Column functions on counts, dates, languages and engagement."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of engagement counts by platform.
WEIGHTS = {
    "instagram": {"likes": 1.0, "comments": 3.0, "shares": 5.0, "views": 0.1},
    "tiktok": {"likes": 1.0, "comments": 5.0, "shares": 3.0, "views": 0.05},
    "reddit": {"score": 1.0, "comments": 2.0},
    "x": {"likes": 1.0, "retweets": 2.0, "replies": 2.0},
    "youtube": {"likes": 1.0, "comments": 2.0, "views": 0.001},
    "xiaohongshu": {"likes": 1.0, "comments": 3.0, "shares": 2.0, "views": 0.1, "saves": 4.0},
}
#: ISO 639-3 to 639-1.
ISO3 = {"eng": "en", "deu": "de", "fra": "fr", "ita": "it", "spa": "es", "por": "pt", "nld": "nl", "zho": "zh-CN", "jpn": "ja", "kor": "ko", "rus": "ru", "arb": "ar"}


def round_half_up(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5)


def author_tier(followers: Column) -> Column:
    f = F.coalesce(followers, F.lit(0))
    return F.when(f < 1_000, "nano").when(f < 10_000, "micro").when(f < 100_000, "mid").when(f < 1_000_000, "macro").otherwise("mega")


def engagement(platform: Column, counts: dict[str, Column], weights: dict | None = None) -> Column:
    """struct(score, composite): counts by the platform's weights; unknown platforms use Instagram's."""
    table = weights or WEIGHTS
    total = F.lit(0.0)
    for kind in ("likes", "comments", "shares", "views", "saves"):
        if kind not in counts:
            continue
        w = lambda p: table[p].get(kind, table[p].get("score", 0.0) if kind == "likes" else 0.0)  # noqa: E731, B023
        weight = F.lit(w("instagram"))
        for p in table:
            weight = F.when(platform == p, F.lit(w(p))).otherwise(weight)
        total = total + F.coalesce(counts[kind], F.lit(0)) * weight
    return F.struct(round_half_up(total).cast("long").alias("score"), total.alias("composite"))


def language_gate(text: Column, language: Column) -> Column:
    """struct(language, confidence): short texts have none; confidence grows with length."""
    n = F.length(text)
    mapped = language
    for three, two in ISO3.items():
        mapped = F.when(language == three, two).otherwise(mapped)
    known = text.isNotNull() & (n >= 20) & language.isNotNull() & (language != "und")
    return F.struct(
        F.when(known, mapped).alias("language"), F.when(known, F.least(F.lit(0.5) + n / 500, F.lit(0.99))).otherwise(F.lit(0.0)).alias("confidence")
    )


def clamp_interest(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(x))).cast("int")


def to_day(text: Column) -> Column:
    """Date of an ISO string or of one like "Apr 12, 2025"; null otherwise."""
    iso = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.expr("null")
    return F.coalesce(iso, F.to_date(F.try_to_timestamp(text, F.lit("MMM d, yyyy"))))


def bucket_cols(posted: Column, captured: Column, geography: Column, composite: Column) -> list[Column]:
    return [
        F.to_date(F.coalesce(posted, captured)).alias("bucket_date"),
        F.coalesce(geography, F.lit("Global")).alias("geography"),
        F.coalesce(composite, F.lit(0.0)).alias("composite"),
    ]


def pct1(x: Column) -> Column:
    """Fraction as percent with one decimal."""
    return round_half_up(x * 1000) / 10


def evidence_cutoff(as_of: datetime.date, days: int) -> datetime.date:
    return as_of - datetime.timedelta(days=days)


def snap_window(days: Column) -> Column:
    return F.when(days.isin(7, 30, 90), days).otherwise(30)


def seeded_key(entity: Column, replicate: Column, place: Column) -> Column:
    """Sort key that shuffles places of a replicate the same way on every run."""
    return F.md5(F.concat_ws("|", entity.cast("string"), replicate.cast("string"), place.cast("string")).cast("binary"))


def growth_rate(before: Column, now: Column) -> Column:
    """Relative change; from zero it is 1 if anything came, else 0."""
    return F.when(before == 0, F.when(now > 0, 1.0).otherwise(0.0)).otherwise((now - before) / before)
