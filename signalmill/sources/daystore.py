"""Day buckets laid out by month, in order of days, beside the entities they are of, so that windows read their own months and silent entities still show."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.sources.versions import Change

DAYS, KEYS = "days", "entities"
_KEY = ("tenant", "entity")


def _dealt(buckets: DataFrame, slices: int) -> DataFrame:
    """With `bucket_month`, the first of the month; a month's rows come in `slices` tasks, so in as many files, in order of days."""
    dealt = buckets.withColumn("bucket_month", F.trunc("bucket_date", "MM")).repartition("bucket_month", F.pmod(F.xxhash64(*_KEY), F.lit(slices)))
    return dealt.sortWithinPartitions("bucket_month", "bucket_date")


def store_days(change: Change, buckets: DataFrame, slices: int = 1) -> Change:
    """Table `days` is buckets (tenant, entity, bucket_date ...) from now on, and `entities` their tenants and entities. Both show at the change's commit."""
    change.replace(DAYS, _dealt(buckets, slices), by="bucket_month")
    return change.replace(KEYS, change.read(DAYS).select(*_KEY).distinct())


def renew_months(change: Change, buckets: DataFrame, months: list[datetime.date], slices: int = 1) -> Change:
    """The rows of some months (their first days) are those of `buckets` from now on; folders of other months are not read or written.

    Entities are added and never dropped: one whose last bucket went has windows of zero.
    A bucket of a month that is not named is an error.
    """
    change.replace_scope(DAYS, _dealt(buckets, slices), months)
    new = change.read(DAYS, scope=months).select(*_KEY)
    return change.replace(KEYS, change.read(KEYS).union(new).distinct())
