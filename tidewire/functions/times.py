"""Days, weeks and relative times; instants are ISO texts read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EAST = 8  # hours ahead of UTC of the editorial day


def instant(c: Column) -> Column:
    return F.try_to_timestamp(c)


def editorial_day(c: Column) -> Column:
    """The date eight hours ahead of UTC; null if the time can't be read."""
    return F.date_format(instant(c) + F.expr(f"interval {EAST} hours"), "yyyy-MM-dd")


def editorial_week(c: Column) -> Column:
    """The Monday of the editorial day."""
    return F.date_format(F.date_trunc("week", instant(c) + F.expr(f"interval {EAST} hours")), "yyyy-MM-dd")


def age_days(c: Column, now: Column) -> Column:
    """Whole days between two instants, 0 at least; null if one can't be read."""
    days = F.floor((instant(now).cast("long") - instant(c).cast("long")) / 86400)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def editorial(c: Column) -> Column:
    return instant(c) + F.expr(f"interval {EAST} hours")


def clock(c: Column) -> Column:
    """The part of the editorial day and its time of day; empty if the time can't be read."""
    h = F.hour(editorial(c))
    part = F.when(h < 6, "凌晨").when(h < 12, "上午").when(h < 18, "下午").otherwise("晚上")
    return F.coalesce(F.concat_ws(" ", F.when(h.isNotNull(), part), F.date_format(editorial(c), "HH:mm")), F.lit(""))


def relative(c: Column, now: Column) -> Column:
    """Just now, minutes ago, hours ago on the same editorial day, yesterday, or month, day and time; empty if the time can't be read."""
    seconds = instant(now).cast("long") - instant(c).cast("long")
    same = editorial_day(now) == editorial_day(c)
    return (
        F.when(instant(c).isNull(), "")
        .when(seconds < 60, "刚刚")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" 分钟前")))
        .when((seconds < 86400) & same, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" 小时前")))
        .when(F.date_add(F.to_date(editorial_day(c)), 1) == F.to_date(editorial_day(now)), "昨天")
        .otherwise(F.date_format(editorial(c), "M/d HH:mm"))
    )


def window(since: Column, now: Column) -> Column:
    """Today with its date, or the editorial dates of both ends; empty if the beginning can't be read."""
    first, last = editorial_day(since), editorial_day(now)
    return F.when(first.isNull(), "").when(first == last, F.concat(F.lit("今天（"), first, F.lit("）"))).otherwise(F.concat_ws(" ~ ", first, last))


def is_young(created: Column, now: Column, days: int = 60) -> Column:
    """Whether something was created in the last sixty days."""
    return F.coalesce(age_days(created, now) <= days, F.lit(False))


def is_new(first_seen: Column, now: Column, hours: int = 24) -> Column:
    return F.coalesce(instant(now).cast("long") - instant(first_seen).cast("long") < hours * 3600, F.lit(False))
