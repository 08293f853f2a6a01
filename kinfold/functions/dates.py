"""Timestamps without a zone, so no session setting can shift a result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: str | datetime | Column) -> Column:
    if isinstance(moment, datetime):
        moment = moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(moment, str):
        moment = F.lit(moment)
    return moment.cast("timestamp_ntz")


def parsed(text: Column) -> Column:
    """Unreadable dates become null, also under ANSI mode."""
    return text.try_cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """floor((later - earlier) / 24 h); a difference of -6 hours is -1 day."""
    gap = later - earlier
    days = F.date_part(F.lit("DAY"), gap)
    return (days - (gap < F.make_dt_interval(days)).cast("int")).cast("long")
