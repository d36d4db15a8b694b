"""Dates relative to an explicit ``as_of`` instant; nothing reads the wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def today(as_of: dt.datetime) -> Column:
    """The day of ``as_of``, as stored into a DATE column."""
    return F.lit(as_of.date())


def not_ended(valid_to: Column, as_of: dt.datetime) -> Column:
    """An open end, or an end (a date, so midnight) that is not before ``as_of``.

    Written as a comparison with a DATE literal so that it is pushed to the
    scan: a holding ending on the day of ``as_of`` has ended, except at midnight.
    """
    day = as_of.date()
    first = day if as_of.time() == dt.time.min else day + dt.timedelta(days=1)
    return valid_to.isNull() | (valid_to >= F.lit(first))


def valid_on(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """Interval test with both ends included and either end open."""
    return (valid_from.isNull() | (valid_from <= day)) & (valid_to.isNull() | (valid_to >= day))
