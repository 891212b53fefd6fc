"""Ratios of the visitor dashboard, in decimals rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(top, bottom, digits: int) -> Column:
    top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
    exact = top.cast("decimal(24,0)") / F.when(bottom != 0, bottom).cast("decimal(20,0)")
    return F.round(F.coalesce(exact, F.lit(0)), digits)


def bounce_rate(jumps: str = "uj_ct", sessions: str = "sv_ct") -> Column:
    """Percent with two digits; 0 without sessions."""
    return _share(F.col(jumps) * 100, sessions, 2).cast("decimal(20,2)")


def seconds_per_session(millis: str = "dur_sum", sessions: str = "sv_ct") -> Column:
    """Rounded to whole milliseconds first, then to tenths of a second."""
    return F.round(_share(millis, sessions, 0) / 1000, 1).cast("decimal(20,1)")


def pages_per_session(pages: str = "pv_ct", sessions: str = "sv_ct") -> Column:
    return _share(pages, sessions, 2).cast("decimal(20,2)")
