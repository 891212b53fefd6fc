"""Times: epoch milliseconds, text and windows, in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = "yyyy-MM-dd HH:mm:ss"


def from_millis(ms) -> Column:
    """A timestamp at whole seconds, as integer division of milliseconds gives."""
    return F.timestamp_seconds(F.expr(f"{ms} div 1000") if isinstance(ms, str) else F.floor(ms / 1000))


def exact_millis(ms) -> Column:
    return F.timestamp_millis(ms)


def to_millis(text) -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd HH:mm:ss`` text; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(SECONDS)))


def to_millis_at(text, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of such text as the clock of a fixed offset shows it, whatever the session's zone."""
    return F.unix_millis(F.try_to_timestamp(F.concat(F.col(text) if isinstance(text, str) else text, F.lit(offset)), F.lit(SECONDS + "XXX")))


def processing_millis() -> Column:
    """Epoch milliseconds of the time of processing, in whole seconds."""
    return F.unix_timestamp() * 1000


def shown(ts) -> Column:
    return F.date_format(ts, SECONDS)


def date_number(ts) -> Column:
    """yyyyMMdd as an integer."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def create_parts(text: str = "create_time") -> dict[str, Column]:
    """create_date, create_hour and create_ts of a creation time."""
    c = F.col(text)
    return {"create_date": F.substring_index(c, " ", 1), "create_hour": F.substring_index(F.substring_index(c, " ", -1), ":", 1), "create_ts": to_millis(c)}


def age(birthday, as_of) -> Column:
    """Whole years of 365 days from birthday to as_of; 0 if the birthday can't be read."""
    born = F.try_to_timestamp(birthday, F.lit("yyyy-MM-dd")) if isinstance(birthday, str) else birthday.cast("timestamp")
    gap = F.unix_millis(F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of.cast("timestamp")) - F.unix_millis(born)
    return F.coalesce(F.floor(gap / F.lit(365 * 86_400_000)).cast("int"), F.lit(0))


def window_bounds(window: str = "window") -> list[Column]:
    return [shown(F.col(f"{window}.start")).alias("stt"), shown(F.col(f"{window}.end")).alias("edt")]
