"""Timestamp helpers: the driver tables carry TIMESTAMP_NTZ wall-clock times recorded in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_instant(ntz) -> Column:
    """TIMESTAMP_NTZ wall time read as UTC -> TIMESTAMP instant, whatever the session time zone
    (a plain cast would read the wall time in the session zone)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), _c(ntz)).cast("timestamp")


def utc_wall(ts) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ wall time in UTC (for zone-independent output)."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))
