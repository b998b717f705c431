"""Time expressions that do not depend on the session time zone.

Event times are epoch milliseconds. Conversions go through TIMESTAMP_NTZ so
that hour and weekday are UTC whatever ``spark.sql.session.timeZone`` says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_ms(col: str) -> Column:
    """Epoch milliseconds (floored) of a TIMESTAMP_NTZ column."""
    return F.expr(f"timestampdiff(MILLISECOND, {_EPOCH_NTZ}, `{col}`)").cast("bigint")


def ms_to_ntz(col: str) -> Column:
    return F.expr(f"timestampadd(MILLISECOND, `{col}`, {_EPOCH_NTZ})")


def hour_of_ms(col: str) -> Column:
    return F.hour(ms_to_ntz(col)).cast("int")


def weekday_of_ms(col: str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ms_to_ntz(col)).cast("int")
