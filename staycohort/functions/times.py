"""Time arithmetic on zone-free timestamps, independent of the session zone.

Arguments are column names or other SQL text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: str, end: str) -> Column:
    """Midnights crossed from start to end."""
    return F.expr(f"CAST(datediff({end}, {start}) AS BIGINT)")


def hours_between(start: str, stop: str) -> Column:
    """Whole hours from start to stop, cut toward zero.

    Subtracting the two timestamps gives an exact interval. A difference function that
    converts to instants first would be an hour off where clocks change.
    """
    span = f"({stop} - {start})"
    return F.expr(
        f"CAST(extract(DAY FROM {span}) AS BIGINT) * 24 + CAST(extract(HOUR FROM {span}) AS BIGINT)"
    )


def bin_start(time: str, hours: int, shift: str = "0") -> Column:
    """First hour, counted from 1970, of the `hours`-wide bin that holds the time."""
    hour = f"(CAST(datediff({time}, DATE'1970-01-01') AS BIGINT) * 24 + hour({time}))"
    return F.expr(f"{hour} - pmod({hour}, {hours}) + {shift}")
