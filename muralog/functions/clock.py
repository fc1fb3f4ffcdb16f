"""Time arithmetic on timestamp columns (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, as a long."""
    return F.unix_micros(ts)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since the epoch with their fraction, as a double."""
    return micros(ts) / F.lit(1e6)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds with their fraction."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def crossed_seconds(start: Column | str, end: Column | str) -> Column:
    """Number of whole-second boundaries between two instants.

    0.9 s → 1.1 s crosses one boundary although only 0.2 s have passed.
    """
    return F.unix_seconds(end) - F.unix_seconds(start)


def crossed_minutes(start: Column | str, end: Column | str) -> Column:
    """Number of whole-minute boundaries between two instants."""
    return _minute_number(end) - _minute_number(start)


def _minute_number(ts: Column | str) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(60))


def instant(value) -> Column:
    """A timestamp literal from a string, a datetime or a column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def within(ts: Column, start, end) -> Column:
    """Half-open range test `[start, end)`; reaches the file scan as two filters."""
    return (ts >= instant(start)) & (ts < instant(end))


def in_unit(ts: Column, unit: str, moment) -> Column:
    """True where `date_trunc(unit, ts) = moment`.

    Written as a range, which the scan can use to skip row groups; a truncation
    around the column could not be pushed down. A moment that is not on a unit
    boundary matches nothing, as with the equality.
    """
    start = instant(moment)
    aligned = F.date_trunc(unit, start) == start
    return within(ts, start, unit_end(unit, start)) & aligned


def unit_end(unit: str, start) -> Column:
    """The instant one unit after `start`; takes every unit that `date_trunc` takes."""
    length = "3 MONTH" if unit.lower() == "quarter" else f"1 {unit}"
    return instant(start) + F.expr(f"INTERVAL {length}")


def slot_start(ts: Column | str, width_micros: int) -> Column:
    """Start, in microseconds, of the fixed-width slot an instant lies in."""
    at = micros(ts)
    return at - F.pmod(at, F.lit(width_micros).cast("long"))
