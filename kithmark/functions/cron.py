"""Cron expressions: parsed on the driver into value lists, matched and advanced in Spark.

Five fields with lists, ranges, steps, names, ? and macros; day of month and day of week are alternatives
when both are restricted. Wall-clock candidates are turned to instants by Spark's time zone functions:
a time that a gap skips moves on, one that an overlap repeats fires first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import product
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the cron notation.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Days that a search looks ahead: the next 29 February is at most eight years away, but rarely over six.
HORIZON = 6 * 366


@dataclass(frozen=True)
class Cron:
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    any_day: bool
    any_weekday: bool


def _values(field: str, low: int, high: int, names: list[str], base: int) -> set[int]:
    def number(x: str) -> int:
        x = x.lower()
        n = names.index(x) + base if x in names else int(x)
        if not low <= n <= high:
            raise ValueError(f"{n} is outside {low}-{high}")
        return n

    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        if step and int(step) < 1:
            raise ValueError("steps start at 1")
        if span in ("*", "?"):
            first, last = low, high
        elif "-" in span:
            first, last = map(number, span.split("-", 1))
            if first > last:
                raise ValueError(f"{span} runs backwards")
        else:
            first = number(span)
            last = high if step else first
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def parse(expression: str) -> Cron:
    fields = MACROS.get(expression.strip().lower(), expression).split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    got = [_values(f, lo, hi, names, base) for f, (lo, hi), names, base in zip(fields, RANGES, ([], [], [], MONTHS, DAYS), (0, 0, 0, 1, 0), strict=True)]
    got[4] = {d % 7 for d in got[4]}
    return Cron(*(tuple(sorted(x)) for x in got), fields[2] in ("*", "?"), fields[4] in ("*", "?"))


def matches_day(day: Column, cron: Cron) -> Column:
    month = F.month(day).isin(*cron.months)
    dom, dow = F.dayofmonth(day).isin(*cron.days), (F.dayofweek(day) - 1).isin(*cron.weekdays)
    if cron.any_day or cron.any_weekday:
        return month & (dow if cron.any_day else F.lit(True)) & (dom if cron.any_weekday else F.lit(True))
    return month & (dom | dow)


def next_fire(df: DataFrame, after: str, expression: str, zone: str = "UTC", horizon: int = HORIZON, out: str = "next_fire") -> DataFrame:
    """df with the first instant (epoch seconds) strictly after column `after` (epoch seconds) at which the expression fires.

    Days are searched first, as an array filter; then the times of the first two matching days and the day itself.
    """
    cron = parse(expression)
    start = F.from_utc_timestamp(F.timestamp_seconds(F.col(after)), zone)
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(horizon)), lambda i: F.date_add(F.to_date(start), i)), lambda d: matches_day(d, cron))
    times = F.array(*(F.lit(h * 60 + m) for h in cron.hours for m in cron.minutes))
    stamp = lambda d, t: F.unix_timestamp(F.to_utc_timestamp(d.cast("timestamp") + F.make_dt_interval(mins=t), F.lit(zone)))
    when = F.flatten(F.transform(F.slice(days, 1, 3), lambda d: F.transform(times, lambda t: stamp(d, t))))
    return df.withColumn(out, F.array_min(F.filter(when, lambda x: x > F.col(after))))


def fire_times(expression: str, zone: str, start: int, n: int) -> Iterator[int]:
    """The first n instants (epoch seconds) after `start` at which the expression fires in the zone; fewer if the horizon ends.

    Wall clock times: one that a clock change repeats fires once, at its first; one that it leaves out fires as much later as the clock is moved, and the
    search goes on from there.
    """
    cron, tz = parse(expression), ZoneInfo(zone)
    at = datetime.fromtimestamp(start, tz).replace(second=0, microsecond=0, tzinfo=None)
    day, left = at.replace(hour=0, minute=0), n
    for _ in range(HORIZON):
        if left <= 0:
            return
        inside, weekday = day.day in cron.days, (day.weekday() + 1) % 7 in cron.weekdays
        either = (inside or weekday) if not (cron.any_day or cron.any_weekday) else (inside or cron.any_day) and (weekday or cron.any_weekday)
        for hour, minute in product(cron.hours, cron.minutes) if day.month in cron.months and either else ():
            wall = day.replace(hour=hour, minute=minute)
            if wall <= at or left <= 0:
                continue
            fire = int(wall.replace(tzinfo=tz).timestamp())
            at, left = datetime.fromtimestamp(fire, tz).replace(tzinfo=None), left - 1
            yield fire
        day += timedelta(days=1)


@F.udtf(returnType="fire long")
class CronFires:
    """cron_fires(expression, zone, start, n): fire_times() as rows, none for nulls. For use in a lateral join."""

    def eval(self, expression: str, zone: str, start: int, n: int):
        if expression is not None and zone is not None and start is not None:
            yield from ((at,) for at in fire_times(expression, zone, start, n))


def fires(df: DataFrame, expression: str, zone: str, start: str, n: int) -> DataFrame:
    """df with `fire`: a row for each of the first n fires of its expression, zone and start (names of columns)."""
    return df.lateralJoin(CronFires(*(F.col(c).outer() for c in (expression, zone, start)), F.lit(n)))
