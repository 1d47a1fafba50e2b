"""Column functions over durations, times and scores.  Every clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(float(default))), F.lit(float(low))), F.lit(float(high)))


def duration_seconds(text: Column) -> Column:
    """h:m:s to seconds; an empty part is 0, and all is 0 if any part is no number."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ":"), lambda p: F.when(F.trim(p) == "", 0.0).otherwise(F.trim(p).try_cast("double")))
    bad = F.exists(parts, lambda p: p.isNull())
    return F.when(bad, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + F.coalesce(p, F.lit(0.0))))


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; empty without a value."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.when(h > 99, h.cast("string")).otherwise(two(h))
    return F.when(seconds.isNull(), "").when(h > 0, F.concat_ws(":", hours, two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def epoch_to_iso(seconds: Column) -> Column:
    """ISO text of epoch seconds in UTC; empty unless positive."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("")


def epoch_guess(value: Column) -> Column:
    """Epoch milliseconds of a number that may be seconds (below 1e10) or milliseconds."""
    return F.when(value >= 10_000_000_000, value).otherwise(value * 1000)


def moment(text: Column) -> Column:
    """Epoch milliseconds of a text: a positive number of seconds or milliseconds, or a date in ISO form; null for anything else."""
    number_ = text.try_cast("double")
    dated = F.when(text.rlike(r"^\d{4}-\d\d"), F.unix_millis(text.try_cast("timestamp")))
    return F.when(number_ > 0, epoch_guess(number_).cast("long")).when(number_.isNull(), dated)


def credits(tokens_in: Column, tokens_out: Column, total: Column) -> Column:
    """100 credits an input token, 200 an output token; without either, 100 a token of the total."""
    i, o, t = (F.greatest(number(c), F.lit(0.0)) for c in (tokens_in, tokens_out, total))
    return F.round(F.when((i > 0) | (o > 0), i * 100 + o * 200).otherwise(t * 100)).cast("long")


def importance(size: Column, issues: Column) -> Column:
    """1 to 5 by length, less for issues."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.round(size / 12000).cast("int") + 2 - F.least(issues, F.lit(2)))).cast("int")


def retry_delay_ms(count: Column) -> Column:
    """5 minutes, 30 minutes, then 2 hours."""
    return F.when(count <= 0, 5 * 60_000).when(count == 1, 30 * 60_000).otherwise(2 * 3_600_000).cast("long")


def ms_to_next_hour(now_ms: Column) -> Column:
    return (3_600_000 - F.pmod(now_ms, F.lit(3_600_000))).cast("long")


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def seconds(at: Column) -> Column:
    return F.floor(micros(at) / 1_000_000).cast("long")
