"""Column functions that several operators use."""

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Seconds as a double, exact to microseconds; works for timestamps with and without time zone."""
    of = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (of(later) - of(earlier)) / F.lit(1e6)


def parse_time(text: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or ``yyyy/MM/dd HH:mm:ss.SSS``; null for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS"))).cast("timestamp_ntz")


def weekday(time: str | Column) -> Column:
    """Monday is 0."""
    return F.weekday(F.col(time) if isinstance(time, str) else time)


def calendar_batch(time: str, unit: str) -> Column:
    """Key of a calendar batch: ISO day ``YYYY/WW/D``, ISO week ``YYYY/WW``, month ``YYYY/MM``."""
    week = F.concat_ws("/", F.expr(f"extract(YEAROFWEEK FROM {time})").cast("string"), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))
    if unit == "day":
        return F.concat_ws("/", week, (F.weekday(time) + 1).cast("string"))
    return week if unit == "week" else F.date_format(time, "yyyy/MM")


def equal_width_bin(x: str, low: Column, high: Column, bins: int) -> Column:
    """Right-closed bins of equal width from ``low`` to ``high``, numbered from 0; the first also holds ``low``; null outside."""
    width = (high - low) / bins
    bin_ = F.greatest(F.ceil((F.col(x) - low) / width) - 1, F.lit(0)).cast("long")
    return F.when((F.col(x) < low) | (F.col(x) > high), None).when(high == low, F.lit(0).cast("long")).otherwise(F.least(bin_, F.lit(bins - 1).cast("long")))


def draw(most: int, *parts: str | int | Column) -> Column:
    """A number from 0 to ``most`` - 1 by the MD5 of parts joined by ``|`` (texts and numbers as they are, nulls as nothing).

    The first 32 bits count, so other engines can draw the same.
    """
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(most))


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided p-value of the two-sample statistic by the Kolmogorov series with Stephens' correction."""
    e = F.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, j: a + 2 * F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def rounded(columns: Iterable[str], digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def log_space(low: float, high: float, n: int) -> list[float]:
    return [float(x) for x in np.logspace(low, high, n)]
