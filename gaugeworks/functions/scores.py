"""Column expressions that score, bin, split and label rows. All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def churn_risk(lines: Column) -> Column:
    return 1 - F.exp(-0.002 * lines)


def change_risk(churn: Column, files: Column, paths: Column, hour: Column, fragile: tuple[str, ...]) -> Column:
    """Additive heuristic: size, spread, fragile paths and late hours; 1 at most."""
    touches = F.exists(paths, lambda p: reduce(lambda a, b: a | b, [p.startswith(x) for x in fragile]))
    parts = [
        F.when(churn > 200, 0.35).when(churn > 50, 0.15).otherwise(0.0),
        F.when(files > 8, 0.2).otherwise(0.0),
        F.when(touches, 0.3).otherwise(0.0),
        F.when((hour >= 22) | (hour <= 5), 0.15).otherwise(0.0),
    ]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def change_reasons(churn: Column, files: Column, paths: Column, hour: Column, fragile: tuple[str, ...]) -> Column:
    touches = F.exists(paths, lambda p: reduce(lambda a, b: a | b, [p.startswith(x) for x in fragile]))
    return F.concat_ws(
        "; ",
        F.when(churn > 200, "very large change").when(churn > 50, "large change"),
        F.when(files > 8, "many files"),
        F.when(touches, "fragile path"),
        F.when((hour >= 22) | (hour <= 5), "late hour"),
    )


def resource_risk(cores: Column, memory: Column) -> Column:
    one = F.lit(1.0)
    return F.least(one, 0.5 * F.least(cores / 0.02, one) + 0.5 * F.least(memory / 0.01, one))


def history_anomaly(value: Column, mean: Column, std: Column, n: Column, least: int = 5) -> Column:
    """Logistic of the distance from a history in standard deviations, one half at two; 0 on a short history."""
    z = F.abs(value - mean) / F.when(std == 0, 1.0).otherwise(std)
    return F.when(value.isNull() | n.isNull() | (n < least), 0.0).otherwise(1 / (1 + F.exp(-(z - 2))))


def bin_of(score: Column, bins: int = 10) -> Column:
    """Index of the bin [i/n, (i+1)/n) with edges as doubles i * (1/n); the last bin is closed."""
    width = 1.0 / bins
    b = F.floor(score * bins)
    b = b - F.when(score < b * F.lit(width), 1).otherwise(0) + F.when(score >= (b + 1) * F.lit(width), 1).otherwise(0)
    return F.least(b, F.lit(bins - 1)).cast("int")


#: The same as SQL text, for scores in column s.
BIN_SQL = "cast(least(floor(s*10) - case when s < floor(s*10)*0.1::double then 1 else 0 end + case when s >= (floor(s*10)+1)*0.1::double then 1 else 0 end, 9) as int)"


def half_open_split(t: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """Name of the range [start, end) that holds t, else `outside`."""
    out = F.lit("outside")
    for name, (start, end) in reversed(bounds.items()):
        out = F.when((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")), name).otherwise(out)
    return out


def closed_split(t: Column, bounds: dict[str, tuple[str, str]]) -> Column:
    """Name of the first range [start, end] in order that holds t, else null."""
    return F.coalesce(*(F.when(t.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), name) for name, (a, b) in bounds.items()))


def label_of(outcome: Column) -> Column:
    return F.when(outcome == "observed_positive", 1).when(outcome == "observed_negative", 0)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The message of the first failing check, null if none fails."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), message) for bad, message in checks))


def violations(*checks: tuple[Column, str]) -> Column:
    """All failing checks' messages, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), message) for bad, message in checks)), lambda m: m.isNotNull())


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def wilson(positives: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate, clipped to [0, 1]; null without rows."""
    p = F.try_divide(positives, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low), F.when(n > 0, high)
