"""Honest metrics: a value, or null with a reason. Rounding and window parsing."""

from __future__ import annotations

import re
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason codes.
REACH_UNAVAILABLE = "reach_unavailable"
FOLLOWERS_UNAVAILABLE = "followers_unavailable"
IMPRESSIONS_UNAVAILABLE = "impressions_unavailable"
CLICKS_UNAVAILABLE = "clicks_unavailable"
VIDEO_VIEWS_UNAVAILABLE = "video_views_unavailable"
NON_POSITIVE_DENOMINATOR = "non_positive_denominator"
INSUFFICIENT_SNAPSHOTS = "insufficient_snapshots"
INSUFFICIENT_DATA = "insufficient_data"
NO_ENGAGEMENT_SIGNAL = "no_engagement_signal"
NO_HASHTAGS = "no_hashtags"

_HOURS = {"h": 1, "d": 24, "w": 168}


def round_dp(x: Column | str, dp: int = 2) -> Column:
    """Round a double, a column or the name of one, to ``dp`` places, correctly: by its exact
    binary value, ties to even.

    ``round`` and ``bround`` go through the shortest decimal text of the double, so 2.675
    becomes 2.68 although the stored number is below the tie. Scaling can only land on a false
    tie, so only there the number formatter, which looks at the exact value, decides. Prefer a
    name: the expression mentions its input several times.
    """
    scale = float(10**dp)
    if isinstance(x, str):
        x = f"cast(`{x}` as double)"
        # half of the last place itself, which the formatter takes for an exact tie
        return F.expr(f"""case when abs({x} * {scale}D - rint({x} * {scale}D)) = 0.5D
            then case when abs({x}) < {1 / scale}D then signum({x}) * {round(0.5 / scale, dp)}D
                 else cast(format_number({x}, '0.{'0' * dp}') as double) end
            else rint({x} * {scale}D) / {scale}D end + 0.0D""")
    x = x.cast("double")
    nearest = F.rint(x * scale)
    formatted = F.call_function("format_number", x, F.lit("0." + "0" * dp)).cast("double")
    exact = F.when(F.abs(x) < 1 / scale, F.signum(x) * round(0.5 / scale, dp)).otherwise(formatted)
    rounded = F.when(F.abs(x * scale - nearest) == 0.5, exact).otherwise(nearest / scale)
    # + 0.0 turns a negative zero into zero
    return rounded + F.lit(0.0)


class Metric(NamedTuple):
    """The unrounded value of a metric and the reason that is set where the value is null."""

    raw: Column
    reason: Column
    dp: int = 2

    @property
    def value(self) -> Column:
        return round_dp(self.raw, self.dp)

    def columns(self, name: str) -> list[Column]:
        return [self.value.alias(name), self.reason.alias(f"{name}_reason")]

    def struct(self) -> Column:
        return F.struct(self.value.alias("value"), self.reason.alias("reason"))


def rate(num: Column, den: Column, missing: str, gates: tuple = (), times: float = 100.0,
         dp: int = 2) -> Metric:
    """``num / den * times``; null where a gate is null (its own reason first), the denominator
    is missing (``missing``) or is not positive. A zero numerator is a true zero."""
    reason = F.lit(None).cast("string")
    usable = den > 0
    branches = [(col.isNull(), why) for col, why in gates]
    branches += [(den.isNull(), missing), (den <= 0, NON_POSITIVE_DENOMINATOR)]
    chain = F
    for condition, why in branches:
        chain = chain.when(condition, F.lit(why))
    reason = chain.otherwise(reason)
    for col, _ in gates:
        usable = usable & col.isNotNull()
    return Metric(F.when(usable, num / den * times), reason, dp)


def select_metrics(df, keep: list, metrics: dict[str, Metric], reasons: bool = True):
    """Evaluate metrics in two projections: ratios first, rounding second, so that each ratio is
    computed once although the rounding expression mentions it often."""
    raw = df.select("*", *[m.raw.alias(f"_raw_{n}") for n, m in metrics.items()],
                    *([m.reason.alias(f"{n}_reason") for n, m in metrics.items()] if reasons else []))
    out = list(keep)
    for name, m in metrics.items():
        out.append(round_dp(f"_raw_{name}", m.dp).alias(name))
        if reasons:
            out.append(F.col(f"{name}_reason"))
    return raw.select(*out)


def mean_of(total: Column, n: Column, dp: int = 2) -> Metric:
    """Mean from a sum and a count; no rows is ``insufficient_data``."""
    return Metric(F.when(n > 0, total / n), F.when(n > 0, F.lit(None)).otherwise(INSUFFICIENT_DATA), dp)


def delta_pct(current: Column, previous: Column) -> Metric:
    """Change against the prior period in percent of its absolute value."""
    missing = current.isNull() | previous.isNull()
    return Metric(
        F.when(~missing & (previous != 0), (current - previous) / F.abs(previous) * 100.0),
        F.when(missing, INSUFFICIENT_DATA).when(previous == 0, NON_POSITIVE_DENOMINATOR),
    )


def zscore(current: Column, mean: Column, std: Column, n: Column) -> Metric:
    """Standard score; needs two baseline points and a spread."""
    short = current.isNull() | n.isNull() | (n < 2)
    return Metric(
        F.when(~short & (std != 0), (current - mean) / std),
        F.when(short, INSUFFICIENT_DATA).when(std == 0, NON_POSITIVE_DENOMINATOR),
    )


def cents(x: Column) -> Column:
    """A value already rounded to 2 places as a whole number of hundredths.

    Sums of these are exact and do not depend on the order partitions arrive in.
    """
    return F.rint(x * 100.0).cast("bigint")


def parse_window(window: str) -> timedelta:
    """``30d``, ``48h`` or ``12w`` as a duration."""
    match = re.fullmatch(r"\s*(\d+)\s*([hdwHDW])\s*", window or "")
    if match is None:
        raise ValueError(f"invalid window {window!r}: use forms like '30d', '48h', '12w'")
    return timedelta(hours=int(match.group(1)) * _HOURS[match.group(2).lower()])
