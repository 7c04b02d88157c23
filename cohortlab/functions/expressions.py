"""Scalar column expressions: years, text, clipping and interval estimates."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortlab.config import YearBounds

NO_YEAR = -1


def clamp_year(year: Column, bounds: YearBounds) -> Column:
    """Years outside the bounds become ``first - 1`` or ``last + 1``; NULL stays NULL."""
    return F.when(
        year.isNotNull(),
        F.greatest(F.lit(bounds.first - 1), F.least(F.lit(bounds.last + 1), year)),
    )


def shorten_text(text: Column, width: int, mark: str = "...") -> Column:
    cut = F.concat(F.substring(text, 1, width - len(mark)), F.lit(mark))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``least`` and ``greatest`` alone would replace it)."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNotNull(), bounded)


def neg_log10(value: Column) -> Column:
    """NULL at zero; the addition keeps ``-0.0`` out."""
    return F.when(value > 0, -F.log10(value) + F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that is NULL on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def hash_unit(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the row content, so retried tasks agree."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def risk_ratio(hits: Column, n: Column, control_hits: Column, control_n: Column,
               confidence: float) -> dict[str, Column]:
    """Relative risk with the Katz log interval.

    No exposed hits: ratio 0 and no upper limit. No control hits: infinite ratio and no lower
    limit. Neither: NULL.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    estimate = ratio(hits, n) / ratio(control_hits, control_n)
    spread = F.lit(z) * F.sqrt(
        1 / hits.cast("double") - 1 / n.cast("double")
        + 1 / control_hits.cast("double") - 1 / control_n.cast("double")
    )
    both = (hits > 0) & (control_hits > 0)
    none_exposed = (hits == 0) & (control_hits > 0)
    none_control = (hits > 0) & (control_hits == 0)
    infinite = F.lit(float("inf"))
    return {
        "relative_risk": F.when(both, estimate).when(none_exposed, 0.0).when(none_control, infinite),
        "relative_risk_low": F.when(both, F.exp(F.ln(estimate) - spread)).when(none_exposed, 0.0),
        "relative_risk_high": F.when(both, F.exp(F.ln(estimate) + spread)).when(
            none_control, infinite
        ),
    }


def ln_factorial(n: Column) -> Column:
    """ln(n!): a sum of logs up to 20, Stirling's series beyond (error below 1e-14)."""
    x = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(20), n.cast("int")))),
        F.lit(0.0),
        lambda total, i: total + F.ln(i.cast("double")),
    )
    series = (
        x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    return F.when(n <= 20, small).otherwise(series)


@F.pandas_udf(DoubleType())
def normal_upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z); Spark has no error function, so this runs on already reduced rows."""
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)))
