"""Numbers as text: thousands, mean and deviation, medians, ranges, percent, the true minus sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"


def negative(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(MINUS))


def thousands(x: Column) -> Column:
    return negative(F.format_number(x, 0))


def decimals(x: Column, digits: int) -> Column:
    """So many decimals; halves go to the even digit."""
    return negative(F.format_string(f"%.{digits}f", F.bround(x.cast("double"), digits)))


def mean_sd(mean: Column, sd: Column, digits: int = 2) -> Column:
    """mean plus-minus deviation; the mean alone where there is no deviation, a dash where there is no mean."""
    return F.when(mean.isNull(), F.lit("–")).when(sd.isNull(), decimals(mean, digits)).otherwise(F.concat(decimals(mean, digits), F.lit(" ± "), decimals(sd, digits)))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(decimals(100 * share, digits), F.lit("%"))


def span(low: Column, high: Column, digits: int = 0) -> Column:
    return F.when(low == high, decimals(low, digits)).otherwise(F.concat(decimals(low, digits), F.lit("–"), decimals(high, digits)))


def join_and(items: list[str]) -> str:
    return items[0] if len(items) == 1 else f"{', '.join(items[:-1])} and {items[-1]}" if items else ""
