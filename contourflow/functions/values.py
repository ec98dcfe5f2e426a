"""Value semantics: inf is a value, NaN means not applicable, NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < INF), x)


def ratio(num: Column, den: Column) -> Column:
    """num / den; inf for a denominator of zero, as the arrays of the domain have it."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0).cast("double"))).when(den == 0, F.lit(INF))


def at_most(value: Column, limit: Column, slack: float = 1e-9) -> Column:
    """value <= limit with a relative slack (CK-1)."""
    return value <= limit + slack * F.greatest(F.abs(limit), F.lit(1.0))


def at_least(value: Column, limit: Column, slack: float = 1e-9) -> Column:
    return value >= limit - slack * F.greatest(F.abs(limit), F.lit(1.0))


def significant(x: Column, digits: int = 9) -> Column:
    """x rounded to so many significant digits; zero, inf and NaN stay (SET-1)."""
    size = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))))
    return F.when(finite(x).isNull() | (x == 0), x).otherwise(F.rint(x * size) / size)


def parse_cell(text: Column) -> Column:
    """A typed text cell as a struct: kind (null, bool, int, double, text) and the double it stands for (SRC-13)."""
    t = F.trim(text)
    kind = (
        F.when(t.isNull() | (t == ""), "null")
        .when(t.isin("True", "False"), "bool")
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(t.isin("inf", "-inf", "nan") | t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "double")
        .otherwise("text")
    )
    number = F.when(t.isin("True"), F.lit(1.0)).when(t == "False", F.lit(0.0)).when(kind.isin("int", "double"), t.try_cast("double"))
    return F.struct(kind.alias("kind"), number.alias("number"))


def render_cell(x: Column, kind: str) -> Column:
    """A value as a text cell: NULL is empty, inf and nan are words, arrays are joined with x (SNK-1)."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(x.cast("array<string>"), "x"), F.lit(""))
    if kind in ("double", "float"):
        word = F.when(F.isnan(x), "nan").when(x == INF, "inf").when(x == -INF, "-inf")
        return F.coalesce(word, x.cast("string"), F.lit(""))
    if kind == "boolean":
        return F.coalesce(F.when(x, "True").when(~x, "False"), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))
