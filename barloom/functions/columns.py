"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MARKET_ZONE = "Asia/Taipei"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and +-Inf become NULL (Spark sorts NaN above every number)."""
    c = col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def change(now: str | Column, before: str | Column) -> Column:
    """now / before - 1, NULL when undefined or infinite."""
    return finite(ratio(now, before) - 1.0)


def count_true(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")


def local_date(ts: str | Column, zone: str = MARKET_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def local_instant(date: str | Column, hhmm: str, zone: str = MARKET_ZONE) -> Column:
    """UTC instant of a wall-clock time on a market-local date."""
    text = F.concat(col(date).cast("string"), F.lit(f" {hhmm}:00"))
    return F.to_utc_timestamp(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"), zone)


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    micros = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return micros.cast("double") / F.lit(3_600_000_000.0)


def blank_to_null(c: str | Column) -> Column:
    text = F.trim(col(c))
    return F.when(text != "", text)


def present(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Report form: rounded doubles, ISO text for dates, text for times."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), per_column.get(field.name, digits)) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(field.name))
    return df.select(out)
