"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cdc_timestamp(name: str) -> Column:
    """A change stream's time: text of digits is epoch milliseconds, other text is parsed, what fails is null."""
    text = F.trim(F.col(name).cast("string"))
    millis = F.timestamp_millis(text.try_cast("long"))
    parsed = F.when(text.rlike(r"^[+-]?[0-9]+$"), millis).otherwise(F.try_to_timestamp(text))
    return parsed.alias(name)


def staged_time(df: DataFrame, name: str) -> Column:
    """A time column that may still be a change stream's text."""
    return cdc_timestamp(name) if dict(df.dtypes)[name] == "string" else F.col(name)


def day_key(name: str) -> Column:
    """The day as a number yyyymmdd."""
    day = F.col(name).cast("date")
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("date_key")


def is_cancelled(name: str) -> Column:
    """Both spellings, in any case; a null status is not cancelled."""
    return F.upper(F.coalesce(F.col(name), F.lit(""))).isin("CANCELLED", "CANCELED")


def match_status(paid: str, due: str, *, unknown_is_zero: bool = True) -> Column:
    """Whether payments cover an order to the cent; an order without a total counts as one of 0, or as a mismatch."""
    gap = F.abs(F.col(paid) - (F.coalesce(F.col(due), F.lit(0)) if unknown_is_zero else F.col(due)))
    return F.when(F.col(paid).isNull(), "NO_PAYMENT").when(gap <= 0.01, "MATCHED").otherwise("MISMATCH")


def or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def with_missing(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with the columns it lacks as typed nulls."""
    return df.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in df.columns})
