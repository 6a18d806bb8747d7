"""Small column expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(value: Column, digits: int = 12) -> Column:
    """A double as a decimal of two places."""
    return value.cast(f"decimal({digits},2)")


def disc_price(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """The price after the discount, exact to four places."""
    return exact(F.col(price)) * (1 - exact(F.col(discount), 6))


def money(values: Column) -> Column:
    """The sum of amounts to two places, as a double; summed exactly, so in any order."""
    return money_of(F.sum(values))


def money_of(amount: Column) -> Column:
    """An exact amount to two places, as a double."""
    return F.round(amount, 2).cast("double")


def naive_hour(ts: str) -> Column:
    """The hour of a zone-free timestamp, still zone-free."""
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
