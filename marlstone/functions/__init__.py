"""Column expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted(price: Column, discount: Column) -> Column:
    """The price after its discount."""
    return price * (F.lit(1) - discount)


def money(total: Column) -> Column:
    """A sum of doubles to the cent: the order of adding no longer shows."""
    return F.round(total, 2)
