"""Small expressions: whole logarithms, losses and names by time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2n(value: Column) -> Column:
    """The least n from 0 for which 2^n is not below a whole number; 0 for numbers up to 1."""
    v = F.greatest(value.cast("long"), F.lit(1).cast("long"))
    return F.when(v <= 1, 0).otherwise(F.length(F.conv((v - 1).cast("string"), 10, 2)))


def huber_loss(difference: Column, delta: float) -> Column:
    """Half the square of a difference up to ``delta``, and a line with the same slope from there on."""
    d = F.abs(difference)
    return F.when(d <= delta, d * d / 2).otherwise(delta * d - delta * delta / 2)


def shifted_sigmoid(value: Column) -> Column:
    """2 / (1 + exp(-2 x)) - 1: 0 at 0, towards 1."""
    return 2 / (1 + F.exp(-2 * value)) - 1


def stamped(name: Column, at: Column) -> Column:
    """A name with a time to the second behind it, as yyyyMMddHHmmss."""
    return F.concat_ws("-", name, F.date_format(at, "yyyyMMddHHmmss"))
