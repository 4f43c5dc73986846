"""Rounding without decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_places(value: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic; Spark's round() goes through decimals and costs far more per row."""
    scale = float(10**digits)
    # floor() gives whole 64-bit numbers: NaN, infinity and numbers without such places stay as they are.
    return F.when(F.abs(value) < F.lit(2.0**52 / scale), F.floor(value * scale + 0.5) / F.lit(scale)).otherwise(value)
