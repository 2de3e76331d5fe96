"""Bias-corrected sample moments as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness: null below 3 values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(adjusted))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when(n > 3, F.when(F.var_pop(c) == 0, F.lit(0.0)).otherwise(adjusted))


def moments(c: Column) -> list[Column]:
    """Mean, sample variance, skewness and kurtosis with fixed names."""
    return [
        F.avg(c).alias("mean"),
        F.var_samp(c).alias("variance"),
        sample_skewness(c).alias("skew"),
        sample_kurtosis(c).alias("kurtosis"),
    ]
