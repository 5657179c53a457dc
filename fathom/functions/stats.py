"""Statistics expressions shared by the profile, cleaning and transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.types import is_floating


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat float NaN as missing, like NULL (Spark counts NaN as a value and lets it win max)."""
    exprs = []
    changed = False
    for field in df.schema.fields:
        if is_floating(field.dataType):
            c = F.col(f"`{field.name}`")
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(field.dataType)).otherwise(c).alias(field.name))
            changed = True
        else:
            exprs.append(F.col(f"`{field.name}`"))
    return df.select(*exprs) if changed else df


def sample_skewness(population_skew: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1 from Spark's population skewness g1.

    G1 = g1 * sqrt(n (n - 1)) / (n - 2); undefined (NULL) below three values.
    """
    n = n.cast("double")
    return F.when(n > 2, population_skew * F.sqrt(n * (n - 1)) / (n - 2))
