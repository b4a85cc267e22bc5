"""Checks and scaling of features before a fit."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALINGS = ("raw", "zscore")


def numeric_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns other than `keep`; warns if others are left out. Known from the schema, without a job."""
    rest = [f for f in df.schema.fields if f.name not in keep]
    found = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    if len(found) < len(rest):
        warnings.warn("Some features were not numeric and have been removed.", stacklevel=2)
    return found


def is_missing(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def missing_report(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n_missing): one aggregation over all features."""
    kinds = dict(df.dtypes)
    counted = df.agg(*[F.count_if(is_missing(c, kinds[c])).alias(c) for c in names])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("n_missing")) for c in names])).alias("r")).select("r.*")


def require_complete(df: DataFrame, names: list[str]) -> None:
    kinds = dict(df.dtypes)
    bad = reduce(lambda a, b: a | b, [is_missing(c, kinds[c]) for c in names], F.lit(False))
    if df.where(bad).limit(1).count():
        raise ValueError("Some regions have missing values and missing values are not allowed.")


def scaled(df: DataFrame, names: list[str], scaling: str = "raw", by: list[str] | None = None) -> DataFrame:
    """Columns as doubles; zscore: less their mean, divided by the sample standard deviation, in all rows or in each group.

    A constant column has no zscore and raises an error when it is computed.
    """
    if scaling not in SCALINGS:
        raise ValueError("scaling must be zscore or raw")
    cols = {c: F.col(f"`{c}`").cast("double") for c in names}
    if scaling == "raw":
        return df.withColumns(cols)
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"__{k}{i}") for i, c in enumerate(names) for f, k in ((F.avg, "m"), (F.stddev_samp, "s"))]
    stats = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    both = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row of statistics
    z = {c: F.when(F.col(f"__s{i}") > 0, (cols[c] - F.col(f"__m{i}")) / F.col(f"__s{i}")).otherwise(F.raise_error(F.lit(f"{c} is constant: no zscore")).cast("double")) for i, c in enumerate(names)}
    return both.withColumns(z).drop(*[f"__{k}{i}" for i in range(len(names)) for k in "ms"])


def feature_table(df: DataFrame, id_col: str, run_key: str | None = None, order: str | None = None, features: list[str] | None = None, scaling: str = "raw") -> DataFrame:
    """(run_key, id[, ord], x ARRAY<DOUBLE>): numeric features of a table, checked for missing values and scaled."""
    keep = tuple(c for c in (id_col, run_key, order, "geometry") if c)
    names = features or numeric_columns(df.drop("geometry"), keep)
    if not names:
        raise ValueError("no numeric feature is left")
    require_complete(df, names)
    s = scaled(df, names, scaling, [run_key] if run_key else None)
    key = F.col(run_key) if run_key else F.lit(0)
    cols = [key.cast("bigint").alias("run_key"), F.col(id_col).cast("bigint").alias("id")]
    if order:
        cols.append(F.col(order).alias("ord"))
    return s.select(*cols, F.array(*[F.col(f"`{c}`") for c in names]).alias("x"))
