"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ";", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A delimited text file. The schema is given, so that no pass over the data is spent on guessing it, and bad values are errors."""
    return spark.read.schema(schema).options(sep=sep, header=header, encoding=encoding, mode="FAILFAST", nanValue="NaN").csv(path)


def write(df: DataFrame, path: str, kind: str = "parquet", *, by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """A table as parquet, csv, json or orc files, parted by columns if given."""
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*by) if by else w).save(path)


def with_attributes(shapes: DataFrame, attributes: DataFrame, shape_key: str, attribute_key: str, *, required: str | None = None) -> DataFrame:
    """Shapes with the attributes of their key, compared without blanks around it; shapes without any stay, unless `required` names an attribute that must be there.

    Attributes have one row a key; their key column is left out.
    """
    keyed = attributes.withColumn("__key", F.trim(F.col(f"`{attribute_key}`"))).drop(attribute_key)
    both = shapes.withColumn("__key", F.trim(F.col(f"`{shape_key}`"))).join(keyed, "__key", "left").drop("__key")
    return both.where(F.col(f"`{required}`").isNotNull()) if required else both
