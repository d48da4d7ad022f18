"""Reading panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_panel(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read a panel from headered CSV, parquet, ORC or a catalog table.

    CSV without a schema gives string columns, with no inference pass over the data. With a
    schema the header is checked against it instead of being trusted by position.
    """
    if fmt == "table":
        return spark.read.table(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, enforceSchema=schema is None)
    return reader.format(fmt).load(path)
