"""Table export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cells(table: DataFrame) -> DataFrame:
    """Every column as a CSV cell: ISO dates, JSON for nested values, empty for NULL; no binaries."""

    def cell(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif isinstance(field.dataType, T.TimestampNTZType):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        else:
            value = value.cast("string")
        return F.coalesce(value, F.lit("")).alias(field.name)

    return table.select(*[cell(f) for f in table.schema if not isinstance(f.dataType, T.BinaryType)])


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One gzipped CSV folder per table, written in parallel by the executors."""
    for name, table in tables.items():
        csv_cells(table).write.mode("overwrite").option("header", True).option("compression", "gzip").option(
            "escape", '"'
        ).csv(f"{folder}/{name}")
