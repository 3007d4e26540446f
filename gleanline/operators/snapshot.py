"""A stored table in files by bucket of its key: an update reads and writes the buckets it touches, and leaves a change log.

The current rows lie under `rows/bucket=n`, the log under `log/version=n`. A new version of the touched buckets is
worked out and written down before it replaces them, so that a lost executor repeats a step and never reads half of
one. Replaying the log from the first version gives the current rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shared_folder

BUCKETS = 256


class Snapshot:
    """Rows with unique, non-null `keys`, kept between updates."""

    def __init__(self, first: DataFrame, keys: list[str], buckets: int = BUCKETS, path: str | None = None):
        self.spark: SparkSession = first.sparkSession
        self.keys, self.buckets, self.path = keys, buckets, path or shared_folder(self.spark)
        self.schema, self.version = first.schema, 0
        self._write(self._placed(first))
        self._log(self.read().select(F.lit("insert").alias("change"), "*"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        """Replace the buckets that occur in `rows`, each by one task."""
        out = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(f"{self.path}/rows")

    def _log(self, changes: DataFrame) -> None:
        changes.write.mode("append").parquet(f"{self.path}/log/version={self.version}")

    def _read(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._read().drop("bucket")

    def update(self, news: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Change the table and return the log of this version: change ('insert' or 'update') and the new row.

        `news` has the key columns under their names; `combine(old, news)` gives the rows that follow from the old rows
        of the touched buckets, none of which it drops. The buckets of `news` (BUCKETS numbers at most) are collected
        and become a partition filter.
        """
        news = cut_lineage(self._placed(news))
        touched = [r.bucket for r in news.select("bucket").distinct().collect()]
        columns = self.schema.fieldNames()
        old = self._read().where(F.col("bucket").isin(touched))
        after = combine(old.drop("bucket"), news.drop("bucket")).select(columns)
        after = cut_lineage(self._placed(self.spark.createDataFrame([], self.schema).unionByName(after)))
        # A row that comes out as it was is no change, and its bucket is written only for the sake of others.
        was = old.select(*self.keys, F.struct(*columns).alias("_was"))
        both = after.join(was, self.keys, "left")
        new = F.struct(*columns)
        changed = both.where(F.col("_was").isNull() | ~new.eqNullSafe(F.col("_was"))).select(
            F.when(F.col("_was").isNull(), "insert").otherwise("update").alias("change"), *columns, "bucket"
        )
        self.version += 1
        changed = cut_lineage(changed)
        self._log(changed.drop("bucket"))
        written = [r.bucket for r in changed.select("bucket").distinct().collect()]
        if written:
            self._write(after.where(F.col("bucket").isin(written)))
        return self.log(self.version).drop("version")

    def log(self, version: int | None = None) -> DataFrame:
        """version, change and the row of every logged change, or of one version."""
        fields = [T.StructField("change", T.StringType()), *self.schema.fields, T.StructField("version", T.IntegerType())]
        rows = self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/log")
        return rows if version is None else rows.where(F.col("version") == version)

    def replay(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, from the log alone."""
        columns = self.schema.fieldNames()
        rows = self.log() if version is None else self.log().where(F.col("version") <= version)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "version").alias("_row"))
        return last.select("_row.*")
