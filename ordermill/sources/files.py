"""Reading raw files, reading and writing cleaned tables, views and previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ordermill.operators.shaping import inline_rows
from ordermill.schemas import CLEAN_TABLES, QUOTED_NEWLINES, RAW

def read_csv(spark: SparkSession, path: str, schema: str, quoted_newlines: bool = False) -> DataFrame:
    """A headered CSV with a given schema; empty fields are null, doubled quotes are one quote."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", quoted_newlines).option("mode", "FAILFAST").csv(path))


def read_raw(spark: SparkSession, folder: str,
             files: Mapping[str, str]) -> dict[str, DataFrame]:
    """One lazy frame for each raw table, from the files that the caller names for them.

    Reviews have line breaks in their text, so one task parses each of their files whole;
    have them delivered in many files.
    """
    return {name: read_csv(spark, f"{folder}/{file}", RAW[name], name in QUOTED_NEWLINES)
            for name, file in files.items()}


def read_clean(spark: SparkSession, folder: str,
               names: Sequence[str] = CLEAN_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def write_clean(tables: Mapping[str, DataFrame], folder: str, by_month: bool = False) -> dict[str, int]:
    """Write every table as parquet, replacing what was there, and tell how many rows each got.

    Rows are counted while they are written. ``by_month`` lays orders out by purchase month, so
    that a date range reads only its months. Never write where you read.
    """
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"rows-{name}")
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if by_month and "order_purchase_timestamp" in df.columns:
            month = F.date_format("order_purchase_timestamp", "yyyy-MM")
            rows = rows.withColumn("purchase_month", month).repartition("purchase_month", F.spark_partition_id() % 16)
            rows.write.mode("overwrite").partitionBy("purchase_month").parquet(f"{folder}/{name}.parquet")
        else:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = seen.get["n"]
    return counts


def load_tables(tables: Mapping[str, DataFrame], database: str, folder: str | None = None,
                bucket_by_order: int = 0) -> list[str]:
    """Rebuild one catalog table per frame, in the order given, and return their names.

    ``bucket_by_order`` buckets tables that carry ``order_id`` on it, so that later
    joins between them need no shuffle.
    """
    names = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if folder:
            writer = writer.option("path", f"{folder}/{name}")
        if bucket_by_order and "order_id" in df.columns:
            writer = writer.bucketBy(bucket_by_order, "order_id").sortBy("order_id")
        target = f"{database}.{name}"
        writer.saveAsTable(target)
        names.append(target)
    return names


def append_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str],
                batch_size: int = 20_000, connections: int = 8) -> None:
    """Append rows to an outside database in batches, over a bounded number of connections."""
    df.write.jdbc(url, table, mode="append", properties={
        **properties, "batchsize": str(batch_size), "numPartitions": str(connections)})


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> DataFrame:
    """Create or replace the temporary views and list those that now exist."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    found = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    return inline_rows(spark, [(n, n in found) for n in views], "view string, created boolean")


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 8) -> DataFrame:
    """The first ``n`` rows under a total order, each with the row count of the full result."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))


def source_manifest(spark: SparkSession, folder: str, expected: Sequence[str]) -> DataFrame:
    """Every expected file (or folder of part files): part files, bytes, rows, and whether it is missing.

    All comes from the hidden file columns of a scan that reads no data column; rows of other formats than parquet are
    lines. Files that hold no row at all are not counted.
    """
    def one(name: str) -> DataFrame:
        path = f"{folder}/{name}"
        try:
            rows = spark.read.parquet(path) if name.endswith(".parquet") else spark.read.text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return inline_rows(spark, [(name, None, None, None, True)],
                               "file_name string, parts long, file_size long, table_rows long, missing boolean")
        parts = rows.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
            F.max("file_size").alias("size"), F.count("*").alias("n"))
        return parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("size"), F.lit(0)).alias("file_size"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("table_rows")).select(
            F.lit(name).alias("file_name"), "parts", "file_size", "table_rows", F.lit(False).alias("missing"))
    return reduce(DataFrame.unionByName, [one(name) for name in expected])


def require_complete(manifest: DataFrame) -> None:
    """Fail when an expected file is missing."""
    missing = [r.file_name for r in manifest.filter("missing").collect()]  # as many as were expected at most
    if missing:
        raise FileNotFoundError(f"missing source files: {', '.join(missing)}")
