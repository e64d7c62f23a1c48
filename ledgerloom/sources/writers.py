"""Writing tables: partitioned, idempotent, in parts, with a place for rejected rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filings import keep_last


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)


def write_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Append the rows whose keys the table at ``path`` lacks, so a second run writes nothing twice."""
    fresh = df.dropDuplicates(keys)
    if _exists(df, path):
        fresh = fresh.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(df: DataFrame, path: str, keys: list[str], order: list[str], partition_by: list[str]) -> None:
    """One row per key, the last by ``order``, as JSON in a folder per partition value."""
    keep_last(df, keys, order).write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    chunks.write.mode("overwrite").partitionBy("source_type").format(fmt).save(path)


def write_parts(df: DataFrame, path: str, rows: int = 100_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def recreate(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def upsert(spark_table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after the changes: rows of a key that changes hold are replaced, others stay; of repeated changes one counts."""
    return spark_table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.dropDuplicates([key]), allowMissingColumns=True)


def send_batches(df: DataFrame, send: Callable[[list], None], size: int = 512) -> None:
    """Each partition to an outside service in batches, the last one shorter; ``send`` must bear a retried task's repetition."""

    def run(rows: Iterator) -> None:
        batch = []
        for r in rows:
            batch.append(r)
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines after what is there; finished partitions outlive a crash."""
    df.write.mode("append").json(path)


def write_objects(objects: DataFrame, path: str) -> None:
    objects.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def group_map(groups: DataFrame, path: str) -> None:
    """One JSON object per file name with its groups, in order."""
    per_file = groups.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("group_no", "items"))), lambda g: g["items"]).alias("groups"))
    per_file.write.mode("overwrite").json(path)


def quarantined(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``_error``): the error expression is null for good rows."""
    flagged = df.withColumn("_error", error)
    return flagged.where("_error is null").drop("_error"), flagged.where("_error is not null")
