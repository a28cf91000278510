"""Answer and run-time outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_answers(
    answers: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", files: int | None = None
) -> None:
    """Write answers as parquet, json, csv or text.

    ``files=1`` gives one file, for the few rows of a single query; by default a large
    workload is written in parallel. csv and text take nested columns as json.
    """
    if files:
        answers = answers.coalesce(files)
    if fmt in ("csv", "text"):
        nested = {f.name for f in answers.schema if f.dataType.typeName() in ("array", "struct", "map")}
        columns = [F.to_json(c).alias(c) if c in nested else F.col(c) for c in answers.columns]
        answers = answers.select(*columns)
    if fmt == "text":
        answers = answers.select(
            F.concat_ws("\t", *(F.col(c).cast("string") for c in answers.columns)).alias("value")
        )
    answers.write.mode(mode).format(fmt).save(path)


def write_run_metrics(spark: SparkSession, path: str, query: str, k: int, millis: int) -> None:
    """Append one row with the run time of a query."""
    row = spark.createDataFrame([(query, k, millis)], "query string, k int, runtime_ms bigint")
    row.coalesce(1).write.mode("append").parquet(path)
