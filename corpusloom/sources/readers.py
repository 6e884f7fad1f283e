"""Scans: JSON lines, Markdown folders, binary files, tables, HTML pages.

All readers are lazy, take explicit schemas and keep where a row is from, so order is explicit. Paths are read by Spark alone, so
any store that it knows will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON-lines files with ``source_file``; missing files have none, blank lines are skipped.

    strict: a malformed line is an error; else it is dropped.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("source_file", StringType())]))
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(there)
    return rows.select(*schema.names, F.col("_metadata.file_name").alias("source_file"))


def markdown_folder(spark: SparkSession, folder: str, names: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(file_name, size, modified, text) of a folder's Markdown files in order of name; names that aren't there are an error."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder)
    rows = rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    if names is not None:
        rows = rows.filter(F.col("file_name").isin(*names))
        lost = set(names) - {r[0] for r in rows.select("file_name").collect()}
        if lost:
            raise FileNotFoundError(", ".join(sorted(lost)))
    rows = rows.orderBy("file_name")
    return rows.limit(limit) if limit is not None else rows


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run hasn't done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
