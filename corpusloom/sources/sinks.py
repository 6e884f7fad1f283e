"""Sinks: JSON lines, CSV, routed outputs, previews, rendered files, idempotent appends."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import ArrayType, MapType, StructType


def ordered(df: DataFrame, front: Sequence[str], back: Sequence[str]) -> DataFrame:
    """Columns in canonical order: front ones, all others as they come, back ones."""
    middle = [c for c in df.columns if c not in front and c not in back]
    return df.select(*(c for c in front if c in df.columns), *middle, *(c for c in back if c in df.columns))


def write_json(df: DataFrame, path: str, front: Sequence[str] = (), back: Sequence[str] = (), mode: str = "overwrite") -> None:
    ordered(df, front, back).write.mode(mode).json(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, null as empty text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = (ArrayType, MapType, StructType)
    return df.select(*(F.coalesce(F.to_json(c) if isinstance(kinds[c], nested) else F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


#: The byte order mark, which tells spreadsheet programs that a file is UTF-8.
MARK = "\ufeff"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file, and the byte order mark before it; Spark writes none, so it is part of the first column's name."""
    ready = csv_ready(df)
    ready.withColumnRenamed(ready.columns[0], MARK + ready.columns[0]).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_csv` wrote, as text."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*(c.removeprefix(MARK) for c in rows.columns)).na.fill("")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or for a local master without it, a temporary one.

    It is deleted when the driver's Python ends, if its session hasn't ended before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-work-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark.sparkContext, folder)
    atexit.register(_delete, spark.sparkContext, f"{folder}-checkpoint")
    return folder


def _delete(sc, folder: str) -> None:
    if sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read back: its lineage is cut, and a lost executor loses none of it. It goes when the driver's Python ends."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def routed(df: DataFrame, kind: str, route: str, path: str) -> None:
    """All routes in one write: a folder of each kind and route."""
    df.write.mode("overwrite").partitionBy(kind, route).parquet(path)


def preview(df: DataFrame, order: Sequence[str], limit: int = 80) -> tuple[DataFrame, int]:
    """The first rows in order, and how many there are."""
    return df.orderBy(*order).limit(limit), df.count()


def rendered(df: DataFrame, name: Column, *parts: Column) -> DataFrame:
    """(file_name, text) from a template: present parts, separated by blank lines."""
    return df.select(name.alias("file_name"), F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts)).alias("text"))


def front_matter(**fields: Column) -> Column:
    """Present fields as a front-matter block."""
    rows = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key isn't there yet, each key once: of rows with one key the least by all columns, whenever it is run again.

    One writer at a time: two that run side by side may both find a key missing and append it.
    """
    from corpusloom.sources.readers import exists

    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    fresh = df.groupBy(F.col(key).alias("__key")).agg(F.min(whole).alias("__row")).select("__row.*")
    if exists(df.sparkSession, path):
        fresh = fresh.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def written(df: DataFrame, path: str, mode: str = "overwrite", **measures: Column) -> dict[str, object]:
    """Writes df and gives ``rows`` and the aggregates asked for, from the pass that writes: nothing is scanned a second time."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in measures.items())).write.mode(mode).parquet(path)
    return dict(seen.get)


def written_each(tables: Mapping[str, DataFrame], folder: str, told: Callable[[str, int], None] | None = None) -> dict[str, int]:
    """Writes tables one after another and gives the rows of each; one that fails has -1, and the others go on.

    ``told`` hears of each when it is done. What a table that failed had written is not committed.
    """
    counts = {}
    for name, df in tables.items():
        try:
            counts[name] = written(df, f"{folder}/{name}")["rows"]
        except PySparkException as failure:
            logging.getLogger(__name__).warning("%s wasn't written: %s", name, str(failure).split("\n", 1)[0])
            counts[name] = -1
        if told is not None:
            told(name, counts[name])
    return counts


class Progress(StreamingQueryListener):
    """Tells (rows done, batches done) after each micro-batch of the streams of one name, while they run."""

    def __init__(self, name: str, told: Callable[[int, int], None]):
        self.name, self.told, self.rows, self.batches = name, told, 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if event.progress.name == self.name and event.progress.numInputRows:
            self.rows, self.batches = self.rows + event.progress.numInputRows, self.batches + 1
            self.told(self.rows, self.batches)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
