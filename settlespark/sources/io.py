"""Reading and writing waveform, feature and result tables and models."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

# The columns of the training and of the scoring file.
TRAIN_SCHEMA = StructType([
    StructField("wave_id", LongType()),
    StructField("sample", IntegerType()),
    StructField("time_ms", DoubleType()),
    StructField("value", DoubleType()),
    StructField("sd", DoubleType()),
    StructField("low_limit", DoubleType()),
    StructField("high_limit", DoubleType()),
])
SCORING_SCHEMA = StructType([
    StructField("wave_id", LongType()),
    StructField("sample", IntegerType()),
    StructField("time", DoubleType()),
    StructField("value", DoubleType()),
    StructField("low_limit", DoubleType()),
    StructField("high_limit", DoubleType()),
])


def _schema_of_header(header: list[str]) -> StructType:
    known = {tuple(s.fieldNames()): s for s in (TRAIN_SCHEMA, SCORING_SCHEMA)}
    if tuple(header) not in known:
        raise ValueError(f"give a schema: no known file has the columns {header}")
    return known[tuple(header)]


def read_signals(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    format: str | None = None,
    infer: bool = False,
) -> DataFrame:
    """Read a CSV (with header), Parquet or other table; the format follows the name.

    Without a ``schema``, a CSV file gets the training or the scoring schema,
    whichever its header names; ``infer=True`` reads the file once more to guess
    the types.  Empty CSV fields are null.
    """
    format = format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True)
        if infer:
            return reader.option("inferSchema", True).load(path)
        # columns are matched by position, so a wrong header must not pass
        schema = schema or _schema_of_header(reader.load(path).columns)
        return reader.option("enforceSchema", False).schema(schema).load(path)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "overwrite",
    partition_by: str | list[str] | None = None,
) -> None:
    """Write a table as a folder of files, CSV with a header."""
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def write_bucketed(
    df: DataFrame, name: str, path: str, buckets: int, id: str = "wave_id",
    order: str | list[str] = "sample",
) -> None:
    """Save a waveform table bucketed by wave, so that later jobs need no exchange for it."""
    order = [order] if isinstance(order, str) else order
    # one writer per bucket, or every task would leave a file in every bucket
    writer = df.repartition(buckets, id).write.format("parquet").mode("overwrite")
    writer.bucketBy(buckets, id).sortBy(id, *order).option("path", path).saveAsTable(name)


def new_run_id(now: datetime | None = None) -> str:
    """A run id: date and time, as 20250131_083000."""
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def _marker(path: str, run_id: str) -> str:
    return f"{path}/_runs/{run_id}.json"


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and sizes of the data files in a folder."""
    target, system = _hadoop(spark, folder)
    found = system.listStatus(target) if system.exists(target) else []
    sizes = {f.getPath().getName(): f.getLen() for f in found}
    return {name: size for name, size in sizes.items() if name[0] not in "_."}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it over the old one in one step."""
    target, system = _hadoop(spark, path)
    draft, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(draft, target, options)


def _read_marker(spark: SparkSession, path: str, run_id: str) -> dict | None:
    marker = _marker(path, run_id)
    target, system = _hadoop(spark, marker)
    if not system.exists(target):
        return None
    return json.loads(spark.read.text(marker, wholetext=True).first()[0])


def write_run(df: DataFrame, path: str, run_id: str, format: str = "parquet") -> None:
    """Write a table as one run beside earlier runs; only that run is replaced.

    The files go to a folder of their own.  A marker is written last and renamed into
    place: it names the files with their sizes, the number of rows and the schema.  A
    writer that dies before that leaves the run as it was.  The files of a replaced run
    are deleted once the new marker stands.
    """
    if not re.fullmatch(r"\w[\w.:-]*", run_id):
        raise ValueError(f"a run id is made of letters, digits and _ . : -, not {run_id!r}")
    spark, rows = df.sparkSession, df.drop("run_id")
    before = _read_marker(spark, path, run_id)
    folder = f"run_id={run_id}/{uuid.uuid4().hex}"
    write_table(rows, f"{path}/{folder}", format, mode="errorifexists")
    written = read_signals(spark, f"{path}/{folder}", rows.schema, format)
    _put(spark, _marker(path, run_id), json.dumps({
        "run_id": run_id, "folder": folder, "format": format, "rows": written.count(),
        "files": _files(spark, f"{path}/{folder}"), "schema": rows.schema.json(),
        "schema_sha256": hashlib.sha256(rows.schema.json().encode()).hexdigest(),
    }))
    if before:
        target, system = _hadoop(spark, f"{path}/{before['folder']}")
        system.delete(target, True)


def read_run(
    spark: SparkSession, path: str, run_id: str, format: str | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read one run with the schema it was written with; only its folder is listed.

    A run without a marker, or whose files are not those that the marker names, is refused.
    """
    run = _read_marker(spark, path, run_id)
    if run is None:
        raise FileNotFoundError(f"no finished run {run_id} in {path}")
    if format not in (None, run["format"]):
        raise ValueError(f"run {run_id} is written as {run['format']}, not {format}")
    if _files(spark, f"{path}/{run['folder']}") != run["files"]:
        raise ValueError(f"the files of run {run_id} in {path} are not those it was finished with")
    if hashlib.sha256(run["schema"].encode()).hexdigest() != run["schema_sha256"]:
        raise ValueError(f"the marker of run {run_id} in {path} is damaged")
    schema = schema or StructType.fromJson(json.loads(run["schema"]))
    df = read_signals(spark, f"{path}/{run['folder']}", schema, run["format"])
    return df.withColumn("run_id", F.lit(run_id))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished run: ``run_id``, ``rows``, ``n_files``, ``schema_sha256``."""
    columns = "run_id string, rows long, files map<string, long>, schema_sha256 string"
    target, system = _hadoop(spark, f"{path}/_runs")
    if not system.exists(target):
        return spark.createDataFrame([], "run_id string, rows long, n_files long, schema_sha256 string")
    markers = spark.read.schema(columns).json(f"{path}/_runs", pathGlobFilter="*.json")
    return markers.select("run_id", "rows", F.size("files").cast("long").alias("n_files"), "schema_sha256")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
