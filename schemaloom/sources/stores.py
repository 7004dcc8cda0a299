"""Object stores and warehouses by way of Spark: its file systems, its catalogs and its connectors.

There is no client library here. An object is read by the file system that
Spark has for its scheme; a warehouse table by a catalog or a connector that
the session is configured with.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from schemaloom.functions.errors import StoreError, WarehouseError
from schemaloom.functions.support import on_transient, retrying
from schemaloom.sources.fields import Field, from_struct
from schemaloom.sources.records import hadoop_path, is_object_store, split_object

# Environment variables that name a default project, in this order.
PROJECT_VARIABLES = ("GOOGLE_CLOUD_PROJECT", "GCP_PROJECT")
CONNECTOR = "com.google.cloud.spark.bigquery.BigQueryRelationProvider"
DEFAULT_LOCATION = "US"


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return (p := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(conf), p, conf


def store_status(spark: SparkSession, path: str = "gs://bucket/object") -> tuple[bool, str]:
    """Whether Spark has a file system for the path's scheme, and what to say about it."""
    scheme = path.partition("://")[0] if "://" in path else "file"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getFileSystemClass(scheme, conf)
    except Exception as e:
        return False, f"{scheme}: no file system ({getattr(e, 'java_exception', e)})"
    return True, f"{scheme}: {found.getName()}"


def local_name(path: str, folder: str = "data") -> str:
    """Where a copy of an object lies: bucket and object joined by underscores."""
    bucket, name = split_object(path)
    return str(Path(folder) / f"{bucket}_{name.replace('/', '_')}")


@retrying(3, 0.5, 2.0, StoreError, lambda e: e.details.get("missing") is None)
def fetch(spark: SparkSession, path: str, local: str, force: bool = False) -> str:
    """Copy a file of any of Spark's file systems to a local path, once; a copy broken off leaves nothing behind."""
    target = Path(local)
    if target.is_file() and not force:
        return str(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{os.getpid()}.part")
    try:
        store, source, _ = _file_system(spark, hadoop_path(path))
        if not store.exists(source):
            raise StoreError("no such object", path=path, missing=True)
        store.copyToLocalFile(False, source, spark.sparkContext._jvm.org.apache.hadoop.fs.Path("file://" + str(part.resolve())), True)
        part.replace(target)
    except StoreError:
        raise
    except Exception as e:
        raise StoreError("copy failed", path=path, cause=e) from e
    finally:
        part.unlink(missing_ok=True)
    return str(target)


def resolve(spark: SparkSession, path: str, folder: str = "data", force: bool = False) -> str:
    """A local path for code that opens files itself; objects are fetched. Data is read by hadoop_path instead."""
    return fetch(spark, path, local_name(path, folder), force) if is_object_store(path) else path


def default_project(spark: SparkSession | None = None) -> str:
    """From the environment, else from the connector's setting of the session."""
    for name in PROJECT_VARIABLES:
        if value := os.environ.get(name):
            return value
    value = spark.conf.get("parentProject", None) if spark is not None else None
    if not value:
        raise WarehouseError("no default project", variables=" ".join(PROJECT_VARIABLES))
    return value


def warehouse_reader(spark: SparkSession, project: str | None = None) -> DataFrameReader:
    """A reader of the warehouse's connector; an error if the session has none."""
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(CONNECTOR, False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception as e:
        raise WarehouseError("the session has no connector to the warehouse", connector=CONNECTOR, cause=e) from e
    return spark.read.format("bigquery").option("parentProject", project or default_project(spark))


@on_transient
def live_fields(spark: SparkSession, name: str) -> list[Field]:
    """The fields of a table that a catalog of the session knows, or of project:dataset.table by the connector."""
    try:
        return from_struct(spark.table(name.replace(":", ".")).schema)
    except AnalysisException:
        pass  # no catalog of the session has it
    project, _, table = name.rpartition(":")
    try:
        return from_struct(warehouse_reader(spark, project or None).load(name.replace(":", ".")).schema)
    except WarehouseError as e:
        raise WarehouseError("no such table", table=name, cause=e) from e


def dataset_location(schemata: DataFrame, dataset: str) -> str:
    """The region of a dataset from rows of information_schema.schemata (schema_name, location)."""
    row = schemata.where(schemata["schema_name"] == dataset).select("location").first()
    return row["location"] if row and row["location"] else DEFAULT_LOCATION
